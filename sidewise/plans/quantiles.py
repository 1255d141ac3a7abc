"""Exact interpolated quantiles of large columns.

The built-in exact percentile keeps every distinct value in one task. Here a sketch first brackets each wanted rank
between two values; then the rows outside the bracket are only counted, and the few inside are fetched. A bracket that
still holds too many rows is narrowed again. No rows are shuffled: each pass is one scan with partial aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# A sketch of this accuracy misses a rank by at most 1/ACCURACY of the rows; brackets reach MARGIN times as far.
ACCURACY = 10_000
MARGIN = 3
# Most values of one bracket that are fetched.
FETCH_LIMIT = 20_000
# Values fetched in one pass over all columns and sides.
FETCH_TOTAL = 500_000
# A bracket that is too full is cut into this many parts of about equal row count.
SLICES = 64


@dataclass(frozen=True)
class Request:
    """Quantiles ``fractions`` of one numeric expression over one table; NULLs are left out."""

    df: DataFrame
    value: Column
    fractions: Sequence[float]


@dataclass
class _Search:
    """The hunt for one quantile: the ranks that make it up and the open bracket they are known to lie in or on."""

    request: int
    fraction: float
    rows: int
    low: float | None = None
    high: float | None = None
    result: float | None = None
    inside: int = 0

    def __post_init__(self):
        self.inside = self.rows

    @property
    def ranks(self) -> tuple[int, int]:
        place = (self.rows - 1) * self.fraction
        return math.floor(place), math.ceil(place)

    @property
    def fetch(self) -> bool:
        return self.inside <= FETCH_LIMIT

    def finish(self, first: float, second: float) -> None:
        place = (self.rows - 1) * self.fraction
        self.result = first if first == second else first + (second - first) * (place - math.floor(place))


def exact_quantiles(requests: Sequence[Request]) -> list[list[float | None]]:
    """The quantiles of all requests, in order; NULL for a column without values."""
    requests = [Request(r.df, r.value.cast("double"), r.fractions) for r in requests]
    if not requests:
        return []
    searches = _start(requests)
    waiting = [s for s in searches if s.rows]
    while waiting:
        _advance(requests, _within_bound(waiting))
        waiting = [s for s in waiting if s.result is None]
    results: list[list[float | None]] = [[] for _ in requests]
    for search in searches:
        results[search.request].append(search.result)
    return results


def _within_bound(waiting: Sequence[_Search]) -> list[_Search]:
    """The searches of one pass: as many as together fetch at most ``FETCH_TOTAL`` values; the others wait for a later one."""
    chosen, total = [], 0
    for search in waiting:
        cost = search.inside if search.fetch else 0
        if not chosen or total + cost <= FETCH_TOTAL:
            chosen.append(search)
            total += cost
    return chosen


def _start(requests: Sequence[Request]) -> list[_Search]:
    """Row counts, and a first bracket from a sketch wherever a column is too long to be fetched."""
    parts = []
    for i, request in enumerate(requests):
        fractions = [_clip(f + d * MARGIN / ACCURACY) for f in request.fractions for d in (-1, 1)]
        sketch = F.percentile_approx(request.value, _numbers(fractions), F.lit(ACCURACY))
        parts.append(_one_row(request.df, i, F.count(request.value).alias("n"), sketch.alias("edges")))
    searches = []
    for row in _run(parts):
        for j, fraction in enumerate(requests[row["i"]].fractions):
            search = _Search(row["i"], fraction, row["n"])
            if search.rows > FETCH_LIMIT:
                search.low, search.high = row["edges"][2 * j], row["edges"][2 * j + 1]
                search.inside = _inside_bound(search.rows)
            searches.append(search)
    return sorted(searches, key=lambda s: s.request)


def _advance(requests: Sequence[Request], waiting: Sequence[_Search]) -> None:
    """One pass: count around all brackets, and fetch their insides or sketch them for narrower ones."""
    parts = []
    of_request: dict[int, list[_Search]] = {}
    for search in waiting:
        of_request.setdefault(search.request, []).append(search)
    for i, searches in of_request.items():
        df, value, edges = requests[i].df, requests[i].value, _edges(searches)
        filled = df.select(value.alias("x")).filter(F.col("x").isNotNull())
        placed = filled.select("x", F.expr(_place(edges)).alias("place"))
        fetched = [_between(s, edges) for s in searches if s.fetch]
        kept = F.when(F.expr(" or ".join(fetched)), F.col("x")) if fetched else F.lit(None).cast("double")
        counts = placed.groupBy("place", kept.alias("x")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(counts.select(*_found(i, place=F.col("place"), x=F.col("x"), n=F.col("n"))))
        for j, search in enumerate(searches):
            if not search.fetch:
                inside = F.when(F.expr(_between(search, edges)), F.col("x"))
                cuts = F.percentile_approx(inside, _numbers(t / SLICES for t in range(1, SLICES)), F.lit(ACCURACY))
                sketch = placed.agg(cuts.alias("cuts"))
                parts.append(sketch.select(*_found(i, search=F.lit(j), cuts=F.col("cuts"))))
    rows = _run(parts)
    for i, searches in of_request.items():
        mine, edges = [r for r in rows if r["i"] == i], _edges(searches)
        counts: dict[int, int] = {}
        for r in mine:
            if r["place"] is not None:
                counts[r["place"]] = counts.get(r["place"], 0) + r["n"]
        values = sorted(((r["x"], r["n"]) for r in mine if r["x"] is not None), key=lambda v: _order(v[0]))
        cuts = {r["search"]: r["cuts"] for r in mine if r["search"] is not None}
        for j, search in enumerate(searches):
            _settle(search, _span(search, edges), counts, values, cuts.get(j))


def _found(i: int, **columns: Column) -> list[Column]:
    types = {"place": "int", "x": "double", "n": "long", "search": "int", "cuts": "array<double>"}
    rest = [columns.get(name, F.lit(None)).cast(t).alias(name) for name, t in types.items()]
    return [F.lit(i).alias("i"), *rest]


def _edges(searches: Sequence[_Search]) -> list[float]:
    return sorted({e for s in searches for e in (s.low, s.high) if e is not None}, key=_order)


def _order(value: float) -> tuple[bool, float]:
    """Spark's order of floats: NaN is the greatest."""
    return (True, 0.0) if math.isnan(value) else (False, value)


def _place(edges: Sequence[float]) -> str:
    """Where ``x`` lies among the edges: 2i+1 on edge i, 2i between the edges i-1 and i.

    The many comparisons are written as one SQL expression, which is quicker to build than as many Columns.
    """
    steps = [f"cast(x >= {_number(e)} as int) + cast(x > {_number(e)} as int)" for e in edges]
    return " + ".join(steps) or "0"


def _number(value: float) -> str:
    return f"double('{value!r}')"


def _numbers(values: Iterable[float]) -> Column:
    return F.expr(f"array({', '.join(_number(v) for v in values)})")


def _span(search: _Search, edges: Sequence[float]) -> tuple[int, int]:
    """The places of a bracket's own edges; just outside all places where it has none."""
    low = -1 if search.low is None else 2 * edges.index(search.low) + 1
    high = 2 * len(edges) + 1 if search.high is None else 2 * edges.index(search.high) + 1
    return low, high


def _between(search: _Search, edges: Sequence[float]) -> str:
    low, high = _span(search, edges)
    return f"(place > {low} and place < {high})"


def _settle(search: _Search, span: tuple[int, int], counts: dict[int, int], values: list, cuts: list | None) -> None:
    low, high = span
    below = sum(n for place, n in counts.items() if place < low)
    start = below + counts.get(low, 0)
    inside = sum(n for place, n in counts.items() if low < place < high)
    stop = start + inside
    end = stop + (counts.get(high, 0) if high != low else 0)
    if search.ranks[0] < below:
        search.low, search.inside = None, search.rows
        return
    if search.ranks[1] >= end:
        search.high, search.inside = None, search.rows
        return
    found = []
    for rank in search.ranks:
        if rank < start:
            found.append(search.low)
        elif rank >= stop:
            found.append(search.high)
        elif search.fetch:
            found.append(_pick(values, search, rank - start))
    if len(found) == 2:
        search.finish(*found)
    elif cuts is None:
        search.inside = inside
    else:
        _narrow(search, cuts, inside, start)


def _pick(values: list, search: _Search, rank: int) -> float:
    """The value at a rank among the fetched ones that lie inside the bracket."""
    seen = 0
    for value, count in values:
        above_low = search.low is None or _order(value) > _order(search.low)
        if above_low and (search.high is None or _order(value) < _order(search.high)):
            seen += count
            if rank < seen:
                return value
    raise AssertionError("the fetched values do not reach the rank")


def _narrow(search: _Search, cuts: Sequence[float], inside: int, start: int) -> None:
    """Keep the part of the bracket between the sketched edges around the wanted ranks."""
    step = inside / SLICES
    slack = inside * MARGIN / ACCURACY + 1
    first = math.floor((search.ranks[0] - start - slack) / step)
    last = math.ceil((search.ranks[1] - start + slack) / step)
    if first >= 1:
        search.low = cuts[min(first, SLICES - 1) - 1]
    if last < SLICES:
        search.high = cuts[max(last, 1) - 1]
    search.inside = min(inside, math.ceil((last - first) * step + 2 * slack))


def _one_row(df: DataFrame, index: int, *aggregates: Column) -> DataFrame:
    return df.agg(*aggregates).select(F.lit(index).alias("i"), "*")


def _run(parts: Sequence[DataFrame]) -> list:
    return reduce(DataFrame.union, parts).collect()


def _inside_bound(rows: int) -> int:
    """Most rows between the two edges of a first bracket."""
    return math.ceil(rows * (2 * MARGIN + 2) / ACCURACY)


def _clip(fraction: float) -> float:
    return min(max(fraction, 0.0), 1.0)
