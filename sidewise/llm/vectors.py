"""Exact top-k by inner product with a dual-tree search over cover trees.

Candidates and queries are each indexed by a cover tree, and the two are descended together. For a query node with centre q
and radius s and a candidate node with centre c and radius r, no pair below can score more than
``q.c + r|q| + s|c| + r s``; the node pair is skipped when that does not reach the worst kth score of the group's queries.

Spark deals the work: equal vectors are one candidate with its smallest ids (no query needs more than k + 1 of
them), candidates form blocks of ``BLOCK`` distinct vectors, queries too, and every query block meets every candidate
block in a task of its own. Query blocks first search their own small set of strong candidates (the largest norms of all
blocks) so that the bound is good from the start. Results of a query are merged by a window over k rows per block.

Scores are whole numbers and exact: in double precision while they stay below 2^53, in 64-bit integers below 2^62, in unbounded integers
beyond. Bounds are computed in double precision with a margin, and only skip.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without id;
rows of equal id and vector count once; a query's own rows are those with its id; vectors of different lengths are never
compared (a query meets candidates of its length); components and scores beyond a 64-bit integer are moved to its ends, where they tie;
an empty table yields no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sidewise.llm.common import only
from sidewise.plans.storage import cut

BLOCK = 4096
LEAF = 128
# Centres that a node tries; points near none of them share leaves of their own.
CENTRES = 24
SEEDS = 64


class CoverTree:
    """A simplified cover tree over the rows of ``points``, in arrays: centre, radius, children, members.

    Nodes are built from the top: a node's points within half its radius of its centre stay with the centre, the others get
    centres of their own no closer than that (the cover and separation conditions). In many dimensions most points are near
    nothing; those share leaves around the node's centre. Leaves hold up to ``LEAF`` points.
    """

    def __init__(self, points: np.ndarray):
        self.whole = points
        self.points = points.astype(np.float64)
        self.norms = np.sqrt((self.points**2).sum(axis=1))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        if len(points):
            self._build(0, np.arange(len(points)))

    def _leaf(self, centre: int, members: np.ndarray) -> int:
        distances = np.sqrt(((self.points[members] - self.points[centre]) ** 2).sum(axis=1))
        return self._node(centre, float(distances.max()), members)

    def _node(self, centre: int, radius: float, members: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(radius)
        self.children.append([])
        self.members.append(members)
        return len(self.centre) - 1

    def _build(self, centre: int, members: np.ndarray) -> int:
        distances = np.sqrt(((self.points[members] - self.points[centre]) ** 2).sum(axis=1))
        radius = float(distances.max())
        node = self._node(centre, radius, members)
        if len(members) <= LEAF or radius == 0.0:
            return node
        rest, near = members, distances <= radius / 2
        where, children, alone = centre, [], []
        for _ in range(CENTRES):
            own = rest[near]
            if len(own) > LEAF // 4:
                children.append(self._build(where, own))
            else:
                alone.append(own)
            rest = rest[~near]
            if not len(rest):
                break
            where = int(rest[0])
            near = np.sqrt(((self.points[rest] - self.points[where]) ** 2).sum(axis=1)) <= radius / 2
        scattered = np.concatenate([*alone, rest])
        for i in range(0, len(scattered), LEAF):
            children.append(self._leaf(centre, scattered[i : i + LEAF]))
        self.children[node] = children
        return node


# Scores that no double and no 64-bit integer can miss, with room for the rounding of the norms.
DOUBLE_EXACT, LONG_EXACT = 2.0**52, 2.0**62
LOWEST, HIGHEST = -(2**63), 2**63 - 1
# Relative to the product of the norms; far above what a sum of products in double precision is off by.
ROUNDING = 1e-12


def products(queries: CoverTree, group: np.ndarray, candidates: CoverTree, own: np.ndarray) -> np.ndarray:
    """Exact inner products of some queries and some candidates as 64-bit integers."""
    # No partial sum of a product exceeds the product of the norms.
    largest = queries.norms[group].max() * candidates.norms[own].max()
    if largest < DOUBLE_EXACT:
        return np.rint(queries.points[group] @ candidates.points[own].T).astype(np.int64)
    if largest < LONG_EXACT:
        return queries.whole[group] @ candidates.whole[own].T
    unbounded = queries.whole[group].astype(object) @ candidates.whole[own].astype(object).T
    return np.clip(unbounded, LOWEST, HIGHEST).astype(np.int64)


def search(queries: CoverTree, candidates: CoverTree, worst: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For every query the ``k`` best candidates of this tree that reach ``worst``: scores and places (-1: none).

    ``worst`` holds for each query a score that its kth best is known to reach.
    """
    n = len(queries.points)
    scores = np.full((n, k), LOWEST, np.int64)
    places = np.full((n, k), -1, np.int64)
    if not n or not len(candidates.points):
        return scores, places
    known = worst.astype(np.float64).copy()
    stack = [(0, 0)]
    while stack:
        q, c = stack.pop()
        group = queries.members[q]
        qc, cc = queries.centre[q], candidates.centre[c]
        s, r = queries.radius[q], candidates.radius[c]
        bound = queries.points[qc] @ candidates.points[cc] + r * queries.norms[qc] + s * candidates.norms[cc] + r * s
        # Terms that cancel out leave an error in proportion to the norms.
        error = ROUNDING * (queries.norms[qc] + s) * (candidates.norms[cc] + r)
        if bound + 1e-6 * (1 + abs(bound)) + error < known[group].min():
            continue
        q_children, c_children = queries.children[q], candidates.children[c]
        if not q_children and not c_children:
            own = candidates.members[c]
            product = products(queries, group, candidates, own)
            both = np.concatenate([scores[group], product], axis=1)
            names = np.concatenate([places[group], np.broadcast_to(own, product.shape)], axis=1)
            # Ties keep the smaller place; candidates are numbered by their smallest id.
            order = np.lexsort((np.where(names < 0, len(candidates.points), names), ~both), axis=1)[:, :k]
            scores[group] = np.take_along_axis(both, order, axis=1)
            places[group] = np.take_along_axis(names, order, axis=1)
            reached = np.where(places[group, k - 1] >= 0, scores[group, k - 1].astype(np.float64), -np.inf)
            known[group] = np.maximum(known[group], reached)
        elif c_children and (not q_children or r >= s):
            # The most promising child last, so that it is taken first.
            centres = [candidates.centre[x] for x in c_children]
            for i in np.argsort(candidates.points[centres] @ queries.points[qc]):
                stack.append((q, c_children[i]))
        else:
            stack.extend((x, c) for x in q_children)
    return scores, places


def top_k(
    vectors: DataFrame, is_query: Column, k: int, scale: int, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best other rows of every query row.

    Components are taken as ``floor(scale * x)``. ``is_query`` is a condition on a column named ``id``.
    """
    whole = F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    usable = F.size("vector") > 0
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = only(vectors, id=id_column, vector=vector_column).filter("id is not null and vector is not null")
    rows = rows.filter(usable & finite).select("id", whole.alias("vector")).distinct()
    rows = cut(rows, "vectors")
    # Of equal vectors the k + 1 smallest ids are enough for every query; the window keeps no more per task before its shuffle.
    place = Window.partitionBy("vector").orderBy("id")
    first_ids = rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k + 1)
    distinct = first_ids.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    candidates = cut(distinct.select("vector", "ids", F.size("vector").alias("width")), "candidates")
    queries = rows.filter(is_query)
    asked = cut(
        queries.groupBy("vector").agg(F.min("id").alias("name")).select("vector", "name", F.size("vector").alias("width")),
        "asked",
    )
    found = _search_blocks(asked, candidates, k)
    # Back from distinct vectors to rows: every query drops its own id and keeps the first k.
    own = queries.select(F.col("id").alias("query_id"), "vector").join(asked.select("vector", "name"), "vector")
    best = own.select("query_id", "name").join(found, "name").filter("vec_id != query_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        best.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _search_blocks(asked: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """``name, vec_id, score``: for every distinct query vector its ``k + 1`` best ids."""
    sizes = {row["width"]: row["count"] for row in candidates.groupBy("width").count().collect()}
    asked_sizes = {row["width"]: row["count"] for row in asked.groupBy("width").count().collect()}
    spark = asked.sparkSession
    # The largest norms of all candidates, whatever the query, give every query a first bound.
    norm = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    seeds = {
        width: np.array([row["vector"] for row in candidates.filter(F.col("width") == width).orderBy(norm.desc(), "ids").limit(SEEDS).collect()])
        for width in asked_sizes
    }
    if not asked_sizes:
        return spark.createDataFrame([], "name long, vec_id long, score long")

    def blocks(counts: dict[int, int]) -> Column:
        number = F.lit(1)
        for width, count in counts.items():
            number = F.when(F.col("width") == width, -(-count // BLOCK)).otherwise(number)
        return number

    def block_of(counts: dict[int, int]) -> Column:
        return F.pmod(F.xxhash64("vector", F.lit(5)), blocks(counts)).cast("int")

    def all_of(counts: dict[int, int]) -> Column:
        return F.explode(F.sequence(F.lit(0), (blocks(counts) - 1).cast("int")))

    asking = asked.select("width", block_of(asked_sizes).alias("q"), "name", "vector").withColumn("c", all_of(sizes))
    offered = (
        candidates.filter(F.col("width").isin(list(asked_sizes)))
        .select("width", block_of(sizes).alias("c"), "ids", "vector")
        .withColumn("q", all_of(asked_sizes))
    )
    keys = ["width", "q", "c"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _block(left, right, seeds[key[0].as_py()], k)

    found = (
        asking.select(*keys, "name", "vector").groupBy(*keys)
        .cogroup(offered.select(*keys, "ids", "vector").groupBy(*keys))
        .applyInArrow(run, "name long, vec_id long, score long")
    )
    best = Window.partitionBy("name").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place")


def _block(left: pa.Table, right: pa.Table, seeds: np.ndarray, k: int) -> pa.Table:
    """One query block against one candidate block."""
    names, ids, scores = [], [], []
    if left.num_rows and right.num_rows:
        order = sorted(range(right.num_rows), key=right.column("ids").to_pylist().__getitem__)
        right = right.take(order)
        asked = _matrix(left.column("vector"))
        offered = _matrix(right.column("vector"))
        # k + 1: one of the best may be the query itself.
        ends = (asked.astype(np.float64), seeds.astype(np.float64))
        sizes = [np.sqrt((end**2).sum(axis=1)) for end in ends]
        first = np.sort(ends[0] @ ends[1].T - ROUNDING * np.outer(*sizes), axis=1)[:, ::-1]
        # No score is above the largest integer, so a bound must not be either.
        first = np.minimum(first, float(HIGHEST))
        worst = first[:, k] if first.shape[1] > k else np.full(len(asked), -np.inf)
        found, places = search(CoverTree(asked), CoverTree(offered), worst, k + 1)
        own_ids = right.column("ids").to_pylist()
        for name, row, place in zip(left.column("name").to_pylist(), found, places):
            for score, p in zip(row, place):
                if p >= 0:
                    for key in own_ids[p]:
                        names.append(name)
                        ids.append(key)
                        scores.append(int(score))
    return pa.table(
        {"name": pa.array(names, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())}
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    merged = column.combine_chunks()
    if isinstance(merged, pa.ChunkedArray):
        merged = pa.concat_arrays(merged.chunks)
    return merged.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(merged), -1)
