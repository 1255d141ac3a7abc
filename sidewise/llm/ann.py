"""Approximate nearest neighbours by Euclidean distance with balanced posting lists.

1. *Lists.* A bounded sample of the distinct vectors is halved again and again along its widest direction, then refined with a
   penalty on size, so that all lists hold about as many vectors. A list is known by its centroid.
2. *Postings.* Every vector goes to the list of its nearest centroid, its home. A boundary vector, one almost as near to others, is
   replicated to them, unless the centroid of a list taken before lies much nearer to that other one than the vector does (queries
   that come near would visit both).
3. *Search.* Centroids form a graph held in memory. A query walks it best first and collects the lists whose centroids are at
   most ``ratio`` times as far as the nearest one (distance-ratio pruning), and more as long as their homes are too few.
   Queries meet postings list by list; whatever is farther than the best sampled vectors of a query stays behind, and the rest
   is ranked with those by the exact distance.

``ratio`` is calibrated: for ``CALIBRATION`` sampled queries the true neighbours are found by a scan of all vectors, and the ratio
at which ``target`` of them lie in visited lists is taken. So recall does not depend on how many vectors there are or how
they are spread; on data without any clusters the ratio gets large and most lists are visited.

The index is fitted on at most ``SAMPLE_BYTES`` of vectors but holds every row. Equal vectors are one posting with its ``k + 1`` smallest
ids (no query needs more). Lists and their queries are dealt in blocks of bounded size, so neither a long list nor a popular
one lands in one task. Centroids, graph and sample, at most ``MAX_LISTS`` and ``SEEDS`` vectors, are all that is broadcast.

Defined results: vectors that are null, empty, all zero or hold null or non-finite components take no part, nor do rows without
id or with another number of components than most usable rows have (of equal numbers, the larger); rows of equal id and vector
count once, and a query's own rows are those with its id; ties go to the smaller id; a query gets all other rows if there are
fewer than ``k``; an empty table yields no rows. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sidewise.llm.common import only
from sidewise.plans.storage import cut

LIST_ROWS, MAX_LISTS = 256, 4096
SAMPLE_PER_LIST, SAMPLE_BYTES = 48, 64 << 20
# A vector is tried with so many centroids and kept in up to so many lists that are at most so much farther than its home.
TRIED, REPLICAS, CLOSURE = 8, 4, 1.1
# A centroid is hidden by one taken before that is nearer to it than this share of the vector's distance.
HIDES = 0.6
DEGREE, BEAM = 16, 32
SEEDS, CALIBRATION, TARGET = 1024, 256, 0.95
BLOCK_ROWS, ASK_ROWS = 4096, 1024
_CELLS = 1 << 20


def squared_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances of all pairs, up to rounding; what overflows is infinitely far."""
    with np.errstate(over="ignore", invalid="ignore"):
        found = (left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None, :] - 2 * left @ right.T
    return np.maximum(np.nan_to_num(found, nan=np.inf, posinf=np.inf), 0)


def exact_distances(vector: np.ndarray, others: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(((others - vector) ** 2).sum(axis=1))


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = 4) -> np.ndarray:
    """Centroids of lists of about equal size: halving along the widest direction, then rounds of k-means with a size penalty."""
    found: list[np.ndarray] = []

    def halve(points: np.ndarray, count: int) -> None:
        if count == 1 or len(points) < 2:
            found.append(points.mean(axis=0))
            return
        centred = points - points.mean(axis=0)
        # A few steps of power iteration from the farthest point.
        way = centred[(centred**2).sum(axis=1).argmax()]
        for _ in range(5):
            way = (centred @ way) @ centred
            way = way / (np.linalg.norm(way) or 1.0)
        order = np.argsort(centred @ way, kind="stable")
        left = max(1, len(points) * (count // 2) // count)
        halve(points[order[:left]], count // 2)
        halve(points[order[left:]], count - count // 2)

    halve(sample, lists)
    centroids = np.array(found)
    size = len(sample) / len(centroids)
    filled = np.full(len(centroids), size)
    for _ in range(rounds):
        penalty = (filled / size - 1) * 0.05
        owners = []
        for i in range(0, len(sample), 1024):
            some = squared_distances(sample[i : i + 1024], centroids)
            owners.append((some + penalty * some.min(axis=1, keepdims=True)).argmin(axis=1))
        owner = np.concatenate(owners)
        filled = np.bincount(owner, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, owner, sample)
        centroids = np.where(filled[:, None] > 0, sums / np.maximum(filled, 1)[:, None], centroids)
    return centroids


class CentroidGraph:
    """A graph over centroids, searched best first.

    A centroid is linked with near ones that no nearer linked one hides, both ways, and with the next one in the order of
    halving, which keeps the graph in one piece.
    """

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        n = len(centroids)
        links: list[set[int]] = [set() for _ in range(n)]
        for start in range(0, n, 256):
            distances = squared_distances(centroids[start : start + 256], centroids)
            near = np.argsort(distances, axis=1, kind="stable")[:, : 4 * DEGREE]
            for i, (row, order) in enumerate(zip(distances, near), start):
                kept: list[int] = []
                for j in order.tolist():
                    if j == i:
                        continue
                    if not kept or (((centroids[kept] - centroids[j]) ** 2).sum(axis=1) > row[j]).all():
                        kept.append(j)
                        if len(kept) == DEGREE:
                            break
                if i + 1 < n:
                    kept.append(i + 1)
                for j in kept:
                    links[i].add(j)
                    links[j].add(i)
        self.links = [np.array(sorted(own), np.int64) for own in links]
        self.entries = np.arange(0, n, max(1, int(np.sqrt(n))))

    def within(self, query: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Centroids at most ``ratio`` times as far as the nearest, nearest first, and their distances."""
        away = exact_distances(query, self.centroids[self.entries])
        first = self.entries[int(away.argmin())]
        seen = np.zeros(len(self.centroids), bool)
        seen[first] = True
        nearest = float(away.min())
        waiting, found = [(nearest, int(first))], []
        while waiting:
            distance, node = heapq.heappop(waiting)
            if distance > ratio * nearest and len(found) >= BEAM:
                break
            found.append((distance, node))
            new = self.links[node]
            new = new[~seen[new]]
            if len(new):
                seen[new] = True
                for d, j in zip(exact_distances(query, self.centroids[new]).tolist(), new.tolist()):
                    heapq.heappush(waiting, (d, j))
                nearest = min(nearest, waiting[0][0])
        found = sorted(pair for pair in found if pair[0] <= ratio * nearest)
        return np.array([j for _, j in found], np.int64), np.array([d for d, _ in found])


def lists_of(vectors: np.ndarray, centroids: np.ndarray) -> list[np.ndarray]:
    """The lists of each vector, its home first."""
    tried = min(TRIED, len(centroids))
    found: list[np.ndarray] = []
    rows = max(1, _CELLS // (tried * max(tried, vectors.shape[1])))
    for start in range(0, len(vectors), rows):
        distances = squared_distances(vectors[start : start + rows], centroids)
        near = np.argpartition(distances, tried - 1, axis=1)[:, :tried] if tried < len(centroids) else np.argsort(distances, axis=1)
        own = np.take_along_axis(distances, near, axis=1)
        order = np.argsort(own, axis=1, kind="stable")
        near, own = np.take_along_axis(near, order, axis=1), np.take_along_axis(own, order, axis=1)
        between = centroids[near]
        gaps = ((between[:, :, None, :] - between[:, None, :, :]) ** 2).sum(axis=3)
        taken = np.zeros(near.shape, bool)
        taken[:, 0] = True
        for i in range(1, tried):
            hidden = (taken & (gaps[:, i, :] < HIDES**2 * own[:, i, None])).any(axis=1)
            taken[:, i] = ~hidden & (own[:, i] <= CLOSURE**2 * own[:, 0]) & (taken.sum(axis=1) < REPLICAS)
        found.extend(row[mask] for row, mask in zip(near, taken))
    return found


@dataclass(frozen=True)
class PostingLists:
    """``postings``: ``list, block, ids, vector`` with ``blocks`` per list. ``rows``: ``id, vector`` of all rows that take part.

    ``homes`` counts the distinct vectors at home in each list, ``seeds`` are distinct vectors of the sample with their ids.
    """

    graph: CentroidGraph
    homes: np.ndarray
    blocks: np.ndarray
    seeds: np.ndarray
    seed_ids: list[list]
    postings: DataFrame
    rows: DataFrame
    distinct: DataFrame
    k: int


def build(vectors: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> PostingLists:
    """Index every usable row of ``vectors`` for searches of up to ``k`` neighbours."""
    rows = only(vectors, id=id_column, vector=vector_column).filter("id is not null and vector is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(finite & F.exists("vector", lambda x: x != 0)).distinct()
    width = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    rows = cut(rows.filter(F.size("vector") == (width["width"] if width else 0)), "vectors")
    # The window keeps no more than k + 1 ids of a vector per task before its shuffle.
    place = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k + 1)
    distinct = cut(few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "distinct")
    total = distinct.count()
    wide = width["width"] if width else 1
    most = max(SAMPLE_PER_LIST, SAMPLE_BYTES // (8 * wide))
    lists = max(1, min(MAX_LISTS, -(-total // LIST_ROWS), most // SAMPLE_PER_LIST))
    drawn = _drawn(distinct, min(most, lists * SAMPLE_PER_LIST), total)
    sample = np.array([row["vector"] for row in drawn] or [[0.0] * wide], np.float64)
    graph = CentroidGraph(balanced_centroids(sample, min(lists, len(sample))))
    placed = cut(_placed(distinct, graph.centroids), "postings")
    counts = placed.groupBy("list").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).collect()
    homes, blocks = np.zeros(len(graph.centroids), np.int64), np.ones(len(graph.centroids), np.int64)
    for row in counts:
        homes[row["list"]] = row["homes"]
        blocks[row["list"]] = -(-row["n"] // BLOCK_ROWS)
    block = F.pmod(F.xxhash64("vector", F.lit(3)), F.lit(blocks.tolist())[F.col("list")]).cast("int")
    postings = placed.select("list", block.alias("block"), "ids", "vector")
    seed_ids = [list(row["ids"]) for row in drawn[:SEEDS]]
    return PostingLists(graph, homes, blocks, sample[: len(seed_ids)], seed_ids, postings, rows, distinct, k)


def _drawn(distinct: DataFrame, wanted: int, total: int) -> list[Row]:
    """About ``wanted`` of ``total`` distinct vectors, those of the smallest hashes, in that order."""
    draw = F.xxhash64("vector", F.lit(17))
    if total > 2 * wanted:
        # One and a half times the wanted number is surely enough and bounds what is sorted.
        distinct = distinct.filter(draw < int((1 << 64) * 1.5 * wanted / total) - (1 << 63))
    return distinct.orderBy(draw, "vector").limit(wanted).collect()


def _placed(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``list, home, ids, vector``: every distinct vector in its lists."""
    sent = distinct.sparkSession.sparkContext.broadcast(centroids)
    kinds = {f.name: f.dataType.simpleString() for f in distinct.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = lists_of(matrix(batch.column("vector")), sent.value)
            counts = np.array([len(x) for x in own])
            rows = pa.array(np.repeat(np.arange(len(own)), counts))
            home = np.zeros(len(rows), bool)
            home[np.cumsum(counts) - counts] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(own).astype(np.int32)), pa.array(home), batch.column("ids").take(rows), batch.column("vector").take(rows)],
                ["list", "home", "ids", "vector"],
            )

    return distinct.select("ids", "vector").mapInArrow(
        run, f"list int, home boolean, ids {kinds['ids']}, vector {kinds['vector']}"
    )


def search(index: PostingLists, is_query: Column, k: int, target: float = TARGET, ratio: float | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: about the ``k`` nearest other rows of every row for which ``is_query`` holds.

    ``is_query`` is a condition on a column named ``id``; without ``ratio`` it is calibrated to find ``target`` of the neighbours.
    """
    if k > index.k:
        raise ValueError(f"The index is built for {index.k} neighbours, not {k}")
    queries = index.rows.filter(is_query)
    asked = cut(queries.groupBy("vector").agg(F.min("id").alias("name")), "asked")
    if ratio is None:
        ratio = calibrated_ratio(index, asked, k, target)
    asks = cut(_asks(index, asked, k, ratio), "asks")
    counts = {row["list"]: row["count"] for row in asks.groupBy("list").count().collect()}
    ask_blocks = [max(1, -(-counts.get(i, 0) // ASK_ROWS)) for i in range(len(index.blocks))]
    wanted = [i in counts for i in range(len(index.blocks))]

    def every(numbers: list[int]) -> Column:
        return F.explode(F.sequence(F.lit(0), (F.lit(numbers)[F.col("list")] - 1).cast("int")))

    # Blocks of queries meet blocks of postings; both have bounded sizes.
    ask_block = F.pmod(F.xxhash64("name", F.lit(5)), F.lit(ask_blocks)[F.col("list")]).cast("int")
    asking = asks.select("list", ask_block.alias("asking"), "name", "bound", "vector").withColumn("block", every(index.blocks.tolist()))
    offered = index.postings.filter(F.lit(wanted)[F.col("list")]).withColumn("asking", every(ask_blocks))
    keys = ["list", "block", "asking"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _nearest(left, right, k + 1)

    name_kind, id_kind = asked.schema["name"].dataType.simpleString(), index.rows.schema["id"].dataType.simpleString()
    found = (
        asking.select(*keys, "name", "bound", "vector").groupBy(*keys)
        .cogroup(offered.select(*keys, "ids", "vector").groupBy(*keys))
        .applyInArrow(run, f"name {name_kind}, vec_id {id_kind}, score double")
    )
    # A replicated vector may be found in several lists, a sampled one there as well.
    nearest = found.unionByName(_among_seeds(index, asked, k)).groupBy("name", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("name").orderBy("score", "vec_id")
    nearest = nearest.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    lists = nearest.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    # One short row per distinct vector: a vector with very many rows only splits the side of the rows.
    answers = asked.join(lists, "name").select("vector", "found")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, k)
    own = queries.select("id", "vector").join(answers, "vector").select("id", F.posexplode(others).alias("place", "one"))
    return own.select(
        F.col("id").alias("query_id"), (F.col("place") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"),
        F.col("one.score").alias("score"),
    )


def nearest_neighbours(
    vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """Index all rows and search for those that ``is_query`` (a condition on ``id``) names."""
    return search(build(vectors, k, id_column, vector_column), is_query, k)


def _among_seeds(index: PostingLists, asked: DataFrame, k: int) -> DataFrame:
    """``name, vec_id, score``: the nearest sampled vectors of each query. They bound what is taken from the lists."""
    sent = asked.sparkSession.sparkContext.broadcast((index.seeds, index.seed_ids))
    name = asked.schema["name"].dataType.simpleString()
    id_kind = index.rows.schema["id"].dataType
    id_type = to_arrow_type(id_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, ids = sent.value
        smallest = np.argsort(np.argsort(np.array([own[0] for own in ids]), kind="stable"))
        for batch in batches:
            owners, keys, scores = [], [], []
            for i, query in enumerate(matrix(batch.column("vector")) if batch.num_rows and len(ids) else []):
                away = exact_distances(query, seeds)
                for j in np.lexsort((smallest, away))[: k + 1].tolist():
                    owners += [i] * len(ids[j])
                    keys += ids[j]
                    scores += [float(away[j])] * len(ids[j])
            yield pa.RecordBatch.from_arrays(
                [batch.column("name").take(pa.array(owners, pa.int64())), pa.array(keys, id_type), pa.array(scores, pa.float64())],
                ["name", "vec_id", "score"],
            )

    return asked.select("name", "vector").mapInArrow(run, f"name {name}, vec_id {id_kind.simpleString()}, score double")


def _asks(index: PostingLists, asked: DataFrame, k: int, ratio: float) -> DataFrame:
    """``list, name, bound, vector``: the lists that each query visits, and a distance that its neighbours do not exceed."""
    sent = asked.sparkSession.sparkContext.broadcast((index.graph, index.homes, index.seeds))
    kinds = {f.name: f.dataType.simpleString() for f in asked.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, homes, seeds = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            queries = matrix(batch.column("vector"))
            lists = [_visited(graph, homes, query, k, ratio) for query in queries]
            # k + 1: one of the seeds may be the query itself.
            away = [np.sort(exact_distances(query, seeds))[k] if len(seeds) > k else np.inf for query in queries]
            counts = [len(own) for own in lists]
            rows = pa.array(np.repeat(np.arange(len(lists)), counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(lists).astype(np.int32)), batch.column("name").take(rows), pa.array(np.repeat(np.array(away), counts)), batch.column("vector").take(rows)],
                ["list", "name", "bound", "vector"],
            )

    return asked.select("name", "vector").mapInArrow(
        run, f"list int, name {kinds['name']}, bound double, vector {kinds['vector']}"
    )


def _visited(graph: CentroidGraph, homes: np.ndarray, query: np.ndarray, k: int, ratio: float) -> np.ndarray:
    lists, _ = graph.within(query, ratio)
    if homes[lists].sum() <= k:
        # Too few vectors nearby: as many lists as it takes, in order of distance.
        order = np.argsort(exact_distances(query, graph.centroids), kind="stable")
        enough = int(np.searchsorted(np.cumsum(homes[order]), k + 1)) + 1
        lists = np.union1d(lists, order[:enough])
    return lists


def calibrated_ratio(index: PostingLists, asked: DataFrame, k: int, target: float) -> float:
    """The distance ratio at which ``target`` of the true neighbours of sampled queries lie in visited lists."""
    drawn = np.array([row["vector"] for row in _drawn(asked, CALIBRATION, asked.count())], np.float64)
    if not len(drawn) or len(index.graph.centroids) == 1:
        return 1.0
    sent = index.distinct.sparkSession.sparkContext.broadcast(drawn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = sent.value
        best, held = np.full((len(queries), 0), np.inf), np.empty((len(queries), 0, queries.shape[1]))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                some = matrix(batch.column("vector").slice(start, BLOCK_ROWS))
                both = np.concatenate([best, squared_distances(queries, some)], axis=1)
                order = np.argsort(both, axis=1, kind="stable")[:, : k + 1]
                best = np.take_along_axis(both, order, axis=1)
                before = held.shape[1]
                held = np.stack([
                    np.stack([held[i, j] if j < before else some[j - before] for j in own]) for i, own in enumerate(order.tolist())
                ])
        for i in range(len(queries) if best.shape[1] else 0):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * best.shape[1], pa.int32()), pa.array(best[i]), pa.array(held[i].tolist(), pa.list_(pa.float64()))],
                ["query", "away", "vector"],
            )

    near = index.distinct.select("vector").mapInArrow(run, "query int, away double, vector array<double>")
    place = Window.partitionBy("query").orderBy("away", "vector")
    near = near.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k + 1).collect()
    needed = []
    for row in near:
        query, vector = drawn[row["query"]], np.array(row["vector"])
        if (query == vector).all():
            continue
        away = exact_distances(query, index.graph.centroids)
        own = lists_of(vector[None, :], index.graph.centroids)[0]
        needed.append(away[own].min() / max(away.min(), np.finfo(float).tiny))
    return float(np.quantile(needed, target, method="higher")) * (1 + 1e-9) if needed else 1.0


def _nearest(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """One block of queries against one block of postings: of the vectors within a query's bound its ``k`` nearest."""
    id_type = right.schema.field("ids").type.value_type
    owners, places, scores = [], [], []
    if left.num_rows and right.num_rows:
        ids = right.column("ids").to_pylist()
        smallest = np.argsort(np.argsort(np.array([own[0] for own in ids]), kind="stable"))
        queries, vectors = matrix(left.column("vector")), matrix(right.column("vector"))
        bounds = left.column("bound").to_numpy()
        rows = max(1, _CELLS // len(vectors))
        for start in range(0, len(queries), rows):
            some = squared_distances(queries[start : start + rows], vectors)
            limit = bounds[start : start + rows] ** 2
            if len(vectors) > k:
                limit = np.minimum(limit, np.partition(some, k - 1, axis=1)[:, k - 1])
            # Room for rounding: the distances that count are computed anew.
            scale = (queries[start : start + rows] ** 2).sum(axis=1) + limit
            near = some <= (limit + 1e-9 * scale)[:, None]
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                own = np.flatnonzero(near[i])
                exact = exact_distances(queries[start + i], vectors[own])
                for j in np.lexsort((smallest[own], exact))[:k].tolist():
                    for key in ids[own[j]]:
                        owners.append(start + i)
                        places.append(key)
                        scores.append(float(exact[j]))
    return pa.table(
        {"name": left.column("name").take(pa.array(owners, pa.int64())), "vec_id": pa.array(places, id_type), "score": pa.array(scores, pa.float64())}
    )


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = pa.chunked_array([column]) if isinstance(column, pa.Array) else column
    parts = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in flat.chunks]
    return np.concatenate(parts).astype(np.float64).reshape(len(flat), -1)
