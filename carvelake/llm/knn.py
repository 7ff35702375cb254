"""Exact top-k search by inner product over KD-trees, one for each shard.

Median splits along the widest side of a sample of at most ``SAMPLE`` vectors cut space into at most ``REGIONS`` regions; all
vectors are dealt to their regions, and a region of more than ``SHARD`` of them (equal vectors, however many, are in one) to several
shards by row number. Each shard builds one KD-tree by median splits and keeps the tight bounding box of every leaf. A box bounds the inner
product with a query by the sum of the better corner in each dimension. A query visits a shard's leaves best bound first and
stops at the first bound below its k-th score. Two rounds propagate that score: first every query searches one shard of its own
region; the boxes of whole regions (at most ``REGIONS`` + ``LENGTHS``, so they fit in every task) then tell which regions can hold a
better row, and the query goes to their shards only, with the k-th score found so far. Queries travel in blocks of ``BLOCK``, so
a task holds one shard and one block.

Scores are exact integers: components are floor(scale * x), and float64 sums are exact while dim * max^2 < 2^53;
beyond that the shard takes Python integers. Bounds of regions are widened by more than their rounding.

Defined cases: a null vector, or one with null or non-finite components, takes no part; vectors are only compared
within their own length (lengths beyond the ``LENGTHS`` commonest are one region each); ties go to the smaller id; repeated ids are separate candidates, but no row is a candidate
for a query of its own id; null ids take no part; fewer than k candidates give as many rows; an empty table gives an
empty table; other columns are not read; a score beyond the range of a long is set to that range's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, saved_map, table

K, SCALE, SHARD, LEAF, BLOCK = 10, 1024, 8192, 64, 512
REGIONS, SAMPLE, LENGTHS = 1024, 16_384, 64


class KDTree:
    """Rows in leaf order, and each leaf's bounds and box."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(points))
        self.edges: list[tuple[int, int]] = []
        todo = [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                self.edges.append((a, b))
                continue
            own = points[order[a:b]]
            axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, axis], half)]
            todo += [(a, a + half), (a + half, b)]
        self.order = order
        self.points = points[order]
        self.low = np.array([self.points[a:b].min(axis=0) for a, b in self.edges])
        self.high = np.array([self.points[a:b].max(axis=0) for a, b in self.edges])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The best score that any point of each leaf's box could have with each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T


def search(tree: KDTree, ids: np.ndarray, query: np.ndarray, query_id: int, bounds: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of one tree whose score is at least ``floor``, best first, ties to smaller ids."""
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, tree.points.dtype)
    for leaf in np.argsort(-bounds, kind="stable"):
        if bounds[leaf] < floor:
            break
        a, b = tree.edges[leaf]
        scores, own = tree.points[a:b] @ query, ids[a:b]
        ok = (scores >= floor) & (own != query_id)
        if not ok.any():
            continue
        best, best_ids = np.concatenate([best, scores[ok]]), np.concatenate([best_ids, own[ok]])
        if len(best) >= k:
            keep = np.lexsort([best_ids, -best])[:k]
            best, best_ids = best[keep], best_ids[keep]
            floor = max(floor, best[-1])
    order = np.lexsort([best_ids, -best])
    return best_ids[order], best[order]


class Router:
    """Top-level median splits: which region a vector lies in."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.splits: list[tuple[int, float, int, int]] = []  # axis, value, and the next split below it and above it; -1 - region at the ends
        self.leaves = 0
        self.root = self._split(sample, leaves)

    def _split(self, points: np.ndarray, leaves: int) -> int:
        side = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
        if leaves < 2 or not len(side) or not side.max():
            self.leaves += 1
            return -self.leaves
        axis = int(np.argmax(side))
        value = float(np.quantile(points[:, axis], (leaves // 2) / leaves))
        below = points[:, axis] < value
        if not below.any():
            value = float(np.nextafter(value, np.inf))
            below = points[:, axis] < value
        at = len(self.splits)
        self.splits.append((axis, value, 0, 0))
        ends = self._split(points[below], leaves // 2), self._split(points[~below], leaves - leaves // 2)
        self.splits[at] = (axis, value, *ends)
        return at

    def region(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = -1 - at
            elif len(rows):
                axis, value, lower, upper = self.splits[at]
                below = points[rows, axis] < value
                todo += [(lower, rows[below]), (upper, rows[~below])]
        return out


def _matrix(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All components in a row, and where each vector begins."""
    return column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).astype(np.int64)


RESULT = "query_id long, qrow long, vec_id long, score long, region long, low array<long>, high array<long>"
_RESULT = pa.schema([*((c, pa.int64()) for c in ("query_id", "qrow", "vec_id", "score", "region")), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])


def _quantised(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, dim and integer components of the rows that take part."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (
        rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
        .select(F.col("vec_id").cast("long"), F.size("embedding").alias("dim"), F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))
    )


def _located(routers: dict[int, tuple[int, Router]], first_single: int):
    """Adds the region to rows (vec_id, qrow, dim, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column(2).to_numpy()
            flat, at = _matrix(batch.column(3))
            region = dim.astype(np.int64) + first_single
            for d in np.unique(dim).tolist():
                if d in routers:
                    rows = np.flatnonzero(dim == d)
                    base, router = routers[d]
                    region[rows] = base + router.region(flat[at[rows][:, None] + np.arange(d)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(region), batch.column(3)], ["vec_id", "qrow", "dim", "region", "v"])

    return run


def _searched(k: int, leaf: int, boxes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by shard: first its points, then the queries sent to it. boxes: each shard's bounding box is put out too."""
        key = tree = None
        points: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def exact(m: np.ndarray) -> np.ndarray:
            top = float(np.abs(m.astype(float)).max(initial=0))
            return m.astype(np.float64) if m.shape[1] * top * top < 2**53 else m.astype(object)

        def answers(asked: np.ndarray, qrows: np.ndarray, floors: list, queries: np.ndarray) -> pa.RecordBatch:
            queries = exact(queries)
            own = tree
            if object in (queries.dtype, tree.points.dtype):
                queries = queries.astype(np.int64).astype(object)
                if tree.points.dtype != object:
                    tree.points, tree.low, tree.high = (x.astype(np.int64).astype(object) for x in (tree.points, tree.low, tree.high))
            bounds = own.bounds(queries)
            out: list[list] = [[], [], [], []]
            for query_id, qrow, floor, q, b in zip(asked.tolist(), qrows.tolist(), floors, queries, bounds):
                got, scores = search(own, own.ids, q, query_id, b, k, -np.inf if floor is None else floor)
                for o, x in zip(out, ([query_id] * len(got), [qrow] * len(got), got.tolist(), [min(max(int(s), -(2**63)), 2**63 - 1) for s in scores])):
                    o.extend(x)
            n = len(out[0])
            return pa.RecordBatch.from_arrays([*(pa.array(o, pa.int64()) for o in out), pa.nulls(n, pa.int64()), *(pa.nulls(n, f.type) for f in list(_RESULT)[5:])], schema=_RESULT)

        def box() -> pa.RecordBatch:
            low, high = (np.stack(x).tolist() for x in zip(*((p.min(axis=0), p.max(axis=0)) for p in points)))
            low, high = np.min(low, axis=0).tolist(), np.max(high, axis=0).tolist()
            return pa.RecordBatch.from_pylist([{"region": key[1], "low": low, "high": high}], _RESULT)

        for batch in batches:
            shard, kind, region = (batch.column(c).to_numpy() for c in range(3))
            vec, qrow, floor = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5)
            flat, at = _matrix(batch.column(6))
            change = np.ones(len(shard) + 1, bool)
            change[1:-1] = (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1])
            edges = np.flatnonzero(change).tolist() if len(shard) else []
            for a, b in zip(edges, edges[1:]):
                if (now := (int(shard[a]), int(region[a]))) != key:
                    if boxes and points:
                        yield box()
                    key, points, ids, tree = now, [], [], None
                own = flat[at[a] : at[b]].reshape(b - a, -1)
                if kind[a] == 0:
                    points.append(own.copy())
                    ids.append(vec[a:b].copy())
                elif points and own.shape[1]:
                    if tree is None:
                        tree = KDTree(exact(np.concatenate(points)), leaf)
                        tree.ids = np.concatenate(ids)[tree.order]
                    for c in range(a, b, BLOCK):
                        d = min(c + BLOCK, b)
                        yield answers(vec[c:d], qrow[c:d], floor.slice(c, d - c).to_pylist(), own[c - a : d - a])
        if boxes and points:
            yield box()

    return run


def _sent(region_ids: np.ndarray, low: list[list[int]], high: list[list[int]], shards: list[tuple[int, int]]):
    """A row for each shard that a query still has to visit. shards: first shard and number of shards of each region."""
    by_dim: dict[int, np.ndarray] = {d: np.flatnonzero([len(x) == d for x in low]) for d in {len(x) for x in low}}
    corners = {d: (np.array([low[k] for k in rows], float), np.array([high[k] for k in rows], float)) for d, rows in by_dim.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = _matrix(batch.column(5))
            out: list[list[int]] = [[], [], []]
            for k, (dim, home, floor) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)))):
                if not dim or dim not in by_dim:
                    continue
                q = flat[at[k] : at[k + 1]].astype(float)
                lowest, highest = corners[dim]
                bound = np.maximum(q, 0) @ highest.T + np.minimum(q, 0) @ lowest.T
                bound += 1 + 1e-9 * (np.abs(q) @ np.maximum(np.abs(lowest), np.abs(highest)).T)
                keep = by_dim[dim][bound >= (-np.inf if floor is None else floor)]
                for r in keep.tolist():
                    first, n = shards[r]
                    for shard in range(first, first + n):
                        if region_ids[r] != home or shard != first:  # the first shard of its region has been searched
                            for o, x in zip(out, (k, shard, int(region_ids[r]))):
                                o.append(x)
            rows = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), *(batch.column(c).take(rows) for c in (0, 1, 4, 5))], ["shard", "region", "vec_id", "qrow", "floor", "v"]
            )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, shard: int = SHARD, leaf: int = LEAF, regions: int = REGIONS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k best rows of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    points = _quantised(vectors, scale).where("dim > 0").withColumn("qrow", F.lit(0).cast("long")).select("vec_id", "qrow", "dim", "v")
    lengths = points.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()
    total = max(sum(r["count"] for r in lengths), 1)
    sample = points.select("dim", "v").sample(min(1.0, 0.9 * SAMPLE / total), seed=7).limit(SAMPLE).toArrow()
    routers, base = {}, 0
    for r in lengths:
        own = sample.filter(pc.equal(sample.column(0), r.dim)).column(1).combine_chunks()
        leaves = max(1, min(-(-r["count"] // shard), regions * r["count"] // total))
        router = Router(own.flatten().to_numpy().reshape(-1, r.dim) if len(own) else np.zeros((0, r.dim)), leaves)
        routers[r.dim] = base, router
        base += router.leaves
    locate = _located(routers, base)
    kinds = "vec_id long, qrow long, dim int, region long, v array<long>"
    located = saved_map(points, locate, kinds, "knn-points")
    asked = _quantised(queries, scale).where("dim > 0").withColumn("qrow", F.xxhash64("vec_id", "v")).select("vec_id", "qrow", "dim", "v").distinct()
    asked = saved_map(asked, locate, kinds, "knn-queries")

    # regions and their shards: REGIONS at most, and one for each rare length
    sizes = located.groupBy("region").count().withColumn("shards", F.expr(f"int((count + {shard - 1}) div {shard})")).select("region", "shards").orderBy("region").toArrow()
    counts = np.array(sizes.column(1).to_numpy(), np.int64)
    firsts = np.cumsum(counts) - counts
    shards = max(int(counts.sum()), 1)
    if not len(counts):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    of_region = spark.createDataFrame(list(zip(sizes.column(0).to_pylist(), firsts.tolist(), counts.tolist())), "region long, first long, shards long")
    dealt = F.broadcast(of_region)
    placed = located.join(dealt, "region").select((F.col("first") + F.pmod(F.monotonically_increasing_id(), "shards")).alias("shard"), F.lit(0).alias("kind"), "region", "vec_id", "qrow", F.lit(None).cast("long").alias("floor"), "v")
    placed = saved(placed.repartitionById(shards, F.col("shard").cast("int")), "knn-shards")

    def round_(sent: DataFrame, first: bool, label: str) -> DataFrame:
        rows = placed.unionByName(sent.withColumn("kind", F.lit(1)).select("shard", "kind", "region", "vec_id", "qrow", "floor", "v"))
        rows = rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "kind", "vec_id")
        return saved_map(rows, _searched(k, leaf, first), RESULT, label)

    home = asked.join(dealt, "region").select(F.col("first").alias("shard"), "region", "vec_id", "qrow", F.lit(None).cast("long").alias("floor"), "v")
    first = round_(home, True, "knn-first")
    corner = lambda c, least: first.where("query_id is null").select("region", F.posexplode(c).alias("at", "x")).groupBy("region", "at").agg((F.min if least else F.max)("x").alias("x"))
    ordered = lambda df, c: df.groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s.x).alias(c))
    boxes = ordered(corner("low", True), "low").join(ordered(corner("high", False), "high"), "region").orderBy("region").toArrow()
    found = first.where("query_id is not null").select("query_id", "qrow", "vec_id", "score")
    floors = found.groupBy("query_id", "qrow").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floors = floors.select(F.col("query_id").alias("vec_id"), "qrow", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    again = asked.join(floors, ["vec_id", "qrow"], "left").select("vec_id", "qrow", "dim", "region", "floor", "v")
    sent = _sent(np.array(boxes.column("region").to_numpy()), boxes.column("low").to_pylist(), boxes.column("high").to_pylist(), list(zip(firsts.tolist(), counts.tolist())))
    again = saved_map(again, sent, "shard long, region long, vec_id long, qrow long, floor long, v array<long>", "knn-again")
    found = found.unionByName(round_(again, False, "knn-second").select("query_id", "qrow", "vec_id", "score"))
    w = Window.partitionBy("query_id", "qrow").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM p
)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 10
"""
