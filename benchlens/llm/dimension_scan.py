"""Approximate nearest neighbours by an adaptive dimension scan of probed lists.

Vectors are dealt to the lists of their nearest centroid. A list is scanned in
blocks of randomly rotated vectors that are stored column by column: after each
block of columns the partial squared distances are scaled up to all dimensions,
and a hypothesis test abandons candidates that are unlikely to be among the
nearest. What is left gets its exact distance from the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.llm.shipping import ship
from benchlens.session import scratch_path

MOST_LISTS = 4096  # bounds what is broadcast: centroids and the sample
SAMPLE_PER_LIST = 64  # vectors that centroids and first thresholds are fitted on
BLOCK_ROWS = 4096  # rows of a list that one task scans together
QUERY_ROWS = 4096  # queries that meet a block of a list at once
COLUMNS = 16  # dimensions between two tests
EPSILON = 2.1  # strictness of the test: larger abandons later


@dataclass
class Plan:
    """All that tasks need besides the vectors; its size is bounded by ``MOST_LISTS``."""

    centroids: np.ndarray
    rotation: np.ndarray
    sample_ids: np.ndarray
    sample: np.ndarray
    share: float
    k: int
    sizes: np.ndarray | None = None  # rows of each list
    sample_lists: np.ndarray | None = None  # list of each sampled row

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        """Nearest centroid of each row."""
        c = self.centroids
        return np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)

    def probes(self, q: np.ndarray) -> np.ndarray:
        """Nearest lists of a query that together hold ``share`` of all rows, and well over ``k`` rows."""
        order = np.argsort(((self.centroids - q) ** 2).sum(1), kind="stable")
        held = np.cumsum(self.sizes[order])
        return order[:int(np.searchsorted(held, max(self.share * held[-1], 64 * self.k))) + 1]

    def threshold(self, own: int, q: np.ndarray, lists: np.ndarray) -> float:
        """Distance that the k-th nearest row of ``lists`` cannot exceed: that of the k-th nearest of their sampled rows."""
        inside = np.zeros(len(self.centroids), bool)
        inside[lists] = True
        others = (self.sample_ids != own) & inside[self.sample_lists]
        d = np.sqrt(((self.sample[others] - q) ** 2).sum(1))
        near = _nearest_ids(d, self.sample_ids[others], self.k)
        return near[-1][0] if len(near) == self.k else np.inf


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([np.argmin((c * c).sum(1)[None, :] - 2 * part @ c.T, axis=1) for part in np.array_split(x, -(-len(x) // 4096))])
        n = np.bincount(at, minlength=k)
        for j in range(x.shape[1]):
            c[:, j] = np.where(n > 0, np.bincount(at, x[:, j], k) / np.maximum(n, 1), c[:, j])
    return c


def _nearest_ids(distance: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[float, int]]:
    """The ``k`` nearest different ids as (distance, id), each at its least distance, ties to smaller ids."""
    order = np.lexsort((ids, distance))
    first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
    return [(float(distance[i]), int(ids[i])) for i in order[first]]


def nearest_in_block(ids: np.ndarray, x: np.ndarray, turned: np.ndarray, own: int, q: np.ndarray, q_turned: np.ndarray,
                     limit: float, k: int, step: int = 1024) -> list[tuple[float, int]]:
    """The ``k`` nearest ids of a block within ``limit`` (as (distance, id), ties to smaller ids).

    ``turned`` holds the rotated vectors column by column (dimensions x rows).
    """
    dims, best = len(q), []
    slack = 1e-12 * float(q @ q)
    for at in range(0, len(ids), step):
        alive = np.flatnonzero(ids[at:at + step] != own) + at
        partial = np.zeros(alive.size)
        for first in range(0, dims, COLUMNS):
            cols = slice(first, first + COLUMNS)
            partial = partial + ((turned[cols, alive] - q_turned[cols, None]) ** 2).sum(axis=0)
            seen = min(first + COLUMNS, dims)
            loose = 1 + EPSILON / np.sqrt(seen) if seen < dims else 1.0
            keep = partial * (dims / seen) <= limit * limit * loose * loose * (1 + 1e-9) + slack
            alive, partial = alive[keep], partial[keep]
            if not alive.size:
                break
        if alive.size:
            exact = np.sqrt(((x[alive] - q) ** 2).sum(axis=1))
            best = _nearest_ids(np.append(exact, [d for d, _ in best]), np.append(ids[alive], np.array([j for _, j in best], ids.dtype)), k)
            if len(best) == k:
                limit = min(limit, best[-1][0])
    return best


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the vectors that take part, as doubles: of the most frequent length (ties: the shorter)."""
    v = F.col("vec")
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where(
        F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
        & F.exists(v, lambda x: x != 0))
    sizes = good.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return good.where(F.size(v) == (sizes["d"] if sizes else 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def parts_of(rows: int, most: int) -> int:
    """Parts of about ``most`` rows."""
    return max(1, -(-rows // most))


def scan_groups(index: DataFrame, asked: DataFrame, blocks: list[int], parts: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with their keys (list, block, part): ``blocks`` of each list, ``parts`` of the queries.

    Rows are dealt by hashes of id and vector, queries by one of the id, so neither a
    crowded list, nor an id with many vectors, nor the number of queries makes a large group.
    """
    per_list = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("list") + 1)
    left = index.withColumn("block", F.pmod(F.xxhash64("id", "vec", F.lit("block")), per_list).cast("int"))
    left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = asked.withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(parts)).cast("int"))
    right = right.select("id", "vec", "most", "part", F.explode("at").alias("list"))
    return left, right.withColumn("block", F.explode(F.sequence(F.lit(0), per_list - 1)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, share: float = 0.75, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` nearest rows of ``vectors`` by Euclidean distance: (query_id, rank, vec_id, score).

    A query is compared with the lists nearest to it that together hold
    ``share`` of all rows (all rows of small tables), so the result is
    approximate; distances are exact. Every row is indexed; centroids and
    first thresholds come from ``SAMPLE_PER_LIST`` rows per list, with the
    square root of the row count as lists (at most ``MOST_LISTS``). Lists are
    scanned in blocks of about ``BLOCK_ROWS`` rows by parts of about
    ``QUERY_ROWS`` queries, so neither side of a task's group grows with the
    tables, and a crowded list is many tasks' work. Of a query id with several
    vectors the one with the least hash is taken. Vectors that are null, zero, or hold
    null or non-finite components take no part on either side, nor do null ids
    and vectors of another length than most; a row never finds its own id;
    repeated rows count once; ties go to the smaller id. Empty tables give an
    empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    own_rows = scratch_path(spark, "vectors")
    usable(vectors, id_col, vec_col).distinct().write.parquet(own_rows)  # copies neither fill the sample nor the probed share
    rows = spark.read.parquet(own_rows)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = max(1, min(MOST_LISTS, round(n ** 0.5)))
    some = rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("vec")).limit(SAMPLE_PER_LIST * lists).toArrow()
    x = _matrix(some["vec"])
    rotation = np.linalg.qr(np.random.default_rng(11).normal(size=(x.shape[1], x.shape[1])))[0]
    plan = Plan(kmeans(x, min(lists, len(x))), rotation, some["id"].to_numpy(), x, share, k)
    shared = ship(spark, plan)
    with_list = T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("list", T.IntegerType())])

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = shared().lists_of(_matrix(b.column(1))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], names=with_list.names)

    path = scratch_path(spark, "lists")
    rows.mapInArrow(deal, with_list).write.parquet(path)
    index = spark.read.parquet(path)
    sizes = np.zeros(len(plan.centroids), np.int64)
    for r in index.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    plan.sizes, plan.sample_lists = sizes, plan.lists_of(x)
    blocks = [parts_of(int(s), BLOCK_ROWS) for s in sizes]
    ready = ship(spark, plan)
    asked = T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType())),
                          T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("most", T.DoubleType())])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ready()
        for b in batches:
            qs = list(zip(b.column(0).to_pylist(), _matrix(b.column(1)))) if b.num_rows else []
            probed = [own.probes(q) for _, q in qs]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([p.tolist() for p in probed], pa.list_(pa.int32())),
                 pa.array([own.threshold(i, q, p) for (i, q), p in zip(qs, probed)], pa.float64())], names=asked.names)

    def scan(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        own = ready()
        found: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            ids, vec = left["id"].to_numpy(), _matrix(left["vec"])
            turned = np.ascontiguousarray((vec @ own.rotation).T)
            qs = _matrix(right["vec"])
            for i, q, t, most in zip(right["id"].to_pylist(), qs, qs @ own.rotation, right["most"].to_pylist()):
                found += [(i, j, d) for d, j in nearest_in_block(ids, vec, turned, i, q, t, most, own.k)]
        cols = list(zip(*found)) if found else [(), (), ()]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=out.names)

    q = usable(queries, id_col, vec_col).where(F.size("vec") == x.shape[1]).groupBy("id").agg(
        F.min_by("vec", F.xxhash64("vec")).alias("vec"))
    # a stated number of tasks, as few bytes would be put together into one
    own_queries = scratch_path(spark, "queries")
    q.repartition(spark.sparkContext.defaultParallelism, "id").mapInArrow(ask, asked).write.parquet(own_queries)
    q = spark.read.parquet(own_queries)
    left, right = scan_groups(index, q, blocks, parts_of(q.count(), QUERY_ROWS))
    keys = ("list", "block", "part")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, out)
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
