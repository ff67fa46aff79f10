"""The next row in a global order, without a global sort in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchlens.session import target_partitions

_KEY = "_key"
MOST_BUCKETS = 65_536  # ranges; bounds the keys that the driver sees


def _bounds_column(key: Column, bounds: list[str], key_type: str) -> Column:
    """Number of ``bounds`` (sorted JSON keys) that are not above ``key``: two short searches instead of one long."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    table = F.from_json(F.lit("[" + ",".join("[" + ",".join(b) + "]" for b in blocks) + "]"), f"array<array<{key_type}>>")
    block = F.size(F.filter(table, lambda b: F.element_at(b, 1) <= key))  # blocks that begin at or below the key
    inside = F.size(F.filter(F.element_at(table, F.greatest(block, F.lit(1))), lambda x: x <= key))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + inside)


def with_next(df: DataFrame, id_col: str, tie: Column, carry: dict[str, str], buckets: int | None = None,
              prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """``df`` with the columns ``carry`` (name -> new name) of the next row in ascending ``id_col``.

    ``prepare`` adds columns that depend on a row alone (and may be costly):
    it runs once for each row, and for the few rows that stand in twice.

    Rows of one id are ordered by ``tie`` (a long), null ids come last, and
    the next of the last row is the first. Bounds of ``buckets`` ranges (by
    default four per shuffle partition, at most ``MOST_BUCKETS``) come from a hash sample of the (id,
    tie) keys, so an id that many rows share is cut too; the sample and the
    first keys of the ranges are all that the driver sees. Each range is
    ordered by itself and gets the first row of the next range at its end. Rows that are
    equal in id and tie count as equal. ``df`` is read four times.
    """
    spark = df.sparkSession
    buckets = buckets or min(4 * target_partitions(spark), MOST_BUCKETS)
    keyed = df.withColumn(_KEY, F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), tie.alias("t")))
    key_type = keyed.schema[_KEY].dataType.simpleString()
    sampled = keyed.select(_KEY).orderBy(F.xxhash64(_KEY)).limit(min(16 * buckets, 4 * MOST_BUCKETS))
    # sorted by Spark, so that the order is the one of its comparisons
    rows = [r[0] for r in sampled.distinct().sort(_KEY).select(F.to_json(_KEY, {"ignoreNullFields": "false"})).collect()]
    bounds = [rows[i * len(rows) // buckets] for i in range(1, buckets)] if len(rows) > 1 else []
    bounds = list(dict.fromkeys(bounds))
    placed = keyed.withColumn("_bucket", _bounds_column(F.col(_KEY), bounds, key_type))
    # min of a struct with a null id: the flag keeps nulls last
    heads = {r["_bucket"]: r["k"] for r in placed.groupBy("_bucket").agg(
        F.to_json(F.min(_KEY), {"ignoreNullFields": "false"}).alias("k")).collect()}
    order = sorted(heads)
    before = [(order[i - 1], heads[b]) for i, b in enumerate(order)]  # the range before the first is the last
    ends = spark.createDataFrame(before, "_bucket int, _head string").select(
        "_bucket", F.from_json("_head", key_type).alias("_head"))
    first = keyed.join(F.broadcast(ends), F.col(_KEY).eqNullSafe(F.col("_head"))).dropDuplicates(["_bucket"]).drop("_head")
    every = prepare(placed).withColumn("_extra", F.lit(False)).unionByName(prepare(first).withColumn("_extra", F.lit(True)))
    w = Window.partitionBy("_bucket").orderBy("_extra", _KEY)
    every = every.withColumns({new: F.lead(old).over(w) for old, new in carry.items()})
    return every.where(~F.col("_extra")).drop("_extra", "_bucket", _KEY)
