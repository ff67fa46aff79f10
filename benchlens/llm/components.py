"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchlens.session import scratch_path


def _star_large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _star_small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the least node that it reaches.

    Self-loops and repeated edges are allowed; an empty table gives an empty
    result. Each round is written to the shared scratch folder, which cuts the
    lineage; only a count and a checksum per round reach the driver. The number
    of rounds grows with the logarithm of the longest chain.
    """
    spark = edges.sparkSession

    def written(rows: DataFrame) -> DataFrame:
        path = scratch_path(spark, "stars")
        rows.write.parquet(path)
        return spark.read.parquet(path)

    e, before = written(edges.where("u <> v")), None  # a round reads its edges more than once
    while True:
        e = written(_star_small(_star_large(e) if before else e))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
