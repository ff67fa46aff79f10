"""Derived inputs built from the driver tables.

``runs``: two benchmark runs (A, B) of per-program linear fits, derived from
all of ``events``. A block is an event type, a program a user in one half of
the day; y is the running sum of ``value`` and i the row number, both in (ts,
event_id) order inside (run, block, program); cpu = slope of y on i, r2 its
fit quality (both null for a single event). Users without such an event in one
of the runs are its orphans. ``block_lists``: the (user, hour) pairs that each
run has, as two lists of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.operators.ordered import running

# Fixed values of the fixture definition.
RUN_SPLIT_TS = "2024-01-16 00:00:00"
MIN_POINTS = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, block, program, cpu, r2, n, first_ts) over the whole ``events`` table.

    ``first_ts`` (the program's first event in the run) gives the row order of
    a block's result list for the order-sensitive alignment.
    """
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    # Literal of the column's own type: no session-time-zone conversion either way.
    split = F.lit(RUN_SPLIT_TS).cast(ev.schema["ts"].dataType)
    run = F.when(F.col("ts") < split, F.lit("A")).otherwise(F.lit("B"))
    ev = ev.select(
        run.alias("run"), F.col("event_type").alias("block"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.when(F.hour("ts") < 12, ".am").otherwise(".pm")).alias("program"),
        "ts", "event_id", "value")
    seq = running(ev, ["run", "block", "program"], ["ts", "event_id"], sums={"y": "value"}, index="i")
    fitted = F.count(F.lit(1)) >= MIN_POINTS
    return seq.groupBy("run", "block", "program").agg(
        F.when(fitted, F.round(F.regr_slope("y", "i"), 9)).alias("cpu"),
        F.when(fitted, F.round(F.regr_r2("y", "i"), 9)).alias("r2"),
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"))


def block_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The blocks ('u<user>/<hour>') of each run, from all of ``events``; rows repeat."""
    ev = table(spark, sf_dir, "events").select("ts", "user_id")
    split = F.lit(RUN_SPLIT_TS).cast(ev.schema["ts"].dataType)
    block = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.hour("ts").cast("string")).alias("block")
    return ev.where(F.col("ts") < split).select(block), ev.where(F.col("ts") >= split).select(block)


def file_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The result files (block, path) of each run, one for each user, day and event type; rows repeat."""
    ev = table(spark, sf_dir, "events").select("ts", "user_id", "event_type")
    split = F.lit(RUN_SPLIT_TS).cast(ev.schema["ts"].dataType)
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    path = F.concat_ws("/", F.lit("results"), F.date_format("ts", "yyyy-MM-dd"), F.col("event_type"), F.concat(user, F.lit(".csv")))
    ev = ev.select("ts", user.alias("block"), path.alias("path"))
    return ev.where(F.col("ts") < split).select("block", "path"), ev.where(F.col("ts") >= split).select("block", "path")


FILES_SQL = f"""
files AS (SELECT ts < TIMESTAMP '{RUN_SPLIT_TS}' AS early, 'u' || CAST(user_id AS VARCHAR) AS block,
                 'results/' || strftime(ts, '%Y-%m-%d') || '/' || event_type || '/u' || CAST(user_id AS VARCHAR) || '.csv' AS path
          FROM events)"""

RUNS_SQL = f"""
runs AS (
  SELECT run, block, program,
         CASE WHEN count(*) >= {MIN_POINTS} THEN round(regr_slope(y, i), 9) END AS cpu,
         CASE WHEN count(*) >= {MIN_POINTS} THEN round(regr_r2(y, i), 9) END AS r2,
         count(*) AS n, min(ts) AS first_ts
  FROM (
    SELECT run, block, program, ts,
           sum(value) OVER (PARTITION BY run, block, program ORDER BY ts, event_id
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y,
           row_number() OVER (PARTITION BY run, block, program ORDER BY ts, event_id) AS i
    FROM (
      SELECT CASE WHEN ts < TIMESTAMP '{RUN_SPLIT_TS}' THEN 'A' ELSE 'B' END AS run, event_type AS block,
             'u' || CAST(user_id AS VARCHAR) || CASE WHEN hour(ts) < 12 THEN '.am' ELSE '.pm' END AS program,
             ts, event_id, value
      FROM events) e) s
  GROUP BY run, block, program
),
ra AS (SELECT * FROM runs WHERE run = 'A'),
rb AS (SELECT * FROM runs WHERE run = 'B'),
aligned AS (
  SELECT coalesce(ra.block, rb.block) AS block, coalesce(ra.program, rb.program) AS program,
         CASE WHEN ra.program IS NOT NULL AND rb.program IS NOT NULL THEN 'both'
              WHEN ra.program IS NOT NULL THEN 'first' ELSE 'second' END AS side,
         ra.cpu AS cpu1, ra.r2 AS r2_1, rb.cpu AS cpu2, rb.r2 AS r2_2,
         CASE WHEN ra.program IS NOT NULL AND rb.program IS NOT NULL AND ra.cpu <> 0
              THEN rb.cpu / ra.cpu END AS ratio, least(ra.first_ts, rb.first_ts) AS first_ts
  FROM ra FULL OUTER JOIN rb ON ra.block = rb.block AND ra.program = rb.program
)"""

BLOCKS_SQL = f"""
events_of AS (SELECT ts < TIMESTAMP '{RUN_SPLIT_TS}' AS early,
                     'u' || CAST(user_id AS VARCHAR) || '/' || CAST(hour(ts) AS VARCHAR) AS block FROM events),
ba AS (SELECT DISTINCT block FROM events_of WHERE early),
bb AS (SELECT DISTINCT block FROM events_of WHERE NOT early)"""
