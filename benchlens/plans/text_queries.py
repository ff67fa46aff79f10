"""Acceptance queries: lines, token usage, event logs and outcomes (documents, events, orders)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.functions import scalar as X
from benchlens.operators import text as T
from benchlens.plans.fixtures import table
from benchlens.session import scratch_path
from benchlens.sinks.writers import append_outcomes
from benchlens.sources.lines import file_lines, table_lines

# Token list and log parameters of the acceptance queries.
TOKENS = ["the", "of", "and", "by", "on"]
TAIL_N = 10


def line_scan(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text")
    return table_lines(d, ["doc_id"], "text")


def file_line_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as text files, a folder per source, read back as numbered lines of the folder.

    Rows are range-partitioned by (source, doc_id), so a frequent source has
    several files, whose order is that of the documents.
    """
    root = scratch_path(spark, "doc-files")
    d = table(spark, sf, "documents").select("source", "doc_id", "text")
    d = d.repartitionByRange("source", "doc_id").sortWithinPartitions("source", "doc_id")
    d.select("source", "text").write.partitionBy("source").text(root)
    lines = file_lines(spark, root, per_folder=True)
    return lines.select(F.regexp_extract("folder", "source=([^/]*)$", 1).alias("source"), "line_no", F.col("text").alias("line"))


def token_usage(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("source", "text")
    return T.token_usage(d, "text", TOKENS, by=["source"]).select("source", "token", "n", "total")


def token_usage_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts by language, where one language counts as unknown (null)."""
    d = table(spark, sf, "documents").select(F.nullif("lang", F.lit("en")).alias("lang"), "text")
    return T.token_usage(d, "text", TOKENS, by=["lang"])


# What a line does with the tokens, by its other words.
KINDS = {kind: f"(?:^|[^a-z0-9_])(?:{words})(?:[^a-z0-9_]|$)" for kind, words in (
    ("question", "what|when"), ("motion", "to|from"), ("state", "is|was|are|be"))}


def token_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of the tokens in all lines of ``documents`` by kind of line, with the unexplained rest."""
    lines = table_lines(table(spark, sf, "documents").select("doc_id", "source", "text"), ["source"], "text")
    return T.token_remainder(lines, "line", TOKENS, KINDS, by=["source"])


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a logged command (customer = log, order = line block), read back as segments."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    name = F.col("o_orderkey").cast("string")
    took = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("Total benchmarking time: "), X.duration_text(F.col("o_totalprice") / 1e6)))
    failed = F.when(F.col("o_orderstatus") == "F", X.error_line(F.concat(F.lit("bench "), name), F.col("o_orderkey") % 5 + 1))
    each = o.select("o_custkey", "o_orderkey", F.posexplode(F.array_compact(F.array(
        F.concat(F.lit("+ bench "), name), F.concat(F.lit("total + "), F.col("o_totalprice").cast("string")), took, failed))).alias("p", "text"))
    return T.run_log(each.withColumn("line_no", F.col("o_orderkey") * 4 + F.col("p")), ["o_custkey"], "line_no", "text")


def outcome_lists(spark: SparkSession, sf: str) -> DataFrame:
    o = _outcomes(spark, sf).withColumn("pkg", F.concat(F.lit("pkg-"), F.col("o_orderkey").cast("string")))
    return T.outcome_list(o, "pkg", by=["o_orderpriority"])


def event_rate(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("user_id", "event_type")
    r = T.event_rate(ev, ["user_id"], "event_type")
    return r.select("user_id", "event_type", "n", "total", F.round("rate", 6).alias("rate"))


def event_tail(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    t = T.tail_matching(ev, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()],
                        F.col("event_type") == "error", TAIL_N)
    return t.select("user_id", "event_id", "value", "rank")


def log_segments(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    s = T.log_segments(ev, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", ts="ts")
    return s.select("user_id", "segment", "n_lines", "first_line", "last_line",
                    F.round("duration_s", 6).alias("duration_s"), "duration",
                    F.round(X.duration_seconds("duration"), 6).alias("duration_back"))


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return o.select("o_orderkey", "o_orderpriority",
                    F.when(F.col("o_orderstatus") == "F", F.lit("failed")).otherwise(F.lit("ok")).alias("status"))


def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = T.outcome_summary(_outcomes(spark, sf), by=["o_orderpriority"])
    return s.select("o_orderpriority", "status", "n", "total", F.round("share", 6).alias("share"), "summary")


def outcome_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Failed runs -> error lines appended to a log table in two batches -> read back and parsed."""
    failed = _outcomes(spark, sf).where(F.col("status") == "failed")
    cmd = F.concat(F.lit("run-bench pkg-"), F.col("o_orderkey").cast("string"))
    lines = failed.select("o_orderpriority", X.error_line(cmd, F.col("o_orderkey") % 5 + 1).alias("line"))
    path = scratch_path(spark, "outcome-log")
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    append_outcomes(lines.where(urgent), path)
    append_outcomes(lines.where(~urgent), path)
    back = spark.read.text(path)
    return back.select(X.error_cmd("value").alias("cmd"), X.error_code("value").alias("code"))


SQL = {
    "line_scan": """
SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no,
       unnest(string_split(text, chr(10))) AS line FROM documents""",
    "file_line_scan": """
WITH l AS (SELECT source, doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i,
                  unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id, i) AS BIGINT) AS line_no, line FROM l""",
    "token_kinds": r"""
WITH l AS (SELECT source, lower(unnest(string_split(text, chr(10)))) AS line FROM documents),
c AS (SELECT source, CASE WHEN regexp_matches(line, '(^|[^a-z0-9_])(what|when)([^a-z0-9_]|$)') THEN 'question'
                          WHEN regexp_matches(line, '(^|[^a-z0-9_])(to|from)([^a-z0-9_]|$)') THEN 'motion'
                          WHEN regexp_matches(line, '(^|[^a-z0-9_])(is|was|are|be)([^a-z0-9_]|$)') THEN 'state' END AS kind,
             len(list_filter(string_split_regex(line, '[^\p{L}]+'), lambda w: w IN ('the', 'of', 'and', 'by', 'on'))) AS c FROM l),
g AS (SELECT source, kind, CAST(sum(c) AS BIGINT) AS n FROM c WHERE c > 0 GROUP BY source, kind)
SELECT source, kind, n, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS mentions,
       CAST(coalesce(sum(n) FILTER (WHERE kind IS NULL) OVER (PARTITION BY source), 0) AS BIGINT) AS unexplained FROM g""",
    "run_log": """
SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS segment,
       'bench ' || CAST(o_orderkey AS VARCHAR) AS cmd, CAST(CASE o_orderstatus WHEN 'P' THEN 2 ELSE 3 END AS BIGINT) AS n_lines,
       o_orderkey * 4 AS first_line, o_orderkey * 4 + CASE o_orderstatus WHEN 'P' THEN 1 ELSE 2 END AS last_line,
       CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_totalprice / 1e6 >= 1 THEN round_even(o_totalprice / 1e6 * 1000, 0) / 1000
            WHEN o_totalprice / 1e6 >= 1e-3 THEN round_even(o_totalprice / 1e6 * 1e3 * 1000, 0) / 1000 * 1e-3
            ELSE round_even(o_totalprice / 1e6 * 1e6 * 1000, 0) / 1000 * 1e-6 END END AS seconds,
       CASE WHEN o_orderstatus = 'F' THEN 'bench ' || CAST(o_orderkey AS VARCHAR) END AS error_cmd,
       CAST(CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 5 + 1 END AS INTEGER) AS error_code FROM orders""",
    "outcome_lists": """
SELECT o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ok' END AS status,
       'pkg-' || CAST(o_orderkey AS VARCHAR) AS pkg FROM orders""",
    "token_usage": r"""
WITH w AS (SELECT source, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS token FROM documents),
c AS (SELECT source, token, CAST(count(*) AS BIGINT) AS n FROM w
      WHERE token IN ('the', 'of', 'and', 'by', 'on') GROUP BY source, token)
SELECT source, token, n, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS total FROM c""",
    "token_usage_unknown": r"""
WITH w AS (SELECT nullif(lang, 'en') AS lang, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS token FROM documents),
c AS (SELECT lang, token, CAST(count(*) AS BIGINT) AS n FROM w
      WHERE token IN ('the', 'of', 'and', 'by', 'on') GROUP BY lang, token)
SELECT lang, token, n, CAST(sum(n) OVER (PARTITION BY lang) AS BIGINT) AS total FROM c""",
    "event_rate": """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type),
t AS (SELECT user_id, count(*) AS total FROM events GROUP BY user_id)
SELECT c.user_id, event_type, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total,
       round(1000.0 * n / total, 6) + 0.0 AS rate FROM c JOIN t USING (user_id)""",
    "event_tail": f"""
SELECT user_id, event_id, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT user_id, event_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
  FROM events WHERE event_type = 'error') WHERE rank <= {TAIL_N}""",
    "log_segments": """
WITH s AS (
  SELECT user_id, ts,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_pos,
         sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END)
           OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment
  FROM events),
g AS (SELECT user_id, CAST(segment AS BIGINT) AS segment, CAST(count(*) AS BIGINT) AS n_lines,
             CAST(min(line_pos) AS BIGINT) AS first_line, CAST(max(line_pos) AS BIGINT) AS last_line,
             (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS d FROM s GROUP BY user_id, segment),
f AS (SELECT *, CASE WHEN d >= 1 THEN printf('%.3f s', round_even(d * 1000, 0) / 1000)
                     WHEN d >= 1e-3 THEN printf('%.3f ms', round_even(d * 1e3 * 1000, 0) / 1000)
                     WHEN d >= 1e-6 THEN printf('%.3f us', round_even(d * 1e6 * 1000, 0) / 1000)
                     ELSE printf('%.3f ns', round_even(d * 1e9 * 1000, 0) / 1000) END AS duration FROM g)
SELECT user_id, segment, n_lines, first_line, last_line, round(d, 6) + 0.0 AS duration_s, duration,
       round(CAST(regexp_extract(duration, '^([0-9.]+) (ns|us|ms|s)$', 1) AS DOUBLE) *
             CASE regexp_extract(duration, '^([0-9.]+) (ns|us|ms|s)$', 2)
                  WHEN 's' THEN 1.0 WHEN 'ms' THEN 1e-3 WHEN 'us' THEN 1e-6 ELSE 1e-9 END, 6) + 0.0 AS duration_back
FROM f""",
    "outcome_counts": """
WITH o AS (SELECT o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'ok' END AS status FROM orders),
t AS (SELECT o_orderpriority, count(*) AS total FROM o GROUP BY o_orderpriority),
c AS (SELECT t.o_orderpriority, s.status, total, (SELECT count(*) FROM o WHERE o.o_orderpriority = t.o_orderpriority AND o.status = s.status) AS n
      FROM t, (VALUES ('ok'), ('failed')) s(status))
SELECT o_orderpriority, status, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, round(n / total, 6) + 0.0 AS share,
       printf('%d/%d packages %s', n, total, CASE WHEN status = 'ok' THEN 'succeeded' ELSE 'failed' END) AS summary FROM c""",
    "outcome_parse": """
SELECT 'run-bench pkg-' || CAST(o_orderkey AS VARCHAR) AS cmd, CAST(o_orderkey % 5 + 1 AS INTEGER) AS code
FROM orders WHERE o_orderstatus = 'F'""",
}

QUERIES = {
    "line_scan": line_scan,
    "file_line_scan": file_line_scan,
    "token_usage": token_usage,
    "token_usage_unknown": token_usage_unknown,
    "event_rate": event_rate,
    "event_tail": event_tail,
    "log_segments": log_segments,
    "outcome_counts": outcome_counts,
    "outcome_parse": outcome_parse,
    "outcome_lists": outcome_lists,
    "token_kinds": token_kinds,
    "run_log": run_log,
}
