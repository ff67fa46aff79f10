"""Acceptance queries of the comparison family (two runs derived from ``events``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.operators import compare as C
from benchlens.operators import stats as S
from benchlens.plans.fixtures import BLOCKS_SQL, FILES_SQL, RUNS_SQL, block_lists, file_lists, runs, table

GATE = 0.95


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Both runs aligned straight from the long fixture table (read once, one grouped aggregate)."""
    return C.align_variants(runs(spark, sf), "run", "A", "B", keys=["block", "program"])


def cmp_summary(spark: SparkSession, sf: str) -> DataFrame:
    st = S.geo_stats(C.gated_pairs(_aligned(spark, sf), GATE))
    return st.select("n", "n_invalid", *[F.round(c, 6).alias(c) for c in
                                          ("min_ratio", "max_ratio", "geo_mean", "sdf")])


def cmp_bands(spark: SparkSession, sf: str) -> DataFrame:
    st = S.geo_stats(C.gated_pairs(_aligned(spark, sf), GATE))
    return S.geo_bands(st).select("label", "pos", F.round("ratio", 6).alias("ratio"), "change_pct")


def cmp_align(spark: SparkSession, sf: str) -> DataFrame:
    return _aligned(spark, sf)


def cmp_change(spark: SparkSession, sf: str) -> DataFrame:
    g = C.gated_pairs(_aligned(spark, sf), GATE)
    return g.select("block", "program", "ratio", C.percent_change("ratio").alias("change_pct"))


def cmp_blocks(spark: SparkSession, sf: str) -> DataFrame:
    a, b = block_lists(spark, sf)
    return C.align_blocks(a, b)


def cmp_orphan_blocks(spark: SparkSession, sf: str) -> DataFrame:
    a, b = block_lists(spark, sf)
    return C.orphan_blocks(a, b)


def cmp_orphan_rows(spark: SparkSession, sf: str) -> DataFrame:
    return C.orphan_rows_of(_aligned(spark, sf))


def cmp_orphans_gated(spark: SparkSession, sf: str) -> DataFrame:
    return C.gated_orphans(_aligned(spark, sf), GATE)


def cmp_side_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.side_counts(_aligned(spark, sf))


def cmp_movers(spark: SparkSession, sf: str) -> DataFrame:
    return C.movers(_aligned(spark, sf))


def cmp_dup_keys(spark: SparkSession, sf: str) -> DataFrame:
    """All of lineitem as two 'runs' (line status F and O) whose keys repeat many times.

    block = part key, key = return flag; measure = quantity, quality =
    discount scaled to [0.9, 1]. The n-th lines of a key pair, in (orderkey,
    linenumber) order, which repeats, then by the two values.
    """
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_linestatus", F.col("l_partkey").cast("string").alias("block"),
        F.col("l_returnflag").alias("program"), F.col("l_quantity").alias("cpu"), (F.lit(0.9) + F.col("l_discount")).alias("r2"))
    return C.align_variants(li, "l_linestatus", "F", "O", order=["l_orderkey", "l_linenumber", "cpu", "r2"])


def cmp_file_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The result files of two halves of ``events``: files that share a base name are paired in path order."""
    a, b = file_lists(spark, sf)
    return C.align_blocks(a, b, file="path")


def path_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    """All documents numbered inside their language in path order; documents of one source have no path (null)."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    path = F.concat(F.nullif("source", F.lit("src0")), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"))
    return C.with_occurrence(d.withColumn("path", path), ["lang"], ["path", "doc_id"]).select("doc_id", "lang", "path", "occ")


_CMP_SQL_HEAD = "WITH " + RUNS_SQL

SQL = {
    "cmp_summary": _CMP_SQL_HEAD + """,
g AS (SELECT ratio FROM aligned WHERE side = 'both'
        AND r2_1 IS NOT NULL AND NOT isnan(r2_1) AND r2_1 >= 0.95
        AND r2_2 IS NOT NULL AND NOT isnan(r2_2) AND r2_2 >= 0.95),
v AS (SELECT ratio, ratio IS NOT NULL AND NOT isnan(ratio) AND ratio > 0 AND ratio < 'inf'::DOUBLE AS ok FROM g)
SELECT CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n,
       CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS n_invalid,
       round(min(CASE WHEN ok THEN ratio END), 6) + 0.0 AS min_ratio,
       round(max(CASE WHEN ok THEN ratio END), 6) + 0.0 AS max_ratio,
       round(exp(avg(CASE WHEN ok THEN ln(ratio) END)), 6) + 0.0 AS geo_mean,
       round(exp(stddev_pop(CASE WHEN ok THEN ln(ratio) END)), 6) + 0.0 AS sdf
FROM v""",
    "cmp_bands": _CMP_SQL_HEAD + """,
g AS (SELECT ratio FROM aligned WHERE side = 'both'
        AND r2_1 IS NOT NULL AND NOT isnan(r2_1) AND r2_1 >= 0.95
        AND r2_2 IS NOT NULL AND NOT isnan(r2_2) AND r2_2 >= 0.95),
v AS (SELECT ratio, ratio IS NOT NULL AND NOT isnan(ratio) AND ratio > 0 AND ratio < 'inf'::DOUBLE AS ok FROM g),
st AS (SELECT min(CASE WHEN ok THEN ratio END) AS mn, max(CASE WHEN ok THEN ratio END) AS mx,
              exp(avg(CASE WHEN ok THEN ln(ratio) END)) AS geo,
              exp(stddev_pop(CASE WHEN ok THEN ln(ratio) END)) AS sdf FROM v),
b AS (
  SELECT 'Min' AS label, 1 AS pos, mn AS ratio FROM st UNION ALL
  SELECT 'Max', 2, mx FROM st UNION ALL
  SELECT '-3 s.d.', 3, geo / pow(sdf, 3) FROM st UNION ALL
  SELECT '-2 s.d.', 4, geo / pow(sdf, 2) FROM st UNION ALL
  SELECT '-1 s.d.', 5, geo / sdf FROM st UNION ALL
  SELECT '+1 s.d.', 6, geo * sdf FROM st UNION ALL
  SELECT '+2 s.d.', 7, geo * pow(sdf, 2) FROM st UNION ALL
  SELECT '+3 s.d.', 8, geo * pow(sdf, 3) FROM st UNION ALL
  SELECT 'Geometric mean', 9, geo FROM st)
SELECT label, pos, round(ratio, 6) + 0.0 AS ratio, round_even((ratio - 1) * 100 * 10, 0) / 10 + 0.0 AS change_pct FROM b""",
    "cmp_align": _CMP_SQL_HEAD + """
SELECT block, program, side, cpu1, r2_1, cpu2, r2_2, ratio FROM aligned""",
    "cmp_change": _CMP_SQL_HEAD + """
SELECT block, program, ratio, round_even((ratio - 1) * 100 * 10, 0) / 10 + 0.0 AS change_pct
FROM aligned WHERE side = 'both'
  AND r2_1 IS NOT NULL AND NOT isnan(r2_1) AND r2_1 >= 0.95
  AND r2_2 IS NOT NULL AND NOT isnan(r2_2) AND r2_2 >= 0.95""",
    "cmp_blocks": "WITH " + BLOCKS_SQL + """
SELECT coalesce(ba.block, bb.block) AS block,
       CASE WHEN ba.block IS NOT NULL AND bb.block IS NOT NULL THEN 'both'
            WHEN ba.block IS NOT NULL THEN 'first' ELSE 'second' END AS side
FROM ba FULL OUTER JOIN bb ON ba.block = bb.block""",
    "cmp_orphan_blocks": "WITH " + BLOCKS_SQL + """
SELECT block, 'first' AS side FROM ba WHERE block NOT IN (SELECT block FROM bb)
UNION ALL
SELECT block, 'second' AS side FROM bb WHERE block NOT IN (SELECT block FROM ba)""",
    "cmp_orphan_rows": _CMP_SQL_HEAD + """,
m AS (SELECT DISTINCT block FROM ra WHERE block IN (SELECT block FROM rb))
SELECT block, program, cpu, r2, 'first' AS side FROM ra
WHERE block IN (SELECT block FROM m)
  AND NOT EXISTS (SELECT 1 FROM rb WHERE rb.block = ra.block AND rb.program = ra.program)
UNION ALL
SELECT block, program, cpu, r2, 'second' AS side FROM rb
WHERE block IN (SELECT block FROM m)
  AND NOT EXISTS (SELECT 1 FROM ra WHERE ra.block = rb.block AND ra.program = rb.program)""",
    "cmp_orphans_gated": _CMP_SQL_HEAD + """
SELECT block, program, side, coalesce(cpu1, cpu2) AS cpu, coalesce(r2_1, r2_2) AS r2
FROM aligned WHERE side <> 'both'
  AND coalesce(r2_1, r2_2) IS NOT NULL AND NOT isnan(coalesce(r2_1, r2_2))
  AND coalesce(r2_1, r2_2) >= 0.95""",
    "cmp_side_counts": _CMP_SQL_HEAD + """
SELECT side, CAST(count(*) AS BIGINT) AS n FROM aligned GROUP BY side""",
    "cmp_movers": _CMP_SQL_HEAD + """
SELECT concat_ws('/', nullif(block, ''), program) AS name, cpu1, cpu2, ratio
FROM aligned WHERE side = 'both'""",
    "cmp_file_blocks": "WITH " + FILES_SQL + """,
o AS (SELECT *, row_number() OVER (PARTITION BY early, block ORDER BY path) AS occ FROM (SELECT DISTINCT early, block, path FROM files)),
a AS (SELECT block, occ FROM o WHERE early), b AS (SELECT block, occ FROM o WHERE NOT early)
SELECT coalesce(a.block, b.block) AS block, CAST(coalesce(a.occ, b.occ) AS BIGINT) AS occ,
       CASE WHEN a.block IS NOT NULL AND b.block IS NOT NULL THEN 'both'
            WHEN a.block IS NOT NULL THEN 'first' ELSE 'second' END AS side
FROM a FULL OUTER JOIN b ON a.block = b.block AND a.occ = b.occ""",
    "path_occurrence": """
WITH p AS (SELECT doc_id, lang, nullif(source, 'src0') || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS path FROM documents)
SELECT doc_id, lang, path, CAST(row_number() OVER (PARTITION BY lang ORDER BY path NULLS FIRST, doc_id) AS BIGINT) AS occ FROM p""",
    "cmp_dup_keys": """
WITH li AS (
  SELECT l_linestatus, CAST(l_partkey AS VARCHAR) AS block, l_returnflag AS program,
         l_quantity AS cpu, 0.9 + l_discount AS r2, l_orderkey, l_linenumber
  FROM lineitem),
o AS (
  SELECT *, row_number() OVER (PARTITION BY l_linestatus, block, program ORDER BY l_orderkey, l_linenumber, cpu, r2) AS occ
  FROM li),
a AS (SELECT * FROM o WHERE l_linestatus = 'F'),
b AS (SELECT * FROM o WHERE l_linestatus = 'O')
SELECT coalesce(a.block, b.block) AS block, coalesce(a.program, b.program) AS program,
       CAST(coalesce(a.occ, b.occ) AS BIGINT) AS occ,
       CASE WHEN a.block IS NOT NULL AND b.block IS NOT NULL THEN 'both'
            WHEN a.block IS NOT NULL THEN 'first' ELSE 'second' END AS side,
       a.cpu AS cpu1, a.r2 AS r2_1, b.cpu AS cpu2, b.r2 AS r2_2,
       CASE WHEN a.block IS NOT NULL AND b.block IS NOT NULL AND a.cpu <> 0 THEN b.cpu / a.cpu END AS ratio
FROM a FULL OUTER JOIN b ON a.block = b.block AND a.program = b.program AND a.occ = b.occ""",
}

QUERIES = {
    "cmp_summary": cmp_summary,
    "cmp_bands": cmp_bands,
    "cmp_align": cmp_align,
    "cmp_change": cmp_change,
    "cmp_blocks": cmp_blocks,
    "cmp_orphan_blocks": cmp_orphan_blocks,
    "cmp_orphan_rows": cmp_orphan_rows,
    "cmp_orphans_gated": cmp_orphans_gated,
    "cmp_side_counts": cmp_side_counts,
    "cmp_movers": cmp_movers,
    "cmp_dup_keys": cmp_dup_keys,
    "cmp_file_blocks": cmp_file_blocks,
    "path_occurrence": path_occurrence,
}
