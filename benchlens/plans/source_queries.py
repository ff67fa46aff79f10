"""Acceptance queries for file sources and sinks.

Each query first writes data derived from the driver tables into a fresh
folder under the shared checkpoint area (``spark.checkpoint.dir``), then reads
it back through the source under test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.functions import scalar as X
from benchlens.operators.kmer import chunks_of, sequence_text
from benchlens.plans.fixtures import RUNS_SQL, runs, table
from benchlens.session import scratch_path
from benchlens.sinks.writers import write_results
from benchlens.sources import files as S

FASTA_LINE = 60
FASTA_DOC = 7


def _write_run_tree(spark: SparkSession, sf: str) -> str:
    """Fitted programs of both runs as files ``run=<r>/<block>.csv``, columns in another order per run."""
    root = scratch_path(spark, "result-tree")
    r = runs(spark, sf).where("cpu is not null").select(
        "run", "block", F.col("program").alias("PROGNAME"), F.col("cpu").alias("CPUTIME"), F.col("r2").alias("RSQR_TIME_FIT"),
        F.col("n").alias("N"))
    a = r.where(F.col("run") == "A").select("run", "block", "PROGNAME", "CPUTIME", "RSQR_TIME_FIT", "N")
    b = r.where(F.col("run") == "B").select("run", "block", "N", "RSQR_TIME_FIT", "PROGNAME", "CPUTIME",
                                            F.lit("x, y").alias("EXTRA, QUOTED"))
    for part in (a, b):  # one file per block: a result list is a small aggregate
        (part.repartition("run", "block").write.mode("append").option("header", True).option("escape", '"')
         .partitionBy("run", "block").csv(f"{root}/parts"))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.globStatus(path(f"{root}/parts/run=*/block=*/part-*.csv")):
        folder = f.getPath().getParent()
        run, block = folder.getParent().getName(), folder.getName().removeprefix("block=")
        fs.mkdirs(path(f"{root}/tree/{run}"))
        fs.rename(f.getPath(), path(f"{root}/tree/{run}/{block}.csv"))
    return f"{root}/tree"


def scan_inventory(spark: SparkSession, sf: str) -> DataFrame:
    root = _write_run_tree(spark, sf)
    inv = S.with_path_tags(S.list_runs(spark, root), path="path", keys=["run"])
    return inv.select("run", "block", "file_name", "ext")


def scan_header_bound(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.with_path_tags(S.scan_results(spark, _write_run_tree(spark, sf), mode="fail"), path="file", keys=["run"])
    return rows.select("run", "block", "program", "cpu", "r2")


def _tagged_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return o.select(
        "o_orderkey", "o_totalprice",
        F.col("o_orderstatus").alias("variant"),
        F.format_string("lts-%d.%d", F.year("o_orderdate") - 1990, F.quarter("o_orderdate")).alias("target"),
        X.ts_path_text(F.date_trunc("year", F.col("o_orderdate"))).alias("run_ts"))


def path_tags(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "tagged-results")
    write_results(_tagged_orders(spark, sf), root, ["variant", "target", "run_ts"])
    back = (spark.read.option("recursiveFileLookup", "true").parquet(root)
            .select("o_totalprice", F.col("_metadata.file_path").alias("file")))
    tagged = S.with_path_tags(back, path="file", keys=["variant", "target", "run_ts"])
    return tagged.groupBy("variant", "target", "run_ts").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total_price"))


def overwrite_partition(spark: SparkSession, sf: str) -> DataFrame:
    """Write orders by priority, then replace the 1-URGENT partition with its failed orders only."""
    root = scratch_path(spark, "replace")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus",
                                          F.col("o_orderpriority").alias("variant"))
    write_results(o, root, ["variant"])
    newer = o.where((F.col("variant") == "1-URGENT") & (F.col("o_orderstatus") == "F"))
    write_results(newer, root, ["variant"], replace=True)
    back = spark.read.parquet(root)
    return back.groupBy("variant").agg(F.count(F.lit(1)).alias("n"))


def report_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """Fits as JSON reports (one per program and run), read back and flattened to result rows."""
    root = scratch_path(spark, "reports")
    r = runs(spark, sf)
    reports = r.select("run", F.concat_ws("/", "block", "program").alias("name"), F.array(
        F.struct(F.lit("cpuTime").alias("responder"), F.lit("iters").alias("predictor"),
                 F.col("cpu").alias("coeff"), F.col("r2").alias("r2")),
        F.struct(F.lit("allocated").alias("responder"), F.lit("iters").alias("predictor"),
                 F.col("n").cast("double").alias("coeff"), F.lit(1.0).alias("r2"))).alias("regressions"))
    reports.write.partitionBy("run").json(root)
    outs = []
    for run in ("A", "B"):
        rep = S.read_reports(spark, f"{root}/run={run}")
        outs.append(S.flatten_reports(rep, tags={"variant": run}))
    return outs[0].unionByName(outs[1])


def fasta_section(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as one FASTA file set (header + 60-letter lines), then one section read back."""
    root = scratch_path(spark, "fasta")
    # the header mark cannot stand in a sequence
    d = table(spark, sf, "documents").select("doc_id", "lang", F.translate(sequence_text("text"), ">", "-").alias("seq"))
    # Header and sequence lines of a document come out of one row, in order, so
    # they stay together in one output file without any shuffle.
    head = F.concat(F.lit(">DOC"), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang"))
    lines = d.select(F.explode(F.concat(F.array(head), chunks_of(F.lower("seq"), FASTA_LINE))).alias("text"))
    lines.write.text(root)
    return S.scan_fasta(spark, root, f">DOC{FASTA_DOC} ")


_RUNS = "WITH " + RUNS_SQL

SQL = {
    "scan_inventory": _RUNS + "\nSELECT DISTINCT run, block, block || '.csv' AS file_name, '.csv' AS ext FROM runs WHERE cpu IS NOT NULL",
    "scan_header_bound": _RUNS + "\nSELECT run, block, program, cpu, r2 FROM runs WHERE cpu IS NOT NULL",
    "path_tags": """
SELECT o_orderstatus AS variant, printf('lts-%d.%d', year(o_orderdate) - 1990, quarter(o_orderdate)) AS target,
       strftime(date_trunc('year', o_orderdate), '%Y-%m-%d-%H:%M:%S') AS run_ts,
       CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total_price
FROM orders GROUP BY ALL""",
    "overwrite_partition": """
SELECT o_orderpriority AS variant, CAST(count(*) AS BIGINT) AS n FROM orders
WHERE o_orderpriority <> '1-URGENT' OR o_orderstatus = 'F' GROUP BY ALL""",
    "report_flatten": _RUNS + """
SELECT block || '/' || program AS PROGNAME, cpu AS CPUTIME, r2 AS RSQR_TIME_FIT, run AS variant FROM runs""",
    "fasta_section": f"""
WITH d AS (SELECT doc_id, lang, replace(replace(upper(replace(regexp_replace(text, '[\\r\\n]', '', 'g'), 'ß', chr(57344))), chr(57344), 'ß'), '>', '-') AS seq FROM documents
           WHERE doc_id = {FASTA_DOC})
SELECT 'DOC' || CAST(doc_id AS VARCHAR) || ' ' || lang AS section, CAST(i AS BIGINT) AS line_pos,
       substring(seq, (i - 1) * {FASTA_LINE} + 1, {FASTA_LINE}) AS seq
FROM d, generate_series(1, CAST(ceil(length(seq) / {FASTA_LINE}) AS BIGINT)) g(i)""",
}

QUERIES = {
    "scan_inventory": scan_inventory,
    "scan_header_bound": scan_header_bound,
    "path_tags": path_tags,
    "overwrite_partition": overwrite_partition,
    "report_flatten": report_flatten,
    "fasta_section": fasta_section,
}
