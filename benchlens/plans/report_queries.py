"""Acceptance queries: rendered reports, templates, the stream tee and the sequence alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.operators import compare as C
from benchlens.operators import report as R
from benchlens.operators import stats as S
from benchlens.operators.ordered import materialize
from benchlens.operators.sequence import align_sequence
from benchlens.plans.fixtures import RUNS_SQL, runs, table
from benchlens.session import scratch_path
from benchlens.sinks.writers import write_texts
from benchlens.sources.files import with_path_tags
from benchlens.sources.lines import file_lines
from benchlens.streaming.tee import merge_streams, read_merged, tee_stream

GATE = 0.95


LABELS = ("results/run-A/first-half", "results/run-B/second-half")
LABEL_WIDTH = 20
_FIELDS = R.table_fields(*LABELS, LABEL_WIDTH)


def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    aligned = materialize(C.align_variants(runs(spark, sf), "run", "A", "B", carry={"first_ts": F.min("first_ts")}))
    bands = S.geo_bands(S.geo_stats(C.gated_pairs(aligned, GATE)))
    return R.render_report(aligned, bands, *LABELS, GATE, row_order=["first_ts", "program"], label_width=LABEL_WIDTH)


def report_file(spark: SparkSession, sf: str) -> DataFrame:
    """The comparison table written as one ordered text and read back."""
    path = scratch_path(spark, "report")
    write_texts(report_lines(spark, sf), path, ["sec", "block", "row_no"])
    return file_lines(spark, path, per_folder=True).select("line_no", F.col("text").alias("line"))


def document_files(spark: SparkSession, sf: str) -> DataFrame:
    """One text per order priority (head, a line per order, tail), written in parts and read back with line numbers."""
    path = scratch_path(spark, "documents")
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_orderstatus")
    write_texts(R.template_lines(orders, "o_orderpriority", "o_orderkey", F.format_string("  - %d: %s", "o_orderkey", "o_orderstatus"),
                                 head=F.concat(F.lit("priority: "), F.col("o_orderpriority"), F.lit("\norders:")),
                                 tail=F.lit("# end of list")), path, ["sec", "ord"], "o_orderpriority")
    back = with_path_tags(file_lines(spark, path, per_folder=True), "folder", ["document"])
    return back.select("document", "line_no", F.col("text").alias("line"))


def template_render(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_name", "n_regionkey")
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    return R.render_template(
        n.join(r, on="n_regionkey"), ["r_name"], "n_name", F.concat(F.lit("  - "), F.initcap(F.lower("n_name"))),
        head=F.concat(F.lit("region: "), F.lower("r_name"), F.lit("\nnations:")),
        tail=F.lit("# end of list"))



def stream_tee(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` read as a file stream and copied to two parquet sinks; both read back."""
    schema = table(spark, sf, "events").schema
    src = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
           .option("maxFilesPerTrigger", 1).parquet(sf).select("event_id", "event_type", "value"))
    base = scratch_path(spark, "tee")
    tee_stream(src, f"{base}/a", f"{base}/b", f"{base}/ckpt-a", f"{base}/ckpt-b")
    outs = []
    for name in ("a", "b"):
        s = spark.read.parquet(f"{base}/{name}")
        outs.append(s.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"),
                                                F.round(F.sum("value"), 2).alias("total"))
                    .withColumn("sink", F.lit(name)))
    return outs[0].unionByName(outs[1])


def stream_merge(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` and ``orders`` as two live sources of one log; every row with its place in its source."""
    def live(name: str, *cols: Column) -> DataFrame:
        own = spark.readStream.schema(table(spark, sf, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)
        return own.select(*cols)

    base = scratch_path(spark, "merged")
    merge_streams({"out": live("events", F.col("event_id").alias("id"), F.col("event_type").alias("line")),
                   "err": live("orders", F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("line"))},
                  ["id"], [f"{base}/log", f"{base}/copy"], f"{base}/checkpoint")
    log, copy = (read_merged(spark, f"{base}/{name}").select("source", "pos", "id", "line") for name in ("log", "copy"))
    return log.withColumn("sink", F.lit("log")).unionByName(copy.withColumn("sink", F.lit("copy")))


def cmp_align_seq(spark: SparkSession, sf: str) -> DataFrame:
    """Order-sensitive alignment; each block's rows are ordered by the program's first event."""
    r = materialize(runs(spark, sf))  # both sides read one materialized fixture
    a = r.where(F.col("run") == "A")
    b = r.where(F.col("run") == "B")
    return align_sequence(a, b, order="first_ts")


def cmp_seq_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each block that keep their order in both runs, by the alignment in strips of 100 rows."""
    r = materialize(runs(spark, sf))
    got = align_sequence(r.where("run = 'A'"), r.where("run = 'B'"), order="first_ts", strip=100)
    return got.groupBy("block").agg(F.count_if(F.col("side") == C.BOTH).alias("n_both"),
                                    F.count_if(F.col("side") == C.FIRST).alias("n_first"),
                                    F.count_if(F.col("side") == C.SECOND).alias("n_second"))


def _cell(text: str, width: str, left: bool = False) -> str:
    fill = f"repeat(' ', greatest({width} - length(({text})), 0)::BIGINT)"
    return f"(({text}) || {fill})" if left else f"({fill} || ({text}))"


def _text_line(*cells: str) -> str:
    widths = ["w.w", *[str(f.width) for f in _FIELDS[1:]]]
    return " || '  ' || ".join(_cell(c, w, i == 0) for i, (c, w) in enumerate(zip(cells, widths)))


def _scientific(c: str) -> str:
    scale = f"pow(10.0::DOUBLE, 3 - floor(log10(abs({c}))))"
    return (f"CASE WHEN {c} IS NULL THEN '(none)' WHEN {c} = 0 THEN '0.000e+00' "
            f"ELSE printf('%.3e', round_even({c} * {scale}, 0) / {scale}) END")


def _percent(c: str) -> str:
    return f"coalesce(CASE WHEN {c} > 0 THEN printf('+%.1f%%', {c}) ELSE printf('%.1f%%', {c}) END, '(none)')"


def _passes(side: int) -> str:
    return f"(r2_{side} IS NOT NULL AND NOT isnan(r2_{side}) AND r2_{side} >= {GATE})"


_RULE = f"repeat('-', (w.w + {sum(2 + f.width for f in _FIELDS[1:])})::BIGINT)"
_PAIR = f"""(CASE WHEN side <> 'both' THEN '(none)'
  WHEN cpu1 = 0 THEN coalesce(CASE WHEN cpu2 > 0 THEN 'Infinity%' WHEN cpu2 < 0 THEN '-Infinity%' WHEN cpu2 = 0 THEN 'NaN%' END, '(none)')
  ELSE {_percent("(round_even((cpu2 / cpu1 - 1) * 100 * 10, 0) / 10 + 0.0)")} END)"""
_TITLES = _text_line(*[f"'{f.title}'" for f in _FIELDS])
_ROW = _text_line("program", _scientific("cpu1"), _scientific("cpu2"), _PAIR)
_BAND = _text_line("label", "'-'", "'-'", _percent("c"))

REPORT_SQL = "WITH " + RUNS_SQL + f""",
w AS (SELECT greatest(max(length(block)), max(length(program)), 9) AS w FROM aligned),
shown AS (
  SELECT *, row_number() OVER (PARTITION BY block ORDER BY first_ts, program) AS row_no FROM aligned
  WHERE CASE side WHEN 'both' THEN {_passes(1)} AND {_passes(2)} WHEN 'first' THEN {_passes(1)} ELSE {_passes(2)} END),
g AS (SELECT ratio FROM aligned WHERE side = 'both' AND {_passes(1)} AND {_passes(2)}),
v AS (SELECT ratio, ratio IS NOT NULL AND NOT isnan(ratio) AND ratio > 0 AND ratio < 'inf'::DOUBLE AS ok FROM g),
st AS (SELECT min(CASE WHEN ok THEN ratio END) AS mn, max(CASE WHEN ok THEN ratio END) AS mx,
              exp(avg(CASE WHEN ok THEN ln(ratio) END)) AS geo, exp(stddev_pop(CASE WHEN ok THEN ln(ratio) END)) AS sdf FROM v),
b(label, pos, ratio) AS (
  SELECT 'Min', 1, mn FROM st UNION ALL SELECT 'Max', 2, mx FROM st UNION ALL
  SELECT '-3 s.d.', 3, geo / pow(sdf, 3) FROM st UNION ALL SELECT '-2 s.d.', 4, geo / pow(sdf, 2) FROM st UNION ALL
  SELECT '-1 s.d.', 5, geo / sdf FROM st UNION ALL SELECT '+1 s.d.', 6, geo * sdf FROM st UNION ALL
  SELECT '+2 s.d.', 7, geo * pow(sdf, 2) FROM st UNION ALL SELECT '+3 s.d.', 8, geo * pow(sdf, 3) FROM st UNION ALL
  SELECT 'Geometric mean', 9, geo FROM st),
bc AS (SELECT label, pos, round_even((ratio - 1) * 100 * 10, 0) / 10 + 0.0 AS c FROM b)
SELECT 0 AS sec, '' AS block, 0::BIGINT AS row_no, 'Comparison of two runs' AS line
UNION ALL SELECT 0, '', 1, {_RULE} FROM w
UNION ALL SELECT 0, '', 2, {_TITLES} FROM w
UNION ALL SELECT 0, '', 3, {_RULE} FROM w
UNION ALL SELECT DISTINCT 1, block, 0, block FROM aligned
UNION ALL SELECT 1, block, row_no, {_ROW} FROM shown, w
UNION ALL SELECT 2, '', 0, {_RULE} FROM w
UNION ALL SELECT 2, '', pos, {_BAND} FROM bc, w"""

SQL = {
    "report_lines": REPORT_SQL,
    "report_file": f"SELECT CAST(row_number() OVER (ORDER BY sec, block, row_no) AS BIGINT) AS line_no, line FROM ({REPORT_SQL})",
    "document_files": """
WITH p AS (SELECT DISTINCT o_orderpriority AS document FROM orders),
l AS (SELECT document, 0 AS sec, 0 AS o, 'priority: ' || document AS line FROM p
      UNION ALL SELECT document, 0, 1, 'orders:' FROM p
      UNION ALL SELECT o_orderpriority, 1, o_orderkey, '  - ' || o_orderkey || ': ' || o_orderstatus FROM orders
      UNION ALL SELECT document, 2, 0, '# end of list' FROM p)
SELECT document, CAST(row_number() OVER (PARTITION BY document ORDER BY sec, o) AS BIGINT) AS line_no, line FROM l""",
    # longest increasing subsequence of the second side's places: the least end of each length, row after row
    "cmp_seq_lengths": "WITH RECURSIVE " + RUNS_SQL + """,
pa AS (SELECT block, program, row_number() OVER (PARTITION BY block ORDER BY first_ts, program, cpu, r2) AS p FROM ra),
pb AS (SELECT block, program, row_number() OVER (PARTITION BY block ORDER BY first_ts, program, cpu, r2) AS p FROM rb),
m AS (SELECT pa.block, row_number() OVER (PARTITION BY pa.block ORDER BY pa.p) AS i, pb.p AS j FROM pa JOIN pb USING (block, program)),
step(block, i, tails) AS (
  SELECT DISTINCT block, 0::BIGINT, []::BIGINT[] FROM m
  UNION ALL
  SELECT s.block, s.i + 1, list_concat(list_concat(s.tails[1:len(list_filter(s.tails, lambda x: x < m.j))], [m.j]),
                                       s.tails[len(list_filter(s.tails, lambda x: x < m.j)) + 2:])
  FROM step s JOIN m ON m.block = s.block AND m.i = s.i + 1),
best AS (SELECT block, max(len(tails)) AS n FROM step GROUP BY block),
na AS (SELECT block, count(*) AS n FROM ra GROUP BY block), nb AS (SELECT block, count(*) AS n FROM rb GROUP BY block)
SELECT block, CAST(coalesce(best.n, 0) AS BIGINT) AS n_both, CAST(coalesce(na.n, 0) - coalesce(best.n, 0) AS BIGINT) AS n_first,
       CAST(coalesce(nb.n, 0) - coalesce(best.n, 0) AS BIGINT) AS n_second
FROM na FULL OUTER JOIN nb USING (block) LEFT JOIN best USING (block)""",
    "template_render": """
SELECT r_name, 'region: ' || lower(r_name) || chr(10) || 'nations:' || chr(10)
       || string_agg('  - ' || array_to_string(list_transform(string_split(lower(n_name), ' '),
                       lambda w: upper(left(w, 1)) || substring(w, 2)), ' '), chr(10) ORDER BY n_name)
       || chr(10) || '# end of list' AS doc
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "stream_merge": """
WITH l AS (SELECT 'out' AS source, event_id AS id, event_type AS line FROM events
           UNION ALL SELECT 'err', o_orderkey, o_orderstatus FROM orders)
SELECT source, CAST(row_number() OVER (PARTITION BY source, sink ORDER BY id) AS BIGINT) AS pos, id, line, s.sink
FROM l, (VALUES ('log'), ('copy')) s(sink)""",
    "stream_tee": """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total, s.sink
FROM events, (VALUES ('a'), ('b')) s(sink) GROUP BY event_type, s.sink""",
}

QUERIES = {
    "report_lines": report_lines,
    "report_file": report_file,
    "template_render": template_render,
    "document_files": document_files,
    "stream_tee": stream_tee,
    "stream_merge": stream_merge,
    "cmp_align_seq": cmp_align_seq,
    "cmp_seq_lengths": cmp_seq_lengths,
}
