from pyspark.sql import functions as F

from benchlens.operators import text as T
from benchlens.operators.report import render_template


def test_token_usage_whole_words(spark):  # A11, F15
    df = spark.createDataFrame([("s", "The other theme; the. THE-end onè on"), ("s", "by")], "src string, t string")
    got = {r.token: (r.n, r.total) for r in T.token_usage(df, "t", ["the", "on", "by"], by=["src"]).collect()}
    assert got == {"the": (3, 5), "on": (1, 5), "by": (1, 5)}


def test_usage_kind(spark):
    df = spark.createDataFrame([("x <- readRef r",), ("writeRef r 1",), ("other",)], "t string")
    kinds = {"read": r"\breadRef\b", "write": r"\bwriteRef\b"}
    assert [r.k for r in df.select(T.usage_kind("t", kinds).alias("k")).collect()] == ["read", "write", None]


def test_log_segments_and_tail(spark):  # W4, O4, P8
    rows = [("u", i, "+ cmd" if i in (3, 7) else ("Barrier" if i % 2 else "x")) for i in range(1, 11)]
    df = spark.createDataFrame(rows, "f string, ln int, t string")
    seg = {r.segment: (r.n_lines, r.first_line) for r in
           T.log_segments(df, ["f"], ["ln"], F.col("t").startswith("+ ")).collect()}
    assert seg == {0: (2, 1), 1: (4, 3), 2: (4, 7)}
    tail = T.tail_matching(df, ["f"], [F.col("ln").desc()], F.col("t").contains("Barrier"), 2).collect()
    assert sorted(r.ln for r in tail) == [5, 9]


def test_event_rate_and_outcomes(spark):  # A12, A9
    ev = spark.createDataFrame([("a", "Barrier"), ("a", "Barrier"), ("a", "x"), ("b", "x")], "v string, k string")
    r = {(x.v, x.k): x.rate for x in T.event_rate(ev, ["v"], "k").collect()}
    assert r[("a", "Barrier")] == 2000 / 3
    out = spark.createDataFrame([("ok",), ("ok",), ("failed",)], "status string")
    s = {x.status: x.summary for x in T.outcome_summary(out).collect()}
    assert s == {"ok": "2/3 packages succeeded", "failed": "1/3 packages failed"}
    none = {x.status: x.summary for x in T.outcome_summary(out.where("status = 'ok'")).collect()}
    assert none == {"ok": "2/2 packages succeeded", "failed": "0/2 packages failed"}
    assert T.outcome_summary(out.limit(0)).count() == 0


def test_outcome_lists_are_rows(spark):
    out = spark.createDataFrame([("p", "ok"), ("q", "failed"), ("a", "failed"), ("q", "failed")], "pkg string, status string")
    got = sorted(map(tuple, T.outcome_list(out, "pkg").collect()))
    assert got == [("failed", "a"), ("failed", "q"), ("ok", "p")]


def test_token_mentions_with_remainder(spark):
    lines = spark.createDataFrame([("f", "read ref; ref write"), ("f", "plain ref"), ("f", "none here"), ("g", "new ref")], "file string, text string")
    kinds = {"read": "read", "new": "new"}
    got = {(r.file, r.kind): (r.n, r.mentions, r.unexplained) for r in T.token_remainder(lines, "text", ["ref"], kinds, by=["file"]).collect()}
    assert got == {("f", "read"): (2, 3, 1), ("f", None): (1, 3, 1), ("g", "new"): (1, 1, 0)}


def test_run_log_segments_from_text(spark):
    log = ["free + line", "+ build a", "compiling", "+ not a command? it is one", "Total benchmarking time: 1.500 s",
           "+ run b --flag", "x", "ERROR: run b --flag returned exit code 3", "+ last"]
    df = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(log)], "file string, line_no long, text string")
    got = [tuple(r) for r in T.run_log(df, ["file"], "line_no", "text").orderBy("segment").collect()]
    assert got == [("f", 0, None, 1, 1, 1, None, None, None), ("f", 1, "build a", 2, 2, 3, None, None, None),
                   ("f", 2, "not a command? it is one", 2, 4, 5, 1.5, None, None),
                   ("f", 3, "run b --flag", 3, 6, 8, None, "run b --flag", 3), ("f", 4, "last", 1, 9, 9, None, None, None)]


def test_render_template(spark):  # K6, F11
    df = spark.createDataFrame([("p", "B", 2), ("p", "A", 1)], "pkg string, m string, o int")
    doc = render_template(df, ["pkg"], "o", F.concat(F.lit("import "), F.col("m")),
                          F.lit("module Check where"), F.lit("main = pure ()")).first().doc
    assert doc == "module Check where\nimport A\nimport B\nmain = pure ()"


def test_report_row_layout(spark):  # K5, F6, D9, D10
    from benchlens.operators import compare as C
    from benchlens.operators import stats as S
    from benchlens.operators.report import render_report

    s = "block string, program string, cpu double, r2 double"
    a = spark.createDataFrame([("fib", "fib/10", 0.00125, 0.99), ("fib", "old", 1.0, 0.99)], s)
    b = spark.createDataFrame([("fib", "fib/10", 0.0025, 0.98), ("new", "x", 2.0, 0.5)], s)
    al = C.align_results(a, b)
    lines = render_report(al, S.geo_bands(S.geo_stats(C.gated_pairs(al))), "left", "right")
    got = {r.line.split()[0]: r.line for r in lines.where("sec = 1 AND row_no > 0").collect()}
    w = len("Benchmark")
    cells = lambda name, *rest: "  ".join([name.ljust(w), rest[0].rjust(12), rest[1].rjust(12), rest[2].rjust(10)])
    assert got["fib/10"] == cells("fib/10", "1.250e-03", "2.500e-03", "+100.0%")
    assert got["old"] == cells("old", "1.000e+00", "(none)", "(none)")
    assert "x" not in got  # one-sided row whose fit fails the gate is not printed
    summ = [r.line for r in lines.where("sec = 2 AND row_no > 0").orderBy("row_no").collect()]
    assert summ[-1].startswith("Geometric mean") and summ[-1].endswith("+100.0%")


def test_upper_chars_keeps_every_other_character(spark):  # F8
    from benchlens.functions.scalar import upper_chars

    texts = ["straße ŉ ﬁx", " private", "ÿ é Σς", "", None, "ß", "plain\nline", "\U00010437x"]
    want = {t: None if t is None else "".join(c.upper() if len(c.upper()) == 1 else c for c in t) for t in texts}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.u for r in df.select("t", upper_chars("t").alias("u")).collect()} == want
