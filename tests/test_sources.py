import json
import os

import pytest
from pyspark.sql import functions as F

from benchlens.functions import scalar as X
from benchlens.operators.corpus import cached_table, read_package_cache, scan_pins, slice_corpus
from benchlens.sources import files as S
from benchlens.sources.lines import file_lines, table_lines


def _w(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_header_bound_by_name_per_file(spark, tmp_out):  # S2, D1
    _w(f"{tmp_out}/r/one/fib.csv", "PROGNAME,CPUTIME,RSQR_TIME_FIT\nfib/10,1.5,0.99\nfib/20,3.0,0.97\n")
    _w(f"{tmp_out}/r/two/sort.csv", "RSQR_TIME_FIT,EXTRA,CPUTIME,PROGNAME\n0.5,x,2.5,\"sort,big\"\n")
    _w(f"{tmp_out}/r/two/empty.csv", "PROGNAME,CPUTIME,RSQR_TIME_FIT\n")
    _w(f"{tmp_out}/r/two/notes.CSV", "PROGNAME,CPUTIME,RSQR_TIME_FIT\nnope,1,1\n")
    got = {(r.block, r.program, r.cpu, r.r2) for r in S.scan_results(spark, f"{tmp_out}/r").collect()}
    assert got == {("fib", "fib/10", 1.5, 0.99), ("fib", "fib/20", 3.0, 0.97), ("sort", "sort,big", 2.5, 0.5)}


def test_bad_value_fails_or_is_quarantined(spark, tmp_out):  # D2
    _w(f"{tmp_out}/b/x.csv", "PROGNAME,CPUTIME,RSQR_TIME_FIT\na,1.0,0.99\nb,oops,0.99\nc,NaN,0.5\n")
    with pytest.raises(Exception):
        S.scan_results(spark, f"{tmp_out}/b").collect()
    good, bad = S.scan_results(spark, f"{tmp_out}/b", mode="quarantine")
    assert sorted(r.program for r in good.collect()) == ["a", "c"]
    assert [r.value for r in bad.collect()] == ["b,oops,0.99"]


def test_separators_quotes_and_line_breaks(spark, tmp_out):
    _w(f"{tmp_out}/q/bar.csv", 'PROGNAME|CPUTIME|RSQR_TIME_FIT\n"a|b"|1.0|0.99\n')
    got = S.scan_results(spark, f"{tmp_out}/q", sep="|").collect()
    assert [(r.block, r.program, r.cpu) for r in got] == [("bar", "a|b", 1.0)]
    _w(f"{tmp_out}/n/x.csv", '"NOTE, x",PROGNAME,RSQR_TIME_FIT,CPUTIME\n"said ""hi""","p\nq",0.99,2.5\n')
    got = S.scan_results(spark, f"{tmp_out}/n", multiline=True).collect()
    assert [(r.program, r.cpu, r.r2) for r in got] == [("p\nq", 2.5, 0.99)]
    assert S.scan_results(spark, f"{tmp_out}/n", glob="*.none").count() == 0


def test_missing_column_fails(spark, tmp_out):
    _w(f"{tmp_out}/m/x.csv", "PROGNAME,CPUTIME\na,1.0\n")
    with pytest.raises(Exception):
        S.scan_results(spark, f"{tmp_out}/m").collect()


def test_list_runs_and_names(spark, tmp_out):  # S1, F1, D11, D12
    for p in ["a/x.csv", "a/b/y.csv", "a/.h.csv", "a/_u.csv", "a/z.CSV", "a/w.txt"]:
        _w(f"{tmp_out}/{p}", "PROGNAME\n")
    got = sorted((r.block, r.ext) for r in S.list_runs(spark, f"{tmp_out}/a").collect())
    assert got == [("x", ".csv"), ("y", ".csv")]


def test_path_tags_decode(spark):  # S3, F9
    df = spark.createDataFrame([("file:/r/variant=sc/target=lts-5.16/run_ts=2016-05-15-10%253A00%253A00/p.csv",)],
                               "file string")
    r = S.with_path_tags(df, keys=["variant", "target", "run_ts"]).first()
    assert (r.variant, r.target, r.run_ts) == ("sc", "lts-5.16", "2016-05-15-10:00:00")
    df2 = spark.createDataFrame([("bench-res/opt/lts-5.16/2016-05-15-10:00:00/pkg-1.0.csv",)], "file string")
    r2 = S.with_path_tags(df2, pattern=r"bench-res/([^/]*)/([^/]+)/([^/]+)/", names=["variant", "target", "ts"],
                          uri=False).first()
    assert (r2.variant, r2.target, r2.ts) == ("opt", "lts-5.16", "2016-05-15-10:00:00")


def test_fasta_section_and_to_eof(spark, tmp_out):  # S6, D17
    _w(f"{tmp_out}/f/in.fa", ">ONE x\nacgt\nAC\n>TWO y\nggcc\ntt\n>THREE z\naaa\n")
    got = [(r.line_pos, r.seq) for r in S.scan_fasta(spark, f"{tmp_out}/f", ">TWO").orderBy("line_pos").collect()]
    assert got == [(1, "GGCC"), (2, "TT")]
    eof = [r.seq for r in S.scan_fasta(spark, f"{tmp_out}/f", ">TWO", to_eof=True).orderBy("line_pos").collect()]
    assert eof == ["GGCC", "TT", ">THREE Z", "AAA"]
    assert S.scan_fasta(spark, f"{tmp_out}/f", ">NONE").count() == 0


def test_flatten_reports(spark, tmp_out):  # S9
    reps = [{"name": "fib", "regressions": [{"responder": "cpuTime", "predictor": "iters", "coeff": 2.0, "r2": 0.99},
                                            {"responder": "allocated", "predictor": "iters", "coeff": 9.0, "r2": 1}]},
            {"name": "empty", "regressions": []}]
    _w(f"{tmp_out}/rep/r.json", "\n".join(json.dumps(r) for r in reps))
    got = S.flatten_reports(S.read_reports(spark, f"{tmp_out}/rep"), tags={"variant": "sc"}).collect()
    assert [(r.PROGNAME, r.CPUTIME, r.RSQR_TIME_FIT, r.variant) for r in got] == [("fib", 2.0, 0.99, "sc")]


def test_pins_edge_cases(spark):  # S4, P5, P7
    lines = spark.createDataFrame([
        ("f", 0, "-- comment"), ("f", 1, "constraints: a-b ==1.2, c >=3,"), ("f", 2, "  d,"), ("f", 3, "  e == 4.5.6,")],
        "file string, line_no long, text string")
    got = [(r.name, r.version) for r in scan_pins(lines).orderBy("line_no", "item").collect()]
    assert got == [("a-b", "1.2"), ("e", "4.5.6")]


def test_slices_are_disjoint_and_cover(spark):  # W3, D18
    df = spark.range(0, 23).withColumnRenamed("id", "k")
    seen = []
    for s in range(1, 5):
        seen += [r.k for r in slice_corpus(df, ["k"], s, 4).collect()]
    assert sorted(seen) == list(range(23))
    assert [r.k for r in slice_corpus(df, ["k"], 4, 4).orderBy("k").collect()] == [18, 19, 20, 21, 22]
    assert slice_corpus(df, ["k"], 9, 4).count() == 0
    with pytest.raises(ValueError):
        slice_corpus(df, ["k"], 1, 0)


def test_cache_and_package_cache(spark, tmp_out):  # S8
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([("p-1.0",)], "package string")

    assert cached_table(spark, f"{tmp_out}/c", build).count() == 1
    assert cached_table(spark, f"{tmp_out}/c", build).count() == 1
    assert len(calls) == 1
    _w(f"{tmp_out}/pc/c.json", json.dumps({"packages": ["dir/a-1.0", "b-2"]}))
    assert sorted(r.package for r in read_package_cache(spark, f"{tmp_out}/pc").collect()) == ["a-1.0", "b-2"]
    _w(f"{tmp_out}/bad/c.json", json.dumps({"other": 1}))
    with pytest.raises(Exception):
        read_package_cache(spark, f"{tmp_out}/bad").collect()


def test_lines_numbered_per_file(spark, tmp_out):  # S7, D21
    _w(f"{tmp_out}/l/a.log", "\n".join(f"line {i}" for i in range(1, 501)) + "\n")
    got = file_lines(spark, f"{tmp_out}/l").select("line_no", "text").collect()
    assert all(r.text == f"line {r.line_no}" for r in got) and len(got) == 500
    t = table_lines(spark.createDataFrame([(1, "a\nb\n")], "id int, t string"), ["id"], "t").collect()
    assert [(r.line_no, r.line) for r in t] == [(1, "a"), (2, "b"), (3, "")]


def test_scalar_round_trips(spark):  # F4, F10, F14, F2
    df = spark.createDataFrame([("hs-bench-utils-1.2.3", 0.0123456)], "pid string, d double")
    r = df.select(X.pkg_name("pid").alias("n"), X.pkg_version("pid").alias("v"),
                  X.duration_text("d").alias("t"), X.duration_seconds(X.duration_text("d")).alias("back"),
                  X.error_cmd(X.error_line(F.lit("run-bench"), F.lit(-3))).alias("c"),
                  X.error_code(X.error_line(F.lit("run-bench"), F.lit(-3))).alias("k"),
                  X.path_join(F.lit(""), F.lit("b"), F.lit("c")).alias("p")).first()
    assert (r.n, r.v, r.t, r.c, r.k, r.p) == ("hs-bench-utils", "1.2.3", "12.346 ms", "run-bench", -3, "b/c")
    assert r.back == pytest.approx(0.012346)


def test_long_fasta_header_is_not_cut(spark, tmp_out):
    head = "long " + "x" * (1 << 21)
    _w(f"{tmp_out}/f/a.fa", f">first\nac\n>{head}\ngt\n\nca\n>next\ntt\n")
    got = S.scan_fasta(spark, f"{tmp_out}/f", ">long").orderBy("line_pos").collect()
    assert [(r.section == head, r.line_pos, r.seq) for r in got] == [(True, 1, "GT"), (True, 2, ""), (True, 3, "CA")]
    assert S.scan_fasta(spark, f"{tmp_out}/f", ">none").count() == 0
    assert S.scan_fasta(spark, f"{tmp_out}/f", ">next").count() == 1


def test_cache_raises_storage_errors_and_keeps_tables_without_a_marker(spark, tmp_out):
    import os

    from benchlens.operators.corpus import cached_table
    path = f"{tmp_out}/cache"
    build = lambda: spark.range(3)
    assert cached_table(spark, path, build).count() == 3
    os.remove(f"{path}/_SUCCESS")
    assert cached_table(spark, path, lambda: spark.range(9)).count() == 3
    with pytest.raises(Exception):
        cached_table(spark, "nosuchfs://host/cache", build)


def test_module_list_and_multiline_cache(spark, tmp_out):
    from benchlens.operators.corpus import module_list, read_package_cache
    lines = ["name: p", "library", "  exposed-modules: A.B, C", "      D.E,", "    F", "  other-modules: X", "exposed-modules: Z"]
    df = spark.createDataFrame([("p", i, t) for i, t in enumerate(lines)] + [("q", 0, "library")], "pkg string, line_no long, text string")
    got = [(r.pkg, r.module) for r in module_list(df, "exposed-modules").orderBy("line_no", "item").collect()]
    assert got == [("p", m) for m in ("A.B", "C", "D.E", "F", "Z")]
    _w(f"{tmp_out}/c/list.json", '{\n "packages": ["dir/a-1",\n "b-2"]\n}\n')
    assert sorted(r.package for r in read_package_cache(spark, f"{tmp_out}/c", multiline=True).collect()) == ["a-1", "b-2"]


def test_rows_of_another_width_are_bad(spark, tmp_out):  # S2
    from benchlens.sources.files import scan_results

    with open(f"{tmp_out}/a.csv", "w") as f:
        f.write('PROGNAME,CPUTIME,RSQR_TIME_FIT\nok,1.0,0.99\nq,2.0,0.9,EXTRA,MORE\nfew,3.0\n"x, y",4.0,0.97\n')
    good, bad = scan_results(spark, tmp_out, mode="quarantine")
    assert sorted((r.program, r.cpu) for r in good.collect()) == [("ok", 1.0), ("x, y", 4.0)]
    assert sorted(r.value for r in bad.collect()) == ["few,3.0", "q,2.0,0.9,EXTRA,MORE"]
    with pytest.raises(Exception, match="bad result row"):
        scan_results(spark, tmp_out, mode="fail").collect()


def test_many_headers_are_one_branch_for_each_width(spark, tmp_out):  # S2
    import random

    from benchlens.sources.files import scan_results

    rnd, want = random.Random(1), []
    for i in range(120):
        names = ["PROGNAME", "CPUTIME", "RSQR_TIME_FIT", f"X{i}"] + (["Y"] if i % 3 == 0 else [])
        rnd.shuffle(names)
        value = {"PROGNAME": f"p{i}", "CPUTIME": str(i), "RSQR_TIME_FIT": "0.5"}
        with open(f"{tmp_out}/b{i}.csv", "w") as f:
            f.write(",".join(names) + "\n" + ",".join(value.get(n, "") for n in names) + "\n")
        want.append((f"b{i}", f"p{i}", float(i), 0.5))
    got = scan_results(spark, tmp_out)
    assert sorted((r.block, r.program, r.cpu, r.r2) for r in got.collect()) == sorted(want)
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan csv") == 2
