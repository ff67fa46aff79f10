import math

import pytest

from benchlens.operators import compare as C
from benchlens.operators import stats as S

SCHEMA = "block string, program string, cpu double, r2 double"


def _df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_nan_fit_never_passes_gate(spark):  # D3
    df = spark.createDataFrame([(float("nan"),), (0.96,), (None,), (0.94,)], "r2 double")
    assert df.where(C.quality_gate("r2")).count() == 1


def test_zero_base_gives_null_ratio_counted_invalid(spark):  # D4, D5
    a = _df(spark, [("b", "p", 0.0, 1.0), ("b", "q", 2.0, 1.0), ("b", "r", -1.0, 1.0)])
    b = _df(spark, [("b", "p", 5.0, 1.0), ("b", "q", 1.0, 1.0), ("b", "r", 1.0, 1.0)])
    al = C.align_results(a, b)
    ratios = {r.program: r.ratio for r in al.collect()}
    assert ratios["p"] is None and ratios["q"] == 0.5
    st = S.geo_stats(C.gated_pairs(al)).first()
    assert st.n == 1 and st.n_invalid == 2


def test_empty_stats_one_row(spark):  # D6
    st = S.geo_stats(spark.createDataFrame([], "ratio double")).collect()
    assert len(st) == 1 and st[0].n == 0 and st[0].geo_mean is None


def test_population_sd_and_geo_mean(spark):  # D7
    rs = [0.5, 1.0, 2.0, 4.0]
    st = S.geo_stats(spark.createDataFrame([(r,) for r in rs], "ratio double")).first()
    logs = [math.log(r) for r in rs]
    mu = sum(logs) / 4
    sd = math.sqrt(sum((x - mu) ** 2 for x in logs) / 4)
    assert st.geo_mean == pytest.approx(math.exp(mu))
    assert st.sdf == pytest.approx(math.exp(sd))


def test_half_even_percent(spark):  # D8
    df = spark.createDataFrame([(1.00025,), (1.00075,), (0.5,)], "ratio double")
    got = [r.c for r in df.select(C.percent_change("ratio").alias("c")).collect()]
    assert got == [0.0, 0.1, -50.0]


def test_duplicate_keys_pair_once(spark):  # D14, W1
    a = spark.createDataFrame([("b", "x", 1, 1.0, 1.0), ("b", "x", 2, 2.0, 1.0), ("b", "x", 3, 3.0, 1.0)],
                              "block string, program string, pos int, cpu double, r2 double")
    b = spark.createDataFrame([("b", "x", 1, 10.0, 1.0), ("b", "x", 2, 20.0, 1.0)],
                              "block string, program string, pos int, cpu double, r2 double")
    oa = C.with_occurrence(a, ["block", "program"], ["pos"])
    ob = C.with_occurrence(b, ["block", "program"], ["pos"])
    al = C.align_results(oa, ob, keys=["block", "program", "occ"]).collect()
    sides = sorted((r.occ, r.side) for r in al)
    assert sides == [(1, "both"), (2, "both"), (3, "first")]
    assert {r.occ: r.ratio for r in al if r.side == "both"} == {1: 10.0, 2: 10.0}


def test_swap_inverts_ratios_and_mirrors_orphans(spark):
    a = _df(spark, [("b1", "p", 2.0, 0.99), ("b1", "q", 4.0, 0.99), ("b2", "z", 1.0, 0.99)])
    b = _df(spark, [("b1", "p", 1.0, 0.99), ("b1", "r", 4.0, 0.99), ("b3", "y", 1.0, 0.99)])
    ab = {(r.block, r.program): (r.side, r.ratio) for r in C.align_results(a, b).collect()}
    ba = {(r.block, r.program): (r.side, r.ratio) for r in C.align_results(b, a).collect()}
    mirror = {"first": "second", "second": "first", "both": "both"}
    for k, (side, ratio) in ab.items():
        assert ba[k][0] == mirror[side]
        if ratio is not None:
            assert ba[k][1] == pytest.approx(1 / ratio)
    ob = {(r.block, r.side) for r in C.orphan_blocks(a, b).collect()}
    assert ob == {("b2", "first"), ("b3", "second")}
    orow = {(r.program, r.side) for r in C.orphan_rows(a, b).collect()}
    assert orow == {("q", "first"), ("r", "second")}


def test_self_compare_is_neutral(spark):
    a = _df(spark, [("b", f"p{i}", float(i + 1), 0.99) for i in range(20)])
    st = S.geo_stats(C.gated_pairs(C.align_results(a, a))).first()
    assert st.n == 20 and st.geo_mean == pytest.approx(1.0) and st.sdf == pytest.approx(1.0)
    assert C.orphan_blocks(a, a).count() == 0 and C.orphan_rows(a, a).count() == 0


def test_bands_order_and_values(spark):
    st = S.geo_stats(spark.createDataFrame([(0.5,), (2.0,)], "ratio double"))
    bands = S.geo_bands(st).orderBy("pos").collect()
    assert [b.label for b in bands] == S.BAND_LABELS
    assert bands[-1].ratio == pytest.approx(1.0)
    assert bands[5].ratio == pytest.approx(2.0)  # +1 s.d. = geo * sdf


def test_movers_top_n(spark):
    a = _df(spark, [("b", f"p{i}", 1.0, 0.99) for i in range(10)])
    b = _df(spark, [("b", f"p{i}", float(i), 0.99) for i in range(10)])
    top = C.movers(C.align_results(a, b), 3).collect()
    assert [r.name for r in top] == ["b/p9", "b/p8", "b/p7"]


def test_movers_keep_every_pair(spark):
    a = _df(spark, [("b", "p", 0.0, 0.99), ("b", "q", 1.0, 0.99), ("b", "r", 2.0, 0.99), ("c", "only", 1.0, 0.99)])
    b = _df(spark, [("b", "p", 3.0, 0.99), ("b", "q", 5.0, 0.99), ("b", "r", 1.0, 0.99)])
    al = C.align_results(a, b)
    assert [r.name for r in C.movers(al).collect()] == ["b/q", "b/r", "b/p"]
    assert [r.name for r in C.movers(al, worst=False).collect()] == ["b/r", "b/q", "b/p"]


def test_repeated_keys_pair_in_order_or_raise(spark):
    schema = SCHEMA + ", pos int"
    a = spark.createDataFrame([("b", "p", 1.0, 1.0, 2), ("b", "p", 2.0, 1.0, 1), ("b", "q", 9.0, 1.0, 3)], schema)
    b = spark.createDataFrame([("b", "p", 10.0, 1.0, 7), ("b", "p", 30.0, 1.0, 8), ("b", "p", 40.0, 1.0, 9)], schema)
    got = sorted((r.program, r.occ, r.side, r.cpu1, r.cpu2) for r in C.align_results(a, b, order=["pos"]).collect())
    assert got == [("p", 1, "both", 2.0, 10.0), ("p", 2, "both", 1.0, 30.0), ("p", 3, "second", None, 40.0), ("q", 1, "first", 9.0, None)]
    with pytest.raises(Exception, match="repeated key"):
        C.align_results(a, b).collect()


def test_files_that_share_a_name_are_paired_one_by_one(spark):
    a = spark.createDataFrame([("x", "/a/x.csv"), ("x", "/b/x.csv"), ("y", "/a/y.csv")], "block string, path string")
    b = spark.createDataFrame([("x", "/c/x.csv"), ("z", "/c/z.csv")], "block string, path string")
    got = sorted(map(tuple, C.align_blocks(a, b, file="path").collect()))
    assert got == [("x", 1, "both"), ("x", 2, "first"), ("y", 1, "first"), ("z", 1, "second")]


def test_header_only_file_counts_as_a_present_block(spark):
    a = _df(spark, [("b", "p", 1.0, 1.0), ("c", "q", 1.0, 1.0)])
    b = _df(spark, [("b", "p", 1.0, 1.0)])
    files = spark.createDataFrame([("b",), ("c",)], "block string")
    assert C.orphan_rows(a, b).count() == 0
    assert [r.program for r in C.orphan_rows(a, b, blocks=C.align_blocks(files, files)).collect()] == ["q"]


def test_report_cuts_no_name_and_shows_what_division_gives(spark):
    from benchlens.operators.report import render_report
    long = "a-very-very-long-program-name-of-a-one-sided-block"
    a = _df(spark, [("b", "p", 0.0, 1.0), ("b", "q", 2.0, 1.0), ("b", "n", None, 1.0), ("one", long, 1.5, 1.0)])
    b = _df(spark, [("b", "p", 3.0, 1.0), ("b", "q", 3.0, 1.0), ("b", "n", 1.0, 1.0)])
    al = C.align_results(a, b)
    lines = [r.line for r in render_report(al, S.geo_bands(S.geo_stats(C.gated_pairs(al))), "first", "second").collect()]
    row = {x.split()[0]: x.split()[1:] for x in lines if x.split()}
    assert row[long] == ["1.500e+00", "(none)", "(none)"] and row["p"] == ["0.000e+00", "3.000e+00", "Infinity%"]
    assert row["q"] == ["2.000e+00", "3.000e+00", "+50.0%"] and row["n"] == ["(none)", "1.000e+00", "(none)"]
    assert lines.index("b") < lines.index("one") and len({len(x) for x in lines if x.startswith(("p ", "q ", long, "---"))}) == 1


def test_dim_join_broadcasts_only_measured_small_dims(spark):
    from benchlens.operators.joins import dim_join, measured_bytes

    fact = spark.range(0, 1000).withColumnRenamed("id", "k")
    dim = spark.createDataFrame([(i, f"name{i}") for i in range(100)], "k long, name string")
    assert 100 * 16 < measured_bytes(dim) < 100 * 64
    small = dim_join(fact, dim, "k")
    big = dim_join(fact, dim, "k", max_bytes=10)
    assert small.count() == big.count() == 100
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
