import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from benchlens.operators.corpus import cached_table
from benchlens.operators.report import template_lines
from benchlens.sinks.writers import append_outcomes, commit_new, remove_results, write_results, write_texts
from benchlens.sources.files import with_path_tags
from benchlens.sources.lines import file_lines
from benchlens.streaming import tee
from benchlens.streaming.tee import merge_streams, read_merged, tee_stream


def test_tee_writes_the_same_rows_to_both_sinks(spark, tmp_out):  # K3
    src_dir = f"{tmp_out}/src"
    spark.range(0, 100).withColumn("k", F.col("id") % 3).write.parquet(src_dir)
    sdf = spark.readStream.schema("id long, k long").parquet(src_dir)
    tee_stream(sdf, f"{tmp_out}/a", f"{tmp_out}/b", f"{tmp_out}/ca", f"{tmp_out}/cb")
    a = spark.read.parquet(f"{tmp_out}/a")
    b = spark.read.parquet(f"{tmp_out}/b")
    assert a.count() == 100 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_replace_keeps_other_partitions(spark, tmp_out):  # K1, K2
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "v int, variant string")
    write_results(df, f"{tmp_out}/r", ["variant"])
    write_results(spark.createDataFrame([(9, "y")], "v int, variant string"), f"{tmp_out}/r", ["variant"],
                  replace=True)
    got = sorted((r.variant, r.v) for r in spark.read.parquet(f"{tmp_out}/r").collect())
    assert got == [("x", 1), ("y", 9)]


def test_append_outcomes(spark, tmp_out):  # K4
    lines = spark.createDataFrame([("ERROR: a returned exit code 1",)], "line string")
    append_outcomes(lines, f"{tmp_out}/log")
    append_outcomes(lines, f"{tmp_out}/log")
    assert spark.read.text(f"{tmp_out}/log").count() == 2


def _sources(spark, root):
    return {name: spark.readStream.schema("id long, line string").parquet(f"{root}/{name}") for name in ("out", "err")}


def _add(spark, root, name, first, n):
    spark.range(first, first + n).select("id", F.concat(F.lit(name), F.col("id").cast("string")).alias("line")).write.mode("append").parquet(f"{root}/{name}")


def _ordered(spark, sink):
    rows = sorted((r.source, r.batch, r.pos, r.id) for r in read_merged(spark, sink).collect())
    return {s: [r[3] for r in rows if r[0] == s] for s in ("out", "err")}


def test_two_sources_continue_after_a_crash_between_sinks(spark, tmp_out, monkeypatch):  # K3
    src, sinks, ckpt = f"{tmp_out}/src", [f"{tmp_out}/log", f"{tmp_out}/copy"], f"{tmp_out}/ckpt"
    _add(spark, src, "out", 0, 50)
    _add(spark, src, "err", 0, 7)
    merge_streams(_sources(spark, src), ["id"], sinks, ckpt)
    _add(spark, src, "out", 50, 20)
    _add(spark, src, "err", 7, 3)
    real = tee.materialize

    class Dying:  # writes the first sink's batch, then dies
        def __init__(self, df):
            self.df, self.writes = df, 0

        @property
        def write(self):
            self.writes += 1
            if self.writes > 1:
                raise RuntimeError("killed")
            return self.df.write

    monkeypatch.setattr(tee, "materialize", lambda df: Dying(real(df)))
    with pytest.raises(Exception):
        merge_streams(_sources(spark, src), ["id"], sinks, ckpt)
    assert len(_ordered(spark, sinks[0])["out"]) == 70 and len(_ordered(spark, sinks[1])["out"]) == 50
    monkeypatch.setattr(tee, "materialize", real)
    _add(spark, src, "err", 10, 5)  # arrives before the restart
    merge_streams(_sources(spark, src), ["id"], sinks, ckpt)
    merge_streams(_sources(spark, src), ["id"], sinks, ckpt)  # nothing new
    for sink in sinks:
        assert _ordered(spark, sink) == {"out": list(range(70)), "err": list(range(15))}


def test_a_build_that_dies_leaves_no_cache(spark, tmp_out):  # S8
    path = f"{tmp_out}/cache"
    bad = spark.range(10).withColumn("x", F.when(F.col("id") == 9, F.raise_error(F.lit("dies"))).otherwise(F.col("id")))
    with pytest.raises(Exception):
        cached_table(spark, path, lambda: bad)
    (tmp_dir := __import__("pathlib").Path(path) / "_temporary" / "0").mkdir(parents=True)  # as a killed job leaves it
    (tmp_dir / "part-0").write_text("half")
    assert cached_table(spark, path, lambda: spark.range(3)).count() == 3
    assert cached_table(spark, path, lambda: spark.range(99)).count() == 3
    assert not commit_new(spark.range(5), path) and spark.read.parquet(path).count() == 3


def test_a_repeated_append_adds_nothing(spark, tmp_out):  # K4
    lines = spark.createDataFrame([("ERROR: a returned exit code 1",)], "line string")
    assert [append_outcomes(lines, f"{tmp_out}/log", batch=b) for b in ("1", "1", "2")] == [True, False, True]
    assert spark.read.text(f"{tmp_out}/log").count() == 2


def test_a_run_without_rows_takes_the_place_of_the_older_one(spark, tmp_out):  # K2
    df = spark.createDataFrame([(1, "x", "n"), (2, "y", "n"), (3, "y", "m")], "v int, variant string, target string")
    write_results(df, f"{tmp_out}/r", ["variant", "target"])
    assert remove_results(spark, f"{tmp_out}/r", {"variant": "y", "target": "n"}) == 1
    assert remove_results(spark, f"{tmp_out}/r", {"variant": "z"}) == 0
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_out}/r").collect()) == [1, 3]


@pytest.fixture
def many_parts(spark):
    """Small shuffle partitions stay apart, as large ones would."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_long_document_is_several_ordered_parts(spark, tmp_out, many_parts):  # K5, K6
    """A document with a million of the lines, some of a few, and none: each is read back in its order."""
    n = 1_000_000
    some = spark.range(n + 50).select(F.when(F.col("id") < n, "big/one").when(F.col("id") % 2 == 0, "é small").alias("doc"),
                                      F.pmod(F.col("id") * 7919, F.lit(n + 50)).alias("o"))
    some = some.select("doc", "o", F.concat(F.lit("line "), "o").alias("text"))
    assert write_texts(some, f"{tmp_out}/docs", ["o"], "doc", "text")
    assert not write_texts(some.limit(0), f"{tmp_out}/docs", ["o"], "doc", "text")
    back = with_path_tags(file_lines(spark, f"{tmp_out}/docs", per_folder=True), "folder", ["document"])
    parts = spark.read.text(f"{tmp_out}/docs").where("document = 'big/one'").select("_metadata.file_name").distinct().count()
    assert parts > 1
    want = some.withColumn("line_no", F.row_number().over(Window.partitionBy("doc").orderBy("o"))).select(
        F.coalesce("doc", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("document"), F.col("line_no").cast("long").alias("line_no"), "text")
    got = back.select("document", "line_no", "text")
    assert got.count() == n + 50 and got.exceptAll(want).count() == 0


def test_one_ordered_text_and_its_edges(spark, tmp_out, many_parts):  # K5
    rows = [(i * 37 % 500, f"row {i * 37 % 500}") for i in range(500)] + [(None, "first"), (900, None), (901, "two\nlines")]
    df = spark.createDataFrame(rows, "o int, line string")
    write_texts(df, f"{tmp_out}/t", ["o"])
    got = [r.text for r in file_lines(spark, f"{tmp_out}/t", per_folder=True).orderBy("line_no").collect()]
    assert got == ["first", *[f"row {i}" for i in range(500)], "", "two", "lines"]
    write_texts(df.limit(0), f"{tmp_out}/none", ["o"])
    assert spark.read.schema("value string").text(f"{tmp_out}/none").count() == 0


def test_template_lines(spark):  # K6
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), (None, 1, "z")], "g string, o int, v string")
    got = template_lines(df, "g", "o", F.col("v"), F.concat(F.lit("head "), F.coalesce("g", F.lit("?"))), F.lit("end"))
    rows = sorted(map(tuple, got.collect()), key=lambda r: (r[0] or "", r[1], r[2] or 0))
    assert [r[3] for r in rows] == ["head ?", "z", "end", "head a", "x", "y", "end"]
