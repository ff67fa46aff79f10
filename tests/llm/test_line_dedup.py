import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from benchlens.llm import queries
from benchlens.llm.line_dedup import keep_bitmaps, with_kept_text

WHITE = " \t\n\x0b\x0c\r"
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, at_least, keep_first):
    """(id, n_lines, n_dropped, kept text) by definition; rows are (id, text) in ascending order."""
    cut = [(d, (t or "").split("\n")) for d, t in rows]
    where = {}
    for r, (d, lines) in enumerate(cut):
        for i, line in enumerate(lines):
            where.setdefault(line.strip(WHITE).translate(A_TO_Z), []).append((r, i))
    gone = set()
    for key, at in where.items():
        if key and len({cut[r][0] for r, _ in at}) >= at_least:
            gone.update(sorted(at)[1:] if keep_first else at)
    return sorted(((d, len(ls), sum((r, i) in gone for i in range(len(ls))),
                    "\n".join(x for i, x in enumerate(ls) if (r, i) not in gone)) for r, (d, ls) in enumerate(cut)), key=str)


ROWS = [(1, "Header\nbody one\n\nFOOTER "), (2, "header\t\nbody two\nfooter\nfooter"), (3, "\x0bHEADER\r\nÀ la carte\nà la carte"),
        (4, None), (5, ""), (6, "\n\n"), (7, "À la carte\nonly here"), (8, "header"), (9, "x\n" * 3000 + "header\n" + "y\n" * 3000)]


@pytest.mark.parametrize("at_least,keep_first", [(2, True), (2, False), (3, True), (4, False), (99, False)])
def test_equals_brute_force(spark, at_least, keep_first):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in ROWS], "doc_id long, text string, kept int, _pos string")
    got = with_kept_text(df, keep_bitmaps(df, at_least=at_least, keep_first=keep_first)).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got), key=str) == brute(ROWS, at_least, keep_first)
    for r in got:  # the bitmap is in run lengths
        assert sum(k.length for k in r.kept) == r.n_lines - r.n_dropped
        assert all(a.start + a.length < b.start for a, b in zip(r.kept, r.kept[1:]))


def test_bitmaps_are_small_and_carry_no_text(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = {r._doc: r.dropped for r in keep_bitmaps(df, at_least=4, keep_first=False).collect()}
    assert set(got) == {1, 2, 3, 8, 9}
    assert [tuple(x) for x in got[9]] == [(3000, 1)]
    assert [tuple(x) for x in got[1]] == [(0, 1)]


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a\nb"), (None, "a\nc"), (1, "a\nb"), (1, "a\nb"), (2, "B")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = with_kept_text(df, keep_bitmaps(df, at_least=3, keep_first=False)).collect()
    # null ids are one document: "a" is in 2 documents, "b" in 3
    assert sorted((str(r.doc_id), r.n_dropped, r.kept_text) for r in got) == [
        ("1", 1, "a"), ("1", 1, "a"), ("2", 1, ""), ("None", 0, "a\nc"), ("None", 1, "a")]
    none = df.limit(0)
    assert with_kept_text(none, keep_bitmaps(none)).count() == 0


def test_a_line_of_all_documents_lies_in_many_slices(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("same\n"), F.col("id").cast("string")).alias("text"))
    got = with_kept_text(df, keep_bitmaps(df, at_least=10, keep_first=True))
    assert got.where("n_dropped = 1").count() == 1999 and got.where("n_dropped = 0").first().doc_id == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    got = sorted(map(tuple, queries.op13_line_dedup(spark, path).collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
        want = sorted(db.execute(queries.SQL["op13_line_dedup"]).fetchall())
    assert got == want and sum(r[2] for r in got) > 0
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect())
    assert got == [(d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in sorted(brute(rows, 10, False))]


def test_main_path_is_native(spark):
    plan = queries.op13_line_dedup(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
