import numpy as np
import pytest
from pyspark.sql import functions as F

from benchlens.llm import dimension_scan
from benchlens.llm.dimension_scan import nearest_in_block, parts_of, scan_groups, search

SF = "/root/testdata/sf0.01"


def brute(rows, k, wanted):
    out = {}
    for i, q in rows.items():
        if wanted(i):
            near = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in rows.items() if j != i)[:k]
            out[i] = near
    return out


def collect(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.score, r.vec_id))
    return got


def test_query_against_brute_force(spark):
    from benchlens.llm.queries import QUERIES
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    got = collect(QUERIES["op2_dimension_scan"](spark, SF))
    want = brute(rows, 10, lambda i: i % 100 == 0)
    assert set(got) == set(want)
    assert sum(j in {x for _, x in want[i]} for i in got for _, j in got[i]) / (10 * len(want)) >= 0.9
    for i in got:
        for d, j in got[i]:
            assert d == pytest.approx(float(np.sqrt(((rows[i] - rows[j]) ** 2).sum())), abs=1e-12)


def test_recall_with_part_of_the_lists(spark):
    emb = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = {r.vec_id: np.array(r.embedding, float) for r in emb.collect()}
    ids, x = np.array(list(rows)), np.stack(list(rows.values()))
    got = collect(search(emb, emb.where("vec_id % 100 = 0")))
    hit = 0
    for i in got:
        d = np.sqrt(((x - rows[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:10]
        hit += len({int(ids[j]) for j in order} & {j for _, j in got[i]})
    recall = hit / (10 * len(got))
    print("recall", recall)
    assert recall >= 0.9
    assert all(len(v) == 10 for v in got.values())


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]),
            (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (3, [0.0, 2.0]), (100, [1.0, 0.0]), (200, None), (300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = collect(search(df, df.where("vec_id % 100 = 0")))
    far = 5 ** 0.5
    assert got == {0: [(0.0, 1), (0.0, 2), (0.0, 100), (far, 3)], 100: [(0.0, 0), (0.0, 1), (0.0, 2), (far, 3)]}
    assert search(df.limit(0), df).count() == 0 and search(df, df.limit(0)).count() == 0
    assert search(df.where("vec_id = 0"), df).count() == 4  # the queries 1, 2, 3 and 100


def test_many_copies_of_one_vector(spark):
    df = spark.range(9001).select(F.col("id").alias("vec_id"), F.when(F.col("id") % 3 < 2, F.array(F.lit(0.1), F.lit(0.7), F.lit(-0.2))).otherwise(
        F.array(F.rand(1), F.rand(2), F.rand(3))).alias("embedding"))
    got = collect(search(df, df.where("vec_id in (0, 3000, 9000)")))
    copies = [i for i in range(40) if i % 3 < 2]
    for i in (0, 3000, 9000):
        assert got[i] == [(0.0, j) for j in copies if j != i][:10]


def test_groups_are_bounded_on_both_sides(spark):
    """One id with most of the rows, one list with most of the vectors, many queries: every pair meets once."""
    index = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("id"),
                                     F.array(F.col("id").cast("double")).alias("vec"), (F.col("id") % 10 == 0).cast("int").alias("list"))
    asked = spark.range(900).select("id", F.array(F.lit(0.5)).alias("vec"), F.lit(1.0).alias("most"), F.array(F.lit(0), F.lit(1)).alias("at"))
    sizes = [r["count"] for r in index.groupBy("list").count().orderBy("list").collect()]
    left, right = scan_groups(index, asked, [parts_of(s, 500) for s in sizes], parts_of(900, 300))
    keys = ["list", "block", "part"]
    n, m = left.groupBy(*keys).count(), right.groupBy(*keys).count().withColumnRenamed("count", "asked")
    rows = n.join(m, keys).collect()
    assert max(r["count"] for r in rows) < 2 * 500 and max(r["asked"] for r in rows) < 2 * 300
    assert sum(r["count"] * r["asked"] for r in rows) == 6000 * 900


def test_parts_of_queries_and_lists_change_no_result(spark, monkeypatch):
    emb = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = collect(search(emb, emb.where("vec_id % 20 = 0"), share=1.0))
    monkeypatch.setattr(dimension_scan, "QUERY_ROWS", 7)
    monkeypatch.setattr(dimension_scan, "BLOCK_ROWS", 20)
    got = collect(search(emb, emb.where("vec_id % 20 = 0"), share=1.0))
    assert set(got) == set(want)
    assert sum(got[i] == want[i] for i in got) >= 0.9 * len(got)  # smaller blocks have other limits, so other hypothesis tests


def test_block_scan_equals_brute_force_within_the_limit():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 40))
    ids = rng.permutation(3000)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    hits = 0
    for t in range(20):
        q = x[t] + 0.1 * rng.normal(size=40)
        d = np.sqrt(((x - q) ** 2).sum(1))
        want = sorted((float(a), int(b)) for a, b in zip(d, ids) if b != ids[t])[:10]
        got = nearest_in_block(ids, x, np.ascontiguousarray((x @ turn).T), int(ids[t]), q, q @ turn, want[-1][0] * 1.2, 10)
        hits += len(set(got) & set(want))
    assert hits >= 0.98 * 200


def test_repeated_rows_do_not_use_up_the_places(spark):
    """Copies of one id, and different vectors of one id, leave room for ten other ids."""
    rows = [(i, [1.0, i / 10]) for i in range(30)] + [(1, [1.0, 0.1])] * 200 + [(1, [1.0, 0.01 + j / 1e4]) for j in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collect(search(df, df.where("vec_id = 0")))
    assert [j for _, j in got[0]] == list(range(1, 11)) and got[0][0][0] == pytest.approx(0.01)
