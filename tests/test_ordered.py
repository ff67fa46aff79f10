import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from benchlens.operators.ordered import global_index, running, top_n_per_group


def _data(spark, n=2000, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None])
        rows.append((g, rnd.randint(0, 50), i, rnd.random()))
    return spark.createDataFrame(rows, "g string, t int, id long, v double")


def test_running_matches_plain_window(spark):
    df = _data(spark)
    got = running(df, ["g"], ["t", "id"], sums={"cum": "v"}, index="i", total="n", n_buckets=7)
    w = Window.partitionBy("g").orderBy("t", "id")
    exp = df.select("id", F.row_number().over(w).alias("i"),
                    F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"),
                    F.count(F.lit(1)).over(Window.partitionBy("g")).alias("n"))
    a = {r.id: (r.i, round(r.cum, 9), r.n) for r in got.select("id", "i", "cum", "n").collect()}
    b = {r.id: (r.i, round(r.cum, 9), r.n) for r in exp.collect()}
    assert a == b


def test_running_splits_hot_group_over_buckets(spark):
    from benchlens.operators.ordered import range_buckets

    df = _data(spark)
    b = df.withColumn("b", range_buckets(df, "t", 7))
    per_bucket = [r["count"] for r in b.where("g = 'hot'").groupBy("b").count().collect()]
    assert len(per_bucket) >= 5                       # the hot group is cut into many tasks
    assert max(per_bucket) < 0.4 * sum(per_bucket)    # and no bucket keeps most of it


def test_global_index_is_dense_and_ordered(spark):
    df = _data(spark, 500)
    got = global_index(df, ["t", "id"], index="gi", total="n", n_buckets=5).select("gi", "t", "id", "n").collect()
    got.sort(key=lambda r: r.gi)
    assert [r.gi for r in got] == list(range(500))
    assert all(r.n == 500 for r in got)
    assert [(r.t, r.id) for r in got] == sorted((r.t, r.id) for r in got)


def test_top_n_per_group_equals_plain(spark):
    df = _data(spark)
    got = top_n_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 3)
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), F.col("id"))
    exp = df.withColumn("rank", F.row_number().over(w)).where("rank <= 3")
    assert sorted(map(tuple, got.select("id", "rank").collect())) == \
        sorted(map(tuple, exp.select("id", "rank").collect()))


def test_many_buckets_two_level_are_monotone_and_exact(spark):
    from benchlens.operators import ordered as O

    old = O.MAX_TREE_BUCKETS
    O.MAX_TREE_BUCKETS = 4
    try:
        df = _data(spark)
        b = df.withColumn("b", O.range_buckets(df, "t", 24)).select("t", "b").collect()
        pairs = sorted((r.t, r.b) for r in b)
        assert all(p[1] <= q[1] for p, q in zip(pairs, pairs[1:]))     # non-decreasing in t
        assert len({r.b for r in b}) > 4                                # more than the tree gives
        got = running(df, ["g"], ["t", "id"], sums={"cum": "v"}, index="i", n_buckets=24)
        w = Window.partitionBy("g").orderBy("t", "id")
        exp = df.select("id", F.row_number().over(w).alias("i"),
                        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
        a = {r.id: (r.i, round(r.cum, 9)) for r in got.select("id", "i", "cum").collect()}
        assert a == {r.id: (r.i, round(r.cum, 9)) for r in exp.collect()}
    finally:
        O.MAX_TREE_BUCKETS = old


def test_one_plan_for_every_size_and_no_single_partition_over_rows(spark):
    df = _data(spark, 50)
    out = running(df, ["g"], ["t", "id"], index="i", total="n")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert plan.count("Window") >= 2
    w = Window.partitionBy("g").orderBy("t", "id")
    exp = {r.id: r.i for r in df.select("id", F.row_number().over(w).alias("i")).collect()}
    assert {r.id: r.i for r in out.collect()} == exp
    assert running(df.limit(0), ["g"], ["t", "id"], index="i").count() == 0


def test_top_n_limits_before_the_shuffle(spark):
    plan = top_n_per_group(_data(spark), ["g"], [F.col("v").desc(), F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange") == 1


def _texts(spark, n=3000, seed=4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        path = None if rnd.random() < 0.05 else "results/" + "".join(rnd.choice("abé/𐐷") for _ in range(rnd.randint(0, 9)))
        rows.append(("hot" if rnd.random() < 0.6 else rnd.choice(["a", None]), path, i, None if i % 50 == 0 else i % 7, i % 2 == 0))
    return spark.createDataFrame(rows, "g string, path string, id long, num int, flag boolean").withColumns({
        "raw": F.encode("path", "UTF-8"), "pair": F.struct("num", "path"), "dec": F.col("num").cast("decimal(30,3)")})


def test_running_in_the_order_of_any_type_nulls_first(spark):
    df = _texts(spark).cache()
    for first in ("path", "raw", "pair", "num", "flag", "dec"):
        got = running(df, ["g"], [first, "id"], index="i", total="n", n_buckets=9)
        w = Window.partitionBy("g").orderBy(first, "id")
        exp = {r.id: r.i for r in df.select("id", F.row_number().over(w).alias("i")).collect()}
        assert {r.id: r.i for r in got.select("id", "i").collect()} == exp, first
    assert running(df.limit(0), ["g"], ["path", "id"], index="i").count() == 0
    nulls = df.where("path is null")
    assert sorted(r.i for r in running(nulls, [], ["path", "id"], index="i").collect()) == list(range(1, nulls.count() + 1))


def test_text_buckets_split_a_hot_group_and_do_not_decrease(spark):
    from benchlens.operators import ordered as O

    df = _texts(spark).where("g = 'hot'").cache()
    old = O.MAX_TREE_BUCKETS
    try:
        for tree, n in ((1024, 8), (4, 24)):  # the second needs limits inside the tree's buckets
            O.MAX_TREE_BUCKETS = tree
            rows = df.select("path", O.range_buckets(df, "path", n).alias("b")).orderBy("path").collect()
            assert all(a.b <= b.b for a, b in zip(rows, rows[1:])) and rows[0].path is None and rows[0].b == 0
            sizes = [sum(r.b == b for r in rows) for b in {r.b for r in rows}]
            assert len(sizes) > n / 2 and max(sizes) < 0.5 * len(rows)
    finally:
        O.MAX_TREE_BUCKETS = old


def test_numbers_that_are_not_finite(spark):
    vals = [float("nan"), float("inf"), float("-inf"), None, *map(float, range(500)), float("nan")]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(vals)], "v double, id long")
    got = {r.id: r.gi for r in global_index(df, ["v", "id"], index="gi", n_buckets=6).collect()}
    w = Window.orderBy("v", "id")
    assert got == {r.id: r.gi for r in df.select("id", (F.row_number().over(w) - 1).alias("gi")).collect()}


def test_group_keys_of_any_type(spark):
    df = _texts(spark, 300)
    for key in ("raw", "pair", "flag", "dec"):
        got = {r.id: r.i for r in running(df, [key], ["id"], index="i", n_buckets=3).collect()}
        w = Window.partitionBy(key).orderBy("id")
        assert got == {r.id: r.i for r in df.select("id", F.row_number().over(w).alias("i")).collect()}, key
