import duckdb
import pytest
from pyspark.sql import functions as F

from benchlens.llm.preference import format_pairs, pairs_by_opening

SCHEMA = "conv_id long, turn long, role string, text string, prompt string"


def turns(spark, convs):
    return spark.createDataFrame([(c, i, r, t, "x") for c, ts in convs.items() for i, (r, t) in enumerate(ts)], SCHEMA)


U, A = ("user", "hi"), ("assistant", "hello é")


def brute(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    show = lambda ts: "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in ts)
    runs = lambda ts: ",".join(f"{len(r or '') + 5}:0,{len(t or '') + 8}:{int(r == 'assistant')}" for r, t in ts)
    return n, show(a[:n]), show(a[n:]), show(b[n:]), runs(a[n:]), runs(b[n:])


CONVS = {1: [U, A, ("user", "x")], 2: [U, A, ("user", "y"), A], 3: [U, A, ("user", "x")], 4: [U], 5: [(None, None), A],
         6: [(None, None), (None, "")], 7: [(None, None)], 8: [("system", "s" * 5000), U, A]}


def test_pairs_match_brute_force(spark):
    df = turns(spark, CONVS)
    wanted = [(1, 2), (1, 3), (1, 4), (5, 6), (5, 7), (8, 1), (8, None), (None, None), (2, 99)]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(wanted)] + [(0, 1, 2)],
                                  "pair_id long, chosen_id long, rejected_id long")
    got = {r.pair_id: tuple(r)[3:] for r in format_pairs(df, pairs).collect()}
    assert got == {i: brute(CONVS.get(a, []), CONVS.get(b, [])) for i, (a, b) in enumerate(wanted)}
    for i, (a, _) in enumerate(wanted):
        runs = [x.split(":") for x in got[i][4].split(",") if x]
        assert sum(int(n) for n, _ in runs) == len(got[i][2])


def test_every_conversation_is_in_one_pair(spark):
    df = turns(spark, CONVS)
    got = sorted((r.chosen_id, r.rejected_id) for r in pairs_by_opening(df).collect())
    assert got == [(1, 2), (3, 4), (5, 6), (7, None), (8, None)]
    assert format_pairs(df, pairs_by_opening(df)).count() == 5


def test_repeated_turns_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "user", "b", ""), (1, 0, "user", "a", ""), (1, 0, "user", "a", ""), (1, None, "user", "z", ""),
                                (None, 0, "user", "lost", "")], SCHEMA)
    r = format_pairs(df, pairs_by_opening(df)).collect()
    assert len(r) == 1 and r[0].chosen == "".join(f"<|user|>\n{t}<|end|>\n" for t in "zaab")
    assert format_pairs(df.limit(0), pairs_by_opening(df.limit(0))).count() == 0


def test_hot_opening(spark):
    df = spark.range(3001).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    got = pairs_by_opening(df)
    assert got.count() == 1501 and got.where("rejected_id = chosen_id + 1").count() == 1500


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    from benchlens.llm.queries import QUERIES, SQL
    path = f"/root/testdata/{sf}/conversations.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}')")
    res = con.execute(SQL["op1_preference_format"])
    cols = [d[0] for d in res.description]
    want = sorted(res.fetchall())
    got = QUERIES["op1_preference_format"](spark, f"/root/testdata/{sf}")
    assert got.columns == cols
    assert sorted(tuple(r) for r in got.collect()) == want


def test_text_ids(spark):
    """Conversation ids may be of any ordered type."""
    df = spark.createDataFrame([(f"conv-{i:03d}", 0, "user", "same") for i in range(9)] + [(None, 0, "user", "same")],
                               "conv_id string, turn long, role string, text string")
    got = sorted((r.pair_id, r.chosen_id, r.rejected_id) for r in format_pairs(df, pairs_by_opening(df)).collect())
    assert got == [(f"conv-{i:03d}", f"conv-{i:03d}", f"conv-{i + 1:03d}" if i < 8 else None) for i in range(0, 9, 2)]
