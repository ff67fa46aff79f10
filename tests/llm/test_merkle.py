import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from benchlens.llm.merkle import LONG, PARAGRAPH, PHRASE, PIECES, SECTION, compare_with_edited, leaf_codes, likeness, parts, with_edit_place, with_tree
from benchlens.llm.successor import with_next

TEXTS = ["", "one", " \n", "a b c d e f. g h!i j\n\n\nnext é part\nmore 3.14 x\n\n end ", "日本語 テスト。", "\n\n\n", "x\x0by\tz " * 40,
         "First section. It has two lines,\nof some words each.\n\nSecond section here."]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def cut(text):
    java = SECTION.replace(r"\z", r"\Z")
    return [[[m.group() for m in re.finditer(PHRASE, p)] for p in re.findall(PARAGRAPH, s.group())] for s in re.finditer(java, text)]


def tree(text):
    paras = [[sha("p:" + "".join(sha(x) for x in p)) for p in s] for s in cut(text)]
    return sha("r:" + "".join(sha("s:" + "".join(s)) for s in paras)), paras


def near(a, b):
    if a == b:
        return 1.0
    la, lb = (Counter(y for s in cut(t) for p in s for x in p for y in ([x] if len(x) <= LONG else re.findall(PIECES, x))) for t in (a, b))
    total = len(a) + len(b)  # no character is lost
    return 2 * sum(len(x) * n for x, n in (la & lb).items()) / total if total else 1.0


def test_no_character_is_lost(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for r in df.select("t", parts(F.col("t")).alias("p")).collect():
        assert r.p == cut(r.t)
        assert "".join(x for s in r.p for p in s for x in p) == r.t


def test_tree_and_roots(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS + [None]], "t string")
    roots = {}
    for r in with_tree(df, "t", "root", "paras", "leaves").collect():
        assert (r.root, r.paras) == tree(r.t or "")
        roots.setdefault(r.root, set()).add(r.t or "")
    assert all(len(v) == 1 for v in roots.values()) and len(roots) == len(TEXTS)


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_next_row_over_ranges(spark, buckets):
    ids = [5, 1, None, 9, 9, 9, 2, 70, None, -3]
    df = spark.createDataFrame([(d, i) for i, d in enumerate(ids)], "id long, tie long").repartition(4)
    got = {(r.id, r.tie): (r.nid, r.ntie) for r in with_next(df, "id", F.col("tie"), {"id": "nid", "tie": "ntie"}, buckets).collect()}
    order = sorted(((d, i) for i, d in enumerate(ids)), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    assert got == {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}
    assert with_next(df.limit(0), "id", F.col("tie"), {"id": "nid"}, buckets).count() == 0
    one = with_next(df.limit(1), "id", F.col("tie"), {"tie": "ntie"}, buckets).first()
    assert one.ntie == one.tie


def test_hot_id_is_cut_by_the_tie(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("id"), F.xxhash64("id").alias("tie"))
    got = with_next(df, "id", F.col("tie"), {"id": "nid", "tie": "ntie"}, 16).collect()
    order = sorted((r.id, r.tie) for r in df.collect())
    assert {(r.id, r.tie): (r.nid, r.ntie) for r in got} == {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}


def brute(rows):
    rows = sorted(rows)
    out = {}
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        edited = t[:len(t) - q] + nxt[:q]
        out[d] = (len(t), sha(edited), tree(t)[0], tree(edited)[0], near(t, edited), near(t, nxt))
    return out


def test_query_matches_brute_force(spark):
    from benchlens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op7_merkle_tree"](spark, sf).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert (r.near_edited, r.near_next) == pytest.approx(want[r.doc_id][4:])


def test_nulls_ties_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, 3), (1, None, 4), (2, "a b c d e f g h", 5), (None, "", 6), (4, "long " * 500, 7)],
                               "doc_id long, text string, fingerprint int")
    got = compare_with_edited(df).collect()
    assert len(got) == 5 and len({r.fingerprint for r in got}) == 3
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert [r.near_edited for r in got if r.n_chars == 0] == [1.0] * 3
    assert compare_with_edited(df.limit(0)).count() == 0


def test_differing_branch_is_found(spark):
    a = "one two\nthree four\n\nfive six\nseven eight\nnine\n\nlast"
    pairs = [(a, a, None, None), (a, a.replace("seven", "SEVEN"), 1, 1), (a, a + " more", 2, 0), (a, "", 0, 0),
             (a, a.replace("\n\nlast", "\n\n"), 2, 0), ("", "", None, None)]
    df = spark.createDataFrame(pairs, "a string, b string, section long, paragraph long")
    t = with_tree(with_tree(df, "a", "ra", "pa", "la"), "b", "rb", "pb", "lb")
    for r in with_edit_place(t, "pa", "pb", "s", "p").collect():
        assert (r.s, r.p) == (r.section, r.paragraph), (r.a, r.b)


def test_leaf_codes_keep_lengths_and_repeats(spark):
    df = spark.createDataFrame([("x" * 3000 + " . yy",), ("",), ("same line\n" * 100,)], "t string")
    for r in df.select("t", leaf_codes(parts(F.col("t"))).alias("c")).collect():
        assert sum(c & 1023 for c in r.c) == len(r.t) and len(set(r.c)) == len(r.c)


def test_likeness_is_the_share_of_common_characters(spark):
    import random
    rnd = random.Random(1)
    run = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(100_000))  # one word
    lines = "the same line again\n" * 100
    other = "".join(rnd.choice("ABCDEFGH") for _ in range(25_000))
    pairs = [(run, run[:75_000] + other), (lines, lines[:1500] + "z" * 500), (run, other * 4), (run, run[:50_000] + "!" + run[50_000:])]
    df = with_tree(with_tree(spark.createDataFrame(pairs, "a string, b string"), "a", "ra", "pa", "la"), "b", "rb", "pb", "lb")
    got = [r[0] for r in df.select(likeness("ra", "la", "rb", "lb")).collect()]
    assert got[0] == pytest.approx(0.75, abs=0.02) and got[1] == pytest.approx(0.75, abs=0.02) and got[2] < 0.05 and got[3] > 0.95
    assert got == pytest.approx([near(a, b) for a, b in pairs])
