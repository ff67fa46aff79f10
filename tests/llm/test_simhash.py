import random

import numpy as np
import xxhash

from benchlens.llm.components import components
from benchlens.llm.simhash import (budgets, chain_keys, fingerprints, hex_fingerprint, keep_one, near_duplicates,
                                   near_links, text_fingerprint)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    own = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(nodes, near):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprint_matches_definition():
    rng = random.Random(5)
    words = ["The", "cat", "ÄPFEL", "x\x85y", "über", "a"]
    for text in [None, "", " \t\n", "one", "One two", "a b c"] + [
            " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(100)]:
        assert text_fingerprint(text) == plain_fingerprint(text)
    many = " ".join(rng.choice(words) for _ in range(9000))  # more than one step
    assert text_fingerprint(many) == plain_fingerprint(many)


def test_spark_hash_is_the_same_family(spark):
    from pyspark.sql import functions as F
    got = spark.createDataFrame([("the cat sat",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"the cat sat", 42)


def test_every_pair_within_distance_shares_a_key():
    rng = random.Random(1)
    keys = chain_keys(2, 8)
    assert budgets(2, 8) == [0, 0, 0, 1, 1, 1, 1, 2] and len(keys) == 32
    turn = lambda x, n: (x << 8 * n | x >> (64 - 8 * n)) & (1 << 64) - 1 if n else x
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << bit
        assert any(not (turn(a, s) ^ turn(b, s)) & m for s, m in keys)


def test_links_connect_like_brute_force(spark):
    rng = np.random.default_rng(7)
    codes = {0, 1, 3, 7, 15, (1 << 64) - 1}
    for c in rng.integers(0, 1 << 63, 40):
        x = int(c)
        for _ in range(int(rng.integers(1, 12))):  # walks of few bits: chains and crowds
            codes.add(x)
            for bit in rng.integers(0, 64, int(rng.integers(1, 4))):
                x ^= 1 << int(bit)
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fingerprint long")
    want = roots(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    for segments in (4, 8, 16):
        got = {r.node: r.root for r in components(near_links(df, 2, segments)).collect()}
        assert {c: got.get(c, c) for c in signed} == want
    one = {r.node: r.root for r in components(near_links(df, 1, 8)).collect()}
    assert {c: one.get(c, c) for c in signed} == roots(signed, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 1)


def test_crowded_bucket_gives_a_forest(spark):
    base = 0x0123456789ABCDEF
    codes = [base ^ x for x in range(256)]  # 256 fingerprints that differ in the lowest segment only
    got = near_links(spark.createDataFrame([(c,) for c in codes], "fingerprint long"))
    assert got.count() <= 32 * 255
    assert components(got).select("root").distinct().count() == 1


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (1000, 999)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 999: 999, 1000: 999}
    assert components(edges.limit(0)).count() == 0


DOCS = [(5, "same words here again", "x"), (2, "Same  words here\nagain", "x"), (9, None, "x"), (7, "", "x"), (8, " \n", "x"),
        (None, "quite other words in this row", "x"), (4, "quite other words in this row", "x"),
        (None, "a lonely row without a number", "x"), (4, "quite other words in this row", "x")]


def test_nulls_ties_and_extra_columns(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, fingerprint string")
    got = sorted(((r[0], r[2]) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 2), (2, 2), (9, 7), (7, 7), (8, 7), (None, 4), (4, 4), (None, None), (4, 4)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0
    row = fingerprints(df, ["doc_id"]).select(hex_fingerprint().alias("h")).distinct().collect()
    assert all(len(r.h) == 16 and r.h == r.h.lower() for r in row)


def test_keep_one_row_of_each_group(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string, fingerprint string")
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 4, 7, None]
    assert keep_one(df.limit(0)).count() == 0


def test_query_matches_brute_force(spark):
    from benchlens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fp = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = roots(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert got == {d: (f"{fp[d]:016x}", want[d]) for d in fp}
