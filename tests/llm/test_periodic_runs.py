import hashlib
import random
import zlib

import pytest

from benchlens.llm import queries
from benchlens.llm.periodic_runs import detect, find_runs, runs_by_automaton, stretches, suffix_automaton


def brute(words, least):
    """Maximal stretches that keep a period, with no smaller period, by comparing words at every distance."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            own = words[start:start + length]
            if length >= max(least, 2 * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_random_texts_equal_brute_force():
    rng = random.Random(5)
    found = 0
    for _ in range(500):
        least, letters = rng.choice([2, 4, 7, 12, 12]), rng.choice([1, 2, 2, 3, 5])
        words = [b"%d" % rng.randrange(letters) for _ in range(rng.randint(0, 70))]
        if rng.random() < 0.5 and len(words) > 3:
            a = rng.randrange(len(words))
            p = rng.randint(1, max(1, (len(words) - a) // 3))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        texts = [words, words[::-1], words[: len(words) // 2], []]
        got = find_runs(texts, least)
        assert got == [brute(t, least) for t in texts]
        found += sum(map(len, got))
        number = {w: k for k, w in enumerate(sorted(set(words)))}
        assert sorted(runs_by_automaton([number[w] for w in words], least), key=lambda r: (r[0], r[2])) == got[0]
    assert found > 1000


def test_automaton_has_one_path_for_each_substring():
    words = [0, 1, 0, 0, 1, 0, 1]
    link, size, prefix = suffix_automaton(words)
    subs = {tuple(words[i:j]) for i in range(7) for j in range(i + 1, 8)}
    assert sum(size[s] - size[link[s]] for s in range(1, len(link))) == len(subs)
    assert [size[p] for p in prefix] == list(range(1, 8))


def test_only_stretches_that_repeat_reach_the_automaton():
    import numpy as np
    plain = np.arange(1000, dtype=np.uint64)
    assert not list(stretches(plain, np.zeros(1000, np.int64), 12))
    far = np.concatenate([plain[:50], plain[500:900], plain[:50]])  # the same 50 words at both ends: no period
    assert not list(stretches(far, np.zeros(far.size, np.int64), 12))
    near = np.concatenate([plain[:50], plain[50:70], plain[50:70], plain[70:200]])
    assert list(stretches(near, np.zeros(near.size, np.int64), 12)) == [(50, 90)]
    assert not list(stretches(near, np.arange(near.size) // 70, 12))  # the copies lie in two texts


def row(words, least=12):
    runs = brute(words, least)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def tail(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op12_periodic_runs(spark, sf).collect()
    assert len(got) == len(rows)
    short = [r for r in got if len((rows[r.doc_id] or "").split()) < 1500]  # brute force is quadratic
    assert len(short) > 150 and sum(r.n_runs > 0 for r in short) > 10
    for r in short:
        assert tuple(r)[1:] == row(tail(r.doc_id, (rows[r.doc_id] or "").encode().split())), r.doc_id


def test_edges(spark):
    long = "a b c " * 20_000 + "end"
    rows = [(1, None, 0), (2, "", 0), (3, " \n\t", 0), (None, "x " * 12, 0), (4, "x " * 11, 0), (5, long, 0), (5, long, 1),
            (6, "é\x0bé\x0cé " * 5 + "É", 0), (7, "a\xa0b " * 12, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs int")
    got = detect(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = [t for d, t, _ in rows if d == r.doc_id][0]
        if r.doc_id == 5:
            assert tuple(r)[1:5] == (1, 0, 60_000, 3) and r.exponent_milli == 20_000_000
        else:
            assert tuple(r)[1:] == row((text or "").encode().split())
    assert detect(df.limit(0)).count() == 0


def test_ties_take_the_first_run():
    two = [b"a", b"b"] * 6 + [b"-"] + [b"c", b"d"] * 6
    runs = find_runs([two])[0]
    assert runs == [(0, 12, 2), (13, 12, 2)]
    from benchlens.llm.periodic_runs import describe
    assert describe(two, runs)[:5] == (2, 0, 12, 2, 6000)


@pytest.mark.parametrize("least", [12])
def test_batches_do_not_change_the_result(spark, monkeypatch, least):
    from benchlens.llm import periodic_runs
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = sorted(map(tuple, detect(df, least=least).collect()))
    monkeypatch.setattr(periodic_runs, "_BATCH_WORDS", 1)
    assert sorted(map(tuple, detect(df, least=least).collect())) == whole
