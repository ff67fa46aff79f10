import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from benchlens.llm import queries
from benchlens.llm.spelling import _symbol, chain_ends, near_words, neighbourhoods, reduced, variants, word_counts

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(w):
    """Wild-card forms: two words share one exactly if they are at most one edit apart."""
    return {(len(w), i, w[:i] + w[i + 1:]) for i in range(len(w))} | {(len(w) + 1, i, w[:i] + w[i:]) for i in range(len(w) + 1)}


def brute(counts, least_length=5, least_n=3, times=2):
    words = {w: n for w, n in counts.items() if n >= least_n and len(w) >= least_length}
    shared = {}
    for w in words:
        for form in one_edit(w):
            shared.setdefault(form, []).append(w)
    near = {w: set() for w in words}
    for group in shared.values():
        for w in group:
            near[w].update(group)
    form = {}
    for w, n in words.items():
        near[w].discard(w)
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= times * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def same(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_neighbourhoods_hold_every_edit_of_a_reduced_word():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9):
        cells = rng.integers(1, 4, (20, n)).astype(np.uint64)
        keys = neighbourhoods(cells, 3)
        for row, got in zip(cells.tolist(), keys):
            edits = [row] + [row[:i] + row[i + 1:] for i in range(n)] + [row[:i] + [s] + row[i + 1:] for i in range(n) for s in (1, 2, 3)]
            edits += [row[:i] + [s] + row[i:] for i in range(n + 1) for s in (1, 2, 3)]
            assert {int(reduced(np.array([e], np.uint64).reshape(1, -1))[0]) for e in edits} == set(got.tolist())


def test_random_words_equal_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(4, 9))) for _ in range(300)]
    counts = {}
    for w in base:
        counts[w] = rng.randint(1, 400)
        for _ in range(4):
            i = rng.randrange(len(w))
            v = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abcéx") + w[i:], w[:i] + rng.choice("abÿ") + w[i + 1:]])
            counts.setdefault(v, rng.randint(1, 60))
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = brute(counts)
    assert len(want) > 700 and sum(r[1] != r[2] and r[1] is not None for r in want) > 5  # chains too
    for symbols in (1, 3, 8):
        assert same(variants(df, symbols=symbols)) == want


def test_edges(spark):
    rows = [("aaaaa", 10), ("aaaaaa", 5), ("aaaaab", 5), ("aaaa", 50), ("aaaac", 2), (None, 9), ("zzzzz", None), ("y" * 3000, 3), ("y" * 3001, 9),
            ("𐐷𐐷𐐷𐐷𐐷", 3), ("𐐷𐐷𐐷𐐷a", 6)]
    df = spark.createDataFrame([(w, n, 0) for w, n in rows], "word string, n long, id int")
    got = {r.word: r for r in variants(df).collect()}
    assert set(got) == {"aaaaa", "aaaaaa", "aaaaab", "y" * 3000, "y" * 3001, "𐐷𐐷𐐷𐐷𐐷", "𐐷𐐷𐐷𐐷a"}
    assert got["aaaaaa"].form == got["aaaaab"].form == "aaaaa" and got["aaaaa"].form is None and got["aaaaa"].n_near == 2
    assert got["y" * 3000].form == "y" * 3001 and got["𐐷𐐷𐐷𐐷𐐷"].root == "𐐷𐐷𐐷𐐷a"
    assert variants(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        variants(df, times=1)


def test_ties_take_the_least_word(spark):
    df = spark.createDataFrame([("bbbbb", 8), ("ababb", 8), ("abbbb", 3)], "word string, n long")
    got = {r.word: (r.form, r.n_near) for r in variants(df).collect()}
    assert got == {"abbbb": ("ababb", 2), "ababb": (None, 1), "bbbbb": (None, 1)}


def test_a_pair_is_returned_once_in_each_direction(spark):
    df = spark.createDataFrame([(1, "aaaaa", 3), (2, "aaaaaa", 4), (3, "aaaab", 5)], "id long, word string, n long")
    got = [(r.word, r.near) for r in near_words(df, 2).collect()]
    assert sorted(got) == [("aaaaa", "aaaaaa"), ("aaaaa", "aaaab"), ("aaaaaa", "aaaaa"), ("aaaab", "aaaaa")]


def test_chains_end_at_their_root(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [(f"x{i}", "w5") for i in range(50)]
    got = dict((r.word, r.root) for r in chain_ends(spark.createDataFrame(links, "word string, form string")).collect())
    assert got == {w: "w37" for w, _ in links}
    assert chain_ends(spark.createDataFrame([], "word string, form string")).count() == 0


def test_counting(spark):
    texts = [(1, "Straße straße ÀB àb ÷x×"), (None, "a1b2 É"), (2, None), (3, ""), (4, "word " * 30_000), (4, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, n int")
    want = Counter(w.translate(A_TO_Z) for _, t in texts for w in LETTERS.findall(t or ""))
    assert {r.word: r.n for r in word_counts(df, "doc_id", "text").collect()} == want
    assert word_counts(df.limit(0), "doc_id", "text").count() == 0


def dropped(doc_id, w):
    h = zlib.crc32(f"{doc_id}:{w}".encode())
    return w if h % 97 else w[:h % len(w)] + w[h % len(w) + 1:]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_brute_force(spark, sf):
    counts = Counter()
    for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect():
        counts.update(dropped(r.doc_id, w.translate(A_TO_Z)) for w in LETTERS.findall(r.text or ""))
    got = same(queries.op11_spelling_variants(spark, f"/root/testdata/{sf}"))
    assert got == brute(counts) and sum(r[1] is not None for r in got) > 20


def test_symbols_are_few_and_fixed():
    assert {_symbol(p, 8) for p in range(0xc0, 0x100)} == set(range(1, 9))
