import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchlens.llm import backoff_lm
from benchlens.llm.backoff_lm import PAIR_PRIOR, WORD_PRIOR, Automaton, Block, packed, score, unpacked, words_of

TEXTS = [(0, "The cat sat on the mat"), (1, "the cat  ate the\trat on THE mat"), (2, "a dog sat on the mat"),
         (3, "the cat sat on a dog"), (4, None), (5, ""), (6, "the cat sat on the mat zebra"), (None, "the cat É"),
         (6, "the cat sat on the mat zebra"), (7, "zebra zebra the"), (8, "x " * 3000 + "y")]
END, START = "end", "start"


class Plain:
    """The model by definition: smoothed probabilities from dictionaries of counts, shorter contexts recursively."""

    def __init__(self, texts, train):
        self.toks = [[*words_of((t or "").encode()), END] for _, t in texts]
        self.c, self.ctx = Counter(), Counter()
        for toks, use in zip(self.toks, train):
            full = [START, *toks]
            for i in range(1, len(full)) if use else []:
                for n in (0, 1, 2):
                    if i - n >= 0:
                        h = tuple(full[i - n:i])
                        self.c[(*h, full[i])] += 1
                        self.ctx[h] += 1
        self.words = {k[0] for k in self.c if len(k) == 1}
        self.n, self.v = self.ctx[()], len(self.words)

    def prob(self, h, w):
        if not h:
            return (self.c[(w,)] + 0.5) / (self.n + 0.5 * (self.v + 1))
        prior = WORD_PRIOR if len(h) == 1 else PAIR_PRIOR
        return (self.c[(*h, w)] + prior * self.prob(h[1:], w)) / (self.ctx[h] + prior)

    def text(self, i):
        full = [START, *self.toks[i]]
        return sum(math.log10(self.prob(tuple(full[max(0, k - 2):k]), full[k])) for k in range(1, len(full)))

    def base(self, i):
        return sum(math.log10(self.prob((), w)) for w in self.toks[i])


def compare(spark, texts, train):
    df = spark.createDataFrame([(d, t, u, "x") for (d, t), u in zip(texts, train)], "doc_id long, text string, use boolean, score string")
    plain = Plain(texts, train)
    got = sorted(map(tuple, score(df, F.col("use")).collect()), key=lambda r: (str(r[0]), r[1], r[2], r[6]))
    want = sorted(((d, bool(u), len(plain.toks[i]), sum(w in plain.words for w in plain.toks[i]), plain.n, plain.base(i), plain.text(i))
                   for i, ((d, _), u) in enumerate(zip(texts, train))), key=lambda r: (str(r[0]), r[1], r[2], r[6]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [x for g in got for x in g[5:]] == pytest.approx([x for w in want for x in w[5:]])


def test_scores_equal_recursive_smoothing(spark):
    compare(spark, TEXTS, [bool(i and i % 3) for i in range(len(TEXTS))])
    compare(spark, TEXTS, [True] * len(TEXTS))
    compare(spark, TEXTS, [i == 4 for i in range(len(TEXTS))])  # an empty text only


@pytest.mark.parametrize("tokens,parts", [(1, 1), (20, 7), (500_000, 100)])
def test_blocks_and_parts_do_not_change_a_score(spark, monkeypatch, tokens, parts):
    monkeypatch.setattr(backoff_lm, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(backoff_lm, "PART_BYTES", parts)
    rng = random.Random(7)
    texts = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))) for i in range(60)]
    compare(spark, texts, [i % 4 != 1 for i in range(60)])


def test_every_state_sums_to_one():
    """Over all words and the unseen class, from the root, a word's state and a pair's state."""
    plain = Plain(TEXTS, [True] * len(TEXTS))
    every = [*plain.words, "never seen"]
    for h in [(), (START,), (b"the",), (b"the", b"cat"), (START, b"the"), (b"on", b"zebra"), ("never seen",)]:
        assert sum(plain.prob(h, w) for w in every) == pytest.approx(1.0)


def test_walk_takes_failure_arcs():
    words, tokens = [b"", b"a", b"b"], np.array([1, 2, 1, 2, 2, 0], np.uint32)  # a b a b b end
    block = Block(words, tokens, np.array([6]))
    c1 = np.zeros(3)
    c1[block.word] = [5, 4, 5, 4, 4, 2]
    c2 = np.zeros(block.pair_keys.size)
    c2[block.pair] = [2, 3, 1, 3, 0, 1]  # the pair b b does not occur
    c3 = np.zeros(block.triples.size)
    c3[block.triple] = [2, 2, 1, 1, 0, 0]
    model = Automaton(block, c1, c2, c3, 11.0, 3.0, 2.0)
    a0, a1, a2 = model.arcs
    f1, f2 = model.fails
    want = a1[0] + a2[1] + a2[2] + a2[3] + (f2[4] + f1[4] + a0[4]) + a1[5]
    assert model.walk(0) == pytest.approx(want)


def test_arrays_survive_packing():
    for kind in (np.uint32, np.uint64):
        for a in (np.zeros(0, kind), np.array([0, 1, 2 ** 31, 7], kind), np.arange(1000).astype(kind)):
            assert (unpacked(packed(a), kind) == a).all()


def test_empty_table_and_no_training_rows(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    assert score(df.limit(0), F.lit(True)).count() == 0
    rows = score(df, F.lit(None).cast("boolean")).collect()
    assert len(rows) == len(TEXTS) and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 and not r.train_on for r in rows)


def test_blocks_are_shuffled_once(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    out = score(df, F.lit(True))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 2 and "ReusedExchange" in plan


def test_text_ids(spark):
    df = spark.createDataFrame([(str(d), t) for d, t in TEXTS], "name string, body string")
    assert {r.name for r in score(df, F.lit(True), "name", "body").collect()} == {str(d) for d, _ in TEXTS}


def test_query_on_the_tables(spark):
    """Counts and base scores by definition; on held-out texts the model beats the half counts."""
    from benchlens.llm.queries import QUERIES
    import zlib
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    plain = Plain(rows, [zlib.crc32(str(d).encode()) % 5 != 1 for d, _ in rows])
    at = {d: i for i, (d, _) in enumerate(rows)}
    got = QUERIES["op9_backoff_lm"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        i = at[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(plain.toks[i]), sum(w in plain.words for w in plain.toks[i]), plain.n)
        assert (r.base_score, r.score) == pytest.approx((plain.base(i), plain.text(i)))
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
