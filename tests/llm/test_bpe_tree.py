import hashlib
import random
import struct

import pytest

from benchlens.llm.bpe_tree import HalfCoder, cut_leaves, encode, encode_leaves, halves, leaves_of
from benchlens.llm.words import DEFAULT_FILE, WordCodec


@pytest.fixture(scope="module")
def codec():
    return WordCodec()


def library(codec, text):
    ids = codec.tok.encode(text or "", add_special_tokens=False).ids
    return ids, codec.tok.decode(ids, skip_special_tokens=False)


def test_halves_are_short_and_whole():
    for n in (0, 1, 7, 8, 9, 1000):
        ends = halves(n, 8)
        assert ends[-1] == n and all(0 <= hi - lo <= 8 for lo, hi in zip([0, *ends], ends))


def tree(coder, codec, text, leaf):
    """The whole method in one place (what the Spark job does over rows)."""
    return coder.join_all(encode_leaves(codec, coder, leaves_of(codec, codec.pieces(text), leaf)))


def test_tree_equals_the_library(codec):
    coder, rng = HalfCoder(DEFAULT_FILE), random.Random(3)
    alphabets = ["ab", "etaoinshr", "abcdefghijklmnopqrstuvwxyz ", "aé ", "!?.", "!$#%&*w</>", "日本 ", "e\u0301a 日", "it's re've ",
                 ["<|endoftext|>", "<|startoftext|>", "a", " ", "<|", "|>"], "Aa\n\t İΣß½²1"]
    for _ in range(3000):
        letters = rng.choice(alphabets)
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 200)))
        assert tree(coder, codec, text, rng.choice([1, 2, 3, 8, 32])) == library(codec, text)[0], text


def test_leaves_cut_inside_words(codec):
    cut = leaves_of(codec, codec.pieces("incomprehensible"), 4)
    assert [(h, t) for h, t, _ in cut] == [(False, True), (True, True), (True, True), (True, False)]
    assert ["".join(k) for _, _, k in cut] == ["inco", "mpre", "hens", "ible"]


def test_word_cache_equals_the_library(codec):
    rng = random.Random(1)
    odd = ["", "Hello<|endoftext|>x <|startoftext|>", "á étÉ ΣΑΣ İx ﬁ ½²³ don't WE'LL 'sx''re\x1c\x85y\xa0z", "naïve œuvre日本語 한국어 x​y", "A<|endoftext|"]
    letters = "aA'sr e\n\té́œ日½1²!<|>\x1c\x85 İΣß"
    odd += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    small = WordCodec(max_pieces=50, cache_chars=4)  # a cache that overflows all the time
    for at in range(0, len(odd), 100):
        for text, (ids, shown) in zip(odd[at:at + 100], small.encode(odd[at:at + 100], decode=True)):
            want = library(codec, text)
            assert (list(struct.unpack(f"<{len(ids) // 4}I", ids)), shown) == want, text


TEXTS = [(0, "hello World. " + "ab" * 3000 + " é日 " + "x!" * 500 + " tail"), (1, None), (2, ""), (None, "Foo bar"),
         (4, "".join(random.Random(2).choice("etaoin") for _ in range(5000))), (4, "日" * 2000), (4, "日" * 2000), (5, " \n\t ")]


@pytest.mark.parametrize("deal", [0, 100, 10 ** 6])
def test_long_pieces_and_edges_over_spark(spark, codec, deal):
    df = spark.createDataFrame([(*t, "x") for t in TEXTS], "doc_id long, text string, ids string")
    got = sorted((str(r.doc_id), list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)), r.decoded) for r in encode(df, leaf=64, deal=deal).collect())
    assert got == sorted((str(d), *library(codec, t)) for d, t in TEXTS)
    assert encode(df.limit(0)).count() == 0


def test_texts_of_the_table_have_many_leaves(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS _id", "text AS _text")
    leaves = cut_leaves(docs, DEFAULT_FILE, 512)
    rows = leaves.groupBy("_row").count().collect()
    assert len(rows) == docs.count() and sum(r["count"] > 1 for r in rows) > len(rows) * 0.8
    # a leaf's keys are parted by one space each; Latin-1 letters take two symbols at most
    assert leaves.where("length(replace(keys, ' ', '')) > 1024").isEmpty()
    assert not leaves.where("tail").isEmpty()  # seams inside words occur


def test_query_matches_the_library(spark, codec):
    from benchlens.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op6_bpe_tree"](spark, sf).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids, shown = library(codec, r.text)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want[r.doc_id] = (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(shown.encode()).hexdigest())
    assert got == want
