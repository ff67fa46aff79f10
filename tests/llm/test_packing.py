import random
import struct
import zlib

from pyspark.sql import functions as F

from benchlens.llm.packing import OpenBins, best_fit, pack_documents, token_pieces
from benchlens.llm.words import WordCodec


def check_places(rows, capacity):
    at = {}
    for r in sorted((r for r in rows if r.sequence_id is not None), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    return at


def test_tightest_open_bin_is_chosen():
    rng = random.Random(1)
    bins, free, n_open = OpenBins(100, 5, 0), {}, 0
    for _ in range(3000):
        length = rng.randint(1, 100)
        fits = [(room, s) for s, room in free.items() if room >= length]
        seq, offset = bins.place(length)
        if fits:
            assert 100 - offset == min(fits)[0] and free[seq] == 100 - offset
        else:
            assert offset == 0 and seq not in free
            if len(free) == 5:  # the fullest has made room
                least = min(free.values())
                del free[next(s for s, room in free.items() if room == least and s not in {x for v in bins.by_free.values() for x in v})]
            free[seq] = 100
        free[seq] -= length
        if not free[seq]:
            del free[seq]
        assert len(free) <= 5 and bins.n_open == len(free)
        assert sorted(free.values()) == sorted(room for room, own in bins.by_free.items() for _ in own)
        assert bins.bits == sum(1 << room for room in bins.by_free)


def test_pieces_hold_the_librarys_ids(spark):
    codec = WordCodec()
    texts = [(1, "some words, " * 900), (2, None), (None, ""), (3, "x"), (3, "x")]
    df = spark.createDataFrame([(*t, 5) for t in texts], "doc_id long, text string, piece int")
    got = sorted((str(r.doc_id), r.piece, r.start, r.length, bytes(r.ids)) for r in token_pieces(df, capacity=64).collect())
    want = []
    for d, t in texts:
        ids = codec.tok.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(str(d), k, 64 * k, len(ids[64 * k:64 * k + 64]), struct.pack(f"<{len(ids[64 * k:64 * k + 64])}I", *ids[64 * k:64 * k + 64]))
                 for k in range(-(-len(ids) // 64))]
    assert got == sorted(want)
    assert token_pieces(df.limit(0)).count() == 0


def test_packing_is_gapless_and_tight(spark):
    rows = [(i, random.Random(i).randint(1, 100)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k long, length long").withColumn("offset", F.lit("clash"))
    got = best_fit(df, capacity=100, open_bins=64, per_group=3000)
    assert got.columns == ["k", "length", "sequence_id", "offset"]
    out = got.collect()
    assert sorted((r.k, r.length) for r in out) == rows
    at = check_places(out, 100)
    assert max(at.values()) <= 100 and len(at) <= 1.08 * sum(n for _, n in rows) / 100
    again = {r.k: (r.sequence_id, r.offset) for r in best_fit(df, capacity=100, open_bins=64, per_group=3000).collect()}
    assert again == {r.k: (r.sequence_id, r.offset) for r in out}


def test_odd_lengths(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, -4), (4, 250), (5, 100), (6, 40), (6, 40)], "k long, length long")
    out = best_fit(df, capacity=100).collect()
    assert {r.k: r.sequence_id is None for r in out} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
    at = check_places(out, 100)
    assert sorted(at.values()) == [80, 100, 250]
    assert best_fit(df.limit(0)).count() == 0


def test_query_round_trip(spark):
    from benchlens.llm.queries import QUERIES
    sf, codec = "/root/testdata/sf0.001", WordCodec()
    rows = QUERIES["op10_best_fit_packing"](spark, sf).collect()
    ids = {r.doc_id: codec.tok.encode(r.text, add_special_tokens=False).ids + [0] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = {}
    for r in rows:
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert r.start == 2048 * r.piece and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {d: len(x) for d, x in ids.items()}
    at = check_places(rows, 2048)
    assert max(at.values()) <= 2048 and len(at) <= 1.05 * sum(at.values()) / 2048 + 2
    assert pack_documents(spark.read.parquet(f"{sf}/documents.parquet").limit(0)).count() == 0
