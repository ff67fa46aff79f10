import struct
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from benchlens.llm import secret_scan
from benchlens.llm.words import WordCodec

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's rows, written and read back like run() does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_of_documents_stay(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes
    assert [n for n, _ in P.STAGES][2] == "simhash_near_dedup" and len(P.STAGES) == 5


def test_quality_rejects_low_labels_and_keeps_high_ones(stages, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in stages[1].collect()}
    marked = {r.doc_id: r.quality for r in labels.collect()}
    low, high = ([d for d, q in marked.items() if q == v] for v in (0, 1))
    assert sum(d in kept for d in low) <= 0.05 * len(low) and sum(d in kept for d in high) >= 0.99 * len(high)


def test_language_keeps_texts_with_letters(stages):
    assert stages[2].count() >= 0.99 * stages[1].count()


def test_dedup_matches_brute_force(stages):
    from test_simhash import plain_fingerprint, roots
    fp = {r.doc_id: plain_fingerprint(r.text) for r in stages[2].collect()}
    group = roots(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    assert {r.doc_id for r in stages[3].collect()} == set(group.values())


def test_redaction_changes_only_texts_with_secrets(stages):
    before = {r.doc_id: r for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    assert set(before) == set(after)
    changed = [d for d in before if before[d] != after[d]]
    assert changed and all("[SECRET]" in after[d].text and len(after[d].text) == after[d].n_chars for d in changed)
    assert not any("AKIA" in r.text or 'token = "' in r.text and "[SECRET]" not in r.text for r in after.values())
    assert len(changed) < 0.1 * len(before)


def test_packing_holds_every_text(stages):
    codec = WordCodec()
    want = {}
    for r in stages[4].collect():
        ids = codec.tok.encode(r.text, add_special_tokens=False).ids + [0]
        want[r.doc_id] = [(k, k * 2048, len(ids[k * 2048:(k + 1) * 2048]), zlib.crc32(b"".join(struct.pack("<I", i) for i in ids[k * 2048:(k + 1) * 2048])))
                          for k in range(-(-len(ids) // 2048))]
    got = {}
    rows = stages[5].collect()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert got == want
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 2048 and len(at) <= 1.05 * sum(at.values()) / 2048 + 3


def test_nulls_and_empty_tables_pass_every_stage(spark, stages):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", None, "s", 0), (2, "", None, "s", 0),
                                 (3, "123", "en", None, 3)], stages[0].schema)
    clash = {c: F.lit("x") for c in ("score", "lang_pred", "label", "fingerprint", "row", "doc", "sequence_id", "value")}
    for df in (stages[0].limit(30).unionByName(odd).withColumns(clash), stages[0].limit(0), odd):
        for _, stage in P.STAGES:
            df = stage(spark, df, SF)
            df.count()
    assert secret_scan.redact(odd, secret_scan.Forest([0.0])).count() == 5
