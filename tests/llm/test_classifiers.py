import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from benchlens.llm import language, quality
from benchlens.llm.subwords import AverageScorer, Features, collect_vectors

SF = "/root/testdata/sf0.01"


def test_scorer_equals_plain_average():
    rng = np.random.default_rng(0)
    feats = Features(bits=10, spans=(2, 3))
    table = rng.normal(size=(1 << 10, 3))
    texts = [["ab", "é日x", "ab"], [], ["z"], ["long" * 9, "ab"]]
    extra = [{feats.special("end"): 1.0, feats.special("same"): float(i)} for i in range(4)]
    want = [feats.of_text(t, e) for t, e in zip(texts, extra)]
    got = AverageScorer(feats, table, max_words=3).average(texts, extra)
    for row, (bucket, weight) in zip(got, want):
        assert row == pytest.approx(weight @ table[bucket], abs=1e-5)
        assert weight.sum() == pytest.approx(1.0, abs=1e-5)


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    feats = Features(bits=12)
    words = ["a", "abcdef", "é", "日本語", "xyz"]
    at, bucket = feats.of_words(words)
    for i, w in enumerate(words):
        alone = feats.of_words([w])[1]
        assert sorted(bucket[at == i]) == sorted(alone)
        n = len(w) + 2
        assert len(alone) == 1 + sum(max(0, n - s + 1) for s in feats.spans)


DOCS = [(i, "good plain words here " * (i % 3 + 1), "en", "x") for i in range(30)] + [
    (i, "SPAM!! SPAM!! SPAM!!", "de", "x") for i in range(30, 60)] + [(60, None, None, "x"), (61, "", "fr", "x"), (None, "good plain", "en", "x"), (3, "good plain", "en", "x"),
                                                                      (62, "123 !?", "en", "x"), (63, "plain words " * 3000, "en", "x")]
COLS = "doc_id long, text string, lang string, score string"


def test_quality_edges(spark):
    docs = spark.createDataFrame(DOCS, COLS)
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)] + [(None, 1, 0), (1, None, 0), (2, 7, 0), (99, 0, 0)],
                                   "doc_id long, quality int, toxic int")
    got = quality.predict(docs, quality.fit(docs, labels), ["doc_id"]).collect()
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[0] > 0.5 > by[45] and by[63] > 0.5
    assert quality.predict(docs.limit(0), quality.fit(docs, labels), ["doc_id"]).count() == 0
    assert quality.fit(docs, labels.limit(0)) == 0.5 and quality.fit(docs, labels.where("quality = 1")) == 1.0
    assert quality.fit(docs.limit(0), labels) == pytest.approx(32 / 64, abs=0.05)
    assert {r.score for r in quality.predict(docs, 0.5, ["doc_id"]).collect()} == {0.5}


def test_quality_on_held_out_rows(spark):
    from benchlens.llm.queries import QUERIES
    got = QUERIES["op3_subword_quality"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    hits = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert hits > 0.95


def test_language_edges(spark):
    docs = spark.createDataFrame(DOCS, COLS).withColumn("lang_pred", F.lit("clash"))
    model = language.fit(docs, F.lit(True))
    rows = language.predict(docs, model, ["doc_id"]).collect()
    assert len(rows) == len(DOCS) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.lang_pred for r in rows}
    assert by[0] == "en" and by[45] == "de" and by[60] == by[61] == by[62] == "und" and by[63] == "en"
    assert language.fit(docs.limit(0), F.lit(True)) is None
    assert {r.lang_pred for r in language.predict(docs, None, ["doc_id"]).collect()} == {"und"}
    assert language.predict(docs.limit(0), model, ["doc_id"]).count() == 0


def test_language_hierarchy_by_hand():
    rng = random.Random(2)
    alphabets = {"en": "theandof", "de": "schungei", "fr": "eauxleée", "xx": "日本語中文"}
    texts, langs = [], []
    for lang, letters in alphabets.items():
        for _ in range(40):
            texts.append(" ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(30)))
            langs.append(lang)
    features = language.own_features()
    model = language.train([language._vector(features, t) for t in texts], langs, features)
    assert model.families == ["germanic", "romance", "xx"] and set(model.duels) == {("de", "en")}
    scorer = AverageScorer(model.features, model.table)
    got = model.decide(scorer.average([language._cut(t) for t in texts], [language._extra(model.features)] * len(texts)))
    assert np.mean([g[0] == x for g, x in zip(got, langs)]) > 0.98


def test_language_on_held_out_rows(spark):
    from benchlens.llm.queries import QUERIES
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op5_hierarchical_language"](spark, SF)
    assert got.count() == docs.count()
    assert got.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95


def test_copies_do_not_displace_the_fitted_texts(spark, monkeypatch):
    """40 different texts and one with 20,000 copies: all 41 are fitted, each once."""
    texts = [f"text number {i}" for i in range(40)]
    docs = spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").union(
        spark.range(20_000).select(F.lit("copied text").alias("text"), F.lit("en").alias("lang")))
    fitted = []
    monkeypatch.setattr(language, "train", lambda docs, langs, features: fitted.append(sorted(str(v) for v in docs)))
    language.fit(docs, F.lit(True), per_language=41)
    features = language.own_features()
    assert fitted == [sorted(str(language._vector(features, t)) for t in [*texts, "copied text"])]


def test_fitted_vectors_lie_in_a_file(spark):
    """What a sample's texts are made into is mapped from a file: the driver's memory does not grow with them."""
    texts = [" ".join(f"word{i}x{j}" for j in range(5000)) for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "_hash long, _text string")
    features = Features()
    keys, got = collect_vectors(rows, features, quality._vector)
    assert keys["_hash"].to_pylist() == list(range(60)) and len(got) == 60
    size = 0
    for text, (bucket, weight) in zip(texts, got):
        assert bucket.base is not None and weight.base is not None and not bucket.flags.owndata and not weight.flags.writeable
        want = quality._vector(features, text)
        assert np.array_equal(bucket, want[0]) and np.array_equal(weight, want[1])
        size += bucket.nbytes + weight.nbytes
    del text, bucket, weight, want
    tracemalloc.start()
    _, again = collect_vectors(rows, features, quality._vector)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(again) == 60 and held < size / 4
    with pytest.raises(IndexError):
        got[60]
    assert list(collect_vectors(rows.limit(0), features, quality._vector)[1]) == []


def test_long_texts_are_fitted_whole(spark, monkeypatch):
    """A long text of few words travels as its vector; both models learn from what stands at its very end."""
    rows = [(i, "good plain words " * 4000 + (f"end{i} " if i % 2 else f"fin{i} "), i % 2) for i in range(8)]
    docs = spark.createDataFrame([(i, t, "en" if q else "de") for i, t, q in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] * 3, "doc_id long, quality int")
    for module, features, run in ((quality, Features(), lambda: quality.fit(docs, labels)),
                                  (language, language.own_features(), lambda: language.fit(docs, F.lit(True)))):
        fitted = []
        monkeypatch.setattr(module, "train", lambda docs, *rest: fitted.extend((b.tolist(), w.tolist()) for b, w in docs))
        run()
        want = [module._vector(features, t) for _, t, _ in rows]
        assert sorted(fitted) == sorted((b.tolist(), w.tolist()) for b, w in want)


def test_sample_is_drawn_among_texts_that_exist(spark):
    """Most labelled ids have no text; an id with both labels and repeated label rows change nothing."""
    docs = spark.createDataFrame([(i, f"good words {i}" if i % 2 else f"bad stuff {i}") for i in range(40)] + [(90, "bad stuff of both")],
                                 "doc_id long, text string")
    labels = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    labels = labels.union(labels.where("doc_id < 2")).union(spark.createDataFrame([(90, 1)], "doc_id long, quality int"))
    model = quality.fit(docs, labels, per_label=20)
    by = {r.doc_id: r.score for r in quality.predict(docs, model, ["doc_id"]).collect()}
    assert all((by[i] > 0.5) == bool(i % 2) for i in range(40)) and by[90] < 0.5
