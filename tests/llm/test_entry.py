import importlib.util

import pytest

import __spark_entry__ as E
import corpus_pipeline


def test_all_corpus_queries_are_registered():
    names = [n for n in E.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert E.queries()["pipeline"] is corpus_pipeline.run
    assert {"op1_preference_format", "op13_line_dedup"} <= set(E.oracle_sql())


def test_nothing_else_in_the_library_needs_them(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name == "corpus_pipeline" else real(name, *a))
    spec = real("__spark_entry__")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert not [n for n in module.queries() if n.startswith("op") or n == "pipeline"] and len(module.queries()) > 40


@pytest.mark.parametrize("name", ["op2_dimension_scan", "op6_bpe_tree", "op10_best_fit_packing"])
def test_queries_return_their_columns(spark, name):
    want = {"op2_dimension_scan": ["query_id", "rank", "vec_id", "score"], "op6_bpe_tree": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            "op10_best_fit_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]}
    df = E.queries()[name](spark, "/root/testdata/sf0.001")
    assert df.columns == want[name] and df.count() > 0
