"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.llm import (backoff_lm, bpe_tree, dimension_scan, language, line_dedup, merkle, packing, periodic_runs, preference,
                           quality, secret_scan, simhash, spelling)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _id_share(parts: int) -> Column:
    """Remainder of the id's checksum; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


def op1_preference_format(spark: SparkSession, sf: str) -> DataFrame:
    turns = _table(spark, sf, "conversations")
    return preference.format_pairs(turns, preference.pairs_by_opening(turns))


def op2_dimension_scan(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings")
    return dimension_scan.search(vectors, vectors.where("vec_id % 100 = 0"))


QUALITY_AT = 0.3  # least score of label 1


def op3_subword_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    model = quality.fit(docs, labels.where(_id_share(5) != 0))
    got = quality.predict(docs, model, ["doc_id"])
    return got.select("doc_id", (_id_share(5) == 0).alias("held_out"), "score",
                      (F.col("score") >= QUALITY_AT).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    got = simhash.near_duplicates(_table(spark, sf, "documents"))
    return got.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op5_hierarchical_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    got = language.predict(docs, language.fit(docs, _id_share(4) != 2), ["doc_id"])
    return got.select("doc_id", (_id_share(4) == 2).alias("held_out"), "lang_pred", "score")


def op6_bpe_tree(spark: SparkSession, sf: str) -> DataFrame:
    got = bpe_tree.encode(_table(spark, sf, "documents"))
    return got.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op7_merkle_tree(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.compare_with_edited(_table(spark, sf, "documents"))


def op8_secret_forest(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in the texts; the path is the source, labels come from the candidates' own shapes."""
    docs = _table(spark, sf, "documents")
    forest = secret_scan.train(secret_scan.own_labels(secret_scan.candidates(docs, "text", "source")))
    got = secret_scan.scan(docs, forest, ["doc_id"], "text", "source").where("is_secret")
    return got.select("doc_id", "start", F.length("value").cast("long").alias("length"),
                      F.sha2("value", 256).alias("value_sha256"), "score")


def op9_backoff_lm(spark: SparkSession, sf: str) -> DataFrame:
    got = backoff_lm.score(_table(spark, sf, "documents"), _id_share(5) != 1)
    return got.select("doc_id", (~F.col("train_on")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                      "base_score", "score")


def op10_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents"))


def drop_one_letter(doc_id: int | None, word: str) -> str:
    """The word without one letter, where 97 divides the checksum of `id:word`."""
    h = zlib.crc32(word.encode(), zlib.crc32(("" if doc_id is None else str(doc_id)).encode() + b":"))
    if h % 97:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    counts = spelling.word_counts(_table(spark, sf, "documents"), "doc_id", "text", drop_one_letter)
    return spelling.variants(counts, least_length=5, least_n=3, times=2)


def repeat_the_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """In a tenth of the documents (by the id's checksum) the words from some place on repeat a part of themselves."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return periodic_runs.detect(_table(spark, sf, "documents"), prepare=repeat_the_tail)


def op13_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    bitmaps = line_dedup.keep_bitmaps(docs, at_least=10, keep_first=False)
    return line_dedup.with_kept_text(docs, bitmaps).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op1_preference_format": op1_preference_format, "op2_dimension_scan": op2_dimension_scan,
           "op3_subword_quality": op3_subword_quality, "op4_simhash": op4_simhash,
           "op5_hierarchical_language": op5_hierarchical_language, "op6_bpe_tree": op6_bpe_tree, "op7_merkle_tree": op7_merkle_tree, "op8_secret_forest": op8_secret_forest,
           "op9_backoff_lm": op9_backoff_lm,
           "op10_best_fit_packing": op10_best_fit_packing, "op11_spelling_variants": op11_spelling_variants,
           "op12_periodic_runs": op12_periodic_runs, "op13_line_dedup": op13_line_dedup}
def _rendered(turns: str) -> str:
    return f"""array_to_string(list_transform({turns}, lambda t: '<|' || coalesce(t.role, '') || '|>' || chr(10)
        || coalesce(t.text, '') || '<|end|>' || chr(10)), '')"""


def _masked(turns: str) -> str:
    return f"""array_to_string(list_transform({turns}, lambda t: (5 + length(coalesce(t.role, '')))::VARCHAR || ':0,'
        || (8 + length(coalesce(t.text, '')))::VARCHAR
        || CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END), ',')"""


SQL: dict[str, str] = {
    "op1_preference_format": f"""
WITH convs AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
ranked AS (
  SELECT conv_id, turns, turns[1] AS opening, row_number() OVER (PARTITION BY turns[1] ORDER BY conv_id) - 1 AS i FROM convs),
pairs AS (
  SELECT a.conv_id AS pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.turns AS a, coalesce(b.turns, []) AS b
  FROM ranked a LEFT JOIN ranked b ON b.opening = a.opening AND b.i = a.i + 1 WHERE a.i % 2 = 0),
cut AS (
  SELECT *, coalesce(list_position(list_transform(range(1, 1 + least(len(a), len(b))), lambda k: a[k] IS NOT DISTINCT FROM b[k]), false) - 1,
                     least(len(a), len(b)))::INT AS prompt_turns FROM pairs)
SELECT pair_id, chosen_id, rejected_id, prompt_turns, {_rendered("a[1:prompt_turns]")} AS prompt,
       {_rendered("a[prompt_turns + 1:]")} AS chosen, {_rendered("b[prompt_turns + 1:]")} AS rejected,
       {_masked("a[prompt_turns + 1:]")} AS chosen_mask, {_masked("b[prompt_turns + 1:]")} AS rejected_mask
FROM cut""",
    "op13_line_dedup": """
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
cut AS (SELECT doc_id, r, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM cut),
often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) >= 10),
marked AS (SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r""",
}
