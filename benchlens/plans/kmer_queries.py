"""Acceptance queries: k-mer frequencies over ``documents``; OLS fits over lineitem x part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.operators import kmer as K
from benchlens.operators import stats as S
from benchlens.operators.joins import dim_join
from benchlens.plans.fixtures import table

# Probe list (three present words, one absent 12-mer, one absent 18-mer).
PROBES = ["THE", "ANDT", "INGTHE", "QZXJKQZXJKQZ", "ZQXJWKZQXJWKZQXJWK"]
LONG_K = 18
CHUNK = 60  # characters of a chunk; shorter ones below


def _sequences(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    return d.select("doc_id", "lang", K.sequence_text("text").alias("seq"))


def kmer_freq(spark: SparkSession, sf: str) -> DataFrame:
    f = K.kmer_freq(_sequences(spark, sf), "seq", 2, by=["lang"])
    return f.select("lang", "kmer", "n", F.round("pct", 6).alias("pct"))


def kmer_topk(spark: SparkSession, sf: str) -> DataFrame:
    f = K.kmer_freq(_sequences(spark, sf), "seq", 2, by=["lang"])
    t = K.top_kmers(f, 10, by=["lang"])
    return t.select("lang", "kmer", "n", F.round("pct", 6).alias("pct"), "rank")


def kmer_specific(spark: SparkSession, sf: str) -> DataFrame:
    return K.probe_lines(K.probe_counts(_sequences(spark, sf), "seq", PROBES))


def kmer_report(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes 1 and 2 (one counting pass, ranked per size) and the probe lines, as one list."""
    seq = _sequences(spark, sf)
    freq = K.with_share(K.kmer_counts_multi(seq, "seq", [1, 2]), by=["k"])
    lines = K.freq_lines(freq, by=["k"]).select(
        F.concat(F.lit("k"), F.col("k").cast("string")).alias("section"), "pos", "line")
    pc = K.probe_lines(K.probe_counts(seq, "seq", PROBES))
    order = F.array_position(F.array(*[F.lit(p) for p in PROBES]), F.col("probe")).cast("int")
    return lines.unionByName(pc.select(F.lit("probe").alias("section"), order.alias("pos"), "line"))


def kmer_halo(spark: SparkSession, sf: str) -> DataFrame:
    """k=3 counts per language from chunks, every fifth cut into single characters; equal to the unchunked counts."""
    chunks = K.chunk_text(_sequences(spark, sf), "doc_id", "seq", CHUNK)
    size = F.when(F.col("chunk_pos") % 5 == 0, "(?s).").otherwise("(?s).{1,%d}" % CHUNK)
    short = chunks.select("doc_id", "lang", "chunk_pos", F.posexplode(F.regexp_extract_all("chunk", size, F.lit(0))).alias("p", "chunk"))
    short = short.withColumn("chunk_pos", F.col("chunk_pos") * CHUNK + F.col("p"))
    return K.kmer_counts_chunked(short, ["doc_id"], 3, by=["lang"])


def ols_fit(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_tax")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    # part (key, brand) is a dimension: broadcast after measuring it, so lineitem is never shuffled
    # for the join; the fit is then a partial/final aggregate on 25 brands.
    f = S.ols_fit(dim_join(li, p, "l_partkey"), ["p_brand"], ["l_extendedprice", "l_tax"], "l_quantity")
    return _rounded(f, "p_brand")


def _rounded(f: DataFrame, key: str) -> DataFrame:
    return f.select(key, *[F.col(c) if c == "n" or c.endswith("_n") else F.round(c, 6).alias(c) for c in f.columns if c != key])


def ols_fit_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Prices by quantity per ship mode stand-in (a null group too), where a measure or x is missing in some rows."""
    li = table(spark, sf, "lineitem").select("l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", "l_tax")
    gaps = li.select(F.nullif("l_returnflag", F.lit("A")).alias("flag"), F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("x"),
                     F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice")).alias("price"), F.col("l_tax").alias("tax"))
    return _rounded(S.ols_fit(gaps, ["flag"], ["price", "tax"], "x"), "flag")


def kmer_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """How many different 18-mers of the documents occur once, twice and so on, counted by minimizers."""
    c = K.minimized_counts(_sequences(spark, sf), "seq", LONG_K)
    return c.groupBy("n").agg(F.count(F.lit(1)).alias("kmers"))


def kmer_freq_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """Character shares by language, where one language counts as unknown (null)."""
    d = _sequences(spark, sf).withColumn("lang", F.nullif("lang", F.lit("de")))
    f = K.kmer_freq(d, "seq", 1, by=["lang"])
    return f.select("lang", "kmer", "n", F.round("pct", 6).alias("pct"))


_SEQ = "d AS (SELECT doc_id, lang, replace(upper(replace(regexp_replace(text, '[\\r\\n]', '', 'g'), 'ß', chr(57344))), chr(57344), 'ß') AS seq FROM documents)"


def _counts_sql(k: int, by: str) -> str:
    # Each document's k-mer list is built in place, so generated rows carry only the k-mer.
    sel = f"{by}, " if by else ""
    return (f"SELECT {sel}kmer, CAST(count(*) AS BIGINT) AS n FROM ("
            f"SELECT {sel}unnest(list_transform(range(1, length(seq) - {k - 2}), "
            f"lambda i: substring(seq, i, {k}))) AS kmer FROM d) GROUP BY {sel}kmer")


_PROBES_SQL = "probes(probe, pos) AS (VALUES " + ", ".join(
    f"('{p}', {i + 1})" for i, p in enumerate(PROBES)) + ")"
_PROBE_COUNTS = f"""{_PROBES_SQL},
pc AS (SELECT p.probe, p.pos, CAST(coalesce(sum(
         len(list_filter(range(1, length(d.seq) - length(p.probe) + 2),
                         lambda i: substring(d.seq, i, length(p.probe)) = p.probe))), 0) AS BIGINT) AS n
       FROM probes p, d GROUP BY p.probe, p.pos)"""

SQL = {
    "kmer_freq": f"""WITH {_SEQ}, c AS ({_counts_sql(2, 'lang')})
SELECT lang, kmer, n, round(100.0 * n / sum(n) OVER (PARTITION BY lang), 6) + 0.0 AS pct FROM c""",
    "kmer_topk": f"""WITH {_SEQ}, c AS ({_counts_sql(2, 'lang')}),
f AS (SELECT lang, kmer, n, 100.0 * n / sum(n) OVER (PARTITION BY lang) AS pct,
             row_number() OVER (PARTITION BY lang ORDER BY n DESC, kmer ASC) AS rank FROM c)
SELECT lang, kmer, n, round(pct, 6) + 0.0 AS pct, CAST(rank AS INTEGER) AS rank FROM f WHERE rank <= 10""",
    "kmer_specific": f"""WITH {_SEQ}, {_PROBE_COUNTS}
SELECT probe, n, CAST(n AS VARCHAR) || chr(9) || probe AS line FROM pc""",
    "kmer_report": f"""WITH {_SEQ}, {_PROBE_COUNTS},
c1 AS ({_counts_sql(1, '')}), c2 AS ({_counts_sql(2, '')}),
f AS (SELECT 'k1' AS section, kmer, n, 100.0 * n / sum(n) OVER () AS pct FROM c1
      UNION ALL SELECT 'k2', kmer, n, 100.0 * n / sum(n) OVER () FROM c2)
SELECT section, CAST(row_number() OVER (PARTITION BY section ORDER BY n DESC, kmer ASC) AS INTEGER) AS pos,
       printf('%s %.3f', kmer, round_even(pct * 1000, 0) / 1000) AS line FROM f
UNION ALL
SELECT 'probe', CAST(pos AS INTEGER), CAST(n AS VARCHAR) || chr(9) || probe FROM pc""",
    "kmer_halo": f"WITH {_SEQ} " + _counts_sql(3, "lang"),
    "ols_fit": """
SELECT p_brand,
       round(regr_slope(l_extendedprice, l_quantity), 6) + 0.0 AS l_extendedprice_slope,
       round(regr_intercept(l_extendedprice, l_quantity), 6) + 0.0 AS l_extendedprice_intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) + 0.0 AS l_extendedprice_r2,
       CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS l_extendedprice_n,
       round(regr_slope(l_tax, l_quantity), 6) + 0.0 AS l_tax_slope,
       round(regr_intercept(l_tax, l_quantity), 6) + 0.0 AS l_tax_intercept,
       round(regr_r2(l_tax, l_quantity), 6) + 0.0 AS l_tax_r2,
       CAST(regr_count(l_tax, l_quantity) AS BIGINT) AS l_tax_n,
       CAST(count(*) AS BIGINT) AS n
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
    "ols_fit_gaps": """
WITH g AS (SELECT nullif(l_returnflag, 'A') AS flag, CASE WHEN l_linenumber <> 2 THEN l_quantity END AS x,
                  CASE WHEN l_linenumber <> 3 THEN l_extendedprice END AS price, l_tax AS tax FROM lineitem)
SELECT flag, round(regr_slope(price, x), 6) + 0.0 AS price_slope, round(regr_intercept(price, x), 6) + 0.0 AS price_intercept,
       round(regr_r2(price, x), 6) + 0.0 AS price_r2, CAST(regr_count(price, x) AS BIGINT) AS price_n,
       round(regr_slope(tax, x), 6) + 0.0 AS tax_slope, round(regr_intercept(tax, x), 6) + 0.0 AS tax_intercept,
       round(regr_r2(tax, x), 6) + 0.0 AS tax_r2, CAST(regr_count(tax, x) AS BIGINT) AS tax_n, CAST(count(*) AS BIGINT) AS n
FROM g GROUP BY flag""",
    "kmer_spectrum": f"WITH {_SEQ}, c AS ({_counts_sql(18, '')}) SELECT n, CAST(count(*) AS BIGINT) AS kmers FROM c GROUP BY n",
    "kmer_freq_unknown": f"""WITH {_SEQ}, c AS (SELECT nullif(lang, 'de') AS lang, kmer, CAST(sum(n) AS BIGINT) AS n FROM ({_counts_sql(1, 'lang')})
           GROUP BY 1, 2)
SELECT lang, kmer, n, round(100.0 * n / sum(n) OVER (PARTITION BY lang), 6) + 0.0 AS pct FROM c""",
}

QUERIES = {
    "kmer_freq": kmer_freq,
    "kmer_topk": kmer_topk,
    "kmer_specific": kmer_specific,
    "kmer_report": kmer_report,
    "kmer_halo": kmer_halo,
    "ols_fit": ols_fit,
    "ols_fit_gaps": ols_fit_gaps,
    "kmer_freq_unknown": kmer_freq_unknown,
    "kmer_spectrum": kmer_spectrum,
}
