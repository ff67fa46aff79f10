"""Acceptance queries: corpus selection (part, lineitem, orders, documents)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.functions import scalar as X
from benchlens.operators import corpus as C
from benchlens.plans.fixtures import table
from benchlens.session import scratch_path
from benchlens.sources.lines import table_lines

# Fixed values of the derived fixtures.
STANZA_HEAD = r"^(The|And|Of)\s+([A-Za-z]+)"
SLICE, NUM_SLICES = 3, 7
BENCH_QTY = 50


def pin_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A pin list per brand, built from ``part``: comment, head, one entry line per part.

    Entries: exact pins ``name ==size.brandno``; SMALL parts get a range
    (``>=``), parts of size < 5 no version at all; every entry ends with a comma.
    """
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    name = F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-"), F.col("p_partkey").cast("string"))
    ver = F.concat(F.col("p_size").cast("string"), F.lit("."), F.regexp_extract("p_brand", "([0-9]+)", 1))
    entry = (F.when(F.col("p_size") < 5, name)
             .when(F.col("p_type") == "SMALL", F.concat(name, F.lit(" >="), ver))
             .otherwise(F.concat(name, F.lit(" =="), ver)))
    body = p.select(F.col("p_brand").alias("file"), (F.col("p_partkey") + 2).alias("line_no"),
                    F.concat(F.lit("             "), entry, F.lit(",")).alias("text"))
    brands = p.select(F.col("p_brand").alias("file")).distinct()
    head = brands.select("file", F.lit(0).cast("long").alias("line_no"),
                         F.concat(F.lit("-- pins of "), F.col("file")).alias("text")).unionByName(
        brands.select("file", F.lit(1).cast("long").alias("line_no"), F.lit("constraints:").alias("text")))
    return head.unionByName(body)


def pins_parse(spark: SparkSession, sf: str) -> DataFrame:
    return C.scan_pins(pin_lines(spark, sf))


def _pkg_ids(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    name = F.regexp_replace("p_name", " ", "-")
    ver = F.concat(F.col("p_size").cast("string"), F.lit("."), F.regexp_extract("p_brand", "([0-9]+)", 1))
    return p.select("p_partkey", X.pkg_id(name, ver).alias("pkg"))


def pkg_id_split(spark: SparkSession, sf: str) -> DataFrame:
    ids = _pkg_ids(spark, sf)
    return ids.select("p_partkey", "pkg", X.pkg_name("pkg").alias("name"),
                      X.pkg_version("pkg").alias("version"))


def target_slug(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return o.select(F.date_format("d", "yyyy-MM-dd").alias("day"), X.target_slug_nightly("d").alias("nightly"),
                    X.target_slug_lts(F.year("d") - 1990, F.month("d")).alias("lts"))


def _doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pkg"), "text")
    return table_lines(d, ["pkg"], "text", line="text")


def stanza_scan(spark: SparkSession, sf: str) -> DataFrame:
    return C.scan_stanzas(_doc_lines(spark, sf), STANZA_HEAD)


def stanza_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.stanza_counts(C.scan_stanzas(_doc_lines(spark, sf), STANZA_HEAD))


def _with_bench(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    li = table(spark, sf, "lineitem").where(F.col("l_quantity") >= BENCH_QTY).select(
        F.col("l_partkey").alias("p_partkey"))
    return C.with_stanza(p, li, "p_partkey")


def corpus_with_bench(spark: SparkSession, sf: str) -> DataFrame:
    return _with_bench(spark, sf)


def corpus_slice(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return C.slice_corpus(p, ["p_partkey"], SLICE, NUM_SLICES).select("p_partkey", "p_name", "idx")


def corpus_slice_names(spark: SparkSession, sf: str) -> DataFrame:
    """Every slice of the packages in name order: the slice a package is in, and its place."""
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    each = [C.slice_corpus(p, ["p_name", "p_partkey"], s, NUM_SLICES).withColumn("slice", F.lit(s)) for s in (1, SLICE, NUM_SLICES)]
    return each[0].unionByName(each[1]).unionByName(each[2]).select("p_partkey", "p_name", "slice", "idx")


def cached_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Build the package list once into the shared scratch area, then serve it from there."""
    path = scratch_path(spark, "corpus-cache")

    def build() -> DataFrame:
        ids = _pkg_ids(spark, sf)
        return ids.join(_with_bench(spark, sf).select("p_partkey"), on="p_partkey", how="left_semi").select(
            F.col("pkg").alias("package"))

    C.cached_table(spark, path, build)          # first call builds and writes
    return C.cached_table(spark, path, build)   # second call reads the cache


def package_cache(spark: SparkSession, sf: str) -> DataFrame:
    """All package ids written as JSON package lists (with folders, one list per part size), read back as names."""
    path = scratch_path(spark, "package-lists")
    p = _pkg_ids(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    entry = F.concat(F.lit("corpus/"), F.col("p_size").cast("string"), F.lit("/"), F.col("pkg"))
    lists = p.groupBy("p_size", (F.col("p_partkey") % 64).alias("part")).agg(F.collect_list(entry).alias("packages"))
    lists.select(F.to_json(F.struct("packages")).alias("value")).write.text(path)
    return C.read_package_cache(spark, path)


def module_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Module lists of manifests, one per order."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("pkg"), F.col("o_custkey").cast("string").alias("c"), "o_orderstatus")
    lines = o.select("pkg", F.posexplode(F.array(
        F.lit("library"), F.concat(F.lit("  Exposed-Modules: Main.C"), F.col("c"), F.lit(", Lib.C"), F.col("c"), F.lit(",")),
        F.concat(F.lit("      Extra."), F.col("o_orderstatus")), F.lit("  build-depends:   base, containers"))).alias("line_no", "text"))
    return C.module_list(lines, "exposed-modules")


_PIN_LINES_SQL = r"""
p AS (SELECT p_partkey, p_brand,
             replace(p_name, ' ', '-') || '-' || CAST(p_partkey AS VARCHAR) AS nm,
             CAST(p_size AS VARCHAR) || '.' || regexp_extract(p_brand, '([0-9]+)', 1) AS ver,
             p_type, p_size FROM part),
pl AS (
  SELECT p_brand AS file, CAST(p_partkey + 2 AS BIGINT) AS line_no,
         '             ' || CASE WHEN p_size < 5 THEN nm WHEN p_type = 'SMALL' THEN nm || ' >=' || ver
                                 ELSE nm || ' ==' || ver END || ',' AS text FROM p
  UNION ALL SELECT DISTINCT p_brand, 0, '-- pins of ' || p_brand FROM p
  UNION ALL SELECT DISTINCT p_brand, 1, 'constraints:' FROM p),
items AS (
  SELECT file, line_no, unnest(string_split(t, ',')) AS e, generate_subscripts(string_split(t, ','), 1) - 1 AS item
  FROM (SELECT file, line_no, regexp_replace(text, '^\s*constraints:', '') AS t FROM pl
        WHERE NOT starts_with(ltrim(text), '--'))),
parsed AS (
  SELECT file, line_no, CAST(item AS INTEGER) AS item,
         regexp_extract(trim(e), '^([A-Za-z0-9][A-Za-z0-9-]*)\s*(.*)$', 1) AS name,
         trim(regexp_extract(trim(e), '^([A-Za-z0-9][A-Za-z0-9-]*)\s*(.*)$', 2)) AS spec
  FROM items WHERE trim(e) <> '')"""

_PKG_SQL = """pk AS (SELECT p_partkey, replace(p_name, ' ', '-') || '-' || CAST(p_size AS VARCHAR) || '.'
                  || regexp_extract(p_brand, '([0-9]+)', 1) AS pkg FROM part)"""

_DOC_LINES_SQL = """dl AS (SELECT doc_id AS pkg, unnest(string_split(text, chr(10))) AS text FROM documents)"""

SQL = {
    "pins_parse": "WITH " + _PIN_LINES_SQL + r"""
SELECT file, line_no, item, name, spec,
       nullif(regexp_extract(spec, '^==\s*([0-9]+(?:[.][0-9]+)*)$', 1), '') AS version
FROM parsed WHERE nullif(regexp_extract(spec, '^==\s*([0-9]+(?:[.][0-9]+)*)$', 1), '') IS NOT NULL""",
    "pkg_id_split": "WITH " + _PKG_SQL + """
SELECT p_partkey, pkg, nullif(regexp_extract(pkg, '^(.*)-([0-9]+(?:[.][0-9]+)*)$', 1), '') AS name,
       nullif(regexp_extract(pkg, '^(.*)-([0-9]+(?:[.][0-9]+)*)$', 2), '') AS version FROM pk""",
    "target_slug": """
SELECT strftime(d, '%Y-%m-%d') AS day, 'nightly-' || strftime(d, '%Y-%m-%d') AS nightly,
       printf('lts-%d.%d', year(d) - 1990, month(d)) AS lts
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)""",
    "stanza_scan": "WITH " + _DOC_LINES_SQL + r"""
SELECT pkg, regexp_extract(text, '^(The|And|Of)\s+([A-Za-z]+)', 1) AS kind,
       regexp_extract(text, '^(The|And|Of)\s+([A-Za-z]+)', 2) AS name
FROM dl WHERE regexp_extract(text, '^(The|And|Of)\s+([A-Za-z]+)', 1) <> ''""",
    "stanza_counts": "WITH " + _DOC_LINES_SQL + r""",
st AS (SELECT pkg, regexp_extract(text, '^(The|And|Of)\s+([A-Za-z]+)', 2) AS name
       FROM dl WHERE regexp_extract(text, '^(The|And|Of)\s+([A-Za-z]+)', 1) <> '')
SELECT pkg, CAST(count(*) AS BIGINT) AS n, string_agg(name, ',' ORDER BY name) AS names FROM st GROUP BY pkg""",
    "corpus_with_bench": f"""
SELECT p_partkey, p_name FROM part
WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= {BENCH_QTY})""",
    "corpus_slice": f"""
WITH g AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS idx,
                  count(*) OVER () AS n FROM part)
SELECT p_partkey, p_name, CAST(idx AS BIGINT) AS idx FROM g
WHERE floor(idx / ceil(n / {NUM_SLICES})) = {SLICE - 1}""",
    "corpus_slice_names": f"""
WITH g AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name NULLS FIRST, p_partkey) - 1 AS idx,
                  count(*) OVER () AS n FROM part),
s AS (SELECT *, CAST(floor(idx / ceil(n / {NUM_SLICES})) AS INTEGER) + 1 AS slice FROM g)
SELECT p_partkey, p_name, slice, CAST(idx AS BIGINT) AS idx FROM s WHERE slice IN (1, {SLICE}, {NUM_SLICES})""",
    "package_cache": "WITH " + _PKG_SQL + "\nSELECT pkg AS package FROM pk",
    "module_scan": """
SELECT o_orderkey AS pkg, CAST(line_no AS INTEGER) AS line_no, CAST(item AS INTEGER) AS item,
       CASE WHEN line_no = 2 THEN 'Extra.' || o_orderstatus WHEN item = 0 THEN 'Main.C' || CAST(o_custkey AS VARCHAR)
            ELSE 'Lib.C' || CAST(o_custkey AS VARCHAR) END AS module
FROM orders, (VALUES (1, 0), (1, 1), (2, 0)) v(line_no, item)""",
    "cached_corpus": "WITH " + _PKG_SQL + f"""
SELECT pkg AS package FROM pk
WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= {BENCH_QTY})""",
}

QUERIES = {
    "pins_parse": pins_parse,
    "pkg_id_split": pkg_id_split,
    "target_slug": target_slug,
    "stanza_scan": stanza_scan,
    "stanza_counts": stanza_counts,
    "corpus_with_bench": corpus_with_bench,
    "corpus_slice": corpus_slice,
    "corpus_slice_names": corpus_slice_names,
    "cached_corpus": cached_corpus,
    "package_cache": package_cache,
    "module_scan": module_scan,
}
