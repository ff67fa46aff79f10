"""Corpus selection: pins, stanzas, semi-join to packages with benchmarks, slicing, caching."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.operators.ordered import global_index, running
from benchlens.sinks.writers import commit_new, file_system

# The pin-list grammar pieces that are read.
PIN_COMMENT = "--"
PIN_HEAD = "constraints:"
PIN_ENTRY = r"^([A-Za-z0-9][A-Za-z0-9-]*)\s*(.*)$"
PIN_EXACT = r"^==\s*([0-9]+(?:[.][0-9]+)*)$"


def scan_pins(lines: DataFrame, file: str = "file", line_no: str = "line_no",
              text: str = "text", exact_only: bool = True) -> DataFrame:
    """Pin-list lines -> (file, line_no, item, name, spec, version).

    Comment lines are skipped, the ``constraints:`` head is stripped and each
    line is split at commas. ``version`` is set only for an exact ``==`` pin;
    with ``exact_only`` the other entries are dropped.
    """
    body = lines.where(~F.ltrim(F.col(text)).startswith(PIN_COMMENT))
    body = body.withColumn("_t", F.regexp_replace(F.col(text), r"^\s*" + PIN_HEAD, ""))
    items = body.select(file, line_no, F.posexplode(F.split("_t", ",")).alias("item", "_e"))
    items = items.withColumn("_e", F.trim("_e")).where(F.col("_e") != "")
    out = items.select(
        file, line_no, "item",
        F.regexp_extract("_e", PIN_ENTRY, 1).alias("name"),
        F.trim(F.regexp_extract("_e", PIN_ENTRY, 2)).alias("spec"))
    out = out.withColumn("version", F.nullif(F.regexp_extract("spec", PIN_EXACT, 1), F.lit("")))
    if exact_only:
        out = out.where(F.col("version").isNotNull())
    return out


def scan_stanzas(lines: DataFrame, pattern: str, pkg: str = "pkg", text: str = "text") -> DataFrame:
    """Stanza heads of manifest lines: (pkg, kind, name); ``pattern`` captures kind and name."""
    m = lines.select(pkg, F.regexp_extract(F.col(text), pattern, 1).alias("kind"),
                     F.regexp_extract(F.col(text), pattern, 2).alias("name"))
    return m.where(F.col("kind") != "")


def stanza_counts(stanzas: DataFrame, pkg: str = "pkg", name: str = "name") -> DataFrame:
    """Stanzas per package with their sorted names (one package's list is one row)."""
    return stanzas.groupBy(pkg).agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.sort_array(F.collect_list(name)), ",").alias("names"))


def with_stanza(pkgs: DataFrame, stanzas: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Packages that declare at least one stanza (left semi join).

    The stanza side is reduced to its distinct keys first: the partial
    aggregate drops repeats before the shuffle, and the join reuses the
    aggregate's partitioning.
    """
    keys = [on] if isinstance(on, str) else list(on)
    return pkgs.join(stanzas.select(*keys).distinct(), on=keys, how="left_semi")


def slice_corpus(df: DataFrame, order: Sequence[Column | str], s: int, ns: int,
                 bucket_on: str | None = None, index: str = "idx") -> DataFrame:
    """Slice ``s`` (1-based) of ``ns``: rows whose 0-based position div ceil(n/ns) == s-1.

    Positions come from ``global_index`` (range buckets + bucket offsets), so
    no single-partition window is needed. ``ns < 1`` raises; an ``s`` out of
    range gives an empty result.
    """
    if ns < 1:
        raise ValueError("number of slices must be >= 1")
    g = global_index(df, order, index=index, total="_n", bucket_on=bucket_on)
    chunk = F.ceil(F.col("_n") / F.lit(ns))
    return g.where(F.floor(F.col(index) / chunk) == F.lit(s - 1)).drop("_n")


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read ``path`` if a table is there, else build, commit and read it.

    A build is written beside ``path`` and renamed at the end, so a build that
    dies leaves no cache and the next call builds anew. A folder that holds
    nothing but the leavings of a job (names that begin with '_' or '.') is no
    cache and is replaced. Storage errors are raised, never taken for an absent
    cache, and a table that is there is never overwritten.
    """
    fs, p = file_system(spark, path)
    if fs.exists(p):
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        if names and (any(n[0] not in "_." for n in names) or "_SUCCESS" in names):
            return spark.read.parquet(path)
        fs.delete(p, True)
    commit_new(build(), path)
    return spark.read.parquet(path)


def module_list(lines: DataFrame, field: str, pkg: str = "pkg", line_no: str = "line_no", text: str = "text") -> DataFrame:
    """Names of a manifest's ``field:`` list (such as exposed modules): (pkg, line_no, item, module).

    The list starts behind the colon and goes on over deeper or equally
    indented lines until another ``name:`` field; names are parted by commas
    or blanks.
    """
    head = F.regexp_extract(F.lower(F.col(text)), r"^\s*([a-z][a-z0-9-]*)\s*:", 1)
    heads = lines.withColumn("_head", head)
    marked = heads.withColumn("_st", F.when(F.col("_head") != "", F.lit(1)).otherwise(F.lit(0)))
    own = running(marked, [pkg], [line_no], sums={"_field": "_st"}, index=None)
    fields = own.where(F.lower(F.col("_head")) == field.lower()).select(pkg, "_field").distinct()
    body = F.regexp_replace(F.col(text), r"^\s*[A-Za-z][A-Za-z0-9-]*\s*:", "")
    items = own.join(fields, [pkg, "_field"], "left_semi").select(
        pkg, line_no, F.posexplode(F.split(F.trim(body), r"[\s,]+")).alias("item", "module"))
    return items.where(F.col("module") != "")


def read_package_cache(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """JSON cache ``{"packages": [...]}`` (one object per line, or per file) -> (package) base names.

    A cache of another shape fails loudly instead of yielding nothing.
    """
    raw = spark.read.text(path, wholetext=multiline)
    parsed = raw.select(F.from_json("value", "packages array<string>").alias("j"), "value")
    bad = F.col("j").isNull() | F.col("j.packages").isNull()
    checked = parsed.select(F.when(bad, F.raise_error(F.concat(F.lit("Corrupt package cache: "),
                                                                 F.substring("value", 1, 80))))
                            .otherwise(F.col("j.packages")).alias("p"))
    return checked.select(F.explode("p").alias("_e")).select(
        F.element_at(F.split("_e", "/"), -1).alias("package"))
