"""File sources: result trees, header-bound CSV, path tags, FASTA sections, JSON reports."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.functions.scalar import base_name, drop_extension, extension, upper_chars
from benchlens.operators.joins import dim_join
from benchlens.operators.ordered import running
from benchlens.sources.lines import ordered_text

# The result-file columns the comparison reads, by header name.
RESULT_COLUMNS = {"program": "PROGNAME", "cpu": "CPUTIME", "r2": "RSQR_TIME_FIT"}
RESULT_TYPES = {"program": "string", "cpu": "double", "r2": "double"}


def list_runs(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """(path, file_name, block, ext, size) of every matching file under ``root`` (recursive).

    Only file metadata is read (the content column is pruned). Names that
    start with '.' or '_' are skipped, as Spark's file listing does.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).load(root).select("path", "length"))
    name = base_name("path")
    return files.select("path", name.alias("file_name"), drop_extension(name).alias("block"),
                        extension(name).alias("ext"), F.col("length").alias("size"))


def read_headers(spark: SparkSession, root: str | Sequence[str], glob: str = "*.csv", sep: str = ",") -> dict[str, list[str]]:
    """Column names of every file's own header, by file path (one entry per listed file reaches the driver)."""
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    lines = r.text(root if isinstance(root, str) else list(root)).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_mid"))
    first = lines.where("_start = 0").groupBy("file").agg(F.min_by("value", "_mid").alias("header")).collect()
    return {f["file"]: [n.strip() for n in next(csv.reader([f["header"]], delimiter=sep), [])] for f in first}


def scan_results(spark: SparkSession, root: str | Sequence[str], columns: dict[str, str] | None = None,
                 types: dict[str, str] | None = None, mode: str = "fail", glob: str = "*.csv",
                 sep: str = ",", multiline: bool = False):
    """Header-bound CSV scan: every file's own header decides where each column is.

    The headers are read once into a table of column places by file. Files of
    the same width are read together by Spark's CSV reader (quoted fields, any
    separator; quoted line breaks with ``multiline``, which keeps a file in one
    task) and each row takes its columns through its file's places, so the plan
    has a branch for each width, however many headers there are. A file with a
    header and no rows gives none.

    Output: file, block (base name), line order keys (_ord, _mid) and the wanted
    columns. A row is bad if it has fewer or more fields than its header, or a
    wanted value that is missing or does not parse. ``mode="fail"`` raises on a
    missing column or a bad row; ``mode="quarantine"`` returns (good, bad) with
    the bad rows as CSV text.
    """
    if mode not in ("fail", "quarantine"):
        raise ValueError(f"unknown mode {mode!r}")
    columns = dict(columns or RESULT_COLUMNS)
    types = dict(types or RESULT_TYPES)
    widths: dict[int, list[str]] = {}
    places: list[tuple[str, list[int]]] = []
    for file, names in sorted(read_headers(spark, root, glob, sep).items()):
        absent = [h for h in columns.values() if h not in names]
        if absent and mode == "fail":
            raise ValueError(f"no column {', '.join(absent)} in {file}")
        widths.setdefault(len(names), []).append(unquote(file))
        places.append((file, [names.index(h) if h in names else -1 for h in columns.values()]))
    heads = spark.createDataFrame(places, "file string, _at array<int>")
    parts = [_scan_width(spark, files, n, heads, columns, types, sep, multiline) for n, files in sorted(widths.items())]
    if not parts:
        empty = ", ".join(f"{k} {types.get(k, 'string')}" for k in columns)
        parts = [spark.createDataFrame([], f"file string, block string, _ord double, _mid long, value string, {empty}, _bad boolean")]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    keep = ["file", "block", "_ord", "_mid", *columns]
    if mode == "fail":
        checked = rows.where(F.when(F.col("_bad"), F.raise_error(F.concat(
            F.lit("bad result row in "), F.col("file"), F.lit(": "), F.col("value")))).otherwise(F.lit(True)))
        return checked.select(*keep)
    return rows.where(~F.col("_bad")).select(*keep), rows.where(F.col("_bad")).select("file", "_ord", "_mid", "value")


def _scan_width(spark: SparkSession, files: list[str], width: int, heads: DataFrame, columns: dict[str, str], types: dict[str, str],
                sep: str, multiline: bool) -> DataFrame:
    """Rows of the files with ``width`` columns, by the places of their headers."""
    fields = [f"c{i}" for i in range(width)]
    # a row of another width is kept as it is in _raw
    raw = (spark.read.schema(", ".join([*[f"{c} string" for c in fields], "_raw string"])).option("header", True).option("sep", sep)
           .option("escape", '"').option("multiLine", multiline).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_raw")
           .csv(files))
    raw = raw.select(F.array(*fields).alias("_f"), "_raw", F.col("_metadata.file_path").alias("file"),
                     (F.col("_metadata.file_block_start") / (F.col("_metadata.file_size") + 1)).alias("_ord"),
                     F.monotonically_increasing_id().alias("_mid"))
    raw = dim_join(raw, heads, "file")
    wanted, bad = {}, F.col("_raw").isNotNull()
    for i, k in enumerate(columns):
        text = F.get("_f", F.get("_at", F.lit(i)))
        kind = types.get(k, "string")
        typed = text if kind == "string" else F.trim(text).try_cast(kind)
        wanted[k] = typed
        bad = bad | typed.isNull()
    text = F.to_csv(F.struct(*[F.get("_f", F.lit(i)).alias(c) for i, c in enumerate(fields)]), {"sep": sep})
    return raw.select("file", drop_extension(base_name("file")).alias("block"), "_ord", "_mid",
                      F.coalesce("_raw", text).alias("value"), *[c.alias(k) for k, c in wanted.items()], bad.alias("_bad"))


def _pct_decode(c: Column) -> Column:
    """Percent-decoding that keeps '+' (``url_decode`` alone would turn it into a space)."""
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def with_path_tags(df: DataFrame, path: str = "file", keys: Sequence[str] = (),
                   pattern: str | None = None, names: Sequence[str] = (), uri: bool = True) -> DataFrame:
    """Run tags from the path: ``key=value`` directories and/or positional parts
    captured by ``pattern`` into ``names``.

    ``uri=True`` (paths from ``_metadata.file_path`` or a file listing) first
    decodes the URI; ``key=value`` values are then unescaped the way Spark
    escapes partition values.
    """
    p = _pct_decode(F.col(path)) if uri else F.col(path)
    cols = {k: _pct_decode(F.nullif(F.regexp_extract(p, f"(?:^|/){k}=([^/]*)", 1), F.lit("")))
            for k in keys}
    if pattern:
        for i, n in enumerate(names, start=1):
            cols[n] = F.nullif(F.regexp_extract(p, pattern, i), F.lit(""))
    return df.withColumns(cols)


def scan_fasta(spark: SparkSession, path: str | Sequence[str], marker: str, to_eof: bool = False,
               glob: str | None = None) -> DataFrame:
    """One FASTA section as numbered, upper-cased sequence lines: (section, line_pos, seq).

    The section starts after the first header line that begins with ``marker``
    and ends at the next header (``to_eof=True``: runs to the end of the input,
    later headers included as text). Line order across files follows the path
    order. Two filtered aggregates over the header lines give the section's
    bounds; only the lines between them are kept and numbered.
    """
    t = ordered_text(spark, path, glob=glob, rank_files=True)
    at = F.struct(F.col("_ord").alias("o"), F.col("_mid").alias("m"))
    heads = t.where(F.col("value").startswith(">"))
    start = heads.where(F.col("value").startswith(marker)).agg(F.min(F.struct(
        F.col("_ord").alias("o"), F.col("_mid").alias("m"), F.col("value").alias("v"))).alias("h")).select("h").scalar()
    first = F.struct(start["o"].alias("o"), start["m"].alias("m"))
    kept = t.where(at > first)
    if not to_eof:
        end = heads.where(at > first).agg(F.min(at).alias("e")).select("e").scalar()
        kept = kept.where(end.isNull() | (at < end))
    n = running(kept, [], ["_ord", "_mid"], index="line_pos")
    return n.select(F.regexp_replace(start["v"], "^>", "").alias("section"),
                    "line_pos", upper_chars(F.regexp_replace("value", "[\r\n]", "")).alias("seq"))


REPORT_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("regressions", T.ArrayType(T.StructType([
        T.StructField("responder", T.StringType()),
        T.StructField("predictor", T.StringType()),
        T.StructField("coeff", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
    ]))),
])


def read_reports(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """JSON reports (one object per line, or arrays with ``multiline``) with a fixed schema."""
    return spark.read.schema(REPORT_SCHEMA).option("multiLine", multiline).json(path)


def flatten_reports(reports: DataFrame, tags: dict[str, str] | None = None,
                    responder: str = "cpuTime", predictor: str = "iters") -> DataFrame:
    """Reports -> result rows (PROGNAME, CPUTIME, RSQR_TIME_FIT) plus constant run tags.

    A report without a regression of ``responder`` on ``predictor`` gives no row.
    """
    r = reports.select("name", F.explode("regressions").alias("g"))
    r = r.where((F.col("g.responder") == responder) & (F.col("g.predictor") == predictor))
    out = r.select(F.col("name").alias("PROGNAME"), F.col("g.coeff").alias("CPUTIME"),
                   F.col("g.r2").alias("RSQR_TIME_FIT"))
    return out.withColumns({k: F.lit(v) for k, v in (tags or {}).items()})
