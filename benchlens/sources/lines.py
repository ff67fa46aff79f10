"""Numbered lines from text tables and text files.

Files are read with ``spark.read.text`` (splittable). Line order inside a file
is recovered from the split's start offset and a per-split increasing id taken
in the scan's own projection; per-file line numbers then come from the
skew-safe ``running`` helper, so one huge file is numbered by many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.operators.ordered import running


MOST_BROADCAST_FILES = 100_000  # longer file lists meet their lines by a shuffle join


def table_lines(df: DataFrame, ids: Sequence[str], text: str, line: str = "line") -> DataFrame:
    """(ids..., line_no, line): split a text column at newlines; line numbers start at 1."""
    return df.select(*ids, F.posexplode(F.split(F.col(text), "\n", -1)).alias("_p", line)).select(
        *ids, (F.col("_p") + 1).alias("line_no"), line)


def ordered_text(spark: SparkSession, path: str | Sequence[str], glob: str | None = None,
                 recursive: bool = True, rank_files: bool = False) -> DataFrame:
    """Raw lines with their order keys: (file, value, _start, _ord, _mid[, file_rank]).

    ``_ord`` = split start / file size orders the splits of one file;
    ``_mid`` orders the lines inside one split. With ``rank_files`` the file's
    rank in path order is added to ``_ord`` so it also orders lines across
    files; the ranks come from the driver's own file listing (which Spark
    builds anyway to plan the scan) and join as a table of one row per file.
    """
    r = spark.read
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    raw = r.text(path if isinstance(path, str) else list(path))
    scan = raw.select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("_metadata.file_size").alias("_size"),
        F.monotonically_increasing_id().alias("_mid"))
    frac = F.col("_start") / (F.col("_size") + F.lit(1))
    if not rank_files:
        return scan.select("file", "value", "_start", frac.alias("_ord"), "_mid")
    files = sorted(_norm_path(f) for f in raw.inputFiles())
    ranks = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "_fkey string, file_rank int")
    scan = scan.withColumn("_fkey", _norm_path_col(F.col("file")))
    if len(files) <= MOST_BROADCAST_FILES:
        ranks = F.broadcast(ranks)
    scan = scan.join(ranks, on="_fkey", how="inner").drop("_fkey")
    return scan.select("file", "file_rank", "value", "_start", (F.col("file_rank") + frac).alias("_ord"), "_mid")


_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):/+")


def _norm_path(p: str) -> str:
    """Same key for 'file:///a' and 'file:/a', percent-decoded (listing vs metadata forms)."""
    return unquote(_SCHEME.sub(r"\1:/", p))


def _norm_path_col(c):
    c = F.regexp_replace(c, r"^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")
    return F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def file_lines(spark: SparkSession, path: str | Sequence[str], glob: str | None = None,
               per_folder: bool = False) -> DataFrame:
    """(file, line_no, text): numbered lines of every file under ``path``.

    With ``per_folder`` the files of a folder, in name order, are numbered as
    one: (folder, line_no, text).
    """
    t = ordered_text(spark, path, glob, rank_files=per_folder)
    if per_folder:
        t = t.withColumn("folder", F.regexp_replace("file", "/[^/]*$", ""))
        n = running(t, ["folder"], ["_ord", "_mid"], index="line_no")
        return n.select("folder", "line_no", F.col("value").alias("text"))
    n = running(t, ["file"], ["_start", "_mid"], index="line_no", bucket_on="_ord")
    return n.select("file", "line_no", F.col("value").alias("text"), "_ord", "_mid")
