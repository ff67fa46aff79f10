"""Result sinks: partitioned result trees, partition replacement, appended outcome logs, ordered texts."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.session import fresh_name

_STAGING = "_staging"  # Spark's readers pass over names that begin with '_'


def file_system(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The Hadoop file system of ``path``, and ``path`` as its path object."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def commit_new(df: DataFrame, path: str, fmt: str = "parquet", tags: Sequence[str] = ()) -> bool:
    """Write ``df`` beside ``path`` and rename it there at the end; False if ``path`` is there already.

    ``path`` is either absent or whole at any time: a job that dies leaves only
    a staging folder, which no reader sees. Of two writers one wins, and the
    other's rows are dropped.
    """
    spark = df.sparkSession
    fs, target = file_system(spark, path)
    if fs.exists(target):
        return False
    staged = f"{target.getParent().toString()}/{fresh_name(_STAGING)}"
    df.write.partitionBy(*tags).format(fmt).save(staged)
    _, source = file_system(spark, staged)
    fs.mkdirs(target.getParent())
    won = not fs.exists(target) and fs.rename(source, target)
    if not won:
        fs.delete(source, True)
    return bool(won)


def remove_results(spark: SparkSession, root: str, tags: dict[str, str]) -> int:
    """Remove the result folders ``root/<tag>=<value>/...`` of one run; returns how many there were.

    ``tags`` are the leading partition tags, in order. With it a run without
    any row also takes the place of an older one.
    """
    fs, top = file_system(spark, "/".join([root, *[f"{k}={v}" for k, v in tags.items()]]))
    return int(fs.exists(top) and fs.delete(top, True))


def write_results(df: DataFrame, root: str, tags: Sequence[str], replace: bool = False,
                  fmt: str = "parquet") -> None:
    """Write rows under ``root/<tag>=<value>/...``.

    ``replace=True`` replaces only the tag partitions present in ``df``
    (dynamic partition overwrite), the way a new run removes the older report
    files of the same prefix; other partitions are kept.
    """
    w = df.write.partitionBy(*tags).format(fmt)
    if replace:
        w = w.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    else:
        w = w.mode("append")
    w.save(root)


def write_texts(lines: DataFrame, path: str, order: Sequence[str], document: str | None = None, line: str = "line") -> bool:
    """Write ``lines`` as one text, or one text per ``document``, whose parts in name order hold the lines in ``order``.

    Rows are dealt into ranges of (document, order) and sorted in each, so a
    long document is several parts written by several tasks, and no document is
    ever one row or one group; rows with equal ``order`` may stand either way round.
    A document is the folder ``document=<value>``, a null or empty one the
    folder of Spark's default partition; null orders come first, a null line is
    an empty one, and a line break in a line starts a new line. The folder
    appears whole or not at all; False if ``path`` is there already.
    ``sources.lines.file_lines(per_folder=True)`` reads the texts back.
    """
    keys = [F.col(c) for c in order]
    text = F.coalesce(F.col(line).cast("string"), F.lit("")).alias("value")
    if document is None:
        return commit_new(lines.repartitionByRange(*keys).sortWithinPartitions(*keys).select(text), path, "text")
    # never null: the writer would otherwise put its own column in its place and sort by that alone
    named = lines.withColumn("document", F.coalesce(F.col(document).cast("string"), F.lit("")))
    keys = [F.col("document"), *keys]
    return commit_new(named.repartitionByRange(*keys).sortWithinPartitions(*keys).select(text, "document"), path, "text", ["document"])


def append_outcomes(lines: DataFrame, path: str, text: str = "line", batch: str | None = None) -> bool:
    """Append outcome lines (e.g. error lines) to a text log table.

    With ``batch`` (an id of these lines) they are committed as a whole to a
    folder ``batch=<id>`` of the log; appending the same batch again adds
    nothing and returns False.
    """
    if batch is not None:
        return commit_new(lines.select(text), f"{path}/batch={batch}", "text")
    lines.select(text).write.mode("append").text(path)
    return True
