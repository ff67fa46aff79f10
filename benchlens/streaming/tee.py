"""Tee: streaming sources copied to several sinks.

``tee_stream``: one source, two sinks; each sink is its own file-sink query
with its own checkpoint, so each is exactly-once on its own; ``availableNow``
processes what is there and stops. ``merge_streams``: several live sources in
one log, written to one or more sinks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from benchlens.operators.ordered import materialize, running


def tee_stream(sdf: DataFrame, sink_a: str, sink_b: str, checkpoint_a: str, checkpoint_b: str,
               fmt: str = "parquet", available_now: bool = True,
               wait: bool = True) -> tuple[StreamingQuery, StreamingQuery]:
    """Start two file-sink queries over ``sdf``; with ``wait`` block until both finish."""
    queries = []
    for sink, ckpt in ((sink_a, checkpoint_a), (sink_b, checkpoint_b)):
        w = sdf.writeStream.format(fmt).option("path", sink).option("checkpointLocation", ckpt)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
        queries.append(w.start())
    if wait:
        for q in queries:
            q.awaitTermination()
    return queries[0], queries[1]


def merge_streams(sources: dict[str, DataFrame], order: Sequence[str], sinks: Sequence[str], checkpoint: str,
                  available_now: bool = True, wait: bool = True) -> StreamingQuery:
    """Merge streaming ``sources`` (name -> stream, all with the same columns) into one log, copied to every sink.

    A log holds the sources' columns, ``source``, ``batch`` and ``pos``: the
    rows of one source are in (batch, pos) order, which inside a batch is
    ``order`` (a total order of a source's rows). One checkpoint keeps the
    place in all sources, so after a crash the same rows form the same batch
    again. A sink's folder of that batch is then written anew, so no row is
    lost or repeated, also if only some sinks had it. An empty batch writes
    nothing; a later batch never changes an earlier one.
    """
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        rows = materialize(running(batch, ["source"], list(order), index="pos"))
        for sink in sinks:
            rows.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    w = reduce(DataFrame.unionByName, tagged).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    query = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()
    if wait:
        query.awaitTermination()
    return query


def read_merged(spark: SparkSession, sink: str) -> DataFrame:
    """The rows of a log written by ``merge_streams``, with their ``batch``."""
    return spark.read.option("basePath", sink).parquet(sink).withColumn("batch", F.col("batch").cast("long"))
