"""Best-fit packing of token pieces into fixed-length sequences, online and in bounded space.

A task keeps at most ``open_bins`` open sequences. A bitset has a bit for each
free space that some open sequence has, so the tightest sequence that still
takes a piece is the lowest set bit at or above the piece's length. When a new
sequence is needed and all places are taken, the fullest one is closed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.llm.words import DEFAULT_FILE, WordCodec, slices
from benchlens.session import scratch_path


class OpenBins:
    """Open sequences of one task, keyed by free space."""

    def __init__(self, capacity: int, most: int, first_id: int):
        self.capacity, self.most, self.next_id = capacity, most, first_id
        self.by_free: dict[int, list[int]] = {}
        self.bits = 0
        self.n_open = 0

    def _take(self, free: int) -> int:
        at = self.by_free[free]
        seq = at.pop()
        if not at:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.n_open -= 1
        return seq

    def place(self, length: int) -> tuple[int, int]:
        """(sequence id, offset) of a piece; pieces longer than a sequence get one of their own."""
        if length > self.capacity:
            self.next_id += 1
            return self.next_id - 1, 0
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            seq = self._take(free)
        else:
            if self.n_open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, seq = self.capacity, self.next_id
            self.next_id += 1
        left = free - length
        if left:
            self.by_free.setdefault(left, []).append(seq)
            self.bits |= 1 << left
            self.n_open += 1
        return seq, self.capacity - free


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_FILE,
                 capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of each text: (``id_col``, piece, start, length, ids).

    A text's ids are those of the tokenizer file without special tokens, then
    ``end_id``; ids beyond ``capacity`` are cut into pieces of ``capacity``, the
    last of which may be shorter. ``ids`` holds little-endian unsigned 32-bit
    integers. A null or empty text has the one id ``end_id``; repeated rows
    give repeated pieces; null ids of documents stay null; other columns of the
    input are not read; an empty table gives no piece.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
                           T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    end = end_id.to_bytes(4, "little")
    step = 4 * capacity

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordCodec(path)
        for b in slices(batches):
            take, piece, start, length, ids = [], [], [], [], []
            for row, (got, _) in enumerate(codec.encode(b.column(1).to_pylist())):
                got += end
                for k, at in enumerate(range(0, len(got), step)):
                    own = got[at:at + step]
                    take.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    ids.append(own)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                names=[id_col, "piece", "start", "length", "ids"])

    return src.mapInArrow(cut, schema)


def best_fit(pieces: DataFrame, capacity: int = 2048, open_bins: int = 1024, per_group: int = 500_000) -> DataFrame:
    """``pieces`` with the sequence and offset that best fit gives each.

    Needs a ``length`` column; every other column is kept (``sequence_id`` and
    ``offset`` are replaced if present). Pieces are dealt by row number into
    groups of about ``per_group`` rows and packed in a fixed pseudo-random
    order within each, so no key can make a group large, and a retried task
    repeats its result. Pieces longer than ``capacity`` get a sequence of their
    own; a null or non-positive length gets null sequence and offset. An empty
    table gives an empty result. ``pieces`` is read twice (row count and
    packing): pass a written table.
    """
    src = pieces.drop("sequence_id", "offset")
    groups = max(1, -(-pieces.count() // per_group))
    row = "_pack_row"
    dealt = (src.withColumn(row, F.monotonically_increasing_id()).repartition(groups, row)
             .sortWithinPartitions(F.xxhash64(row), row).drop(row))
    schema = T.StructType([*src.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    at_length = src.columns.index("length")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        for b in batches:
            got = [bins.place(n) if n is not None and n > 0 else (None, None) for n in b.column(at_length).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([s for s, _ in got], pa.int64()), pa.array([o for _, o in got], pa.int64())],
                names=[*b.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(pack, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_FILE,
                   capacity: int = 2048, end_id: int = 0, open_bins: int = 1024) -> DataFrame:
    """Placement of every piece of ``docs``: (id, piece, start, length, ids_crc32, sequence_id, offset).

    The pieces' lengths and checksums are written once to the shared scratch
    folder, so the texts are encoded once. Nulls, empty tables and repeated
    rows behave as in ``token_pieces`` and ``best_fit``.
    """
    spark = docs.sparkSession
    out = scratch_path(spark, "pieces")
    (token_pieces(docs, id_col, text_col, path, capacity, end_id)
     .select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")).write.parquet(out))
    return best_fit(spark.read.parquet(out), capacity, open_bins)
