"""SimHash near-duplicate groups, with candidates pruned by chains of segments on a ring.

The 64 bits of a fingerprint are ``segments`` equal parts on a ring. If two
fingerprints differ in at most ``distance`` bits, then from some segment on
every chain of ``n`` consecutive segments differs in at most ``n * distance /
segments`` bits. Chains whose budget is under one bit must be equal, and of the
next ones (budget under two bits) all segments but one: these equal parts are
the join keys, so a pair is only looked at when a whole chain can still hold.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.llm.components import components
from benchlens.session import scratch_path, target_partitions

SEED = 42
_STEP = 8192  # shingles whose bits are spread out at once


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of one whole text; 0 if it has no word."""
    words = (text or "").encode().lower().split()  # ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [e - 1 for e in accumulate([len(w) + 1 for w in words])]
    starts = [0, *[e + 1 for e in ends[:-1]]]
    hashed = [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[min(shingle, len(words)) - 1:])]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashed), _STEP):
        part = np.array(hashed[at:at + _STEP], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_cols: list[str], text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``id_cols`` and the signed 64-bit ``fingerprint`` of each row's whole text (null: no words)."""
    src = docs.select(*id_cols, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*[docs.schema[c] for c in id_cols], T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([text_fingerprint(t.as_py(), shingle) for t in b.column(len(id_cols))], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got.view(np.int64))], names=schema.names)

    return src.mapInArrow(run, schema)


def budgets(distance: int, segments: int) -> list[int]:
    """Whole bits that a chain of 1, 2, ... ``segments`` segments may differ in."""
    return [n * distance // segments for n in range(1, segments + 1)]


def chain_keys(distance: int, segments: int) -> list[tuple[int, int]]:
    """(ring start, mask) of each join key; a mask covers the parts of a turned fingerprint that must be equal."""
    width, spare = 64 // segments, budgets(distance, segments)
    none, one = spare.count(0), spare.count(1)
    part = [((1 << width) - 1) << (64 - width * (n + 1)) for n in range(segments)]
    run = sum(part[:none])
    masks = [run | sum(part[none:none + one]) ^ part[none + k] for k in range(one)] or [run]
    return [(start, mask) for start in range(segments) for mask in masks]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _turn(c: Column | str, bits: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c if bits % 64 == 0 else F.shiftleft(c, bits % 64).bitwiseOR(F.shiftrightunsigned(c, 64 - bits % 64))


def forest(codes: np.ndarray, distance: int, segments: int) -> list[tuple[int, int]]:
    """Links that span what links ``codes`` of one bucket: at most one less than there are codes."""
    width, spare = 64 // segments, budgets(distance, segments)
    checks = [(np.uint64(64 - width * n), most) for n, most in enumerate(spare[:-1], 1)]
    links: list[tuple[int, int]] = []
    rest = codes
    while rest.size > 1:
        front, rest = [rest[0]], rest[1:]
        while front and rest.size:
            x = front.pop()
            diff = x ^ rest
            near = np.ones(rest.size, bool)
            for shift, most in checks:  # the chain first
                near &= np.bitwise_count(diff >> shift) <= most
            near[near] = np.bitwise_count(diff[near]) <= distance  # then all bits
            if near.any():
                own = rest[near]
                links += [(int(x), int(y)) for y in own]
                front += list(own)
                rest = rest[~near]
    return links


def near_links(codes: DataFrame, distance: int = 2, segments: int = 8) -> DataFrame:
    """Links (u, v) that connect all distinct ``fingerprint`` values within ``distance`` bits of each other.

    Every pair within the distance is connected, though not always by a link of
    its own: within a bucket only a spanning forest is returned. With the
    default 8 segments and 2 bits a key fixes 48 bits, so a bucket holds at
    most 65,536 different fingerprints whatever the size of the input.
    """
    if 64 % segments or not 0 <= distance < segments:
        raise ValueError("segments must divide 64 and exceed the distance")
    width, keys = 64 // segments, chain_keys(distance, segments)
    cases = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(start * width).alias("turn"),
                               _turn("fingerprint", start * width).alias("code"),
                               _turn("fingerprint", start * width).bitwiseAND(F.lit(_signed(mask))).alias("key"))
                      for k, (start, mask) in enumerate(keys)])
    # a fingerprint is small and its keys are many: deal the fingerprints over all tasks before they are multiplied
    # (by another key than the one that they come grouped by, or Spark would leave them in the few tasks they are in)
    dealt = codes.repartition(target_partitions(codes.sparkSession), F.xxhash64("fingerprint"))
    buckets = (dealt.select(F.explode(cases).alias("c")).select("c.*").groupBy("k", "turn", "key")
               .agg(F.collect_list("code").alias("codes")).where(F.size("codes") > 1).select("turn", "codes"))
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("turn", "x", "y")])

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns, xs, ys = [], [], []
            for turn, own in zip(b.column(0).to_pylist(), b.column(1)):
                for x, y in forest(own.values.to_numpy().view(np.uint64), distance, segments):
                    turns.append(turn)
                    xs.append(_signed(x))
                    ys.append(_signed(y))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (turns, xs, ys)], names=out.names)

    got = buckets.mapInArrow(link, out)

    def back(c: str) -> Column:  # turn by a column: pick the constant turn that fits
        cases = F.when(F.lit(False), F.col(c))
        for start in range(segments):
            cases = cases.when(F.col("turn") == start * width, _turn(c, 64 - start * width))
        return cases

    return got.select(back("x").alias("u"), back("y").alias("v")).distinct()


def _grouped(docs: DataFrame, id_cols: list[str], text_col: str = "text", shingle: int = 3, distance: int = 2,
             segments: int = 8) -> tuple[DataFrame, DataFrame]:
    """Written rows (``id_cols``, ``fingerprint``) and the ``component_id`` of each different fingerprint."""
    spark = docs.sparkSession
    path = scratch_path(spark, "fingerprints")
    fingerprints(docs, id_cols, text_col, shingle).write.parquet(path)
    rows = spark.read.parquet(path)
    least = rows.groupBy("fingerprint").agg(F.min(id_cols[0]).alias("_least"))
    roots = components(near_links(least.select("fingerprint"), distance, segments))
    in_group = least.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "_least", F.coalesce("root", "fingerprint").alias("_root"))
    names = in_group.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return rows, in_group.join(names, "_root").select("fingerprint", "component_id")


def near_duplicates(docs: DataFrame, id_cols: list[str] | None = None, text_col: str = "text", shingle: int = 3,
                    distance: int = 2, segments: int = 8) -> DataFrame:
    """Every row's ``id_cols``, ``fingerprint`` (signed long), ``component_id``.

    ``component_id`` is the least first id column of all rows reachable over
    links of at most ``distance`` bits (equal fingerprints are linked too).
    Rows are kept one to one. Null and empty texts, and texts of white space
    only, have fingerprint 0 and are linked like any other; a null id takes no
    part in the minimum (null only if its whole component has null ids); an
    empty table gives an empty result; other columns are not read. Equal
    fingerprints are one row before any pair is formed. Fingerprints are
    written once to the shared scratch folder.
    """
    id_cols = id_cols or ["doc_id"]
    rows, groups = _grouped(docs, id_cols, text_col, shingle, distance, segments)
    return rows.join(groups, "fingerprint").select(*id_cols, "fingerprint", "component_id")


def hex_fingerprint(c: str = "fingerprint") -> Column:
    """16 lowercase hex digits of a signed fingerprint."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options: int) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the least id (nulls last).

    Of repeated rows with that id the first stays. Columns are unchanged; the
    rows are written once to the shared scratch folder under a row number.
    """
    spark = docs.sparkSession
    row, path = "_dedup_row", scratch_path(spark, "dedup-rows")
    docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    place = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col(row).alias("r"))
    ids = rows.select(place.alias("_place"), F.col(row), F.col(text_col))
    groups = _grouped(ids, ["_place"], text_col, **options)[1]  # each group's least place is all that is kept of it
    kept = groups.select(F.col("component_id.r").alias(row)).distinct()
    return rows.join(kept, row, "left_semi").drop(row)
