"""Order-sensitive alignment of two result lists per block (longest common subsequence).

Rows that moved become two orphans, as in a sequence diff. The key-based
full outer join (``compare.align_results``) is the order-free alternative and
the default everywhere else.

A block is first cut where no key has rows on both sides of the cut: no match
can cross such a cut, so the longest common subsequences of the pieces add up
exactly. A piece of one key pairs its n-th rows by a join. The other pieces are
cut into strips of rows on either side (``strip_size``). Where that gives more than one
strip, the table of common-subsequence lengths is swept strip by strip, from
both ends: a tile (a strip of each side) needs only the length differences along
two of its edges and passes on those along the other two, so the tiles of a
diagonal run side by side, and no task holds more than two strips. The lengths
from both ends give the row of the second side at which a best path leaves each
first-side strip (the leftmost; these are all on one path), so every strip is
then a problem of its own.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.operators.compare import BOTH, FIRST, SECOND
from benchlens.operators.ordered import materialize, range_buckets, running
from benchlens.session import scratch_path, target_partitions

STRIP = 65_536  # rows of a strip
MOST_STRIPS = 4  # of a side, while strips have fewer than STRIP rows: every diagonal of tiles is a job
_MOST_PAIRS = 50  # equal rows of both sides per row, beyond which lengths are swept instead


def sweep(first: list, second: list, flat: int, steps: np.ndarray) -> tuple[int, np.ndarray]:
    """Carry the lengths of common subsequences over the rows of ``first``.

    Bit j of ``flat`` is 0 where the length grows from row j to j + 1 of
    ``second`` (along the edge before ``first``); ``steps`` is 1 for rows of
    ``first`` over which it grows along the edge before ``second``. Returns
    both for the opposite edges. Where equal rows are few, each moves one place
    of growth (``_sweep_pairs``); else all rows of ``second`` are handled at
    once, as the bits of one number.
    """
    width = len(second)
    where: dict = {}
    for j, k in enumerate(second):
        where.setdefault(k, []).append(j)
    if sum(len(where.get(k, ())) for k in first) <= len(first) * (4 + width // 4096):  # a pair costs as much as the bits of so many rows
        return _sweep_pairs(first, where, width, flat, steps)
    return _sweep_bits(first, where, width, flat, steps)


def _sweep_pairs(first: list, where: dict, width: int, flat: int, steps: np.ndarray) -> tuple[int, np.ndarray]:
    """``sweep`` by the pairs of equal rows, whatever the width."""
    grows = np.flatnonzero(_growth(flat, width)).tolist()
    gone = 0  # places of growth passed to the rows before ``second``
    out = np.zeros(len(first), np.uint8)
    for i, (k, step) in enumerate(zip(first, steps.tolist())):
        for j in reversed(where.get(k, ())):
            p = bisect_left(grows, j, gone)
            if p == len(grows):
                grows.append(j)
                out[i] = 1
            else:
                grows[p] = j
        if step:
            if gone == len(grows):
                out[i] = 1
            else:
                gone += 1
    flats = np.ones(width, np.uint8)
    flats[grows[gone:]] = 0
    return int.from_bytes(np.packbits(flats, bitorder="little").tobytes(), "little"), out


def _sweep_bits(first: list, where: dict, width: int, flat: int, steps: np.ndarray) -> tuple[int, np.ndarray]:
    """``sweep`` by whole rows of the table, however many rows are equal."""
    full = (1 << width) - 1
    masks: dict = {}

    def mask(k: object) -> int:
        if k in masks:
            return masks[k]
        at = where.get(k)
        if at is None:
            return 0
        bits = bytearray(-(-width // 8))
        for j in at:
            bits[j >> 3] |= 1 << (j & 7)
        got = int.from_bytes(bits, "little")
        if len(at) > 64:  # few keys have so many rows, so few masks are kept
            masks[k] = got
        return got

    out = np.zeros(len(first), np.uint8)
    for i, (k, step) in enumerate(zip(first, steps.tolist())):
        m = mask(k)
        if m or step:
            hit = flat & m
            total = flat + hit + step
            out[i] = total >> width
            flat = (total & full) | (flat ^ hit)
    return flat, out


def _growth(flat: int, width: int) -> np.ndarray:
    """1 where the length grows, by row of the second side."""
    bits = np.frombuffer(flat.to_bytes(-(-width // 8), "little"), np.uint8)
    return 1 - np.unpackbits(bits, count=width, bitorder="little")


def _lengths(growth: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(growth, dtype=np.int64)])


def crossing(ahead: np.ndarray, behind: np.ndarray) -> int:
    """How many rows of the second side lie before the leftmost best path at an edge.

    ``ahead``: where lengths of the rows above the edge grow; ``behind``: those
    of the rows below it, from the other end.
    """
    return int(np.argmax(_lengths(ahead) + _lengths(behind)[::-1]))


def lcs_matches(ka: list, kb: list) -> list[tuple[int, int]]:
    """Index pairs of one longest common subsequence.

    Where equal rows are few their pairs are searched (``lcs_pairs``); where
    keys repeat a lot, the first side is halved at the crossing of a best path.
    """
    na, nb = Counter(ka), Counter(kb)
    pairs = sum(n * nb[k] for k, n in na.items())
    if pairs <= _MOST_PAIRS * (len(ka) + len(kb)) or len(ka) < 2:
        return lcs_pairs(ka, kb)
    mid, zero = len(ka) // 2, np.zeros(len(ka), np.uint8)
    full = (1 << len(kb)) - 1
    ahead = _growth(sweep(ka[:mid], kb, full, zero[:mid])[0], len(kb))
    behind = _growth(sweep(ka[mid:][::-1], kb[::-1], full, zero[mid:])[0], len(kb))
    at = crossing(ahead, behind)
    return lcs_matches(ka[:mid], kb[:at]) + [(i + mid, j + at) for i, j in lcs_matches(ka[mid:], kb[at:])]


def lcs_pairs(ka: list, kb: list) -> list[tuple[int, int]]:
    """Index pairs (i, j) of one longest common subsequence of ``ka`` and ``kb``."""
    where: dict = {}
    for j, k in enumerate(kb):
        where.setdefault(k, []).append(j)
    tails: list[int] = []        # smallest end j of an increasing run of each length
    tail_idx: list[int] = []     # index into ``pairs`` of that end
    prev: list[int] = []
    pairs: list[tuple[int, int]] = []
    for i, k in enumerate(ka):
        for j in reversed(where.get(k, ())):
            p = bisect_left(tails, j)
            pairs.append((i, j))
            prev.append(tail_idx[p - 1] if p > 0 else -1)
            if p == len(tails):
                tails.append(j)
                tail_idx.append(len(pairs) - 1)
            else:
                tails[p] = j
                tail_idx[p] = len(pairs) - 1
    out = []
    t = tail_idx[-1] if tail_idx else -1
    while t >= 0:
        out.append(pairs[t])
        t = prev[t]
    return out[::-1]


def _positions(df: DataFrame, order: str, block: str, key: str, measure: str, quality: str) -> DataFrame:
    """(block, program, pos, occ, cpu, r2): 0-based position in the block and occurrence of the key.

    Both numberings follow (``order``, key, values), a total order of different
    rows, and share one set of range-bucket limits.
    """
    p = df.select(F.col(block).alias("block"), F.col(key).alias("program"), F.col(order).alias("_o"),
                  F.col(measure).cast("double").alias("cpu"), F.col(quality).cast("double").alias("r2"))
    bk = range_buckets(p, "_o")
    total = ["_o", "program", "cpu", "r2"]
    p = running(p, ["block"], total, index="_p1", bucket=bk)
    p = running(p, ["block", "program"], total, index="occ", bucket=bk)
    return materialize(p.select("block", "program", (F.col("_p1") - 1).alias("pos"), "occ", "cpu", "r2"))


def pieces(a: DataFrame, b: DataFrame) -> DataFrame:
    """(block, program, piece, n_keys): the keys of both sides, by the piece of their block.

    Keys are taken in first-side order; there is a cut behind a key where all
    rows so far, on either side, lie before all rows of the keys to come. The
    extremes so far and to come are computed inside range buckets and joined
    with those of the other buckets, so a large block is many tasks' work.
    """
    span = lambda df, i: df.groupBy("block", "program").agg(F.min("pos").alias(f"lo{i}"), F.max("pos").alias(f"hi{i}"))
    keys = materialize(span(a, 1).join(span(b, 2), ["block", "program"]))
    keys = keys.withColumn("_b", range_buckets(keys, "lo1"))
    at = Window.partitionBy("block", "_b").orderBy("lo1")
    so_far = at.rowsBetween(Window.unboundedPreceding, 0)
    # from the end: Spark computes a frame that reaches to it anew for every row
    to_come = Window.partitionBy("block", "_b").orderBy(F.col("lo1").desc()).rowsBetween(Window.unboundedPreceding, -1)
    local = keys.withColumns({"_m1": F.max("hi1").over(so_far), "_m2": F.max("hi2").over(so_far),
                              "_n1": F.lead("lo1").over(at), "_n2": F.min("lo2").over(to_come)})
    per = keys.groupBy("block", "_b").agg(F.max("hi1").alias("_x1"), F.max("hi2").alias("_x2"),
                                          F.min("lo1").alias("_y1"), F.min("lo2").alias("_y2"))
    before = lambda c: Window.partitionBy("block").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731  (one row a bucket)
    earlier, later = before(F.col("_b")), before(F.col("_b").desc())
    per = per.select("block", "_b", F.max("_x1").over(earlier).alias("_e1"), F.max("_x2").over(earlier).alias("_e2"),
                     F.min("_y1").over(later).alias("_l1"), F.min("_y2").over(later).alias("_l2"))
    seen = local.join(per, ["block", "_b"])
    cut = ((F.greatest("_m1", "_e1") < F.least("_n1", "_l1")) & (F.greatest("_m2", "_e2") < F.least("_n2", "_l2")))
    seen = seen.select("block", "program", "lo1", F.coalesce(cut, F.lit(False)).cast("int").alias("_cut"))
    numbered = running(seen, ["block"], ["lo1"], sums={"_cuts": "_cut"}, index=None)
    numbered = numbered.select("block", "program", (F.col("_cuts") - F.col("_cut")).cast("long").alias("piece"))
    sizes = numbered.groupBy("block", "piece").agg(F.count(F.lit(1)).alias("n_keys"))
    return numbered.join(sizes, ["block", "piece"])


_PIECE = ["block", "piece"]


def _strips(rows: DataFrame, size: int) -> DataFrame:
    """(block, piece, strip, n, keys): the keys of ``rows`` (block, piece, program, i from 0) in strips of ``size`` rows."""
    at = rows.withColumn("strip", F.floor(F.col("i") / size).cast("int"))
    own = at.groupBy(*_PIECE, "strip").agg(F.sort_array(F.collect_list(F.struct("i", "program"))).alias("_r"), F.first("_total").alias("n"))
    return own.select(*_PIECE, "strip", "n", F.col("_r.program").alias("keys"))


def _tile(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        flats, steps = [], []
        for r in b.to_pylist():
            first, second = r["keys1"], r["keys2"]
            if r["back"]:
                first, second = first[::-1], second[::-1]
            flat = int.from_bytes(r["flat"], "little") if r["flat"] is not None else (1 << len(second)) - 1
            step = np.frombuffer(r["steps"], np.uint8) if r["steps"] is not None else np.zeros(len(first), np.uint8)
            flat, step = sweep(first, second, flat, step)
            flats.append(flat.to_bytes(-(-len(second) // 8), "little"))
            steps.append(step.tobytes())
        kept = [b.column(b.schema.get_field_index(c)) for c in names[:-2]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(flats, pa.binary()), pa.array(steps, pa.binary())], names=names)


def _swept(strips1: DataFrame, strips2: DataFrame, shape: DataFrame, rounds: int) -> DataFrame:
    """The lower edges of all tiles: (block, piece, back, p, q, n2, flat, steps), tile by tile along the diagonals.

    Each diagonal is one job over all pieces and both directions and is
    written to the shared scratch folder, from which the next one reads.
    """
    spark = shape.sparkSession
    path = scratch_path(spark, "tiles")
    schema = T.StructType([shape.schema["block"], T.StructField("piece", T.LongType()), T.StructField("back", T.BooleanType()),
                           T.StructField("p", T.IntegerType()), T.StructField("q", T.IntegerType()), T.StructField("n2", T.IntegerType()),
                           T.StructField("flat", T.BinaryType()), T.StructField("steps", T.BinaryType())])
    names = schema.names
    own = [*_PIECE, "back", "p", "q"]
    edge = spark.createDataFrame([], schema)
    for d in range(rounds):
        low, high = F.greatest(F.lit(0), F.lit(d + 1) - F.col("s2")), F.least(F.lit(d), F.col("s1") - 1)
        tiles = (shape.where(low <= high).withColumn("p", F.explode(F.sequence(low, high)))
                 .withColumn("q", F.lit(d) - F.col("p")).withColumn("back", F.explode(F.array(F.lit(False), F.lit(True)))))
        mirrored = lambda c, n: F.when(F.col("back"), F.col(n) - 1 - F.col(c)).otherwise(F.col(c))
        tiles = tiles.withColumns({"_p": mirrored("p", "s1"), "_q": mirrored("q", "s2")})
        tiles = tiles.join(strips1.select(*_PIECE, F.col("strip").alias("_p"), F.col("keys").alias("keys1")), [*_PIECE, "_p"])
        tiles = tiles.join(strips2.select(*_PIECE, F.col("strip").alias("_q"), F.col("keys").alias("keys2")), [*_PIECE, "_q"])
        above = edge.select(*_PIECE, "back", (F.col("p") + 1).alias("p"), "q", "flat")
        before = edge.select(*_PIECE, "back", "p", (F.col("q") + 1).alias("q"), "steps")
        tiles = tiles.join(above, own, "left").join(before, own, "left").withColumn("n2", F.size("keys2"))
        tiles = tiles.repartition(target_partitions(spark), *own)  # few bytes, but much work: not to be coalesced
        done = tiles.mapInArrow(lambda batches: _tile(batches, names), schema)
        done.write.parquet(f"{path}/diagonal={d}")
        edge = spark.read.schema(schema).parquet(f"{path}/diagonal={d}")
    return spark.read.schema(schema).parquet(path)


def _cross(key: tuple, edges: pa.Table) -> pa.Table:
    """Where the leftmost best path of a piece leaves one strip of the first side."""
    rows = sorted(edges.to_pylist(), key=lambda r: r["q"])
    ahead, behind = (np.concatenate([_growth(int.from_bytes(r["flat"], "little"), r["n2"]) for r in rows if r["back"] == back])
                     for back in (False, True))
    return pa.table({"block": edges["block"].slice(0, 1), "piece": edges["piece"].slice(0, 1),
                     "at": pa.array([crossing(ahead, behind)], pa.int64())})


def _lcs_of_strip(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """(block, pos1, pos2) of one longest common subsequence of a strip and its rows of the other side."""
    left, right = left.sort_by("pos"), right.sort_by("pos")
    found = lcs_matches(left["program"].to_pylist(), right["program"].to_pylist())
    i, j = [pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)]
    return pa.table({"block": left["block"].take(i), "pos1": left["pos"].take(i), "pos2": right["pos"].take(j)})


def strip_size(strip: int, rows: int) -> int:
    """Rows of a strip where the longest side of a piece has ``rows``: ``strip``, or more, up to ``STRIP``, if these were many strips."""
    return max(strip, min(STRIP, -(-rows // MOST_STRIPS)))


def lcs_of_pieces(first: DataFrame, second: DataFrame, strip: int = STRIP) -> DataFrame:
    """(block, pos1, pos2): a longest common subsequence of each piece of the two sides (block, piece, program, pos).

    Pieces of more than ``strip`` rows on a side are split at crossings of a
    best path (see the module), into strips of ``strip_size`` rows.
    """
    def numbered(df: DataFrame) -> DataFrame:
        return materialize(running(df, _PIECE, ["pos"], index="i", total="_total").withColumn("i", F.col("i") - 1))

    one, two = numbered(first), numbered(second)
    strip = strip_size(strip, max(df.agg(F.max("_total")).first()[0] or 0 for df in (one, two)))
    one, two = (df.withColumn("strip", F.floor(F.col("i") / strip).cast("int")) for df in (one, two))
    count = lambda df, n: df.groupBy(*_PIECE).agg((F.max("strip") + 1).alias(n))
    shape = count(one, "s1").join(count(two, "s2"), _PIECE).where("s1 > 1 or s2 > 1")
    rounds = shape.agg(F.max(F.col("s1") + F.col("s2") - 1)).first()[0]
    if rounds:
        shape = materialize(shape)
        large = lambda df: materialize(_strips(df.join(shape.select(*_PIECE), _PIECE, "left_semi"), strip))
        tiles = _swept(large(one), large(two), shape, rounds).join(shape, _PIECE)
        # a strip of the second side is the same whichever end it is swept from, its place is not
        inner = tiles.where(F.col("p") < F.col("s1") - 1).withColumn(
            "edge", F.when(F.col("back"), F.col("s1") - 1 - F.col("p")).otherwise(F.col("p") + 1))
        schema = T.StructType([first.schema["block"], T.StructField("piece", T.LongType()), T.StructField("at", T.LongType())])
        cuts = inner.groupBy(*_PIECE, "edge").applyInArrow(_cross, schema)
        cuts = cuts.groupBy(*_PIECE).agg(F.sort_array(F.collect_list("at")).alias("_cuts"))
        two = two.join(cuts, _PIECE, "left")
        passed = F.size(F.filter("_cuts", lambda x: x <= F.col("i")))
        two = two.withColumn("strip", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(passed).cast("int")).drop("_cuts")
    else:
        two = two.withColumn("strip", F.lit(0))
    schema = T.StructType([first.schema["block"], T.StructField("pos1", T.LongType()), T.StructField("pos2", T.LongType())])
    at = [*_PIECE, "strip", "program"]
    two = two.join(one.select(*at).distinct(), at, "left_semi")  # a strip's other rows match nothing
    own = lambda df: df.select(*at, "pos").groupBy(*_PIECE, "strip")
    two = two.select(*[F.col(c).alias(c) for c in two.columns])  # the sides may come from one table
    return own(one).cogroup(own(two)).applyInArrow(_lcs_of_strip, schema)


def align_sequence(a: DataFrame, b: DataFrame, order: str, block: str = "block",
                   key: str = "program", measure: str = "cpu", quality: str = "r2", strip: int = STRIP) -> DataFrame:
    """Order-sensitive alignment per block; ``order`` gives the row order on each side.

    ``strip``, or ``strip_size`` if sides are longer, bounds the rows of either side that a task aligns (see the module).

    Output: block, program, side, cpu1, r2_1, cpu2, r2_2, ratio, pos1, pos2.
    Matches are position pairs from both branches (see the module); all values
    are joined to them in one way, so nulls and NaNs stay what they are.
    """
    pa_, pb = (_positions(df, order, block, key, measure, quality) for df in (a, b))
    cut = materialize(pieces(pa_, pb))
    single = cut.where("n_keys = 1").select("block", "program")
    one = pa_.join(single, ["block", "program"]).select("block", "program", "occ", F.col("pos").alias("pos1")).join(
        pb.select("block", "program", "occ", F.col("pos").alias("pos2")), ["block", "program", "occ"])
    mixed = cut.where("n_keys > 1").select("block", "program", "piece")
    side = lambda df: df.select("block", "program", "pos").join(mixed, ["block", "program"])
    many = lcs_of_pieces(side(pa_), side(pb), strip)
    matched = one.select("block", "pos1", "pos2").unionByName(many)

    def values(df: DataFrame, i: int) -> DataFrame:
        return df.select("block", F.col("pos").alias(f"pos{i}"), F.col("program").alias(f"program{i}"),
                         F.col("cpu").alias(f"cpu{i}"), F.col("r2").alias(f"r2_{i}"))

    first = values(pa_, 1).join(matched, ["block", "pos1"], "left").withColumn(
        "pos2", F.coalesce("pos2", -1 - F.col("pos1")))  # an own stand-in for each row without a partner
    out = first.join(values(pb, 2), ["block", "pos2"], "full_outer")
    in1, in2 = F.col("program1").isNotNull(), F.col("program2").isNotNull()
    return out.select("block", F.coalesce("program1", "program2").alias("program"), _side(in1, in2).alias("side"),
                      "cpu1", "r2_1", "cpu2", "r2_2", F.when(in1 & in2, F.try_divide("cpu2", "cpu1")).alias("ratio"),
                      F.col("pos1").cast("long").alias("pos1"), F.when(F.col("pos2") >= 0, F.col("pos2")).cast("long").alias("pos2"))


def _side(in1: Column, in2: Column) -> Column:
    return F.when(in1 & in2, F.lit(BOTH)).when(in1, F.lit(FIRST)).otherwise(F.lit(SECOND))
