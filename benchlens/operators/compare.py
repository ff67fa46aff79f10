"""Align two result sets (variants) and classify every row as first / second / both.

Inputs are long DataFrames with one row per measured program:
``block`` (the result file / benchmark group), a program key, a measure and
its fit quality. Alignment is a full outer equi-join on (block, key[, occ]);
``occ`` numbers duplicate keys so each occurrence pairs at most once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchlens.functions.scalar import path_join, round_half_even
from benchlens.operators.ordered import running

FIRST, SECOND, BOTH = "first", "second", "both"


def quality_gate(c: Column | str, threshold: float = 0.95) -> Column:
    """Fit-quality gate; NaN and NULL never pass (IEEE semantics, not Spark's NaN ordering)."""
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (c >= F.lit(threshold))


def ratio(new: Column | str, base: Column | str) -> Column:
    """second / first; a zero base gives NULL instead of an ANSI error."""
    new = F.col(new) if isinstance(new, str) else new
    base = F.col(base) if isinstance(base, str) else base
    return F.try_divide(new, base)


def percent_change(r: Column | str, places: int = 1) -> Column:
    """(ratio - 1) * 100 rounded half-to-even to ``places`` decimals."""
    r = F.col(r) if isinstance(r, str) else r
    # + 0.0 turns a rounded -0.0 into 0.0, so equal changes also print and hash the same
    return round_half_even((r - F.lit(1.0)) * F.lit(100.0), places) + F.lit(0.0)


def with_occurrence(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                    occ: str = "occ", bucket_on: str | None = None) -> DataFrame:
    """n-th occurrence of a duplicate key (1-based), in ``order`` (skew-safe)."""
    return running(df, keys, order, index=occ, bucket_on=bucket_on)


def align_blocks(a: DataFrame, b: DataFrame, block: str = "block", file: str | None = None) -> DataFrame:
    """Full outer alignment of the two block (file) lists: (block, side).

    Without ``file`` a block counts once per side. With ``file`` (the path
    column of two file lists) files that share a block name are numbered in
    path order and paired one by one: (block, occ, side).
    """
    keys = [block] if file is None else [block, "occ"]

    def blocks(df: DataFrame) -> DataFrame:
        if file is None:
            return df.select(block).distinct()
        return running(df.select(block, file).distinct(), [block], [file], index="occ").select(*keys)

    la = blocks(a).withColumn("_in1", F.lit(True))
    lb = blocks(b).withColumn("_in2", F.lit(True))
    j = la.join(lb, on=keys, how="full_outer")
    return j.select(*keys, _side(F.col("_in1"), F.col("_in2")).alias("side"))


def _side(in1: Column, in2: Column) -> Column:
    return (F.when(in1.isNotNull() & in2.isNotNull(), F.lit(BOTH))
            .when(in1.isNotNull(), F.lit(FIRST)).otherwise(F.lit(SECOND)))


def align_results(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("block", "program"),
                  measure: str = "cpu", quality: str = "r2", order: Sequence[str] | None = None) -> DataFrame:
    """Full outer alignment of two result sets on ``keys``.

    Output: keys, side, cpu1, r2_1, cpu2, r2_2, ratio (NULL unless both sides
    exist or when the base is zero). Repeated keys: see ``align_variants``.
    """
    cols = list(dict.fromkeys([*keys, measure, quality, *(order or [])]))
    tagged = (a.select(*cols, F.lit(1).alias("_variant"))
              .unionByName(b.select(*cols, F.lit(2).alias("_variant"))))
    return align_variants(tagged, "_variant", 1, 2, keys, measure, quality, order)


def align_variants(df: DataFrame, variant: str, first, second,
                   keys: Sequence[str] = ("block", "program"), measure: str = "cpu",
                   quality: str = "r2", order: Sequence[str] | None = None, occ: str = "occ",
                   carry: dict[str, Column] | None = None) -> DataFrame:
    """``align_results`` for two variants stored in one long table (a ``variant`` column).

    With ``order`` (columns that order a side's rows; the first a plain
    column) repeated keys are numbered per side, skew-safe, and the n-th
    occurrences pair; ``occ`` joins the output keys. Without it keys must be
    unique per side: a repeated key raises an error instead of losing rows.
    ``carry`` adds aggregates over the one or two rows of an output row. The
    alignment is one grouped aggregate: a single shuffle on the keys with
    partial aggregation, no sort-merge join, one read of the input.
    """
    keys = list(keys)
    v = F.col(variant)
    two = df.where(v.isin(first, second))
    if order:
        two = running(two, [variant, *keys], list(order), index=occ)
        keys.append(occ)
    g = two.groupBy(*keys).agg(
        F.count_if(v == first).alias("_n1"), F.count_if(v == second).alias("_n2"),
        F.max_by(F.col(measure), v == first).alias("_m1"), F.max_by(F.col(quality), v == first).alias("_q1"),
        F.max_by(F.col(measure), v == second).alias("_m2"), F.max_by(F.col(quality), v == second).alias("_q2"),
        *[c.alias(name) for name, c in (carry or {}).items()])
    in1, in2 = F.col("_n1") > 0, F.col("_n2") > 0
    repeated = F.raise_error(F.concat(F.lit("repeated key, give an order to pair its rows: "),
                                      F.to_json(F.struct(*keys)))).cast("string")
    side = (F.when(F.greatest("_n1", "_n2") > 1, repeated)
            .when(in1 & in2, F.lit(BOTH)).when(in1, F.lit(FIRST)).otherwise(F.lit(SECOND)))
    return g.select(
        *keys, side.alias("side"),
        F.when(in1, F.col("_m1")).alias(f"{measure}1"), F.when(in1, F.col("_q1")).alias(f"{quality}_1"),
        F.when(in2, F.col("_m2")).alias(f"{measure}2"), F.when(in2, F.col("_q2")).alias(f"{quality}_2"),
        F.when(in1 & in2, ratio(F.col("_m2"), F.col("_m1"))).alias("ratio"), *(carry or {}))


def orphan_blocks(a: DataFrame, b: DataFrame, block: str = "block") -> DataFrame:
    """Blocks (files) without a counterpart, both directions: (block, side)."""
    la = a.select(block).distinct()
    lb = b.select(block).distinct()
    return (la.join(lb, on=[block], how="left_anti").withColumn("side", F.lit(FIRST))
            .unionByName(lb.join(la, on=[block], how="left_anti").withColumn("side", F.lit(SECOND))))


def orphan_rows(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("block", "program"),
                block: str = "block", measure: str = "cpu", quality: str = "r2",
                order: Sequence[str] | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """Rows of blocks present on both sides that have no partner, before any gate."""
    aligned = align_results(a, b, keys, measure, quality, order)
    return orphan_rows_of(aligned, [*keys, *(["occ"] if order else [])], block, measure, quality, blocks)


def orphan_rows_of(aligned: DataFrame, keys: Sequence[str] = ("block", "program"), block: str = "block",
                   measure: str = "cpu", quality: str = "r2", blocks: DataFrame | None = None) -> DataFrame:
    """Orphan rows from an alignment: one-sided rows of blocks that exist on both sides.

    ``blocks`` is the alignment of the file lists (``align_blocks``), so a file
    with a header and no rows still counts as present. Without it the blocks
    on both sides are a small per-block aggregate of the alignment.
    """
    keys = list(keys)
    if blocks is not None:
        matched = blocks.where(F.col("side") == BOTH).select(block).distinct()
    else:
        matched = (aligned.groupBy(block)
                   .agg(F.max(F.col("side") != SECOND).alias("_h1"),   # some row from the first side
                        F.max(F.col("side") != FIRST).alias("_h2"))    # some row from the second side
                   .where(F.col("_h1") & F.col("_h2")).select(block))
    one = aligned.where(F.col("side") != BOTH).join(matched, on=[block], how="left_semi")
    return one.select(*keys, F.coalesce(F.col(f"{measure}1"), F.col(f"{measure}2")).alias(measure),
                      F.when(F.col("side") == FIRST, F.col(f"{quality}_1"))
                      .otherwise(F.col(f"{quality}_2")).alias(quality), "side")


def gated_pairs(aligned: DataFrame, threshold: float = 0.95, quality: str = "r2") -> DataFrame:
    """Rows present on both sides whose two fits pass the gate."""
    return aligned.where((F.col("side") == BOTH) & quality_gate(f"{quality}_1", threshold)
                         & quality_gate(f"{quality}_2", threshold))


def gated_orphans(aligned: DataFrame, threshold: float = 0.95, measure: str = "cpu",
                  quality: str = "r2") -> DataFrame:
    """One-sided rows (orphan blocks and orphan rows) whose only fit passes the gate."""
    one = aligned.where(F.col("side") != BOTH)
    q = F.coalesce(F.col(f"{quality}_1"), F.col(f"{quality}_2"))
    m = F.coalesce(F.col(f"{measure}1"), F.col(f"{measure}2"))
    keep = [c for c in aligned.columns if c not in (
        "side", f"{measure}1", f"{measure}2", f"{quality}_1", f"{quality}_2", "ratio")]
    return one.where(quality_gate(q, threshold)).select(*keep, "side", m.alias(measure),
                                                        q.alias(quality))


def side_counts(aligned: DataFrame) -> DataFrame:
    """Rows per side (first / second / both)."""
    return aligned.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def movers(aligned: DataFrame, n: int | None = None, worst: bool = True, block: str = "block",
           key: str = "program") -> DataFrame:
    """All paired rows from the largest (or smallest) ratio on, named block/program.

    Pairs without a ratio (zero base) come last. With ``n`` only the first
    ``n`` are returned (TakeOrderedAndProject: each task keeps n rows).
    """
    name = path_join(F.col(block), F.col(key)).alias("name")
    ratio_order = F.col("ratio").desc_nulls_last() if worst else F.col("ratio").asc_nulls_last()
    out = aligned.where(F.col("side") == BOTH).select(name, "cpu1", "cpu2", "ratio").orderBy(ratio_order, F.col("name").asc())
    return out if n is None else out.limit(n)
