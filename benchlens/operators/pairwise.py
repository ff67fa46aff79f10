"""Pair sums inside groups without materialising the pairs.

Bodies of a group are dealt into hash tiles of about ``tile`` bodies. Every
unordered pair of tiles (including a tile with itself) meets exactly once by
an equi-join on (group, tile_i, tile_j), so a large group is spread over
(tiles^2 / 2) tasks' worth of rows instead of one task, and no per-pair row is
ever emitted. Each joined row holds two bounded arrays; the tile x tile
interaction is one vectorised numpy evaluation in an Arrow-batched pandas UDF.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.operators.joins import dim_join, group_join

_PAIR_SCHEMA = T.StructType([
    T.StructField("potential", T.DoubleType()),
    T.StructField("n_pairs", T.LongType()),
    T.StructField("n_zero", T.LongType()),
])


def _tile_pair_sums(same: pd.Series, most: pd.Series, ia: pd.Series, xa: pd.Series, ya: pd.Series, za: pd.Series,
                    ma: pd.Series, ib: pd.Series, xb: pd.Series, yb: pd.Series, zb: pd.Series,
                    mb: pd.Series) -> pd.DataFrame:
    pot, npairs, nzero = [], [], []
    for k in range(len(same)):
        pa = np.stack([np.asarray(xa[k], float), np.asarray(ya[k], float), np.asarray(za[k], float)], 1)
        pb = np.stack([np.asarray(xb[k], float), np.asarray(yb[k], float), np.asarray(zb[k], float)], 1)
        d = np.sqrt(((pa[:, None, :] - pb[None, :, :]) ** 2).sum(-1))
        mm = np.asarray(ma[k], float)[:, None] * np.asarray(mb[k], float)[None, :]
        if same[k]:
            keep = np.asarray(ia[k])[:, None] < np.asarray(ib[k])[None, :]
        else:
            keep = np.ones(d.shape, dtype=bool)
        keep &= d <= most[k]
        zero = keep & (d == 0.0)
        ok = keep & ~zero
        pot.append(float((mm[ok] / d[ok]).sum()))
        npairs.append(int(keep.sum()))
        nzero.append(int(zero.sum()))
    return pd.DataFrame({"potential": pot, "n_pairs": npairs, "n_zero": nzero})


_pair_udf = F.pandas_udf(_tile_pair_sums, _PAIR_SCHEMA)


def tiles(df: DataFrame, group: Sequence[str], body_id: str, cols: dict[str, Column | str],
          tile: int = 1024) -> DataFrame:
    """(group..., tile, n_tiles, items): bodies dealt into hash tiles of about ``tile`` bodies."""
    group = list(group)
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    b = df.select(*group, F.col(body_id).alias("_id"),
                  *[(F.col(c) if isinstance(c, str) else c).cast("double").alias(n) for n, c in cols.items()])
    # one row a group: broadcast after measuring it, so bodies of a large group are not moved for a count
    b = dim_join(b, sizes, group, null_keys=True).withColumn(
        "n_tiles", F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(tile))).cast("int"))
    b = b.withColumn("tile", F.pmod(F.xxhash64("_id"), F.col("n_tiles")).cast("int"))
    return b.groupBy(*group, "tile", "n_tiles").agg(
        F.collect_list(F.struct("_id", *cols.keys())).alias("items"))


def pair_potential(df: DataFrame, group: Sequence[str], body_id: str, x: str, y: str, z: str,
                   mass: Column | str, tile: int = 1024, skip_zero: bool = False, cutoff: float | None = None) -> DataFrame:
    """Per group: sum over unordered pairs of m_i m_j / |p_i - p_j| and the pair count.

    With ``cutoff`` only pairs within that distance count: bodies are dealt
    into grid cells of that width and meet the bodies of the 27 cells around,
    so the work follows the pairs in range. Without it the work is quadratic
    in a group's size, as the sum is.

    Two bodies at distance 0 raise an error unless ``skip_zero`` (then they are
    left out and counted in ``n_zero``).
    """
    group = list(group)
    cols = {"x": x, "y": y, "z": z, "m": mass}
    if cutoff is not None:
        return _pair_sums(_in_range(df, group, body_id, cols, tile, cutoff), group, skip_zero, F.lit(True), cutoff)
    t = tiles(df, group, body_id, cols, tile)
    # Left role: tile t pairs with u >= t; right role: tile t pairs with u <= t.
    left = t.select(*group, F.col("tile").alias("ti"),
                    F.explode(F.sequence(F.col("tile"), F.col("n_tiles") - 1)).alias("tj"),
                    F.col("items").alias("a"))
    right = t.select(*group, F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("ti"),
                     F.col("tile").alias("tj"), F.col("items").alias("b"))
    j = group_join(left, right, [*group, "ti", "tj"])
    return _pair_sums(j, group, skip_zero, F.col("ti") == F.col("tj"), float("inf"))


def _in_range(df: DataFrame, group: list[str], body_id: str, cols: dict[str, Column | str], tile: int, cutoff: float) -> DataFrame:
    """Pairs of tiles of a cell (a) and of the bodies of the cells around it (b)."""
    cell = [f"_cell_{c}" for c in "xyz"]
    at = df.withColumns({k: F.floor((F.col(c) if isinstance(c, str) else c) / F.lit(cutoff)).cast("long")
                         for k, c in zip(cell, (cols["x"], cols["y"], cols["z"]))})
    step = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    near = at
    for k in cell:
        near = near.withColumn("_d", F.explode(step)).withColumn(k, F.col(k) + F.col("_d")).drop("_d")
    a = tiles(at, [*group, *cell], body_id, cols, tile).select(*group, *cell, F.col("items").alias("a"))
    b = tiles(near, [*group, *cell], body_id, cols, tile).select(*group, *cell, F.col("items").alias("b"))
    return group_join(a, b, [*group, *cell])


def _pair_sums(j: DataFrame, group: list[str], skip_zero: bool, by_id: Column, most: float) -> DataFrame:
    """Sums over pairs of tiles; ``by_id``: both hold the same bodies, so a pair counts in id order only."""
    r = j.select(*group, _pair_udf(
        by_id, F.lit(most),
        F.col("a._id"), F.col("a.x"), F.col("a.y"), F.col("a.z"), F.col("a.m"),
        F.col("b._id"), F.col("b.x"), F.col("b.y"), F.col("b.z"), F.col("b.m")).alias("r"))
    out = r.groupBy(*group).agg(F.sum("r.potential").alias("potential"),
                                F.sum("r.n_pairs").alias("n_pairs"), F.sum("r.n_zero").alias("n_zero"))
    if not skip_zero:
        out = out.withColumn("potential", F.when(
            F.col("n_zero") > 0, F.raise_error(F.lit("two bodies at distance 0"))).otherwise(
            F.col("potential")))
    return out


def kinetic(df: DataFrame, group: Sequence[str], vx: str, vy: str, vz: str,
            mass: Column | str) -> DataFrame:
    """Per group: sum of 0.5 m |v|^2."""
    m = F.col(mass) if isinstance(mass, str) else mass
    v2 = F.col(vx) * F.col(vx) + F.col(vy) * F.col(vy) + F.col(vz) * F.col(vz)
    return df.groupBy(*group).agg(F.sum(F.lit(0.5) * m * v2).alias("kinetic"))


def total_energy(df: DataFrame, group: Sequence[str], body_id: str, pos: Sequence[str],
                 vel: Sequence[str], mass: Column | str, tile: int = 1024,
                 skip_zero: bool = False) -> DataFrame:
    """Per group: kinetic - pair potential."""
    group = list(group)
    ke = kinetic(df, group, *vel, mass=mass)
    pe = pair_potential(df, group, body_id, *pos, mass=mass, tile=tile, skip_zero=skip_zero)
    return (group_join(ke, pe, group)
            .withColumn("energy", F.col("kinetic") - F.col("potential")))


def weighted_vector_sum(df: DataFrame, group: Sequence[str], body_id: str, weight: Column | str,
                        vec: Sequence[str]) -> DataFrame:
    """Per group: sum of w * v over all bodies except the anchor (least id), and the
    anchor's new vector = -sum / anchor weight. One aggregate: the anchor's own
    term is kept aside and taken off the sums."""
    group = list(group)
    w = F.col(weight) if isinstance(weight, str) else weight
    b = df.select(*group, F.col(body_id).alias("_id"), w.cast("double").alias("_w"),
                  *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(vec)])
    term = [F.col("_w") * F.col(f"_v{i}") for i in range(len(vec))]
    g = b.groupBy(*group).agg(
        F.min("_id").alias("anchor_id"), F.min_by("_w", "_id").alias("_aw"),
        *[F.sum(t).alias(f"_s{i}") for i, t in enumerate(term)],
        *[F.min_by(F.coalesce(t, F.lit(0.0)), F.col("_id")).alias(f"_a{i}") for i, t in enumerate(term)])
    p = [F.coalesce(F.col(f"_s{i}") - F.col(f"_a{i}"), F.lit(0.0)) for i in range(len(vec))]
    return g.select(*group, "anchor_id", *[c.alias(f"p{i}") for i, c in enumerate(p)],
                    *[(-c / F.col("_aw")).alias(f"anchor_v{i}") for i, c in enumerate(p)])
