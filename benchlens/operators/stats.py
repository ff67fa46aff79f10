"""Geometric statistics of ratios and least-squares fits (one partial/final aggregate each)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchlens.operators.compare import percent_change

# Band labels and their order in the printed summary.
BAND_LABELS = ["Min", "Max", "-3 s.d.", "-2 s.d.", "-1 s.d.", "+1 s.d.", "+2 s.d.", "+3 s.d.",
               "Geometric mean"]


def valid_ratio(r: Column) -> Column:
    """A ratio usable in log space: finite and > 0."""
    return r.isNotNull() & ~F.isnan(r) & (r > F.lit(0.0)) & (r < F.lit(float("inf")))


def geo_stats(df: DataFrame, ratio: str = "ratio", by: Sequence[str] = ()) -> DataFrame:
    """n, n_invalid, min, max, geometric mean and geometric s.d. (population) of ``ratio``.

    Ratios that are NULL, NaN, infinite or <= 0 are counted in ``n_invalid``
    and left out of the statistics. With no rows the result is one row with
    n = 0 and NULL statistics (when ``by`` is empty).
    """
    r = F.col(ratio)
    ok = valid_ratio(r)
    lr = F.when(ok, F.ln(r))
    aggs = [
        F.count_if(ok).alias("n"),
        F.count_if(~ok).alias("n_invalid"),
        F.min(F.when(ok, r)).alias("min_ratio"),
        F.max(F.when(ok, r)).alias("max_ratio"),
        F.exp(F.avg(lr)).alias("geo_mean"),
        F.exp(F.stddev_pop(lr)).alias("sdf"),
    ]
    g = df.groupBy(*by) if by else df
    return g.agg(*aggs)


def geo_bands(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long form of the summary: (label, pos, ratio, change_pct), nine rows per group.

    Bands are geo / sdf^k and geo * sdf^k for k = 1..3.
    """
    g, s = F.col("geo_mean"), F.col("sdf")
    values = [F.col("min_ratio"), F.col("max_ratio"), g / F.pow(s, 3), g / F.pow(s, 2), g / s,
              g * s, g * F.pow(s, 2), g * F.pow(s, 3), g]
    items = F.array(*[F.struct(F.lit(lab).alias("label"), F.lit(i + 1).alias("pos"),
                               v.alias("ratio")) for i, (lab, v) in enumerate(zip(BAND_LABELS, values))])
    out = stats.select(*by, F.inline(items))
    return out.withColumn("change_pct", percent_change("ratio"))


def ols_fit(df: DataFrame, by: Sequence[str], ys: Sequence[str], x: str) -> DataFrame:
    """Per group and per measure: slope, intercept, R^2 and number of fitted points (``<y>_n``) of ``y ~ x``.

    A point is fitted if neither its x nor its y is null; ``n`` counts all rows of the group.
    """
    aggs = []
    for y in ys:
        aggs += [F.regr_slope(y, x).alias(f"{y}_slope"),
                 F.regr_intercept(y, x).alias(f"{y}_intercept"),
                 F.regr_r2(y, x).alias(f"{y}_r2"),
                 F.regr_count(y, x).alias(f"{y}_n")]
    aggs.append(F.count(F.lit(1)).alias("n"))
    return df.groupBy(*by).agg(*aggs)
