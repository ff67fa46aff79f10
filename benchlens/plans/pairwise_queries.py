"""Acceptance queries: pair sums and weighted sums over ``embeddings`` grouped by label.

Bodies: position = embedding dims 1-3, velocity = dims 4-6, mass = 1 + vec_id % 5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from benchlens.operators import pairwise as P
from benchlens.plans.fixtures import table


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    dims = {n: F.element_at("embedding", i).cast("double") for i, n in
            enumerate(["x", "y", "z", "vx", "vy", "vz"], start=1)}
    return e.select("vec_id", "label", *[c.alias(n) for n, c in dims.items()],
                    (F.lit(1) + F.col("vec_id") % 5).cast("double").alias("mass"))


def pairwise_potential(spark: SparkSession, sf: str) -> DataFrame:
    p = P.pair_potential(bodies(spark, sf), ["label"], "vec_id", "x", "y", "z", "mass")
    return p.select("label", "n_pairs", F.round("potential", 6).alias("potential"))


def pairwise_unknown(spark: SparkSession, sf: str) -> DataFrame:
    """Pair sums where the bodies of one label belong to no known system (a null group)."""
    b = bodies(spark, sf).withColumn("label", F.nullif("label", F.lit(1)))
    e = P.total_energy(b, ["label"], "vec_id", ["x", "y", "z"], ["vx", "vy", "vz"], "mass")
    return e.select("label", "n_pairs", *[F.round(c, 6).alias(c) for c in ("kinetic", "potential")])


def energy_total(spark: SparkSession, sf: str) -> DataFrame:
    e = P.total_energy(bodies(spark, sf), ["label"], "vec_id", ["x", "y", "z"], ["vx", "vy", "vz"], "mass")
    return e.select("label", *[F.round(c, 6).alias(c) for c in ("kinetic", "potential", "energy")])


def momentum_sum(spark: SparkSession, sf: str) -> DataFrame:
    m = P.weighted_vector_sum(bodies(spark, sf), ["label"], "vec_id", "mass", ["vx", "vy", "vz"])
    return m.select("label", "anchor_id", *[F.round(c, 6).alias(c) for c in m.columns
                                             if c not in ("label", "anchor_id")])


_BODIES_SQL = """b AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
  CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS vx, CAST(embedding[5] AS DOUBLE) AS vy,
  CAST(embedding[6] AS DOUBLE) AS vz, CAST(1 + vec_id % 5 AS DOUBLE) AS mass FROM embeddings)"""
_PAIRS_SQL = """pp AS (SELECT a.label, CAST(count(*) AS BIGINT) AS n_pairs,
  sum(a.mass * b2.mass / sqrt((a.x - b2.x) ^ 2 + (a.y - b2.y) ^ 2 + (a.z - b2.z) ^ 2)) AS potential
  FROM b a JOIN b b2 ON a.label = b2.label AND a.vec_id < b2.vec_id GROUP BY a.label)"""

SQL = {
    "pairwise_unknown": f"""WITH {_BODIES_SQL.replace("vec_id, label,", "vec_id, nullif(label, 1) AS label,")}, {_PAIRS_SQL.replace("a.label = b2.label", "a.label IS NOT DISTINCT FROM b2.label")},
ke AS (SELECT label, sum(0.5 * mass * (vx * vx + vy * vy + vz * vz)) AS kinetic FROM b GROUP BY label)
SELECT ke.label, n_pairs, round(kinetic, 6) + 0.0 AS kinetic, round(potential, 6) + 0.0 AS potential
FROM ke JOIN pp ON ke.label IS NOT DISTINCT FROM pp.label""",
    "pairwise_potential": f"WITH {_BODIES_SQL}, {_PAIRS_SQL} SELECT label, n_pairs, round(potential, 6) + 0.0 AS potential FROM pp",
    "energy_total": f"""WITH {_BODIES_SQL}, {_PAIRS_SQL},
ke AS (SELECT label, sum(0.5 * mass * (vx * vx + vy * vy + vz * vz)) AS kinetic FROM b GROUP BY label)
SELECT label, round(kinetic, 6) + 0.0 AS kinetic, round(potential, 6) + 0.0 AS potential,
       round(kinetic - potential, 6) + 0.0 AS energy FROM ke JOIN pp USING (label)""",
    "momentum_sum": f"""WITH {_BODIES_SQL},
an AS (SELECT label, min(vec_id) AS anchor_id, arg_min(mass, vec_id) AS aw FROM b GROUP BY label),
s AS (SELECT b.label, sum(mass * vx) AS p0, sum(mass * vy) AS p1, sum(mass * vz) AS p2
      FROM b JOIN an ON b.label = an.label AND b.vec_id <> an.anchor_id GROUP BY b.label)
SELECT an.label, an.anchor_id, round(coalesce(p0, 0), 6) + 0.0 AS p0, round(coalesce(p1, 0), 6) + 0.0 AS p1,
       round(coalesce(p2, 0), 6) + 0.0 AS p2, round(-coalesce(p0, 0) / aw, 6) + 0.0 AS anchor_v0,
       round(-coalesce(p1, 0) / aw, 6) + 0.0 AS anchor_v1, round(-coalesce(p2, 0) / aw, 6) + 0.0 AS anchor_v2
FROM an LEFT JOIN s ON an.label = s.label""",
}

QUERIES = {
    "pairwise_potential": pairwise_potential,
    "energy_total": energy_total,
    "momentum_sum": momentum_sum,
    "pairwise_unknown": pairwise_unknown,
}
