import itertools
import math
import random

import pytest

from benchlens.operators import pairwise as P


def _bodies(n=37, seed=3):
    rnd = random.Random(seed)
    return [(i, g, rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1), float(1 + i % 5))
            for g in (0, 1) for i in range(g * 1000, g * 1000 + n)]


def _brute(rows):
    out = {}
    for g in (0, 1):
        bs = [r for r in rows if r[1] == g]
        pot = sum(a[6] * b[6] / math.dist(a[2:5], b[2:5]) for a, b in itertools.combinations(bs, 2))
        out[g] = (pot, len(bs) * (len(bs) - 1) // 2)
    return out


@pytest.mark.parametrize("tile", [1, 4, 16, 1024])
def test_tiled_pair_sum_equals_brute_force(spark, tile):  # J8, A14
    rows = _bodies()
    df = spark.createDataFrame(rows, "id long, g int, x double, y double, z double, vx double, m double")
    got = {r.g: (r.potential, r.n_pairs) for r in P.pair_potential(df, ["g"], "id", "x", "y", "z", "m",
                                                                   tile=tile).collect()}
    exp = _brute(rows)
    for g in exp:
        assert got[g][1] == exp[g][1]
        assert got[g][0] == pytest.approx(exp[g][0], rel=1e-12)


def test_zero_distance_raises_or_is_skipped(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 1.0), (2, 0, 0.0, 0.0, 0.0, 1.0), (3, 0, 1.0, 0.0, 0.0, 1.0)],
                               "id long, g int, x double, y double, z double, m double")
    with pytest.raises(Exception):
        P.pair_potential(df, ["g"], "id", "x", "y", "z", "m").collect()
    r = P.pair_potential(df, ["g"], "id", "x", "y", "z", "m", skip_zero=True).first()
    assert r.n_zero == 1 and r.potential == pytest.approx(2.0)


def test_weighted_vector_sum_excludes_anchor(spark):  # A13
    df = spark.createDataFrame([(1, 0, 2.0, 1.0), (2, 0, 1.0, 3.0), (3, 0, 2.0, -1.0)],
                               "id long, g int, m double, vx double")
    r = P.weighted_vector_sum(df, ["g"], "id", "m", ["vx"]).first()
    assert r.anchor_id == 1 and r.p0 == pytest.approx(1.0) and r.anchor_v0 == pytest.approx(-0.5)


def test_cutoff_equals_brute_force(spark):
    rows = _bodies(60)
    df = spark.createDataFrame(rows, "id long, g int, x double, y double, z double, vx double, m double")
    for cutoff in (0.3, 1.1, 50.0):
        got = {r.g: (r.potential, r.n_pairs) for r in P.pair_potential(df, ["g"], "id", "x", "y", "z", "m", tile=8, cutoff=cutoff).collect()}
        for g in (0, 1):
            near = [(a[6] * b[6] / math.dist(a[2:5], b[2:5])) for a, b in itertools.combinations([r for r in rows if r[1] == g], 2)
                    if math.dist(a[2:5], b[2:5]) <= cutoff]
            assert got[g][1] == len(near) and got[g][0] == pytest.approx(sum(near), rel=1e-12)


def test_measured_size_counts_arrays(spark):
    from benchlens.operators.joins import measured_bytes
    small = spark.createDataFrame([(1, [1.5])], "k long, v array<double>")
    large = spark.createDataFrame([(1, [1.5] * 10000)], "k long, v array<double>")
    assert measured_bytes(large) > 80_000 > 1000 > measured_bytes(small)
