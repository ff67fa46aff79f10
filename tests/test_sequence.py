import random

import numpy as np
import pytest

from benchlens.operators.compare import align_results
from benchlens.operators.sequence import _growth, _lengths, align_sequence, lcs_matches, lcs_of_pieces, lcs_pairs, sweep


def _lcs_len(a, b):
    dp = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            dp[i + 1][j + 1] = dp[i][j] + 1 if a[i] == b[j] else max(dp[i][j + 1], dp[i + 1][j])
    return dp[-1][-1]


@pytest.mark.parametrize("seed", range(25))
def test_lcs_pairs_are_a_longest_common_subsequence(seed):
    rnd = random.Random(seed)
    alphabet = "abcdefgh"[: rnd.randint(2, 8)]
    a = [rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))]
    b = [rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))]
    pairs = lcs_pairs(a, b)
    assert len(pairs) == _lcs_len(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_moved_row_becomes_two_orphans(spark):
    s = "block string, program string, o int, cpu double, r2 double"
    a = spark.createDataFrame([("b", "x", 1, 1.0, 1.0), ("b", "y", 2, 1.0, 1.0), ("b", "z", 3, 1.0, 1.0)], s)
    b = spark.createDataFrame([("b", "y", 1, 2.0, 1.0), ("b", "z", 2, 2.0, 1.0), ("b", "x", 3, 2.0, 1.0)], s)
    got = sorted((r.program, r.side) for r in align_sequence(a, b, "o").collect())
    assert got == [("x", "first"), ("x", "second"), ("y", "both"), ("z", "both")]


def test_same_order_equals_key_alignment(spark):
    s = "block string, program string, o int, cpu double, r2 double"
    rows_a = [("b1", f"p{i}", i, float(i + 1), 0.99) for i in range(30) if i % 4 != 0]
    rows_b = [("b1", f"p{i}", i, float(i + 2), 0.99) for i in range(30) if i % 5 != 0] + [("b2", "q", 1, 1.0, 1.0)]
    a, b = spark.createDataFrame(rows_a, s), spark.createDataFrame(rows_b, s)
    seq = {(r.block, r.program, r.side, r.ratio) for r in align_sequence(a, b, "o").collect()}
    key = {(r.block, r.program, r.side, r.ratio) for r in align_results(a, b).collect()}
    assert seq == key


def test_alignment_lcs_length_per_block_equals_brute_force(spark):
    rnd = random.Random(11)
    rows_a, rows_b, exp = [], [], {}
    for blk in range(12):
        keys = [f"k{i}" for i in range(rnd.randint(1, 15))]
        if blk % 3 == 0:      # same order on both sides, with duplicates
            sa = [rnd.choice(keys) for _ in range(rnd.randint(0, 25))]
            sb = [x for x in sa if rnd.random() < 0.8]
        else:                 # shuffled
            sa = [rnd.choice(keys) for _ in range(rnd.randint(0, 25))]
            sb = [rnd.choice(keys) for _ in range(rnd.randint(0, 25))]
        rows_a += [(f"b{blk}", k, i, 1.0, 1.0) for i, k in enumerate(sa)]
        rows_b += [(f"b{blk}", k, i, 2.0, 1.0) for i, k in enumerate(sb)]
        exp[f"b{blk}"] = (_lcs_len(sa, sb), len(sa), len(sb))
    s = "block string, program string, o int, cpu double, r2 double"
    out = align_sequence(spark.createDataFrame(rows_a, s), spark.createDataFrame(rows_b, s), "o").collect()
    for blk, (n, na, nb) in exp.items():
        rs = [r for r in out if r.block == blk]
        pairs = sorted((r.pos1, r.pos2) for r in rs if r.side == "both")
        assert len(pairs) == n
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert sum(r.side != "second" for r in rs) == na and sum(r.side != "first" for r in rs) == nb


def test_only_the_swapped_piece_goes_to_python(spark):
    from benchlens.operators.sequence import pieces
    n = 400
    a = spark.createDataFrame([("b", f"k{i}", i) for i in range(n)], "block string, program string, pos long")
    order = list(range(n))
    order[100], order[101] = order[101], order[100]
    b = spark.createDataFrame([("b", f"k{k}", i) for i, k in enumerate(order)], "block string, program string, pos long")
    got = pieces(a, b).where("n_keys > 1").collect()
    assert sorted(r.program for r in got) == ["k100", "k101"]


def test_pieces_add_up_to_the_whole_lcs(spark):
    import random
    rnd = random.Random(8)
    rows_a, rows_b, want = [], [], {}
    for t in range(12):
        ka = [rnd.choice("abcdefghij") + str(i // 6) for i in range(rnd.randint(0, 40))]
        kb = [x for x in ka if rnd.random() < 0.8]
        for _ in range(3):
            if len(kb) > 2:
                i = rnd.randrange(len(kb) - 1)
                kb[i], kb[i + 1] = kb[i + 1], kb[i]
        want[f"t{t}"] = len(lcs_pairs(ka, kb))
        rows_a += [(f"t{t}", k, i, float("nan") if i % 5 == 0 else 1.0, None if i % 3 == 0 else 0.9) for i, k in enumerate(ka)]
        rows_b += [(f"t{t}", k, i, 2.0, 0.9) for i, k in enumerate(kb)]
    s = "block string, program string, o long, cpu double, r2 double"
    got = align_sequence(spark.createDataFrame(rows_a, s), spark.createDataFrame(rows_b, s), order="o").collect()
    assert len(got) == len(rows_a) + len(rows_b) - sum(want.values())
    for t, n in want.items():
        both = sorted((r.pos1, r.pos2) for r in got if r.block == t and r.side == "both")
        assert len(both) == n and all(x[1] < y[1] for x, y in zip(both, both[1:]))
    values = {(t, i): (c, q) for t, _, i, c, q in rows_a}
    for r in got:
        if r.pos1 is not None:
            c, q = values[r.block, r.pos1]
            assert (r.r2_1, r.cpu1 != r.cpu1) == (q, c != c)


def _matches(pairs, a, b):
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    return len(pairs)


def test_tiles_give_the_lengths_of_the_whole_table():
    rnd = random.Random(3)
    for _ in range(60):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(1, 30))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(1, 30))]
        cut = rnd.randint(1, len(b))
        left, steps = sweep(a, b[:cut], (1 << cut) - 1, np.zeros(len(a), np.uint8))
        right, _ = sweep(a, b[cut:], (1 << len(b) - cut) - 1, steps) if cut < len(b) else (0, None)
        grows = np.concatenate([_growth(left, cut), _growth(right, len(b) - cut) if cut < len(b) else []])
        assert [int(x) for x in _lengths(grows)] == [_lcs_len(a, b[:j]) for j in range(len(b) + 1)]


def test_matches_of_repeated_keys_equal_brute_force(monkeypatch):
    from benchlens.operators import sequence
    rnd = random.Random(4)
    for most in (0, 2, 50):
        monkeypatch.setattr(sequence, "_MOST_PAIRS", most)
        for _ in range(40):
            a = [rnd.choice("aab") for _ in range(rnd.randint(0, 40))]
            b = [rnd.choice("abc") for _ in range(rnd.randint(0, 40))]
            assert _matches(lcs_matches(a, b), a, b) == _lcs_len(a, b)


@pytest.mark.parametrize("strip", [3, 8, 1000])
def test_strips_of_a_shuffled_block_equal_brute_force(spark, strip):
    rnd = random.Random(strip)
    sides, rows = {}, ([], [])
    for t in range(7):
        keys = [f"k{i}" for i in range(rnd.choice([3, 12, 40]))]
        a = keys * rnd.choice([1, 1, 2])
        b = [k for k in keys if rnd.random() < 0.9] * rnd.choice([1, 2])
        rnd.shuffle(a)
        rnd.shuffle(b)
        a, b = (a, b) if t else (a, b[:2])  # one side much shorter
        sides[f"t{t}"] = a, b
        for out, ks in zip(rows, (a, b)):
            out += [(f"t{t}", 0, k, 10 * i) for i, k in enumerate(ks)]
    s = "block string, piece long, program string, pos long"
    got = lcs_of_pieces(spark.createDataFrame(rows[0], s), spark.createDataFrame(rows[1], s), strip).collect()
    for t, (a, b) in sides.items():
        pairs = sorted((r.pos1 // 10, r.pos2 // 10) for r in got if r.block == t)
        assert _matches(pairs, a, b) == _lcs_len(a, b), t


def test_alignment_in_strips_equals_the_one_of_one_strip(spark):
    rnd = random.Random(6)
    order = list(range(120))
    rnd.shuffle(order)
    s = "block string, program string, o long, cpu double, r2 double"
    a = spark.createDataFrame([("b", f"k{i}", i, 1.0, 1.0) for i in range(120)], s)
    b = spark.createDataFrame([("b", f"k{k}", i, 2.0, 1.0) for i, k in enumerate(order)], s)
    n = {strip: align_sequence(a, b, "o", strip=strip).where("side = 'both'").count() for strip in (30, 1000)}
    assert n[30] == n[1000] == len(lcs_pairs(list(range(120)), order))


def test_pairs_sweep_as_the_bits_do():
    from benchlens.operators import sequence
    rnd = random.Random(5)
    for _ in range(300):
        width = rnd.randint(1, 70)
        a = [rnd.choice("abcdefgh"[:rnd.randint(1, 8)]) for _ in range(rnd.randint(1, 50))]
        where = {}
        for j in range(width):
            where.setdefault(rnd.choice("abcdefghij"), []).append(j)
        flat, steps = rnd.getrandbits(width), np.array([rnd.randint(0, 1) for _ in a], np.uint8)
        pairs, bits = (f(a, where, width, flat, steps) for f in (sequence._sweep_pairs, sequence._sweep_bits))
        assert pairs[0] == bits[0] and pairs[1].tolist() == bits[1].tolist()


def test_diagonals_do_not_grow_with_the_rows(spark, monkeypatch):
    """Short strips of a long side are lengthened: a job for each diagonal of strips would not end."""
    from benchlens.operators import sequence
    rounds, swept = [], sequence._swept
    monkeypatch.setattr(sequence, "_swept", lambda a, b, shape, n: rounds.append(n) or swept(a, b, shape, n))
    order = list(range(400))
    random.Random(2).shuffle(order)
    s = "block string, piece long, program string, pos long"
    one, two = (spark.createDataFrame([("b", 0, f"k{k}", i) for i, k in enumerate(ks)], s) for ks in (range(400), order))
    got = sorted((r.pos1, r.pos2) for r in lcs_of_pieces(one, two, 5).collect())
    assert _matches(got, list(range(400)), order) == len(lcs_pairs(list(range(400)), order))
    assert rounds == [2 * sequence.MOST_STRIPS - 1]
    assert [sequence.strip_size(100, n) for n in (50, 1000, 10**6)] == [100, 250, sequence.STRIP]


def test_cuts_need_no_frame_to_the_end(spark):
    """Spark computes such a frame anew for each row, which is quadratic in the keys of a bucket."""
    from benchlens.operators.sequence import pieces
    a = spark.createDataFrame([("b", f"k{i}", i) for i in range(9)], "block string, program string, pos long")
    out = pieces(a, a.select("block", "program", "pos"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "rowframe, 1, unboundedfollowing" not in plan.lower()
