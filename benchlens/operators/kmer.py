"""k-mer frequencies over text or chunked long sequences.

Counting adds up each task's k-mers in Arrow batches -> shuffle on the k-mer ->
final aggregate, so the shuffle carries few rows per (group, k-mer) and task. Long sequences stored as numbered chunks of any
lengths are dealt anew into blocks with k-1 following characters, so no
sequence has to fit one row or one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.functions.scalar import upper_chars
from benchlens.operators.joins import group_join
from benchlens.operators.matching import count_patterns
from benchlens.operators.ordered import materialize, running, top_n_per_group
from benchlens.session import target_partitions


PIECE = 65_536  # characters of a text that are expanded into k-mers at once
CELL_BITS = 12  # low bits of a chunk's number, inside which neighbouring chunks are joined
STRETCH = 64  # most k-mers in one run of a shared minimizer
_AT_ONCE = 131_072  # k-mers that are counted at once behind the shuffle
_HELD = 8 << 20  # bytes of text whose runs a task packs at once
_MOST_GROUPS = 4_096  # groups that a task packs at once
_BUCKETS = 1_024  # least number of buckets of minimizers
_PARTS = np.uint64(256)  # parts of a bucket
_LEVEL = 1  # of compression
_MOST_COUNTS = 500_000  # different k-mers that a task holds before it passes their counts on


def sequence_text(c: Column | str) -> Column:
    """The text as one upper-case sequence: only line breaks are taken out."""
    c = F.col(c) if isinstance(c, str) else c
    return upper_chars(F.regexp_replace(c, "[\r\n]", ""))


def all_kmers(seq: Column, k: int) -> Column:
    """Array of every overlapping k-mer of ``seq``, in order, in one linear regex pass.

    A zero-width look-ahead match at each character captures the next k
    characters (never from inside a character outside the basic plane); texts
    shorter than k give an empty array. (Position-wise ``substring`` would
    rescan the UTF-8 text from its start for every k-mer.)
    """
    if k == 1:  # the characters themselves
        return F.when(seq != "", F.split(seq, F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.regexp_extract_all(seq, F.lit("(?s)(?![\\uDC00-\\uDFFF])(?=(.{%d}))" % k), 1)


def pieces(seq: Column, k: int, size: int = PIECE) -> Column:
    """``seq`` cut into pieces of ``size`` characters, each with the k-1 characters that follow it."""
    pattern = F.lit("(?s)(.{1,%d})(?=(.{0,%d}))" % (size, k - 1))
    cut = F.zip_with(F.regexp_extract_all(seq, pattern, 1), F.regexp_extract_all(seq, pattern, 2), lambda a, b: F.concat(a, b))
    return F.when(F.length(seq) <= size, F.array(seq)).otherwise(cut)


def kmer_counts(df: DataFrame, text: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., kmer, n): count of every k-mer of ``text`` (per row, no cross-row k-mers)."""
    return kmer_counts_multi(df, text, [k], by).drop("k")


def _coded(part: str, k: int) -> tuple[list[int], list[int]]:
    """The different k-mers of a text (k up to 3) as numbers of 21 bits a character, and their counts."""
    points = np.frombuffer(part.encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = points.size - k + 1
    codes = points[:n]
    for i in range(1, k):
        codes = codes << np.uint64(21) | points[i:i + n]
    found, times = np.unique(codes, return_counts=True)
    return found.tolist(), times.tolist()


def _decoded(code: int, k: int) -> str:
    return "".join(chr(code >> 21 * i & 0x1FFFFF) for i in range(k - 1, -1, -1))


def kmer_counts_multi(df: DataFrame, text: str, ks: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """(by..., k, kmer, n) for several sizes, from one pass over the texts.

    Every task adds up its own counts before the shuffle and passes them on
    when they grow too many.
    """
    by = list(by)
    schema = T.StructType([*[df.schema[c] for c in by], T.StructField("k", T.IntegerType()), T.StructField("kmer", T.StringType()),
                           T.StructField("n", T.LongType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        types: list[pa.DataType] = []

        def rows() -> Iterator[pa.RecordBatch]:
            for (*group, k), own in counts.items():
                fixed = [pa.array([g] * len(own), t) for g, t in zip([*group, k], types)]
                kmers = [_decoded(c, k) for c in own] if k <= 3 else list(own)
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(kmers, pa.string()), pa.array(list(own.values()), pa.int64())],
                                                 names=schema.names)
            counts.clear()

        for b in batches:
            types = [*[b.schema.field(i).type for i in range(len(by))], pa.int32()]
            groups = list(zip(*[b.column(i).to_pylist() for i in range(len(by))])) if by else [()] * b.num_rows
            for group, value in zip(groups, b.column(len(by))):
                seq = value.as_py() or ""
                for k in ks:
                    own = counts.setdefault((*group, k), Counter())
                    for at in range(0, len(seq) - k + 1, PIECE):
                        part = seq[at:at + PIECE + k - 1]
                        if k <= 3:
                            for code, n in zip(*_coded(part, k)):
                                own[code] += n
                        else:
                            own.update(map("".join, zip(*[part[i:] for i in range(k)])))
            if sum(map(len, counts.values())) > _MOST_COUNTS:
                yield from rows()
        yield from rows()

    got = df.select(*by, F.col(text).cast("string").alias("_text")).mapInArrow(work, schema)
    return got.groupBy(*by, "k", "kmer").agg(F.sum("n").alias("n"))


def with_share(counts: DataFrame, by: Sequence[str] = (), n: str = "n", out: str = "pct") -> DataFrame:
    """Percent of the group's total (the reference's length - k + 1 when all k-mers count).

    Group totals are a separate small aggregate joined back on the group keys
    (no window over a whole group; null keys are a group); a single total is a
    scalar subquery.
    """
    if not by:  # one total: a scalar subquery, no join
        return counts.withColumn(out, F.lit(100.0) * F.col(n) / counts.agg(F.sum(n)).scalar())
    tot = counts.groupBy(*by).agg(F.sum(n).alias("_tot"))
    return (group_join(counts, tot, by)
            .withColumn(out, F.lit(100.0) * F.col(n) / F.col("_tot")).drop("_tot"))


def kmer_freq(df: DataFrame, text: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    """k-mer counts with their share in percent, per group."""
    return with_share(kmer_counts(df, text, k, by), by)


def top_kmers(freq: DataFrame, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Top n per group by count desc, then k-mer asc (tasks cut to n before the shuffle)."""
    return top_n_per_group(freq, by, [F.col("n").desc(), F.col("kmer").asc()], n)


def _hashes(points: np.ndarray, m: int) -> np.ndarray:
    """The hash of each m-mer, of sums that are doubled in width or made one wider."""
    odd = 0x9E3779B97F4A7C15
    mixed, wide = points + np.uint64(1), 1
    for bit in bin(m)[3:]:
        mixed = mixed[:-wide] * np.uint64(pow(odd, wide, 1 << 64)) + mixed[wide:]
        wide *= 2
        if bit == "1":
            mixed = mixed[:-1] * np.uint64(odd) + points[wide:]
            wide += 1
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed


def _least(x: np.ndarray, most: int) -> np.ndarray:
    """The least of each ``most`` neighbours, by doubling."""
    wide = 1
    while wide < most:
        step = min(wide, most - wide)
        x = np.minimum(x[:-step], x[step:])
        wide += step
    return x


def _least_hashes(points: np.ndarray, k: int, m: int) -> np.ndarray:
    """The hash of the minimizer of each k-mer, the first of its m-mers in an order by hash (``points``: k characters at least).

    M-mers whose own least s-mer (a third as long) is the middle one come first, then those where it is the first or last: such
    m-mers are rarely near each other, so longer runs of k-mers share one.
    """
    size = max(1, m // 3)
    short, n = _hashes(points, size), points.size - m + 1
    least = _least(short, m - size + 1)
    middle, last = (m - size) // 2, m - size
    late = (short[middle:middle + n] != least).astype(np.uint64)
    late += (late != 0) & (short[:n] != least) & (short[last:last + n] != least)
    return _least(_hashes(points, m) >> np.uint64(2) | late << np.uint64(62), k - m + 1)


def _stretches(least: np.ndarray, whole: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First k-mer and number of k-mers of each run of ``whole`` ones with one hash, at most ``STRETCH`` in one and none over ``ends``."""
    change = np.ones(least.size + 1, bool)
    change[1:-1] = (least[1:] != least[:-1]) | ~whole[1:] | ~whole[:-1]
    change[ends[ends < least.size]] = True
    borders = np.flatnonzero(change)
    starts, sizes = borders[:-1], np.diff(borders)
    starts, sizes = starts[whole[starts]], sizes[whole[starts]]
    if sizes.size and sizes.max() > STRETCH:
        parts = -(-sizes // STRETCH)
        place = STRETCH * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        starts = np.repeat(starts, parts) + place
        sizes = np.minimum(np.repeat(sizes, parts) - place, STRETCH)
    return starts, sizes


def minimizer_runs(seq: str, k: int, m: int) -> list[tuple[int, str]]:
    """(minimizer's hash, characters) of each run of neighbouring k-mers that share their minimizer, at most ``STRETCH`` in one."""
    points = np.frombuffer(seq.encode("utf-32-le"), "<u4").astype(np.uint64)
    if points.size < k:
        return []
    least = _least_hashes(points, k, m)
    starts, sizes = _stretches(least, np.ones(least.size, bool), np.zeros(0, np.int64))
    return [(b, seq[s:s + n + k - 1]) for b, s, n in zip(least[starts].view(np.int64).tolist(), starts.tolist(), sizes.tolist())]


def _between(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions begin, begin + 1, ... of each range, one range after the other."""
    ends = np.cumsum(size)
    steps = np.ones(ends[-1] if size.size else 0, np.int64)
    if size.size:
        steps[0] = begin[0]
        steps[ends[:-1]] = begin[1:] - begin[:-1] - size[:-1] + 1
    return np.cumsum(steps, out=steps)


def _utf8(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and where each begins and ends in them."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    return raw, bounds - bounds[0]


def _windows(raw: np.ndarray, bounds: np.ndarray, k: int, m: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of the texts in ``raw``, some ``PIECE`` bytes at once, as (from byte, to byte, starts, sizes, minimizers' hashes, runs' hashes).

    Starts (in bytes, from the window's first) and sizes (in bytes) are those of the runs; none reaches over a text's end.
    """
    power = np.cumprod(np.append(np.uint64(1), np.full(PIECE + 4 * k + 8, 0x9E3779B97F4A7C15, np.uint64)))
    back = np.cumprod(np.append(np.uint64(1), np.full(PIECE + 4 * k + 8, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)))

    def border(at: int) -> int:  # of a character
        while 0 < at < raw.size and raw[at] & 0xC0 == 0x80:
            at -= 1
        return min(at, raw.size)

    low, high = 0, 0
    while high < raw.size:
        low, high = high, border(high + max(PIECE, 4))
        end = border(high + 4 * k)
        points = np.frombuffer(raw[low:end].tobytes().decode().encode("utf-32-le"), "<u4").astype(np.uint64)
        if points.size < k:
            continue
        at = np.append(np.flatnonzero((raw[low:end] & 0xC0) != 0x80), end - low)  # byte of each character
        least = _least_hashes(points, k, m)[:np.searchsorted(at, high - low)]
        ends = np.searchsorted(at, bounds[np.searchsorted(bounds, low, "right"):np.searchsorted(bounds, end, "right")] - low)
        over = np.bincount(np.clip(ends - k + 1, 0, least.size), minlength=least.size + 1)
        over -= np.bincount(np.minimum(ends, least.size), minlength=least.size + 1)
        starts, sizes = _stretches(least, np.cumsum(over)[:-1] == 0, ends)
        if not starts.size:
            continue
        sums = np.append(np.uint64(0), np.cumsum(points * power[:points.size]))
        own = (sums[starts + sizes + k - 1] - sums[starts]) * back[starts]
        yield low, end, at[starts], at[starts + sizes + k - 1] - at[starts], least[starts], own


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers as their lowest bytes, then the next and so on."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _packed(batches: Iterable[pa.RecordBatch], by: int, k: int, m: int, buckets: int, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows (by..., text) as (by..., bucket, rows, size, about, runs): the different runs of some ``_HELD`` bytes of text, one row for each bucket.

    ``runs`` has the characters in the order of the parts, ``about`` for each run the step to its part of the bucket, its size and
    how often it occurs; both are compressed.
    """
    held: list[tuple[np.ndarray, ...]] = []
    groups: dict[tuple, int] = {}
    types: list[pa.DataType] = []
    packer = pa.Codec("zstd", _LEVEL)
    size = 0

    def found() -> Iterator[tuple[int, int, int, int, bytes, bytes]]:
        """(group, bucket, rows, size, about, runs)"""
        bases = np.cumsum([0, *[w[0].size for w in held]])
        raw = np.concatenate([w[0] for w in held])
        start = np.concatenate([w[1] + base for w, base in zip(held, bases.astype(np.uint32))])
        sizes, part, own = (np.concatenate([w[i] for w in held]) for i in (2, 3, 4))
        held.clear()
        n = start.size
        least_bits, part_bits = n.bit_length(), int(part.max()).bit_length()
        spare = 64 - part_bits - least_bits
        if part_bits and spare > 0:  # by part, equal runs beside each other, as one number
            order = part << np.uint64(64 - part_bits) | own >> np.uint64(64 - spare) << np.uint64(least_bits) | np.arange(n, dtype=np.uint64)
            order.sort()
            order = (order & np.uint64((1 << least_bits) - 1)).view(np.int64)
        else:
            order = np.lexsort((own, part))
        start, sizes, part, own = (x[order] for x in (start, sizes, part, own))
        new = np.ones(n, bool)
        new[1:] = (own[1:] != own[:-1]) | (sizes[1:] != sizes[:-1]) | (part[1:] != part[:-1])
        for some in np.array_split(like := np.flatnonzero(~new), like.size // 65_536 + 1):  # one hash: compared
            if some.size:
                size, one, other = (x.astype(np.int64) for x in (sizes[some], start[some], start[some - 1]))
                new[some] = np.logical_or.reduceat(raw[_between(one, size)] != raw[_between(other, size)], np.cumsum(size) - size)
        first = np.flatnonzero(new)
        start, sizes, part, times = start[first].astype(np.int64), sizes[first].astype(np.int64), part[first], np.diff(first, append=n)
        borders = np.flatnonzero(np.append(True, part[1:] // _PARTS != part[:-1] // _PARTS))
        for s, e in zip(borders.tolist(), [*borders[1:].tolist(), first.size]):
            chars = raw[_between(start[s:e], sizes[s:e])]
            steps = np.diff((part[s:e] % _PARTS).astype(np.uint8), prepend=np.uint8(0))
            about = b"".join([steps.tobytes(), _planes(sizes[s:e]), _planes(times[s:e])])
            yield (*divmod(int(part[s]) // int(_PARTS), buckets), e - s, chars.size, packer.compress(about, asbytes=True),
                   packer.compress(chars, asbytes=True))

    def rows() -> Iterator[pa.RecordBatch]:
        names, some = list(groups), []

        def batch() -> pa.RecordBatch:
            group, *columns = zip(*some)
            keys = list(zip(*[names[g] for g in group]))
            some.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*keys, *columns], [*types, *[pa.int32()] * 3, *[pa.binary()] * 2])],
                                              names=schema.names)

        for row in found() if held else ():
            some.append(row)
            if len(some) >= 128:
                yield batch()
        if some:
            yield batch()
        groups.clear()

    for b in batches:
        types = [b.schema.field(i).type for i in range(by)]
        raw, bounds = _utf8(b.column(by))
        keys = list(zip(*[b.column(i).to_pylist() for i in range(by)])) if by else [()]
        own = np.zeros(0, np.uint64)
        for low, end, start, sizes, least, hashes in _windows(raw, bounds, k, m):
            part = (least >> np.uint64(8)) % np.uint64(buckets) * _PARTS + least % _PARTS
            if by:
                of = np.searchsorted(bounds, start + low, "right") - 1
                near = range(int(of[0]), int(of[-1]) + 1)
                own = np.array([groups.setdefault(keys[i], len(groups)) for i in near], np.uint64)
                part += own[of - near[0]] * np.uint64(buckets) * _PARTS
            else:
                groups.setdefault((), 0)
            held.append((raw[low:end].copy(), start.astype(np.uint32), sizes.astype(np.uint32), part, hashes))
            size += end - low
            if size >= _HELD or len(groups) > _MOST_GROUPS:
                yield from rows()
                size = 0
    yield from rows()


def _shares(sizes: np.ndarray, most: int) -> list[int]:
    """Borders that cut ``sizes`` into neighbours of about ``most`` in all."""
    share = (np.cumsum(sizes) - 1) // most
    return [*np.flatnonzero(np.append(True, share[1:] != share[:-1])).tolist(), sizes.size]


def _unpacked(batches: Iterable[pa.RecordBatch], by: int) -> Iterator[pa.RecordBatch]:
    """Packed rows, sorted by the first ``by`` columns and bucket, as rows (by..., bucket, run, c); a bucket comes in some parts."""
    packer = pa.Codec("zstd")
    held: list[tuple[np.ndarray, ...]] = []
    own: tuple | None = None
    types: list[pa.DataType] = []

    def batch(part: int, some: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        sizes, times, chars = (np.concatenate(x) for x in zip(*some))
        bounds = np.append(0, np.cumsum(sizes)).astype(np.int32)
        return pa.RecordBatch.from_arrays([
            *[pa.array([v] * sizes.size, t) for v, t in zip(own, types)], pa.array(np.full(sizes.size, own[-1] * int(_PARTS) + part, np.int64)),
            pa.StringArray.from_buffers(sizes.size, pa.py_buffer(bounds), pa.py_buffer(chars)), pa.array(times.astype(np.int64))],
            names=[*[f"_{i}" for i in range(by)], "bucket", "run", "c"])

    def runs() -> Iterator[pa.RecordBatch]:
        cuts = _shares(sum(np.bincount(part, weights=np.diff(ends), minlength=int(_PARTS)) for part, ends, _, _ in held), 2 * _AT_ONCE)
        places = [np.searchsorted(part, cuts).tolist() for part, *_ in held]
        for i, low in enumerate(cuts[:-1]):
            some, size = [], 0
            for place, (_, ends, times, chars) in zip(places, held):
                for at in range(place[i], place[i + 1], _AT_ONCE):
                    to = min(place[i + 1], at + _AT_ONCE)
                    some.append((np.diff(ends[at:to + 1]), times[at:to], chars[ends[at]:ends[to]]))
                    size += some[-1][2].size
                    if size > 8 * _AT_ONCE:  # many runs in one part
                        yield batch(low, some)
                        some, size = [], 0
            if some:
                yield batch(low, some)
        held.clear()

    for b in batches:
        types = [b.schema.field(i).type for i in range(by)]
        for i, (*key, n, size) in enumerate(zip(*[c.to_pylist() for c in b.columns[:-2]])):
            if held and tuple(key) != own:
                yield from runs()
            own = tuple(key)
            about, chars = (c[i].as_buffer() for c in b.columns[-2:])
            data = np.frombuffer(packer.decompress(about, 9 * n), np.uint8)
            sizes, times = (np.ascontiguousarray(data[n * j:n * (j + 4)].reshape(4, n).T).view("<u4").ravel() for j in (1, 5))
            held.append((np.cumsum(data[:n], dtype=np.uint8), np.append(0, np.cumsum(sizes)).astype(np.int32), times,
                         np.frombuffer(packer.decompress(chars, size), np.uint8)))
    if held:
        yield from runs()


def _characters(runs: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """The bytes and characters of ``runs``, the byte of each character (none if all have one) and the first character of each run."""
    raw, bounds = _utf8(runs)
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
    if points.size == raw.size:
        return raw, points, None, bounds
    lead = (raw & 0xC0) != 0x80
    return raw, points, np.append(np.flatnonzero(lead), raw.size), np.append(0, np.cumsum(lead))[bounds]


def _sums(runs: pa.StringArray, times: np.ndarray, k: int) -> tuple[pa.StringArray, np.ndarray]:
    """The different k-mers of ``runs`` (each of k characters at least) and how often they occur; a run counts ``times``."""
    raw, points, at, of_run = _characters(runs)
    found = np.flatnonzero(np.bincount(points))
    codes = np.zeros(int(found[-1]) + 1, np.uint64)
    codes[found] = np.arange(found.size, dtype=np.uint64)
    bits = max(1, (found.size - 1).bit_length())
    wide, word = 1, codes[points]  # ``wide`` neighbouring characters as one number, by doubling
    most = min(k, 64 // bits)
    while wide < most:
        step = min(wide, most - wide)
        rest = word[step:] if step == wide else word[step:] & np.uint64((1 << bits * step) - 1)
        word = word[:word.size - step] << np.uint64(bits * step) | rest
        wide += step
    n = np.diff(of_run) - (k - 1)
    starts = _between(of_run[:-1], n)
    words = [word[starts + j if j else starts] for j in sorted({*range(0, k - wide + 1, wide), k - wide})]
    mixed = np.zeros(starts.size, np.uint64)
    for w in words:
        mixed = (mixed ^ w) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    places = np.uint64((starts.size - 1).bit_length())  # a hash and a place in one number: sorted without a second array
    mixed = mixed * np.uint64(0xBF58476D1CE4E5B9) >> places << places | np.arange(starts.size, dtype=np.uint64)
    mixed.sort()
    order = (mixed & np.uint64((1 << int(places)) - 1)).astype(np.int64)
    mixed >>= places
    new = np.ones(order.size, bool)
    new[1:] = mixed[1:] != mixed[:-1]
    like = np.flatnonzero(~new)
    if any((w[order[like]] != w[order[like - 1]]).any() for w in words):  # different k-mers of one hash
        order = np.lexsort(words)
        new[1:] = False
        for w in words:
            w = w[order]
            new[1:] |= w[1:] != w[:-1]
    first = np.flatnonzero(new)
    sums = np.diff(first, append=order.size) if (times == 1).all() else np.add.reduceat(np.repeat(times, n)[order], first)
    begin = starts[order[first]]
    if at is None:
        data, bounds = _items(raw, begin, k), np.arange(0, k * first.size + 1, k)
    else:
        begin, size = at[begin], at[begin + k] - at[begin]
        alike = np.argsort(size.astype(np.uint16), kind="stable")  # k-mers of as many bytes together
        begin, size, sums = begin[alike], size[alike], sums[alike]
        bounds = np.append(0, np.cumsum(size))
        borders = np.flatnonzero(np.append(True, size[1:] != size[:-1])).tolist()
        data = np.concatenate([_items(raw, begin[s:e], int(size[s])) for s, e in zip(borders, [*borders[1:], size.size])])
    return pa.StringArray.from_buffers(first.size, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)), sums


def _items(raw: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes from each of the places ``begin``, one after the other."""
    return np.ndarray((raw.size - size + 1,), f"V{size}", raw, strides=(1,))[begin].view(np.uint8)


def _changes(b: pa.RecordBatch, columns: int) -> np.ndarray:
    """Rows at which the first ``columns`` columns differ from the row before; the first row is one."""
    new = np.zeros(b.num_rows, bool)
    new[:1] = True
    for i in range(columns):
        codes = b.column(i).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _dealt(runs: pa.StringArray, times: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray]:
    """The k-mers of ``runs`` by a byte of their hash: the bytes, where each begins, their sizes and times if not all k and 1, and borders."""
    raw, points, at, of_run = _characters(runs)
    n = np.diff(of_run) - (k - 1)
    starts = _between(of_run[:-1], n)
    kind = (_hashes(points.astype(np.uint64), k)[starts] >> np.uint64(56)).astype(np.uint8)
    order = np.argsort(kind, kind="stable")
    starts = starts[order]
    begin, size = (starts, None) if at is None else (at[starts], (at[starts + k] - at[starts]).astype(np.uint32))
    times = None if (times == 1).all() else np.repeat(times, n)[order]
    return raw, begin.astype(np.uint32), size, times, np.append(0, np.cumsum(np.bincount(kind, minlength=256)))


def _dealt_sums(dealt: list[tuple], k: int) -> Iterator[tuple[pa.StringArray, np.ndarray]]:
    """``_sums`` of dealt k-mers, about ``_AT_ONCE`` at a time."""
    cuts = _shares(sum(np.diff(borders) for *_, borders in dealt), _AT_ONCE)
    for low, high in zip(cuts, cuts[1:]):
        some = []
        for raw, begin, size, times, borders in dealt:
            own = slice(borders[low], borders[high])
            at = begin[own].astype(np.int64)
            sizes = np.full(at.size, k) if size is None else size[own].astype(np.int64)
            some.append((_items(raw, at, k) if size is None else raw[_between(at, sizes)], sizes, np.ones(at.size, np.int64) if times is None else times[own]))
        data, sizes, times = (np.concatenate(x) for x in zip(*some))
        if sizes.size:
            bounds = np.append(0, np.cumsum(sizes)).astype(np.int32)
            yield _sums(pa.StringArray.from_buffers(sizes.size, pa.py_buffer(bounds), pa.py_buffer(data)), times, k)


def _counted(batches: Iterable[pa.RecordBatch], by: int, k: int, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows (by..., bucket, run, c), sorted by the first ``by`` columns and bucket, as (by..., kmer, n)."""
    held: list[pa.RecordBatch] = []
    size = 0
    large: list[tuple] = []  # dealt k-mers of a bucket that is too large to be counted at once
    first: pa.RecordBatch | None = None  # its first row

    def rows(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        starts = _changes(b, by) if b.num_rows else np.zeros(0, np.int64)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
            yield labelled(b.slice(s, 1), *_sums(b.column(by + 1).slice(s, e - s), b.column(by + 2).slice(s, e - s).to_numpy(), k))

    def labelled(row: pa.RecordBatch, kmers: pa.StringArray, n: np.ndarray) -> pa.RecordBatch:
        place = pa.array(np.zeros(len(kmers), np.int64))
        return pa.RecordBatch.from_arrays([*[row.column(i).take(place) for i in range(by)], kmers, pa.array(n)], names=schema.names)

    for b in chain(batches, [None]):
        if b is not None and b.num_rows:
            held.append(b)
            size += len(b.column(by + 1).buffers()[2] or b"") // 4  # a run's k-mers are about a fourth of its characters
        if b is not None and size < _AT_ONCE or not held and not large:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if held else first.slice(1)
        held, size = [], 0
        if large:
            own = pa.Table.from_batches([first, whole]).combine_chunks().to_batches()[0]
            more = int(np.append(_changes(own, by + 1), own.num_rows)[1]) - 1  # rows of the same bucket
            if more:
                large.append(_dealt(whole.column(by + 1).slice(0, more), whole.column(by + 2).slice(0, more).to_numpy(), k))
            whole = whole.slice(more)
            if whole.num_rows or b is None:
                for kmers, n in _dealt_sums(large, k):
                    yield labelled(first, kmers, n)
                large = []
        if not whole.num_rows:
            continue
        cut = whole.num_rows if b is None else int(_changes(whole, by + 1)[-1])
        yield from rows(whole.slice(0, cut))  # all but the last bucket are complete
        rest = whole.slice(cut)
        if cut and rest.num_rows:
            held = [rest.take(pa.array(np.arange(rest.num_rows)))]
            size = len(held[0].column(by + 1).buffers()[2] or b"") // 4
        elif rest.num_rows:  # one bucket only
            first = rest.slice(0, 1).take(pa.array([0]))
            large = [_dealt(rest.column(by + 1), rest.column(by + 2).to_numpy(), k)]


def minimized_counts(df: DataFrame, text: str, k: int, m: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The counts of ``kmer_counts`` for large ``k``: (by..., kmer, n), with runs of the text in the shuffle.

    The minimizer of a k-mer is its m-mer with the least hash (``m``: about
    half of ``k``). Neighbouring k-mers mostly share it, so a text falls into
    runs of them; a run of r k-mers is shuffled as r + k - 1 characters instead
    of r * k, by its minimizer's hash, and cut into its k-mers there. Equal
    k-mers have equal minimizers, so they meet without another shuffle. A task
    adds up equal runs and packs the runs of a bucket of minimizers into one
    compressed row (``_packed``). Behind the shuffle rows come sorted by bucket and a
    bucket's runs are counted some minimizers at a time, those of a frequent one by their
    k-mers' hashes; a task holds the runs of a bucket and about ``_AT_ONCE`` k-mers.
    """
    by = list(by)
    m = m or max(1, (k + 1) // 2)
    buckets = max(_BUCKETS, 2 * target_partitions(df.sparkSession))
    schema = T.StructType([*[df.schema[c] for c in by], *[T.StructField(c, T.IntegerType()) for c in ("bucket", "rows", "size")],
                           *[T.StructField(c, T.BinaryType()) for c in ("about", "runs")]])
    found = df.select(*by, F.col(text).cast("string").alias("_text")).mapInArrow(
        lambda batches: _packed(batches, len(by), k, m, buckets, schema), schema)
    counted = T.StructType([*[df.schema[c] for c in by], T.StructField("kmer", T.StringType()), T.StructField("n", T.LongType())])
    dealt = found.repartition(*by, "bucket").sortWithinPartitions(*by, "bucket")
    return dealt.mapInArrow(lambda batches: _counted(_unpacked(batches, len(by)), len(by), k, counted), counted)


def probe_counts(df: DataFrame, text: str, probes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., probe, n): overlapping occurrences of each probe, zero when absent.

    All probes are found in one pass over the text, whether they contain each
    other or not; the counts are joined to the probe list, so every group (the
    one group of an empty input too) has every probe.
    """
    spark = df.sparkSession
    hits = count_patterns(df, text, probes, by).withColumnRenamed("pattern", "probe")
    wanted = spark.createDataFrame([(p,) for p in dict.fromkeys(probes)], "probe string")
    if by:
        each = F.explode(F.array(*[F.lit(p) for p in dict.fromkeys(probes)])).alias("probe")
        wanted = df.select(*by).distinct().select(*by, each)
    got = group_join(wanted, hits, [*by, "probe"], "left")
    return got.select(*by, "probe", F.coalesce("n", F.lit(0)).alias("n"))


def chunks_of(text: Column, size: int) -> Column:
    """Array of consecutive ``size``-character pieces of ``text`` (the last may be shorter).

    One linear regex pass; cutting with ``substring`` at growing offsets would
    rescan the UTF-8 text from its start for every piece.
    """
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), 0)


def chunk_text(df: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """Cut each text into numbered chunks of ``size`` characters: (id, chunk_pos, chunk).

    An empty text gives one empty chunk, so every id keeps a row.
    """
    keep = [c for c in df.columns if c != text]
    pieces = chunks_of(F.col(text), size)
    pieces = F.when(F.size(pieces) > 0, pieces).otherwise(F.array(F.lit("")))
    return df.select(*keep, F.posexplode(pieces).alias("chunk_pos", "chunk"))


def _gathered(batches: Iterable[pa.RecordBatch], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows (keys..., cell, pos, text) of one cell as one row, with the steps between their positions and their sizes."""
    for b in batches:
        n, m = b.num_rows, b.num_columns - 2
        if not n:
            continue
        pos, text = b.column(m).to_numpy(zero_copy_only=False), b.column(m + 1)
        new = np.ones(n, bool)
        new[1:] = pos[1:] <= pos[:-1]
        for i in range(m):
            codes = b.column(i).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(new)
        bounds = np.append(starts, n).astype(np.int32)
        at = np.frombuffer(text.buffers()[1], np.int32)[text.offset:text.offset + n + 1]
        steps = np.diff(pos, prepend=pos[:1])
        steps[starts] = 0
        joined = lambda kind, ends, data: pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(ends.astype(np.int32)), data])
        yield pa.RecordBatch.from_arrays([
            *[b.column(i).take(pa.array(starts)) for i in range(m)], pa.array(pos[starts]), pa.array(pos[bounds[1:] - 1]),
            joined(pa.binary(), 2 * bounds, pa.py_buffer(steps.astype("<u2").tobytes())),
            joined(pa.binary(), 4 * bounds, pa.py_buffer(np.diff(at).astype("<u4").tobytes())),
            joined(pa.string(), at[bounds], text.buffers()[2])], names=schema.names)


def _in_order(rows: list[dict]) -> tuple[int, str]:
    """First position and whole text of gathered rows whose positions overlap."""
    if len(rows) == 1:
        return rows[0]["_first"], rows[0]["_t"]
    parts = []
    for r in rows:
        text, ends = r["_t"].encode(), np.cumsum(np.frombuffer(r["_sizes"], "<u4"), dtype=np.int64).tolist()
        at = (r["_first"] + np.cumsum(np.frombuffer(r["_steps"], "<u2"), dtype=np.int64)).tolist()
        parts += [(p, text[a:e]) for p, a, e in zip(at, [0, *ends], ends)]
    parts.sort()
    return parts[0][0], b"".join(t for _, t in parts).decode()


def _merged(batches: Iterable[pa.RecordBatch], keys: list[str], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Gathered rows, sorted by keys, cell and first position, as (keys..., pos, text)."""
    held: list[dict] = []
    own, last = None, 0
    types: list[pa.DataType] = []
    for b in chain(batches, [None]):
        out = []
        for r in b.to_pylist() if b is not None else [None]:
            key = None if r is None else tuple(r[c] for c in [*keys, "_cell"])
            if held and (r is None or key != own or r["_first"] > last):
                out.append((*own[:-1], *_in_order(held)))
                held = []
            if r is not None:
                last = max(last, r["_last"]) if held else r["_last"]
                held.append(r)
                own = key
        types = types if b is None else [b.schema.field(c).type for c in keys]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*types, pa.int64(), pa.string()])], names=schema.names)


def joined_chunks(chunks: DataFrame, keys: Sequence[str], pos: str, chunk: str) -> DataFrame:
    """The sequences of ``chunks`` in fewer, longer chunks: (keys..., pos, chunk); empty ones are left out.

    Rows that follow each other in a task are joined before the shuffle, up to
    ``2 ** CELL_BITS`` positions, and put in order by position behind it; a sequence is
    spread over its cells, and a task holds only rows whose positions overlap.
    """
    keys = list(keys)
    rows = chunks.where(F.length(chunk) > 0).select(
        *keys, F.coalesce(F.col(pos).cast("long"), F.lit(-1 << 63)).alias("_pos"), F.col(chunk).alias("_t"))  # nulls first
    rows = rows.select(*keys, F.shiftright("_pos", CELL_BITS).alias("_cell"), "_pos", "_t")
    fixed = [chunks.schema[c] for c in keys]
    long, text = T.LongType(), T.StringType()
    gathered = T.StructType([*fixed, *[T.StructField(c, t) for c, t in [
        ("_cell", long), ("_first", long), ("_last", long), ("_steps", T.BinaryType()), ("_sizes", T.BinaryType()), ("_t", text)]]])
    merged = T.StructType([*fixed, T.StructField(pos, long), T.StructField(chunk, text)])
    dealt = rows.mapInArrow(lambda b: _gathered(b, gathered), gathered).repartition(*keys, "_cell")
    return dealt.sortWithinPartitions(*keys, "_cell", "_first").mapInArrow(lambda b: _merged(b, keys, merged), merged)


def rechunk(chunks: DataFrame, seq_id: Sequence[str], k: int, by: Sequence[str] = (), pos: str = "chunk_pos",
            chunk: str = "chunk", size: int = PIECE) -> DataFrame:
    """Sequences in chunks of any lengths (empty and shorter than k too) as (seq_id..., by..., block, text).

    Character offsets from running lengths put every chunk's text into blocks
    of ``size`` characters; what lies in the first k-1 of a block is also sent
    to the block before. ``text`` is a block with these following characters,
    so a block never holds more than ``size + k - 1`` characters, however the
    sequence was cut. ``by`` must be constant in a sequence. Chunks numbered by
    integers are joined first (``joined_chunks``), so that no step orders the
    short ones one by one.
    """
    seq_id, size = list(seq_id), max(size, k)
    if isinstance(chunks.schema[pos].dataType, T.IntegerType | T.LongType):
        chunks = materialize(joined_chunks(chunks, [*seq_id, *[c for c in by if c not in seq_id]], pos, chunk))
    src = chunks.select(*seq_id, *[c for c in by if c not in seq_id], pos, F.col(chunk).alias("_t"), F.length(chunk).alias("_n"))
    keep = [c for c in src.columns if c not in (pos, "_t", "_n")]
    at = running(src, seq_id, [pos], sums={"_end": "_n"}, index=None).where("_n > 0").withColumn(
        "_start", (F.col("_end") - F.col("_n")).cast("long"))
    room = (F.lit(size) - F.col("_start") % size).cast("int")  # up to the first block border
    parts = F.concat(F.array(F.substring("_t", F.lit(1), room)), chunks_of(F.substring("_t", room + 1, F.col("_n")), size))
    cut = at.select(*keep, "_start", F.floor(F.col("_start") / size).alias("_first"), F.posexplode(parts).alias("_p", "_t"))
    cut = cut.withColumn("_b", F.col("_first") + F.col("_p")).withColumn(
        "_o", F.when(F.col("_p") == 0, F.col("_start")).otherwise(F.col("_b") * size))
    inside = (F.col("_o") - F.col("_b") * size).cast("int")
    halo = F.when((F.col("_b") > 0) & (inside < k - 1), F.struct(
        (F.col("_b") - 1).alias("b"), F.col("_o").alias("o"), F.substring("_t", F.lit(1), F.lit(k - 1) - inside).alias("t")))
    own = F.struct(F.col("_b").alias("b"), F.col("_o").alias("o"), F.col("_t").alias("t"))
    sent = cut.select(*keep, F.explode(F.array_compact(F.array(own, halo))).alias("_s"))
    got = sent.groupBy(*keep, F.col("_s.b").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("_s.o", "_s.t"))).alias("_ts"))
    return got.select(*keep, "block", F.array_join(F.transform("_ts", lambda x: x["t"]), "").alias("text"))


def kmer_counts_chunked(chunks: DataFrame, seq_id: Sequence[str], k: int, by: Sequence[str] = (),
                        pos: str = "chunk_pos", chunk: str = "chunk") -> DataFrame:
    """Same counts as ``kmer_counts`` on the joined text, from its chunks, whatever their lengths."""
    # a block's text holds exactly the k-mers that start inside the block
    return kmer_counts(rechunk(chunks, seq_id, k, by, pos, chunk), "text", k, by)


def freq_lines(freq: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """'KMER pct' lines (3 decimals, half-to-even) with their rank in sort order.

    The rank (count desc, k-mer asc) comes from the range-bucketed ``running``
    helper, so no single task ranks a whole group. The counts are first
    checkpointed to the shared folder, so ranking does not recount the input.
    """
    freq = materialize(freq)
    ranked = running(freq.withColumn("_negn", -F.col("n")), list(by), ["_negn", "kmer"], index="pos", bucket_on="_negn")
    return ranked.select(*by, F.col("pos").cast("int").alias("pos"),
                         F.format_string("%s %.3f", F.col("kmer"),
                                         F.rint(F.col("pct") * 1000.0) / 1000.0).alias("line"))


def probe_lines(counts: DataFrame) -> DataFrame:
    """'count<TAB>probe' lines."""
    return counts.select("probe", "n", F.concat_ws("\t", F.col("n").cast("string"),
                                                    F.col("probe")).alias("line"))
