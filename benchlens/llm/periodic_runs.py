"""Periodic runs in word sequences, by a suffix automaton and link-cut access.

Words are appended one by one. The path from a word's state to the root of the
suffix links holds all strings that end there; an access recolours the path
with the new end. The path falls into segments by the end that its strings had
last. If a segment's longest string is no shorter than the distance between
its previous and its new end, a square ends here, whose run begins that string
and one distance back. A run is taken where the next word breaks its period.

Before that, windows of words that do not come back nearby are left out: a run
is covered by windows of ``least // 2`` words that occur twice in one covered
stretch, so no run is lost and most texts need no automaton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 12  # words of a run
_BATCH_WORDS = 1_000_000  # words that a task looks through at once

Run = tuple[int, int, int]  # start, length, period


def suffix_automaton(words: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(suffix link, length of the longest string) of each state, and the state of each prefix. State 0 is the root."""
    steps: list[dict[int, int]] = [{}]
    link, size, prefix = [-1], [0], []
    last = 0
    for w in words:
        new = len(steps)
        steps.append({})
        size.append(size[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and w not in steps[at]:
            steps[at][w] = new
            at = link[at]
        if at >= 0:
            to = steps[at][w]
            if size[to] == size[at] + 1:
                link[new] = to
            else:
                copy = len(steps)
                steps.append(steps[to].copy())
                size.append(size[at] + 1)
                link.append(link[to])
                link[to] = link[new] = copy
                while at >= 0 and steps[at].get(w) == to:
                    steps[at][w] = copy
                    at = link[at]
        prefix.append(new)
        last = new
    return link, size, prefix


class Access:
    """Paths to the root as splay trees: ``access(state, end)`` recolours the path and yields what it was coloured."""

    def __init__(self, parent: list[int]):
        n = len(parent)
        self.up = parent  # parent inside a splay tree, or the state above the whole path
        self.left, self.right = [-1] * n, [-1] * n  # towards the root, away from it
        self.colour = [-1] * n  # of a path: kept at the root of its splay tree

    def splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        top = x
        while True:
            p = up[x]
            if p < 0 or (left[p] != x and right[p] != x):
                break
            g = up[p]
            inner = g >= 0 and (left[g] == p or right[g] == p)
            turns = (x,) if not inner else (p, x) if (left[g] == p) == (left[p] == x) else (x, x)
            for y in turns:  # turn the edge between y and its parent
                p = up[y]
                g = up[p]
                if left[p] == y:
                    moved = left[p] = right[y]
                    right[y] = p
                else:
                    moved = right[p] = left[y]
                    left[y] = p
                if moved >= 0:
                    up[moved] = p
                up[p], up[y] = y, g
                if g >= 0 and left[g] == p:
                    left[g] = y
                elif g >= 0 and right[g] == p:
                    right[g] = y
                elif top == x:  # the first to be turned under was the root
                    top = p
        if top != x:
            self.colour[x] = self.colour[top]

    def access(self, state: int, end: int) -> Iterator[tuple[int, int]]:
        """(previous end, deepest state) of each segment of the path, from ``state`` up; then all of it has ``end``."""
        up, right, colour = self.up, self.right, self.colour
        below, at = -1, state
        while at >= 0:
            self.splay(at)
            if colour[at] >= 0:
                yield colour[at], at
            if right[at] >= 0:  # the deeper part is a path of its own now
                colour[right[at]] = colour[at]
            right[at] = below
            below, at = at, up[at]
        colour[below] = end


def runs_by_automaton(words: Sequence[int], least: int) -> list[Run]:
    """Runs of at least ``least`` words and two periods, each once."""
    link, size, prefix = suffix_automaton(words)
    paths = Access(link)
    out, n = [], len(words)
    for end, state in enumerate(prefix):
        for before, deepest in paths.access(state, end):
            period, common = end - before, size[deepest]
            if common >= period and common + period >= least and (end + 1 == n or words[end + 1] != words[end + 1 - period]):
                out.append((end + 1 - period - common, common + period, period))
    return out


def _repeated(codes: np.ndarray, group: np.ndarray, width: int) -> np.ndarray:
    """Which places lie in a window of ``width`` words that occurs twice in its group (hashed: perhaps some more)."""
    n = codes.size - width + 1
    covered = np.zeros(codes.size, bool)
    if n < 2:
        return covered
    key = group[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        key *= np.uint64(0xD1342543DE82EF95)
        key += codes[k:k + n]
        key ^= key >> np.uint64(29)
    whole = np.flatnonzero(group[:n] == group[width - 1:])
    key = key[whole]
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not twice.size:
        return covered
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, key), twice.size - 1)
    first = whole[twice[at] == key]
    edge = np.zeros(codes.size + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + width, -1)
    return np.cumsum(edge[:-1]) > 0


def stretches(codes: np.ndarray, text_of: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(from, to) of the stretches that hold every run; ``codes`` are words of texts one after the other.

    Places outside repeated windows are cut away, and again inside of what is left, until nothing changes.
    """
    place, group = np.arange(codes.size), text_of
    while True:
        covered = _repeated(codes[place], group, max(1, least // 2))
        left, of = place[covered], group[covered]
        if not left.size:
            return
        new = np.ones(left.size, bool)
        new[1:] = (np.diff(left) > 1) | (of[1:] != of[:-1])
        group = np.cumsum(new)
        long = np.bincount(group)[group] >= least
        left, group = left[long], group[long]
        if left.size == place.size:
            break
        place = left
    if place.size:
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        for a, b in zip(starts, [*starts[1:], place.size]):
            yield int(place[a]), int(place[b - 1]) + 1


def find_runs(texts: Sequence[Sequence[bytes]], least: int = LEAST) -> list[list[Run]]:
    """The runs of each text (a list of words), by start, then period.

    A run is a stretch of words with smallest period q, at least ``least`` and 2 q long, that cannot be made
    longer on either side. Memory grows with the longest stretch that may hold a run, inside one text.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.fromiter((hash(w) for t in texts for w in t), np.int64, int(starts[-1])).view(np.uint64)
    text_of = np.repeat(np.arange(sizes.size), sizes)
    out: list[list[Run]] = [[] for _ in texts]
    for a, b in stretches(codes, text_of, least):
        own = int(text_of[a])
        at = a - int(starts[own])
        number: dict[bytes, int] = {}
        words = [number.setdefault(w, len(number)) for w in texts[own][at:at + b - a]]
        out[own] += [(s + at, n, q) for s, n, q in runs_by_automaton(words, least)]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: Sequence[bytes], runs: Iterable[Run]) -> list[bytes]:
    """``words`` without those that any run holds after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def describe(words: Sequence[bytes], runs: list[Run]) -> tuple:
    """One row of ``SCHEMA``: the longest run (least start, then period), digests of all runs and of the collapsed text."""
    top: tuple = (None, None, None, None)
    if runs:
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        top = (start, length, period, 1000 * length // period)
    listed = "".join([f"{s},{n},{q}\n" for s, n, q in runs])
    left = collapsed(words, runs) if runs else words
    return (len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest())


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
           prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """The periodic runs of every row's whole text: ``id_col`` and the columns of ``SCHEMA``.

    Words are maximal runs without ASCII white space, numbered from 0.
    ``prepare`` may change a row's words first (given its id and words). Rows
    are kept one to one and nothing is shuffled. Null and empty texts have no
    words: 0 runs, nulls for the longest run, digests of the empty text. An
    empty table gives an empty result; other columns are not read. A text is
    looked at whole, however long; a task holds about a million words at a time
    (or one text).
    """
    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL(SCHEMA).fields])

    def look(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = [describe(t, r) for t, r in zip(texts, find_runs(texts, least))]
        columns = [pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(zip(*found))]
        return pa.RecordBatch.from_arrays([ids_array(ids), *columns], names=schema.names)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal kind
        ids, texts, held = [], [], 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or b"").split()
                words = prepare(i, words) if prepare else words
                ids.append(i)
                texts.append(words)
                held += len(words)
                if held >= _BATCH_WORDS:
                    yield look(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield look(ids, texts)

    kind: pa.DataType | None = None

    def ids_array(ids: list) -> pa.Array:
        return pa.array(ids, kind)

    return docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("_text")).mapInArrow(work, schema)
