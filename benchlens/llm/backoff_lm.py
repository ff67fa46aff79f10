"""N-gram language model as a weighted backoff automaton, walked left to right over every text.

States are contexts: the root, words, and pairs of words that training holds.
A state has an arc for every word that follows it in training, weighted with
its smoothed log-probability, and a failure arc to its shorter context, taken
at a weight where a word has no arc. Every state's weights sum to one (words
that training has not seen are one class).

No part of the model is gathered in one place. Texts are dealt into blocks of
bounded size. A block asks for the training counts of its own words and word
pairs (with the words before them); the questions are dealt by the hash of what
they ask for, summed over all blocks, and each block gets its answers back in
the order in which it asked. With them it builds the part of the automaton
that its texts can reach, and walks it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.session import target_partitions

END = b""  # the end token; words are never empty
WORD_PRIOR, PAIR_PRIOR = 20.0, 5.0  # counts that a shorter context's probabilities stand for in a word's or a pair's state
BLOCK_TOKENS = 500_000
PART_BYTES = 12_000_000  # of texts whose pairs are summed in one group

_START, _NONE = np.uint64(0x51A7), np.uint64(0x0E0E)  # stand for what lies before a text's first word, and before that
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: A-Z lower-cased, cut at ASCII white space."""
    return (text or b"").lower().split()


def packed(a: np.ndarray) -> bytes:
    """An array's bytes, all first bytes before all second ones, compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T)
    return zstandard.ZstdCompressor(1).compress(planes.tobytes())


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def _pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    key = (a * _MIX ^ (a >> np.uint64(31))) + b
    key = (key ^ (key >> np.uint64(29))) * _MIX
    return (key ^ (key >> np.uint64(32))) & ~np.uint64(255)  # 56 bits: the rest would only be shuffled


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of the key space begins and ends in ascending ``keys``."""
    limits = np.array([-(-(p << 64) // parts) for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, limits), [keys.size]])


class Block:
    """Texts of one block, and its words, pairs and triples (a pair and the word before it) in the order of their keys.

    ``word``, ``pair``, ``triple`` give each token's place in those orders.
    """

    def __init__(self, words: list[bytes], tokens: np.ndarray, sizes: np.ndarray):
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        self.first = self.ends - sizes  # first token of each text
        own = _hashes(words)
        by_hash = np.argsort(own)
        self.words, self.word_keys = [words[i] for i in by_hash], own[by_hash]
        place = np.empty(own.size, np.int64)
        place[by_hash] = np.arange(own.size)
        self.word = place[tokens]
        here = own[tokens]
        before = np.concatenate([[_START], here[:-1]]).astype(np.uint64)
        before[self.first] = _START
        two = np.concatenate([[_NONE], before[:-1]]).astype(np.uint64)
        two[self.first] = _NONE
        self.pair_keys, self.pair = np.unique(_pair_key(before, here), return_inverse=True)
        triple = (self.pair.astype(np.uint64) << np.uint64(32)) | ((two * _MIX) >> np.uint64(32))
        self.triples, self.triple = np.unique(triple, return_inverse=True)

    @classmethod
    def read(cls, row: dict) -> Block:
        words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b" ")
        return cls(words, unpacked(row["tokens"], np.uint32), np.array(row["sizes"], np.int64))

    def questions(self, train: np.ndarray, word_parts: int, pair_parts: int) -> Iterator[tuple]:
        """(kind, part, keys, widths, firsts, counts): what is asked of each part, with the block's own training counts.

        Every word part is asked, if only for its totals.
        """
        weight = np.repeat(train, self.sizes).astype(float)
        counts = np.bincount(self.word, weight, len(self.words)).astype(np.uint64)
        cuts = _cuts(self.word_keys, word_parts)
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            yield 1, p, zstandard.ZstdCompressor(1).compress(b" ".join(self.words[a:b])), None, None, packed(counts[a:b])
        counts = np.bincount(self.triple, weight, self.triples.size).astype(np.uint64)
        of_pair = (self.triples >> np.uint64(32)).astype(np.int64)
        widths = np.bincount(of_pair, minlength=self.pair_keys.size).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
        firsts = self.triples.astype(np.uint32)  # the low half
        cuts = _cuts(self.pair_keys, pair_parts)
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                inside = slice(at[a], at[b])
                steps = np.diff(self.pair_keys[a:b], prepend=np.uint64(0))
                yield 2, p, packed(steps), packed(widths[a:b]), packed(firsts[inside]), packed(counts[inside])


class Automaton:
    """The states and arcs that a block's texts can reach, as log10 weights.

    ``c1``, ``c2``, ``c3`` are the training counts of the block's words, pairs
    and triples; ``total``, ``vocab``, ``texts`` those of all training tokens,
    different tokens and texts.
    """

    def __init__(self, block: Block, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, total: float, vocab: float, texts: float):
        self.block, self.total = block, total
        self.base = np.log10((c1 + 0.5) / (total + 0.5 * (vocab + 1)))
        w, g, t = block.word, block.pair, block.triple
        size = np.concatenate([[texts], c1[w[:-1]]])  # how often the word before each token is followed by any
        size[block.first] = texts
        low = (c2[g] + WORD_PRIOR * 10 ** self.base[w]) / (size + WORD_PRIOR)
        wide = np.concatenate([[0.0], c2[g[:-1]]])  # and the pair before it
        wide[block.first] = 0.0
        high = (c3[t] + PAIR_PRIOR * low) / (wide + PAIR_PRIOR)
        # by token: arcs of the root, of the word before, of the pair before; the failure arcs of the latter two
        self.arcs = [self.base[w], np.log10(low), np.log10(high)]
        self.fails = [np.log10(WORD_PRIOR / (size + WORD_PRIOR)), np.log10(PAIR_PRIOR / (wide + PAIR_PRIOR))]
        self.has = [c1[w] > 0, c2[g] > 0, (c3[t] > 0) & (wide > 0)]
        self.start = int(texts > 0)  # the state before a text's first word: that of its start, or the root

    def walk(self, i: int) -> float:
        """log10 probability of text ``i``: one pass that carries the state's length (root 0, word 1, pair 2)."""
        own = slice(self.block.first[i], self.block.ends[i])
        state, lp = self.start, 0.0
        for known, two, three, a0, a1, a2, f1, f2 in zip(*[x[own].tolist() for x in (*self.has, *self.arcs, *self.fails)]):
            if state == 2:
                if three:
                    lp += a2
                    continue  # the last two words are a state again
                lp += f2
                state = 1
            if state == 1:
                if two:
                    lp += a1
                    state = 2
                    continue
                lp += f1
            lp += a0
            state = 1 if known else 0
        return lp


def _blocks(src: DataFrame, id_field: T.StructField) -> DataFrame:
    """One row for each block: its texts' ids, training marks and sizes, its words, and the texts as numbers of these."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(id_field.dataType)),
                           T.StructField("train", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.LongType())),
                           T.StructField("words", T.BinaryType()), T.StructField("tokens", T.BinaryType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        ids, train, sizes, tokens, kind = [], [], [], [], None
        number: dict[bytes, int] = defaultdict(count(1).__next__)

        def row() -> pa.RecordBatch:
            words = zstandard.ZstdCompressor(3).compress(b" ".join([END, *number]))
            values = [[(task << 32) + n], [ids], [train], [sizes], [words], [packed(np.array(tokens, np.uint32))]]
            types = [pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=schema.names)

        for b in batches:
            kind = b.schema.field(0).type
            for i, text, use in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                words = words_of(text.as_py())
                tokens += map(number.__getitem__, words)
                tokens.append(0)
                ids.append(i)
                train.append(use)
                sizes.append(len(words) + 1)
                if len(tokens) >= BLOCK_TOKENS:
                    yield row()
                    n += 1
                    ids, train, sizes, tokens = [], [], [], []
                    number = defaultdict(count(1).__next__)
        if ids:
            yield row()

    return src.mapInArrow(work, schema)


_ASKED = "kind int, part int, block long, keys binary, widths binary, firsts binary, counts binary"
_ANSWER = "kind int, part int, block long, first binary, second binary, total double, vocab double, texts double"


def _asked(blocks: DataFrame, word_parts: int, pair_parts: int) -> DataFrame:
    schema = T.StructType.fromDDL(_ASKED)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
        for b in batches:
            for row in b.to_pylist():
                rows = [(k, p, row["block"], *rest) for k, p, *rest in
                        Block.read(row).questions(np.array(row["train"], bool), word_parts, pair_parts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=schema.names)

    return blocks.mapInArrow(work, schema)  # of all columns, so that both uses of the blocks read the same shuffle


def _sum_words(rows: list[dict]) -> Iterator[tuple]:
    totals: dict[bytes, int] = defaultdict(int)
    asked = []
    for r in rows:
        counts = unpacked(r["counts"], np.uint64).tolist()
        words = zstandard.ZstdDecompressor().decompress(r["keys"]).split(b" ") if counts else []
        asked.append(words)
        for w, c in zip(words, counts):
            totals[w] += c
    sums = float(sum(totals.values())), float(sum(c > 0 for c in totals.values())), float(totals.get(END, 0))
    for r, words in zip(rows, asked):
        yield packed(np.array([totals[w] for w in words], np.uint64)), None, *sums


def _sum_pairs(rows: list[dict]) -> Iterator[tuple]:
    keys = [np.cumsum(unpacked(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
    widths = [unpacked(r["widths"], np.uint32).astype(np.int64) for r in rows]
    firsts, counts = (np.concatenate([unpacked(r[c], k) for r in rows]) for c, k in (("firsts", np.uint32), ("counts", np.uint64)))
    _, pair_of_key = np.unique(np.concatenate(keys), return_inverse=True)
    pair = np.repeat(pair_of_key, np.concatenate(widths))
    _, triple = np.unique((pair.astype(np.uint64) << np.uint64(32)) | firsts, return_inverse=True)
    weight = counts.astype(float)
    c2 = np.bincount(pair, weight).astype(np.uint64)[pair_of_key]
    c3 = np.bincount(triple, weight).astype(np.uint64)[triple]
    at2 = np.cumsum([0, *[k.size for k in keys]])
    at3 = np.cumsum([0, *[int(w.sum()) for w in widths]])
    for i in range(len(rows)):
        yield packed(c2[at2[i]:at2[i + 1]]), packed(c3[at3[i]:at3[i + 1]]), None, None, None


def _answer(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    got = (_sum_words if rows[0]["kind"] == 1 else _sum_pairs)(rows)
    out = [(r["kind"], r["part"], r["block"], *g) for r, g in zip(rows, got)]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), *[pa.float64()] * 3]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[c.split()[0] for c in _ANSWER.split(", ")])


def _counts(answers: list[dict], kind: int, column: str, size: int) -> np.ndarray:
    parts = [unpacked(r[column], np.uint64) for r in sorted(answers, key=lambda r: r["part"]) if r["kind"] == kind]
    got = np.concatenate(parts).astype(float) if parts else np.zeros(0)
    if got.size != size:
        raise ValueError("a block and its answers do not fit together")
    return got


def automaton_of(block: Block, answers: list[dict]) -> Automaton:
    total, vocab, texts = (sum(r[c] for r in answers if r["kind"] == 1) for c in ("total", "vocab", "texts"))
    return Automaton(block, _counts(answers, 1, "first", len(block.words)), _counts(answers, 2, "first", block.pair_keys.size),
                     _counts(answers, 2, "second", block.triples.size), total, vocab, texts)


def score(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row's whole text under a model learnt from the rows where ``train_on`` is true.

    Returns ``id_col``, train_on, n_tokens, n_known, train_tokens, base_score
    (unigrams with half counts) and score (the automaton's log10 probability).
    The model holds all words, pairs and triples of the training texts.
    A null text is empty: only its end token counts. Rows are kept one to one,
    with null ids and repeated rows; a null ``train_on`` counts as false; other
    columns are not read; an empty table gives an empty result; without
    training rows every token falls to the unseen class of probability 1.

    Words are counted exactly. Pairs are told apart by 56-bit hashes and the
    words before a pair by 32 bits more. Blocks follow the partitions of
    ``docs`` and are shuffled once for both of their uses; should their rows
    not come back in the same order after a loss, the run fails, as a block and
    its answers then do not fit. A text longer than a block is a block of its
    own.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("_text"),
                      F.coalesce(train_on, F.lit(False)).alias("_train"))
    size = src.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(target_partitions(spark), -(-size // PART_BYTES))
    blocks = _blocks(src, docs.schema[id_col]).repartition(parts, "block")
    answers = _asked(blocks, max(1, parts // 2), parts).groupBy("kind", "part").applyInArrow(_answer, _ANSWER)
    schema = T.StructType([docs.schema[id_col], *T.StructType.fromDDL(
        "train_on boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = Block.read(row)
        model = automaton_of(block, right.to_pylist())
        n = len(row["ids"])
        known = np.add.reduceat(model.has[0].astype(np.int64), block.first)
        base = np.add.reduceat(model.arcs[0], block.first)
        columns = [left["ids"].combine_chunks().flatten(), pa.array(row["train"], pa.bool_()), pa.array(block.sizes),
                   pa.array(known), pa.array(np.full(n, int(model.total))), pa.array(base),
                   pa.array([model.walk(i) for i in range(n)], pa.float64())]
        return pa.table(columns, names=schema.names)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, schema)
