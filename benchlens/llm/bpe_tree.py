"""BPE encoding and decoding of whole texts as a tree of halves.

A text is halved by its characters until its leaves are short, wherever the
cuts fall: between the pieces of the pre-tokenizer or inside one. The leaves
are encoded, those of very long texts in parallel as rows of their own, and
neighbours are joined up the tree. At a join inside a piece a window of tokens around the seam is encoded
anew and doubled until its outer tokens are those of both sides. Merges are by
rank and stay within a piece, so a token sequence is the encoding of its text
exactly when every two neighbours are that of theirs; a window that agrees with
both sides therefore makes the joined sequence exact. Between two pieces
nothing merges, so there both sides stay as they are.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.llm.words import DEFAULT_FILE, SPECIAL, SYMBOLS, WordCodec, slices

_END = "</w>"  # fixed value: the word end of the vocabulary file
Leaf = tuple[bool, bool, list[str]]  # head, tail, keys: see leaves_of
AGREE = 2  # outer tokens of a window that must equal each side's


class HalfCoder:
    """Encodes parts of one piece: open parts have more of the piece to their right."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        self.closed = Tokenizer.from_file(path).model
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        spec = file["model"]
        self.open = models.BPE(vocab=spec["vocab"], merges=[tuple(m) for m in spec["merges"]])
        self.token = {i: t for t, i in spec["vocab"].items()}
        # tokens after which their piece goes on; a special token is a piece by itself
        self.inside = {i for i, t in self.token.items() if not t.endswith(_END)} - {t["id"] for t in file["added_tokens"]}

    def encode(self, symbols: str, last: bool) -> list[int]:
        return [t.id for t in (self.closed if last else self.open).tokenize(symbols)]

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """Encoding of the text of ``left`` and ``right``; ``last``: the piece ends with ``right``."""
        w = 2 * AGREE
        while True:
            all_left, all_right = w >= len(left), w >= len(right)
            a, b = left[-w:], right[:w]
            text = "".join([self.token[i] for i in a + b])
            closed = last and all_right
            got = self.encode(text.removesuffix(_END) if closed else text, closed)
            if (all_left or got[:AGREE] == a[:AGREE]) and (all_right or got[-AGREE:] == b[-AGREE:]):
                return left[:-w] + got + right[w:]
            w *= 2

    def join_texts(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of two neighbouring parts of a text; only a piece that lies on both sides is encoded anew."""
        if not left or not right or left[-1] not in self.inside:
            return left + right
        i = len(left)
        while i and left[i - 1] in self.inside:
            i -= 1
        j = next((n for n, t in enumerate(right, 1) if t not in self.inside), len(right))
        return left[:i] + self.join(left[i:], right[:j], right[j - 1] not in self.inside) + right[j:]

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Join neighbouring encodings pairwise, level by level."""
        while len(parts) > 1:
            parts = [self.join_texts(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]


def halves(n: int, leaf: int) -> list[int]:
    """Where ``n`` characters are cut when they are halved until no part is longer than ``leaf``; ends with ``n``."""
    def cut(lo: int, hi: int) -> list[int]:
        mid = (lo + hi) // 2
        return [hi] if hi - lo <= leaf else cut(lo, mid) + cut(mid, hi)

    return cut(0, n)


def leaves_of(codec: WordCodec, pieces: list[str], leaf: int) -> list[Leaf]:
    """(head, tail, keys) of every leaf of a text.

    ``head``: the first key is the rest of a piece begun in the leaf before;
    ``tail``: the last key's piece goes on in the next leaf. Such keys are byte symbols.
    """
    marked = not "".join(pieces).isascii()
    ends = list(accumulate([1 if p[0] == SPECIAL else len(p) - (p[0] == SYMBOLS) for p in pieces] if marked else map(len, pieces)))
    out: list[Leaf] = []
    at, used = 0, 0  # the piece that the leaf starts in, and how many of its symbols are used up
    for hi in halves(ends[-1] if ends else 0, leaf):
        stop = bisect_right(ends, hi)  # pieces before this one end in the leaf
        head, keys = used > 0, pieces[at:stop]
        if head and keys:
            keys[0] = codec.symbols(keys[0])[used:]
        over = hi - (ends[stop - 1] if stop else 0)  # symbols of the next piece that belong to the leaf
        if over:
            keys.append(codec.symbols(pieces[stop])[used if stop == at else 0:over])
        out.append((head, over > 0, keys))
        at, used = stop, over
    return out


def encode_leaves(codec: WordCodec, coder: HalfCoder, leaves: list[Leaf]) -> list[list[int]]:
    """Ids of every leaf by itself; pieces that lie whole in a leaf are looked up in the cache."""
    codec.learn((k for head, tail, keys in leaves for k in keys[head:len(keys) - tail]), False)
    out = []
    for head, tail, keys in leaves:
        ids = coder.encode(keys[0], not (tail and len(keys) == 1)) if head else []
        ids += _unpacked(b"".join([codec.ids[k] for k in keys[head:len(keys) - tail]]))
        if tail and len(keys) > head:
            ids += coder.encode(keys[-1], False)
        out.append(ids)
    return out


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT_FILE,
           leaf: int = 512, deal: int = 16384) -> DataFrame:
    """(``id_col``, ids, decoded) of every whole text.

    ``ids`` holds little-endian unsigned 32-bit integers; ``decoded`` is the
    decoded text of these ids, special tokens included. A null text is empty
    (no ids, empty decoded text). Rows are kept one to one: null ids and
    repeated rows too. Other columns are not read; an empty table gives an
    empty result. Every text is a tree of leaves of at most ``leaf``
    characters. The tree of a text of at most ``deal`` characters is built
    where the text is read; of all longer texts the leaves are dealt over the
    tasks and joined. The table is scanned once for each of the two.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    long = F.length("_text") > deal
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType()),
                           T.StructField("decoded", T.StringType())])

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, coder = WordCodec(path), HalfCoder(path)
        for b in slices(batches, 64):
            cut = [leaves_of(codec, codec.pieces(text), leaf) for text in b.column(1).to_pylist()]
            done = iter(encode_leaves(codec, coder, [x for own in cut for x in own]))
            got = [coder.join_all([next(done) for _ in own]) for own in cut]
            yield _decoded(codec, b.column(0), got, schema.names)

    return src.where(~long).mapInArrow(whole, schema).unionByName(_tree(src.where(long), schema, path, leaf))


def cut_leaves(src: DataFrame, path: str, leaf: int) -> DataFrame:
    """A row for each leaf of the texts in ``src`` (_id, _text): _id, _row, part, head, tail, keys."""
    src = src.withColumn("_row", F.monotonically_increasing_id())
    schema = T.StructType([*(f for f in src.schema if f.name != "_text"), T.StructField("part", T.IntegerType()),
                           T.StructField("head", T.BooleanType()), T.StructField("tail", T.BooleanType()),
                           T.StructField("keys", T.StringType())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordCodec(path)
        for b in slices(batches, 16):
            rows = [(i, part, *own[:2], " ".join(own[2])) for i, text in enumerate(b.column(1).to_pylist())
                    for part, own in enumerate(leaves_of(codec, codec.pieces(text), leaf))]
            of, part, head, tail, keys = zip(*rows)
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(of), b.column(2).take(of), pa.array(part, pa.int32()), pa.array(head, pa.bool_()),
                 pa.array(tail, pa.bool_()), pa.array(keys, pa.string())], names=schema.names)

    return src.select("_id", "_text", "_row").mapInArrow(cut, schema)


def _tree(src: DataFrame, schema: T.StructType, path: str, leaf: int) -> DataFrame:
    parts = cut_leaves(src, path, leaf)
    encoded = T.StructType([f for f in parts.schema if f.name not in ("head", "tail", "keys")] + [T.StructField("ids", T.BinaryType())])

    def leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, coder = WordCodec(path), HalfCoder(path)
        for b in slices(batches):
            rows = [(head, tail, keys.split(" ") if keys else []) for head, tail, keys in
                    zip(*(b.column(c).to_pylist() for c in ("head", "tail", "keys")))]
            ids = pa.array([_packed(x) for x in encode_leaves(codec, coder, rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in encoded.names[:-1]), ids], names=encoded.names)

    def grow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, coder = WordCodec(path), HalfCoder(path)
        for b in slices(batches, 8):
            got = [coder.join_all([_unpacked(x) for x in own]) for own in b.column(1).to_pylist()]
            yield _decoded(codec, b.column(0), got, schema.names)

    # leaves are dealt out one by one, so a very long text is encoded by many tasks
    done = parts.repartition("_row", "part").mapInArrow(leaves, encoded)
    own = done.groupBy("_row").agg(F.first("_id").alias("_id"), F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("own"))
    return own.select("_id", F.col("own.ids").alias("own")).mapInArrow(grow, schema)


def _decoded(codec: WordCodec, id_values: pa.Array, ids: list[list[int]], names: list[str]) -> pa.RecordBatch:
    shown = [" ".join([codec.token[i] for i in own]) for own in ids]
    return pa.RecordBatch.from_arrays([id_values, pa.array([_packed(own) for own in ids], pa.binary()),
                                       pa.array(shown, pa.string())], names=names)


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _unpacked(ids: bytes) -> list[int]:
    return memoryview(ids).cast("I").tolist()
