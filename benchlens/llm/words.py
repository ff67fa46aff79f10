"""Cached use of a public word-level BPE file inside Spark tasks.

The file's normalizer (NFC, white space, lower case) and pre-tokenizer cut a
text into short pieces that are merged independently of each other, so the ids
of a text are the ids of its pieces, one after the other. Pieces repeat, texts
do not: each distinct piece is merged once per task and looked up afterwards.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import public_tokenizers

DEFAULT_FILE = public_tokenizers.path("word_bpe_49k.json")

# The classes of the file's split pattern, restricted to Latin-1
# (white space, letters after lower-casing, numbers), and its contractions.
_SPACE = " \t\n\x0b\x0c\r\x85\xa0"
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_ASCII_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")

# Marks of pieces that did not take the Latin-1 path; no Latin-1 text holds these characters.
SYMBOLS = "Ā"
SPECIAL = "ā"


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level BPE files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordCodec:
    """Ids (little-endian unsigned 32-bit bytes) and shown tokens of each piece, with a bounded cache."""

    def __init__(self, path: str = DEFAULT_FILE, max_pieces: int = 300_000, cache_chars: int = 48):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task per core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.any_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, reverse=True))) + ")")
        n = self.tok.get_vocab_size(with_added_tokens=True)
        self.token = [self.tok.id_to_token(i) for i in range(n)]
        self.packed = [i.to_bytes(4, "little") for i in range(n)]
        table = byte_symbols()
        self.latin = str.maketrans({chr(c): "".join(table[b] for b in chr(c).encode()) for c in range(256)})
        self.max_pieces, self.cache_chars = max_pieces, cache_chars
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}
        self.passing: list[str] = []  # long pieces, kept for one batch only

    def pieces(self, text: str) -> list[str]:
        """Cache keys of the pieces of ``text``, in order."""
        try:
            text.encode("latin-1")
            if not ("<" in text and self.any_special.search(text)):
                return _PIECE.findall(text.lower())
        except UnicodeEncodeError:
            pass
        out: list[str] = []
        for word in _ASCII_SPACE.split(text):
            for part in self.any_special.split(word):
                if part in self.special:
                    out.append(SPECIAL + part)
                elif part:
                    try:
                        part.encode("latin-1")
                        out += _PIECE.findall(part.lower())
                    except UnicodeEncodeError:
                        plain = self.tok.normalizer.normalize_str(part)
                        out += [SYMBOLS + s for s, _ in self.tok.pre_tokenizer.pre_tokenize_str(plain)]
        return out

    def symbols(self, piece: str) -> str:
        """The byte symbols that the merges of ``piece`` start from."""
        return piece[1:] if piece[0] == SYMBOLS else piece.translate(self.latin)

    def merge(self, piece: str) -> list[int]:
        if piece[0] == SPECIAL:
            return [self.special[piece[1:]]]
        return [t.id for t in self.model.tokenize(self.symbols(piece))]

    def learn(self, pieces: Iterable[str], decode: bool) -> None:
        """Merge the pieces not seen yet; the cache starts anew when it would outgrow its bound."""
        for p in self.passing:
            self.ids.pop(p, None)
            self.shown.pop(p, None)
        pieces = set(pieces)
        new = pieces.difference(self.ids)
        if len(self.ids) + len(new) > self.max_pieces:
            self.ids, self.shown, new = {}, {}, pieces
        self.passing = [p for p in new if len(p) > self.cache_chars]
        for p in new:
            got = self.merge(p)
            self.ids[p] = b"".join([self.packed[i] for i in got])
            if decode:
                self.shown[p] = " ".join([self.token[i] for i in got])

    def encode(self, texts: list[str | None], decode: bool = False) -> Iterator[tuple[bytes, str | None]]:
        """(ids, decoded text or None) of each text, in order; a null text is empty."""
        cut = [self.pieces(t) if t else [] for t in texts]
        self.learn((p for ps in cut for p in ps), decode)
        ids, shown = self.ids, self.shown
        for ps in cut:
            yield b"".join([ids[p] for p in ps]), " ".join([shown[p] for p in ps]) if decode else None


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that Python holds few texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
