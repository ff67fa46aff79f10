"""Merkle trees over the sections, paragraphs and phrases of a text, as column expressions.

A text is cut into sections (at blank lines), these into paragraphs (at line
ends) and these into phrases of up to four words that end with a sentence; no
character is lost. A node's digest is the SHA-256 of its children's digests,
so equal roots mean equal texts, and where two trees differ only the branches
with unequal digests need to be followed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchlens.llm.successor import with_next

SECTION = r"(?s).+?(?:\n\n+|\z)"
PARAGRAPH = r"[^\n]*\n+|[^\n]+"
PHRASE = r"[ \t\n\f\r]*(?:[^ \t\n\f\r]+[ \t\n\f\r]+){0,3}?[^ \t\n\f\r]*[.!?]|[ \t\n\f\r]*[^ \t\n\f\r]+(?:[ \t\n\f\r]+[^ \t\n\f\r]+){0,3}|[ \t\n\f\r]+"
LONG = 256  # characters beyond which a phrase falls into several leaves
PIECES = r"(?s).{32,%d}?[aeiouAEIOU0-4]|.{1,%d}" % (LONG - 1, LONG)  # of such a phrase, by what they hold: they stay the same behind an edit
_WEIGHT = 1023  # low bits of a leaf's code: its length


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def parts(text: Column) -> Column:
    """sections x paragraphs x phrases of ``text``."""
    return F.transform(_all(text, SECTION), lambda s: F.transform(_all(s, PARAGRAPH), lambda p: _all(p, PHRASE)))


def _digest(children: Column, level: str) -> Column:
    return F.sha2(F.concat(F.lit(level), F.array_join(children, "")), 256)


def paragraph_digests(cut: Column) -> Column:
    return F.transform(cut, lambda s: F.transform(s, lambda p: _digest(F.transform(p, lambda x: F.sha2(x, 256)), "p:")))


def section_digests(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda s: _digest(s, "s:"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def leaf_codes(cut: Column) -> Column:
    """Leaves as different 64-bit codes whose low bits hold the leaf's length.

    A leaf is a phrase, or a piece of one of more than ``LONG`` characters. The
    n-th occurrence of a leaf has a code of its own, so a leaf counts as often
    as it occurs.
    """
    pieces = lambda x: F.when(F.length(x) <= LONG, F.array(x)).otherwise(_all(x, PIECES))
    leaves = F.sort_array(F.flatten(F.transform(F.flatten(F.flatten(cut)), pieces)))
    code = lambda x, n: F.xxhash64(x, n).bitwiseAND(F.lit(~_WEIGHT)).bitwiseOR(F.length(x))

    def numbered(s: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))),
                          lambda i: (i < F.size(s)) & ((i == 0) | ~F.get(s, i).eqNullSafe(F.get(s, i - 1))))
        return _let(firsts, lambda at: F.flatten(F.transform(at, lambda i, k: F.transform(
            F.sequence(F.lit(1), F.coalesce(F.get(at, k + 1), F.size(s)) - i), lambda n: code(F.get(s, i), n)))))

    return _let(leaves, numbered)


def with_tree(df: DataFrame, text_col: str, root: str, paragraphs: str, leaves: str) -> DataFrame:
    """``df`` with the root digest, the paragraph digests of each section, and the leaf codes of a text."""
    cut = df.withColumn("_cut", parts(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    cut = cut.withColumns({paragraphs: paragraph_digests(F.col("_cut")), leaves: leaf_codes(F.col("_cut"))}).drop("_cut")
    return cut.withColumn(root, _digest(section_digests(F.col(paragraphs)), "r:"))


def _weight(codes: Column) -> Column:
    return F.aggregate(codes, F.lit(0).cast("long"), lambda acc, x: acc + x.bitwiseAND(F.lit(_WEIGHT)))


def likeness(root_a: str, leaves_a: str, root_b: str, leaves_b: str) -> Column:
    """1 for equal roots, else the share of characters in common leaves (twice those, of both sides'), each as often as both hold it."""
    both = _weight(F.array_intersect(leaves_a, leaves_b))
    total = _weight(F.col(leaves_a)) + _weight(F.col(leaves_b))
    return F.when(F.col(root_a) == F.col(root_b), F.lit(1.0)).when(total == 0, F.lit(1.0)).otherwise(2.0 * both / total)


def first_difference(a: Column, b: Column) -> Column:
    """0-based place of the first differing branch of two lists of digests; null if there is none."""
    n = F.least(F.size(a), F.size(b))
    at = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y), False)
    return F.when(at > 0, at - 1).when(F.size(a) != F.size(b), n.cast("long"))


def with_edit_place(df: DataFrame, paragraphs_a: str, paragraphs_b: str, section: str, paragraph: str) -> DataFrame:
    """Where two trees first differ: the section, and the paragraph inside it (null: nowhere)."""
    a, b = F.col(paragraphs_a), F.col(paragraphs_b)
    out = df.withColumn(section, first_difference(section_digests(a), section_digests(b)))
    at = (F.col(section) + 1).cast("int")
    none = F.array().cast("array<string>")
    return out.withColumn(paragraph, F.when(F.col(section).isNotNull(), first_difference(
        F.coalesce(F.get(a, at - 1), none), F.coalesce(F.get(b, at - 1), none))))


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited form, and how like they are.

    The edited text has the last quarter (whole code points, rounded down)
    replaced by as many first code points of the next text in ascending
    ``id_col`` (all of it, if shorter; after the last comes the first). Returns
    ``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint (root
    digests), near_edited, near_next, edit_section, edit_paragraph (first
    differing branch). A null text is empty; null ids come last in the order;
    rows of one id are ordered by a hash of their texts and kept one to one;
    other columns are not read; an empty table gives an empty result.
    """
    src = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    got = with_next(src, "_id", F.xxhash64("_text"), {"_text": "_next", "_root": "_next_root", "_leaves": "_next_leaves"},
                    prepare=lambda rows: with_tree(rows, "_text", "_root", "_paras", "_leaves"))
    n = F.length("_text")
    quarter = F.floor(n / 4).cast("int")
    got = got.withColumn("_edited", F.concat(F.substring("_text", F.lit(1), n - quarter), F.substring("_next", F.lit(1), quarter)))
    got = with_tree(got, "_edited", "_edited_root", "_edited_paras", "_edited_leaves")
    got = with_edit_place(got, "_paras", "_edited_paras", "edit_section", "edit_paragraph")
    return got.select(
        F.col("_id").alias(id_col), n.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"),
        F.col("_root").alias("fingerprint"), F.col("_edited_root").alias("edited_fingerprint"),
        likeness("_root", "_leaves", "_edited_root", "_edited_leaves").alias("near_edited"),
        likeness("_root", "_leaves", "_next_root", "_next_leaves").alias("near_next"), "edit_section", "edit_paragraph")
