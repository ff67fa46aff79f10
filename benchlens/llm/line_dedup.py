"""Repeated lines: hash ranges in order of document and position, results as keep bitmaps.

Every line with a key becomes a small row (128-bit hash, document, position);
no text is moved. Rows are dealt into ranges of the hash, each range cut into
slices of the documents (so a line that a third of all documents holds lies in
many tasks), and ordered by hash, document and position inside. There a look
at the row before tells the first occurrence of a key and of a document under
a key. A line's number of documents is the sum over its slices. What goes is
returned per document as a bitmap in run lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE_BITS = 12  # leading bits of a hash that make its range
SLICES = 64  # of the documents, in every range
WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ROW = ["_doc", "_t1", "_t2"]  # a row: its id and a 128-bit hash of its text
_KEY = ["_h1", "_h2"]


def ascii_lower(c: Column) -> Column:
    """``c`` with A-Z lower-cased and nothing else."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def whole_text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def row_key(id_col: str, text_col: str) -> list[Column]:
    text = whole_text(text_col)
    return [F.col(id_col).alias("_doc"), F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(1), text).alias("_t2")]


def keyed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, _pos, _h1, _h2) of every line whose key (stripped, A-Z lower-cased) is not empty."""
    keys = F.transform(lines_of(ascii_lower(whole_text(text_col))), lambda x: F.btrim(x, F.lit(WHITE)))
    cut = docs.select(*row_key(id_col, text_col), F.posexplode(keys).alias("_pos", "_line")).where("_line <> ''")
    return cut.select(*_ROW, "_pos", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit(1), F.col("_line")).alias("_h2"))


def dropped_lines(lines: DataFrame, at_least: int, keep_first: bool) -> DataFrame:
    """(row, _pos) of the lines of keys in ``at_least`` documents or more; with ``keep_first`` but the first of each."""
    placed = lines.withColumns({"_range": F.shiftrightunsigned("_h1", 64 - RANGE_BITS),
                                "_slice": F.pmod(F.xxhash64("_doc"), F.lit(SLICES))})
    order = Window.partitionBy("_range", "_slice").orderBy(*_KEY, *_ROW, "_pos")
    key = F.struct(*_KEY)
    before = F.lag(F.struct(key.alias("k"), F.col("_doc").alias("d"))).over(order)
    streamed = placed.withColumn("_before", before)
    same_key = F.coalesce(F.col("_before.k") == key, F.lit(False))
    streamed = streamed.withColumns({
        "_new_doc": (~(same_key & F.col("_before.d").eqNullSafe(F.col("_doc")))).cast("int"),
        "_first": F.when(~same_key, F.struct(*_ROW, "_pos"))})
    # one row for each key and slice, from ordered rows; then one sum over the slices of a key
    own = streamed.groupBy("_range", "_slice", *_KEY).agg(F.sum("_new_doc").alias("_n"), F.min("_first").alias("_first"))
    of_key = Window.partitionBy(*_KEY)
    often = own.withColumns({"_docs": F.sum("_n").over(of_key), "_first": F.min("_first").over(of_key)}).where(
        F.col("_docs") >= at_least).select("_slice", *_KEY, "_first")
    found = placed.join(often, ["_slice", *_KEY])
    if keep_first:
        found = found.where(~F.struct(*_ROW, "_pos").eqNullSafe(F.col("_first")))
    return found.select(*_ROW, "_pos")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: int = 2,
                 keep_first: bool = True) -> DataFrame:
    """Compressed keep bitmaps: (_doc, _t1, _t2, dropped), one row for each row that loses a line.

    A line's key is the line without ASCII white space at its ends and with A-Z
    lower-cased; lines without a key always stay. A key that ``at_least``
    different documents hold loses all its lines, or with ``keep_first`` all
    but the one at the least (document, position). ``dropped`` is the bitmap of
    lines that go in run lengths, as ascending structs (start, length).
    (_doc, _t1, _t2) names a row by its id and a 128-bit hash of its text.

    A null text is one empty line. Rows with one id are one document, also the
    rows whose id is null; equal rows share one bitmap. An empty table gives an
    empty result; other columns are not read. Keys are told apart by 128 bits.
    """
    gone = dropped_lines(keyed_lines(docs, id_col, text_col), at_least, keep_first)
    at = gone.groupBy(*_ROW).agg(F.array_sort(F.collect_set("_pos")).alias("_at"))
    places = F.col("_at")
    starts = F.filter(places, lambda p, i: ~F.get(places, i - 1).eqNullSafe(p - 1))
    ends = F.filter(places, lambda p, i: ~F.get(places, i + 1).eqNullSafe(p + 1))
    return at.select(*_ROW, F.zip_with(starts, ends, lambda s, e: F.struct(
        s.alias("start"), (e - s + 1).alias("length"))).alias("dropped"))


def kept_runs(dropped: Column, n_lines: Column) -> Column:
    """The lines that stay, as runs (start, length): the gaps between the ``dropped`` runs."""
    none = F.array().cast("array<int>")
    ends = F.coalesce(F.transform(dropped, lambda r: r["start"] + r["length"]), none)
    starts = F.coalesce(F.transform(dropped, lambda r: r["start"]), none)
    gaps = F.zip_with(F.concat(F.array(F.lit(0)), ends), F.concat(starts, F.array(n_lines)),
                      lambda a, b: F.struct(a.alias("start"), (b - a).alias("length")))
    return F.filter(gaps, lambda r: r["length"] > 0)


def with_kept_text(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept, kept_text) of every row: the texts without the lines that ``bitmaps`` drop.

    ``kept`` holds the runs of lines that stay; kept lines are joined by line feeds.
    """
    rows = docs.select(*row_key(id_col, text_col), whole_text(text_col).alias("_text"))
    same = [rows[c].eqNullSafe(bitmaps[c]) for c in _ROW]
    got = rows.join(bitmaps, same, "left").select(rows["_doc"], "_text", "dropped")
    got = got.withColumn("_lines", lines_of(F.col("_text")))
    got = got.withColumn("kept", kept_runs(F.col("dropped"), F.size("_lines")))
    stay = F.transform("kept", lambda r: F.slice("_lines", r["start"] + 1, r["length"]))
    n_kept = F.aggregate("kept", F.lit(0), lambda a, r: a + r["length"])
    return got.select(F.col("_doc").alias(id_col), F.size("_lines").cast("long").alias("n_lines"),
                      (F.size("_lines") - n_kept).cast("long").alias("n_dropped"), "kept",
                      F.array_join(F.flatten(stay), "\n").alias("kept_text"))
