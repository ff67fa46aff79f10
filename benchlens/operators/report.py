"""Text rendering: the aligned comparison table and per-group template documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchlens.operators.compare import BOTH, FIRST, percent_change, quality_gate
from benchlens.operators.ordered import materialize, running

GAP = "  "
MISSING = "(none)"


@dataclass(frozen=True)
class Field:
    """One printed column: its title, least width, side, and how a value becomes text."""

    title: str
    width: int
    left: bool
    show: Callable[[Column], Column]

    def cell(self, text: Column, width: Column) -> Column:
        """``text`` padded to ``width``; a longer text is never cut."""
        fill = F.repeat(F.lit(" "), F.greatest(width - F.length(text), F.lit(0)).cast("int"))
        return F.concat(text, fill) if self.left else F.concat(fill, text)


def scientific(c: Column) -> Column:
    """Four significant digits, half-to-even before formatting, so the text does not depend on a formatter's ties."""
    scale = F.pow(F.lit(10.0), F.lit(3) - F.floor(F.log10(F.abs(c))))
    rounded = F.when(c == 0, F.lit(0.0)).otherwise(F.rint(c * scale) / scale)
    return F.when(c.isNull(), F.lit(MISSING)).otherwise(F.format_string("%.3e", rounded))


def signed_percent(c: Column) -> Column:
    """One decimal and a percent sign; only gains carry a plus."""
    text = F.when(c > 0, F.format_string("+%.1f%%", c)).otherwise(F.format_string("%.1f%%", c))
    return F.when(c.isNull(), F.lit(MISSING)).otherwise(text)


def table_fields(label1: str, label2: str, label_width: int | None = None) -> list[Field]:
    """Fields of the comparison table; widths are plain numbers that grow with the labels.

    With ``label_width`` longer labels are cut to that many characters.
    """
    label1, label2 = label1[:label_width], label2[:label_width]
    return [Field("Benchmark", 9, True, lambda c: c),
            Field(label1, max(12, len(label1)), False, scientific),
            Field(label2, max(12, len(label2)), False, scientific),
            Field("Change", 10, False, signed_percent)]


def _line(fields: Sequence[Field], first_width: Column, cells: Sequence[Column]) -> Column:
    parts = [f.cell(c, F.lit(f.width) if i else first_width) for i, (f, c) in enumerate(zip(fields, cells))]
    return F.concat_ws(GAP, *parts)


def max_width(df: DataFrame, cols: Sequence[Column], floor: int = 0) -> Column:
    """Widest value over several label columns, as a scalar subquery."""
    widest = F.greatest(*[F.coalesce(F.max(F.length(c)), F.lit(floor)) for c in cols], F.lit(floor))
    return df.agg(widest).scalar()


def change_of_pair(base: Column, new: Column) -> Column:
    """Printed change of a pair: percent, or what IEEE division gives where the base is zero."""
    by_zero = F.when(new > 0, "Infinity%").when(new < 0, "-Infinity%").when(new == 0, "NaN%")
    return F.when(base == 0, F.coalesce(by_zero, F.lit(MISSING))).otherwise(
        signed_percent(percent_change(F.try_divide(new, base))))


def render_report(aligned: DataFrame, bands: DataFrame, label1: str, label2: str, threshold: float = 0.95,
                  row_order: Sequence[str] = ("program",), label_width: int | None = None) -> DataFrame:
    """Lines of the comparison table: (sec, block, row_no, line); the first three give the printed order.

    ``aligned`` comes from ``align_results`` (block, program, side, cpu1, r2_1,
    cpu2, r2_2, ratio) and is computed once (checkpoint); ``bands`` from
    ``geo_bands``. One-sided rows and paired rows are printed only when their
    fits pass the gate. Blocks are in name order, a block's rows in
    ``row_order`` (columns of ``aligned``). ``label_width`` cuts the run labels.
    """
    aligned = materialize(aligned)
    spark = aligned.sparkSession
    fields = table_fields(label1, label2, label_width)
    width = max_width(aligned, [F.col("block"), F.col("program")], fields[0].width)
    rest = sum(len(GAP) + f.width for f in fields[1:])
    rule = F.repeat(F.lit("-"), (width + F.lit(rest)).cast("int"))
    titles = _line(fields, width, [F.lit(f.title) for f in fields])

    def fixed(sec: int, lines: Sequence[Column]) -> DataFrame:
        rows = spark.range(1).select(F.posexplode(F.array(*lines)).alias("i", "line"))
        return rows.select(F.lit(sec).alias("sec"), F.lit("").alias("block"), F.col("i").cast("long").alias("row_no"), "line")

    head = fixed(0, [F.lit("Comparison of two runs"), rule, titles, rule])
    blocks = aligned.select("block").distinct().select(F.lit(1).alias("sec"), "block", F.lit(0).cast("long").alias("row_no"),
                                                       F.col("block").alias("line"))
    side = F.col("side")
    ok1, ok2 = quality_gate("r2_1", threshold), quality_gate("r2_2", threshold)
    shown = aligned.where(F.when(side == BOTH, ok1 & ok2).when(side == FIRST, ok1).otherwise(ok2))
    shown = running(shown, ["block"], list(row_order), index="row_no")
    none = F.lit(MISSING)
    cells = [F.col("program"), fields[1].show(F.col("cpu1")), fields[2].show(F.col("cpu2")),
             F.when(side == BOTH, change_of_pair(F.col("cpu1"), F.col("cpu2"))).otherwise(none)]
    rows = shown.select(F.lit(1).alias("sec"), "block", "row_no", _line(fields, width, cells).alias("line"))
    summary = bands.select(F.lit(2).alias("sec"), F.lit("").alias("block"), F.col("pos").cast("long").alias("row_no"),
                           _line(fields, width, [F.col("label"), F.lit("-"), F.lit("-"),
                                                 fields[3].show(F.col("change_pct"))]).alias("line"))
    out = head.unionByName(blocks).unionByName(rows).unionByName(fixed(2, [rule])).unionByName(summary)
    return out.orderBy("sec", "block", "row_no")


def template_lines(df: DataFrame, group: str, order: str, item: Column, head: Column, tail: Column) -> DataFrame:
    """Lines of one document per group: (``group``, sec, ord, line), in the order of sec and ord.

    Section 0 is the head, 1 one line per item by ``order``, 2 the tail. No
    document becomes a row, so its length has no bound; ``write_texts`` makes
    files of it. ``head`` and ``tail`` are functions of the group alone.
    """
    items = df.select(F.col(group), F.lit(1).alias("sec"), F.col(order).alias("ord"), item.alias("line"))
    ends = df.groupBy(group).agg(F.first(head).alias("_h"), F.first(tail).alias("_t")).select(
        group, F.explode(F.array(F.struct(F.lit(0).alias("sec"), F.col("_h").alias("line")),
                                 F.struct(F.lit(2).alias("sec"), F.col("_t").alias("line")))).alias("_e"))
    none = F.lit(None).cast(df.schema[order].dataType)
    return items.unionByName(ends.select(group, "_e.sec", none.alias("ord"), "_e.line"))


def render_template(df: DataFrame, group: Sequence[str], order: Column | str, item: Column,
                    head: Column, tail: Column, sep: str = "\n") -> DataFrame:
    """One text document per group: head, one line per item (in ``order``), tail.

    The group's lines become one row, so a group's document must fit a row
    (a module list per package).
    """
    o = F.col(order) if isinstance(order, str) else order
    g = df.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct(o.alias("o"), item.alias("l")))).alias("_ls"),
        F.first(head).alias("_h"), F.first(tail).alias("_t"))
    body = F.array_join(F.transform("_ls", lambda x: x["l"]), sep)
    return g.select(*group, F.concat_ws(sep, F.col("_h"), body, F.col("_t")).alias("doc"))
