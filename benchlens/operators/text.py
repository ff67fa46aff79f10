"""Log and source-text operators: token usage, event rates, tails, command segments, outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchlens.functions.scalar import duration_seconds, duration_text, error_cmd, error_code
from benchlens.operators.joins import group_join
from benchlens.operators.matching import count_patterns
from benchlens.operators.ordered import running, top_n_per_group


def token_usage(lines: DataFrame, text: str, tokens: Sequence[str], by: Sequence[str] = (),
                lower: bool = True) -> DataFrame:
    """Occurrences of each token as a whole word (maximal letter run), per group.

    Output (by..., token, n, total): ``total`` is the group's mentions of all
    ``tokens``, which may be a long list: one pass finds them all. Null group keys are a group. ``token_remainder`` gives what a
    classification of the lines leaves unexplained.
    """
    t = F.lower(F.col(text)) if lower else F.col(text)
    found = count_patterns(lines.select(*by, t.alias("_line")), "_line", tokens, by, whole_words=True)
    counts = found.withColumnRenamed("pattern", "token")
    return _with_total(counts, by, "total")


def usage_kind(text: Column | str, kinds: dict[str, str]) -> Column:
    """First matching kind of a line; ``kinds`` maps kind -> regex (checked in order)."""
    t = F.col(text) if isinstance(text, str) else text
    out = None
    for kind, pat in kinds.items():
        cond = t.rlike(pat)
        out = F.when(cond, F.lit(kind)) if out is None else out.when(cond, F.lit(kind))
    return out.otherwise(F.lit(None).cast("string"))


def token_remainder(lines: DataFrame, text: str, tokens: Sequence[str], kinds: dict[str, str],
                    by: Sequence[str] = (), lower: bool = True) -> DataFrame:
    """All mentions of ``tokens``, split by the kind of their line, and what no kind explains.

    (by..., kind, n, mentions, unexplained): ``n`` mentions lie on lines of
    ``kind`` (``usage_kind``; null: none fits), ``mentions`` is the group's total
    and ``unexplained`` what is left of it after all named kinds.
    """
    t = F.lower(F.col(text)) if lower else F.col(text)
    found = F.regexp_count(t, F.lit(r"(?<!\p{L})(?:" + "|".join(_quote(x) for x in tokens) + r")(?!\p{L})")).cast("long")
    each = lines.select(*by, usage_kind(t, kinds).alias("kind"), found.alias("c")).where("c > 0")
    counts = each.groupBy(*by, "kind").agg(F.sum("c").alias("n"))
    group = Window.partitionBy(*by)  # over at most one row per kind and group
    return counts.withColumns({"mentions": F.sum("n").over(group), "unexplained": F.coalesce(
        F.sum(F.when(F.col("kind").isNull(), F.col("n"))).over(group), F.lit(0).cast("long"))})


def _quote(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() else ch for ch in s)


def event_rate(events: DataFrame, by: Sequence[str], kind: str, per: float = 1000.0) -> DataFrame:
    """Events of each kind per ``per`` events of the group: (by..., kind, n, total, rate).

    One aggregate over the events; the group total is a window over the
    aggregated rows (at most one row per kind in a group), so events are read once.
    """
    counts = events.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by))
    return (counts.withColumn("total", total)
            .withColumn("rate", F.lit(per) * F.col("n") / F.col("total")))


def tail_matching(lines: DataFrame, by: Sequence[str], order: Sequence[Column], cond: Column,
                  n: int) -> DataFrame:
    """Last ``n`` rows per group that satisfy ``cond`` (``order`` descending = newest first)."""
    return top_n_per_group(lines.where(cond), by, order, n)


def log_segments(lines: DataFrame, by: Sequence[str], order: Sequence[str], is_start: Column,
                 ts: str | None = None) -> DataFrame:
    """Split ordered log lines into segments that each begin at a start line.

    Segment 0 holds the lines before the first start. Output: (by..., segment,
    n_lines, first_line, last_line[, duration_s, duration]). The running start
    count is computed with the skew-safe ``running`` helper.
    """
    marked = lines.withColumn("_st", F.when(is_start, F.lit(1)).otherwise(F.lit(0)))
    seg = running(marked, list(by), list(order), sums={"segment": "_st"}, index="line_pos")
    seg = seg.withColumn("segment", F.col("segment").cast("long"))
    aggs = [F.count(F.lit(1)).alias("n_lines"), F.min("line_pos").alias("first_line"),
            F.max("line_pos").alias("last_line")]
    if ts:
        # Difference of the column's own values: no time-zone conversion.
        aggs.append((F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts)) / F.lit(1e6)).alias("duration_s"))
    out = seg.groupBy(*by, "segment").agg(*aggs)
    if ts:
        out = out.withColumn("duration", duration_text("duration_s"))
    return out


# The marks of a run log.
COMMAND_MARK = "+ "
TIME_MARK = "Total benchmarking time: "


def run_log(lines: DataFrame, by: Sequence[str], line_no: str, text: str) -> DataFrame:
    """Run-log lines -> one row per command.

    (by..., segment, cmd, n_lines, first_line, last_line, seconds, error_cmd,
    error_code): a line that begins with ``+ `` starts a segment with the
    command after it (segment 0: lines before the first); ``seconds`` comes
    from the segment's duration line, the error from its error line (null if
    there is none).
    """
    t = F.col(text)
    start = t.startswith(COMMAND_MARK)
    marked = lines.select(*by, F.col(line_no).alias("line_pos"), t.alias("_t"),
                          F.when(start, F.lit(1)).otherwise(F.lit(0)).alias("_st"))
    seg = running(marked, list(by), ["line_pos"], sums={"segment": "_st"}, index=None)
    took = F.when(F.col("_t").startswith(TIME_MARK), duration_seconds(F.substring("_t", len(TIME_MARK) + 1, 1 << 30)))
    command = F.when(F.col("_st") == 1, F.expr(f"substring(_t, {len(COMMAND_MARK) + 1})"))
    return seg.groupBy(*by, F.col("segment").cast("long").alias("segment")).agg(
        F.max(command).alias("cmd"), F.count(F.lit(1)).alias("n_lines"), F.min("line_pos").alias("first_line"),
        F.max("line_pos").alias("last_line"), F.max(took).alias("seconds"), F.max(error_cmd("_t")).alias("error_cmd"),
        F.max(error_code("_t")).alias("error_code"))


OUTCOMES = ("ok", "failed")


def outcome_summary(outcomes: DataFrame, by: Sequence[str] = (), status: str = "status") -> DataFrame:
    """Per group and status: n, total, share and the 'k/n ... succeeded|failed' line.

    A group has a line for both statuses, also for none of its packages.
    """
    counts = [F.count_if(F.col(status) == s).alias(s) for s in OUTCOMES]
    g = outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts).where("total > 0")
    rows = g.select(*by, "total", F.inline(F.array(*[
        F.struct(F.lit(s).alias(status), F.col(s).alias("n"),
                 F.lit("succeeded" if s == OUTCOMES[0] else "failed").alias("_verb")) for s in OUTCOMES])))
    return rows.select(*by, status, "n", "total", (F.col("n") / F.col("total")).alias("share"), F.format_string(
        "%d/%d packages %s", F.col("n"), F.col("total"), F.col("_verb")).alias("summary"))


def outcome_list(outcomes: DataFrame, name: str, by: Sequence[str] = (), status: str = "status") -> DataFrame:
    """The succeeded and the failed packages, one row each: (by..., status, name)."""
    return outcomes.select(*by, status, name).distinct()


def _with_total(counts: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Add the group's sum of ``n``: a small aggregate joined back, or a scalar subquery."""
    if not by:
        return counts.withColumn(name, counts.agg(F.sum("n")).scalar())
    tot = counts.groupBy(*by).agg(F.sum("n").alias(name))
    return group_join(counts, tot, by)
