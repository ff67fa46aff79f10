"""Occurrences of many patterns in one pass over the texts (an Aho-Corasick automaton a task)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MOST_COUNTS = 500_000  # (group, pattern) counts that a task holds before it passes them on


def count_patterns(df: DataFrame, text: str, patterns: Sequence[str], by: Sequence[str] = (), whole_words: bool = False) -> DataFrame:
    """(by..., pattern, n): overlapping occurrences of each pattern that occurs, per group.

    Patterns may contain or begin with each other; every occurrence of every
    pattern counts, in one pass however long the list is. With ``whole_words``
    an occurrence must not touch another letter on either side. Null texts have
    no occurrence, null group keys are a group, and patterns that repeat count
    once; an empty pattern never occurs. The list is sent to every task with
    the function; counts are added up in the tasks before they are shuffled.
    """
    by = list(by)
    wanted = sorted({p for p in patterns if p})
    fields = [df.schema[c] for c in by]
    schema = T.StructType([*fields, T.StructField("pattern", T.StringType()), T.StructField("n", T.LongType())])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in wanted:
            automaton.add_word(p, p)
        automaton.make_automaton()
        counts: Counter = Counter()
        types: list[pa.DataType] = []

        def rows() -> pa.RecordBatch:
            keys = list(counts)
            columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names=schema.names)

        for b in batches:
            types = [*[b.schema.field(i).type for i in range(len(by))], pa.string()]
            groups = list(zip(*[b.column(i).to_pylist() for i in range(len(by))])) if by else [()] * b.num_rows
            for group, value in zip(groups, b.column(len(by))):
                t = value.as_py()
                if not t:
                    continue
                if whole_words:
                    found = Counter(p for end, p in automaton.iter(t) if not (
                        (end + 1 < len(t) and t[end + 1].isalpha()) or (end >= len(p) and t[end - len(p)].isalpha())))
                else:
                    found = Counter(p for _, p in automaton.iter(t))
                for p, n in found.items():
                    counts[(*group, p)] += n
            if len(counts) > _MOST_COUNTS:
                yield rows()
                counts.clear()
        if counts:
            yield rows()

    if not wanted:
        return df.sparkSession.createDataFrame([], schema)
    # keys of a group as Python values must be hashable: nested ones are not
    got = df.select(*by, F.col(text).cast("string").alias("_text")).mapInArrow(work, schema)
    return got.groupBy(*by, "pattern").agg(F.sum("n").alias("n"))
