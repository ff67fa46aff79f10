"""Fact-to-dimension joins with a measured broadcast decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest dimension (in-memory bytes, measured) that is broadcast to every executor.
MAX_BROADCAST_BYTES = 256 * 1024 * 1024


def _width(dt: T.DataType) -> int:
    if isinstance(dt, T.BooleanType | T.ByteType):
        return 1
    if isinstance(dt, T.ShortType):
        return 2
    if isinstance(dt, T.IntegerType | T.FloatType | T.DateType):
        return 4
    if isinstance(dt, T.DecimalType):
        return 16
    return 8


def measured_bytes(df: DataFrame) -> int:
    """Bytes of ``df`` as rows in memory: fixed widths, string/binary lengths, and the text size of
    arrays, maps and structs, which their binary form does not exceed by much (one job)."""
    fixed, var = 16, []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            var.append(F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)).cast("long") + F.lit(8))
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            text = F.to_json(F.struct(F.col(f.name)))
            var.append(4 * F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(16))
        else:
            fixed += _width(f.dataType)
    total = F.count(F.lit(1)) * F.lit(fixed)
    for v in var:
        total = total + F.sum(v)
    return int(df.agg(total.alias("b")).first()["b"] or 0)


def group_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Inner or left equi-join on group keys, where a null key is a group like any other."""
    own = {c: f"_group{i}" for i, c in enumerate(on)}
    named = right.withColumnsRenamed(own)
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in own.items()]
    return left.join(named, same, how).drop(*own.values())


def dim_join(fact: DataFrame, dim: DataFrame, on: str | Sequence[str], how: str = "inner",
             max_bytes: int = MAX_BROADCAST_BYTES, null_keys: bool = False) -> DataFrame:
    """Join a fact table to a dimension; broadcast the dimension only when its measured size
    is under ``max_bytes``, else leave the shuffle join (and AQE) to Spark. With ``null_keys``
    (inner and left joins) null keys meet each other."""
    keys = [on] if isinstance(on, str) else list(on)
    side = F.broadcast(dim) if measured_bytes(dim) <= max_bytes else dim
    return group_join(fact, side, keys, how) if null_keys else fact.join(side, on=keys, how=how)
