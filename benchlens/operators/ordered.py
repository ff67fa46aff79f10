"""Order-dependent building blocks that stay distributed when one group is huge.

``Window.partitionBy(g).orderBy(o)`` sends each group ``g`` to one task. When a
single group holds a large share of all rows (one program, one file, one
duplicate key), that task does all the work. The helpers here split every
group into ordered range buckets of the first order column, compute local
results per (group, bucket) in parallel, and add the totals of the earlier
buckets of the groups that lie in more than one, joined back on the same keys
(the large side is already hash-partitioned on them). One plan serves every
input size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from benchlens.session import checkpoint_dir

_BUCKET = "_ord_bucket"


def _as_number(df: DataFrame, c: str) -> Column | None:
    """The column as a double that does not decrease along it; None for types without one."""
    dt = df.schema[c].dataType
    if isinstance(dt, T.TimestampNTZType):  # wall-clock values: micros since the epoch, no zone
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                                F.col(c)).cast("double")
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(F.col(c)).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(F.col(c)).cast("double")
    if isinstance(dt, T.NumericType | T.BooleanType):
        return F.col(c).cast("double")
    return None


def _bucket_of(v: Column, bounds: list[Column], lo: int, hi: int) -> Column:
    """Balanced CASE tree: index of the range bucket of ``v`` (log2 depth, codegen'd)."""
    if lo >= hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(v < bounds[mid], _bucket_of(v, bounds, lo, mid)).otherwise(_bucket_of(v, bounds, mid + 1, hi))


MAX_TREE_BUCKETS = 1024
MAX_FINE_BUCKETS = 64  # inside one bucket of the tree, for orders without numbers
ROWS_PER_BUCKET = 1_000_000
SAMPLED_KEYS = 8  # sampled for each limit between buckets, for orders without numbers
KEY_LENGTH = 64  # characters (bytes) of a sampled text (binary) key


def range_buckets(df: DataFrame, order_col: str, n_buckets: int | None = None) -> Column:
    """Column with the range bucket of ``order_col``; buckets are non-decreasing in its ascending order, nulls first.

    Any type that Spark can order will do. About one bucket per
    ``ROWS_PER_BUCKET`` rows, but never fewer than the cluster has task slots,
    whatever the size. Nulls are in bucket 0. Numbers, times and booleans are
    cut at quantiles (``_number_buckets``), all else at sampled keys
    (``_key_buckets``).
    """
    v = _as_number(df, order_col)
    bucket = _key_buckets(df, order_col, n_buckets) if v is None else _number_buckets(df, v, n_buckets)
    return F.when(F.col(order_col).isNull(), F.lit(0)).otherwise(bucket)


def _wanted_buckets(df: DataFrame, rows: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_BUCKET))


def _number_buckets(df: DataFrame, v: Column, n_buckets: int | None) -> Column:
    """Buckets of a numeric expression.

    One small aggregate job returns approximate quantiles (at most
    ``MAX_TREE_BUCKETS`` + 1 numbers reach the driver) and the row count. Up to
    ``MAX_TREE_BUCKETS`` buckets are a balanced CASE tree over the limits;
    beyond that each quantile range is cut into equal-width sub-buckets
    arithmetically (its two limits are looked up by index), so any bucket count
    costs O(log 1024) per row and the plan stays small.
    """
    grid = MAX_TREE_BUCKETS if n_buckets is None else max(1, min(n_buckets, MAX_TREE_BUCKETS))
    finite = F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)  # limits are finite; what is beyond sorts behind them
    probs = ", ".join(f"{i / grid!r}D" for i in range(0, grid + 1))  # one text: a call to the JVM for each would take a second
    row = df.select(finite.alias("_v")).select(F.expr(f"percentile_approx(_v, array({probs}), 10000)").alias("q"),
                                               F.count(F.lit(1)).alias("n")).first()
    n = n_buckets or _wanted_buckets(df, int(row["n"] or 0))
    if row["q"] is None:  # no value to cut at
        return F.lit(0)
    qs = [float(q) for q in row["q"]]
    coarse = min(n, grid)
    fine = -(-n // coarse)
    # Interior limits at probabilities i / coarse, taken from the quantile grid.
    bounds = sorted({qs[round(i * grid / coarse)] for i in range(1, coarse)})
    c = _bucket_of(v, [F.lit(x) for x in bounds], 0, len(bounds)) if bounds else F.lit(0)
    if fine <= 1:
        return c
    lows = F.array(*[F.lit(x) for x in [qs[0], *bounds]])
    highs = F.array(*[F.lit(x) for x in [*bounds, qs[-1]]])
    lo = F.element_at(lows, c + 1)
    hi = F.element_at(highs, c + 1)
    inside = F.least(F.floor((v - lo) / (hi - lo) * F.lit(fine)), F.lit(fine - 1))
    sub = F.when(v <= lo, F.lit(0)).when(v >= hi, F.lit(fine - 1)).otherwise(inside)  # NaN is above all numbers
    return (c * F.lit(fine) + sub).cast("long")


def _key_buckets(df: DataFrame, order_col: str, n_buckets: int | None) -> Column:
    """Buckets of a column of any ordered type, by limits that Spark itself compares.

    Limits are sampled keys (texts and binaries cut to ``KEY_LENGTH``; a limit
    need not be a value), ``SAMPLED_KEYS`` for each, sorted by Spark; they are
    all that reaches the driver. The first ``MAX_TREE_BUCKETS`` limits are a
    CASE tree; each bucket of it may be cut by up to ``MAX_FINE_BUCKETS``
    further ones.
    """
    dt = df.schema[order_col].dataType
    key = F.col(order_col)
    short = F.substring(key, 1, KEY_LENGTH) if isinstance(dt, T.StringType | T.BinaryType) else key
    rows = df.select(F.count(key)).first()[0]
    n = min(n_buckets or _wanted_buckets(df, rows), MAX_TREE_BUCKETS * MAX_FINE_BUCKETS)
    if n <= 1 or not rows:
        return F.lit(0)
    kept = df.where(key.isNotNull()).select(short.alias("k"))
    share = 2.0 * SAMPLED_KEYS * n / rows  # twice as many, as a sample's size varies; small inputs are taken whole
    sampled = kept if share >= 1 else kept.sample(share, seed=n)
    found = [r[0] for r in sampled.sort("k").select(F.to_json(F.struct("k"))).limit(4 * SAMPLED_KEYS * n + 100).collect()]
    limits = list(dict.fromkeys(found[i * len(found) // n] for i in range(1, n))) if found else []
    if not limits:
        return F.lit(0)
    as_key = lambda text: F.from_json(F.lit(text), T.StructType([T.StructField("k", dt)]))["k"]
    step = -(-len(limits) // MAX_TREE_BUCKETS)
    tree = limits[step - 1::step]  # every step-th limit parts two buckets of the tree
    c = _bucket_of(key, [as_key(x) for x in tree], 0, len(tree))
    if step == 1:
        return c
    inner = [limits[i * step:i * step + step - 1] for i in range(len(tree) + 1)]
    table = F.from_json(F.lit("[" + ",".join("[" + ",".join(x) + "]" for x in inner) + "]"),
                        T.ArrayType(T.ArrayType(T.StructType([T.StructField("k", dt)]))))
    passed = F.size(F.filter(F.element_at(table, c + 1), lambda x: x["k"] <= key))
    return c * F.lit(step) + passed


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint into the shared checkpoint folder.

    Used before chains of ordered steps, whose bucket-limit jobs would
    otherwise each recompute the whole upstream plan.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _group_cols(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Non-null stand-ins for the group keys (value or default, plus a null flag).

    Partitioning the local window and the join back by the same non-null
    columns lets the join reuse the window's hash partitioning (a plain equi
    join; a null-safe join would re-shuffle the large side).
    """
    names, cols = [], {}
    for i, k in enumerate(keys):
        dt = df.schema[k].dataType
        if isinstance(dt, T.StringType):
            value, default = F.col(k), F.lit("")
        elif isinstance(dt, T.BinaryType):
            value, default = F.col(k), F.lit(b"")
        elif isinstance(dt, T.NumericType | T.BooleanType):
            value, default = F.col(k), F.lit(0).cast(dt)
        elif isinstance(dt, T.DateType | T.TimestampType | T.TimestampNTZType):
            value, default = F.col(k), F.lit("1970-01-01").cast(dt)
        else:  # nested values: their text
            value, default = F.to_json(F.struct(k)), F.lit("")
        cols[f"_gv{i}"] = F.when(F.col(k).isNull(), default).otherwise(value)
        cols[f"_gn{i}"] = F.col(k).isNull()
        names += [f"_gv{i}", f"_gn{i}"]
    return df.withColumns(cols), names


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
            sums: dict[str, Column | str] | None = None, index: str | None = "_i",
            total: str | None = None, bucket_on: str | None = None,
            n_buckets: int | None = None, bucket: Column | None = None) -> DataFrame:
    """Add a 1-based row index and running sums inside ``keys``, in ``order``.

    ``order`` must be a total order inside a group (add a unique tie-breaker);
    ascending columns have their nulls first. The first may be of any type that
    Spark can order.
    ``total`` adds the group's row count. ``bucket_on`` names the column the
    range buckets are cut on (default: the first order column, which must be a
    plain column name). ``bucket`` passes ready bucket numbers (from
    ``range_buckets``) so several steps can share one limit job; they must be
    non-decreasing along ``order``.
    """
    sums = dict(sums or {})
    keys = list(keys)
    first = bucket_on or order[0]
    if not isinstance(first, str):
        raise ValueError("running(): give bucket_on= when the first order item is an expression")
    bk = bucket if bucket is not None else range_buckets(df, first, n_buckets)
    b, gk = _group_cols(df.withColumn(_BUCKET, bk), keys)
    in_bucket = Window.partitionBy(*gk, _BUCKET)
    w_local = in_bucket.orderBy(*order)
    frame = w_local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {name: F.col(c) if isinstance(c, str) else c for name, c in sums.items()}
    local_cols = {"_li": F.row_number().over(w_local)}
    local_cols.update({f"_ls_{name}": F.sum(c).over(frame) for name, c in sums.items()})
    if total:
        local_cols["_lt"] = F.count(F.lit(1)).over(in_bucket)
    loc = b.withColumns(local_cols)

    # Totals need no order: a partial aggregate in the scan stage, one row per (group, bucket) and task.
    tot = b.groupBy(*gk, _BUCKET).agg(
        F.count(F.lit(1)).alias("_bn"), *[F.sum(c).alias(f"_bs_{name}") for name, c in sums.items()])
    of_group = Window.partitionBy(*gk)
    w_prev = of_group.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    off_cols = {"_oi": F.coalesce(F.sum("_bn").over(w_prev), F.lit(0))}
    for name in sums:
        off_cols[f"_os_{name}"] = F.coalesce(F.sum(f"_bs_{name}").over(w_prev), F.lit(0.0))
    off_cols["_gt"] = F.sum("_bn").over(of_group)
    # Groups that lie in one bucket need no offset, so they are not joined at all.
    off = tot.withColumns(off_cols).where(F.col("_gt") > F.col("_bn")).drop("_bn", *[f"_bs_{n}" for n in sums])

    out = loc.join(off, on=[*gk, _BUCKET], how="left")
    final = {}
    if index:
        final[index] = (F.col("_li") + F.coalesce("_oi", F.lit(0))).cast("long")
    for name in sums:
        final[name] = F.col(f"_ls_{name}") + F.coalesce(f"_os_{name}", F.lit(0.0))
    if total:
        final[total] = F.coalesce("_gt", "_lt").cast("long")
    out = out.withColumns(final)
    drop = ["_li", "_oi", "_lt", _BUCKET, "_gt", *gk] + [f"_ls_{n}" for n in sums] + [f"_os_{n}" for n in sums]
    return out.drop(*[c for c in drop if c not in final])


def top_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                    rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..n inside each group (``order`` must be a total order).

    The filter on the row number lets every task cut its own part of a group
    to n rows before the shuffle (WindowGroupLimit), so a hot group sends only
    n rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def global_index(df: DataFrame, order: Sequence[Column | str], index: str = "_gi",
                 total: str | None = None, bucket_on: str | None = None,
                 n_buckets: int | None = None) -> DataFrame:
    """0-based position of each row in ``order`` over the whole DataFrame.

    Never a single-partition window: rows are cut into range buckets, numbered
    inside each bucket in parallel, and shifted by the (tiny) bucket totals.
    """
    out = running(df, [], order, index="_gi1", total=total, bucket_on=bucket_on,
                  n_buckets=n_buckets)
    return out.withColumn(index, F.col("_gi1") - 1).drop("_gi1")
