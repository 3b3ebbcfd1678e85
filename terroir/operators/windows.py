"""Skew-tolerant window building blocks.

A ``Window.partitionBy(key)`` puts all rows of a key into one task; with one key
holding a third of the rows that task is a third of the job.  These helpers keep the
exact semantics while splitting hot keys:

* ``top_k_per_group`` - salted two-stage top-k: the per-(group, salt) top-k is a
  superset of the group's top-k, so stage two only sees ``salts * k`` rows per group.
* ``bounded_history`` - the last ``n`` rows (a ``rowsBetween(-(n-1), 0)`` frame) per
  key, computed per (key, time chunk) plus a carry of the previous chunks' last
  ``n-1`` rows.  The carry step works on per-chunk tails (at most ``n-1`` rows per
  chunk), so no task ever holds a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group_cols, order: list[Column], k: int, salts: int = 256,
                    rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k per group by ``order`` (which must be a total order)."""
    group_cols = list(group_cols)
    salt = F.pmod(F.xxhash64(*[o for o in order]), F.lit(salts))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    stage1 = df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= k)
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return (stage1.withColumn(rank_col, F.row_number().over(w2)).filter(F.col(rank_col) <= k)
            .drop("_salt", "_r1"))


def bounded_history(df: DataFrame, key_cols, order_cols, payload_cols, n: int, chunk: Column,
                    out: str = "history") -> DataFrame:
    """Add ``out``: the last ``n`` rows (ordered by ``order_cols``) of the row's key, itself included.

    ``order_cols`` must be a total order within a key and ``chunk`` a non-decreasing
    function of it (e.g. ``floor(ts / 1 day)``).  Each history element is a struct of
    ``order_cols + payload_cols``.
    """
    key_cols, order_cols, payload_cols = list(key_cols), list(order_cols), list(payload_cols)
    fields = order_cols + [c for c in payload_cols if c not in order_cols]
    elem = F.struct(*[F.col(c) for c in fields])
    base = df.withColumn("_chunk", chunk).withColumn("_elem", elem)
    part = key_cols + ["_chunk"]
    w_local = Window.partitionBy(*part).orderBy(*order_cols).rowsBetween(-(n - 1), 0)
    w_desc = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order_cols])
    local = (base.withColumn("_local", F.collect_list("_elem").over(w_local))
             .withColumn("_rdesc", F.row_number().over(w_desc)))
    if n == 1:
        return local.withColumn(out, F.col("_local")).drop("_chunk", "_elem", "_local", "_rdesc")
    tails = (local.filter(F.col("_rdesc") < n).groupBy(*part)
             .agg(F.sort_array(F.collect_list("_elem")).alias("_tail")))
    w_prev = Window.partitionBy(*key_cols).orderBy("_chunk").rowsBetween(-(n - 1), -1)
    carry = tails.withColumn("_prev", F.flatten(F.collect_list("_tail").over(w_prev))).select(
        *part, F.when(F.size("_prev") > n - 1, F.slice("_prev", -(n - 1), n - 1)).otherwise(F.col("_prev")).alias("_carry"))
    joined = local.join(carry, on=part, how="left")
    hist =F.when(F.col("_carry").isNull(), F.col("_local")).otherwise(F.concat(F.col("_carry"), F.col("_local")))
    hist = F.when(F.size(hist) > n, F.slice(hist, -n, n)).otherwise(hist)
    return joined.withColumn(out, hist).drop("_chunk", "_elem", "_local", "_rdesc", "_carry")


def day_chunk(ts_us: str = "ts_us", days: int = 1) -> Column:
    """Chunk id of an epoch-microsecond column (``days``-wide chunks)."""
    return F.floor(F.col(ts_us) / F.lit(days * 86_400_000_000)).cast("long")


def prefix_sum(df: DataFrame, part_cols, order_col: str, value_col: str, chunk: Column, out: str = "prefix") -> DataFrame:
    """Sum of ``value_col`` over the rows before this one (by ``order_col``, unique per part).

    Computed per (part, chunk) with a local running sum plus an offset from the
    previous chunks' totals; ``chunk`` must be non-decreasing in ``order_col``.  No
    window ever spans a whole part.
    """
    part_cols = list(part_cols)
    base = df.withColumn("_chunk", chunk)
    w_in = Window.partitionBy(*part_cols, "_chunk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    local = base.withColumn("_run", F.coalesce(F.sum(value_col).over(w_in), F.lit(0)))
    totals = base.groupBy(*part_cols, "_chunk").agg(F.sum(value_col).alias("_tot"))
    w_prev = Window.partitionBy(*part_cols).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part_cols, "_chunk", F.coalesce(F.sum("_tot").over(w_prev), F.lit(0)).alias("_off"))
    return (local.join(offsets, part_cols + ["_chunk"], "left")
            .withColumn(out, F.col("_off") + F.col("_run")).drop("_chunk", "_run", "_off"))
