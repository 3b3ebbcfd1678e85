"""Cleaning operators.

Bounds and statistics are fitted with one distributed pass each and come back as
literals (fitted parameters: one value per column), so the filters that apply them
are plain conjunctive predicates inside whole-stage codegen.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import knowledge as K
from .quantiles import exact_quantiles


def remove_duplicates(df: DataFrame, subset=None) -> DataFrame:
    """Drop exact duplicate rows (over ``subset`` columns when given)."""
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


@dataclass(frozen=True)
class Bounds:
    column: str
    q1: float
    q3: float
    lower: float
    upper: float


def iqr_bounds(df: DataFrame, cols, k: float = K.IQR_K, method: str = "exact") -> dict[str, Bounds]:
    """A3: linear-interpolated quartiles +- k * IQR per column."""
    qs = exact_quantiles(df, cols, [0.25, 0.75], method=method)
    out = {}
    for c in cols:
        q1, q3 = qs.get(((), c, 0.25)), qs.get(((), c, 0.75))
        if q1 is None:
            continue
        iqr = q3 - q1
        out[c] = Bounds(c, q1, q3, q1 - k * iqr, q3 + k * iqr)
    return out


def zscore_params(df: DataFrame, cols) -> dict[str, tuple[float, float]]:
    """A4 as fitted parameters: ``{column: (mean, population std)}``."""
    row = df.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0]
    return {c: (row[f"c{i}"][0], row[f"c{i}"][1]) for i, c in enumerate(cols)}


def within(c: str, lo: float, hi: float):
    """Inclusive bounds; null/NaN fail (outlier filters drop missing values)."""
    v = F.col(c)
    return F.coalesce(~F.isnan(v) & v.between(F.lit(lo), F.lit(hi)), F.lit(False))


def remove_outliers_iqr(df: DataFrame, cols, k: float = K.IQR_K, method: str = "exact"):
    """P10: column by column, bounds recomputed on the rows that survived earlier columns.

    Returns ``(filtered, steps)`` with one step row per column.  The input is persisted
    once (each step re-reads survivors) and released by the caller via ``unpersist``.
    """
    cur = df
    steps = []
    for c in cols:
        b = iqr_bounds(cur, [c], k, method).get(c)
        if b is None:
            continue
        cur = cur.filter(within(c, b.lower, b.upper))
        steps.append((c, b.q1, b.q3, b.lower, b.upper))
    spark = df.sparkSession
    report = spark.createDataFrame(steps, "column string, q1 double, q3 double, lower double, upper double")
    return cur, report


def remove_outliers_zscore(df: DataFrame, cols, threshold: float = K.Z_THRESHOLD):
    """Sequential like P10, with population mean/std and a strict ``<`` threshold."""
    cur = df
    steps = []
    for c in cols:
        m, s = zscore_params(cur, [c])[c]
        if m is None:
            continue
        z = F.abs((F.col(c) - F.lit(m)) / F.lit(s))
        cur = cur.filter(F.coalesce(z < threshold, F.lit(False)))
        steps.append((c, m, s))
    report = df.sparkSession.createDataFrame(steps, "column string, mean double, std double")
    return cur, report


def apply_iqr_bounds(df: DataFrame, bounds: dict[str, Bounds]) -> DataFrame:
    """Keep rows inside every column's bounds (one conjunctive filter)."""
    cond = F.lit(True)
    for b in bounds.values():
        cond = cond & within(b.column, b.lower, b.upper)
    return df.filter(cond)


def apply_zscore(df: DataFrame, stats: dict[str, tuple[float, float]], threshold: float = K.Z_THRESHOLD) -> DataFrame:
    """One mask; columns with zero (or missing) std are skipped at plan time."""
    cond = F.lit(True)
    for c, (m, s) in stats.items():
        if not s:
            continue
        cond = cond & F.coalesce(F.abs((F.col(c) - F.lit(m)) / F.lit(s)) < threshold, F.lit(False))
    return df.filter(cond)


def removal_guard(original: DataFrame, keep: "F.Column", limit: float = K.REMOVAL_LIMIT, mode: str = "revert"):
    """If more than ``limit`` of rows would go, raise / revert to the input / allow.

    Both counts come from one pass (``avg`` of the keep flag).
    """
    share_removed = original.agg((F.lit(1.0) - F.avg(F.when(keep, 1.0).otherwise(0.0))).alias("r")).collect()[0]["r"]
    share_removed = share_removed or 0.0
    exceeded = share_removed > limit
    if exceeded and mode == "raise":
        raise ValueError(f"removal of {share_removed:.2%} exceeds {limit:.0%}")
    result = original if (exceeded and mode == "revert") else original.filter(keep)
    return result, share_removed, exceeded


def clip_to_bounds(df: DataFrame, bounds: dict[str, Bounds]) -> DataFrame:
    """Clip each column to its bounds (nulls stay null)."""
    return df.withColumns({
        b.column: F.when(F.col(b.column) < b.lower, F.lit(b.lower))
                   .when(F.col(b.column) > b.upper, F.lit(b.upper)).otherwise(F.col(b.column))
        for b in bounds.values()})


def clip_report(df: DataFrame, bounds: dict[str, Bounds], by=None) -> DataFrame:
    """Low and high hits per column (optionally per ``by`` group, e.g. split)."""
    aggs = []
    for i, b in enumerate(bounds.values()):
        aggs += [F.count_if(F.col(b.column) < b.lower).alias(f"lo{i}"), F.count_if(F.col(b.column) > b.upper).alias(f"hi{i}")]
    g = df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)
    items = [F.struct(F.lit(b.column).alias("column"), F.col(f"lo{i}").cast("bigint").alias("low_hits"),
                      F.col(f"hi{i}").cast("bigint").alias("high_hits")) for i, b in enumerate(bounds.values())]
    keep = [by] if by else []
    return g.select(*keep, F.inline(F.array(*items)))
