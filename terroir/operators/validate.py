"""Validation operators (P1-P9, P18-P21): schema reconciliation, row checks, range audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import knowledge as K
from .windows import top_k_per_group

# FIXED VALUES - canonical column names (raw name -> canonical name)
RENAME_MAP = {
    "label": "crop",
    "Output": "fertility_grade",
    "pH": "ph",
    "EC": "ec",
    "OC": "organic_carbon",
    "Nitrogen Value": "N",
    "Phosphorous value": "P",
    "Potassium value": "K",
    "District": "region",
}
LABEL_COLUMNS = ["crop", "fertility_grade", "region"]


def reconcile_schema(df: DataFrame, rename_map=RENAME_MAP) -> tuple[DataFrame, DataFrame]:
    """Rename mapped columns; report ``(position, original, final, renamed)``."""
    present = {k: v for k, v in rename_map.items() if k in df.columns}
    out = df.withColumnsRenamed(present)
    rows = [(i, c, present.get(c, c), c in present) for i, c in enumerate(df.columns)]
    report = df.sparkSession.createDataFrame(rows, "position int, original string, final string, renamed boolean")
    return out, report


def trim_labels(df: DataFrame, cols=LABEL_COLUMNS) -> DataFrame:
    """Trim string label columns (only those present and of string type)."""
    types = dict(df.dtypes)
    return df.withColumns({c: F.trim(F.col(c)) for c in cols if types.get(c) == "string"})


def prune_columns(df: DataFrame, wanted) -> DataFrame:
    """Keep ``wanted`` columns that exist, in the given order."""
    return df.select(*[c for c in dict.fromkeys(wanted) if c in df.columns])


def missing_columns(df: DataFrame, required) -> list[str]:
    """Required columns absent from the schema (plan-time check)."""
    return [c for c in required if c not in df.columns]


def _bound_text(x) -> str:
    return "None" if x is None else repr(float(x))


def row_errors(df: DataFrame, bounds=K.ROW_BOUNDS, seasons=K.SEASONS) -> DataFrame:
    """P5: ``errors`` (array of messages, in field order) and ``valid`` per row.

    Missing values pass (a range check on null is not a violation); NaN counts as missing.
    """
    msgs = []
    for c, (lo, hi) in bounds.items():
        if c not in df.columns:
            continue
        v = F.col(c).cast("double")
        v = F.when(F.isnan(v), None).otherwise(v)
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (v < F.lit(float(lo)))
        if hi is not None:
            bad = bad | (v > F.lit(float(hi)))
        msgs.append(F.when(F.coalesce(bad, F.lit(False)),
                           F.lit(f"{c}: out of range [{_bound_text(lo)}, {_bound_text(hi)}]")))
    if "season" in df.columns:
        s = F.col("season")
        bad = s.isNotNull() & (s != "") & ~s.isin(*seasons)
        msgs.append(F.when(bad, F.concat(F.lit(f"season: must be one of {seasons} (got '"), s, F.lit("')"))))
    errors = F.array_compact(F.array(*msgs)) if msgs else F.array().cast("array<string>")
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and the quarantine (rows with at least one error)."""
    checked = row_errors(df)
    return checked.filter("valid").drop("errors", "valid"), checked.filter(~F.col("valid"))


def range_violations(df: DataFrame, hard=K.HARD_BOUNDS, soft=K.SOFT_BOUNDS) -> DataFrame:
    """Per checked column: violation count, min, max, bounds, kind - one aggregation.

    Only columns with at least one violation are reported.
    """
    checks = [(c, "hard", lo, hi) for c, (lo, hi) in hard.items() if c in df.columns]
    checks += [(c, "soft", lo, hi) for c, (lo, hi) in soft.items() if c in df.columns]
    aggs = []
    for i, (c, _, lo, hi) in enumerate(checks):
        v = F.col(c)
        aggs += [F.count_if((v < lo) | (v > hi)).alias(f"n{i}"), F.min(v).cast("double").alias(f"lo{i}"),
                 F.max(v).cast("double").alias(f"hi{i}")]
    one = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.col(f"n{i}").cast("bigint").alias("count"),
                      F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
                      F.lit(float(lo)).alias("lower"), F.lit(float(hi)).alias("upper"))
             for i, (c, kind, lo, hi) in enumerate(checks)]
    return one.select(F.inline(F.array(*items))).filter(F.col("count") > 0)


def violation_sample(df: DataFrame, id_col: str, hard=K.HARD_BOUNDS, soft=K.SOFT_BOUNDS, max_rows: int = 50) -> DataFrame:
    """The first ``max_rows`` violating rows per column (by ``id_col``), with their message."""
    checks = [(c, lo, hi) for c, (lo, hi) in {**hard, **soft}.items() if c in df.columns]
    items = [F.when((F.col(c) < lo) | (F.col(c) > hi),
                    F.struct(F.lit(c).alias("column"), F.lit(f"{c}: out of range [{float(lo)}, {float(hi)}]").alias("message")))
             for c, lo, hi in checks]
    long = (df.select(id_col, F.explode(F.array_compact(F.array(*items))).alias("e"))
            .select(id_col, "e.column", "e.message"))
    return top_k_per_group(long, ["column"], [F.col(id_col)], max_rows)


def severity(violations: DataFrame, missing: list[str]) -> DataFrame:
    """CRITICAL if columns are missing or any hard violation, WARN if soft only, else PASS."""
    agg = violations.agg(F.count_if(F.col("kind") == "hard").alias("hard"),
                         F.count_if(F.col("kind") == "soft").alias("soft"),
                         F.coalesce(F.sum(F.when(F.col("kind") == "hard", F.col("count"))), F.lit(0)).cast("bigint")
                         .alias("hard_rows"))
    level = (F.when(F.lit(bool(missing)) | (F.col("hard") > 0), "CRITICAL")
             .when(F.col("soft") > 0, "WARN").otherwise("PASS"))
    return agg.select(F.col("hard").cast("bigint").alias("hard_columns"), F.col("soft").cast("bigint").alias("soft_columns"),
                      F.lit(",".join(missing)).alias("missing_columns"), level.alias("severity"))


def invalid_row_count(df: DataFrame, hard=K.HARD_BOUNDS) -> Column:
    """Q19: all distinct rows with a hard violation (not only the sampled ones)."""
    cond = F.lit(False)
    for c, (lo, hi) in hard.items():
        if c in df.columns:
            cond = cond | F.coalesce((F.col(c) < lo) | (F.col(c) > hi), F.lit(False))
    return F.count_if(cond)


def normalize_name(c: Column) -> Column:
    """Lower-case and drop non-alphanumerics."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def schema_diff(columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``columns(dataset, column)`` -> (missing per dataset, near-name mismatches).

    Missing: every column of the union that the dataset lacks - per column, the
    datasets not holding it (``array_except`` against the dataset list).
    Mismatch: normalised names that appear with more than one spelling.
    """
    names = sorted(r["dataset"] for r in columns.select("dataset").distinct().collect())  # metadata
    holders = columns.groupBy("column").agg(F.collect_set("dataset").alias("has"))
    missing = holders.select(F.explode(F.array_except(F.array(*[F.lit(n) for n in names]), F.col("has")))
                             .alias("dataset"), "column")
    mism = (columns.withColumn("norm", normalize_name(F.col("column"))).groupBy("norm")
            .agg(F.count_distinct("column").alias("spellings"),
                 F.array_join(F.array_sort(F.collect_set("column")), "|").alias("variants"))
            .filter(F.col("spellings") > 1))
    return missing, mism


def schema_columns(spark, frames: dict) -> DataFrame:
    """``(dataset, column, dtype)`` rows from DataFrame schemas (metadata only)."""
    rows = [(name, f.name, f.dataType.simpleString()) for name, df in frames.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "dataset string, column string, dtype string")


def state_filter(features: DataFrame, state: str) -> DataFrame:
    """P20: boundary features of one state, case-insensitive."""
    return features.filter(F.lower(F.col("state")) == F.lower(F.lit(state)))


def range_status(df: DataFrame, features, target: str, ranges=K.HARD_BOUNDS | K.SOFT_BOUNDS, tolerance: float = 0.01) -> DataFrame:
    """One row per feature and target of a processed table with its range status.

    MISSING (no such column), PASS (min and max within the range, give or take ``tolerance``; also a column
    without a range or without values), else CLIP/FAIL.  The target has no range.
    """
    wanted = list(dict.fromkeys([*features, *ranges, target]))
    here = [c for c in wanted if c in df.columns]
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(here)],
                 *[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(f"r{i}")
                   if c in ranges else F.lit(None).cast("struct<lo: double, hi: double>").alias(f"r{i}") for i, c in enumerate(here)])
    items = []
    for c in wanted:
        if c in here:
            i = here.index(c)
            lo, hi, nulls = F.col(f"r{i}.lo"), F.col(f"r{i}.hi"), F.col(f"n{i}")
            bad = (lo < ranges[c][0] - tolerance) | (hi > ranges[c][1] + tolerance) if c in ranges else F.lit(False)
            status = F.when(bad, "CLIP/FAIL").otherwise("PASS")
        else:
            lo = hi = F.lit(None).cast("double")
            nulls, status = F.lit(None).cast("bigint"), F.lit("MISSING")
        items.append(F.struct(F.lit(c).alias("feature"), F.lit("target" if c == target else "feature").alias("role"), lo.alias("min"),
                              hi.alias("max"), nulls.cast("bigint").alias("nulls"), status.alias("status")))
    return one.select(F.inline(F.array(*items)))


def pipeline_gate(frames: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """Per data set ``(table, target, required columns)`` whether the pipeline goes on.

    A CRITICAL severity (P8) or a missing target skips it; one row per data set.
    """
    rows = []
    for name, (df, target, required) in frames.items():
        lacks = target not in df.columns
        sev = severity(range_violations(df), missing_columns(df, required))
        critical = F.col("severity") == "CRITICAL"
        rows.append(sev.select(
            F.lit(name).alias("dataset"), "severity", F.when(critical | F.lit(lacks), "skipped").otherwise("processed").alias("status"),
            F.when(~critical & F.lit(lacks), F.lit(f"Missing target column: {target}")).alias("error")))
    return reduce(lambda a, b: a.unionByName(b), rows)
