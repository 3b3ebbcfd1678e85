"""Table profiling and data-quality audits.

Each profile is one aggregation pass with many expressions (Catalyst does not fuse
separate actions), followed by an ``unpivot`` into one row per column.  Aggregates
are algebraic (count/sum/min/max/moments), so they run with map-side partial
aggregation: a hot key or a skewed column costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import knowledge as K
from .quantiles import exact_quantiles


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    """Numeric columns of the schema, minus ``exclude``."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def row_digest(df: DataFrame) -> list[Column]:
    """Columns that are equal for rows with equal values: the first 16 bytes of the SHA-256 digest of all numbers, texts, booleans
    and dates (each preceded by its length, null by none), and the columns of other types as they are.  As in a grouping -0.0 is 0.0."""
    simple, other = [], []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(c == 0, F.lit(0.0).cast(f.dataType)).otherwise(c)
        plain = isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType)) or f.dataType == T.StringType()
        (simple if plain else other).append(c.cast("string") if plain else c)
    parts = [F.coalesce(F.concat(F.char_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in simple]
    return [F.substring(F.unhex(F.sha2(F.concat(F.lit(""), *parts).cast("binary"), 256)), 1, 16).alias("_digest"), *other]


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows (nulls compare equal), as a one-row frame.

    A row is shuffled as its digest: 16 bytes whatever its width."""
    g = df.groupBy(*row_digest(df)).agg(F.count(F.lit(1)).alias("count"))
    return g.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def table_profile(df: DataFrame) -> DataFrame:
    """A1: row and column counts, nulls per column, duplicate rows - long format."""
    aggs = [F.count("*").alias("rows")] + [F.count_if(F.col(c).isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)]
    item = lambda m, c, v: F.struct(F.lit(m).alias("metric"), F.lit(c).alias("column"),
                                    v.cast("bigint").alias("value"))
    items = ([item("rows", "*", F.col("rows")), item("columns", "*", F.lit(len(df.columns)))]
             + [item("nulls", c, F.col(f"n_{i}")) for i, c in enumerate(df.columns)])
    dups = duplicate_count(df).select(F.lit("duplicates").alias("metric"), F.lit("*").alias("column"),
                                      F.col("duplicates").alias("value"))
    return df.agg(*aggs).select(F.inline(F.array(*items))).unionByName(dups)


def integrity(df: DataFrame, required=()) -> DataFrame:
    """A2: nulls, infinities, duplicates, missing columns, dtype counts -> PASS/FAIL."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    aggs = [F.count("*").alias("rows"),
            sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0)).cast("bigint").alias("nulls"),
            sum((F.count_if(F.abs(F.col(c)) == F.lit(float("inf"))) for c in num), F.lit(0)).cast("bigint").alias("infinities")]
    missing = [c for c in required if c not in df.columns]
    kinds = {"double": 0, "integer": 0, "string": 0, "other": 0}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            kinds["double"] += 1
        elif isinstance(f.dataType, T.IntegralType):
            kinds["integer"] += 1
        elif isinstance(f.dataType, T.StringType):
            kinds["string"] += 1
        else:
            kinds["other"] += 1
    dups = duplicate_count(df).collect()[0]["duplicates"]   # one scalar
    out = df.agg(*aggs).withColumn("duplicates", F.lit(dups).cast("bigint"))
    status = F.when((F.col("nulls") == 0) & (F.col("infinities") == 0) & (F.col("duplicates") == 0)
                    & F.lit(not missing), "PASS").otherwise("FAIL")
    return out.select("rows", "nulls", "infinities", "duplicates",
                      F.lit(",".join(missing)).alias("missing_columns"),
                      *[F.lit(v).cast("int").alias(f"n_{k}") for k, v in kinds.items()],
                      status.alias("status"))


def zscore_stats(df: DataFrame, cols) -> DataFrame:
    """A4: mean and population std per column."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
    one = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
             for i, c in enumerate(cols)]
    return one.select(F.inline(F.array(*items)))


def feature_stats(df: DataFrame, cols, collapse_tol: float = 1e-8) -> DataFrame:
    """A5: mean, sample std, min, max, bias-corrected skewness and excess kurtosis.

    Spark's ``skewness``/``kurtosis`` are population moments (g1, g2); the sample
    versions are G1 = g1*sqrt(n(n-1))/(n-2), G2 = (n-1)/((n-2)(n-3))*((n+1)g2+6).
    """
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"),
                 F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.skewness(c).alias(f"g1_{i}"),
                 F.kurtosis(c).alias(f"g2_{i}")]
    one = df.agg(*aggs)
    items = []
    for i, c in enumerate(cols):
        n = F.col(f"n{i}").cast("double")
        skew = F.col(f"g1_{i}") * F.sqrt(n * (n - 1)) / (n - 2)
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col(f"g2_{i}") + 6)
        items.append(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"),
                              F.col(f"lo{i}").cast("double").alias("min"), F.col(f"hi{i}").cast("double").alias("max"),
                              skew.alias("skew"), kurt.alias("kurtosis"),
                              (F.col(f"s{i}") < collapse_tol).alias("collapsed")))
    return one.select(F.inline(F.array(*items)))


def describe(df: DataFrame, cols, method: str = "exact") -> DataFrame:
    """Count, mean, std, min, quartiles, max per column (quartiles exact by default)."""
    base = df.agg(*[F.struct(F.count(c), F.avg(c), F.stddev_samp(c), F.min(c).cast("double"),
                             F.max(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0]
    qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75], method=method)
    rows = []
    for i, c in enumerate(cols):
        cnt, mean, std, lo, hi = base[f"c{i}"]
        rows.append((c, int(cnt), mean, std, lo, qs.get(((), c, 0.25)), qs.get(((), c, 0.5)), qs.get(((), c, 0.75)), hi))
    return df.sparkSession.createDataFrame(
        rows, "column string, count bigint, mean double, std double, min double, q25 double, q50 double, "
              "q75 double, max double")


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count and share per class, imbalance ratio, rare classes.

    A class is rare below ``max(0.02, 0.3 / k)`` of rows.  Totals are class-level
    scalars fetched once and used as literals (not an ``over ()`` window).
    """
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("count"))
    tot = counts.agg(F.sum("count").alias("total"), F.count("*").alias("k"),
                     F.max("count").alias("mx"), F.min("count").alias("mn")).collect()[0]   # class-level scalars
    share = F.col("count") / F.lit(float(tot["total"]))
    return counts.select(F.col(target), F.col("count").cast("bigint").alias("count"),
                         (share * 100.0).alias("percent"),
                         (F.lit(float(tot["mx"])) / F.lit(float(tot["mn"]))).alias("imbalance_ratio"),
                         (share < F.greatest(F.lit(0.02), F.lit(0.3) / F.lit(float(tot["k"])))).alias("is_rare"))


def correlation_pairs(df: DataFrame, cols) -> DataFrame:
    """A10: Pearson correlation for every pair i < j, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    items = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{i}").alias("corr"))
             for i, (a, b) in enumerate(pairs)]
    return one.select(F.inline(F.array(*items)))


def target_quality(df: DataFrame, target: str, target_code: str, features) -> DataFrame:
    """Null labels, distinct labels, leakage (|corr(feature, code)| > 0.99), target among features."""
    one = df.agg(F.count_if(F.col(target).isNull()).cast("bigint").alias("null_labels"),
                 F.count_distinct(target).cast("bigint").alias("distinct_labels"),
                 *[F.corr(c, target_code).alias(f"c{i}") for i, c in enumerate(features)])
    leak = F.concat_ws(",", F.array_compact(F.array(*[F.when(F.abs(F.col(f"c{i}")) > 0.99, F.lit(c))
                                                for i, c in enumerate(features)])))
    return one.select("null_labels", "distinct_labels", leak.alias("leaking_features"),
                      F.lit(target in features).alias("target_in_features"))


def histograms(df: DataFrame, cols, bins: int = 30) -> DataFrame:
    """Equal-width histogram per column; the top edge folds into the last bin."""
    rng = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(f"r{i}")
                   for i, c in enumerate(cols)]).collect()[0]   # fitted range per column
    items = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"), F.lit(rng[f"r{i}"]["lo"]).alias("lo"),
                      F.lit(rng[f"r{i}"]["hi"]).alias("hi")) for i, c in enumerate(cols)]
    long = df.select(F.inline(F.array(*items))).filter(F.col("v").isNotNull())
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.lit(bins), (F.floor((F.col("v") - F.col("lo")) / width * F.lit(float(bins))) + 1).cast("int")))
    return long.groupBy("column", b.alias("bin")).agg(F.count("*").alias("count"))


def box_stats(df: DataFrame, cols, by: str, method: str = "exact") -> DataFrame:
    """Min, quartiles, max of ``cols`` per class (exact, distributed)."""
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    res = exact_quantiles(df, cols, probs, group_cols=[by], method=method)
    rows = sorted({(g[0], c) for (g, c, _) in res})
    data = [(g, c) + tuple(float(res[((g,), c, q)]) for q in probs) for g, c in rows]
    dtype = dict(df.dtypes)[by]
    return df.sparkSession.createDataFrame(
        data, f"`{by}` {dtype}, column string, min double, q1 double, median double, q3 double, max double")


def mutual_information(df: DataFrame, cols, target: str, bins: int = 10, weak: float = 0.01) -> DataFrame:
    """Binned mutual information (equal-frequency bins x class), in nats.

    Bin edges are exact quantiles; a value's bin is the number of edges below it.
    This ranks features like the kNN estimator but is not numerically equal to it.
    """
    probs = [i / bins for i in range(1, bins)]
    qs = exact_quantiles(df, cols, probs)
    items = []
    for c in cols:
        edges = [float(qs[((), c, q)]) for q in probs]
        b = sum((F.when(F.col(c) > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
        items.append(F.struct(F.lit(c).alias("column"), b.alias("bin")))
    long = df.filter(F.col(target).isNotNull()).select(F.col(target).alias("y"), F.inline(F.array(*items)))
    joint = long.groupBy("column", "bin", "y").agg(F.count("*").alias("nbc"))
    pb = joint.groupBy("column", "bin").agg(F.sum("nbc").alias("nb"))
    pc = joint.groupBy("column", "y").agg(F.sum("nbc").alias("nc"))
    tot = joint.groupBy("column").agg(F.sum("nbc").alias("n"))
    j = joint.join(pb, ["column", "bin"]).join(pc, ["column", "y"]).join(tot, "column")
    term = (F.col("nbc") / F.col("n")) * F.log((F.col("nbc") * F.col("n")) / (F.col("nb") * F.col("nc")))
    return j.groupBy("column").agg(F.sum(term).alias("mi")).withColumn("weak", F.col("mi") < weak)


def audit_rollup(checks: DataFrame) -> DataFrame:
    """Checks ``(check, dataset, level, message)`` -> readiness per dataset."""
    return checks.groupBy("dataset").agg(
        F.count_if(F.col("level") == "BLOCKER").cast("bigint").alias("blockers"),
        F.count_if(F.col("level") == "WARNING").cast("bigint").alias("warnings"),
        F.bool_and(F.col("level") != "BLOCKER").alias("ready"))


def imbalance_checks(dist: DataFrame, dataset: str) -> DataFrame:
    """A29 input: imbalance ratio > 20 blocks, > 5 warns."""
    r = dist.agg(F.max("imbalance_ratio").alias("ratio"))
    level = F.when(F.col("ratio") > 20, "BLOCKER").when(F.col("ratio") > 5, "WARNING").otherwise("OK")
    return r.select(F.lit("class_imbalance").alias("check"), F.lit(dataset).alias("dataset"), level.alias("level"),
                    F.format_string("imbalance ratio %.2f", F.col("ratio")).alias("message"))


HARD = K.HARD_BOUNDS
SOFT = K.SOFT_BOUNDS
