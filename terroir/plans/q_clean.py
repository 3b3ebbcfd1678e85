"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..sources import proxies as P
from .catalog import register
from .common import samples_split
from .oracle_views import with_views

FEATURES = P.FEATURES
R6 = lambda c: F.round(c, 6)


# --- U2 ---------------------------------------------------------------------------------
@register("u02_dedupe", with_views("""
SELECT (SELECT count(*) FROM samples_dirty) AS rows_in,
       (SELECT count(*) FROM (SELECT DISTINCT * FROM samples_dirty)) AS rows_out,
       (SELECT count(*) FROM samples_dirty) - (SELECT count(*) FROM (SELECT DISTINCT * FROM samples_dirty)) AS removed""",
                                    "samples_dirty"))
def u02_dedupe(spark, sf):
    d = P.samples_dirty(spark, sf)
    n_in = d.count()
    out = C.remove_duplicates(d)
    return out.agg(F.lit(n_in).cast("bigint").alias("rows_in"), F.count("*").alias("rows_out"),
                   (F.lit(n_in) - F.count("*")).cast("bigint").alias("removed"))


# --- A3 ---------------------------------------------------------------------------------
def _bounds_sql(src: str, where: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {src} {where}"
        for c in FEATURES)


@register("a03_iqr_bounds", with_views(f"""
WITH b AS ({_bounds_sql('samples_split', "WHERE split = 'train'")})
SELECT "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS lower,
       round(q3 + 1.5 * (q3 - q1), 6) AS upper FROM b""", "samples_split"))
def a03_iqr_bounds(spark, sf):
    train = samples_split(spark, sf).filter(F.col("split") == "train")
    b = C.iqr_bounds(train, FEATURES)
    rows = [(x.column, x.q1, x.q3, x.lower, x.upper) for x in b.values()]
    df = spark.createDataFrame(rows, "column string, q1 double, q3 double, lower double, upper double")
    return df.select("column", *[R6(F.col(c)).alias(c) for c in ("q1", "q3", "lower", "upper")])


# --- P10 --------------------------------------------------------------------------------
def _seq_iqr_sql():
    ctes = ["s0 AS (SELECT * FROM samples)"]
    outs = []
    for i, c in enumerate(FEATURES, start=1):
        ctes.append(f"b{i} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM s{i - 1})")
        ctes.append(f"s{i} AS (SELECT s{i - 1}.* FROM s{i - 1}, b{i} WHERE {c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))")
        outs.append(f"SELECT {i} AS step, '{c}' AS \"column\", round(q1, 6) AS q1, round(q3, 6) AS q3, "
                    f"round(q1 - 1.5 * (q3 - q1), 6) AS lower, round(q3 + 1.5 * (q3 - q1), 6) AS upper, "
                    f"(SELECT count(*) FROM s{i}) AS kept FROM b{i}")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(outs)


@register("p10_iqr_sequential", with_views(_seq_iqr_sql(), "samples"))
def p10_iqr_sequential(spark, sf):
    s = P.samples(spark, sf).select("sample_id", *FEATURES).persist()
    rows = []
    cur = s
    for i, c in enumerate(FEATURES, start=1):
        cur, rep = C.remove_outliers_iqr(cur, [c])
        r = rep.collect()[0]
        rows.append((i, c, r["q1"], r["q3"], r["lower"], r["upper"], cur.count()))
    s.unpersist()
    df = spark.createDataFrame(rows, "step int, column string, q1 double, q3 double, lower double, upper double, kept bigint")
    return df.select("step", "column", *[R6(F.col(x)).alias(x) for x in ("q1", "q3", "lower", "upper")], "kept")


# --- P11 --------------------------------------------------------------------------------
def _seq_z_sql():
    ctes = ["z0 AS (SELECT * FROM samples)"]
    outs = []
    for i, c in enumerate(FEATURES, start=1):
        ctes.append(f"m{i} AS (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM z{i - 1})")
        ctes.append(f"z{i} AS (SELECT z{i - 1}.* FROM z{i - 1}, m{i} WHERE abs(({c} - m) / s) < 3.0)")
        outs.append(f"SELECT {i} AS step, '{c}' AS \"column\", round(m, 6) AS mean, round(s, 6) AS std, "
                    f"(SELECT count(*) FROM z{i}) AS kept FROM m{i}")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(outs)


@register("p11_zscore_sequential", with_views(_seq_z_sql(), "samples"))
def p11_zscore_sequential(spark, sf):
    s = P.samples(spark, sf).select("sample_id", *FEATURES).persist()
    rows = []
    cur = s
    for i, c in enumerate(FEATURES, start=1):
        cur, rep = C.remove_outliers_zscore(cur, [c])
        r = rep.collect()[0]
        rows.append((i, c, r["mean"], r["std"], cur.count()))
    s.unpersist()
    df = spark.createDataFrame(rows, "step int, column string, mean double, std double, kept bigint")
    return df.select("step", "column", R6(F.col("mean")).alias("mean"), R6(F.col("std")).alias("std"), "kept")


# --- P12 / P13 / P14 / P15 / A14: parameters fitted on the train split ------------------
_TRAIN_B = f"""b AS ({_bounds_sql('samples_split', "WHERE split = 'train'")}),
bw AS (SELECT {', '.join(f"max(CASE WHEN \"column\" = '{c}' THEN q1 - 1.5 * (q3 - q1) END) AS lo_{c}, "
                         f"max(CASE WHEN \"column\" = '{c}' THEN q3 + 1.5 * (q3 - q1) END) AS hi_{c}" for c in FEATURES)} FROM b)"""
_IN_B = " AND ".join(f"{c} BETWEEN lo_{c} AND hi_{c}" for c in FEATURES)


def _train_bounds(spark, sf):
    sp = samples_split(spark, sf)
    return sp, C.iqr_bounds(sp.filter(F.col("split") == "train"), FEATURES)


@register("p12_apply_iqr_bounds", with_views(f"""
WITH {_TRAIN_B}
SELECT split, count_if({_IN_B}) AS kept, count(*) AS total FROM samples_split, bw GROUP BY split""", "samples_split"))
def p12_apply_iqr_bounds(spark, sf):
    sp, bounds = _train_bounds(spark, sf)
    kept = C.apply_iqr_bounds(sp, bounds).groupBy("split").agg(F.count("*").alias("kept"))
    total = sp.groupBy("split").agg(F.count("*").alias("total"))
    return total.join(kept, "split", "left").select("split", F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept"), "total")


_TRAIN_Z = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES)
_IN_Z = " AND ".join(f"abs(({c} - m_{c}) / s_{c}) < 3.0" for c in FEATURES)


@register("p13_apply_zscore", with_views(f"""
WITH z AS (SELECT {_TRAIN_Z} FROM samples_split WHERE split = 'train')
SELECT split, count_if({_IN_Z}) AS kept, count(*) AS total FROM samples_split, z GROUP BY split""", "samples_split"))
def p13_apply_zscore(spark, sf):
    sp = samples_split(spark, sf)
    stats = C.zscore_params(sp.filter(F.col("split") == "train"), FEATURES)
    kept = C.apply_zscore(sp, stats).groupBy("split").agg(F.count("*").alias("kept"))
    total = sp.groupBy("split").agg(F.count("*").alias("total"))
    return total.join(kept, "split", "left").select("split", F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept"), "total")


@register("p14_removal_guard", with_views(f"""
WITH {_TRAIN_B},
r AS (SELECT 1 - avg(CASE WHEN {_IN_B} THEN 1.0 ELSE 0.0 END) AS share, count_if({_IN_B}) AS kept, count(*) AS total
      FROM samples_split, bw)
SELECT round(share, 6) AS share_removed, share > 0.2 AS exceeded,
       CASE WHEN share > 0.2 THEN total ELSE kept END AS rows_out FROM r""", "samples_split"))
def p14_removal_guard(spark, sf):
    sp, bounds = _train_bounds(spark, sf)
    keep = F.lit(True)
    for b in bounds.values():
        keep = keep & C.within(b.column, b.lower, b.upper)
    out, share, exceeded = C.removal_guard(sp, keep, mode="revert")
    return out.agg(F.count("*").alias("rows_out")).select(
        R6(F.lit(share)).alias("share_removed"), F.lit(exceeded).alias("exceeded"), "rows_out")


@register("p15_clip_report", with_views(f"""
WITH {_TRAIN_B}
{' UNION ALL '.join(f"SELECT split, '{c}' AS \"column\", count_if({c} < lo_{c}) AS low_hits, count_if({c} > hi_{c}) AS high_hits FROM samples_split, bw GROUP BY split" for c in FEATURES)}""",
                                         "samples_split"))
def p15_clip_report(spark, sf):
    sp, bounds = _train_bounds(spark, sf)
    return C.clip_report(sp, bounds, by="split")


@register("a14_clip_report_total", with_views(f"""
WITH {_TRAIN_B}
{' UNION ALL '.join(f"SELECT '{c}' AS \"column\", count_if({c} < lo_{c}) AS low_hits, count_if({c} > hi_{c}) AS high_hits FROM samples_split, bw" for c in FEATURES)}""",
                                               "samples_split"))
def a14_clip_report_total(spark, sf):
    sp, bounds = _train_bounds(spark, sf)
    return (C.clip_report(sp, bounds, by="split").groupBy("column")
            .agg(F.sum("low_hits").cast("bigint").alias("low_hits"), F.sum("high_hits").cast("bigint").alias("high_hits")))


@register("p15_clip_values", with_views(f"""
WITH {_TRAIN_B}
SELECT split, {', '.join(f"round(avg(least(greatest({c}, lo_{c}), hi_{c})), 6) AS avg_{c}" for c in FEATURES)}
FROM samples_split, bw GROUP BY split""", "samples_split"))
def p15_clip_values(spark, sf):
    sp, bounds = _train_bounds(spark, sf)
    clipped = C.clip_to_bounds(sp, bounds)
    return clipped.groupBy("split").agg(*[R6(F.avg(c)).alias(f"avg_{c}") for c in FEATURES])


# --- X4: exact blocked KNN imputation (rows-only: brute force in SQL is the quadratic case) -------
def _knn_sql(k: int = 5) -> str:
    """Brute force over all pairs of a row with a gap and a donor."""
    gaps = []
    for c in ("N", "ph", "rainfall"):
        others = [o for o in FEATURES if o != c]
        parts = [f"(r.{o} - y.{o}) * (r.{o} - y.{o})" for o in others]
        shared = " + ".join(f"(({p}) IS NOT NULL)::INT" for p in parts)
        total = " + ".join(f"coalesce({p}, 0::DOUBLE)" for p in parts)
        gaps.append(f"""SELECT sample_id, '{c}' AS gap, list_avg(list_transform(best, lambda b: b.v)) AS value FROM (
            SELECT r.sample_id, min(struct_pack(d := {len(FEATURES)}::DOUBLE / ({shared}) * ({total}), id := y.sample_id, v := y.{c}), {k}) AS best
            FROM d AS r, d AS y WHERE r.{c} IS NULL AND y.{c} IS NOT NULL GROUP BY r.sample_id)""")
    return "WITH d AS (SELECT DISTINCT * FROM samples_dirty)\nSELECT sample_id, gap, round(value, 6) AS value FROM (" + " UNION ALL ".join(gaps) + ")"


@register("x04_knn_impute", with_views(_knn_sql(), "samples_dirty"))
def x04_knn_impute(spark, sf):
    """Every gap of samples_dirty with the mean of its 5 nearest donors."""
    from ..operators.impute import knn_impute, stored
    d = P.samples_dirty(spark, sf).dropDuplicates(["sample_id"])
    gap = F.when(F.col("N").isNull(), "N").when(F.col("ph").isNull(), "ph").when(F.col("rainfall").isNull(), "rainfall")
    d = stored(d.select("sample_id", *FEATURES, gap.alias("gap")), "rows")     # read twice
    out = knn_impute(d, "sample_id", FEATURES, k=5).filter("gap is not null")
    value = F.when(F.col("gap") == "N", F.col("N")).when(F.col("gap") == "ph", F.col("ph")).otherwise(F.col("rainfall"))
    return out.select("sample_id", "gap", R6(value).alias("value"))
