"""More scan, default, alignment, set and audit queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import features as FX
from ..operators import profile as PR
from ..operators import validate as V
from ..sources import knowledge as K
from ..sources import proxies as P
from ..sources.tables import read_table
from .catalog import register
from .oracle_views import with_views

SCANNED = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
R6 = lambda c: F.round(c, 6)


# --- S2: one summary row per input table ----------------------------------------------------------
def _summary_sql(t):
    return (f"SELECT '{t}' AS dataset, (SELECT count(*) FROM {t}) AS rows, "
            f"(SELECT count(*) FROM (DESCRIBE {t}))::int AS columns, "
            f"(SELECT sum(n) FROM (UNPIVOT (SELECT count(*) - count(COLUMNS(*)) FROM {t}) ON COLUMNS(*) INTO NAME c VALUE n))::bigint AS null_cells, "
            f"(SELECT count(*) FROM {t}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS duplicates")


@register("s02_table_summary", " UNION ALL ".join(_summary_sql(t) for t in SCANNED))
def s02_table_summary(spark, sf):
    parts = []
    for t in SCANNED:
        df = read_table(spark, sf, t)
        nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0)).cast("bigint")
        one = df.agg(F.count("*").alias("rows"), nulls.alias("null_cells"))
        dup = PR.duplicate_count(df).collect()[0]["duplicates"]
        parts.append(one.select(F.lit(t).alias("dataset"), "rows", F.lit(len(df.columns)).alias("columns"), "null_cells",
                                F.lit(dup).cast("bigint").alias("duplicates")))
    return reduce(lambda a, b: a.unionByName(b), parts)


# --- P16 / P17: defaults for missing values ------------------------------------------------------------
@register("p16_default_missing", with_views("""
SELECT round(sum(coalesce(N, 0.0)), 6) AS sum_N, round(sum(coalesce(ph, 0.0)), 6) AS sum_ph,
       round(avg(coalesce(rainfall, 0.0)), 6) AS avg_rainfall,
       count_if(N IS NULL OR ph IS NULL OR rainfall IS NULL) AS rows_defaulted FROM samples_dirty""", "samples_dirty"))
def p16_default_missing(spark, sf):
    d = P.samples_dirty(spark, sf)
    missing = F.size(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("N", "ph", "rainfall")])))
    filled = d.withColumn("missing_n", missing).withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("N", "ph", "rainfall")})
    return filled.agg(R6(F.sum("N")).alias("sum_N"), R6(F.sum("ph")).alias("sum_ph"), R6(F.avg("rainfall")).alias("avg_rainfall"),
                      F.count_if(F.col("missing_n") > 0).alias("rows_defaulted"))


@register("p17_telemetry_defaults", with_views(f"""
SELECT round(sum(coalesce(N, {K.TELEMETRY_DEFAULTS['N']})), 6) AS sum_N,
       round(avg(coalesce(rainfall, {K.TELEMETRY_DEFAULTS['rainfall']})), 6) AS avg_rainfall, count(*) AS n
FROM samples_dirty""", "samples_dirty"))
def p17_telemetry_defaults(spark, sf):
    d = P.samples_dirty(spark, sf).na.fill({k: v for k, v in K.TELEMETRY_DEFAULTS.items()})
    return d.agg(R6(F.sum("N")).alias("sum_N"), R6(F.avg("rainfall")).alias("avg_rainfall"), F.count("*").alias("n"))


# --- J10: raw <-> processed alignment by key ------------------------------------------------------------
@register("j10_key_alignment", with_views("""
WITH raw AS (SELECT DISTINCT sample_id, N FROM samples_dirty)
SELECT count(*) AS aligned, round(sum(coalesce(raw.N, 0.0)), 6) AS sum_raw_N FROM raw JOIN (SELECT DISTINCT sample_id FROM samples) p USING (sample_id)""",
                                           "samples_dirty"))
def j10_key_alignment(spark, sf):
    raw = P.samples_dirty(spark, sf).select("sample_id", "N").distinct()
    processed = P.samples(spark, sf).select("sample_id").distinct()
    j = raw.join(processed, "sample_id")
    return j.agg(F.count("*").alias("aligned"), R6(F.sum(F.coalesce(F.col("N"), F.lit(0.0)))).alias("sum_raw_N"))


# --- U3: set algebra on region sets --------------------------------------------------------------------------
_NUT = ("CASE WHEN N < 40 THEN 'Nitrogen deficient' WHEN P < 20 THEN 'Phosphorus deficient' "
        "WHEN K < 30 THEN 'Potassium deficient' ELSE 'Balanced' END")


@register("u03_set_operations", with_views(f"""
WITH s AS (SELECT region, {_NUT} AS status, season FROM samples),
a AS (SELECT DISTINCT region, season FROM s WHERE status = 'Nitrogen deficient'),
b AS (SELECT DISTINCT region, season FROM s WHERE status = 'Potassium deficient')
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""", "samples"))
def u03_set_operations(spark, sf):
    s = P.samples(spark, sf).select("region", "season", FX.nutrient_status().alias("status"))
    a = s.filter(F.col("status") == "Nitrogen deficient").select("region", "season")
    b = s.filter(F.col("status") == "Potassium deficient").select("region", "season")
    ops = {"union": a.union(b).distinct(), "except": a.subtract(b), "intersect": a.intersect(b)}
    return reduce(lambda x, y: x.unionByName(y),
                  [df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n") for op, df in ops.items()])


# --- A29: audit roll-up -------------------------------------------------------------------------------------
def _checks_sql(view, name):
    hard = " OR ".join(f"{c} < {lo} OR {c} > {hi}" for c, (lo, hi) in K.HARD_BOUNDS.items())
    soft = " OR ".join(f"{c} < {lo} OR {c} > {hi}" for c, (lo, hi) in K.SOFT_BOUNDS.items())
    return f"""
SELECT '{name}' AS dataset, CASE WHEN r > 20 THEN 'BLOCKER' WHEN r > 5 THEN 'WARNING' ELSE 'OK' END AS level
FROM (SELECT max(c) / min(c) AS r FROM (SELECT count(*) AS c FROM {view} GROUP BY crop))
UNION ALL SELECT '{name}', CASE WHEN count_if(N IS NULL OR ph IS NULL OR rainfall IS NULL) > 0 THEN 'WARNING' ELSE 'OK' END FROM {view}
UNION ALL SELECT '{name}', CASE WHEN (SELECT count(*) FROM {view}) > (SELECT count(*) FROM (SELECT DISTINCT * FROM {view})) THEN 'WARNING' ELSE 'OK' END
UNION ALL SELECT '{name}', CASE WHEN count_if({hard}) > 0 THEN 'BLOCKER' WHEN count_if({soft}) > 0 THEN 'WARNING' ELSE 'OK' END FROM {view}"""


@register("a29_audit_rollup", with_views(f"""
WITH c AS ({_checks_sql('samples', 'samples')} UNION ALL {_checks_sql('samples_dirty', 'samples_dirty')})
SELECT dataset, count_if(level = 'BLOCKER') AS blockers, count_if(level = 'WARNING') AS warnings,
       bool_and(level <> 'BLOCKER') AS ready FROM c GROUP BY dataset""", "samples_dirty"))
def a29_audit_rollup(spark, sf):
    checks = []
    for name, df in (("samples", P.samples(spark, sf)), ("samples_dirty", P.samples_dirty(spark, sf))):
        dist = PR.target_distribution(df, "crop")
        checks.append(PR.imbalance_checks(dist, name).select("dataset", "level"))
        nulls = df.agg(F.count_if(F.col("N").isNull() | F.col("ph").isNull() | F.col("rainfall").isNull()).alias("k"))
        checks.append(nulls.select(F.lit(name).alias("dataset"), F.when(F.col("k") > 0, "WARNING").otherwise("OK").alias("level")))
        dups = PR.duplicate_count(df)
        checks.append(dups.select(F.lit(name).alias("dataset"), F.when(F.col("duplicates") > 0, "WARNING").otherwise("OK").alias("level")))
        sev = V.severity(V.range_violations(df), [])
        checks.append(sev.select(F.lit(name).alias("dataset"), F.when(F.col("severity") == "CRITICAL", "BLOCKER")
                                 .when(F.col("severity") == "WARN", "WARNING").otherwise("OK").alias("level")))
    return PR.audit_rollup(reduce(lambda a, b: a.unionByName(b), checks)).select("dataset", "blockers", "warnings", "ready")
