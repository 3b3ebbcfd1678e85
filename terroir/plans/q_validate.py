"""Validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as FX
from ..operators import validate as V
from ..sources import knowledge as K
from ..sources import proxies as P
from ..sources.tables import Tables
from .catalog import register
from .oracle_views import with_views

R6 = lambda c: F.round(c, 6)


def raw_crop(spark, sf):
    """The crop table in its raw spelling (``label`` for the target)."""
    s = P.samples(spark, sf)
    return s.select("N", "P", "K", "temperature", "humidity", "ph", "rainfall", F.col("crop").alias("label"))


def raw_fertility(spark, sf):
    s = P.samples(spark, sf)
    return s.select("N", "P", "K", F.col("ph").alias("pH"), F.col("ec").alias("EC"),
                    F.col("organic_carbon").alias("OC"), FX.nutrient_status_code().alias("Output"))


def raw_regional(spark, sf):
    s = P.samples(spark, sf)
    return s.select(F.concat(F.lit("  "), F.col("region"), F.lit(" ")).alias("District"),
                    F.col("N").alias("Nitrogen Value"), F.col("P").alias("Phosphorous value"),
                    F.col("K").alias("Potassium value"), F.col("ph").alias("pH"))


_RAW_SQL = {
    "crop": "SELECT l_quantity AS N, l_quantity AS P, l_quantity AS K, l_quantity AS temperature, "
            "l_quantity AS humidity, l_quantity AS ph, l_quantity AS rainfall, l_returnflag AS label FROM lineitem",
    "fertility": "SELECT l_quantity AS N, l_quantity AS P, l_quantity AS K, l_quantity AS \"pH\", "
                 "l_quantity AS \"EC\", l_quantity AS \"OC\", l_linenumber AS \"Output\" FROM lineitem",
    "regional": "SELECT l_returnflag AS \"District\", l_quantity AS \"Nitrogen Value\", "
                "l_quantity AS \"Phosphorous value\", l_quantity AS \"Potassium value\", l_quantity AS \"pH\" FROM lineitem",
}


# --- P1 ---------------------------------------------------------------------------------
_MAP_SQL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.RENAME_MAP.items())


@register("p01_schema_reconcile", "\nUNION ALL\n".join(
    f"SELECT '{d}' AS dataset, cast(row_number() OVER () - 1 as int) AS position, column_name AS original, "
    f"CASE column_name {_MAP_SQL} ELSE column_name END AS final, "
    f"column_name IN ({', '.join(repr(k) for k in V.RENAME_MAP)}) AS renamed FROM (DESCRIBE ({q}))"
    for d, q in _RAW_SQL.items()))
def p01_schema_reconcile(spark, sf):
    frames = {"crop": raw_crop(spark, sf), "fertility": raw_fertility(spark, sf), "regional": raw_regional(spark, sf)}
    reports = [V.reconcile_schema(df)[1].withColumn("dataset", F.lit(d)) for d, df in frames.items()]
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out.select("dataset", "position", "original", "final", "renamed")


# --- P2 ---------------------------------------------------------------------------------
@register("p02_trim_labels", with_views("""
SELECT trim(concat('  ', region, ' ')) AS region, count(*) AS n FROM samples GROUP BY 1""", "samples"))
def p02_trim_labels(spark, sf):
    reg, _ = V.reconcile_schema(raw_regional(spark, sf))
    return V.trim_labels(reg).groupBy("region").agg(F.count("*").alias("n"))


# --- P5 ---------------------------------------------------------------------------------
def _rng(c, lo, hi):
    conds = []
    if lo is not None:
        conds.append(f"{c} < {float(lo)}")
    if hi is not None:
        conds.append(f"{c} > {float(hi)}")
    return (f"CASE WHEN {' OR '.join(conds)} THEN '{c}: out of range [{V._bound_text(lo)}, {V._bound_text(hi)}]' END")


_ERR_SQL = "concat_ws('; ', " + ", ".join(_rng(c, lo, hi) for c, (lo, hi) in K.ROW_BOUNDS.items()) + ")"


@register("p05_row_validation", with_views(f"""
SELECT {_ERR_SQL} = '' AS valid, {_ERR_SQL} AS errors, count(*) AS n FROM samples_dirty GROUP BY ALL""",
                                           "samples_dirty"))
def p05_row_validation(spark, sf):
    checked = V.row_errors(P.samples_dirty(spark, sf))
    return (checked.select("valid", F.array_join("errors", "; ").alias("errors"))
            .groupBy("valid", "errors").agg(F.count("*").alias("n")))


# --- P7 / P8 ----------------------------------------------------------------------------
def _viol_sql():
    parts = []
    for kind, bounds in (("hard", K.HARD_BOUNDS), ("soft", K.SOFT_BOUNDS)):
        for c, (lo, hi) in bounds.items():
            parts.append(f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count_if({c} < {lo} OR {c} > {hi}) AS count, "
                         f"min({c}) AS min, max({c}) AS max, {float(lo)} AS lower, {float(hi)} AS upper FROM samples")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE count > 0"


@register("p07_range_violations", with_views(_viol_sql(), "samples"))
def p07_range_violations(spark, sf):
    return V.range_violations(P.samples(spark, sf))


@register("p08_severity", with_views(f"""
WITH v AS ({_viol_sql()})
SELECT count_if(kind = 'hard') AS hard_columns, count_if(kind = 'soft') AS soft_columns, '' AS missing_columns,
       CASE WHEN count_if(kind = 'hard') > 0 THEN 'CRITICAL' WHEN count_if(kind = 'soft') > 0 THEN 'WARN'
            ELSE 'PASS' END AS severity FROM v""", "samples"))
def p08_severity(spark, sf):
    s = P.samples(spark, sf)
    return V.severity(V.range_violations(s), V.missing_columns(s, P.FEATURES + ["crop"]))


# --- P9 ---------------------------------------------------------------------------------
@register("p09_coordinates", """
SELECT coalesce(try_cast(lat AS double) BETWEEN -90 AND 90 AND try_cast(lon AS double) BETWEEN -180 AND 180, false) AS valid,
       count(*) AS n
FROM (SELECT CASE WHEN c_custkey % 97 = 0 THEN 'invalid' ELSE concat(cast(c_custkey % 200 - 100 as varchar), '.5') END AS lat,
             concat(cast(c_custkey % 400 - 200 as varchar), '.25') AS lon FROM customer)
GROUP BY 1""")
def p09_coordinates(spark, sf):
    c = Tables(spark, sf).read("customer", "c_custkey")
    k = F.col("c_custkey")
    pts = c.select(F.when(k % 97 == 0, F.lit("invalid")).otherwise(F.concat((k % 200 - 100).cast("string"), F.lit(".5")))
                   .alias("lat"), F.concat((k % 400 - 200).cast("string"), F.lit(".25")).alias("lon"))
    return pts.select(FX.valid_coordinates("lat", "lon").alias("valid")).groupBy("valid").agg(F.count("*").alias("n"))


# --- P19 --------------------------------------------------------------------------------
_COLS_SQL = " UNION ALL ".join(f"SELECT '{d}' AS dataset, column_name AS \"column\" FROM (DESCRIBE ({q}))"
                               for d, q in _RAW_SQL.items())


@register("p19_schema_diff_missing", f"""
WITH c AS ({_COLS_SQL}), d AS (SELECT DISTINCT dataset FROM c), u AS (SELECT DISTINCT "column" FROM c)
SELECT d.dataset, u."column" FROM d CROSS JOIN u
WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.dataset = d.dataset AND c."column" = u."column")""")
def p19_schema_diff_missing(spark, sf):
    cols = V.schema_columns(spark, {"crop": raw_crop(spark, sf), "fertility": raw_fertility(spark, sf),
                                    "regional": raw_regional(spark, sf)})
    return V.schema_diff(cols)[0]


@register("p19_schema_diff_mismatch", f"""
WITH c AS ({_COLS_SQL})
SELECT regexp_replace(lower("column"), '[^a-z0-9]', '', 'g') AS norm, count(DISTINCT "column") AS spellings,
       array_to_string(list_sort(list(DISTINCT "column")), '|') AS variants
FROM c GROUP BY 1 HAVING count(DISTINCT "column") > 1""")
def p19_schema_diff_mismatch(spark, sf):
    cols = V.schema_columns(spark, {"crop": raw_crop(spark, sf), "fertility": raw_fertility(spark, sf),
                                    "regional": raw_regional(spark, sf)})
    return V.schema_diff(cols)[1]


# --- P20 --------------------------------------------------------------------------------
@register("p20_state_filter", with_views("""
SELECT feature_order, state, district FROM polygons WHERE lower(state) = lower('Asia')""", "polygons"))
def p20_state_filter(spark, sf):
    return V.state_filter(P.polygons(spark, sf), "Asia").select("feature_order", "state", "district")


# --- P21 / A20 / A21 -------------------------------------------------------------------
@register("p21_misclassified", with_views("""
SELECT count_if(true_label <> predicted_label) AS misclassified, count(*) AS total,
       round(avg(CASE WHEN true_label <> predicted_label THEN 1.0 ELSE 0.0 END), 6) AS error_share
FROM predictions""", "predictions"))
def p21_misclassified(spark, sf):
    p = P.predictions(spark, sf)
    wrong = F.col("true_label") != F.col("predicted_label")
    return p.agg(F.count_if(wrong).alias("misclassified"), F.count("*").alias("total"),
                 R6(F.avg(F.when(wrong, 1.0).otherwise(0.0))).alias("error_share"))


# --- T3 ---------------------------------------------------------------------------------
def _t3_sql():
    parts = []
    for c, (lo, hi) in {**K.HARD_BOUNDS, **K.SOFT_BOUNDS}.items():
        parts.append(f"SELECT sample_id, '{c}' AS \"column\", '{c}: out of range [{float(lo)}, {float(hi)}]' AS message "
                     f"FROM samples WHERE {c} < {lo} OR {c} > {hi}")
    return ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY sample_id) AS rank FROM ("
            + " UNION ALL ".join(parts) + ")) WHERE rank <= 50")


@register("t03_violation_sample", with_views(_t3_sql(), "samples"))
def t03_violation_sample(spark, sf):
    return V.violation_sample(P.samples(spark, sf), "sample_id").withColumn("rank", F.col("rank").cast("bigint"))
