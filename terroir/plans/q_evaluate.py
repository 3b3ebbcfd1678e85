"""Evaluation queries on the pseudo-prediction table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import profile as PR
from ..sources import dims
from ..sources import knowledge as K
from ..sources import proxies as P
from .catalog import register
from .oracle_views import CROPS_LIST, with_views

R6 = lambda c: F.round(c, 6)

_REPORT_SQL = """
cm AS (SELECT true_label AS y, predicted_label AS yhat, count(*) AS n FROM predictions GROUP BY ALL),
cls AS (SELECT y AS cls FROM cm UNION SELECT yhat FROM cm),
rep AS (
  SELECT cls.cls,
    coalesce((SELECT sum(n) FROM cm WHERE y = cls.cls AND yhat = cls.cls), 0) AS tp,
    coalesce((SELECT sum(n) FROM cm WHERE y = cls.cls), 0) AS support,
    coalesce((SELECT sum(n) FROM cm WHERE yhat = cls.cls), 0) AS predicted
  FROM cls),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM rep),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr)"""


@register("a16_summary_metrics", with_views(f"""
WITH {_REPORT_SQL}
SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision,
       round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
       round(sum(precision * support) / sum(support), 6) AS weighted_precision,
       round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f""", "predictions"))
def a16_summary_metrics(spark, sf):
    m = EV.summary_metrics(P.predictions(spark, sf), "true_label", "predicted_label")
    return m.select(*[R6(F.col(c)).alias(c) for c in m.columns])


@register("a17_per_class_report", with_views(f"""
WITH {_REPORT_SQL}
SELECT cls, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       cast(support as bigint) AS support FROM f""", "predictions"))
def a17_per_class_report(spark, sf):
    r = EV.per_class_report(P.predictions(spark, sf), "true_label", "predicted_label")
    return r.select("cls", *[R6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("a18_confusion_matrix", with_views(f"""
WITH d AS (SELECT a.c AS true_label, b.c AS predicted_label FROM unnest({CROPS_LIST}) a(c), unnest({CROPS_LIST}) b(c)),
cm AS (SELECT true_label, predicted_label, count(*) AS n FROM predictions GROUP BY ALL)
SELECT d.true_label, d.predicted_label, coalesce(cm.n, 0) AS n FROM d LEFT JOIN cm USING (true_label, predicted_label)""",
                                             "predictions"))
def a18_confusion_matrix(spark, sf):
    return EV.confusion_matrix(P.predictions(spark, sf), "true_label", "predicted_label", K.CROP_CLASSES)


def _scores_long(spark, sf):
    p = P.predictions(spark, sf)
    c = F.col("c")
    return (p.select("sample_id", "true_code", "pred_code", "noise", F.explode(F.sequence(F.lit(0), F.lit(21))).alias("c"))
            .select(dims.crop_name(c).alias("cls"), c.alias("c"), "sample_id",
                    P.class_score(F.col("true_code"), F.col("pred_code"), F.col("noise"), c).alias("score"),
                    (F.col("true_code") == c).alias("positive")))


_SCORES_SQL = f"""
s AS (SELECT {CROPS_LIST}[c + 1] AS cls, c, sample_id,
        CASE WHEN c = pred_code THEN cast(0.5 as double) + cast(noise as double) * cast(0.04 as double)
             ELSE cast((c * 7 + true_code * 3 + noise) % 13 as double) / cast(40 as double) END AS score,
        true_code = c AS positive
      FROM predictions, range(0, 22) r(c))"""


@register("a19_roc_auc", with_views(f"""
WITH {_SCORES_SQL},
r AS (SELECT cls, positive, rank() OVER (PARTITION BY cls ORDER BY score)
             + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0 AS avg_rank FROM s),
a AS (SELECT cls, count_if(positive) AS np, count_if(NOT positive) AS nn, sum(CASE WHEN positive THEN avg_rank ELSE 0 END) AS rs
      FROM r GROUP BY cls)
SELECT cls, round((rs - np * (np + 1) / 2.0) / (np * nn), 6) AS auc FROM a
UNION ALL
SELECT 'macro', round(avg((rs - np * (np + 1) / 2.0) / (np * nn)), 6) FROM a""", "predictions"))
def a19_roc_auc(spark, sf):
    auc = EV.roc_auc_ovr(_scores_long(spark, sf))
    macro = auc.agg(F.lit("macro").alias("cls"), F.avg("auc").alias("auc"))
    return auc.unionByName(macro).select("cls", R6(F.col("auc")).alias("auc"))


@register("a20_class_error_rates", with_views("""
SELECT true_label, round(avg(CASE WHEN true_label <> predicted_label THEN 1.0 ELSE 0.0 END), 6) AS error_rate,
       count(*) AS n FROM predictions GROUP BY true_label""", "predictions"))
def a20_class_error_rates(spark, sf):
    e = EV.class_error_rates(P.predictions(spark, sf), "true_label", "predicted_label")
    return e.select("true_label", R6(F.col("error_rate")).alias("error_rate"), "n")


_A21 = ["N", "P", "K", "ph", "moisture"]


@register("a21_misclassified_profile", with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
    f"min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
    f"round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM predictions WHERE true_label <> predicted_label"
    for c in _A21), "predictions"))
def a21_misclassified_profile(spark, sf):
    p = P.predictions(spark, sf)
    d = PR.describe(p.filter(F.col("true_label") != F.col("predicted_label")), _A21)
    return d.select("column", "count", R6(F.col("mean")).alias("mean"), R6(F.col("std")).alias("std"), "min",
                    *[R6(F.col(c)).alias(c) for c in ("q25", "q50", "q75")], "max")


@register("w06_contrastive_gap", with_views(f"""
WITH {_SCORES_SQL},
r AS (SELECT sample_id, cls, score, row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, c) AS rn FROM s)
SELECT sample_id, max(CASE WHEN rn = 1 THEN cls END) AS best, max(CASE WHEN rn = 2 THEN cls END) AS runner_up,
       round(max(CASE WHEN rn = 1 THEN score END) - max(CASE WHEN rn = 2 THEN score END), 6) AS gap
FROM r WHERE rn <= 2 GROUP BY sample_id""", "predictions"))
def w06_contrastive_gap(spark, sf):
    p = P.predictions(spark, sf)
    probs = F.array(*[P.class_score(F.col("true_code"), F.col("pred_code"), F.col("noise"), c) for c in range(22)])
    t = p.select("sample_id", EV.top_two(probs, K.CROP_CLASSES).alias("t"))
    return t.select("sample_id", F.col("t.best").alias("best"), F.col("t.runner_up").alias("runner_up"),
                    R6(F.col("t.p1") - F.col("t.p2")).alias("gap"))
