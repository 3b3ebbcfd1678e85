"""Classifier evaluation on a table of predictions.

Everything starts from ``(y, yhat)`` counts - a k x k table - so the metric math runs
on at most k^2 rows whatever the prediction volume.  ROC AUC uses score-value counts
with exact tie handling (average ranks), and a chunked prefix sum, so no task sorts a
whole class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import running


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """``n / (k * n_c)`` per row ("balanced" sample weights), via class counts."""
    counts = df.groupBy(label).agg(F.count("*").alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("n"), F.count("*").alias("k")).collect()[0]
    w = counts.select(label, (F.lit(float(tot["n"])) / (F.lit(float(tot["k"])) * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), label, "left")   # one row per class


def confusion_counts(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count("*").alias("n"))


def per_class_report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Precision, recall, F1, support per class (0 where a denominator is 0)."""
    cm = confusion_counts(df, y, yhat)
    tp = cm.filter(F.col("y") == F.col("yhat")).select(F.col("y").alias("cls"), F.col("n").alias("tp"))
    sup = cm.groupBy(F.col("y").alias("cls")).agg(F.sum("n").alias("support"))
    pred = cm.groupBy(F.col("yhat").alias("cls")).agg(F.sum("n").alias("predicted"))
    classes = sup.select("cls").union(pred.select("cls")).distinct()
    j = classes.join(tp, "cls", "left").join(sup, "cls", "left").join(pred, "cls", "left").na.fill(0)
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    j = j.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return j.withColumn("f1", f1).select("cls", "precision", "recall", "f1", F.col("support").cast("bigint"),
                                         F.col("tp").cast("bigint"))


def summary_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Accuracy and macro / weighted precision, recall, F1 (one row)."""
    rep = per_class_report(df, y, yhat)
    w = F.col("support")
    return rep.agg(
        (F.sum("tp") / F.sum(w)).alias("accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("precision") * w) / F.sum(w)).alias("weighted_precision"),
        (F.sum(F.col("f1") * w) / F.sum(w)).alias("weighted_f1"))


def confusion_matrix(df: DataFrame, y: str, yhat: str, classes: list) -> DataFrame:
    """Long confusion matrix on the full class domain (zeros included)."""
    cm = confusion_counts(df, y, yhat)
    dom = df.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], "y string, yhat string")
    return (dom.join(cm, ["y", "yhat"], "left")
            .select(F.col("y").alias("true_label"), F.col("yhat").alias("predicted_label"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def roc_auc_ovr(scores: DataFrame, cls: str = "cls", score: str = "score", positive: str = "positive") -> DataFrame:
    """One-vs-rest AUC per class from long ``(cls, score, positive)`` rows.

    AUC = sum_s pos(s) * (neg(< s) + neg(= s) / 2) / (P * N), equal to the rank-sum
    formula with average ranks for ties.  ``neg(< s)`` is a running sum over distinct
    scores in blocks of equal frequency (cut at sampled quantiles of (class, score)), so scores
    that crowd near one value are many blocks.
    """
    g = scores.groupBy(cls, score).agg(F.count_if(F.col(positive)).alias("pos"),
                                       F.count_if(~F.col(positive)).alias("neg"))
    g = running(g, [cls], [F.col(score)], {"neg_to": F.col("neg")}, "auc")
    per = g.groupBy(cls).agg(
        F.sum(F.col("pos") * (F.col("neg_to") - F.col("neg") / 2.0)).alias("num"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("num") / (F.col("P") * F.col("N")))
    return per.select(cls, auc.alias("auc"))


def class_error_rates(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """Error rate and count per true class."""
    return df.groupBy(F.col(y).alias("true_label")).agg(
        F.avg(F.when(F.col(y) != F.col(yhat), 1.0).otherwise(0.0)).alias("error_rate"), F.count("*").alias("n"))


def top_two(probs: Column, labels: list) -> Column:
    """Best and runner-up (class, probability) from an array of per-class scores.

    Sorted in-row (no shuffle); ties keep class order, as a stable descending sort does.
    """
    items = F.array(*[F.struct((-probs[i]).alias("neg"), F.lit(i).alias("idx"), F.lit(lbl).alias("label"),
                               probs[i].alias("p")) for i, lbl in enumerate(labels)])
    s = F.array_sort(items)
    return F.struct(s[0]["label"].alias("best"), s[0]["p"].alias("p1"), s[1]["label"].alias("runner_up"),
                    s[1]["p"].alias("p2"))


def contrastive_text(best: Column, runner: Column, p1: Column, p2: Column) -> Column:
    """W6 narrative: why the best class wins over the runner-up."""
    gap = (p1 - p2) * 100.0
    return F.concat(F.lit("The model prefers "), best, F.lit(" over "), runner, F.lit(" by "),
                    F.format_string("%.1f", gap), F.lit(" percentage points."))
