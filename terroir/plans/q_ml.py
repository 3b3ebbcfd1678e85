"""Spark ML queries on the ``embeddings`` vectors.

Model training is not expressible in SQL, so these register no oracle; the metric
code paths (A16-A19) are oracle-checked elsewhere and the rules are unit-tested.
Each query returns a small result frame built from Spark jobs over the whole table.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..operators import ml as ML
from ..operators import registry as RG
from ..session import shared_path
from ..sources import proxies as P
from .catalog import register

RESULT = "model string, val_accuracy double, test_accuracy double, test_macro_f1 double"


def _data(spark, sf):
    return ML.prepare_vectors(P.vectors(spark, sf)).persist()


def _row(res):
    return (res["model"], res["val_accuracy"], res["test_accuracy"], res["test_macro_f1"])


def _one(spark, sf, estimator, name):
    d = _data(spark, sf)
    try:
        res = ML.fit_and_score(estimator, d, name)
    finally:
        d.unpersist()
    return spark.createDataFrame([_row(res)], RESULT)


@register("m01_logistic_regression")
def m01_logistic_regression(spark, sf):
    return _one(spark, sf, ML.logistic_regression(), "logistic_regression")


@register("m02_random_forest")
def m02_random_forest(spark, sf):
    return _one(spark, sf, ML.ForestInParts(ML.random_forest()), "random_forest")


@register("m03_margin_classifier")
def m03_margin_classifier(spark, sf):
    """The RBF margin classifier by random Fourier features, with class weights."""
    d = ML.fourier_features(ML.prepare_vectors(P.vectors(spark, sf))).persist()
    res = ML.fit_and_score(ML.margin_classifier(), d, "ovr_rff_svc")
    d.unpersist()
    return spark.createDataFrame([_row(res)], RESULT)


@register("m04_gradient_boosting")
def m04_gradient_boosting(spark, sf):
    return _one(spark, sf, ML.gradient_boosting(), "ovr_gbt")


@register("m05_boosted_early_stopping")
def m05_boosted_early_stopping(spark, sf):
    """Binary task (class 0 vs rest) with validation-based early stopping and balanced weights."""
    d = ML.prepare_vectors(P.vectors(spark, sf)).withColumn("label", (F.col("label") == 0).cast("double"))
    d = EV.balanced_weights(d.drop("weight"), "label").withColumn("is_val", F.col("split") == "val")
    train = d.filter(F.col("split") != "test")
    model = ML.boosted_with_validation().fit(train)
    m = ML.evaluate_predictions(model.transform(d.filter(F.col("split") == "test")))
    return spark.createDataFrame([("gbt_early_stop", model.getNumTrees, m["accuracy"], m["macro_f1"])],
                                 "model string, trees int, test_accuracy double, test_macro_f1 double")


@register("m06_grid_search_cv")
def m06_grid_search_cv(spark, sf):
    d = _data(spark, sf)
    cv = ML.grid_search().fit(d.filter(F.col("split") == "train"))
    best = cv.bestModel
    m = ML.evaluate_predictions(best.transform(d.filter(F.col("split") == "test")))
    d.unpersist()
    return spark.createDataFrame([("cv_logistic_regression", float(best.getRegParam()), float(best.getElasticNetParam()),
                                   float(max(cv.avgMetrics)), float(m["accuracy"]))],
                                 "model string, reg_param double, elastic_net double, cv_accuracy double, test_accuracy double")


@register("m07_baselines")
def m07_baselines(spark, sf):
    d = _data(spark, sf)
    rows = [_row(ML.fit_and_score(est, d, name)) for name, est in
            (("logistic_regression", ML.logistic_regression()), ("random_forest", ML.ForestInParts(ML.random_forest(100, 15))),
             ("ovr_linear_svc", ML.margin_classifier()))]
    d.unpersist()
    return spark.createDataFrame(rows, RESULT)


@register("m08_stacking")
def m08_stacking(spark, sf):
    d = _data(spark, sf)
    pred = ML.stacking(d)
    out = [("stacked_lr_rf", *[ML.evaluate_predictions(pred.filter(F.col("split") == s))["accuracy"] for s in ("val", "test")])]
    d.unpersist()
    return spark.createDataFrame(out, "model string, val_accuracy double, test_accuracy double")


@register("m09_mlp")
def m09_mlp(spark, sf):
    d = _data(spark, sf)
    n_in = len(d.select("features").first()["features"])
    n_cls = d.agg(F.max("label")).first()[0]
    res = ML.fit_and_score(ML.mlp(n_in, int(n_cls) + 1), d, "mlp")
    d.unpersist()
    return spark.createDataFrame([_row(res)], RESULT)


@register("m10_trainability")
def m10_trainability(spark, sf):
    """Tiny RF and LR on an 80/20 split; OK/FAIL with accuracy."""
    from ..operators import transform as X
    v = ML.prepare_vectors(P.vectors(spark, sf)).drop("split")
    v = X.stratified_split(v, "label", "vec_id", shares=(0.8, 0.2), names=("train", "test"))
    rows = []
    for name, est in (("tiny_rf", ML.random_forest(20, 5, weighted=False)), ("tiny_lr", ML.logistic_regression(False))):
        try:
            m = est.fit(v.filter(F.col("split") == "train"))
            acc = ML.evaluate_predictions(m.transform(v.filter(F.col("split") == "test")))["accuracy"]
            rows.append((name, "OK", float(acc)))
        except Exception:  # noqa: BLE001 - a failed fit is a reported status
            rows.append((name, "FAIL", None))
    return spark.createDataFrame(rows, "model string, status string, accuracy double")


@register("m11_feature_ablation")
def m11_feature_ablation(spark, sf):
    base = P.vectors(spark, sf)
    rows = []
    for k in (8, 16, 32, 64):
        d = ML.prepare_vectors(base.withColumn("embedding", F.slice("embedding", 1, k)))
        rows.append(_row(ML.fit_and_score(ML.logistic_regression(), d, f"first_{k}_dims")))
    return spark.createDataFrame(rows, RESULT)


def _fitted_lr(spark, sf):
    d = _data(spark, sf)
    model = ML.logistic_regression().fit(d.filter(F.col("split") == "train"))
    return d, model


@register("m12_batch_scoring")
def m12_batch_scoring(spark, sf):
    d, model = _fitted_lr(spark, sf)
    labels = [f"class_{i}" for i in range(int(d.agg(F.max("label")).first()[0]) + 1)]
    s = ML.batch_scores(model, d, labels)
    out = s.groupBy("predicted_label").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return out


@register("m13_feature_importance")
def m13_feature_importance(spark, sf):
    """M13 + T2: the top-10 features of a random forest."""
    d = _data(spark, sf)
    model = ML.random_forest(100, 10).fit(d.filter(F.col("split") == "train"))
    n = model.numFeatures
    top = ML.importances(model, [f"dim_{i}" for i in range(n)])[:10]
    d.unpersist()
    return spark.createDataFrame(top, "feature string, importance double")


@register("m14_permutation_importance")
def m14_permutation_importance(spark, sf):
    raw = P.vectors(spark, sf)
    d = ML.prepare_vectors(raw).join(raw.select("vec_id", "embedding"), "vec_id")
    model = ML.logistic_regression().fit(d.filter(F.col("split") == "train"))
    test = d.filter(F.col("split") == "test")
    drops = ML.permutation_importance(model, test, list(range(model.numFeatures)))
    return spark.createDataFrame([(f"dim_{i}", float(x)) for i, x in drops], "feature string, accuracy_drop double")


@register("m15_local_attribution")
def m15_local_attribution(spark, sf):
    """Per sample, the feature with the largest |linear attribution| for the predicted class."""
    raw = P.vectors(spark, sf)
    d = ML.prepare_vectors(raw).join(raw.select("vec_id", "embedding"), "vec_id")
    model = ML.logistic_regression().fit(d.filter(F.col("split") == "train"))
    n = model.numFeatures
    means_row = raw.select(*[F.avg(F.col("embedding")[i]).alias(f"m{i}") for i in range(n)]).first()
    att = ML.linear_attribution(model, d, [means_row[f"m{i}"] for i in range(n)])
    ranked = att.withColumn("top", F.array_sort(F.transform("attribution", lambda a, i: F.struct((-F.abs(a)).alias("k"), i.alias("i"))))[0]["i"])
    return ranked.groupBy(F.concat(F.lit("dim_"), F.col("top").cast("string")).alias("top_feature")).agg(F.count("*").alias("n"))


@register("m16_registry_benchmark")
def m16_registry_benchmark(spark, sf):
    """Results -> registry JSON -> merge -> best model -> benchmark table."""
    d = _data(spark, sf)
    ts = _dt.datetime(2024, 1, 1).isoformat()
    results = []
    forest_path = shared_path(spark, f"terroir-artifacts/random_forest-{uuid.uuid4().hex}")   # fitted in parts straight into its artifact
    for name, est in (("logistic_regression", ML.logistic_regression()), ("random_forest", ML.ForestInParts(ML.random_forest(100, 15), forest_path))):
        r = ML.fit_and_score(est, d, name)
        path = forest_path
        if not isinstance(r["_model"], ML.StoredForest):
            path = shared_path(spark, f"terroir-artifacts/{name}")
            RG.save_artifact(r["_model"], path)
        results.append({"model_name": name, "task": "vectors", "training_timestamp": ts, "artifact_path": path,
                        "metrics": {k: v for k, v in r.items() if not k.startswith("_") and k != "model"}})
    d.unpersist()
    # a first batch of one model, then a batch with that model again and a new one
    base = shared_path(spark, f"terroir-registry-{uuid.uuid4().hex}")
    merged = RG.read_json(spark, f"{base}/0")
    for i, batch in enumerate((results[:1], results), 1):
        RG.write_json(RG.merge_new(merged, RG.entries(spark, batch)), f"{base}/{i}")
        merged = RG.read_json(spark, f"{base}/{i}")
    RG.append_log(merged.select("model_name", "task", "metrics"), f"{base}/log")
    assert RG.load_artifact(spark, LogisticRegressionModel, results[0]["artifact_path"]) is not None
    best = RG.best_model(merged, "vectors").select(F.col("model_name").alias("best_model"))
    table = RG.benchmark_table(merged)
    return table.join(best, F.col("model_name") == F.col("best_model"), "left").select(
        "model_name", "task", "rank", F.col("best_model").isNotNull().alias("is_best"))


@register("m17_training_orchestration")
def m17_training_orchestration(spark, sf):
    """Run the tasks in order; each reports ok / skipped / failed."""
    tasks = [("vectors_lr", lambda: _one(spark, sf, ML.logistic_regression(), "lr").count()),
             ("samples_lr", lambda: _samples_lr(spark, sf)),
             ("missing_target", None)]
    rows = []
    for name, fn in tasks:
        if fn is None:
            rows.append((name, "skipped"))
            continue
        try:
            fn()
            rows.append((name, "ok"))
        except Exception:  # noqa: BLE001
            rows.append((name, "failed"))
    return spark.createDataFrame(rows, "task string, status string")


def _samples_lr(spark, sf):
    """Crop classifier on the soil samples (7 features, 22 classes) - the reference's main task."""
    from .common import samples_split
    s = ML.prepare_columns(samples_split(spark, sf), P.FEATURES, "crop_code", "sample_id")
    s = ML._stored(s.select("label", "features", "split"), "samples-lr")   # weights, fit and metrics read these rows
    s = EV.balanced_weights(s, "label")
    return ML.fit_and_score(ML.logistic_regression(maxIter=50), s, "samples_lr")


@register("m01_samples_logistic_regression")
def m01_samples_logistic_regression(spark, sf):
    return spark.createDataFrame([_row(_samples_lr(spark, sf))], RESULT)
