"""Model training, scoring and explanation with Spark ML.

Re-aimed where Spark has no equivalent: kernel SVM -> one-vs-rest linear SVM over random Fourier features (M3),
boosting library -> one-vs-rest GBT with a validation indicator (M4/M5), multi-task
network -> one MLP per target on the shared split (M9), SHAP -> permutation importance
and exact linear attribution (M14/M15).  Metrics come from ``operators.evaluate`` on the
prediction table, so they are the same code paths the oracle checks.
"""

from __future__ import annotations

import math
import time
import uuid
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
                                       OneVsRest, RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluate as EV
from . import forest as FO
from . import transform as X
from ..session import shared_path
from .scan import ranked

#: Nodes of a part of a forest (about 1 KB each on the driver, that holds PARTS_AT_ONCE parts while they are fitted).
PART_NODES = 100_000
PARTS_AT_ONCE = 4


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def prepare_vectors(df: DataFrame, id_col: str = "vec_id", label: str = "label", emb: str = "embedding") -> DataFrame:
    """Features vector + label double + stratified split + balanced weights."""
    v = df.select(id_col, F.col(label).cast("double").alias("label"), array_to_vector(F.col(emb)).alias("features"))
    v = X.stratified_split(v, "label", id_col)
    return EV.balanced_weights(v, "label")


def prepare_columns(df: DataFrame, cols, label: str, id_col: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip")
    return va.transform(df).withColumn("label", F.col(label).cast("double"))


def evaluate_predictions(pred: DataFrame) -> dict:
    """A16 on a prediction frame (``label``, ``prediction``)."""
    m = EV.summary_metrics(pred, "label", "prediction").first()
    return {"accuracy": m["accuracy"], "macro_f1": m["macro_f1"], "weighted_f1": m["weighted_f1"]}


def fit_and_score(estimator, data: DataFrame, name: str) -> dict:
    """M7 step: fit on train, score val and test (seconds and metrics)."""
    train = data.filter(F.col("split") == "train")
    t0 = time.perf_counter()
    model = estimator.fit(train)
    secs = time.perf_counter() - t0
    out = {"model": name, "train_seconds": secs}
    scored = model.transform(data.filter(F.col("split").isin("val", "test")))
    for part in ("val", "test"):
        m = evaluate_predictions(scored.filter(F.col("split") == part))
        out.update({f"{part}_{k}": v for k, v in m.items()})
    out["_model"] = model
    return out


def _weight(weighted: bool) -> dict:
    return {"weightCol": "weight"} if weighted else {}


def logistic_regression(weighted: bool = True, **kw):
    """M1."""
    return LogisticRegression(family="multinomial", maxIter=kw.get("maxIter", 200), regParam=kw.get("regParam", 0.0),
                              **_weight(weighted))


def random_forest(num_trees: int = 300, max_depth: int = 20, weighted: bool = True):
    """M2 (reference settings: 300 trees; depth 20 for crops, 15 for fertility)."""
    return RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, seed=42, **_weight(weighted))


class StoredForest:
    """M2: a forest stored in parts of some of its trees; the driver reads one part at a time, and none if they are scored in tasks."""

    def __init__(self, parts: list[str], features: str | None = None):
        self.parts, self.features = parts, features

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``rawPrediction``, ``probability`` and ``prediction`` from the votes of all parts."""
        if self.features:
            rows = _stored(df.withColumn("_row", F.monotonically_increasing_id()), "forest-rows")
            out = rows.join(FO.votes(self.parts, rows, self.features, "_row", shared_path(df.sparkSession, f"forest-votes-{uuid.uuid4().hex}")), "_row").select(*df.columns, "_votes")
            out = _stored(out, "forest-votes")
        else:
            out = self._by_part(df)
        total = F.aggregate("_votes", F.lit(0.0), lambda t, v: t + v)
        return (out.withColumn("rawPrediction", array_to_vector("_votes"))
                .withColumn("probability", array_to_vector(F.transform("_votes", lambda v: v / F.when(total > 0, total).otherwise(1.0))))
                .withColumn("prediction", (F.array_position("_votes", F.array_max("_votes")) - 1).cast("double")).drop("_votes"))

    def _by_part(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_votes", F.lit(None).cast("array<double>"))
        for path in self.parts:
            raw = vector_to_array("rawPrediction")
            votes = F.when(F.col("_votes").isNull(), raw).otherwise(F.zip_with("_votes", raw, lambda a, b: a + b))
            out = _stored(RandomForestClassificationModel.load(path).transform(out).select(*df.columns, votes.alias("_votes")), "forest-votes")
        return out


class ForestInParts:
    """M2: ``estimator``'s trees stored in parts, so that the driver never holds a large forest whole.

    A tree of n training rows has less than 2 n nodes, and at most 2^(depth + 1); parts have about ``part_nodes``.  Spark ML fits
    up to PARTS_AT_ONCE parts side by side; part i draws with the estimator's seed + i.  The trees of more parts are grown whole in tasks,
    each with a draw of its own (``forest``), unless a task may not hold the binned training rows: then Spark ML fits these parts too."""

    def __init__(self, estimator: RandomForestClassifier, path: str | None = None, part_nodes: int = PART_NODES):
        self.estimator, self.path, self.part_nodes = estimator, path, part_nodes

    def fit(self, train: DataFrame) -> StoredForest:
        spark, e = train.sparkSession, self.estimator
        path = self.path or shared_path(spark, f"forest-{uuid.uuid4().hex}")
        rows = train.count()
        nodes = max(1, min(2 * rows, 2 ** (e.getMaxDepth() + 1)))
        n = math.ceil(e.getNumTrees() / max(1, self.part_nodes // nodes))
        sizes = [e.getNumTrees() // n + (i < e.getNumTrees() % n) for i in range(n)]
        if n > PARTS_AT_ONCE and FO.fits(e, train, rows, len(train.select(vector_to_array(e.getFeaturesCol())).first()[0])):
            return StoredForest(FO.grow(e, train, rows, path, sizes), e.getFeaturesCol())

        def fit_part(i: int) -> str:
            part = e.copy({e.numTrees: sizes[i], e.seed: e.getSeed() + i})
            part.fit(train).write().overwrite().save(f"{path}/part-{i:05d}")
            return f"{path}/part-{i:05d}"

        with ThreadPool(min(n, PARTS_AT_ONCE)) as pool:
            return StoredForest(pool.map(inheritable_thread_target(spark)(fit_part), range(n), 1))


def margin_classifier(weighted: bool = True):
    """M3: one-vs-rest linear SVM with class weights; over ``fourier_features`` it is the RBF margin classifier."""
    return OneVsRest(classifier=LinearSVC(maxIter=100, regParam=0.001), parallelism=4, **_weight(weighted))


def fourier_features(df: DataFrame, features: str = "features", m: int = 256, gamma: float | None = None, seed: int = 42) -> DataFrame:
    """M3: ``features`` replaced by ``m`` random Fourier features, whose inner products approximate exp(-gamma |x - y|^2).

    ``gamma`` is by default 1 / (dimensions x variance of all entries), from one aggregation.  The random projection is the same
    for every row; rows are projected in Arrow batches."""
    values = df.select(vector_to_array(features).alias("x"))
    if gamma is None:
        stats = values.select(F.size("x").alias("d"), F.explode("x").alias("v")).agg(F.max("d").alias("d"), F.var_pop("v").alias("var")).first()
        gamma = 1.0 / (stats["d"] * stats["var"]) if stats["var"] else 1.0
    first = values.first()
    d = len(first["x"]) if first else 1
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0.0, np.sqrt(2.0 * gamma), (d, m)), rng.uniform(0.0, 2.0 * np.pi, m)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        z = np.sqrt(2.0 / m) * np.cos(np.stack(x.to_list()) @ w + b) if len(x) else np.zeros((0, m))
        return pd.Series(list(z))

    return df.withColumn(features, array_to_vector(project(vector_to_array(features))))


def gradient_boosting(max_iter: int = 20):
    """M4: one-vs-rest GBT (Spark's GBT is binary)."""
    return OneVsRest(classifier=GBTClassifier(maxIter=max_iter, maxDepth=4, seed=42), parallelism=4)


def boosted_with_validation(max_iter: int = 300):
    """M5: GBT with validation-based early stopping (binary task) and weights."""
    return GBTClassifier(maxIter=max_iter, maxDepth=4, seed=42, validationIndicatorCol="is_val", weightCol="weight",
                         validationTol=0.01)


def grid_search(num_folds: int = 3):
    """M6: grid search with cross-validation (3 folds), parallel fits."""
    lr = LogisticRegression(family="multinomial", maxIter=100)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.01, 0.1]).addGrid(lr.elasticNetParam, [0.0, 0.5]).build()
    return CrossValidator(estimator=lr, estimatorParamMaps=grid, numFolds=num_folds, parallelism=4, seed=42,
                          evaluator=MulticlassClassificationEvaluator(metricName="accuracy"))


def mlp(n_in: int, n_classes: int):
    """M9: one MLP per target with layers [d, 128, 64, 32, k]."""
    return MultilayerPerceptronClassifier(layers=[n_in, 128, 64, 32, n_classes], maxIter=100, seed=42, blockSize=32)


def stacking(data: DataFrame, id_col: str = "vec_id", k: int = 5) -> DataFrame:
    """M8: out-of-fold class probabilities of LR and RF on the training rows -> meta LR.

    Folds come from X3 (stratified, hash order); base models are refit on all training
    rows for val/test.  Returns the meta model's predictions for every split.
    """
    train = data.filter(F.col("split") == "train")
    folded = _stored(X.stratified_folds(train, "label", id_col, k=k), "folds")   # each fold is read by every base model
    bases = {"lr": lambda: LogisticRegression(family="multinomial", maxIter=100),
             "rf": lambda: RandomForestClassifier(numTrees=50, maxDepth=10, seed=42)}

    def probs(model, df, tag):
        return model.transform(df).select(id_col, vector_to_array("probability").alias(tag))

    oof = None
    for name, make in bases.items():
        parts = []
        for f in range(k):
            m = make().fit(folded.filter(F.col("fold") != f))
            parts.append(probs(m, folded.filter(F.col("fold") == f), name))
        col = parts[0]
        for p_ in parts[1:]:
            col = col.unionByName(p_)
        full = probs(make().fit(train), data.filter(F.col("split") != "train"), name)
        col = col.unionByName(full)
        oof = col if oof is None else oof.join(col, id_col)
    meta_in = data.select(id_col, "label", "split").join(oof, id_col)
    meta_in = _stored(meta_in.withColumn("features", array_to_vector(F.concat("lr", "rf"))), "meta")   # all base models score once
    meta = LogisticRegression(family="multinomial", maxIter=100).fit(meta_in.filter(F.col("split") == "train"))
    return meta.transform(meta_in)


def batch_scores(model, df: DataFrame, labels: list | None = None) -> DataFrame:
    """Predicted class, confidence and probability per row (index -> label when given)."""
    p = model.transform(df).withColumn("_p", vector_to_array("probability"))
    p = p.withColumn("confidence", F.array_max("_p")).withColumn("predicted", F.col("prediction").cast("int"))
    if labels:
        arr = F.array(*[F.lit(x) for x in labels])
        p = p.withColumn("predicted_label", F.element_at(arr, F.col("predicted") + 1)).withColumn(
            "probabilities", F.map_from_arrays(arr, F.col("_p")))
    return p.drop("_p")


def importances(model, names: list[str]) -> list[tuple[str, float]]:
    """Tree importances, or mean |coefficient| over classes for linear models."""
    if hasattr(model, "featureImportances"):
        vals = model.featureImportances.toArray().tolist()
    else:
        vals = np.abs(model.coefficientMatrix.toArray()).mean(axis=0).tolist()
    return sorted(zip(names, vals), key=lambda t: -t[1])


def permutation_importance(model, df: DataFrame, dims: list[int], id_col: str = "vec_id", emb: str = "embedding") -> list:
    """``(dimension, accuracy drop)`` when one feature is replaced by another row's value.

    The permutation shifts each row to its successor in a hash order of the ids (ranks by an ordered scan, so no bucket is a
    task), and all dimensions are scored in one job: every row goes out once for each dimension, and once as it is."""
    n = df.count()
    order = ranked(df.select(F.col(id_col), F.col("label"), F.col(emb).cast("array<double>").alias(emb)), [], [X.hash_key(id_col), F.col(id_col)], "_rank", "permutation")
    donors = order.select((F.col("_rank") % n + 1).alias("_rank"), F.col(emb).alias("_donor"))
    each = order.join(donors, "_rank").withColumn("_dim", F.explode(F.array(*[F.lit(d) for d in [-1, *dims]])))
    mixed = F.transform(emb, lambda x, i: F.when(i == F.col("_dim"), F.get("_donor", i)).otherwise(x))
    scored = model.transform(each.select("label", "_dim", array_to_vector(mixed).alias("features")))
    hit = F.avg((F.col("prediction") == F.col("label")).cast("double"))
    accuracy = {r["_dim"]: r["a"] for r in scored.groupBy("_dim").agg(hit.alias("a")).collect()}   # a row for each dimension
    return [(d, accuracy[-1] - accuracy[d]) for d in dims] if accuracy else []


def linear_attribution(model, df: DataFrame, feature_means: list[float], emb: str = "embedding") -> DataFrame:
    """Exact attribution of a linear model, coef[class] * (x - mean), for the predicted class."""
    coef = model.coefficientMatrix.toArray().tolist()
    coef_arr = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in coef])
    means = F.array(*[F.lit(float(m)) for m in feature_means])
    p = model.transform(df).withColumn("_c", F.element_at(coef_arr, F.col("prediction").cast("int") + 1))
    attr = F.transform(F.col(emb), lambda x, i: F.element_at(F.col("_c"), i + 1) * (x - F.element_at(means, i + 1)))
    return p.withColumn("attribution", attr).drop("_c")


def pipeline(stages) -> Pipeline:
    return Pipeline(stages=stages)
