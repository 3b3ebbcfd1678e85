"""M2: forests stored in parts (F1, F2)."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from terroir.operators import ml as ML


def _rows(spark):
    r = spark.range(60).select(F.col("id"), (F.col("id") % 3).cast("double").alias("label"), F.lit(1.0).alias("weight"),
                               F.array((F.col("id") % 3 + F.col("id") % 5 * 0.3).cast("double"), (F.col("id") % 7).cast("double")).alias("x"))
    return r.select("id", "label", "weight", array_to_vector("x").alias("features")).persist()


def _raw(df):
    return {r["id"]: (r["raw"], r["prediction"]) for r in df.select("id", vector_to_array("rawPrediction").alias("raw"), "prediction").collect()}


def test_one_part_is_the_plain_forest(spark):
    d = _rows(spark)
    e = ML.random_forest(6, 4)
    stored = ML.ForestInParts(e).fit(d)
    assert len(stored.parts) == 1
    assert _raw(stored.transform(d)) == _raw(e.fit(d).transform(d))


def test_parts_hold_all_trees_and_their_votes_add_up(spark):
    d = _rows(spark)
    stored = ML.ForestInParts(ML.random_forest(7, 4), part_nodes=64).fit(d)       # at most 32 nodes a tree
    models = [ML.RandomForestClassificationModel.load(p) for p in stored.parts]
    assert [m.getNumTrees for m in models] == [2, 2, 2, 1]
    each = [_raw(m.transform(d)) for m in models]
    got = _raw(stored.transform(d))
    assert len(got) == 60
    for i, (raw, prediction) in got.items():
        total = [sum(p[i][0][c] for p in each) for c in range(3)]
        assert max(abs(a - b) for a, b in zip(raw, total)) < 1e-9
        assert prediction == raw.index(max(raw))


def _random_rows(spark, n=400):
    import numpy as np
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(0, 2, (n, 5)), 3)
    x[:, 4] = 1.0                                                     # no split
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0) + 2 * (x[:, 3] > 1)
    w = rng.uniform(0.5, 2.0, n)
    rows = spark.createDataFrame([(i, float(c), float(v), r.tolist()) for i, (c, v, r) in enumerate(zip(y, w, x))], "id long, label double, weight double, x array<double>")
    return rows.select("id", "label", "weight", array_to_vector("x").alias("features")).persist()


def test_grown_trees_split_as_spark_ml_does(spark):
    """Without random draws a grown tree is that of Spark ML: thresholds, weights, counts, merged siblings."""
    d = _random_rows(spark)
    e = ML.RandomForestClassifier(numTrees=5, maxDepth=4, bootstrap=False, featureSubsetStrategy="all", weightCol="weight", minInstancesPerNode=3, seed=1)
    stored = ML.ForestInParts(e, part_nodes=1).fit(d)
    assert stored.features and len(stored.parts) == 5
    want = e.fit(d)
    lines = lambda tree: tree.toDebugString.split("\n")[1:]
    for path, tree in zip(stored.parts, want.trees):
        got = ML.RandomForestClassificationModel.load(path)
        assert (got.numClasses, got.numFeatures, got.getMaxDepth()) == (4, 5, 4)
        assert lines(got.trees[0]) == lines(tree)
        assert all(abs(a - b) < 1e-9 for a, b in zip(got.featureImportances.toArray(), want.featureImportances.toArray()))
    got = _raw(stored.transform(d))
    for i, (raw, prediction) in _raw(want.transform(d)).items():
        assert max(abs(a - b) for a, b in zip(raw, got[i][0])) < 1e-9 and prediction == got[i][1]


def test_a_forest_in_parts_is_neither_fitted_nor_read_by_the_driver(spark, monkeypatch):
    """300 parts were 300 fits, loads and stored tables."""
    d = _random_rows(spark)
    fits, fit = [], ML.RandomForestClassifier.fit
    monkeypatch.setattr(ML.RandomForestClassifier, "fit", lambda self, *a: fits.append(self.getNumTrees()) or fit(self, *a))
    monkeypatch.setattr(ML.RandomForestClassificationModel, "load", None)
    stored = ML.ForestInParts(ML.random_forest(40, 8), part_nodes=1).fit(d)
    assert len(stored.parts) == 40 and sum(fits) <= 1
    rows = stored.transform(d).select("id", "label", "prediction", vector_to_array("probability").alias("p")).collect()
    assert sorted(r["id"] for r in rows) == list(range(400))
    assert all(abs(sum(r["p"]) - 1.0) < 1e-9 for r in rows)
    assert sum(r["label"] == r["prediction"] for r in rows) > 380


def test_few_parts_are_spark_mls(spark):
    d = _random_rows(spark)
    e = ML.random_forest(4, 5)
    stored = ML.ForestInParts(e, part_nodes=64).fit(d)
    assert len(stored.parts) == 4 and stored.features is None
    for i, path in enumerate(stored.parts):
        assert ML.RandomForestClassificationModel.load(path).toDebugString.split("\n")[1:] == e.copy({e.numTrees: 1, e.seed: 42 + i}).fit(d).toDebugString.split("\n")[1:]


def test_grown_parts_hold_all_trees_and_their_votes_add_up(spark):
    d = _random_rows(spark)
    stored = ML.ForestInParts(ML.random_forest(11, 4), part_nodes=64).fit(d)       # at most 32 nodes a tree
    models = [ML.RandomForestClassificationModel.load(p) for p in stored.parts]
    assert stored.features and [m.getNumTrees for m in models] == [2, 2, 2, 2, 2, 1]
    each = [_raw(m.transform(d)) for m in models]
    for i, (raw, prediction) in _raw(stored.transform(d)).items():
        total = [sum(p[i][0][c] for p in each) for c in range(4)]
        assert max(abs(a - b) for a, b in zip(raw, total)) < 1e-9
        assert prediction == raw.index(max(raw))


def test_rows_that_a_task_may_not_hold_are_left_to_spark_ml(spark, monkeypatch):
    from terroir.operators import forest
    d = _random_rows(spark)
    monkeypatch.setattr(forest, "LOCAL_BYTES", 1000)
    stored = ML.ForestInParts(ML.random_forest(5, 3), part_nodes=16).fit(d)
    assert len(stored.parts) == 5 and stored.features is None
    assert stored.transform(d).count() == 400


def test_scored_rows_go_out_in_blocks(spark, monkeypatch):
    from terroir.operators import forest
    d = _random_rows(spark)
    stored = ML.ForestInParts(ML.random_forest(6, 5), part_nodes=64).fit(d)
    assert stored.features and len(stored.parts) == 6
    whole = _raw(stored.transform(d))
    monkeypatch.setattr(forest, "LOCAL_BYTES", 6000)
    assert {i: p for i, (_, p) in _raw(stored.transform(d)).items()} == {i: p for i, (_, p) in whole.items()}
    assert stored.transform(d.filter("id < 0")).count() == 0
