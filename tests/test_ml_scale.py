"""Permutation importance in one job, and the RBF margin classifier."""

import numpy as np
from pyspark.sql import functions as F

from terroir.operators import ml as ML
from terroir.operators import transform as X


def test_permutation_importance_matches_a_local_model(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = (x @ [3.0, 0.0, -1.0, 0.2] + rng.normal(size=400) * 0.3 > 0).astype(int)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "vec_id long, embedding array<double>, label int")
    data = ML.prepare_vectors(df).join(df.select("vec_id", "embedding"), "vec_id")
    model = ML.logistic_regression(weighted=False).fit(data)
    got = dict(ML.permutation_importance(model, data, [0, 1, 2, 3]))
    order = [r.vec_id for r in df.orderBy(X.hash_key("vec_id"), "vec_id").collect()]
    after = dict(zip(order, order[1:] + order[:1]))           # a row takes the value of the one before it in rank, cyclically
    before = {b: a for a, b in after.items()}

    def accuracy(v):
        raw = v @ model.coefficientMatrix.toArray().T + model.interceptVector.toArray()
        return (raw.argmax(1) == y).mean()

    for d in range(4):
        moved = x.copy()
        moved[:, d] = [x[before[i], d] for i in range(400)]
        assert abs(got[d] - (accuracy(x) - accuracy(moved))) < 1e-12
    assert got[0] > got[2] > got[1] - 0.02


def test_fourier_features_find_a_ring(spark):
    rng = np.random.default_rng(2)
    r, t = rng.uniform(0, 3, 1500), rng.uniform(0, 2 * np.pi, 1500)
    rows = [(i, [float(a * np.cos(b)), float(a * np.sin(b))], int(1 < a < 2)) for i, (a, b) in enumerate(zip(r, t))]
    data = ML.prepare_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).coalesce(1).persist()
    linear = ML.fit_and_score(ML.margin_classifier(), data, "linear")
    kernel = ML.fit_and_score(ML.margin_classifier(), ML.fourier_features(data, m=96, gamma=1.0).coalesce(1).persist(), "rbf")
    assert kernel["test_accuracy"] > 0.9 > linear["test_accuracy"] + 0.1
    assert ML.fourier_features(data.limit(3), m=8).select(F.size(ML.vector_to_array("features")).alias("n")).first()["n"] == 8
