"""Findings of round 4: X4 with many recipients (F1), texts of R1."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def _some_boxes(rng, columns=3):
    from terroir.operators import impute
    points = np.round(rng.normal(0, 9, (900, columns)), 1)
    points[rng.random(points.shape) < 0.1] = np.nan
    tree = impute._fit_tree(points, 40)
    number = ((np.isnan(points) @ (1 << np.arange(columns))) << impute.LEAF_BITS) + impute._leaf_of(tree, points)
    names = [f"c{j}" for j in range(columns)]
    none = lambda x: None if np.isnan(x) else float(x)
    cells = []
    for n in np.unique(number):
        own = points[number == n]
        cells.append({"cell": int(n)} | {f"lo_{c}": none(own[:, j].min()) for j, c in enumerate(names)} | {f"hi_{c}": none(own[:, j].max()) for j, c in enumerate(names)})
    return impute._boxes(cells, names, columns + 1, tree), cells, names


@pytest.mark.parametrize("most", [1, 4])
def test_next_cells_of_all_recipients_at_once(most):
    """The next cells by (bound, number) after the last one seen and within reach, as an ordered list of all cells has them."""
    from terroir.operators import impute
    rng = np.random.default_rng(4)
    b, cells, names = _some_boxes(rng)
    points = np.round(rng.normal(0, 12, (60, 3)), 1)
    points[rng.random(points.shape) < 0.15] = np.nan
    seen = [(-1.0, -1)] * 60
    for reach in (np.inf, np.inf, 40.0):
        rows, number, bound, more = impute._next_of(points, np.full(60, reach), np.array([s[0] for s in seen]), np.array([s[1] for s in seen]), b, most)
        for i, x in enumerate(points):
            want = []
            for c in cells:
                off = [max(c[f"lo_{n}"] - v, v - c[f"hi_{n}"], 0.0) for n, v in zip(names, x) if c[f"lo_{n}"] is not None and not np.isnan(v)]
                if off:
                    want.append((4 / len(off) * sum(o * o for o in off), c["cell"]))
            want = sorted(w for w in want if w > seen[i] and w[0] <= reach)
            got = list(zip(bound[rows == i], number[rows == i]))
            assert [g[1] for g in got] == [w[1] for w in want[:most]]
            assert np.allclose([g[0] for g in got], [w[0] for w in want[:most]])
            assert more[i] or len(want) <= most
            seen[i] = got[-1] if got else seen[i]


def test_next_cells_are_chosen_by_all_cores(spark):
    from terroir.operators import impute
    b, _, names = _some_boxes(np.random.default_rng(4))
    state = spark.range(50).select(F.col("id").alias("rid"), *[F.lit(1.0).alias(n) for n in names], F.lit(float("inf")).alias("reach"),
                                   F.lit(-1.0).alias("at_bound"), F.lit(-1).cast("long").alias("at_cell")).coalesce(1)
    visits = impute._next_cells(state, names, spark.sparkContext.broadcast(b), 1)
    assert visits.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert visits.count() == 50


def test_only_crowded_cells_lose_donors_that_cannot_count(spark, monkeypatch):
    """Donors are not ranked at their points unless a cell is crowded; then k stay at a point, those with the smallest ids."""
    from terroir.operators import impute
    ranked, top = [], impute.top_k_per_group
    monkeypatch.setattr(impute, "top_k_per_group", lambda df, *a: ranked.append(df.count()) or top(df, *a))
    rows = [(i, float(i % 50), float(i % 7), None if i % 10 == 0 else float(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    assert impute.knn_impute(df, "id", ["a", "b", "c"], leaf_rows=64).filter("c is null").count() == 0
    assert ranked == []
    rows += [(1000 + i, 3.0, 3.0, float(i)) for i in range(400)] + [(0, 3.0, 3.0, None)]
    df = spark.createDataFrame(rows[1:], "id long, a double, b double, c double")
    got = impute.knn_impute(df, "id", ["a", "b", "c"], leaf_rows=64).filter("id = 0").first()["c"]
    at = sorted((r[0], r[3]) for r in rows[1:] if r[1:3] == (3.0, 3.0) and r[3] is not None)[:5]
    assert len(ranked) == 1 and 400 <= ranked[0] < 600
    assert abs(got - sum(v for _, v in at) / 5) < 1e-9


def test_rows_keep_their_columns_and_null_ids_are_left_out(spark):
    from terroir.operators import impute
    df = spark.createDataFrame([(1, "x", 1.0, 2.0), (2, "y", float("nan"), 2.0), (None, "z", 1.0, 1.0), (4, "w", 3.0, 5.0)], "id long, t string, a double, b double")
    out = impute.knn_impute(df, "id", ["a", "b"], k=1)
    assert out.columns == ["id", "t", "a", "b"]
    assert sorted(map(tuple, out.collect())) == [(1, "x", 1.0, 2.0), (2, "y", 1.0, 2.0), (4, "w", 3.0, 5.0)]


def _field_requests(spark):
    """Requests at and beside the bounds of the profiles, with missing numbers and seasons."""
    rng = np.random.default_rng(12)
    pick = lambda *v: v[rng.integers(len(v))]
    rows = [(float(pick(0, 30, 50, 90)), float(pick(0, 30, 60)), float(pick(0, 35, 80)), pick(None, 4.0, 5.5, 6.5, 7.5, 9.0), pick(None, 5.0, 20.0, 28.0, 45.0),
             pick(None, 20.0, 55.0, 80.0, 99.0), pick(None, float("nan"), 100.0, 450.0, 500.0, 1200.0, 4000.0), pick(None, "", "Kharif", "rabi", "summer", "perennial"),
             pick(None, "rain-fed", "borewell"), [float(x) for x in rng.random(22) / 4]) for _ in range(300)]
    return spark.createDataFrame(rows, "N double, P double, K double, ph double, temperature double, humidity double, rainfall double, seasonal_context string, "
                                       "irrigation_type string, probs array<double>")


def test_joined_texts_are_the_joined_lists(spark):
    from terroir.operators import rules as RU
    e = RU.suitability_rows(RU.with_shared(_field_requests(spark)), sep=" | ")
    assert e.count() == 300 * 22
    for name, most in (("advantages", 3), ("risks", 3), ("limiting_factors", 2)):
        got = e.select(F.array_join(f"t.{name}", " | ").alias("want"), F.col(f"joined.{name}").alias("got"), F.size(f"t.{name}").alias("n"))
        assert got.filter("not want <=> got").count() == 0
        assert got.agg(F.min("n"), F.max("n")).first()[:] == (1, most)
        assert got.select("want").distinct().count() > 50


def test_r01_makes_no_lists_of_texts(spark, monkeypatch):
    from terroir.plans import q_rules
    monkeypatch.setattr(q_rules, "_requests", lambda s, _: q_rules.RU.with_shared(_field_requests(s)))
    out = q_rules.r01_crop_suitability(spark, "")
    assert len(out.collect()) == 22
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "slice(" not in plan
