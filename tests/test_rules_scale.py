"""rules without interpreted lambdas, ranking in batches."""

import itertools

from pyspark.sql import functions as F

from terroir.operators import rules as RU
from terroir.operators import spatial as SP

SCHEMA = ("rainfall double, temperature double, humidity double, ph double, N double, P double, K double, seasonal_context string, "
          "irrigation_type string, probs array<double>")


def _requests(spark):
    nan = float("nan")
    numbers = [(900.0, 25.0, 60.0, 6.5, 60.0, 40.0, 40.0), (100.0, 5.0, 20.0, 4.0, 1.0, 2.0, 3.0), (None,) * 7, (nan,) * 7, (2500.0, 30.0, None, nan, None, 29.0, 35.0),
               (1200.0, 20.0, 70.0, 5.0, 50.0, 30.0, 35.0)]
    context = [(None, None), ("Kharif", "Rain-fed"), ("rabi", "borewell"), ("", "rain-fed"), ("no season", "rain-fed")]
    probs = [None, [0.9] + [0.0] * 21, [None] * 11 + [0.3] * 11, [1 / 22] * 22, [0.05] * 10 + [0.0501] * 12]
    return RU.with_shared(spark.createDataFrame([n + c + (p,) for n, c, p in itertools.product(numbers, context, probs)], SCHEMA))


def test_batches_rank_as_the_columns_do(spark):
    top, avoid = RU.ranked(F.col("sc"))
    d = RU.with_ranked(_requests(spark).withColumn("sc", RU.suitability_scores())).select("_top", "_avoid", top.alias("top"), avoid.alias("avoid")).collect()
    assert len(d) == 150
    for r in d:
        assert r["_top"] == r["top"] and r["_avoid"] == r["avoid"]


def test_texts_are_compiled_and_keep_their_order(spark):
    e = RU.suitability_rows(_requests(spark))
    assert "lambda" not in e.select("t")._jdf.queryExecution().optimizedPlan().toString()
    lim, risk = RU.first_texts(F.col("pr"))
    for r in e.select("t", lim.alias("lim"), risk.alias("risk")).collect():
        assert r["t"]["limiting_factors"][0] == (r["lim"] or RU.T["no_limit"]) and r["t"]["risks"][0] == (r["risk"] or RU.T["no_risk"])
        assert None not in r["t"]["advantages"] and 1 <= len(r["t"]["advantages"]) <= 3


def test_adjusted_crop_is_one_expression(spark):
    """Tags and zone count together; the expression does not grow with the crops that have tags."""
    df = spark.createDataFrame([("Rice", 97, "Thanjavur", ["clay", "clay", "arid"]), ("wheat", 12, "Thanjavur", ["kharif"]), ("jowar", 95, "Coimbatore", []),
                                ("apple", 5, None, ["clay"])], "crop string, suitability_score int, district string, tags array<string>")
    d = df.withColumns({"advantages": F.array(F.lit("a")), "risks": F.array().cast("array<string>")})
    out = d.select(SP.adjust_crop({c: F.col(c) for c in d.columns}, F.col("tags"), F.col("district")).alias("c")).select("c.*")
    assert [(r[0], r[1], len(r[2]), len(r[3])) for r in out.collect()] == [("Rice", 99, 3, 1), ("wheat", 10, 1, 2), ("jowar", 99, 2, 0), ("apple", 5, 1, 0)]
    top = F.array(F.struct(*[F.col(c) for c in ("crop", "suitability_score", "advantages", "risks")]))
    assert d.select(SP.adjust_top_crops(top, F.col("tags"), F.col("district"))[0].alias("c")).select("c.*").collect() == out.collect()
