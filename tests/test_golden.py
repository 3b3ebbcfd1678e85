"""Golden cases (FIXTURES.md section 3) checked against the operators on tiny literal frames."""

from pyspark.sql import functions as F

from terroir.functions import features as FX
from terroir.operators import clean as C
from terroir.operators import rules as RU
from terroir.operators import spatial as SP
from terroir.operators import timeops as TO
from terroir.operators import transform as X
from terroir.operators import validate as V
from terroir.sources import knowledge as K

G1 = dict(N=50.0, P=40.0, K=40.0, ph=6.5, moisture=40.0, humidity=65.0, rainfall=800.0, temperature=28.0, ec=0.5,
          organic_carbon=0.8)


def test_g1_g2_row_validation(spark):
    bad = dict(G1, ph=15.0)
    df = spark.createDataFrame([G1, bad])
    rows = V.row_errors(df).select("valid", "errors").collect()
    assert rows[0]["valid"] and rows[0]["errors"] == []
    assert not rows[1]["valid"] and any(e.startswith("ph") for e in rows[1]["errors"])


def test_g3_quality_index(spark):
    df = spark.createDataFrame([G1])
    v = df.select(FX.soil_quality_index().alias("q")).first()["q"]
    assert abs(v - 35.08) < 1e-9


def test_g4_dedupe(spark):
    df = spark.createDataFrame([(10.0,), (10.0,), (20.0,)], "N double")
    assert C.remove_duplicates(df).count() == 2


def test_g5_unseen_label(spark):
    fit = spark.createDataFrame([("Rice",), ("Wheat",)], "crop string")
    app = spark.createDataFrame([("Rice",), ("Barley",)], "crop string")
    out = {r["crop"]: r["crop_encoded"] for r in X.encode_labels(app, "crop", X.label_mapping(fit, "crop")).collect()}
    assert out == {"Rice": 0, "Barley": -1}


def _rice_request(spark, **kw):
    base = dict(N=90.0, P=42.0, K=43.0, temperature=25.0, humidity=82.0, ph=6.5, rainfall=200.0,
                seasonal_context=None, irrigation_type=None)
    base.update(kw)
    probs = [0.0] * 22
    probs[K.CROP_CLASSES.index("rice")] = 0.88
    base["probs"] = probs
    schema = ("N double, P double, K double, temperature double, humidity double, ph double, rainfall double, "
              "seasonal_context string, irrigation_type string, probs array<double>")
    return spark.createDataFrame([base], schema)


def test_g6_tiers_and_suitability(spark):
    d = RU.with_shared(_rice_request(spark)).withColumn("sc", RU.suitability_scores())
    rows = RU.suitability_rows(RU.with_shared(_rice_request(spark))).filter("crop_name = 'rice'").first()
    assert rows["score_mod"] == 0 and rows["suitability_score"] == 77
    prim = RU.primary_score(F.col("sc"), F.lit("rice"))
    tiers = d.select(*[RU.confidence_tier(prim, F.lit(c)).alias(f"t{i}") for i, c in enumerate((0.88, 0.55, 0.25))]).first()
    assert (tiers["t0"], tiers["t1"], tiers["t2"]) == ("HIGH CONFIDENCE", "MODERATE CONFIDENCE", "LOW CONFIDENCE")


def test_g7_acid_soil(spark):
    req = _rice_request(spark, N=10.0, P=5.0, K=40.0, ph=4.5, rainfall=2000.0)
    r = RU.suitability_rows(RU.with_shared(req)).filter("crop_name = 'rice'").first()
    assert r["score_mod"] == -10 and r["suitability_score"] == 71
    a = req.select(RU.actions(F.col("ph"), F.lit("Medium"), F.lit("Nitrogen deficient"), F.lit("rice")).alias("a")).first()["a"]
    assert any("lime" in x for x in a["high"]) and any("Nitrogen" in x for x in a["high"])
    n = req.select(RU.narrative(F.col("ph"), F.col("rainfall"), F.col("humidity"), F.col("N"), F.col("P"), F.col("K"),
                                F.lit("rice")).alias("n")).first()["n"]
    assert "suboptimal levels" in n


def test_g8_top_three(spark):
    d = RU.with_shared(_rice_request(spark)).withColumn("sc", RU.suitability_scores())
    top, avoid = RU.ranked(F.col("sc"))
    r = d.select(top.alias("top"), avoid.alias("avoid")).first()
    assert len(r["top"]) == 3 and all(0 <= x["score"] <= 100 for x in r["top"]) and len(r["avoid"]) == 3


def test_g9_extremes(spark):
    req = _rice_request(spark, N=0.0, P=0.0, K=0.0, ph=0.0, rainfall=0.0, humidity=0.0, temperature=-50.0)
    assert RU.suitability_rows(RU.with_shared(req)).count() == 22


def _spatial(spark, zone, agro, irr, soil, season, district, crop, score):
    df = spark.createDataFrame([(zone, agro, irr, soil, season, district)],
                               "rz string, az string, irr string, soil string, season string, district string")
    tags = SP.spatial_tags(F.col("rz"), F.col("az"), F.col("irr"), F.col("soil"), F.col("season"))
    top = F.array(F.struct(F.lit(crop).alias("crop"), F.lit(score).alias("suitability_score"),
                           F.array().cast("array<string>").alias("advantages"), F.array().cast("array<string>").alias("risks")))
    return df.select(SP.adjust_top_crops(top, tags, F.col("district"))[0].alias("c"),
                     SP.region_intelligence(F.lit("Tamil Nadu"), F.col("district"), F.lit(None), F.col("az"), F.col("irr")).alias("i")).first()


def test_g10_spatial_bonus(spark):
    r = _spatial(spark, "coastal", "coastal", "canal_irrigation", "clay", "kharif", "Chennai", "Rice", 50)
    assert r["c"]["suitability_score"] == 75


def test_g11_district(spark):
    r = _spatial(spark, None, "delta_region", "canal irrigation", "clay", None, "Thanjavur", "Rice", 60)
    assert r["c"]["suitability_score"] == 80
    risks = " ".join(r["i"]["environmental_risks"])
    assert "flood" in risks.lower() and "salinity" in risks.lower()


def test_g12_arid(spark):
    r = _spatial(spark, None, "arid", None, None, None, "X", "Rice", 60)
    assert any("Drought risk" in x for x in r["i"]["environmental_risks"])


def test_g13_polygon(spark):
    ring = "array(named_struct('x', 0d, 'y', 0d), named_struct('x', 10d, 'y', 0d), named_struct('x', 10d, 'y', 10d), " \
           "named_struct('x', 0d, 'y', 10d), named_struct('x', 0d, 'y', 0d))"
    df = spark.createDataFrame([(5.0, 5.0), (15.0, 15.0)], "x double, y double").withColumn("ring", F.expr(ring))
    assert [r["i"] for r in df.select(SP.ray_cast_inside(F.col("x"), F.col("y"), F.col("ring")).alias("i")).collect()] == [True, False]


def test_g15_coordinates(spark):
    df = spark.createDataFrame([("12.9716", "77.5946", True), ("-90", "180", True), ("95", "77", False),
                                ("12", "-190", False), ("invalid", "77", False)], "lat string, lon string, ok boolean")
    assert all(r["v"] == r["ok"] for r in df.select(FX.valid_coordinates("lat", "lon").alias("v"), "ok").collect())


def test_g16_grid_cell(spark):
    df = spark.createDataFrame([(12.9716, 77.5946), (12.9749, 77.5922)], "lat double, lon double")
    assert {r["k"] for r in df.select(FX.grid_key().alias("k")).collect()} == {"12.97_77.59"}


def _compat(spark, ut, uh, lt, lh, lr=0.0, p7=0.0, has_obs=True):
    df = spark.createDataFrame([(ut, uh, lt, lh, lr, p7)], "ut double, uh double, lt double, lh double, lr double, p7 double")
    obs = F.when(F.lit(has_obs), F.struct(F.col("lt").alias("live_temp"), F.col("lh").alias("live_hum"),
                                          F.col("lr").alias("live_rain"), F.lit(0.0).alias("wind_speed"),
                                          F.col("p7").alias("precip_7d")))
    return df.select(TO.compatibility(F.col("ut"), F.col("uh"), F.lit(None).cast("double"), F.lit("borewell"), obs).alias("c")).first()["c"]


def test_g17_alignment(spark):
    a = _compat(spark, 25.0, 40.0, 25.0, 40.0)
    assert a["alignment_score"] == 100 and a["realism_confidence"] == "HIGH CONSISTENCY"
    b = _compat(spark, 25.0, 40.0, 38.0, 80.0)
    assert b["alignment_score"] == 5 and b["realism_confidence"] == "CRITICAL ANOMALY"


def test_g18_risks(spark):
    a = _compat(spark, 39.0, 20.0, 39.0, 20.0)
    assert a["drought_risk"] == "High" and a["heat_stress"] == "Medium"
    b = _compat(spark, 25.0, 50.0, 25.0, 50.0, lr=25.0, p7=140.0)
    assert b["flood_sensitivity"] == "High"


def test_g19_fallback(spark):
    a = _compat(spark, 25.0, 40.0, 25.0, 40.0, has_obs=False)
    assert a["alignment_score"] == 100 and a["realism_confidence"].startswith("HIGH (Fallback")


def test_g20_graph(spark):
    df = spark.createDataFrame([("rice", "clay loamy", "Delta Region", "canal irrigation", 90.0),
                                ("rice", "sandy dry", "Semi-Arid Plains", "rain-fed", 20.0)],
                               "crop string, soil string, zone string, irr string, n double")
    g = [r["g"]["score_offset"] for r in df.select(TO.graph_compatibility(
        F.col("crop"), F.col("soil"), F.col("zone"), F.col("irr"), F.col("n")).alias("g")).collect()]
    assert g == [35, -40]


def test_g21_drift_and_recurring(spark):
    rows = [(1, 1, 1_000_000, 25.0, 60.0, 120.0, "Nitrogen deficient"), (1, 2, 2_000_000, 28.0, 45.0, 50.0, "Nitrogen deficient")]
    df = spark.createDataFrame(rows, "field_id long, event_id long, ts_us long, temperature double, humidity double, "
                                     "rainfall double, deficiency string")
    df = df.withColumns({"N": F.lit(50.0), "P": F.lit(40.0), "K": F.lit(40.0), "crop_prediction": F.lit("rice")})
    h = TO.session_history(df).filter("event_id = 2")
    r = h.select(TO.drift(F.col("history")).alias("d"), TO.recurring_deficiencies(F.col("history")).alias("r")).first()
    assert abs(r["d"]["temp_drift"] - 3.0) < 1e-9 and r["d"]["drought_trend"] and r["d"]["rainfall_trend"] == "drying"
    assert r["r"] == ["Nitrogen"]


def test_g22_health(spark):
    df = spark.createDataFrame([(90.0, 60.0, 60.0, 6.8), (10.0, 10.0, 10.0, 4.5)], "N double, P double, K double, ph double")
    assert [r["h"] for r in df.select(FX.soil_health_rating().alias("h")).collect()] == [100, 40]


def test_g23_adaptive(spark):
    base = dict(N=80.0, P=40.0, K=40.0, ph=6.5, crop_prediction="rice", soil_texture="clay", agro_climatic_zone="Delta",
                irrigation_type="canal irrigation", confidence_pct=90.0)
    df = spark.createDataFrame([dict(base, dry=False), dict(base, dry=True)])
    compat = F.struct(F.lit(95).alias("alignment_score"), F.lit("Low").alias("drought_risk"),
                      F.lit("Low").alias("flood_sensitivity"), F.lit("Low").alias("heat_stress"))
    df = df.withColumns({"compat": compat, "recurring": F.array().cast("array<string>"),
                         "drift_prev": F.struct(F.col("dry").alias("drought_trend"), F.lit("stable").alias("rainfall_trend")),
                         "graph": TO.graph_compatibility(F.col("crop_prediction"), F.col("soil_texture"),
                                                         F.col("agro_climatic_zone"), F.col("irrigation_type"), F.col("N"))})
    scores = [r["intelligence_score"] for r in TO.adaptive_score(df).orderBy("dry").collect()]
    assert scores == [95, 75]
