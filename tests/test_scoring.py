"""Scoring inputs, processed-table validation and the pipeline gate."""

from terroir.operators import scoring as SC
from terroir.operators import validate as V


def test_nearest_centroid_ties_and_gaps(spark):
    centres = [(0.0, 0.0), (2.0, 0.0), (10.0, 10.0)]
    rows = [(1, 1.0, 0.0), (2, 1.9, 0.1), (3, 99.0, 99.0), (4, None, 0.0), (5, float("nan"), 10.0)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double")
    got = {r["id"]: r["lat_lon_cluster"] for r in SC.nearest_centroid(df, centres).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0}
    assert {r["lat_lon_cluster"] for r in SC.nearest_centroid(df.drop("lon"), centres).collect()} == {0}
    assert {r["lat_lon_cluster"] for r in SC.nearest_centroid(df, []).collect()} == {0}


def test_fitted_centroids_separate_two_places(spark):
    rows = [(float(i % 3), float(i % 2)) for i in range(20)] + [(50.0 + i % 3, 50.0) for i in range(20)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    centres = sorted(SC.fit_centroids(df, k=2))
    assert len(centres) == 2 and centres[0][0] < 3 and centres[1][0] > 49


def test_assemble_takes_what_there_is(spark):
    df = spark.createDataFrame([(10.0, 20.0, 30.0, 6.5, "rabi", "X"), (999.0, 20.0, 30.0, 6.5, "rabi", "Y")],
                               "N double, P double, K double, ph double, season string, state string")
    states = spark.createDataFrame([("W", 0), ("X", 1)], "state string, code int")
    out, names = SC.assemble(df, ["N", "P", "K", "ph", "moisture"], states=states)
    assert names == ["N", "P", "K", "ph", "fertility_score", "season_encoded", "lat_lon_cluster", "region_code"]
    good, bad = sorted(out.collect(), key=lambda r: not r["valid"])
    assert [good[c] for c in names] == [10.0, 20.0, 30.0, 6.5, 20.0, 1.0, 0.0, 1.0]
    assert not bad["valid"] and all(bad[c] is None for c in names)


def test_range_status(spark):
    df = spark.createDataFrame([(14.005, 101.0, None), (0.0, 5.0, "rice")], "ph double, humidity double, crop string")
    got = {r["feature"]: r["status"] for r in V.range_status(df, ["ph", "humidity", "ec"], "crop").collect()}
    assert (got["ph"], got["humidity"], got["ec"], got["crop"]) == ("PASS", "CLIP/FAIL", "MISSING", "PASS")
    empty = {r["feature"]: (r["status"], r["nulls"]) for r in V.range_status(df.filter("false"), ["ph"], "yield").collect()}
    assert empty["ph"] == ("PASS", 0) and empty["yield"] == ("MISSING", None)


def test_gate_skips_critical_and_untargeted(spark):
    ok = spark.createDataFrame([(7.0, "rice")], "ph double, crop string")
    wet = spark.createDataFrame([(15.0, "rice")], "ph double, crop string")
    got = {r["dataset"]: (r["severity"], r["status"], r["error"]) for r in V.pipeline_gate(
        {"ok": (ok, "crop", ["ph"]), "wet": (wet, "crop", ["ph"]), "bare": (ok.drop("crop"), "crop", ["ph"]), "cut": (ok, "crop", ["N"])}).collect()}
    assert got == {"ok": ("PASS", "processed", None), "wet": ("CRITICAL", "skipped", None),
                   "bare": ("PASS", "skipped", "Missing target column: crop"), "cut": ("CRITICAL", "skipped", None)}
