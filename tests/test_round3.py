"""Steps changed for FINDINGS_r03: row digests, stored quantile inputs, one-profile scores, spread bad lines."""

import glob
import os

from pyspark.sql import functions as F

from terroir.operators import profile as PR
from terroir.operators import quantiles as Q
from terroir.operators import rules as RU
from terroir.operators import transform as X


def test_duplicates_by_digest(spark):
    rows = [("a", "b:1", 1.0, None), ("a", "b:1", 1.0, None), ("a", None, 1.0, "b:1"), ("ab", ":1", 1.0, None), (None, None, 0.0, None),
            (None, None, -0.0, None), (None, None, float("nan"), None), (None, None, float("nan"), None), ("-", "", None, ""), ("-", None, None, "")]
    df = spark.createDataFrame(rows, "a string, b string, x double, c string").withColumn("parts", F.array("a"))
    assert PR.duplicate_count(df).first()["duplicates"] == 3
    shuffled = df.groupBy(*PR.row_digest(df.drop("parts"))).count()
    assert [f.dataType.simpleString() for f in shuffled.schema] == ["binary", "bigint"]        # no column goes along as it is
    assert PR.duplicate_count(df.limit(0)).first()["duplicates"] == 0


def _runs_of(spark, df, use):
    """How often rows of ``df`` are made while ``use`` takes it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    use(df.mapInArrow(count, df.schema))
    return seen.value


def test_quantile_passes_read_stored_values(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * F.col("id") * 1.0).alias("x"), (F.col("id") % 3).alias("g"))
    got = {}
    assert _runs_of(spark, df, lambda d: got.update(Q.exact_quantiles(d, ["x"], [0.5]))) == 500
    assert got[((), "x", 0.5)] == (249.0 ** 2 + 250.0 ** 2) / 2
    assert _runs_of(spark, df, lambda d: X.stratified_split(d, "g", "id")) == 500


def test_split_without_labels_to_stratify(spark):
    df = spark.range(40).withColumn("g", F.when(F.col("id") < 5, F.lit("a")).when(F.col("id") < 9, F.lit("b")))   # nine labelled rows
    n = {r["split"]: r["count"] for r in X.stratified_split(df, "g", "id").groupBy("split").count().collect()}
    assert n == {"train": 28, "val": 6, "test": 6}


def test_primary_score_of_one_profile(spark):
    rows = [("Rice", 900.0, 25.0), ("maize", 600.0, None), ("unknown", 1.0, 1.0), (None, 1.0, 1.0), ("apple", None, 12.0)]
    df = spark.createDataFrame(rows, "predicted string, rainfall double, temperature double").select(
        "*", *[F.lit(60.0).alias(c) for c in ("humidity", "N", "P", "K")], F.lit(6.5).alias("ph"), F.lit("kharif").alias("seasonal_context"),
        F.lit("rain-fed").alias("irrigation_type"), F.array(*[F.lit(c / 22) for c in range(22)]).alias("probs"))
    d = RU.with_shared(df).withColumn("sc", RU.suitability_scores())
    got = RU.with_primary(d, "predicted", "one").collect()
    for r in got:
        scores = [x["score"] for x in r["sc"] if x["crop"] == (r["predicted"] or "").lower()]
        assert r["one"] == (scores[0] if scores else 50)


def test_bad_lines_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    from terroir.plans import q_io
    from terroir.sources import proxies as P
    s = spark.range(0, 40, 1, 4).select(F.concat(F.lit('i"'), F.col("id").cast("string")).alias("sample_id"), F.col("id").cast("double").alias("N"),
                                        F.lit(0.5).alias("rainfall"), F.lit(3).alias("noise"))
    monkeypatch.setattr(P, "samples", lambda *_: s)
    monkeypatch.setattr(q_io, "shared_path", lambda *_: str(tmp_path / "csv"))
    out = {r["part"]: r for r in q_io.s01_csv_source(spark, "").collect()}
    assert (out["rows"]["n"], out["rows"]["ids"], out["rows"]["sum_n"]) == (40, 40, 780.0)
    assert (out["quarantine"]["n"], out["quarantine"]["ids"]) == (120, 120)
    files = [open(f).read().splitlines() for f in glob.glob(os.path.join(tmp_path, "csv", "part-*"))]
    assert len([f for f in files if any("many" in line for line in f)]) == 4
    assert all(f[0] == "sample_id,N,rainfall,noise" for f in files if f)
