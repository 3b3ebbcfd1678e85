"""Text source and sink, fitted-artifact store and input order."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.artifacts import ArtifactStore
from ..operators.scan import ranked
from ..session import shared_path
from ..sources import proxies as P
from ..sources import textfiles as TX
from ..sources.tables import read_positioned
from . import pipeline as PL
from .catalog import register
from .oracle_views import with_views
from .q_features import PIPE_FEATURES, PIPELINE_SQL

R6 = lambda c: F.round(c, 6)


@register("s01_csv_source", with_views("""
SELECT 'rows' AS part, count(*) AS n, count(DISTINCT sample_id) AS ids, round(sum(N), 4) AS sum_n, round(sum(rainfall), 4) AS sum_rainfall FROM samples
UNION ALL
SELECT 'quarantine', count(*) * 3, count(*) * 3, NULL, NULL FROM samples WHERE noise = 3""", "samples"))
def s01_csv_source(spark, sf):
    """The samples as text, with bad lines among them (a word for a number, too few and too many fields), read with their schema."""
    s = P.samples(spark, sf)
    path = shared_path(spark, f"csv-{uuid.uuid4().hex}")
    schema = TX.write_csv(s, path)
    bad = s.filter("noise = 3").select(F.explode(F.array(
        F.concat_ws(",", "sample_id", F.lit("many"), *[F.lit("1.5")] * (len(schema) - 2)), F.concat_ws(",", "sample_id", F.lit("1.5")),
        F.concat_ws(",", "sample_id", *[F.lit("1")] * (len(schema) + 3)))).alias("value"))
    # one column named like the whole header line: every task writes its own file, header first, lines as they are
    bad.toDF(",".join(schema.names)).write.mode("append").options(header=True, sep="\u0001", quote="", ignoreLeadingWhiteSpace=False,
                                                                  ignoreTrailingWhiteSpace=False).csv(path)
    rows, quarantine = TX.read_csv(spark, path, schema)
    good = rows.agg(F.lit("rows").alias("part"), F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("ids"), F.round(F.sum("N"), 4).alias("sum_n"),
                    F.round(F.sum("rainfall"), 4).alias("sum_rainfall"))
    none = F.lit(None).cast("double")
    return good.unionByName(quarantine.agg(F.lit("quarantine").alias("part"), F.count(F.lit(1)).alias("n"), F.countDistinct("line").alias("ids"), none.alias("sum_n"),
                                           none.alias("sum_rainfall")))


@register("s08_csv_sink", with_views("""
SELECT sample_id, N, ph, rainfall, season, crop, crop_code FROM samples_dirty""", "samples_dirty"))
def s08_csv_sink(spark, sf):
    """A table with gaps and repeated rows written as text and read again: every value as it was."""
    path = shared_path(spark, f"csv-{uuid.uuid4().hex}")
    schema = TX.write_csv(P.samples_dirty(spark, sf), path)
    return TX.read_csv(spark, path, schema)[0].select("sample_id", "N", "ph", "rainfall", "season", "crop", "crop_code")


@register("s12_artifact_store", PIPELINE_SQL)
def s12_artifact_store(spark, sf):
    """X9 with its encoder, bounds and scaler saved, loaded from the latest version and applied."""
    split = PL.split_samples(P.samples(spark, sf))
    store = ArtifactStore(spark, shared_path(spark, f"artifacts-{uuid.uuid4().hex}"))
    fitted = PL.fit(split)
    store.save("crop", "v1", {k: t.limit(0) for k, t in fitted.items()})
    store.save("crop", "v2", fitted)
    out = PL.apply(split, {kind: store.load("crop", kind) for kind in fitted})
    return out.groupBy("split").agg(F.count("*").alias("n"), F.sum("crop_encoded").cast("bigint").alias("code_sum"), *[R6(F.avg(c)).alias(f"avg_{c}") for c in PIPE_FEATURES])


@register("t01_input_order", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER () AS place FROM lineitem)
SELECT row_number() OVER (ORDER BY place) AS place, l_orderkey, l_linenumber FROM l WHERE l_quantity <= 45""")
def t01_input_order(spark, sf):
    """Line items split in two, filtered, shuffled and put together again: their input order comes back from the positions."""
    li = read_positioned(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").filter("l_quantity <= 45")
    odd, even = li.filter("l_linenumber % 2 = 1").repartition("l_linenumber"), li.filter("l_linenumber % 2 = 0")
    return ranked(even.unionByName(odd), [], [F.col("position")], "place", "order").select("place", "l_orderkey", "l_linenumber")
