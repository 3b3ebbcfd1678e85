"""The skew-tolerant helpers against brute force on small data."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from terroir.operators import registry as RG
from terroir.operators import timeops as TO
from terroir.operators.quantiles import exact_quantiles, values_at_ranks
from terroir.operators.windows import bounded_history, prefix_sum, top_k_per_group


def _frame(spark, n=3000, seed=7):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.35, 0, rng.integers(1, 6, n))   # one hot key with a third of the rows
    ts = rng.integers(0, 10 * 86_400_000_000, n)
    v = np.round(rng.normal(50, 20, n), 3)
    v[rng.random(n) < 0.3] = 42.0                                      # a heavily repeated value
    rows = [(int(k), int(t), int(i), float(x)) for i, (k, t, x) in enumerate(zip(key, ts, v))]
    return spark.createDataFrame(rows, "k long, ts long, id long, v double"), key, ts, v


def test_exact_quantiles_match_numpy(spark):
    df, _, _, v = _frame(spark)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = exact_quantiles(df, ["v"], probs)
    for q in probs:
        assert abs(got[((), "v", q)] - float(np.quantile(v, q))) < 1e-9


def test_grouped_quantiles(spark):
    df, key, _, v = _frame(spark)
    got = exact_quantiles(df, ["v"], [0.5], group_cols=["k"])
    for k in set(key.tolist()):
        assert abs(got[((k,), "v", 0.5)] - float(np.quantile(v[key == k], 0.5))) < 1e-9


def test_quantiles_with_infinities(spark):
    v = [float("-inf"), 1.0, 2.0, 2.0, 5.0, float("inf"), float("inf")]
    df = spark.createDataFrame([(x,) for x in v + [None, float("nan")]], "v double")
    got = exact_quantiles(df, ["v"], [0.0, 0.25, 0.5, 0.7, 1.0])
    assert [got[((), "v", q)] for q in (0.0, 0.5, 1.0)] == [v[0], 2.0, v[-1]]
    assert got[((), "v", 0.25)] == 1.5 and got[((), "v", 0.7)] == float("inf")
    only = exact_quantiles(df.filter("v = double('inf')"), ["v"], [0.5])
    assert only[((), "v", 0.5)] == float("inf")


def test_asof_matches_brute_force_in_one_cell(spark):
    rng = np.random.default_rng(3)
    half = TO.TTL_US
    obs = [(i, int(t), 8.0, 76.0, float(i)) for i, t in enumerate(rng.integers(0, 6 * half, 60))]
    obs += [(100, obs[0][1], 8.0, 76.0, 1.0), (101, None, 8.0, 76.0, 1.0), (102, 5, None, 76.0, 1.0)]
    req = [(i, int(t), 8.0, 76.0) for i, t in enumerate(rng.integers(0, 8 * half, 400))]
    req += [(400, obs[0][1], 8.0, 76.0), (401, None, 8.0, 76.0), (402, 5, None, 76.0), (403, 5, 9.0, 76.0)]
    o = spark.createDataFrame(obs, "obs_id long, ts_us long, lat double, lon double, temperature double").selectExpr(
        "*", "0D AS humidity", "0D AS rainfall", "0D AS wind_speed", "0D AS precip_7d")
    r = spark.createDataFrame(req, "req_id long, ts_us long, lat double, lon double")
    got = {x["req_id"]: x["obs"] and x["obs"]["obs_id"] for x in TO.asof_weather(r, o).collect()}
    assert len(got) == len(req)
    for rid, t, lat, _ in req:
        seen = [(ot, oid) for oid, ot, olat, _, _ in obs if None not in (t, ot, lat, olat) and olat == lat and t - half <= ot <= t]
        assert got[rid] == (max(seen)[1] if seen else None), rid


def test_registry_keeps_order_and_first_maximum(spark, tmp_path):
    def entry(name, acc):
        return {"model_name": name, "task": "crop", "training_timestamp": "2024-01-01", "metrics": {"test_accuracy": acc}}

    reg = RG.read_json(spark, str(tmp_path / "absent"))
    assert reg.count() == 0
    reg = RG.merge_new(reg, RG.entries(spark, [entry("z", 0.9), entry("m", 0.5)]))
    RG.write_json(reg, str(tmp_path / "reg"))
    reg = RG.merge_new(RG.read_json(spark, str(tmp_path / "reg")), RG.entries(spark, [entry("z", 0.1), entry("a", 0.9)]))
    assert [(r["model_name"], r["position"]) for r in reg.orderBy("position").collect()] == [("z", 0), ("m", 1), ("a", 3)]
    assert RG.best_model(reg, "crop").first()["model_name"] == "z"
    assert RG.best_model(reg, "crop", "m").first()["model_name"] == "m"
    assert {r["model_name"]: r["rank"] for r in RG.benchmark_table(reg).collect()} == {"z": 1, "a": 2, "m": 3}


def test_values_at_ranks(spark):
    df, _, _, v = _frame(spark)
    found, counts = values_at_ranks(df, "v", [], lambda n: [0, n // 3, n - 1])
    s = np.sort(v)
    n = len(v)
    assert counts[()] == n
    assert found[((), n // 3)] == s[n // 3] and found[((), 0)] == s[0]


def test_bounded_history_matches_window(spark):
    df, _, _, _ = _frame(spark)
    chunk = F.floor(F.col("ts") / F.lit(86_400_000_000))
    h = bounded_history(df, ["k"], ["ts", "id"], ["v"], 10, chunk)
    got = {r["id"]: [e["id"] for e in r["history"]] for r in h.select("id", "history").collect()}
    w = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(-9, 0)
    ref = {r["id"]: r["ids"] for r in df.select("id", F.collect_list("id").over(w).alias("ids")).collect()}
    assert got == ref


def test_top_k_matches_window(spark):
    df, _, _, _ = _frame(spark)
    got = {(r["k"], r["rank"], r["id"]) for r in top_k_per_group(df, ["k"], [F.col("v"), F.col("id")], 5).collect()}
    w = Window.partitionBy("k").orderBy("v", "id")
    ref = {(r["k"], r["rank"], r["id"]) for r in
           df.withColumn("rank", F.row_number().over(w)).filter("rank <= 5").collect()}
    assert got == ref


def test_prefix_sum(spark):
    df, _, _, _ = _frame(spark)
    g = df.groupBy("k", "id").agg(F.sum("v").alias("v"))
    got = prefix_sum(g, ["k"], "id", "v", (F.col("id") / 100).cast("int"))
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    ref = g.withColumn("ref", F.coalesce(F.sum("v").over(w), F.lit(0.0)))
    j = got.join(ref, ["k", "id"])
    assert j.filter(F.abs(F.col("prefix") - F.col("ref")) > 1e-6).count() == 0


def _brute_force_impute(rows, cols, k=5):
    out = {r[0]: list(r[1:]) for r in rows}
    for j in range(1, cols + 1):
        donors = [r for r in rows if r[j] is not None]
        for x in rows:
            if x[j] is not None:
                continue
            near = []
            for y in donors:
                shared = [(u - v) ** 2 for i, (u, v) in enumerate(zip(x[1:], y[1:]), 1) if i != j and u is not None and v is not None]
                if shared:
                    near.append((cols / len(shared) * sum(shared), y[0], y[j]))
            best = sorted(near)[:k]
            out[x[0]][j - 1] = sum(b[2] for b in best) / len(best) if best else (sum(d[j] for d in donors) / len(donors) if donors else None)
    return out


def _check_impute(spark, rows, cols, **how):
    from terroir.operators.impute import knn_impute
    names = [f"c{j}" for j in range(cols)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))
    got = {r["id"]: [r[n] for n in names] for r in knn_impute(df, "id", names, **how).collect()}
    want = _brute_force_impute(rows, cols, how.get("k", 5))
    assert set(got) == set(want)
    for i, w in want.items():
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got[i], w)), (i, got[i], w)


def test_knn_impute_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    gap = lambda x, p: None if rng.random() < p else float(x)
    rows = [(i, gap(rng.integers(0, 50), 0.1), gap(rng.integers(0, 9), 0.1), gap(np.round(rng.normal(10, 3), 2), 0.15)) for i in range(400)]
    rows += [(900, None, None, None), (901, None, None, 3.0)]
    _check_impute(spark, rows, 3, leaf_rows=6, sample_rows=200)   # the tree knows half of the rows


def test_knn_impute_with_a_hot_point_and_few_donors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 1.0, 2.0, float(i % 7)) for i in range(700)]                                       # one point holds a third of all donors
    rows += [(1000 + i, float(rng.normal(0, 30)), float(rng.normal(0, 1)), float(i)) for i in range(300)]
    rows += [(2000 + i, 1.0 if i % 2 else float(rng.normal(0, 30)), 2.0, None) for i in range(40)]   # equal recipients too
    _check_impute(spark, rows, 3, leaf_rows=8)
    _check_impute(spark, [(1, 0.0, 5.0), (2, 1.0, 7.0), (3, 4.0, None), (4, None, None)], 2)
    _check_impute(spark, [(1, 0.0, None), (2, 1.0, None)], 2)


def test_knn_impute_meets_few_large_cells(spark, monkeypatch):
    """Ties at many points, a cell of many boxes, more visitors than a task takes: a recipient meets one cell, not one per 64 donors."""
    from terroir.operators import impute
    rng = np.random.default_rng(9)
    rows = [(i, None if i < 60 else float(i % 97), *(float(x) for x in rng.integers(0, 12, 4))) for i in range(5000)]
    visits, stored = [], impute._stored

    def counted(df, name):
        out = stored(df, name)
        if name == "visits":
            visits.append(out.count())
        return out

    monkeypatch.setattr(impute, "_stored", counted)
    monkeypatch.setattr(impute, "VISITORS", 25, raising=False)
    _check_impute(spark, rows, 5)
    assert sum(visits) == 60


def test_scans_match_windows(spark):
    from terroir.operators.scan import last_rows, ranked, running
    df, _, _, _ = _frame(spark)
    df = df.unionByName(spark.createDataFrame([(None, 5, 9001, 1.0), (None, 4, 9002, 2.0), (7, None, 9003, 3.0)], df.schema))
    for keys in (["k"], []):
        r = ranked(df, keys, [F.col("ts"), F.col("id")])
        got = last_rows(r, keys, "rank", 10, {"ids": F.collect_list("id"), "mean": F.avg("v")}, rows_per_chunk=64)
        w = Window.partitionBy(*keys).orderBy("ts", "id")
        ref = df.select("id", F.row_number().over(w).alias("rank"), F.collect_list("id").over(w.rowsBetween(-9, 0)).alias("ids"))
        assert {x["id"]: (x["rank"], x["ids"]) for x in got.collect()} == {x["id"]: (x["rank"], x["ids"]) for x in ref.collect()}
    sums = running(df, ["k"], [F.col("ts"), F.col("id")], {"n": F.lit(1), "s": F.col("id")})
    w = Window.partitionBy("k").orderBy("ts", "id")
    ref = df.select("id", F.sum("id").over(w).alias("s"))
    assert {x["id"]: x["s"] for x in sums.collect()} == {x["id"]: x["s"] for x in ref.collect()}
    assert ranked(df.limit(0), [], [F.col("id")]).count() == 0


def test_history_of_one_busy_field(spark):
    """All rows on one field within one minute: many blocks and chunks, none with more than its share."""
    from terroir.operators import scan
    n = 40_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(n).select(F.lit(1).alias("field_id"), F.pmod(F.xxhash64("id"), F.lit(60_000_000)).alias("ts_us"), F.col("id").alias("event_id"), F.lit(1.0).alias("v"))
    r = scan.ranked(df, ["field_id"], [F.col("ts_us"), F.col("event_id")])
    blocks = [x["count"] for x in scan.ordered_blocks(df, [F.col("field_id"), F.col("ts_us"), F.col("event_id")]).groupBy("_block").count().collect()]
    assert len(blocks) == 8 and max(blocks) < 2 * n / 8
    assert r.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()[:] == (1, n, n)
    h = scan.last_rows(r, ["field_id"], "rank", 100, {"ids": F.collect_list("event_id")}, rows_per_chunk=1000)
    order = [x["event_id"] for x in df.orderBy("ts_us", "event_id").collect()]
    got = {x["event_id"]: x["ids"] for x in h.collect()}
    assert all(got[e] == order[max(0, i - 99):i + 1] for i, e in enumerate(order[:300]))
    assert got[order[-1]] == order[-100:]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_auc_of_crowded_scores(spark):
    """99 % of the scores lie within 1e-6 of 1: the blocks keep equal numbers of rows, and the AUC is exact."""
    from terroir.operators import evaluate, scan
    rng = np.random.default_rng(2)
    score = np.where(rng.random(20_000) < 0.99, 1 - rng.random(20_000) * 1e-6, rng.random(20_000))
    positive = rng.random(20_000) < 0.3 + 0.4 * (score > 1 - 5e-7)
    df = spark.createDataFrame([("a", float(s), bool(p)) for s, p in zip(score, positive)], "cls string, score double, positive boolean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [x["count"] for x in scan.ordered_blocks(df, [F.col("cls"), F.col("score")]).groupBy("_block").count().collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 8 and max(sizes) <= 2 * min(sizes)
    rank = np.empty(len(score))
    rank[np.argsort(score)] = np.arange(1, len(score) + 1)
    p, n = positive.sum(), (~positive).sum()
    assert abs(evaluate.roc_auc_ovr(df).first()["auc"] - (rank[positive].sum() - p * (p + 1) / 2) / (p * n)) < 1e-9
