"""Exact quantiles (linear interpolation, like ``percentile`` / pandas / ``quantile_cont``).

Spark's exact ``percentile`` keeps a value->count map per group and merges all of it
in one task: a global quantile over a continuous column at scale does not fit.  Here
the answer is found by histogram refinement instead:

1. one aggregation gives ``count/min/max`` per (group, column);
2. each target rank is located in a value interval ``(L, H]``; every pass splits the
   live intervals into ``BUCKETS`` equal-width buckets and counts rows per bucket with
   one distributed ``groupBy`` (output: targets x buckets rows);
3. the bucket holding the rank becomes the new interval.  A bucket whose min equals
   its max settles the rank at once (so a value shared by a third of all rows costs
   nothing); otherwise its min and max bound the next interval.

Infinities are the first and last ranks and take no part in the intervals.  The driver only sees per-bucket counts - never the data.  Each pass narrows by about
``BUCKETS``x, so 10^12 rows take 4-5 passes.  ``method='approx'`` uses
``percentile_approx`` instead (one pass, bounded error).
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path

BUCKETS = 1024


def _stored(df: DataFrame) -> DataFrame:
    """``df`` in the shared folder: the passes read the values, not the plan that makes them."""
    path = shared_path(df.sparkSession, f"quantiles-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _stats(long: DataFrame, keys):
    """Per key: rows, rows at either infinity, and the range of the finite values."""
    v = F.col("v")
    finite = F.when(F.abs(v) < math.inf, v)
    return long.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(v == -math.inf).alias("below"), F.count_if(v == math.inf).alias("above"),
                                   F.min(finite).alias("lo"), F.max(finite).alias("hi")).collect()


def _long_form(df: DataFrame, cols, group_cols) -> DataFrame:
    items = [F.struct(F.lit(i).alias("cid"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)]
    out = df.select(*[F.col(g) for g in group_cols], F.explode(F.array(*items)).alias("_kv"))
    out = out.select(*group_cols, F.col("_kv.cid").alias("cid"), F.col("_kv.v").alias("v"))
    return out.filter(F.col("v").isNotNull() & ~F.isnan("v"))


def _locate(long: DataFrame, keys, stats, wanted):
    """Find the values at the requested 0-based ranks: ``{(key, rank): value}``.

    ``long`` has columns ``keys + ["v"]``; ``stats`` are the rows of ``_stats``.
    """
    targets = {}
    found = {}
    for r in stats:
        key = tuple(r[k] for k in keys)
        n, lo, hi = r["n"], r["lo"], r["hi"]
        for rk in wanted.get(key, ()):
            if rk < r["below"]:
                found[(key, rk)] = -math.inf
            elif rk >= n - r["above"]:
                found[(key, rk)] = math.inf
            elif lo == hi or rk == r["below"]:
                found[(key, rk)] = lo
            elif rk == n - r["above"] - 1:
                found[(key, rk)] = hi
            else:
                targets[len(targets)] = {"key": key, "rank": rk, "L": math.nextafter(lo, -math.inf), "H": hi, "below": r["below"]}

    spark = long.sparkSession
    while targets:
        tdf = spark.createDataFrame(
            [t["key"] + (tid, t["L"], t["H"]) for tid, t in targets.items()],
            [*keys, "tid", "L", "H"])
        joined = long.join(F.broadcast(tdf), on=keys).filter((F.col("v") > F.col("L")) & (F.col("v") <= F.col("H")))
        w = (F.col("H") - F.col("L")) / F.lit(float(BUCKETS))
        b0 = F.least(F.greatest(F.floor((F.col("v") - F.col("L")) / w), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")

        def bound(j):
            return F.when(j >= BUCKETS, F.col("H")).otherwise(F.col("L") + j.cast("double") * w)

        b = (b0 - F.when(F.col("v") <= bound(b0), 1).otherwise(0) + F.when(F.col("v") > bound(b0 + 1), 1).otherwise(0))
        b = F.least(F.greatest(b, F.lit(0)), F.lit(BUCKETS - 1))
        hist = (joined.select("tid", b.alias("b"), "v").groupBy("tid", "b")
                .agg(F.count("*").alias("c"), F.min("v").alias("mn"), F.max("v").alias("mx")).collect())
        per = defaultdict(list)
        for r in hist:
            per[r["tid"]].append((r["b"], r["c"], r["mn"], r["mx"]))
        nxt = {}
        for tid, t in targets.items():
            acc = t["below"]
            for _, c, mn, mx in sorted(per[tid]):
                if acc + c > t["rank"]:
                    if mn == mx:
                        found[(t["key"], t["rank"])] = mn
                    else:
                        nxt[len(nxt)] = {"key": t["key"], "rank": t["rank"], "L": math.nextafter(mn, -math.inf), "H": mx, "below": acc}
                    break
                acc += c
        targets = nxt
    return found


def values_at_ranks(df: DataFrame, value_col: str, group_cols, ranks_of_count):
    """``{(group_tuple, rank): value}`` for the ranks ``ranks_of_count(n)`` of each group.

    Ranks are 0-based in ascending order of ``value_col`` (cast to double; values up to
    2**53 are exact).  Used for exact stratified splits without a per-class window.
    """
    group_cols = list(group_cols)
    long = _stored(df.select(*group_cols, F.col(value_col).cast("double").alias("v")).filter(F.col("v").isNotNull()))
    stats = _stats(long, group_cols)
    wanted = {tuple(r[k] for k in group_cols): set(ranks_of_count(r["n"])) for r in stats}
    counts = {tuple(r[k] for k in group_cols): r["n"] for r in stats}
    if not group_cols:
        long = long.withColumn("_g", F.lit(0))
        stats = [r.asDict() | {"_g": 0} for r in stats]
        wanted = {(0,): v for v in wanted.values()}
        found = _locate(long, ["_g"], stats, wanted)
        return {((), rk): v for ((_, ), rk), v in found.items()}, {(): n for n in counts.values()}
    return _locate(long, group_cols, stats, wanted), counts


def exact_quantiles(df: DataFrame, cols, probs, group_cols=(), method: str = "exact"):
    """Return ``{(group_tuple, column, prob): value}`` (None for empty groups)."""
    cols, probs, group_cols = list(cols), list(probs), list(group_cols)
    if method == "approx":
        aggs = [F.percentile_approx(c, probs, 100000).alias(f"q{i}") for i, c in enumerate(cols)]
        res = {}
        rows = (df.groupBy(*group_cols).agg(*aggs) if group_cols else df.agg(*aggs)).collect()
        for r in rows:
            g = tuple(r[x] for x in group_cols)
            for i, c in enumerate(cols):
                vals = r[f"q{i}"] or [None] * len(probs)
                for q, v in zip(probs, vals):
                    res[(g, c, q)] = v
        return res

    long = _long_form(_stored(df.select(*dict.fromkeys([*group_cols, *cols]))), cols, group_cols)
    keys = group_cols + ["cid"]
    stats = _stats(long, keys)
    wanted = {}
    for r in stats:
        n = r["n"]
        ranks = set()
        for q in probs:
            h = (n - 1) * q
            r0 = int(math.floor(h))
            ranks.add(r0)
            if h > r0 and r0 + 1 < n:
                ranks.add(r0 + 1)
        wanted[tuple(r[k] for k in keys)] = ranks
    found = _locate(long, keys, stats, wanted)
    out = {}
    for r in stats:
        key = tuple(r[k] for k in keys)
        n = r["n"]
        for q in probs:
            h = (n - 1) * q
            r0 = int(math.floor(h))
            v0 = found[(key, r0)]
            if h > r0 and r0 + 1 < n:
                v1 = found[(key, r0 + 1)]
                v = v0 if v0 == v1 else v0 + (h - r0) * (v1 - v0)
            else:
                v = v0
            out[(key[:-1], cols[key[-1]], q)] = v
    return out


def quantile_frame(df: DataFrame, cols, probs, group_cols=(), method: str = "exact",
                   names=None) -> DataFrame:
    """Quantiles as a DataFrame: one row per (group, column), one column per prob."""
    res = exact_quantiles(df, cols, probs, group_cols, method)
    names = names or [f"q{int(round(q * 100)):02d}" for q in probs]
    groups = sorted({k[0] for k in res}, key=lambda g: tuple((x is None, x) for x in g))
    rows = []
    for g in groups:
        for c in cols:
            if (g, c, probs[0]) in res:
                rows.append(tuple(g) + (c,) + tuple(float(res[(g, c, q)]) for q in probs))
    schema = ", ".join([f"`{gc}` {dict(df.dtypes)[gc]}" for gc in group_cols] + ["column string"]
                       + [f"{n} double" for n in names])
    return df.sparkSession.createDataFrame(rows, schema)
