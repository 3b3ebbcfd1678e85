"""Splitting, encoding and scaling.

Exact stratified split without a per-class window: every row gets a hash rank key
``h = first 13 hex digits of md5(id#seed)`` (an integer below 2**52).  Within a
class of ``n`` rows the split is ``train`` for the ``floor(70 n / 100)`` smallest keys,
``val`` up to ``floor(85 n / 100)``, ``test`` for the rest - the same as ranking the
class by ``md5`` order.  The two cut values per class are found with the distributed
rank locator (``values_at_ranks``) and applied as a broadcast lookup of
``(class, cut1, cut2)`` - a table with one row per class.  No task sees a whole class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import knowledge as K
from .quantiles import exact_quantiles, values_at_ranks

BROADCAST_ROWS = 1_000_000   # dimension tables up to this many rows are broadcast


def hash_key(id_col: str, seed: int = K.SEED) -> Column:
    """Deterministic rank key in [0, 2**52): the leading 13 hex digits of md5(id#seed)."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 13),
                  16, 10).cast("long")


def _cuts(n: int, shares) -> list[int]:
    """Cumulative cut ranks for integer percentage shares, e.g. (70, 15, 15) -> [70n//100, 85n//100]."""
    pct = [int(round(s * 100)) for s in shares]
    out, acc = [], 0
    for p in pct[:-1]:
        acc += p
        out.append(n * acc // 100)
    return out


def _lookup(df: DataFrame, small: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a lookup table; broadcast it when its row count is within ``BROADCAST_ROWS``."""
    n = small.count()
    return df.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on=on, how=how)


def stratified_split(df: DataFrame, target: str | None, id_col: str, shares=K.SPLIT_SHARES, seed: int = K.SEED,
                     names=("train", "val", "test"), out: str = "split") -> DataFrame:
    """Add a ``split`` column (exact per-class proportions in hash order).

    Falls back to one global ordering when the target is absent, single-valued or has
    fewer than 10 labelled rows.
    """
    keyed = df.withColumn("_h", hash_key(id_col, seed))
    ranks = lambda n: [c for c in _cuts(n, shares) if c < n]
    stratify = False
    if target and target in df.columns:
        found, counts = values_at_ranks(keyed, "_h", [target], ranks)     # a hash is never null: every row counts
        labelled = [n for (label,), n in counts.items() if label is not None]
        stratify = len(labelled) > 1 and sum(labelled) >= 10
    if not stratify:
        found, counts = values_at_ranks(keyed, "_h", [], ranks)
    rows = []
    for g, n in counts.items():
        cuts = [found.get((g, c)) if c < n else None for c in _cuts(n, shares)]
        rows.append(tuple(g) + tuple(float(c) if c is not None else None for c in cuts))
    cut_names = [f"_c{i}" for i in range(len(shares) - 1)]
    if stratify:
        dtype = dict(df.dtypes)[target]
        cuts_df = df.sparkSession.createDataFrame(rows, f"`{target}` {dtype}, " + ", ".join(f"{c} double" for c in cut_names))
        keyed = _lookup(keyed, cuts_df, [target])
    else:
        for c, v in zip(cut_names, rows[0] if rows else [None] * len(cut_names)):
            keyed = keyed.withColumn(c, F.lit(v).cast("double"))
    label = F.lit(names[-1])
    for c, nm in reversed(list(zip(cut_names, names))):
        label = F.when(F.col(c).isNull() | (F.col("_h").cast("double") < F.col(c)), F.lit(nm)).otherwise(label)
    # rows whose target is null get no cut values and land in the first split
    return keyed.withColumn(out, label).drop("_h", *cut_names)


def stratified_folds(df: DataFrame, target: str, id_col: str, k: int = 5, seed: int = K.SEED,
                     out: str = "fold") -> DataFrame:
    """fold = floor(rank * k / n) within the class, in hash order (balanced, stratified)."""
    keyed = df.withColumn("_h", hash_key(id_col, seed))

    def starts(n):
        return [(f * n + k - 1) // k for f in range(1, k) if (f * n + k - 1) // k < n]

    found, counts = values_at_ranks(keyed, "_h", [target], starts)
    rows = []
    for g, n in counts.items():
        cuts = [(f * n + k - 1) // k for f in range(1, k)]
        rows.append(tuple(g) + (sorted(float(found[(g, c)]) for c in cuts if c < n),))
    dtype = dict(df.dtypes)[target]
    cuts_df = df.sparkSession.createDataFrame(rows, f"`{target}` {dtype}, _starts array<double>")
    j = _lookup(keyed, cuts_df, [target])
    fold = F.size(F.filter("_starts", lambda s: F.col("_h").cast("double") >= s))
    return j.withColumn(out, fold.cast("int")).drop("_h", "_starts")


def label_mapping(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """code = rank of the label among the sorted distinct labels (0-based).

    The ``dense_rank`` runs on the distinct labels only (one row per label).
    """
    labels = df.select(F.col(col).cast("string").alias(col)).filter(F.col(col).isNotNull()).distinct()
    return labels.withColumn(out, (F.dense_rank().over(Window.orderBy(col)) - 1).cast("int"))


def encode_labels(df: DataFrame, col: str, mapping: DataFrame, out: str | None = None, code_col: str = "code",
                  unknown: int = -1) -> DataFrame:
    """F8: map labels to codes with a lookup join; unseen labels get ``unknown`` (-1)."""
    out = out or f"{col}_encoded"
    m = mapping.select(F.col(col).alias("_lbl"), F.col(code_col).alias(out))
    j = _lookup(df.withColumn("_lbl", F.col(col).cast("string")), m, ["_lbl"])
    return j.withColumn(out, F.coalesce(F.col(out), F.lit(unknown))).drop("_lbl")


def region_code(df: DataFrame, out: str = "region_code") -> DataFrame:
    """categorical code of ``region`` (else ``state``); nulls encode as the text 'nan'."""
    src = "region" if "region" in df.columns else ("state" if "state" in df.columns else None)
    if src is None:
        return df
    txt = F.coalesce(F.col(src).cast("string"), F.lit("nan"))
    keyed = df.withColumn("_rc", txt)
    mapping = label_mapping(keyed, "_rc", out)
    return _lookup(keyed, mapping, ["_rc"]).drop("_rc")


def minmax_params(train: DataFrame, cols) -> dict[str, tuple[float, float]]:
    """F9 fit: per-column (min, max) on the training rows."""
    row = train.agg(*[F.struct(F.min(c).cast("double"), F.max(c).cast("double")).alias(f"c{i}")
                      for i, c in enumerate(cols)]).collect()[0]
    return {c: (row[f"c{i}"][0], row[f"c{i}"][1]) for i, c in enumerate(cols)}


def minmax_apply(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """F9 apply: (x - min) / (max - min); a zero range divides by 1 (constant -> 0)."""
    cols = {}
    for c, (lo, hi) in params.items():
        if lo is None:
            continue
        rng = hi - lo
        cols[c] = (F.col(c) - F.lit(lo)) / F.lit(rng if rng != 0 else 1.0)
    return df.withColumns(cols)


def qcut(df: DataFrame, col: str, q: int = 3, out: str | None = None) -> DataFrame:
    """Equal-frequency bins (right-closed, first bin includes the minimum)."""
    out = out or f"{col}_bin"
    probs = [i / q for i in range(1, q)]
    qs = exact_quantiles(df, [col], probs)
    edges = [qs[((), col, p)] for p in probs]
    expr = F.lit(q - 1)
    for i in reversed(range(q - 1)):
        expr = F.when(F.col(col) <= F.lit(float(edges[i])), F.lit(i)).otherwise(expr)
    return df.withColumn(out, F.when(F.col(col).isNull(), None).otherwise(expr))


def reference_sample(df: DataFrame, id_col: str, n: int = 300, seed: int = K.SEED) -> DataFrame:
    """Up to ``n`` rows without replacement, in hash order (a distributed top-n)."""
    return df.withColumn("_h", hash_key(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h")
