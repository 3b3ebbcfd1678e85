"""Ordered scans without a task for each key: ranks, running sums and bounded histories.

Rows are dealt by range over (keys, order) into blocks of about equal numbers of rows and stored in the
shared folder, so that a lost executor or a second read sees the same blocks.  A key that runs over
several blocks (or all rows, without keys) is scanned block by block; the carry into a block is the sum of
the key's earlier blocks.  A block continues at most one key of the block before, so the carries are at most
one row for each block, which is the proven bound of their broadcast.

Rows that are equal in keys and order cannot be parted by range; where they may be many, ``order`` ends with
a column that tells them apart.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path


def ordered_blocks(df: DataFrame, order: list[Column], name: str = "blocks", block: str = "_block") -> DataFrame:
    """``df`` stored in range blocks of ``order``; ``block`` numbers them in that order."""
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.repartitionByRange(*order).withColumn(block, F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], name: str = "running") -> DataFrame:
    """``df`` with the running sum (the row included) of each expression of ``sums`` within the row's keys.

    Null keys are a key.  ``df`` must not have columns that begin with ``_block`` or ``_carry``.  No rows give
    no rows.
    """
    stored = ordered_blocks(df, [*[F.col(k) for k in keys], *order], name)
    carried = {out: f"_carry{i}" for i, out in enumerate(sums)}
    per_block = stored.groupBy("_block", *keys).agg(*[F.sum(v).alias(carried[out]) for out, v in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_block.select(F.col("_block").alias("_block_"), *[F.col(k).alias(f"_block_{k}") for k in keys],
                             *[F.sum(c).over(before).alias(c) for c in carried.values()],
                             F.count(F.lit(1)).over(before).alias("_carry")).filter("_carry > 0")
    here = Window.partitionBy("_block", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = stored.withColumns({out: F.sum(v).over(here) for out, v in sums.items()})
    same = F.col("_block") == F.col("_block_")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_block_{k}"))
    joined = local.join(F.broadcast(carry), same, "left")  # at most a row for each block
    return joined.select(*df.columns, *[(F.col(out) + F.coalesce(F.col(c), F.lit(0))).alias(out) for out, c in carried.items()])


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank", name: str = "ranked") -> DataFrame:
    """``df`` with ``out``, 1, 2, ... by ``order`` within the row's keys."""
    return running(df, keys, order, {out: F.lit(1).cast("long")}, name)


def last_rows(ranked_rows: DataFrame, keys: list[str], rank: str, n: int, outputs: dict[str, Column],
              rows_per_chunk: int = 8192) -> DataFrame:
    """``ranked_rows`` with window expressions over the last ``n`` rows of the row's keys, itself included.

    ``rank`` counts 1, 2, ... within the keys.  A chunk is ``rows_per_chunk`` successive ranks of a key, and the
    last ``n - 1`` rows of a chunk also go to the next one, so that every frame lies within a chunk: no task
    holds more of a key than a chunk, whatever its share of the rows, and there is no carry to wait for.
    ``outputs`` maps names to aggregate expressions.
    """
    size = max(rows_per_chunk, n)
    chunk = F.floor((F.col(rank) - 1) / size).cast("long")
    ahead = F.floor((F.col(rank) - 1 + (n - 1)) / size).cast("long")
    spread = (ranked_rows.withColumn("_home", chunk)
              .withColumn("_chunk", F.explode(F.when(ahead > chunk, F.array(chunk, ahead)).otherwise(F.array(chunk)))))
    frame = Window.partitionBy(*keys, "_chunk").orderBy(rank).rowsBetween(-(n - 1), 0)
    wide = spread.withColumns({name: agg.over(frame) for name, agg in outputs.items()})
    return wide.filter("_chunk = _home").drop("_chunk", "_home")
