"""K-nearest-neighbour imputation (mean of the k nearest donors), exact, by best-first search of cells.

Distance is NaN-aware Euclidean over the other columns: ``d^2 = w * sum (x_j - y_j)^2`` over the coordinates
present in both rows, ``w = #columns / #shared columns``.  For each column with gaps, donors are the rows that
have it.  Ties go to the smaller id.

1. A k-d tree is fitted to a bounded hash sample of the donors (``sample_rows``): each split halves the column
   that spreads widest there, so dense regions and heavy values get many small cells.  Its leaves number about
   rows / ``leaf_rows``, at most ``max_cells``: the proven bound of what is sent to the tasks.
2. Donors are dealt to cells (columns that they lack, leaf).  Of donors at one point only the k with the smallest
   ids can count: crowded cells keep no others, which bounds the cell of a value that a third of all rows hold.
   Cells get their true bounding boxes from all donors.
3. Recipients at one point are one recipient.  In rounds of 1, 16, 64, 256, 256, ... cells each visits its next cells by
   lower bound of the distance, and keeps the k best; it is done when the next bound exceeds its k-th distance.  Only
   recipients that are not done take part in a round, and a round's state is stored, so lineage stays short.
4. A cell's donors meet its visitors in groups of about ``VISITORS``.  There the donors are halved again into boxes of at most
   ``BOX``, which each visitor sees by lower bound until the next one exceeds its k-th distance.

The tree only steers the search: any tree gives the same result.  A recipient with fewer than ``k`` donors in reach (at
least one shared column) takes those there are; without any, the column's mean; a column without values stays null.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from ..session import shared_path
from ..sources.tables import spread
from .windows import top_k_per_group

#: Visits of a cell that one task takes at a time.
VISITORS = 4096
#: Donors of a box inside a cell, and boxes that a visitor sees by step: the nearest one first, then ever more of them at once.
BOX = 64
STEPS = (1, 4, 16, 64, 256)
#: Visitors whose bounds and distances are in memory at a time.
AT_ONCE = 256
#: A cell with more than so many times ``leaf_rows`` donors keeps only the donors of a point that can count.
CROWDED = 4
#: Recipients times cells in memory at a time, while the next cells are chosen.
PAIRS = 1 << 22
ROUNDS = (1, 16, 64, 256)
#: A cell's number: the columns that its donors lack, then its leaf in so many bits.  Complete donors come first among equal bounds.
LEAF_BITS = 32


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, f"knn-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared checkpoint folder and read from there."""
    return _stored(df, name)


# --- the tree -------------------------------------------------------------------------------------
def _spread(values: np.ndarray) -> tuple[float, float]:
    return (float(np.subtract(*np.percentile(values, (90, 10)))), float(np.ptp(values))) if len(values) else (0.0, 0.0)


def _fit_tree(points: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(column, cut, child)`` of each node of a k-d tree: below the cut (and missing) goes to ``child``, the rest to
    ``child + 1``; a leaf has column -1 and its number as child."""
    column, cut, child = [-1], [0.0], [0]
    todo, n_leaves = [(-len(points), 0, points)], 1
    while todo and n_leaves < leaves:
        _, node, rows = heapq.heappop(todo)          # the fullest leaf first
        spread = [_spread(x[~np.isnan(x)]) for x in rows.T]
        for j in sorted(range(rows.shape[1]), key=lambda j: spread[j], reverse=True):
            values = rows[:, j][~np.isnan(rows[:, j])]
            if len(values) < 2 or values.min() == values.max():
                continue
            at = np.median(values)
            at = values[values > at].min() if at == values.min() else at
            low = ~(rows[:, j] >= at)
            column[node], cut[node], child[node] = j, at, len(column)
            for at, part in enumerate((rows[low], rows[~low]), len(column)):
                heapq.heappush(todo, (-len(part), at, part))
            column += [-1, -1]
            cut += [0.0, 0.0]
            child += [0, 0]
            n_leaves += 1
            break
    column, child = np.array(column), np.array(child)
    todo, number = [0], 0
    while todo:                                      # from left to right: leaves with near numbers are near each other
        node = todo.pop()
        if column[node] < 0:
            child[node] = number
            number += 1
        else:
            todo += [child[node] + 1, child[node]]
    return column, np.array(cut), child


def _leaf_of(tree, points: np.ndarray) -> np.ndarray:
    column, cut, child = tree
    at = np.zeros(len(points), np.int64)
    todo = np.flatnonzero(column[at] >= 0)
    while len(todo):
        node = at[todo]
        at[todo] = child[node] + (points[todo, column[node]] >= cut[node])
        todo = todo[column[at[todo]] >= 0]
    return child[at]


def _numbers(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(first + j).cast(pa.float64()).fill_null(np.nan)) for j in range(n)]) if batch.num_rows else np.zeros((0, n))


def _with_cells(donors: DataFrame, others: list[str], tree) -> DataFrame:
    """``donors`` with the ``cell`` of each: leaf and missing columns in one number."""
    shared, n = donors.sparkSession.sparkContext.broadcast(tree), len(others)
    source = donors.select(*others, *[c for c in donors.columns if c not in others])
    schema = StructType(list(source.schema.fields)).add("cell", LongType())

    def run(batches):
        for batch in batches:
            points = _numbers(batch, 0, n)
            lacks = np.isnan(points) @ (1 << np.arange(n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((lacks << LEAF_BITS) + _leaf_of(shared.value, points), pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)


def _thinned(placed: DataFrame, crowded: list[int], others: list[str], k: int) -> DataFrame:
    """``placed`` with at most ``k`` donors, those with the smallest ids, at each point of the ``crowded`` cells."""
    if not crowded:
        return placed
    cells = F.broadcast(placed.sparkSession.createDataFrame([(c,) for c in crowded], "cell long"))
    few = top_k_per_group(placed.join(cells, "cell", "left_semi"), others, [F.col("id")], k).drop("rank")
    return _stored(placed.join(cells, "cell", "left_anti").unionByName(few), "donors")


# --- best-first rounds ----------------------------------------------------------------------------
def _boxes(cells: list, others: list[str], columns: int, tree) -> dict:
    """The cells' boxes (missing columns have none) in groups of neighbours with a box of their own."""
    number = np.array([c["cell"] for c in cells], np.int64)
    low = np.array([[np.nan if c[f"lo_{o}"] is None else c[f"lo_{o}"] for o in others] for c in cells], float).reshape(len(cells), -1)
    high = np.array([[np.nan if c[f"hi_{o}"] is None else c[f"hi_{o}"] for o in others] for c in cells], float).reshape(len(cells), -1)
    order = np.argsort(number)   # by pattern, then leaf: neighbours stay together
    number, low, high = number[order], low[order], high[order]
    width = max(1, int(np.sqrt(len(number))))
    starts = np.arange(0, len(number), width)
    pattern = number >> LEAF_BITS
    starts = np.unique(np.concatenate([starts, np.flatnonzero(np.diff(pattern)) + 1]))  # a group has one pattern
    return {"number": number, "low": low, "high": high, "starts": np.append(starts, len(number)), "columns": columns, "tree": tree,
            "group_low": np.minimum.reduceat(low, starts, axis=0), "group_high": np.maximum.reduceat(high, starts, axis=0)}


def _bounds(points: np.ndarray, who, low: np.ndarray, high: np.ndarray, columns: int) -> np.ndarray:
    """Least squared distances of ``points[who]`` to boxes (column by column, as they broadcast); infinite without a shared column."""
    total, shared = 0.0, 0
    for j in range(points.shape[1]):
        x = points[who, j]
        off = np.maximum(np.maximum(low[..., j] - x, x - high[..., j]), 0.0)
        has = ~np.isnan(off)
        total = total + np.where(has, off * off, 0.0)
        shared = shared + has
    return np.where(shared > 0, columns / np.maximum(shared, 1) * total, np.inf)


def _cells_of(b: dict, rows: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, place)`` of every cell of each row's group."""
    size = b["starts"][groups + 1] - b["starts"][groups]
    first = np.repeat(b["starts"][groups] - (np.cumsum(size) - size), size)
    return np.repeat(rows, size), first + np.arange(size.sum())


def _next_of(points: np.ndarray, reach: np.ndarray, at_bound: np.ndarray, at_cell: np.ndarray, b: dict, most: int):
    """``(row, cell, bound, more)`` of the next ``most`` cells of each point by (bound, cell); rows without any are left out."""
    def new_cells(rows, places, far):
        d = _bounds(points, rows, b["low"][places], b["high"][places], b["columns"])
        new = np.isfinite(d) & (d <= far[rows]) & ((d > at_bound[rows]) | ((d == at_bound[rows]) & (b["number"][places] > at_cell[rows])))
        rows, places, d = rows[new], places[new], d[new]
        by = np.lexsort((b["number"][places], d, rows))
        rows, places, d = rows[by], places[by], d[by]
        return rows, places, d, np.arange(len(rows)) - np.searchsorted(rows, rows)

    far = reach * (1 + 1e-12)      # rounding of a bound must not hide a tie
    every = np.arange(len(points))
    near = _bounds(points, every[:, None], b["group_low"], b["group_high"], b["columns"])
    # no cell beyond the last of the next ``most`` of one group, that of the point's leaf, is among the next of all
    home = np.searchsorted(b["starts"][1:-1], np.searchsorted(b["number"], _leaf_of(b["tree"], points)), "right")
    rows, places, d, place = new_cells(*_cells_of(b, every, home), far)
    cut = far.copy()
    cut[rows[place == most - 1]] = d[place == most - 1]
    rows, places, d, place = new_cells(*_cells_of(b, *np.nonzero(near <= cut[:, None])), cut)
    more = (np.bincount(rows, minlength=len(points)) > most) | (cut < far)
    taken = place < most
    return rows[taken], b["number"][places[taken]], d[taken], more


def _next_cells(state: DataFrame, others: list[str], shared, most: int) -> DataFrame:
    """``(rid, others, reach, cell, at_bound, at_cell, more)``: the next ``most`` cells of each recipient by (bound, cell), within its reach, the last
    of them, and whether there may be more."""
    n = len(others)
    source = spread(state.select("rid", *others, "reach", "at_bound", "at_cell"))
    schema = (state.select("rid", *others, "reach").schema.add("cell", LongType()).add("at_bound", DoubleType()).add("at_cell", LongType())
              .add("more", BooleanType()))

    def run(batches):
        b = shared.value
        step = max(1, min(AT_ONCE, PAIRS // len(b["number"])))
        for batch in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
            reach, at_bound, at_cell = (np.asarray(batch.column(n + 1 + j)) for j in range(3))
            rows, cells, bounds, more = _next_of(_numbers(batch, 1, n), reach, at_bound, at_cell, b, most)
            last = np.searchsorted(rows, rows, "right") - 1
            if len(rows):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(j).take(at) for j in range(n + 2)] + [pa.array(c) for c in (cells, bounds[last], cells[last], more[rows])],
                                                 names=schema.names)

    return source.mapInArrow(run, schema)


class _Boxes:
    """The donors of a cell in boxes of at most ``BOX``, each a row of (columns, boxes, BOX) padded with -1 in ``donor``."""

    def __init__(self, points: np.ndarray) -> None:
        order, starts, todo = np.arange(len(points)), [], [(0, len(points))]
        while todo:
            i, j = todo.pop()
            rows = points[order[i:j]]
            if j - i > BOX:
                column = rows[:, np.argmax(np.ptp(rows, axis=0))]
                order[i:j] = order[i:j][np.argpartition(column, (j - i) // 2)]
                todo += [(i + (j - i) // 2, j), (i, i + (j - i) // 2)]
            else:
                starts.append(i)
        sizes = np.diff(np.append(starts, len(points)))
        place = np.arange(sizes.max())
        self.donor = np.where(place < sizes[:, None], order[np.minimum(np.array(starts)[:, None] + place, len(points) - 1)], -1)
        # the padding repeats a donor of the box, so that it changes no bounds
        self.points = points[np.where(self.donor < 0, self.donor[:, :1], self.donor)].transpose(2, 0, 1).copy()
        self.low, self.high = self.points.min(2), self.points.max(2)

    def nearest(self, x: np.ndarray, reach: np.ndarray, rank: np.ndarray, k: int, weight: float):
        """``(visitor, distance, donor)`` of the k donors within ``reach`` that are nearest to each row of ``x``, by (distance, rank)."""
        bound = np.zeros((len(x), len(self.donor)))
        for j in range(x.shape[1]):
            off = np.maximum(np.maximum(self.low[j] - x[:, j, None], x[:, j, None] - self.high[j]), 0.0)
            bound += off * off
        bound *= weight
        order = np.argsort(bound, axis=1)
        bound = np.take_along_axis(bound, order, 1)
        reach = reach.copy()
        visitor, distance, donor = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        at, step = 0, 0
        while at < order.shape[1]:
            to = at + STEPS[min(step, len(STEPS) - 1)]
            i, l = np.nonzero(bound[:, at:to] <= reach[:, None] * (1 + 1e-12))     # rounding of a bound must not hide a tie
            if not len(i):
                break
            box = order[i, at + l]
            total = np.zeros((len(i), self.donor.shape[1]))
            for j in range(x.shape[1]):        # in the order of the columns, as the distance is defined
                off = self.points[j][box]
                off -= x[i, j, None]
                off *= off
                total += off
            total *= weight
            p, c = np.nonzero((total <= reach[i, None]) & (self.donor[box] >= 0))
            visitor = np.concatenate([visitor, i[p]])
            distance = np.concatenate([distance, total[p, c]])
            donor = np.concatenate([donor, self.donor[box[p], c]])
            by = np.lexsort((rank[donor], distance, visitor))
            first = np.searchsorted(visitor[by], np.arange(len(x)))
            place = np.arange(len(by)) - first[visitor[by]]
            last = by[place == k - 1]
            reach[visitor[last]] = distance[last]
            by = by[place < k]
            visitor, distance, donor = visitor[by], distance[by], donor[by]
            at, step = to, step + 1
        return visitor, distance, donor


def _near(visits: DataFrame, donors: DataFrame, others: list[str], k: int, columns: int) -> DataFrame:
    """``(rid, near)``: for each visit that meets donors within reach, the k nearest ``(d, id, v)`` of the cell."""
    n = len(others)
    chunks = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("long").alias("chunks"))       # at most max_cells x patterns rows
    asked = visits.join(F.broadcast(chunks), "cell").select("cell", F.pmod(F.xxhash64("rid"), F.col("chunks")).alias("chunk"), "rid", "reach", *others)
    held = donors.join(F.broadcast(chunks), "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "id", "v", *others)
    kind = StructType([StructField("d", DoubleType()), StructField("id", donors.schema["id"].dataType), StructField("v", DoubleType())])
    schema = StructType([visits.schema["rid"], StructField("near", ArrayType(kind))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        rows, sizes, parts = [], [], []
        if left.num_rows and right.num_rows:
            x, y = (np.column_stack([np.asarray(t.column(t.num_columns - n + j).combine_chunks().cast(pa.float64()).fill_null(np.nan)) for j in range(n)]) for t in (left, right))
            reach = np.asarray(left.column(3).combine_chunks())
            rank = np.empty(len(y), np.int64)
            rank[np.asarray(pa.compute.sort_indices(right.column(2)))] = np.arange(len(y))
            has, asks = ~np.isnan(y[0]), ~np.isnan(x)               # all donors of a cell lack the same columns
            for pattern in np.unique(asks, axis=0):
                both = has & pattern
                if not both.any():
                    continue
                boxes, weight = _Boxes(y[:, both]), columns / both.sum()
                same = np.flatnonzero((asks == pattern).all(1))
                for i in range(0, len(same), AT_ONCE):
                    who = same[i:i + AT_ONCE]
                    visitor, distance, donor = boxes.nearest(x[who][:, both], reach[who], rank, k, weight)
                    count = np.bincount(visitor, minlength=len(who))
                    rows.append(who[count > 0])
                    sizes.append(count[count > 0])
                    parts.append((distance, donor))
        if not rows:
            return pa.table([pa.array([], left.schema.field(2).type), pa.array([], near_type(right))], names=["rid", "near"])
        donor = pa.array(np.concatenate([p[1] for p in parts]))
        near = pa.StructArray.from_arrays([pa.array(np.concatenate([p[0] for p in parts])), right.column(2).combine_chunks().take(donor), right.column(3).combine_chunks().take(donor)],
                                          names=["d", "id", "v"])
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return pa.table([left.column(2).combine_chunks().take(pa.array(np.concatenate(rows))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), near)], names=["rid", "near"])

    def near_type(right: pa.Table):
        return pa.list_(pa.struct([("d", pa.float64()), ("id", right.schema.field(2).type), ("v", pa.float64())]))

    return asked.groupBy("cell", "chunk").cogroup(held.groupBy("cell", "chunk")).applyInArrow(run, schema)


def _search(recipients: DataFrame, donors: DataFrame, boxes: dict, others: list[str], k: int, columns: int) -> DataFrame:
    """``(rid, best)``: the k nearest donors ``(d, id, v)`` of each recipient; ``donors`` have their ``cell``."""
    spark = recipients.sparkSession
    shared = spark.sparkContext.broadcast(boxes)
    none = F.array().cast(f"array<struct<d:double,id:{donors.schema['id'].dataType.simpleString()},v:double>>")
    state = recipients.select("rid", *others, F.lit(float("inf")).alias("reach"), F.lit(-1.0).alias("at_bound"), F.lit(-1).cast("long").alias("at_cell"), none.alias("best"))
    finished, step = [], 0
    while True:
        visits = _stored(_next_cells(state, others, shared, ROUNDS[min(step, len(ROUNDS) - 1)]), "visits")
        if visits.isEmpty():
            break
        found = _near(visits, donors, others, k, columns).groupBy("rid").agg(F.flatten(F.collect_list("near")).alias("near"))   # at most ``most`` cells
        ends = visits.groupBy("rid").agg(F.max(F.struct("at_bound", "at_cell")).alias("end"), F.max("more").alias("more"))
        best = F.slice(F.array_sort(F.concat("best", F.coalesce("near", none))), 1, k)
        met = state.drop("at_bound", "at_cell", "reach").join(ends, "rid", "left").join(found, "rid", "left").withColumn("best", best)
        reach = F.when(F.size("best") >= k, F.element_at("best", -1)["d"]).otherwise(F.lit(float("inf")))
        met = _stored(met.select("rid", *others, reach.alias("reach"), F.col("end.at_bound").alias("at_bound"), F.col("end.at_cell").alias("at_cell"), "best",
                                 F.coalesce("more", F.lit(False)).alias("more")), "state")
        finished.append(met.filter("not more").select("rid", "best"))
        state = met.filter("more").drop("more")
        step += 1
    out = state.select("rid", "best")
    for part in finished:
        out = out.union(part)
    return out


def _impute_column(base: DataFrame, c: str, others: list[str], k: int, donors_n: int, leaf_rows: int, max_cells: int, sample_rows: int) -> DataFrame:
    """``(key, value)``: the value for each different point ``key`` of the rows that lack ``c``."""
    columns = len(others) + 1
    donors = base.filter(F.col(c).isNotNull()).select(F.col("id"), F.col(c).alias("v"), *others)
    million = 1_000_000
    keep = max(1, min(million, -(-million * sample_rows // max(donors_n, 1))))
    sample = donors.filter(F.pmod(F.xxhash64(F.lit(c), "id"), F.lit(million)) < keep).select(*others).toPandas().to_numpy(dtype=float)
    tree = _fit_tree(sample, min(max_cells, max(1, donors_n // leaf_rows))) if len(sample) else (np.array([-1]), np.zeros(1), np.zeros(1, np.int64))
    placed = _stored(_with_cells(donors, others, tree), "donors")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(o).alias(f"{p}_{o}") for o in others for f, p in ((F.min, "lo"), (F.max, "hi"))]).collect()
    placed = _thinned(placed, [c["cell"] for c in cells if c["n"] > CROWDED * leaf_rows], others, k)
    lacking = base.filter(F.col(c).isNull())
    recipients = _stored(lacking.groupBy(*others).agg(F.min("id").alias("rid")), "recipients")
    best = _search(recipients, placed, _boxes(cells, others, columns, tree), others, k, columns) if cells else recipients.select("rid", F.lit(None).cast("array<struct<v:double>>").alias("best"))
    mean = donors.agg(F.avg("v")).first()[0]
    value = F.when(F.size("best") > 0, F.aggregate("best", F.lit(0.0), lambda s, y: s + y["v"]) / F.size("best")).otherwise(F.lit(mean).cast("double"))
    return recipients.join(best, "rid").select(F.struct(*others).alias("key"), value.alias("value"))


def knn_impute(df: DataFrame, id_col: str, cols, k: int = 5, leaf_rows: int = 8192, max_cells: int = 1 << 17, sample_rows: int = 200_000) -> DataFrame:
    """``df`` with the gaps (null or NaN) of ``cols`` filled with the mean of the ``k`` nearest donors; ids are unique."""
    cols = list(cols)
    present = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    base = _stored(df.select(F.col(id_col).alias("id"), *[present(c).alias(c) for c in cols]), "base")
    have = base.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in cols]).first()
    found = None
    for c in cols:
        if have[c] == have["n"]:
            continue
        others = [o for o in cols if o != c]
        values = _impute_column(base, c, others, k, have[c], leaf_rows, max_cells, sample_rows)
        one = base.filter(F.col(c).isNull()).select("id", F.struct(*others).alias("key")).join(values, "key").select(
            "id", *[(F.col("value") if o == c else F.lit(None).cast("double")).alias(f"new_{o}") for o in cols])
        found = one if found is None else found.union(one)
    rest = [F.col(c) for c in df.columns if c not in (id_col, *cols)]
    kept = df.filter(F.col(id_col).isNotNull())
    if found is None:
        return kept.select(id_col, *rest, *[present(c).alias(c) for c in cols])
    # only rows with gaps are joined: the others keep what they have
    found = found.groupBy(F.col("id").alias("found_id")).agg(*[F.max(f"new_{c}").alias(f"new_{c}") for c in cols])
    return kept.join(found, F.col(id_col) == F.col("found_id"), "left").select(
        id_col, *rest, *[F.coalesce(present(c), F.col(f"new_{c}")).alias(c) for c in cols])
