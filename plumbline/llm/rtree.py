"""Hard negatives by a sort-tile-recursive R-tree over integer vectors, searched best first inside score windows."""

import heapq
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.plans.staging import cut, scratch_path

# Rows of one shard of the tree, of one leaf, and children of one inner node; coordinates that a shard is tiled by.
SHARD, LEAF, FAN, TILED = 8_192, 256, 8, 3
# Boxes of a block of the directory of shards, and searching rows that meet a shard, or such a block, in one task.
BOXES, ASKING = 4_096, 16_384
# Components stay below 2**28 / sqrt(length), so that 100 times any score is a long.
ROOM = 2**28

HIT = "asker long, place int, score long, id long"


def integer_rows(rows: DataFrame, asks: Column, label: Column, key: str, vector: str, scale: int) -> DataFrame:
    """``id``, ``label``, ``dim``, ``vector`` (components times ``scale``, rounded down) and ``asks`` of the rows that take part."""
    whole = rows.select(
        F.col(f"`{key}`").cast("long").alias("id"), label.cast("string").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("vector"),
        F.coalesce(asks, F.lit(False)).alias("asks"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull())
    dim = F.size("vector")
    fine = whole.where(F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float(ROOM)) / scale / F.greatest(F.sqrt(dim), F.lit(1.0)) - 1), F.lit(False))))
    return fine.select("id", "label", dim.alias("dim"), F.transform("vector", lambda x: F.floor(x * scale).cast("int")).alias("vector"), "asks")


def tiles(points: np.ndarray, capacity: int, coordinates: list[int]) -> np.ndarray:
    """An order of the points in which runs of ``capacity`` are tiles: slabs by one coordinate, each cut by the next."""
    def order(own: np.ndarray, left: list[int]) -> np.ndarray:
        own = own[np.argsort(points[own, left[0]], kind="stable")]
        pages = ceil(len(own) / capacity)
        if len(left) == 1 or pages <= 1:
            return own
        slabs = ceil(pages ** (1 / len(left)))
        step = ceil(pages / slabs) * capacity
        return np.concatenate([order(own[i : i + step], left[1:]) for i in range(0, len(own), step)])

    return order(np.arange(len(points)), coordinates) if points.shape[1] else np.arange(len(points))


def boxes(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest of each coordinate over runs of ``size`` rows."""
    starts = np.arange(0, len(points), size)
    return np.minimum.reduceat(points, starts, axis=0), np.maximum.reduceat(points, starts, axis=0)


def intervals(asking: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each row of ``asking`` with any point of each box, coordinate by coordinate."""
    above, below = np.maximum(asking, 0), np.minimum(asking, 0)
    return above @ low.T + below @ high.T, above @ high.T + below @ low.T


def exact_kind(a: np.ndarray, b: np.ndarray):
    """The number type in which inner products of the rows of a and b are exact: double where it holds them, which is faster."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return np.float64 if most < 2**53 else np.int64


class Tree:
    """Leaves of ``LEAF`` points and nodes of ``FAN`` children, each with its box; the points come in the order of ``tiles``."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        self.ids, self.points = ids, points
        low, high = boxes(points, LEAF)
        self.levels = [(low, high)]
        while len(low) > FAN:
            starts = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, starts, axis=0), np.maximum.reduceat(high, starts, axis=0)
            self.levels.append((low, high))

    def search(self, own_id: int, asking: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """For each window (low, high): the k best (-score, id) of points whose score lies in it, without the id of the asker.

        A queue of boxes by greatest possible score; a box whose scores all lie outside every window, or strictly below
        the k-th best of each, is pruned.
        """
        kind = exact_kind(asking[None, :], self.points)
        own = asking.astype(kind)
        floors, best = [low for low, _ in windows], [[] for _ in windows]

        def wanted(least, most) -> bool:
            return any(most >= floor and least <= high for floor, (_, high) in zip(floors, windows))

        queue = []

        def push(level: int, start: int, stop: int) -> None:
            low, high = self.levels[level]
            least, most = intervals(own[None, :], low[start:stop].astype(kind), high[start:stop].astype(kind))
            for i, (a, b) in enumerate(zip(least[0].tolist(), most[0].tolist()), start):
                if wanted(a, b):
                    heapq.heappush(queue, (-b, a, level, i))

        top = len(self.levels) - 1
        push(top, 0, len(self.levels[top][0]))
        while queue:
            most, least, level, i = heapq.heappop(queue)
            if -most < min(floors):
                break
            if not wanted(least, -most):
                continue
            if level:
                push(level - 1, i * FAN, min((i + 1) * FAN, len(self.levels[level - 1][0])))
                continue
            ids = self.ids[i * LEAF : (i + 1) * LEAF]
            scores = self.points[i * LEAF : (i + 1) * LEAF].astype(kind) @ own
            for w, (_, high) in enumerate(windows):
                inside = np.flatnonzero((scores >= floors[w]) & (scores <= high) & (ids != own_id))
                if len(inside):
                    inside = inside[np.lexsort((ids[inside], -scores[inside]))[:k]]
                    best[w] = sorted([*best[w], *((-int(scores[j]), int(ids[j])) for j in inside)])[:k]
                    if len(best[w]) == k:
                        floors[w] = -best[w][-1][0]
        return best


def _packed(batches):
    """Shards of rows that come ordered by (dim, label, first coordinate, id): one row each, with its box and its tree."""
    kept, key = [], None
    out = {n: [] for n in ("dim", "label", "n", "low", "high", "ids", "points")}

    def pack():
        ids, points = np.concatenate([i for i, _ in kept]), np.concatenate([p for _, p in kept])
        spread = points.max(0).astype(np.int64) - points.min(0) if key[0] else np.zeros(0)
        order = tiles(points, LEAF, np.argsort(-spread, kind="stable")[:TILED].tolist())
        values = (*key, len(ids), points.min(0).tolist(), points.max(0).tolist(), ids[order].astype("<i8").tobytes(), points[order].astype("<i4").tobytes())
        for name, value in zip(out, values):
            out[name].append(value)
        kept.clear()

    def batch():
        ints = pa.list_(pa.int32())
        made = pa.RecordBatch.from_arrays([
            pa.array(out["dim"], pa.int32()), pa.array(out["label"], pa.string()), pa.array(out["n"], pa.int32()), pa.array(out["low"], ints),
            pa.array(out["high"], ints), pa.array(out["ids"], pa.binary()), pa.array(out["points"], pa.binary()),
        ], list(out))
        for values in out.values():
            values.clear()
        return made

    for part in batches:
        ids, dims, labels = part.column("id").to_numpy(), part.column("dim").to_numpy(), np.array(part.column("label").to_pylist(), object)
        flat = part.column("vector").flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(dims, dtype=np.int64)])
        changes = np.flatnonzero((dims[1:] != dims[:-1]) | (labels[1:] != labels[:-1])) + 1
        for start, stop in zip([0, *changes], [*changes, len(ids)]):
            if stop == start:
                continue
            here = (int(dims[start]), labels[start])
            if kept and here != key:
                pack()
            key = here
            points = flat[ends[start] : ends[stop]].reshape(stop - start, here[0])
            while start < stop:
                room = SHARD - sum(len(i) for i, _ in kept)
                take = min(room, stop - start)
                kept.append((ids[start : start + take], points[:take]))
                start, points = start + take, points[take:]
                if take == room:
                    pack()
        if out["dim"]:
            yield batch()
    if kept:
        pack()
    yield batch()


def packed_tree(rows: DataFrame, spare: int) -> tuple[DataFrame, DataFrame]:
    """The shards of the tree, one row each with all its points, and the directory: the shards without them.

    Equal rows are one. Rows with equal vectors and labels keep the ``spare`` smallest ids. Shards hold one label and one length; slabs
    along the first coordinate (ids part equal ones) are tiled by the coordinates that are most spread in them.
    """
    place = F.row_number().over(Window.partitionBy("dim", "label", "vector").orderBy("id"))
    own = rows.select("id", "dim", "label", "vector").distinct()
    points = cut(own.withColumn("place", place).where(F.col("place") <= spare).drop("place"))
    first = F.coalesce(F.try_element_at("vector", F.lit(1)), F.lit(0))
    order = [F.col("dim"), F.col("label"), first, F.col("id")]
    parts = max(ceil(points.count() / SHARD), 1)
    slabs = points.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    shards = slabs.mapInArrow(_packed, "dim int, label string, n int, low array<int>, high array<int>, ids binary, points binary")
    folder = scratch_path(rows.sparkSession, "rtree")
    shards.withColumn("shard", F.monotonically_increasing_id()).write.parquet(folder)
    trees = rows.sparkSession.read.parquet(folder)
    return trees, trees.select("shard", "dim", "label", "low", "high")


def _matrix(table: pa.Table, column: str, dim: int) -> np.ndarray:
    return table.column(column).combine_chunks().flatten().to_numpy().reshape(table.num_rows, dim).astype(np.int64)


def _routed(asked: DataFrame, directory: DataFrame, same: bool, blocks: int, pages: int, best: bool) -> DataFrame:
    """``asker``, ``shard``, ``most`` (its greatest possible score): the shards that may hold scores inside an asker's windows; ``best``: the most promising one."""
    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"asker": [], "shard": [], "most": []}
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            asking, low, high = _matrix(left, "vector", dim), _matrix(right, "low", dim), _matrix(right, "high", dim)
            kind = exact_kind(asking, np.concatenate([low, high]))
            shards, labels = right.column("shard").to_numpy(), np.array(right.column("label").to_pylist(), object)
            windows, own = left.column("windows").to_pylist(), np.array(left.column("label").to_pylist(), object)
            askers = left.column("asker").to_numpy()
            for start in range(0, len(askers), 512):
                least, most = intervals(asking[start : start + 512].astype(kind), low.astype(kind), high.astype(kind))
                for i in range(len(least)):
                    open_ = np.zeros(len(shards), bool)
                    for w in windows[start + i]:
                        open_ |= (most[i] >= w["low"]) & (least[i] <= w["high"])
                    open_ = np.flatnonzero(open_ & ((labels == own[start + i]) == same))
                    if best and len(open_):
                        open_ = open_[[np.argmax(most[i][open_])]]
                    out["asker"].append(np.full(len(open_), askers[start + i]))
                    out["shard"].append(shards[open_])
                    out["most"].append(most[i][open_].astype(np.int64))
        return pa.table([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in out.values()], list(out))

    left = asked.withColumn("block", F.pmod(F.xxhash64("asker"), F.lit(blocks))).withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
    right = directory.withColumn("page", F.pmod(F.xxhash64("shard"), F.lit(pages)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    keys = ["dim", "block", "page"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(route, "asker long, shard long, most long")
    return found.groupBy("asker").agg(F.max_by("shard", F.struct("most", "shard")).alias("shard")) if best else found.select("asker", "shard")


def _searched(pairs: DataFrame, asked: DataFrame, trees: DataFrame, k: int, blocks: int) -> DataFrame:
    """The k best hits of each asker's windows in each of its shards."""
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            dim = right.column("dim")[0].as_py()
            ids = np.frombuffer(right.column("ids")[0].as_py(), "<i8")
            tree = Tree(ids, np.frombuffer(right.column("points")[0].as_py(), "<i4").reshape(len(ids), dim).astype(np.int64))
            asking = _matrix(left, "vector", dim)
            for i, (asker, anchor, windows) in enumerate(zip(*(left.column(c).to_pylist() for c in ("asker", "anchor", "windows")))):
                for place, hits in enumerate(tree.search(anchor, asking[i], [(w["low"], w["high"]) for w in windows], k)):
                    for score, hit in hits:
                        for values, value in zip(out, (asker, place, -score, hit)):
                            values.append(value)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["asker", "place", "score", "id"])

    left = pairs.join(asked.select("asker", "anchor", "vector", "windows"), "asker").withColumn("block", F.pmod(F.xxhash64("asker"), F.lit(blocks)))
    needed = pairs.select("shard", F.pmod(F.xxhash64("asker"), F.lit(blocks)).alias("block")).distinct()
    right = trees.select("shard", "dim", "ids", "points").join(needed, "shard")
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(search, HIT)


def _best(asked: DataFrame, trees: DataFrame, directory: DataFrame, k: int, same: bool) -> DataFrame:
    """The k best rows in each window of each asker, of its own label or of others: ``asker``, ``place``, ``score``, ``id``, ``rank``.

    The most promising shard first; its k-th best raises the window's floor for the search of the other shards.
    """
    blocks, pages = max(ceil(asked.count() / ASKING), 1), max(ceil(directory.count() / BOXES), 1)
    first = cut(_routed(asked, directory, same, blocks, pages, best=True))
    hits = cut(_searched(first, asked, trees, k, blocks))
    floors = hits.groupBy("asker", "place").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    floors = floors.groupBy("asker").agg(F.map_from_entries(F.collect_list(F.struct("place", "floor"))).alias("floors"))
    raised = asked.join(floors, "asker", "left").withColumn("windows", F.transform("windows", lambda w, i: F.struct(
        F.coalesce(F.try_element_at("floors", i), w["low"]).alias("low"), w["high"].alias("high")))).drop("floors")
    raised = cut(raised)
    others = _routed(raised, directory, same, blocks, pages, best=False).join(first, ["asker", "shard"], "left_anti")
    hits = hits.unionAll(_searched(others, raised, trees, k, blocks))
    order = Window.partitionBy("asker", "place").orderBy(F.desc("score"), "id")
    return cut(hits.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k))


def hard_negatives(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
                   key: str = "vec_id", vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Components become floor(``scale`` * x); a score is the integer inner product with the anchor, higher first, ties by smaller key.
    The ``positives`` best other rows of an anchor's label are its positives; for each, the ``negatives`` best rows of other labels
    with low * positive_score <= 100 * negative_score <= high * positive_score are given, or as many as there are.

    Rows with a null key, label or vector, or with a null or non-finite component take no part, nor do those with a component of
    2**28 / ``scale`` / sqrt(length) or more, whose scores a long would not hold. Vectors of different lengths do not meet.
    Equal rows are one; other rows with equal keys are rows of their own, but none is found by an anchor with its key. Equal vectors
    of one label keep the few smallest keys that any search can return, so copies cost nothing. Anchors without positives, and
    positives without negatives, have no rows; an empty table has none.
    Columns with other names play no part.

    The tree: rows are range-partitioned into shards of one label, each packed by sort-tile-recursion; the boxes of the shards are
    the directory, which is met in blocks. All anchors meet all boxes, but only the shards whose score intervals reach into a window.
    """
    label = F.col("label") if label is None else label
    valid = cut(integer_rows(rows, anchor, label, key, vector, scale))
    trees, directory = packed_tree(valid, max(positives, negatives) + 1)
    folder = scratch_path(rows.sparkSession, "anchors")
    anchors = valid.where("asks").select(F.col("id").alias("anchor"), "dim", "label", "vector").distinct()
    anchors.withColumn("asker", F.monotonically_increasing_id()).write.parquet(folder)
    anchors = rows.sparkSession.read.parquet(folder)
    everything = F.array(F.struct(F.lit(-(2**62)).alias("low"), F.lit(2**62).alias("high")))
    found = _best(anchors.withColumn("windows", everything), trees, directory, positives, same=True)
    found = found.select("asker", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # windows of equal scores are one; integer division cuts towards zero
    least = F.expr(f"(p * {low} + CASE WHEN p * {low} > 0 THEN 99 ELSE 0 END) div 100")
    most = F.expr(f"(p * {high} - CASE WHEN p * {high} < 0 THEN 99 ELSE 0 END) div 100")
    windows = found.groupBy("asker").agg(F.collect_set("positive_score").alias("scores")).select("asker", F.explode(F.array_sort("scores")).alias("p"))
    windows = windows.withColumn("low", least).withColumn("high", most).where(F.col("low") <= F.col("high"))
    # an anchor has a window for each of its few positives
    windows = windows.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("p", "low", "high"))).alias("windows"))
    asked = cut(anchors.join(windows, "asker"))
    hits = _best(asked, trees, directory, negatives, same=False).select("asker", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = asked.select("asker", "anchor", F.posexplode("windows").alias("place", "window")).select("asker", "anchor", "place", F.col("window.p").alias("positive_score"))
    return (
        hits.join(named, ["asker", "place"]).join(found, ["asker", "positive_score"])
        .select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
