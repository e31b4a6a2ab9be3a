"""Random forests of features with few bins, grown from sums over bins instead of rows.

A tree sees a row only through the bins of its features, at most 32 each. Where all combinations of bins (cells) are few, the
rows are read once: every row draws how often each tree holds it, and each cell sums count, label and squared label for each tree.
Trees are then grown from the cells, with the splits, impurities, limits and pruning of Spark's forests, and become a Spark model.
"""

from math import prod

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from ..plans.staging import scratch_path

# Rows from which cells are summed; fewer are given to Spark's own trees.
LEAST_ROWS = 200_000
# Cells times trees whose sums a task and the driver hold; more are left to Spark's own trees.
HELD_SUMS = 2_000_000
# Draws that a task holds at a time, and tree nodes times bins that are grown at a time.
DRAWN, GROWN = 1 << 20, 1 << 21
NODE = pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()),
    ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()),
    ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])),
])


def thresholds(values: np.ndarray, bins: int) -> np.ndarray:
    """Where a feature is split: between its values if they are few, otherwise at about equal counts; as in Spark's trees."""
    kinds, counts = np.unique(values, return_counts=True)
    between = (kinds[:-1] + kinds[1:]) / 2
    if len(between) <= bins - 1:
        return between
    stride, found = len(values) / bins, []
    current, target = counts[0], stride
    for i in range(1, len(kinds)):
        previous, current = current, current + counts[i]
        if abs(previous - target) < abs(current - target):
            found.append(between[i - 1])
            target += stride
    return np.array(found)


def _binned(batch: pa.RecordBatch, splits: list[np.ndarray]) -> np.ndarray:
    """The cell of each row."""
    values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(splits))
    cell = np.zeros(batch.num_rows, np.int64)
    for f, at in enumerate(splits):
        cell = cell * (len(at) + 1) + np.searchsorted(at, values[:, f], side="left")
    return cell


def _class_sums(rows: DataFrame, splits: list[np.ndarray], trees: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their counts by tree and class. The draws of n equal rows add up to one draw with mean n."""
    def count(batches):
        for batch in batches:
            pairs = np.stack([_binned(batch, splits), batch.column("y").to_numpy().astype(np.int64)])
            kinds, n = np.unique(pairs, axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds[0]), pa.array(kinds[1]), pa.array(n.astype(np.int64))], ["cell", "label", "n"])

    counted = rows.mapInArrow(count, "cell long, label long, n long").groupBy("cell", "label").agg(F.sum("n").alias("n")).orderBy("cell", "label").collect()
    cells, at = np.unique([r["cell"] for r in counted], return_inverse=True)
    sums = np.zeros((trees, len(cells), max(2, 1 + max(r["label"] for r in counted))))
    for r, i in zip(counted, at):
        sums[:, i, r["label"]] = rng.poisson(r["n"], trees)
    return cells, sums


def _value_sums(rows: DataFrame, splits: list[np.ndarray], trees: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and by tree their draws, sum of labels and sum of squared labels."""
    def emit(cells, sums):
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array([s.tobytes() for s in sums], pa.binary())], ["cell", "sums"])

    def draw(batches):
        rng = np.random.Generator(np.random.SFC64([abs(seed), TaskContext.get().partitionId()]))
        total = np.zeros((prod(len(s) + 1 for s in splits), 3, trees))
        step = max(1, DRAWN // trees)
        for batch in batches:
            every, labels = _binned(batch, splits), batch.column("y").to_numpy()
            order = np.argsort(every, kind="stable")
            every, labels = every[order], labels[order]
            for start in range(0, len(every), step):
                cell, y = every[start : start + step], labels[start : start + step, None]
                times = rng.poisson(1.0, (len(cell), trees)).astype(float)
                edges = np.r_[0, np.flatnonzero(np.diff(cell)) + 1, len(cell)]
                for a, b in zip(edges[:-1], edges[1:]):
                    total[cell[a]] += np.concatenate([np.ones((1, b - a)), y[a:b].T, np.square(y[a:b]).T]) @ times[a:b]
        held = np.flatnonzero(total[:, 0].any(axis=1))
        yield emit(held, total[held])

    def add(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, sums in zip(batch.column("cell").to_pylist(), batch.column("sums")):
                part = np.frombuffer(sums.as_buffer()).reshape(3, trees)
                found[cell] = found[cell] + part if cell in found else part
        yield emit(np.array(list(found), np.int64), list(found.values()))

    kind = "cell long, sums binary"
    found = rows.mapInArrow(draw, kind).repartition(8, "cell").mapInArrow(add, kind).collect()
    found.sort(key=lambda r: r["cell"])
    sums = np.stack([np.frombuffer(r["sums"]).reshape(3, trees) for r in found])
    return np.array([r["cell"] for r in found]), np.ascontiguousarray(sums.transpose(2, 0, 1))


def _impurity(sums: np.ndarray, classes: bool) -> np.ndarray:
    """Gini impurity of class counts, or the variance of (count, sum, sum of squares), along the last axis."""
    n = sums.sum(-1) if classes else sums[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        if classes:
            return np.where(n > 0, 1 - np.square(sums).sum(-1) / (n * n), 0.0)
        return np.where(n > 0, (sums[..., 2] - sums[..., 1] * sums[..., 1] / n) / n, 0.0)


def _grown(sums: np.ndarray, bins: np.ndarray, widths: list[int], depth: int, least: int, subset: int, classes: bool, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Nodes of trees over (tree, cell) sums, by rising depth: tree, sums, gain, feature, split, left, right (-1 in leaves)."""
    weigh = lambda s: s.sum(-1) if classes else s[..., 0]
    tree, cell = np.nonzero(weigh(sums) > 0)
    values, bins = sums[tree, cell], bins[cell]
    owner, trees = np.unique(tree, return_inverse=True)
    kinds = values.shape[1]
    add = lambda at, size: np.stack([np.bincount(at, values[:, s], size) for s in range(kinds)], -1)
    at, totals, made = trees, add(trees, len(owner)), 0
    out = {n: [] for n in ("tree", "sums", "gain", "feature", "split", "left", "right")}
    closed = np.zeros(len(owner), bool)
    for level in range(depth + 1):
        n = len(totals)
        best, feature, split = np.full(n, -np.inf), np.full(n, -1), np.full(n, -1)
        left = np.zeros((n, kinds))
        if level < depth and len(at):
            impurity, size = _impurity(totals, classes), weigh(totals)
            chosen = np.argsort(rng.random((n, len(widths))), axis=1)[:, :subset] if subset < len(widths) else None
            for f, width in enumerate(widths):
                if width < 2:
                    continue
                low = add(at * width + bins[:, f], n * width).reshape(n, width, kinds).cumsum(1)[:, :-1]
                high = totals[:, None] - low
                a, b = weigh(low), weigh(high)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = impurity[:, None] - (a * _impurity(low, classes) + b * _impurity(high, classes)) / size[:, None]
                gain[(a < least) | (b < least) | closed[:, None]] = -np.inf
                if chosen is not None:
                    gain[~(chosen == f).any(axis=1)] = -np.inf
                place = gain.argmax(1)
                top = gain[np.arange(n), place]
                better = top > best
                best[better], feature[better], split[better] = top[better], f, place[better]
                left[better] = low[better, place[better]]
        inner = best > 0
        children = made + n + 2 * (np.cumsum(inner) - 1)
        for name, value in (("tree", owner), ("sums", totals), ("gain", np.where(inner, best, -1.0)), ("feature", np.where(inner, feature, -1)), ("split", split), ("left", np.where(inner, children, -1)), ("right", np.where(inner, children + 1, -1))):
            out[name].append(value)
        if not inner.any():
            break
        keep = inner[at]
        at, values, bins = at[keep], values[keep], bins[keep]
        beyond = bins[np.arange(len(at)), feature[at]] > split[at]
        at = children[at] - made - n + beyond
        made += n
        totals = np.stack([left[inner], totals[inner] - left[inner]], 1).reshape(-1, kinds)
        owner = np.repeat(owner[inner], 2)
        closed = np.abs(_impurity(totals, classes)) < np.finfo(float).eps
    return {name: np.concatenate(parts) for name, parts in out.items()}


def _nodes(grown: dict[str, np.ndarray], splits: list[np.ndarray], classes: bool, first: int) -> pa.Table:
    """The rows of a saved Spark forest; two leaves of one prediction become one, as in Spark."""
    sums, left, right = grown["sums"], grown["left"].copy(), grown["right"].copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        guess = sums.argmax(1).astype(float) if classes else np.where(sums[:, 0] > 0, sums[:, 1] / sums[:, 0], 0.0)
    gone = np.zeros(len(left), bool)
    for i in range(len(left) - 1, -1, -1):
        a, b = left[i], right[i]
        if a >= 0 and left[a] < 0 and left[b] < 0 and guess[a] == guess[b]:
            gone[[a, b]] = True
            left[i] = right[i] = -1
    order = np.flatnonzero(~gone)
    order = order[np.argsort(grown["tree"][order], kind="stable")]
    trees = grown["tree"][order]
    starts = np.searchsorted(trees, trees, side="left")
    name = np.full(len(left) + 1, -1)
    name[order] = np.arange(len(order)) - starts
    inner = left[order] >= 0
    impurity, size = _impurity(sums, classes), sums.sum(1) if classes else sums[:, 0]
    nodes = [
        {"id": int(name[i]), "prediction": float(guess[i]), "impurity": float(impurity[i]), "impurityStats": sums[i].tolist(), "rawCount": int(size[i]),
         "gain": float(grown["gain"][i]) if is_inner else -1.0, "leftChild": int(name[left[i]]), "rightChild": int(name[right[i]]),
         "split": {"featureIndex": int(grown["feature"][i]), "leftCategoriesOrThreshold": [float(splits[grown["feature"][i]][grown["split"][i]])], "numCategories": -1}
         if is_inner else {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
        for i, is_inner in zip(order, inner)
    ]
    return pa.table({"treeID": pa.array((trees + first).astype(np.int32)), "nodeData": pa.array(nodes, NODE)})


class _ByCells:
    """A Spark forest model that scores each cell once; rows look up the scores of their cell, since no tree splits inside one."""

    splits: list[np.ndarray] = []

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sizes = [len(s) + 1 for s in self.splits]
        inside = [[*map(float, s), float("inf")] for s in self.splits]
        cells = [(cell, Vectors.dense([inside[f][i] for f, i in enumerate(at)])) for cell, at in enumerate(np.ndindex(*sizes))]
        features = self.getFeaturesCol()
        table = super()._transform(dataset.sparkSession.createDataFrame(cells, ["_cell", features]).withColumn("_cell", F.col("_cell").cast("long"))).drop(features)
        cell = F.lit(0).cast("long")
        for f, at in enumerate(self.splits):
            beyond = F.lit(0)
            for t in at:
                beyond = beyond + (F.get("_x", F.lit(f)) > F.lit(float(t))).cast("int")
            cell = cell * (len(at) + 1) + beyond
        placed = dataset.withColumn("_x", vector_to_array(F.col(features))).withColumn("_cell", cell).drop("_x")
        return placed.join(F.broadcast(table), "_cell", "left").drop("_cell")


class CellClassifier(_ByCells, RandomForestClassificationModel):
    pass


class CellRegressor(_ByCells, RandomForestRegressionModel):
    pass


class _FromCells:
    """A Spark forest that is grown from cells where they are few and the rows many."""

    def _fit(self, dataset: DataFrame):
        found = self._from_cells(dataset)
        return super()._fit(dataset) if found is None else self._copyValues(found)

    def _from_cells(self, dataset: DataFrame):
        classes = isinstance(self, RandomForestClassifier)
        trees, seed = self.getNumTrees(), self.getSeed()
        plain = trees > 1 and self.getBootstrap() and self.getSubsamplingRate() == 1.0 and not self.isDefined("weightCol")
        plain = plain and self.getMinInfoGain() == 0 and self.getMinWeightFractionPerNode() == 0 and self.getImpurity() in ("gini", "variance")
        subsets = {"all": lambda n: n, "sqrt": lambda n: int(np.ceil(np.sqrt(n))), "log2": lambda n: max(1, int(np.ceil(np.log2(n)))), "onethird": lambda n: int(np.ceil(n / 3)), "auto": lambda n: int(np.ceil(np.sqrt(n))) if classes else int(np.ceil(n / 3))}
        if not plain or self.getFeatureSubsetStrategy() not in subsets or (n := dataset.count()) < LEAST_ROWS:
            return None
        label, spark = F.col(self.getLabelCol()).cast("double").alias("y"), dataset.sparkSession
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), label)
        width = len(rows.first()["x"])
        most = self.getMaxBins()
        if width > np.log2(HELD_SUMS):
            return None
        wanted = max(most * most, 10_000)
        sample = np.array([r["x"] for r in rows.select("x").sample(False, min(1.0, 1.1 * wanted / n), seed).collect()])
        splits = [thresholds(sample[:, f], most) for f in range(width)]
        sizes = [len(s) + 1 for s in splits]
        if prod(sizes) * trees > HELD_SUMS:
            return None
        rng = np.random.default_rng(abs(seed))
        cells, sums = _class_sums(rows, splits, trees, rng) if classes else _value_sums(rows, splits, trees, seed)
        bins = np.stack(np.unravel_index(cells, sizes), 1)
        parts, step = [], max(1, GROWN // (len(cells) * max(sizes) * sums.shape[2]))
        for start in range(0, trees, step):
            grown = _grown(sums[start : start + step], bins, sizes, self.getMaxDepth(), self.getMinInstancesPerNode(), subsets[self.getFeatureSubsetStrategy()](width), classes, rng)
            parts.append(_nodes(grown, splits, classes, start))
        # Spark's own forest of a few made-up rows, saved, gives everything but the nodes.
        kinds = sums.shape[2]
        made_up = spark.createDataFrame(
            [(float(i % kinds if classes else i), Vectors.dense([float(i)] * width)) for i in range(3 * kinds)], [self.getLabelCol(), self.getFeaturesCol()]
        )
        folder = scratch_path(spark, "forest")
        super()._fit(made_up).save(folder)
        spark.createDataFrame(pa.concat_tables(parts)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/data")
        loaded = (RandomForestClassificationModel if classes else RandomForestRegressionModel).load(folder)
        # a model of its own: the loaded one is detached from the driver's JVM when Python forgets it
        model = (CellClassifier if classes else CellRegressor)(loaded._java_obj.copy(loaded._empty_java_param_map()))
        model.splits = splits
        return model


class ForestClassifier(_FromCells, RandomForestClassifier):
    pass


class ForestRegressor(_FromCells, RandomForestRegressor):
    pass
