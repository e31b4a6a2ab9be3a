"""Similarity join of documents on word n-grams: MinHash candidates, Bayesian pruning, exact verification."""

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from plumbline.llm.components import components
from plumbline.llm.text import Words, mixed, positional, sums_between, text_slices
from plumbline.plans.staging import scratch_path

SHINGLE, THRESHOLD = 5, 0.8
# Bands of MinHash values that make two documents candidates: of a pair at 0.8, three in a million share none.
BANDS, BAND = 32, 5
# MinHash values compared at a time, and the posterior chance of reaching the threshold below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-7
# Documents of one bucket or cluster, and shingles of one cluster, that meet in a task; larger ones are dealt in blocks.
BUCKET, CELL = 2_048, 300_000
# Rows of a product of incidence matrices, and numbers of such a matrix, held at a time.
STRIPE, HELD = 256, 1 << 23

_random = np.random.default_rng(99)
FACTORS = _random.integers(0, 2**63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _random.integers(0, 2**63, BANDS * BAND, dtype=np.uint64)


def fewest_matches(threshold: float, tolerance: float = TOLERANCE, step: int = STEP, total: int = BANDS * BAND) -> list[tuple[int, int]]:
    """After n compared values, the matches below which a pair is dropped.

    With a flat prior the similarity given m matches of n is Beta(m + 1, n - m + 1), and the chance that it is
    at least t is that of at most m successes in n + 1 trials of probability t.
    """
    out = []
    for n in range(step, total + 1, step):
        chance = m = 0
        while True:
            chance += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in rising order, all in one run, and where each text's begin.

    A text of fewer words than a shingle has one shingle, all its words.
    """
    words = Words(column)
    hashes = words.hashes()
    starts, grams = words.windows(hashes, size)
    doc = words.doc[starts]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        whole = np.array([_whole(hashes[words.first[d] : words.first[d + 1]]) for d in short], np.uint64)
        doc, grams = np.concatenate([doc, short]), np.concatenate([grams, whole])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(len(words.counts) + 1))


def _whole(hashes: np.ndarray) -> np.uint64:
    value = np.uint64(len(hashes))
    with np.errstate(over="ignore"):
        for h in hashes:
            value = mixed(np.array([value * np.uint64(31) + h], np.uint64))[0]
    return value


def signatures(grams: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of each set that is not empty."""
    out = np.empty((len(firsts) - 1, BANDS * BAND), np.uint32)
    if len(out):
        for i, (factor, term) in enumerate(zip(FACTORS, TERMS)):
            out[:, i] = np.minimum.reduceat(((grams * factor + term) >> np.uint64(32)).astype(np.uint32), firsts[:-1])
    return out


def similarity_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """``docs`` with ``class_id``, ``n_links``, ``n_shingles`` and ``is_kept``.

    Two documents are linked if the Jaccard similarity of their sets of ``size``-word shingles is at least
    ``threshold``. ``n_links`` counts the documents linked to a row, copies included; ``class_id`` is the smallest
    key among the documents that links connect; ``is_kept`` marks the row that stands for its class (all rows
    that are equal to it in key and text).

    Texts with equal sets are one node from the start, so copies cost nothing more. MinHash bands give
    candidates; in a bucket, MinHash values are compared 32 at a time, and a pair is dropped when the posterior
    probability of reaching the threshold falls below ``TOLERANCE``. Surviving pairs make clusters, inside
    which every similarity is computed exactly from whole texts. Buckets and clusters of any size are dealt in
    blocks and as pairs of blocks; tasks return counts and spanning links, never pairs.

    A null key, and a text without a word, is linked to nothing: the class is the row's own key, 0 links, and
    it is kept. Rows with equal keys are documents of their own. Columns of ``docs`` with the name of an added
    one are replaced.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    rest = docs.drop("class_id", "n_links", "n_shingles", "is_kept")
    names, added = rest.columns, ["class_id", "n_links", "n_shingles", "is_kept"]
    rest, (key, text) = positional(rest, key, text)
    body = rest.select(F.col(key).alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("row"))
    body = body.where(F.col("doc").isNotNull() & F.col("text").isNotNull())

    def sign(batches):
        for batch in text_slices(batches):
            grams, firsts = shingle_sets(batch.column("text"), size)
            full = np.flatnonzero(np.diff(firsts) > 0)
            firsts = np.append(firsts[full], len(grams))
            values = signatures(grams, firsts)
            one = sums_between(mixed(grams).view(np.int64), firsts[:-1], firsts[1:])
            two = sums_between(mixed(grams ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64), firsts[:-1], firsts[1:])
            bands = np.full((len(full), BANDS), 1, np.uint64) * np.arange(1, BANDS + 1, dtype=np.uint64)
            for i in range(BAND):
                bands = mixed(bands * np.uint64(0x9E3779B97F4A7C15) + values[:, i::BAND])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
            at = pa.array(full)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc").take(at), batch.column("row").take(at), pa.array(one), pa.array(two), pa.array(np.diff(firsts)), bands,
                pa.array([v.tobytes() for v in values.astype(np.uint8)], pa.binary()),
            ], ["doc", "row", "set1", "set2", "n", "bands", "values"])

    long, binary = T.LongType(), T.BinaryType()
    schema = T.StructType([T.StructField("doc", kind), *(T.StructField(c, long) for c in ("row", "set1", "set2", "n")), T.StructField("bands", T.ArrayType(long)), T.StructField("values", binary)])
    folder = scratch_path(spark, "signatures")
    body.mapInArrow(sign, schema).write.parquet(folder)
    signed = spark.read.parquet(folder)

    nodes = signed.groupBy("set1", "set2").agg(F.min(F.struct("doc", "row")).alias("low"), F.count("*").alias("copies"), F.max("n").alias("n"))
    folder = scratch_path(spark, "nodes")
    nodes.withColumn("node", F.monotonically_increasing_id()).write.parquet(folder)
    nodes = spark.read.parquet(folder)

    # candidates: buckets of more than one node
    chosen = nodes.select("node", "copies", "n", F.col("low.doc").alias("doc"), F.col("low.row").alias("row"), "set1", "set2")
    signed_nodes = chosen.join(signed.dropDuplicates(["set1", "set2"]).select("set1", "set2", "bands", "values"), ["set1", "set2"])
    folder = scratch_path(spark, "sketches")
    signed_nodes.select("node", "bands", "values").write.parquet(folder)
    sketches = spark.read.parquet(folder)
    places = sketches.select("node", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    met = places.join(shared, "bucket").join(sketches.select("node", "values"), "node")
    fewest = fewest_matches(threshold)
    cells = _blocks(met, F.ceil(F.col("size") / BUCKET)).select("bucket", "one", "two", "own", "node", "values")
    cells = cells.repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two")
    links = cells.mapInArrow(lambda b: _survivors(b, fewest), "a long, b long")
    clusters = components(links.distinct())

    # exact similarity inside the clusters
    clusters = clusters.select("node", F.col("root").alias("cluster"))
    clusters = clusters.union(clusters.select(F.col("cluster").alias("node"), "cluster").distinct())
    inside = clusters.join(chosen.select("node", "copies", "n", "doc", "row"), "node")
    weights = inside.groupBy("cluster").agg(F.sum("n").alias("shingles"), F.count("*").alias("nodes"))
    inside = inside.join(weights, "cluster")
    texts = body.join(inside, ["doc", "row"]).select("node", "cluster", "copies", "shingles", "nodes", "text")
    cells = _blocks(texts, F.greatest(F.ceil(F.col("shingles") / CELL), F.ceil(F.col("nodes") / BUCKET))).select("cluster", "one", "two", "own", "node", "copies", "text")
    cells = cells.repartition("cluster", "one", "two").sortWithinPartitions("cluster", "one", "two")
    folder = scratch_path(spark, "links")
    cells.mapInArrow(lambda b: _verified(b, threshold, size), "node long, root long, links long").write.parquet(folder)
    linked = spark.read.parquet(folder)
    roots = components(linked.where(F.col("node") != F.col("root")).select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    placed = (
        nodes.join(roots, "node", "left").join(counts, "node", "left")
        .select("set1", "set2", "low", "copies", "n", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    classes = placed.groupBy("root").agg(F.min("low").alias("first"))
    placed = placed.join(classes, "root").select("set1", "set2", "first", F.col("n").alias("n_shingles"), (F.col("links") + F.col("copies") - 1).alias("n_links"))
    members = signed.select("doc", "row", "set1", "set2").distinct().join(placed, ["set1", "set2"]).select("doc", "row", "first", "n_shingles", "n_links")
    out = rest.join(members, (F.col(key) == F.col("doc")) & (F.xxhash64(F.col(text)) == F.col("row")), "left")
    own = (F.col("first.doc") == F.col("doc")) & (F.col("first.row") == F.col("row"))
    return out.select(
        *rest.columns, F.coalesce(F.col("first.doc"), F.col(key)).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), F.coalesce(own, F.lit(True)).alias("is_kept"),
    ).toDF(*names, *added)


def _blocks(rows: DataFrame, blocks) -> DataFrame:
    """Each row in its own block, once for every pair of blocks (``one`` <= ``two``) that this one is in."""
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    return rows.withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("one", F.least("own", "mate")).withColumn("two", F.greatest("own", "mate"))


def _groups(batches, keys: int):
    """Runs of rows with equal first columns, as lists of tuples; the batches come ordered by them."""
    group = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if group and group[-1][:keys] != row[:keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


class _Forest:
    """Union-find over places; the root is the smallest place."""

    def __init__(self, size: int):
        self.up = list(range(size))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        self.up[max(a, b)] = min(a, b)


def _survivors(batches, fewest: list[tuple[int, int]]):
    """Spanning links (a, b) of the pairs of each cell whose MinHash values do not rule them out."""
    a, b = [], []
    for group in _groups(batches, 3):
        if len(group) > 1:
            group.sort(key=lambda r: r[4])
            one, two = group[0][1:3]
            node = [r[4] for r in group]
            if len(group) == 2 and one == two:  # most cells
                pair = np.frombuffer(group[0][5], np.uint8) == np.frombuffer(group[1][5], np.uint8)
                sums = np.cumsum(pair)
                if all(sums[n - 1] >= m for n, m in fewest):
                    a.append(node[0])
                    b.append(node[1])
                continue
            values = np.frombuffer(b"".join(r[5] for r in group), np.uint8).reshape(len(group), -1)
            own = np.array([r[3] for r in group])
            forest, root = _Forest(len(group)), np.arange(len(group))
            for i in range(len(group) - 1):
                others = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & ((own[i + 1 :] != own[i]) | (one == two)))
                done, matches = 0, np.zeros(len(others), np.int64)
                for n, least in fewest:
                    matches += (values[others, done:n] == values[i, done:n]).sum(1)
                    left = matches >= least
                    others, matches, done = others[left], matches[left], n
                    if not len(others):
                        break
                for j in others.tolist():
                    if forest.find(i) != forest.find(j):
                        forest.join(i, j)
                        a.append(node[i])
                        b.append(node[j])
                if len(others):
                    root = np.array([forest.find(k) for k in range(len(group))])
        if len(a) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
    if a:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def common_shingles(grams: np.ndarray, firsts: np.ndarray):
    """Row by row, in stripes: the first row, and the number of shingles that each set of the stripe shares with every set.

    Products of incidence matrices, a stretch of the stripe's shingles at a time.
    """
    size = len(firsts) - 1
    row = np.repeat(np.arange(size), np.diff(firsts))
    _, column, count = np.unique(grams, return_inverse=True, return_counts=True)
    keep = count[column] > 1
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    by_column, ends = row[order], np.concatenate([[0], np.cumsum(np.where(count > 1, count, 0))])
    wide = max(HELD // max(size, 1), 64)
    for start in range(0, size, STRIPE):
        stop = min(start + STRIPE, size)
        low, high = np.searchsorted(row, [start, stop])
        own = np.unique(column[low:high])
        out = np.zeros((stop - start, size), np.float64)
        for first in range(0, len(own), wide):
            some = own[first : first + wide]
            times = ends[some + 1] - ends[some]
            spots = np.repeat(ends[some] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            part = np.zeros((size, len(some)), np.float32)
            part[by_column[spots], np.repeat(np.arange(len(some)), times)] = 1
            out += part[start:stop] @ part.T
        yield start, out


def _verified(batches, threshold: float, size: int):
    """For each node of a cell with links: the smallest node it is connected to there, and its linked documents."""
    out = {"node": [], "root": [], "links": []}
    for group in _groups(batches, 3):
        group = sorted({r[4]: r for r in group}.values(), key=lambda r: r[4])
        if len(group) > 1:
            node, copies = [r[4] for r in group], np.array([r[5] for r in group])
            grams, firsts = shingle_sets(pa.array([r[6] for r in group], pa.large_string()), size)
            sizes, root, links = np.diff(firsts), np.arange(len(group)), np.zeros(len(group), np.int64)
            own = None if group[0][1] == group[0][2] else np.array([r[3] for r in group])
            for start, shared in common_shingles(grams, firsts):
                rows = np.arange(start, start + len(shared))
                linked = shared >= threshold * (sizes[rows][:, None] + sizes[None, :] - shared) - 1e-9
                linked[rows - start, rows] = False
                if own is not None:
                    linked &= own[rows][:, None] != own[None, :]
                links[rows] = linked @ copies
                for i in rows[linked.any(1)].tolist():
                    met = np.unique(root[linked[i - start]])
                    met = met[met != root[i]]
                    if len(met):
                        met = np.append(met, root[i])
                        root[np.isin(root, met)] = met.min()
            for i in np.flatnonzero(links).tolist():
                for name, value in zip(out, (node[i], node[root[i]], int(links[i]))):
                    out[name].append(value)
        if len(out["node"]) > 20_000:
            yield pa.RecordBatch.from_pydict(out, pa.schema([(c, pa.int64()) for c in out]))
            out = {c: [] for c in out}
    if out["node"]:
        yield pa.RecordBatch.from_pydict(out, pa.schema([(c, pa.int64()) for c in out]))
