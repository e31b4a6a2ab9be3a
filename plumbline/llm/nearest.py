"""Nearest vectors by multi-index hashing: learned binary codes, pigeonhole probing, exact distances."""

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.plans.staging import cut

# Vectors that the rotation and the radius are learned from; every vector is indexed.
SAMPLE, TRIALS, REACHED = 4_096, 256, 0.95
# Pairs of the sample whose distances belong together when the radius for a distance is learned, at least.
GROUP = 512
# A code has so many substrings of eight bits, each with a table of its own.
TABLES, WIDTH = 8, 8
# Most vectors, or queries, of one table entry that a task compares at a time; fuller entries are split.
BLOCK = 4_096
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass
class Coder:
    """Rotation to binary codes, the Hamming radius that searches begin with, and (distance, radius): vectors beyond that distance may need the radius."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int
    needed: list[tuple[float, int]]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return np.packbits((vectors - self.mean) @ self.turn > 0, axis=1)


def reach_of(radius: int) -> list[int]:
    """Bits that may differ in each substring: codes within the radius agree that well in one at least; -1 where no probe is needed."""
    whole, more = divmod(radius, TABLES)
    if whole >= WIDTH:  # the first table has everything
        return [WIDTH] + [-1] * (TABLES - 1)
    return [whole if t <= more else whole - 1 for t in range(TABLES)]


def learn(sample: np.ndarray, k: int, seed: int = 7) -> Coder:
    """Principal directions turned so that their signs lose least (iterative quantisation).

    The radius holds at least ``REACHED`` of the ``k`` nearest vectors of trial queries in the sample; in the
    whole table the nearest are nearer. For queries whose nearest are further away than that, pairs of the sample are sorted by distance and
    dealt into groups, each twice as large as all before it; ``needed`` has the radius that holds ``REACHED`` of every group up to a distance.
    """
    random, bits = np.random.default_rng(seed), TABLES * WIDTH
    mean = sample.mean(0)
    centred = sample - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:bits].T
    flat = centred @ axes
    turn = np.linalg.qr(random.normal(size=(bits, bits)))[0][: flat.shape[1]]
    for _ in range(30):
        u, _, v = np.linalg.svd(flat.T @ np.sign(flat @ turn), full_matrices=False)
        turn = u @ v
    coder = Coder(mean, axes @ turn, 0, [])
    codes, needed, pairs = coder.codes(sample), [], [(np.zeros(0), np.zeros(0, int))]
    for i in range(0, len(sample), max(len(sample) // TRIALS, 1)):
        away = ((sample - sample[i]) ** 2).sum(1)
        away[i] = np.inf
        near = np.argsort(away, kind="stable")[: len(sample) - 1]
        differ = ONES[codes[near] ^ codes[i]].sum(1)
        needed.extend(differ[:k])
        pairs.append((np.sqrt(away[near]), differ))
    coder.radius = int(np.quantile(needed, REACHED, method="higher")) if needed else bits
    away, differ = (np.concatenate(x) for x in zip(*pairs))
    order, start, most = np.argsort(away, kind="stable"), 0, 0
    while start < len(order):
        group = order[start : max(2 * start, GROUP)]
        radius = int(np.quantile(differ[group], REACHED, method="higher"))
        if radius > most:
            coder.needed.append((float(away[group[0]]) if start else -1.0, radius))
            most = radius
        start += len(group)
    return coder


def nearest(rows: DataFrame, query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """The ``k`` nearest found of each row for which ``query`` holds: ``query_id``, ``rank``, ``<key>``, ``score``.

    Nearness is the Euclidean distance of the original vectors in double precision, ties go to the smaller
    key, and a query does not find itself. Vectors that are null, zero, of another length than most, or hold
    null or non-finite components take no part, nor do rows with a null key. Equal vectors are one class and
    are searched once, whatever their number; each class keeps its k + 1 smallest keys.

    Codes of 64 bits come from a rotation learned on ``sample`` vectors. Each of their eight bytes has a
    table. A query probes every table entry that differs in so few bits that, by the pigeonhole principle, it
    meets every code within a Hamming radius; a code is looked at in the first table that gives it away. What
    lies within the radius is ranked by its floats. The first radius is the learned one; queries that meet fewer
    than ``k`` other rows there, or than there are, or whose k-th hit is so far away that nearer vectors may lie beyond the radius, go
    through rounds with a radius wider by a bit per table, up to all bits, until none is short. Entries of more than 4,096 vectors or queries are split into blocks. The
    index holds each distinct vector eight times, once per table.
    """
    shape = rows.schema[vector].dataType
    kind = "<f4" if isinstance(shape.elementType, T.FloatType) else "<f8"
    element = "float" if kind == "<f4" else "double"
    valid = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{element}>").alias("vector"), F.coalesce(query, F.lit(False)).alias("asks")).where(
        F.col("id").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    )
    empty = rows.sparkSession.createDataFrame([], f"query_id long, rank int, `{key}` long, score double")
    usual = valid.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if usual is None:
        return empty
    valid = valid.where(F.size("vector") == usual["n"])
    # the smallest keys of each vector, with and without questions; Spark keeps the same few before the shuffle
    place = F.row_number().over(Window.partitionBy("vector", "asks").orderBy("id"))
    classes = cut(
        valid.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vector")
        .agg(F.min("id").alias("class"), F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"), F.bool_or("asks").alias("asks"))
    )
    # about twice as many as are wanted, so that tasks send few
    chance = F.pmod(F.xxhash64("class"), F.lit(1 << 40)) / float(1 << 40)
    drawn = classes.where(chance < 2 * sample / max(classes.count(), 1)).orderBy(chance, "class").limit(sample).select("vector").collect()
    coder = learn(np.array([r["vector"] for r in drawn], np.float64), k)
    def entries(batches, masks: list[list[int]]):
        for batch in batches:
            ids, vectors = batch.column("class").to_numpy(), np.stack(batch.column("vector").to_numpy(zero_copy_only=False)).astype(kind)
            codes = coder.codes(vectors.astype(np.float64))
            raw, code = [v.tobytes() for v in vectors], [c.tobytes() for c in codes]
            for table in range(TABLES):
                flips = masks[table]
                if not flips:
                    continue
                for start in range(0, len(ids), 256):
                    part = slice(start, start + 256)
                    values = (codes[part, table][:, None] ^ np.array(flips, np.uint8)[None, :]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(ids[part], len(flips))), pa.array((table * 256 + values).ravel()),
                        pa.array(np.repeat(np.array(code[part], object), len(flips)), pa.binary()),
                        pa.array(np.repeat(np.array(raw[part], object), len(flips)), pa.binary()),
                    ], ["id", "entry", "code", "raw"])

    layout = "id long, entry int, code binary, raw binary"
    vectors = classes.select("class", "vector")
    index = vectors.mapInArrow(lambda b: entries(b, [[0]] * TABLES), layout)
    fill = _blocks(index)

    def within(asking: DataFrame, radius: int) -> DataFrame:
        """The nearest rows, its own among them, that each class of ``asking`` has within the radius: ``query``, ``hits``."""
        reach = reach_of(radius)
        masks = [[m for m in range(256) if ONES[m] <= r] for r in reach]
        probes = asking.select("class", "vector").mapInArrow(lambda b: entries(b, masks), layout)
        asked = _blocks(probes)
        cells = _spread(probes, asked, fill).groupBy("entry", "asked", "fill").cogroup(_spread(index, fill, asked, own="fill", other="asked").groupBy("entry", "asked", "fill"))

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            out = {"query": [], "found": [], "away": []}
            if left.num_rows and right.num_rows:
                table = left.column("entry")[0].as_py() // 256
                ids = right.column("id").to_numpy()
                order = np.argsort(ids)
                ids = ids[order]
                codes = _stacked(right, "code", np.uint8)[order]
                floats = _stacked(right, "raw", kind)[order].astype(np.float64)
                asking, own = _stacked(left, "code", np.uint8), _stacked(left, "raw", kind).astype(np.float64)
                for i, query in enumerate(left.column("id").to_pylist()):
                    bits = ONES[codes ^ asking[i]]
                    hit = bits.sum(1) <= radius
                    for earlier in range(table):
                        hit &= bits[:, earlier] > reach[earlier]
                    hit = np.flatnonzero(hit)
                    if not len(hit):
                        continue
                    away = np.sqrt(((floats[hit] - own[i]) ** 2).sum(1))
                    best = np.argsort(away, kind="stable")[: k + 1]
                    out["query"].append(query)
                    out["found"].append(ids[hit[best]].tolist())
                    out["away"].append(away[best].tolist())
            return pa.table(out, pa.schema([("query", pa.int64()), ("found", pa.list_(pa.int64())), ("away", pa.list_(pa.float64()))]))

        near = cells.applyInArrow(compare, "query long, found array<long>, away array<double>")
        # a query meets at most 8 * 256 entries times the blocks, and has k + 1 rows from each
        near = near.select("query", F.explode(F.arrays_zip("found", "away")).alias("hit")).select("query", "hit.found", "hit.away")
        near = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("away", "found"))).where(F.col("place") <= k + 1)
        return (
            near.join(classes.select(F.col("class").alias("found"), "ids"), "found")
            .select("query", "away", F.explode("ids").alias("id")).groupBy("query")
            .agg(F.slice(F.sort_array(F.collect_list(F.struct("away", "id"))), 1, k + 1).alias("hits"))
        )

    # the own row counts, so that a class has enough with one more than k, or with all there are
    enough = min(k + 1, classes.agg(F.sum(F.size("ids"))).first()[0])
    radius, short, answers = coder.radius, classes.where("asks").select("class", "vector"), None
    while True:
        found = cut(within(short, radius))
        last = F.try_element_at("hits", F.lit(enough))["away"]
        needed = F.greatest(F.lit(0), F.lit(0), *[F.when(last >= away, wide).otherwise(0) for away, wide in coder.needed])
        full = found if radius == TABLES * WIDTH else found.where((F.size("hits") >= enough) & (needed <= radius))
        answers = full if answers is None else answers.union(full)
        if radius == TABLES * WIDTH:
            break
        short = cut(short.join(full.select(F.col("query").alias("class")), "class", "left_anti"))
        if short.isEmpty():
            break
        radius = min(radius + TABLES, TABLES * WIDTH)
    asking = valid.where("asks").select(F.col("id").alias("query_id"), "vector").join(classes.where("asks").select("vector", "class"), "vector")
    return (
        asking.select("query_id", F.col("class").alias("query")).join(answers, "query")
        .select("query_id", F.posexplode(F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)))
        .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias(key), F.col("col.away").alias("score"))
    )


def _stacked(table: pa.Table, column: str, kind) -> np.ndarray:
    raw = table.column(column).to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def _blocks(rows: DataFrame) -> list[int]:
    """Blocks of each table entry; there are 2,048 entries at any size."""
    counts = {r["entry"]: r["n"] for r in rows.groupBy("entry").agg(F.count("*").alias("n")).collect()}
    return [max(-(-counts.get(e, 0) // BLOCK), 1) for e in range(TABLES * 256)]


def _spread(rows: DataFrame, own_blocks: list[int], other_blocks: list[int], own: str = "asked", other: str = "fill") -> DataFrame:
    """Each row in one block of its own side, for every block of the other side."""
    def blocks(numbers):
        return F.element_at(F.from_json(F.lit(json.dumps(numbers)), "array<int>"), F.col("entry") + 1)

    return rows.withColumn(own, F.pmod(F.xxhash64("id"), blocks(own_blocks)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), blocks(other_blocks) - 1))
    )
