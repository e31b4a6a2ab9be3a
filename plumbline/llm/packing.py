"""Packing of token sequences into windows by non-negative least squares over the histogram of lengths."""

from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from plumbline.llm.text import text_slices
from plumbline.llm.wordtokens import word_tokens
from plumbline.plans.staging import scratch_path

TOKENIZER = "word_bpe_49k.json"
WINDOW, END = 4_096, 2
# Tokens per unit of length in the histogram, and pieces of a planned window at most.
UNIT, DEPTH = 16, 3


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` exactly with at most ``depth`` lengths, longest first."""
    def fill(rest: int, most: int, left: int):
        if rest == 0:
            yield ()
        elif left == 1:
            if rest <= most:
                yield (rest,)
        elif left:
            for first in range(min(rest, most), 0, -1):
                if first * left < rest:
                    break
                for others in fill(rest - first, first, left - 1):
                    yield (first, *others)

    return sorted(set(fill(units, units, depth)), reverse=True)


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the smallest |ax - b|: columns join a passive set one by one and leave when they turn negative."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(np.abs(a.T @ b).max(), 1e-300)
    for _ in range(3 * len(b)):
        slope = a.T @ (b - a @ x)
        slope[passive] = -np.inf
        if passive.sum() == len(b) or slope.max() <= tolerance:
            break
        passive[slope.argmax()] = True
        while True:
            chosen = np.flatnonzero(passive)
            solved = np.linalg.lstsq(a[:, chosen], b, rcond=None)[0]
            if solved.min() > 0:
                x[:] = 0
                x[chosen] = solved
                break
            down = solved <= 0
            ratio = (x[chosen][down] / np.maximum(x[chosen][down] - solved[down], 1e-300)).min()
            x[chosen] += ratio * (solved - x[chosen])
            passive[chosen[x[chosen] <= 1e-12 * b.max()]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def plan(counts: dict[int, int], units: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how often each is used, from the number of pieces of each length.

    The repeat counts are the least-squares solution, rounded, and lowered where pieces run out.
    """
    ways = [w for w in combinations(units, depth) if all(counts.get(u) for u in w)]
    if not ways:
        return []
    lengths = sorted({u for w in ways for u in w})
    place = {u: i for i, u in enumerate(lengths)}
    a = np.zeros((len(lengths), len(ways)))
    for j, way in enumerate(ways):
        for u in way:
            a[place[u], j] += 1
    repeats = non_negative_least_squares(a, np.array([counts[u] for u in lengths], float))
    left, chosen = Counter(counts), []
    for j in np.argsort(-repeats, kind="stable"):
        need = Counter(ways[j])
        times = min(int(round(repeats[j])), *(left[u] // n for u, n in need.items()))
        if times > 0:
            chosen.append((ways[j], times))
            for u, n in need.items():
                left[u] -= times * n
    return chosen


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, window: int = WINDOW, end: int = END, unit: int = UNIT) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    Columns: ``key``, ``start`` (ids of the document before the piece), ``length``, ``ids`` (binary, unsigned
    32-bit little-endian), ``doc_tokens``, ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).
    A document is its ids and then ``end``. Whole windows of a document are sequences of their own. What
    remains of it is one piece: a histogram of these lengths, in units of ``unit`` tokens rounded up, gives
    the plan (see ``plan``), and pieces fill its slots in the order of their places. Pieces that the plan has no slot for
    are packed greedily, one behind the other, and cut where a sequence is full, so only planned sequences
    (by less than ``unit`` tokens a piece) and the very last one have room left.

    Rows are tokenised once, into the shared folder; each partition numbers its pieces of every length as it
    goes, so no length is ever gathered in one task. The driver sees the histogram alone. Null and empty
    texts are one piece that holds ``end``. Rows with equal or null keys are documents of their own. An empty
    table gives no pieces.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path(TOKENIZER)
    units = window // unit
    fields = [T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()), T.StructField("n", T.LongType()),
              T.StructField("bin", T.IntegerType()), T.StructField("seen", T.LongType()), T.StructField("ids", T.BinaryType())]
    rows = docs.select(F.col(f"`{key}`").alias("doc"), F.col(text).alias("text"))

    def tokenise(batches):
        tokens, seen, part, row = word_tokens(path), Counter(), TaskContext.get().partitionId(), 0
        last = np.array([end], "<u2").tobytes()
        for batch in text_slices(batches):
            found = [tokens.ids(tokens.words(t or b"")) + last for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            sizes = [len(f) // 2 for f in found]
            bins = [-(-(n % window) // unit) for n in sizes]
            ranks = []
            for b in bins:
                ranks.append(seen[b])
                seen[b] += 1
            yield pa.RecordBatch.from_arrays([
                batch.column("doc"), pa.array([part] * len(found), pa.int32()), pa.array(range(row, row + len(found)), pa.int64()),
                pa.array(sizes, pa.int64()), pa.array(bins, pa.int32()), pa.array(ranks, pa.int64()), pa.array(found, pa.binary()),
            ], ["doc", *(f.name for f in fields)])
            row += len(found)

    folder = scratch_path(spark, "tokens")
    rows.mapInArrow(tokenise, T.StructType([rows.schema["doc"], *fields])).write.option("compression", "zstd").parquet(folder)
    tokens = spark.read.parquet(folder)
    sizes = tokens.select("part", "row", "n", "bin", "seen")

    histogram = sizes.groupBy("part", "bin").agg(F.count("*").alias("rows"), F.sum(F.expr(f"n div {window}")).alias("full"))
    counts = histogram.groupBy("bin").agg(F.sum("rows").alias("rows"), F.sum("full").alias("full")).collect()
    chosen = plan({r["bin"]: r["rows"] for r in counts if r["bin"]}, units)
    slots, taken, sequence = [], Counter(), 0
    for way, times in chosen:
        for b, n in Counter(way).items():
            slots.append((b, taken[b], taken[b] + times * n, sequence, n))
            taken[b] += times * n
        sequence += times
    first_loose = sequence + sum(r["full"] for r in counts)
    slots = F.broadcast(spark.createDataFrame(slots, "bin int, low long, high long, first long, copies int"))  # a few hundred

    # the place of each piece among all of its length, and its slot
    earlier = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = histogram.select("part", "bin", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    places = sizes.join(starts, ["part", "bin"]).withColumn("place", F.col("before") + F.col("seen"))
    in_slot = (places["bin"] == slots["bin"]) & (places["place"] >= slots["low"]) & (places["place"] < slots["high"])
    places = places.join(slots, in_slot, "left").select(
        "part", "row", "place", F.expr("first + (place - low) div copies").alias("sequence"), F.expr(f"n div {window}").alias("full"),
        F.expr(f"n % {window}").alias("rest"), F.when(F.col("first").isNull(), F.expr(f"n % {window}")).otherwise(0).alias("loose"),
    )
    # whole windows, and tokens without a slot, of the rows before: by partition, then inside one
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = places.groupBy("part").agg(F.sum("full").alias("full"), F.sum("loose").alias("loose")).select(
        "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("full", "loose")]
    )
    inside = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    places = places.join(parts, "part").select(
        "part", "row", "place", "rest", "sequence",
        *[(F.col(f"{c}_before") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name) for c, name in (("full", "windows"), ("loose", "line"))],
    )
    mates = Window.partitionBy("sequence").orderBy(F.desc("rest"), "place").rowsBetween(Window.unboundedPreceding, -1)  # DEPTH rows at most
    fixed = places.where(F.col("sequence").isNotNull()).withColumn("offset", F.coalesce(F.sum("rest").over(mates), F.lit(0)))
    free = places.where(F.col("sequence").isNull()).withColumn("offset", F.lit(None).cast("long"))
    layout = fixed.unionByName(free).select("part", "row", "sequence", "offset", "line", "windows")

    def cut(batches):
        for batch in text_slices(batches, "ids"):
            made = {c: [] for c in ("at", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
            columns = [batch.column(c).to_pylist() for c in ("ids", "sequence", "offset", "line", "windows")]
            for at, (raw, own, offset, line, windows) in enumerate(zip(*columns)):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                pieces = [(i * window, window, planned + windows + i, 0) for i in range(len(ids) // window)]
                start = len(ids) - len(ids) % window
                if own is not None:
                    pieces.append((start, len(ids) - start, own, offset))
                    start = len(ids)
                while start < len(ids):
                    length = min(len(ids) - start, window - line % window)
                    pieces.append((start, length, first_loose + line // window, line % window))
                    start, line = start + length, line + length
                for start, length, number, place in pieces:
                    for name, value in zip(made, (at, start, length, ids[start : start + length].tobytes(), len(ids), number, place)):
                        made[name].append(value)
            at = made.pop("at")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pa.array(at, pa.int64())), *(pa.array(v, pa.binary() if n == "ids" else pa.int64()) for n, v in made.items())], [key, *made]
            )

    planned = sequence
    joined = tokens.select("doc", "part", "row", "ids").join(layout.hint("shuffle_hash"), ["part", "row"]).drop("part", "row")
    long = [T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset")]
    out = [T.StructField(key, rows.schema["doc"].dataType), *long[:2], T.StructField("ids", T.BinaryType()), *long[2:]]
    return joined.mapInArrow(cut, T.StructType(out))
