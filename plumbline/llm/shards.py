"""Shards of near equal bytes by sampled splitters: DataFrame functions only."""

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.plans.staging import cut

# Keys drawn to choose the splitters, and the ranges that they bound. Both are fixed: neither grows with the input.
SAMPLE, RANGES = 16_384, 1_024
# A range with more than so many times its share of the bytes, and more rows than a trifle, is divided again.
OVERFULL, LEAST_ROWS, PARTS = 2.0, 1_024, 32
BLOCK = 32


def text_bytes(text: str = "text") -> Column:
    """The size of a row: UTF-8 bytes of its text plus 1; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shard_by_bytes(docs: DataFrame, shards: int = 16, key: str = "doc_id", size: str = "size", order: str = "text_md5") -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: shards of near equal ``size``, slots gapless from 0.

    Rows are placed by the string ``order``, then by ``key``. With a hash of the text as ``order``, equal texts
    are neighbours and share a shard unless a border falls between them. A row is in shard ``floor(shards *
    size before it / all sizes)``: two shards differ by less than the largest two rows. Sizes are positive.

    A size-weighted sample of keys gives splitters at its quantiles; rows are counted by range, ranges that
    turn out overfull are sampled and divided again until none is (a range of one key can't be), and the
    order inside a range is a window over that range alone. What the driver holds (sample, splitters, bytes
    of the ranges) has a fixed bound. Copies of one text differ in ``key``, so a hot text is divided like
    any other; rows equal in text and key are taken in one range and may exchange their slots.

    A null ``order`` counts as empty, and a null key comes first. An empty table gives an empty result. Columns
    of ``docs`` with the name of an added one are replaced.
    """
    rows = docs.drop("shard", "slot")
    rows = rows.select(
        F.struct(*[F.col(f"`{n}`") for n in rows.columns]).alias("__own"), F.struct(F.coalesce(order, F.lit("")).alias("hash"), F.col(key).alias("key")).alias("__place"),
        F.col(size).cast("long").alias("__size"),
    )
    narrow = cut(rows.select("__place", "__size"))
    splitters = _splitters(narrow, narrow.agg(F.sum("__size")).first()[0], RANGES)
    while True:
        ranges = _with_range(narrow, splitters).groupBy("__range").agg(
            F.sum("__size").alias("bytes"), F.count("*").alias("rows"), F.min("__place").alias("low"), F.max("__place").alias("high")
        ).collect()
        total = sum(r["bytes"] for r in ranges)
        full = [
            r for r in ranges
            if r["bytes"] > OVERFULL * total / RANGES and r["rows"] > LEAST_ROWS and r["low"] != r["high"]
        ]
        found = {tuple(r["high"]) for r in full}
        for r in full:  # at most RANGES / OVERFULL of them
            inside = narrow.where((F.col("__place") >= _literal(r["low"], narrow)) & (F.col("__place") <= _literal(r["high"], narrow)))
            found |= set(_splitters(inside, r["bytes"], PARTS))
        if not found - set(splitters):
            break
        splitters = sorted(found | set(splitters), key=_ordered)
    ranges.sort(key=lambda r: r["__range"])
    bytes_before = dict(zip([r["__range"] for r in ranges], accumulate((r["bytes"] for r in ranges), initial=0)))
    rows_before = dict(zip([r["__range"] for r in ranges], accumulate((r["rows"] for r in ranges), initial=0)))

    def placed(df: DataFrame) -> DataFrame:
        own = Window.partitionBy("__range").orderBy("__place")
        so_far = F.sum("__size").over(own.rowsBetween(Window.unboundedPreceding, 0))
        return (
            _with_range(df, splitters)
            .withColumn("__before", _by_range(bytes_before, splitters) + so_far - F.col("__size"))
            .withColumn("__row", _by_range(rows_before, splitters) + F.row_number().over(own) - 1)
            .withColumn("shard", F.expr(f"int(__before * {shards}L div {max(total, 1)}L)"))
        )

    starts = placed(narrow).groupBy("shard").agg(F.min("__row").alias("__start"))  # one row per shard
    return placed(rows).join(F.broadcast(starts), "shard").select(
        "__own.*", "shard", (F.col("__row") - F.col("__start")).alias("slot")
    )


def _ordered(place: tuple) -> tuple:
    return place[0], place[1] is not None, place[1]


def _literal(place: tuple, narrow: DataFrame) -> Column:
    kind = narrow.schema["__place"].dataType["key"].dataType
    return F.struct(F.lit(place[0]).alias("hash"), F.lit(place[1]).cast(kind).alias("key"))


def _splitters(narrow: DataFrame, total: int | None, parts: int) -> list[tuple]:
    """At most ``parts`` - 1 places that cut a size-weighted sample in equal parts.

    The sample holds the rows with the smallest -ln(u) / size, u being a hash of the place: a draw without
    replacement in which each next row is taken in proportion to its size, the same in every run. About twice
    as many rows as the sample holds lie below ``2 * SAMPLE / total``; only those are sorted and sent on.
    """
    chance = (F.pmod(F.xxhash64("__place", F.lit(17)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    sample = narrow.select("__place", (-F.log(chance) / F.col("__size")).alias("rank"))
    sample = sample.where(F.col("rank") < 2 * SAMPLE / max(total or 1, 1)).orderBy("rank", "__place").limit(SAMPLE)
    places = sorted((tuple(r["__place"]) for r in sample.collect()), key=_ordered)
    return sorted({places[len(places) * i // parts] for i in range(1, parts)} if places else [], key=_ordered)


def _with_range(df: DataFrame, splitters: list[tuple]) -> DataFrame:
    """The number of splitters at or below each row: first by blocks of splitters, then inside one block."""
    if not splitters:
        return df.withColumn("__range", F.lit(0))
    kind = df.schema["__place"].dataType
    shape = f"array<{kind.simpleString()}>"

    def places(chosen: list[tuple]) -> Column:
        rows = [{"hash": h, "key": k if k is None or isinstance(k, (int, float)) else str(k)} for h, k in chosen]
        return F.from_json(F.lit(json.dumps(rows)), shape)

    below = lambda s: s <= F.col("__place")
    blocks = F.size(F.filter(places(splitters[BLOCK - 1 :: BLOCK]), below)) if len(splitters) >= BLOCK else F.lit(0)
    return df.withColumn("__block", blocks).withColumn(
        "__range", F.col("__block") * BLOCK + F.size(F.filter(F.slice(places(splitters), F.col("__block") * BLOCK + 1, F.lit(BLOCK)), below))
    ).drop("__block")


def _by_range(values: dict[int, int], splitters: list[tuple]) -> Column:
    numbers = [values.get(k, 0) for k in range(len(splitters) + 1)]
    return F.element_at(F.from_json(F.lit(json.dumps(numbers)), "array<bigint>"), F.col("__range") + 1)
