"""Exact and fuzzy duplicates."""

from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import RATIOS, strip_blanks
from ..plans.segments import text_columns
from ..plans.similar import KEYS, POSITIONED, allowed, check_threshold, left_keys, right_keys
from ..plans.staging import cut

FUZZY_THRESHOLD = 0.9
# A key shared by more candidate pairs than this is thinned out by leaders before pairs are formed.
HOT_PAIRS = 1_000_000
# Thinning goes on while each round leaves at most this share of the hottest key's pairs. Rows that match nobody
# lead one by one; then forming the pairs costs less than more rounds. The result is the same either way.
THINNING_SHARE = 0.9
# Keys that one join of left and right rows shuffles; more left rows are taken in turns.
KEYED_ROWS = 16_000_000


# ---- exact ---------------------------------------------------------------------------------------

def duplicate_groups(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """(subset..., copies) of the values that occur more than once; missing values are equal."""
    keys = list(subset or df.columns)
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def duplicate_report(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """(total_rows, exact_duplicate_count, rows_remaining): repeats beyond the first."""
    groups = df.groupBy(*(subset or df.columns)).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("exact_duplicate_count"),
        F.count("*").alias("rows_remaining"),
    )


def drop_duplicates(
    df: DataFrame, order: Sequence[str], subset: Sequence[str] | None = None, keep: str = "first"
) -> DataFrame:
    """One row per value of ``subset``: the first or last in a unique order, or only unrepeated rows.

    Copies are merged before the shuffle, so a value held by many rows costs one row per task.
    """
    keys = list(subset or [c for c in df.columns if c not in order])
    place = F.struct(*order)
    rest = [c for c in df.columns if c not in keys]
    choose = F.max_by if keep == "last" else F.min_by
    picked = df.groupBy(*keys).agg(choose(F.struct(*rest), place).alias("_row"), F.count("*").alias("_copies"))
    if keep == "none":
        picked = picked.where("_copies = 1")
    elif keep not in ("first", "last"):
        raise ValueError(f"unknown keep {keep!r}")
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


# ---- fuzzy ---------------------------------------------------------------------------------------

def _both(a: Column, b: Column) -> Column:
    return (a != "") & (b != "")


def _lanes(patterns: list[tuple[bool, ...]]) -> tuple[dict, bool]:
    """For each pattern of filled columns, the columns in which it must look for partners."""
    lanes = {p: set() for p in patterns}
    free = False
    for p in patterns:
        for q in patterns:
            common = [i for i, (x, y) in enumerate(zip(p, q)) if x and y]
            if common:
                lanes[p].add(common[0])
            else:
                free = True
    return lanes, free


def _keyed(
    reps: DataFrame, names: list[str], lanes: dict, free: bool, threshold: float, side: str, present: dict[str, list[int]]
) -> DataFrame:
    """(id, names..., lane, keys...): one lane per column used for blocking, one for rows that share no column.

    Never written as a whole: a left row has hundreds of keys, which are made where they are used.
    """
    parts = []
    for lane, name in enumerate(names):
        users = [p for p, used in lanes.items() if lane in used]
        if users:
            chosen = reps.where(F.col("_filled").isin(["".join("1" if x else "0" for x in p) for p in users])).select("id", *names)
            keyed = left_keys(chosen, name, threshold, present[name]) if side == "left" else right_keys(chosen, name, threshold)
            parts.append(keyed.select("id", *names, F.lit(lane).alias("lane"), *KEYS))
    if free:
        patterns = ["".join("1" if x else "0" for x in p) for p in lanes]
        for p in patterns:
            for q in patterns:
                if all(x == "0" or y == "0" for x, y in zip(p, q)):
                    parts.append(reps.where(F.col("_filled") == p).select(
                        "id", *names, F.lit(-1).alias("lane"), F.lit(-2).alias("key_length"), F.lit(-2).alias("key_piece"),
                        F.lit("|".join(sorted([p, q]))).alias("piece"),
                    ))
    return reduce(DataFrame.unionByName, parts)


def _matches(left: DataFrame, right: DataFrame, names: list[str], threshold: float, form: str, turns: int = 1) -> DataFrame:
    """(i, j) with i before j for the keyed rows that match in every column; the left rows in ``turns``, each written and swept.

    Rows meet by a hash of their key. Keys that share one only bring pairs that are compared and fail.
    """
    block = F.xxhash64("lane", *KEYS).alias("_block")
    a = left.select(F.col("id").alias("i"), block, *[F.col(n).alias(f"a_{n}") for n in names])
    b = right.select(F.col("id").alias("j"), block, *[F.col(n).alias(f"b_{n}") for n in names])
    near = F.col("i") < F.col("j")
    for n in names:
        x, y = F.col(f"a_{n}"), F.col(f"b_{n}")
        near = near & ((x == y) | (x == "") | (y == "") | allowed(x, y, threshold))

    def matched(part: DataFrame) -> DataFrame:
        pairs = part.join(b, "_block").where(near).drop("_block").distinct()
        for n in names:
            x, y = F.col(f"a_{n}"), F.col(f"b_{n}")
            score = F.when((x == y) | (x == "") | (y == ""), 1.0).otherwise(RATIOS[form](x, y))
            pairs = pairs.where(score >= threshold)
        return cut(pairs.select("i", "j"))

    if turns == 1:
        return matched(a)
    return reduce(DataFrame.unionAll, [matched(a.where(F.pmod(F.xxhash64("i"), F.lit(turns)) == turn)) for turn in range(turns)])


def fuzzy_groups(
    df: DataFrame,
    key: str,
    columns: Sequence[str] | None = None,
    threshold: float = FUZZY_THRESHOLD,
    hot_pairs: int = HOT_PAIRS,
    form: str = "sequence",
    keyed_rows: int = KEYED_ROWS,
) -> DataFrame:
    """(key, leader) of every row in a group of at least two near-duplicates.

    Two rows match when each compared column is equal, empty on a side, or similar enough. A row
    leads unless an earlier leader matches it; it belongs to the earliest leader that matches it.
    ``key`` is unique and gives the order. ``form`` is "sequence" (share of matching characters) or
    "levenshtein" (share of characters left alone by the shortest edit of the longer text).
    """
    check_threshold(threshold)
    if form not in RATIOS:
        raise ValueError(f"unknown form {form!r}")
    names = list(columns or text_columns(df, exclude=[key]))
    tidy = df.select(
        F.col(key).alias("id"), *[F.lower(strip_blanks(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in names]
    )
    # Equal rows share the fate of the first of them, so only distinct rows are compared.
    reps = tidy.groupBy(*names).agg(F.min("id").alias("id")).withColumn(
        "_filled", F.concat(*[F.when(F.col(c) != "", "1").otherwise("0") for c in names])
    )
    reps = cut(reps)
    sizes = reps.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first()
    # The most telling column is used for blocking wherever both rows fill it.
    names.sort(key=lambda c: -sizes[c])
    reps = reps.withColumn("_filled", F.concat(*[F.when(F.col(c) != "", "1").otherwise("0") for c in names]))
    patterns = [tuple(x == "1" for x in r["_filled"]) for r in reps.select("_filled").distinct().collect()]
    lanes, free = _lanes(patterns)
    texts = reps.select("id", *names)
    # Left rows only make keys for the lengths that short right texts have; there are at most POSITIONED of them.
    sized = reps.agg(*[F.collect_set(F.when(F.length(n) <= POSITIONED, F.length(n))).alias(n) for n in names]).first()
    present = {n: sorted(sized[n]) for n in names}

    def keyed(rows: DataFrame, side: str) -> DataFrame:
        return _keyed(rows, names, lanes, free, threshold, side, present)

    left, right = keyed(reps, "left"), keyed(reps, "right")
    opened, open_rows = reps, reps.select("id")
    leaders, early = [], []
    last = None
    while True:
        block = ["lane", *KEYS]
        load = left.groupBy(*block).agg(F.count("*").alias("x"), F.min("id").alias("first")).join(
            right.groupBy(*block).agg(F.count("*").alias("y")), block
        )
        load = cut(load)
        # A row meets itself under each of its keys; a key with one left row forms no pair.
        facts = load.agg(F.max(F.when(F.col("x") > 1, F.col("x") * F.col("y"))).alias("worst"), F.sum("x").alias("keys")).first()
        worst, turns = facts["worst"], max(1, ceil((facts["keys"] or 0) / keyed_rows))
        if worst is None or worst <= hot_pairs or (last is not None and worst > THINNING_SHARE * last):
            break
        last = worst
        # A row that comes first under all of its keys has no earlier open partner: it leads.
        chosen = cut(
            right.join(load.select(*block, "first"), block).groupBy("id")
            .agg(F.max(F.when(F.col("first") < F.col("id"), 1).otherwise(0)).alias("later"))
            .where("later = 0").select("id")
        )
        led = _matches(keyed(opened.join(chosen, "id", "left_semi"), "left"), right, names, threshold, form)
        leaders.append(chosen)
        early.append(led)
        gone = chosen.union(led.select(F.col("j").alias("id"))).distinct()
        opened = cut(opened.join(gone, "id", "left_anti"))
        open_rows = opened.select("id")
        left, right = keyed(opened, "left"), keyed(opened, "right")
    pairs = _matches(left, right, names, threshold, form, turns)

    links = pairs
    while True:
        waiting = cut(links.select(F.col("j").alias("id")).distinct())
        heads = cut(open_rows.join(waiting, "id", "left_anti"))
        leaders.append(heads)
        if waiting.isEmpty():
            break
        taken = links.join(heads.select(F.col("id").alias("i")), "i", "left_semi").select(F.col("j").alias("id")).distinct()
        gone = cut(taken.union(heads).distinct())
        open_rows = cut(open_rows.join(gone, "id", "left_anti"))
        links = links.join(gone.select(F.col("id").alias("i")), "i", "left_anti")
        links = cut(links.join(gone.select(F.col("id").alias("j")), "j", "left_anti"))
    heads = cut(reduce(DataFrame.union, leaders))
    found = pairs.join(heads.select(F.col("id").alias("i")), "i", "left_semi")
    if early:
        led = cut(reduce(DataFrame.union, early).groupBy("j").agg(F.min("i").alias("i")))
        # A leader found later may still come before the one that claimed a row in an early round.
        late_left = keyed(reps.join(heads, "id", "left_semi"), "left")
        late_right = keyed(reps.join(led.select(F.col("j").alias("id")), "id", "left_semi"), "right")
        found = found.union(led.select("i", "j")).union(_matches(late_left, late_right, names, threshold, form, turns))
    owner = found.groupBy(F.col("j").alias("id")).agg(F.min("i").alias("_leader"))
    settled = texts.join(owner, "id", "left").withColumn("_leader", F.coalesce("_leader", "id")).drop("id")
    equal = reduce(lambda x, y: x & y, [tidy[c] == settled[c] for c in names])
    assigned = tidy.join(settled, equal).select(F.col("id").alias(key), F.col("_leader").alias("leader"))
    assigned = cut(assigned)
    groups = assigned.groupBy("leader").agg(F.count("*").alias("_size")).where("_size > 1").select("leader")
    return assigned.join(groups, "leader", "left_semi").select(key, "leader")


def drop_fuzzy_duplicates(
    df: DataFrame,
    key: str,
    columns: Sequence[str] | None = None,
    threshold: float = FUZZY_THRESHOLD,
    keep: str = "first",
    form: str = "sequence",
) -> DataFrame:
    """Keep the first, the last or no row of each group of near-duplicates."""
    groups = fuzzy_groups(df, key, columns, threshold, form=form)
    if keep == "first":
        extra = groups.where(F.col(key) != F.col("leader")).select(key)
    elif keep == "last":
        last = groups.groupBy("leader").agg(F.max(key).alias(key))
        extra = groups.select(key).join(last, key, "left_anti")
    elif keep == "none":
        extra = groups.select(key)
    else:
        raise ValueError(f"unknown keep {keep!r}")
    return df.join(extra, key, "left_anti")
