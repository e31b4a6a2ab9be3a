"""Similarity joins, fuzzy groups and nearest rows against brute force."""

import random
from difflib import SequenceMatcher, get_close_matches

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import clean, dedup, neighbours
from plumbline.plans import segments, similar, staging


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        place = rng.randrange(len(text) + 1)
        action = rng.random()
        if action < 0.4:
            text.insert(place, rng.choice("abcde "))
        elif text and action < 0.8:
            text.pop(min(place, len(text) - 1))
        elif text:
            text[min(place, len(text) - 1)] = rng.choice("abcde")
    return "".join(text)


def words(seed, count, longest=25, alphabet="abcde "):
    rng = random.Random(seed)
    found = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(count)]
    for _ in range(count):
        base = rng.choice(found)
        found.append(edited(rng, base, rng.randint(1, max(1, len(base) // 7))) or "a")
    return found


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.9, 1.0])
def test_similar_pairs_miss_nothing(spark, threshold):
    texts = sorted(set(words(5, 60)))
    left, right = texts[::2], texts[1::2]
    found = similar.similar_pairs(
        spark.createDataFrame([(t,) for t in left], "a string"), spark.createDataFrame([(t,) for t in right], "b string"), threshold
    )
    expected = {(a, b) for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= threshold}
    assert {(r["a"], r["b"]) for r in found.collect()} == expected


def test_similar_long_texts(spark):
    rng = random.Random(3)
    # Lengths on both sides of the border between the two kinds of keys.
    left = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(50, 180))) for _ in range(25)]
    right = [edited(rng, t, rng.randint(1, max(1, len(t) // 12))) for t in left]
    found = similar.similar_pairs(
        spark.createDataFrame([(t,) for t in left], "a string"), spark.createDataFrame([(t,) for t in right], "b string"), 0.85
    )
    expected = {(a, b) for a in left for b in right if SequenceMatcher(None, a, b).ratio() >= 0.85}
    assert len(expected) > 10 and {(r["a"], r["b"]) for r in found.collect()} == expected


def brute_groups(rows, threshold):
    """Greedy groups led by the earliest row."""
    tidy = [[(v or "").strip().lower() for v in row] for row in rows]

    def match(x, y):
        return all(a == b or not a or not b or SequenceMatcher(None, a, b).ratio() >= threshold for a, b in zip(x, y))

    owner = {}
    for i, x in enumerate(tidy):
        if i in owner:
            continue
        members = [j for j in range(i + 1, len(tidy)) if j not in owner and match(x, tidy[j])]
        if members:
            owner[i] = i
            owner.update(dict.fromkeys(members, i))
    return owner


@pytest.mark.parametrize("hot_pairs", [10**6, 20, 0])
@pytest.mark.parametrize("gaps", [0.0, 0.15])
def test_fuzzy_groups_match_brute_force(spark, hot_pairs, gaps):
    rng = random.Random(int(gaps * 100) + 1)
    names, kinds = words(11, 40, 14), ["alpha", "alpho", "beta", "gamma ray", "gamma raj"]
    rows = [
        (None if rng.random() < gaps else rng.choice(names).upper(), "" if rng.random() < gaps else rng.choice(kinds)) for _ in range(150)
    ]
    data = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "id long, name string, kind string")
    found = dedup.fuzzy_groups(data, "id", ["name", "kind"], 0.8, hot_pairs)
    assert {r["id"]: r["leader"] for r in found.collect()} == brute_groups(rows, 0.8)


def test_fuzzy_drop(spark):
    rows = ["john smith", "jon smith", "alice", "john smyth", "alicia keys"]
    data = spark.createDataFrame(list(enumerate(rows)), "id long, name string")
    kept = {k: sorted(r["id"] for r in dedup.drop_fuzzy_duplicates(data, "id", ["name"], 0.85, k).collect()) for k in ("first", "last", "none")}
    assert kept == {"first": [0, 2, 4], "last": [2, 3, 4], "none": [2, 4]}


def test_typos_match_brute_force(spark):
    rng = random.Random(2)
    base = [w for w in words(21, 15, 12) if len(w.strip()) > 3][:12]
    values = base * 3 + [edited(rng, w, 1) or "x" for w in base]
    data = spark.createDataFrame([(v,) for v in values], "v string")
    counts = {v: values.count(v) for v in values}
    expected = {}
    for value in counts:
        if counts[value] == 1:
            close = get_close_matches(value, [v for v in counts if counts[v] > 1], n=1, cutoff=0.85)
            if close:
                expected[value] = close[0]
    found = {r["wrong"]: r["right"] for r in clean.likely_typos(data, "v").collect()}
    score = lambda a, b: SequenceMatcher(None, a, b).ratio()
    assert set(found) == set(expected)
    assert all(score(found[v], v) == pytest.approx(score(expected[v], v)) for v in found)


@pytest.mark.parametrize("per_cell", [500, 5])
def test_nearest_rows_match_brute_force(spark, per_cell):
    rng = random.Random(per_cell)
    rows = []
    for i in range(120):
        values = [float(rng.randint(0, 40)), rng.gauss(0, 10), float(rng.choice([1, 1, 1, 2]))]
        rows.append((i, *[None if rng.random() < 0.15 else v for v in values]))
    data = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in neighbours.fill_nearest(data, ["a", "b", "c"], ["id"], per_cell=per_cell).collect()}

    def distance(x, y):
        shared = [(p - q) ** 2 for p, q in zip(x[1:], y[1:]) if p is not None and q is not None]
        return (3 / len(shared) * sum(shared)) ** 0.5 if shared else None

    for row in rows:
        for k in range(3):
            if row[k + 1] is not None:
                assert got[row[0]][k] == row[k + 1]
                continue
            donors = [(distance(row, d), d[k + 1]) for d in rows if d[k + 1] is not None and distance(row, d) is not None]
            donors.sort()
            chosen = [v for _, v in donors[:5]] or [d[k + 1] for d in rows if d[k + 1] is not None]
            assert got[row[0]][k] == pytest.approx(sum(chosen) / len(chosen))


def test_similarity_runs_over_distinct_texts_only(spark):
    """A third of all rows being one text costs one comparison, not all pairs."""
    rows = [(i, "same text") for i in range(400)] + [(1000 + i, w) for i, w in enumerate(words(8, 20, 10))]
    found = dedup.fuzzy_groups(spark.createDataFrame(rows, "id long, name string"), "id", ["name"], 0.9)
    assert found.where(F.col("leader") == 0).count() >= 400


def test_wide_text_is_not_broadcast(spark, monkeypatch):
    lookup = spark.createDataFrame([("a" * 30, 1), (None, 2)], "`a.b` string, n long")
    plan = lambda df: df._jdf.queryExecution().logical().toString().lower()
    assert "hint" in plan(segments.small(lookup))
    assert "hint" not in plan(segments.small(lookup, rows=1))
    monkeypatch.setattr(segments, "BROADCAST_BYTES", 20)
    assert "hint" not in plan(segments.small(lookup))


def test_groups_by_edits(spark):
    rows = ["abcdefghij", "abcdefghix", "jihgfedcba", "abcdefgh"]
    data = spark.createDataFrame(list(enumerate(rows)), "id long, name string")
    found = dedup.fuzzy_groups(data, "id", ["name"], 0.9, form="levenshtein")
    assert {r["id"]: r["leader"] for r in found.collect()} == {0: 0, 1: 0}
    with pytest.raises(ValueError):
        dedup.fuzzy_groups(data, "id", ["name"], 0.9, form="other")


def test_cells_split_points():
    draw = np.random.default_rng(1)
    points = draw.normal(size=(1000, 3))
    parts = neighbours.cells_of(points, 16)
    assert sorted(np.concatenate(parts).tolist()) == list(range(1000)) and max(map(len, parts)) <= 16
    assert len(neighbours.cells_of(np.zeros((50, 2)), 16)) == 4


def test_nearest_rows_meet_a_small_share_of_the_cells(spark, monkeypatch):
    """Four measures with gaps: a search meets less than a quarter of the cells."""
    seen = []
    search = neighbours._nearest
    monkeypatch.setattr(neighbours, "_nearest", lambda tasks, cells, width, k: seen.append((tasks, cells, search(tasks, cells, width, k))) or seen[-1][2])
    draw = np.random.default_rng(2)
    rows = [(i, *[None if draw.random() < 0.02 else float(v) for v in draw.normal(size=4)]) for i in range(20_000)]
    data = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    filled = neighbours.fill_nearest(data, ["a", "b", "c", "d"], ["id"], per_cell=64)
    assert filled.count() == 20_000 and filled.dropna().count() == 20_000
    tasks, cells, (_, pairs) = seen[0]
    assert pairs.count() < 0.25 * tasks.count() * cells.count()
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Union") >= 1


def test_nearest_rows_of_odd_tables(spark):
    schema = "id long, `a.b` double, c double, _0 string"
    empty = spark.createDataFrame([], schema)
    assert neighbours.fill_nearest(empty, ["a.b", "c"], ["id"]).collect() == []
    lone = spark.createDataFrame([(1, None, 2.0, "x"), (2, None, None, "y"), (3, None, 4.0, None)], schema)
    assert sorted(map(tuple, neighbours.fill_nearest(lone, ["a.b", "c"], ["id"]).collect())) == [(1, None, 2.0, "x"), (2, None, 3.0, "y"), (3, None, 4.0, None)]
    nan = spark.createDataFrame([(1, float("nan"), 2.0, "x"), (2, 5.0, 2.0, "y"), (2, 5.0, 2.0, "y")], schema)
    assert neighbours.fill_nearest(nan, ["a.b", "c"], ["id"]).where("id = 1").first()["a.b"] == 5.0


def test_keys_are_not_written(spark, monkeypatch):
    """Left rows make hundreds of keys; only rows and pairs are written, and rows taken in turns find the same groups."""
    written = []

    def watched(df):
        out = staging.cut(df)
        written.append(out.count())
        return out

    rows = [(t.upper(), None) for t in words(31, 60, 34)]
    data = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id long, name string")
    monkeypatch.setattr(dedup, "cut", watched)
    once = dedup.fuzzy_groups(data, "id", ["name"], 0.8, keyed_rows=10**9)
    found = {r["id"]: r["leader"] for r in once.collect()}
    monkeypatch.undo()
    keys = similar.left_keys(data.withColumn("name", F.lower("name")), "name", 0.8).count()
    assert max(written) < keys / 10
    turned = dedup.fuzzy_groups(data, "id", ["name"], 0.8, keyed_rows=keys // 3)
    assert found == {r["id"]: r["leader"] for r in turned.collect()} == brute_groups([(t,) for t, _ in rows], 0.8)


def test_written_tables_leave_no_shuffle_files(spark):
    shuffled = spark.range(1000).repartition(3, "id")
    n = staging.cut(shuffled)
    assert n.count() == shuffled.count() == 1000
    assert spark.conf.get(staging.CLEANUP, "false") == "false"
