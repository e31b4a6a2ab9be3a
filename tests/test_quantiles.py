"""Percentiles by brackets against sorted lists."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.plans import quantiles
from plumbline.plans.quantiles import _bracketed, _gathered, percentiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.751, 1.0]


def plain(values, probs=PROBS):
    values, out = sorted(values), []
    for p in probs:
        spot = (len(values) - 1) * p
        low = values[int(spot)]
        out.append(low + (values[min(int(spot) + 1, len(values) - 1)] - low) * (spot - int(spot)))
    return out


def rows(n=3_000):
    draw = random.Random(4)
    # all different, few values, one value in a third of all rows, gaps, a constant
    return [
        (i, i % 4, draw.gauss(0, 100), draw.randint(1, 6), 7.0 if draw.random() < 0.4 else draw.random(), None if i % 3 else draw.random(), 2.5)
        for i in range(n)
    ]


COLUMNS = ["a", "b", "c", "d", "e"]
SCHEMA = "id long, g int, a double, b int, c double, d double, e double"


@pytest.mark.parametrize("bound", [0, quantiles.BUFFER_VALUES])
@pytest.mark.parametrize("by", [(), ("g",)])
@pytest.mark.parametrize("accuracy", [20, 1_000])
def test_percentiles(table, monkeypatch, bound, by, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "SEGMENT_ACCURACY", accuracy)
    data = rows()
    found = {(*[r[k] for k in by], r["column"]): r for r in percentiles(table(SCHEMA, data, 5), COLUMNS, PROBS, by, bound).collect()}
    groups = {(): data} if not by else {(g,): [r for r in data if r[1] == g] for g in range(4)}
    assert len(found) == 5 * len(groups)
    for key, own in groups.items():
        for place, c in enumerate(COLUMNS, 2):
            values = [float(r[place]) for r in own if r[place] is not None]
            assert found[*key, c].percentiles == pytest.approx(plain(values), abs=1e-9) and found[*key, c].total == len(values)


def test_many_segments_and_missed_brackets(table, monkeypatch):
    data = table(SCHEMA, rows(), 5)
    want = sorted(tuple(map(str, r)) for r in percentiles(data, ["a", "b"], [0.1, 0.5], ["g"]).collect())
    monkeypatch.setattr(quantiles, "SEGMENTS", 3)
    assert sorted(tuple(map(str, r)) for r in percentiles(data, ["a", "b"], [0.1, 0.5], ["g"]).collect()) == want
    monkeypatch.setattr(quantiles, "SEGMENTS", 2_000)
    monkeypatch.setattr(quantiles, "_brackets", lambda edges: [(1e9, 2e9)])
    assert sorted(tuple(map(str, r)) for r in percentiles(data, ["a", "b"], [0.1, 0.5], ["g"]).collect()) == want


def test_only_what_lies_in_brackets_is_gathered(spark):
    """Of 400,000 different values three ranks need a few hundred."""
    data = spark.range(400_000).select((F.col("id") * 7919 % 400_009).cast("double").alias("x"))
    edges = data.agg(F.percentile_approx("x", [p + s * 2 / quantiles.ACCURACY for p in (0.25, 0.5, 0.75) for s in (-1, 1)], quantiles.ACCURACY)).first()[0]
    gathered = _gathered(*_bracketed(data, ["x"], (), [((), [quantiles._brackets(edges)])], 3), ())
    assert 0 < gathered.count() < 3 * 4 / quantiles.ACCURACY * 400_000 * 2 + 4
    values = sorted(r.x for r in data.collect())
    assert percentiles(data, ["x"], PROBS).first().percentiles == pytest.approx(plain(values), abs=1e-6)


def test_nothing_to_select(table):
    empty = table(SCHEMA, [], None)
    assert percentiles(empty, ["a"], [0.5]).collect() == [] == percentiles(empty, ["a"], [0.5], ["g"]).collect()
    assert percentiles(table(SCHEMA, [(1, 1, None, None, None, None, None)]), ["a", "b"], [0.5]).collect() == []
    assert percentiles(table(SCHEMA, [(1, None, 3.0, None, None, None, None)]), ["a", "b"], [0.5], ["g"]).collect()[0].percentiles == [3.0]
