"""Profiles of columns with very many values."""

from pyspark.sql import functions as F

from plumbline.operators import profile


def test_a_million_texts_are_counted_and_not_listed(spark):
    data = spark.range(1_000_000).select(F.md5(F.col("id").cast("string")).alias("text"), (F.col("id") % 3).cast("string").alias("few"))
    found = {r.column: r for r in profile.profile(data).collect()}
    assert found["text"].distinct_count == 1_000_000 and found["text"].unique_values is None and found["text"].type == "categorical"
    assert found["few"].unique_values == ["0", "1", "2"] and found["few"].distinct_count == 3
    assert all(len(r.unique_values or ()) <= profile.ROW_VALUES for r in found.values())


def test_both_ways_agree(table):
    rows = [(" A ",), ("a",), ("",), (" ",), ("yes",), ("No",), (None,)] * 3
    data = table("v string", rows)
    listed, counted = (profile.profile(data, row_values=n).drop("unique_values").first() for n in (100, 0))
    assert listed == counted and listed.distinct_count == 6
    values = {r.value for r in profile.value_rows(data, data.schema.fields).collect()}
    assert values == {" A ", "a", "", " ", "yes", "No"}
