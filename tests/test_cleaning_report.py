"""The cleaning report against the table it comes with."""

from plumbline.operators import workflow as w

SCHEMA = "id long, name string, state string, day string, amount double"
ROWS = [
    (1, " ann  lee ", "ny", "2024-01-02", 1.0), (2, "Bob", "Texs", "bad", 2.0), (3, "Bob", "Texs", "bad", 2.0), (4, None, "nowhere", None, 3.0),
    (5, "ANN LEE", None, "2024-02-03", 2.5), (6, "Bob", "TX", "2024-03-04", None), (7, "Cy", " Ohio ", "2024-03-05", 900.0), (8, "Cy", "Ohio", "2024-03-06", 1.5),
]


def facts(report):
    return {(r.step, r.column, r["name"]): r.value for r in report.collect()}


def test_report_tells_what_changed(spark):
    data = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    steps = w.Cleaning(
        drop_exact=True, text_columns=["name"], state_columns=["state"], date_columns=["day"], corrections={"name": {"cy": "Cyrus"}},
        typo_columns=["state"], outlier_columns=["amount"], outlier_action="clip",
    )
    cleaned, report = w.clean_with_report(data, "id", steps)
    same = w.clean_table(data, "id", steps)
    assert cleaned.columns == same.columns == data.columns
    assert sorted(map(str, cleaned.collect())) == sorted(map(str, same.collect()))
    found = facts(report)
    assert found["rows", None, "rows_before"] == 8 and found["rows", None, "rows_after"] == 7
    assert found["duplicates", None, "rows_removed"] == 1 and found["duplicates", None, "rows_remaining"] == 7
    assert found["text", "name", "values_changed"] == 2 and found["text", "name", "old_unique_count"] == 4 and found["text", "name", "new_unique_count"] == 3
    assert found["states", "state", "values_changed"] == 5 and found["states", "state", "total_rows"] == 6
    assert found["dates", "day", "parsed"] == 5 and found["dates", "day", "failed"] == 1
    assert found["typos", "name", "values_corrected"] == 2 and found["typos", "state", "values_corrected"] == 0
    assert found["outliers", "amount", "outlier_count"] == 1 and cleaned.agg({"amount": "max"}).first()[0] == found["outliers", "amount", "upper"]


def test_nothing_to_do(spark):
    data = spark.createDataFrame(ROWS, SCHEMA)
    cleaned, report = w.clean_with_report(data, "id", w.Cleaning())
    assert cleaned.count() == 8 and facts(report) == {("rows", None, "rows_before"): 8, ("rows", None, "rows_after"): 8}
    cleaned, report = w.clean_with_report(data.where("false"), "id", w.Cleaning(drop_exact=True, text_columns=["name"], outlier_columns=["amount"]))
    assert cleaned.count() == 0 and facts(report)["outliers", "amount", "outlier_count"] == 0
