"""Quotes, newlines, delimiters and backslashes inside quoted fields."""

from plumbline.sources.tables import read_delimited


def test_quoted_fields(spark, tmp_path):
    fields = ['Smith, "Jo"', "two\nlines", "c:\\", "plain"]
    lines = ["id,name", *(f'{i},"{f.replace(chr(34), chr(34) * 2)}"' for i, f in enumerate(fields))]
    (tmp_path / "t.csv").write_text("\n".join(lines) + "\n")
    found = read_delimited(spark, f"file://{tmp_path}/t.csv").orderBy("id").collect()
    assert [r.name for r in found] == fields
