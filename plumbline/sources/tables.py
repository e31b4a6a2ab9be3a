"""Reading delimited text, reading missing markers as null, and finding the physical types."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Spellings of a missing value, compared after trimming.
MISSING_TOKENS = ["", "NA", "NaN", "null", "N/A", "na", "n/a"]
BOOLEAN_WORDS = ["true", "false"]
# Date layouts tried in this order, month before day, and what such a text looks like.
DATE_FORMATS = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "yyyy-M-d H:m:s": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
    "yyyy-M-d'T'H:m:s": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "yyyy/M/d H:m:s": r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "M/d/yyyy H:m:s": r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$",
    "M-d-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "M/d/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
    "M-d-yy": r"^\d{1,2}-\d{1,2}-\d{2}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
}
# ISO times with a fraction or a zone.
ISO_LIKE = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?( ?(Z|[+-]\d{1,2}:?\d{2}))?$"
DAY_FIRST_FORMATS = {
    (layout.replace("M/d/y", "d/M/y").replace("M-d-y", "d-M-y")): pattern for layout, pattern in DATE_FORMATS.items()
}


def read_delimited(
    spark: SparkSession, path: str | Sequence[str], delimiter: str | None = None, relaxed: bool = False, multi_line: bool = True
) -> DataFrame:
    """Read CSV, TSV or TXT files with a header, every column as text.

    A doubled quote inside quotes is a quote, and a backslash is an ordinary character. Quoted fields may
    hold newlines, for which each file is read by one task; ``multi_line=False`` splits large files, and is right
    only if no field holds a newline.

    Blanks after a delimiter are skipped. ``relaxed`` also takes ragged rows and loose quotes and
    leaves out rows without any value. An unknown extension is read as comma-separated.
    """
    first = path if isinstance(path, str) else path[0]
    if delimiter is None:
        delimiter = "\t" if first.lower().endswith(".tsv") else ","
    reader = (
        spark.read.option("header", True).option("sep", delimiter).option("inferSchema", False)
        .option("ignoreLeadingWhiteSpace", True).option("mode", "PERMISSIVE").option("multiLine", multi_line)
        .option("quote", '"').option("escape", '"')
    )
    if not relaxed:
        return reader.csv(path)
    loose = reader.option("unescapedQuoteHandling", "STOP_AT_DELIMITER").option("ignoreTrailingWhiteSpace", True)
    return loose.csv(path).dropna(how="all")


def read_table(spark: SparkSession, path: str | Sequence[str], delimiter: str | None = None, relaxed: bool = False) -> DataFrame:
    """Read delimited text, read missing markers as null and cast to the physical types found."""
    return cast_types(normalise_missing(read_delimited(spark, path, delimiter, relaxed)))


def present(column: Column, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    return F.when(~F.trim(column).isin(list(tokens)), column)


def normalise_missing(
    df: DataFrame, columns: Sequence[str] | None = None, tokens: Sequence[str] = MISSING_TOKENS
) -> DataFrame:
    """Missing markers in text and NaN in floating-point columns become null."""
    changes = {}
    for field in df.schema.fields:
        if columns is not None and field.name not in columns:
            continue
        if isinstance(field.dataType, T.StringType):
            changes[field.name] = present(F.col(field.name), tokens)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            changes[field.name] = F.nanvl(F.col(field.name), F.lit(None).cast(field.dataType))
    return df.withColumns(changes) if changes else df


def any_timestamp(column: Column, formats: dict[str, str] = DATE_FORMATS) -> Column:
    """The first layout that parses; null when none does.

    The look of the text is checked first, because a failed parse costs far more than a pattern.
    """
    iso = F.when(column.rlike(ISO_LIKE), column.try_cast("timestamp"))
    return F.coalesce(*[
        F.when(column.rlike(pattern), F.try_to_timestamp(column, F.lit(layout))) for layout, pattern in formats.items()
    ], iso)


def physical_types(df: DataFrame) -> DataFrame:
    """(column, type): bigint, double, boolean or string, whichever fits every present text value."""
    columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    checks = []
    for c in columns:
        value = F.trim(F.col(c))
        checks += [
            F.count(c).alias(f"n__{c}"),
            F.count(value.try_cast("bigint")).alias(f"whole__{c}"),
            F.count(value.try_cast("double")).alias(f"number__{c}"),
            F.count_if(F.lower(value).isin(BOOLEAN_WORDS)).alias(f"word__{c}"),
            F.count_if(value.rlike(r"^[+-]?\d+$")).alias(f"digits__{c}"),
        ]
    counts = df.agg(*checks)
    rows = []
    for c in columns:
        n = F.col(f"n__{c}")
        kind = (
            F.when(n == 0, "string")
            .when((F.col(f"whole__{c}") == n) & (F.col(f"digits__{c}") == n), "bigint")
            .when(F.col(f"number__{c}") == n, "double")
            .when(F.col(f"word__{c}") == n, "boolean")
            .otherwise("string")
        )
        rows.append(F.struct(F.lit(c).alias("column"), kind.alias("type"), n.alias("present")))
    return counts.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def cast_types(df: DataFrame) -> DataFrame:
    """Cast each text column to the physical type that fits all of its values."""
    if not any(isinstance(f.dataType, T.StringType) for f in df.schema.fields):
        return df
    found = {r["column"]: r["type"] for r in physical_types(df).collect()}
    return df.withColumns({
        c: F.trim(F.col(c)).try_cast(kind) for c, kind in found.items() if kind != "string"
    }) if any(kind != "string" for kind in found.values()) else df


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double; what cannot be read becomes null."""
    return df.withColumns({
        c: F.nanvl(F.trim(F.col(c).cast("string")).try_cast("double"), F.lit(None).cast("double")) for c in columns
    })


def sample_rows(df: DataFrame, order: Sequence[str], n: int = 100) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order).limit(n)


def sample_values(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None, n: int = 5) -> DataFrame:
    """(column, position, value): the first values of each column, as text."""
    columns = list(columns or df.columns)
    first = df.select(*columns, F.struct(*order).alias("_key")).orderBy("_key").limit(n)
    gathered = first.agg(F.array_sort(F.collect_list(F.struct(
        "_key", *[F.col(c).cast("string").alias(f"_v_{c}") for c in columns]
    ))).alias("rows"))
    parts = [F.struct(F.lit(c).alias("column"), F.col(f"rows._v_{c}").alias("values")) for c in columns]
    exploded = gathered.select(F.explode(F.array(*parts)).alias("_p"))
    return exploded.select("_p.column", F.posexplode("_p.values").alias("position", "value"))
