"""Column profiles: meaning, codes, missing values, duplicates and labels."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.names import hints
from ..plans.quantiles import wide_percentiles
from ..plans.segments import BUFFER_VALUES, small, stack_columns
from ..sources.tables import any_timestamp

FEW_VALUES = 15
# Numbers without a hint in their name are continuous, and not listed, above this many distinct values (by sketch).
LISTED_VALUES = 50
# Most values (by sketch) that one row of a profile lists; ``value_rows`` gives those of wider columns.
ROW_VALUES = 100_000
# Fixed values.
BOOLEAN_WORDS = ["true", "yes", "1", "false", "no", "0"]
BINARY_WORDS_ONLY = ["true", "false", "0", "1", "yes", "no"]
CODE_MAX = 30
UNCERTAIN_MAX = 20
CODES_NOTE = "discrete codes"
CONSTANT_NOTE = "constant column"
CODEBOOK_NOTE = "labelled by codebook"
DETECTED_NOTE = "labelled by detection"
DATE_PATTERN = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{1,2}\s[A-Za-z]{3}\s\d{4}"

_FIELDS = ["count", "null_count", "rough", "low", "high", "mean", "median", "whole", "bits", "small"]


def _kind(field: T.StructField) -> str:
    if isinstance(field.dataType, (T.NumericType, T.BooleanType)):
        return "numeric"
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "text"


def _number(field: T.StructField) -> Column:
    if _kind(field) == "text":
        value = F.col(field.name).try_cast("double")
    elif _kind(field) == "datetime":
        return F.lit(None).cast("double")
    else:
        value = F.col(field.name).cast("double")
    return F.nanvl(value, F.lit(None).cast("double"))


def _seen(field: T.StructField) -> Column:
    """The value with NaN read as missing."""
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(F.col(field.name), F.lit(None).cast(field.dataType))
    return F.col(field.name)


def value_rows(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """(column, value, number): every distinct value of the columns as a row, where a list would be too long for one."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(f.name).alias("column"), _seen(f).cast("string").alias("value"), _number(f).alias("number"))
        for f in fields
    ]))
    return df.select(cells.alias("_c")).select("_c.*").where(F.col("value").isNotNull()).distinct()


def _listed(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """(column, distinct_values, unique_values, words): exact facts about columns; dates are counted but not listed."""
    values = value_rows(df, fields)
    listed = F.col("column").isin([f.name for f in fields if _kind(f) != "datetime"])
    cleaned = F.lower(F.trim(F.col("value")))
    return values.groupBy("column").agg(
        F.count("*").alias("distinct_values"),
        F.transform(F.array_sort(F.collect_list(F.when(listed, F.struct("number", "value")))), lambda v: v["value"]).alias("unique_values"),
        F.count_distinct(F.when(cleaned != "", cleaned)).alias("cleaned_values"),
        F.bool_and((cleaned == "") | cleaned.isin(BOOLEAN_WORDS)).alias("words"),
    )


def _counted(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """The same without lists: counts only, merged by value, so that a column may have any number of values."""
    cleaned = F.lower(F.trim(F.col("value")))
    merged = value_rows(df, fields).groupBy("column", cleaned.alias("cleaned")).agg(F.count("*").alias("n"))
    return merged.groupBy("column").agg(
        F.sum("n").alias("distinct_values"), F.lit(None).cast("array<string>").alias("unique_values"), F.count_if(F.col("cleaned") != "").alias("cleaned_values"),
        F.bool_and((F.col("cleaned") == "") | F.col("cleaned").isin(BOOLEAN_WORDS)).alias("words"),
    )


def profile(df: DataFrame, count_null: bool = True, bound: int = BUFFER_VALUES, row_values: int = ROW_VALUES) -> DataFrame:
    """One row per column: semantic type, code flags, missing values and basic measures.

    ``count_null`` counts a missing value as one more distinct value when the type is decided, so a
    0/1 column with gaps is ordinal; without it such a column is binary. ``distinct_count`` is exact but for
    continuous columns, where it is a sketch; ``unique_values`` holds every value of columns that are neither
    continuous nor dates. Above about ``row_values`` values it is null, and ``value_rows`` gives the values as rows.
    """
    fields = df.schema.fields
    rough = df.agg(*[F.approx_count_distinct(_seen(f)).alias(f.name) for f in fields]).first()
    numeric = [f.name for f in fields if _kind(f) == "numeric" and not isinstance(f.dataType, T.BooleanType)]
    held = all(rough[c] * 1.2 <= bound for c in numeric)
    aggregates = []
    for f in fields:
        c, v = f.name, _number(f)
        aggregates += [
            F.count(_seen(f)).alias(f"count__{c}"),
            (F.count(F.lit(1)) - F.count(_seen(f))).alias(f"null_count__{c}"),
            F.lit(rough[c]).cast("long").alias(f"rough__{c}"),
            F.min(v).alias(f"low__{c}"), F.max(v).alias(f"high__{c}"), F.avg(v).alias(f"mean__{c}"),
            F.bool_and(v == F.floor(v)).alias(f"whole__{c}"),
            F.bool_and(v.isin(0.0, 1.0)).alias(f"bits__{c}"),
            F.bool_and((v != F.floor(v)) | v.between(0.0, float(UNCERTAIN_MAX))).alias(f"small__{c}"),
        ]
        if held or c not in numeric:
            middle = F.percentile(v, F.lit(0.5)) if c in numeric else F.lit(None).cast("double")
            aggregates.append(middle.alias(f"median__{c}"))
    wide = df.agg(*aggregates)
    if not held:
        medians = wide_percentiles(df, numeric, [0.5])
        row = medians.first()
        wide = wide.withColumns({f"median__{c}": F.lit(row[f"pct__{c}"][0]).cast("double") for c in numeric})
    names = [f.name for f in fields]
    facts = stack_columns(wide, names, _FIELDS)
    few = [f for f in fields if _kind(f) != "numeric" or any(hints(f.name)[1:3]) or rough[f.name] <= LISTED_VALUES]
    if few:
        wide = [f for f in few if _kind(f) != "datetime" and rough[f.name] > row_values]
        parts = [part(df, own) for part, own in ((_listed, [f for f in few if f not in wide]), (_counted, wide)) if own]
        facts = facts.join(reduce(DataFrame.unionByName, parts).withColumnRenamed("column", "_c"), F.col("column") == F.col("_c"), "left").drop("_c")
    else:
        facts = facts.withColumns({
            "distinct_values": F.lit(None).cast("long"), "unique_values": F.lit(None).cast("array<string>"),
            "cleaned_values": F.lit(None).cast("long"), "words": F.lit(None).cast("boolean"),
        })

    def by_name(value_of):
        choice = F.lit(None)
        for f in fields:
            choice = F.when(F.col("column") == f.name, F.lit(value_of(f))).otherwise(choice)
        return choice

    known = facts.withColumns({
        "position": by_name(lambda f: names.index(f.name)),
        "kind": by_name(_kind),
        "says_binary": by_name(lambda f: hints(f.name)[0]),
        "says_category": by_name(lambda f: hints(f.name)[1]),
        "says_order": by_name(lambda f: hints(f.name)[2]),
        "distinct_count": F.coalesce("distinct_values", "rough"),
    })
    return _decide(known, count_null)


def _decide(facts: DataFrame, count_null: bool) -> DataFrame:
    distinct = F.col("distinct_count")
    if count_null:
        distinct = distinct + F.when(F.col("null_count") > 0, 1).otherwise(0)
    numeric_type = (
        F.when(F.col("says_binary") & (distinct == 2), "binary")
        .when(F.col("says_category") & ~F.col("says_order"), "categorical")
        .when(F.col("says_order"), "ordinal")
        .when((distinct == 2) & F.coalesce(F.col("bits"), F.lit(True)), "binary")
        .when(distinct <= FEW_VALUES, "ordinal")
        .otherwise("continuous")
    )
    text_type = F.when(
        F.col("cleaned_values").between(1, 2) & F.coalesce(F.col("words"), F.lit(False)), "binary"
    ).otherwise("categorical")
    hinted = F.col("says_binary") | F.col("says_category") | F.col("says_order")
    low_values = F.coalesce(F.col("high") <= CODE_MAX, F.lit(False))
    typed = facts.withColumns({
        "type": F.when(F.col("kind") == "datetime", "datetime").when(F.col("kind") == "numeric", numeric_type).otherwise(text_type),
        "_distinct": distinct,
    })
    measured = F.col("type").isin("continuous", "ordinal")
    codable = ~F.col("type").isin("datetime", "categorical")
    codes = codable & ((F.col("says_binary") & (F.col("_distinct") == 2)) | (hinted & low_values))
    two_bits = F.coalesce(F.col("bits"), F.lit(False)) & (F.col("distinct_values") == 2)
    uncertain = (
        codable & ~codes & ~hinted & ~F.coalesce(two_bits, F.lit(False)) & (F.col("kind") == "numeric")
        & F.coalesce(F.col("whole") & F.col("small"), F.lit(False))
        & F.col("_distinct").between(2, FEW_VALUES) & low_values
    )
    constant = measured & (F.col("count") > 0) & (F.col("distinct_count") <= 1)
    total = F.col("count") + F.col("null_count")
    return typed.select(
        "column", "position", "type",
        F.when(constant | codes, True).when(uncertain, F.lit(None)).otherwise(False).alias("coded"),
        F.when(constant, CONSTANT_NOTE).when(codes, CODES_NOTE).alias("code_note"),
        uncertain.alias("code_uncertain"),
        constant.alias("constant"),
        F.when(~F.col("type").isin("continuous", "datetime"), F.col("unique_values")).alias("unique_values"),
        F.col("distinct_count").cast("long").alias("distinct_count"),
        F.when(measured, F.col("low")).alias("min"), F.when(measured, F.col("high")).alias("max"),
        F.when(measured, F.col("mean")).alias("mean"), F.when(measured, F.col("median")).alias("median"),
        F.col("null_count"),
        F.round(F.col("null_count") / F.greatest(total, F.lit(1)) * 100, 2).alias("null_pct"),
        total.alias("row_count"),
        F.lit(None).cast("map<string,string>").alias("labels"),
    )


def table_facts(df: DataFrame) -> DataFrame:
    """(row_count, column_count, duplicate_row_count) of the table."""
    return duplicate_row_count(df).withColumn("column_count", F.lit(len(df.columns)).cast("long"))


def duplicate_row_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """(row_count, duplicate_row_count): repeats beyond the first; missing values count as equal."""
    groups = df.groupBy(*(subset or df.columns)).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_row_count"),
    )


def value_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, type) judged from the text of the values alone."""
    columns = list(columns or df.columns)
    texts = {c: F.trim(F.col(c).cast("string")) for c in columns}
    rough = df.agg(*[F.approx_count_distinct(texts[c]).alias(c) for c in columns]).first()
    checks = []
    for c, text in texts.items():
        dates = F.coalesce(text.rlike(DATE_PATTERN) & any_timestamp(text).isNotNull(), F.lit(False))
        checks += [
            F.count(text).alias(f"n__{c}"),
            F.bool_and(F.when(text.isNotNull(), dates)).alias(f"dates__{c}"),
            F.bool_and(F.when(text.isNotNull(), text.try_cast("double").isNotNull())).alias(f"numbers__{c}"),
            F.bool_and(text.try_cast("double").isin(0.0, 1.0)).alias(f"bits__{c}"),
            F.bool_and(F.lower(text).isin(BINARY_WORDS_ONLY)).alias(f"words__{c}"),
        ]
    facts = stack_columns(df.agg(*checks), columns, ["n", "dates", "numbers", "bits", "words"])
    few = [c for c in columns if rough[c] <= LISTED_VALUES]
    counted = None
    if few:
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), texts[c].alias("value")) for c in few]))
        counted = df.select(cells.alias("_x")).select("_x.*").where(F.col("value").isNotNull()).distinct().groupBy("_c").agg(
            F.count("*").alias("distinct")
        )
        facts = facts.join(counted, F.col("column") == F.col("_c"), "left").drop("_c")
    else:
        facts = facts.withColumn("distinct", F.lit(None).cast("long"))
    distinct = F.coalesce(F.col("distinct"), F.lit(LISTED_VALUES + 1))
    kind = (
        F.when(F.col("n") == 0, "categorical")
        .when(F.col("dates"), "datetime")
        .when((distinct == 2) & F.col("numbers") & F.col("bits"), "binary")
        .when((distinct == 2) & ~F.col("numbers") & F.col("words"), "binary")
        .when((distinct <= FEW_VALUES) & F.col("numbers"), "ordinal")
        .when(distinct <= FEW_VALUES, "categorical")
        .when(F.col("numbers"), "continuous")
        .otherwise("categorical")
    )
    return facts.select("column", kind.alias("type"))


def missing_report(profiled: DataFrame) -> DataFrame:
    """(column, null_count, null_pct, strategy, warning, requires_attention)."""
    share, kind = F.col("null_pct"), F.col("type")
    strategy = (
        F.when(share > 50, "drop_column")
        .when((share > 20) & (kind == "continuous"), "knn")
        .when(kind == "continuous", "mean")
        .when(kind == "ordinal", "median")
        .otherwise("mode")
    )
    return profiled.select(
        "column", "null_count", "null_pct", strategy.alias("strategy"),
        ((share > 30) & (share <= 50)).alias("warning"), (F.col("null_count") > 0).alias("requires_attention"),
    )


def missing_report_by_value(
    df: DataFrame, types: DataFrame, drop_above: float = 50.0, attention_above: float = 5.0
) -> DataFrame:
    """The report for value-judged types: dates drop rows, attention starts at a share of missing values."""
    names = [r["column"] for r in types.select("column").collect()]
    wide = df.agg(*[
        a for c in names for a in (
            F.count_if(F.col(c).isNull()).alias(f"null_count__{c}"),
            (F.avg(F.col(c).isNull().cast("double")) * 100).alias(f"null_pct__{c}"),
        )
    ])
    shares = stack_columns(wide, names, ["null_count", "null_pct"])
    joined = shares.join(types, "column")
    strategy = (
        F.when(F.col("null_pct") > drop_above, "drop_column").when(F.col("type") == "continuous", "mean")
        .when(F.col("type") == "ordinal", "median").when(F.col("type") == "datetime", "drop_rows").otherwise("mode")
    )
    return joined.select(
        "column", "null_count", "null_pct", strategy.alias("strategy"),
        (F.col("null_pct") > attention_above).alias("requires_attention"),
    )


def usable_columns(profiled: DataFrame, max_null_share: float = 0.8) -> DataFrame:
    """The profile rows of the columns that are not mostly missing."""
    return profiled.where(F.col("null_pct") <= max_null_share * 100)


def _label_maps(codebook: DataFrame) -> DataFrame:
    """(column, labels) from (column, code, label); one code per row, so the map has unique keys."""
    unique = codebook.groupBy("column", F.col("code").cast("string").alias("code")).agg(F.max("label").alias("label"))
    return unique.groupBy("column").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "label")))).alias("_labels"),
        F.count_distinct("label").alias("_label_count"),
    )


def apply_codebook(profiled: DataFrame, codebook: DataFrame) -> DataFrame:
    """Attach labels (column, code, label); a labelled continuous column becomes categorical or binary."""
    joined = profiled.join(_label_maps(codebook), "column", "left")
    hit = F.col("_labels").isNotNull()
    retyped = F.when(F.col("_label_count") > 2, "categorical").otherwise("binary")
    return joined.withColumns({
        "labels": F.coalesce("_labels", "labels"),
        "coded": F.when(hit, True).otherwise(F.col("coded")),
        "code_note": F.when(hit, CODEBOOK_NOTE).otherwise(F.col("code_note")),
        "code_uncertain": F.when(hit, False).otherwise(F.col("code_uncertain")),
        "type": F.when(hit & (F.col("type") == "continuous"), retyped).otherwise(F.col("type")),
    }).drop("_labels", "_label_count")


def label_values(df: DataFrame, codebook: DataFrame, columns: Sequence[str], suffix: str = "_label") -> DataFrame:
    """Add the label of each coded value, or the value itself as text."""
    result = df
    for c in columns:
        labels = codebook.where(F.col("column") == c).groupBy(F.col("code").cast("string").alias("_code")).agg(
            F.max("label").alias("_label")
        )
        text = F.col(c).cast("string")
        result = result.join(small(labels), text == F.col("_code"), "left")
        result = result.withColumn(f"{c}{suffix}", F.coalesce("_label", text)).drop("_code", "_label")
    return result


def merge_detected_codes(profiled: DataFrame, detected: DataFrame) -> DataFrame:
    """Merge (column, is_coded, found_labels): sets the code flag, clears doubt, adopts labels if any."""
    renamed = detected.select("column", "is_coded", "found_labels", F.lit(True).alias("_hit"))
    joined = profiled.join(renamed, "column", "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    offered = F.col("found_labels").isNotNull() & (F.size("found_labels") > 0)
    return joined.withColumns({
        "coded": F.when(hit, F.col("labels").isNotNull() | F.col("is_coded")).otherwise(F.col("coded")),
        "code_uncertain": F.when(hit, False).otherwise(F.col("code_uncertain")),
        "code_note": F.when(hit & F.col("is_coded") & offered, DETECTED_NOTE).otherwise(F.col("code_note")),
        "labels": F.when(hit & offered, F.col("found_labels")).otherwise(F.col("labels")),
    }).drop("_hit", "is_coded", "found_labels")


def uncertain_columns(profiled: DataFrame) -> DataFrame:
    return profiled.where("code_uncertain").select("column")
