"""Scans, profiles, cleaning, duplicates and missing values."""

from pyspark.sql import functions as F

from plumbline.operators import clean as c, dedup as d, impute as m, neighbours as k, profile as p
from plumbline.plans.staging import scratch_path
from plumbline.sources import tables as s

from .common import r, rounded, table

SEGMENT = "CASE WHEN c_custkey % 3 = 0 THEN '  ' || lower(c_mktsegment) || ' ' ELSE c_mktsegment END"
PRIORITY = "CASE WHEN o_orderkey % 11 = 0 THEN 'N/A' ELSE o_orderpriority END"
BALANCE_TEXT = "CASE WHEN c_custkey % 7 = 0 THEN 'unknown' ELSE CAST(c_acctbal AS VARCHAR) END"
DATE_TEXT = "CASE WHEN o_orderkey % 50 = 0 THEN 'bad' ELSE {} END"
STATE_WORDS = ["'ny'", "'New York'", "'  texas '", "'Californa'", "'TX'", "'atlantis'", "'Virginia'", "'pennsylvnia'"]
STATE = "CASE c_custkey % 8 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(STATE_WORDS)) + " END"
EVENT_VALUE = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END"
EVENT_TYPE = "CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END"
QUANTITY = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END"
PRICE_GAPS = "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END"
GAP_KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
GAP_STEPS = [499, 491, 487, 479]
MEASURE_GAPS = {
    c: f"CASE WHEN l_orderkey % {n} = 0 THEN NULL ELSE {c} END"
    for c, n in zip(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], GAP_STEPS)
}
SIZE_GAPS = "CASE WHEN p_partkey % 17 = 5 THEN NULL ELSE p_size END"


def _spark(sql):
    return sql.replace("VARCHAR", "STRING")


# ---- scans ---------------------------------------------------------------------------------------

def _written(spark, df, label, **options):
    path = scratch_path(spark, label)
    df.write.options(header=True, **options).csv(path)
    return path


def scan_delimited(spark, folder):
    customers = table(spark, folder, "customer").withColumn("c_mktsegment", F.expr(SEGMENT))
    path = _written(spark, customers, "customers.csv", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    scanned = s.read_delimited(spark, path)
    return scanned.select("c_custkey", "c_name", F.length("c_mktsegment").alias("segment_length"))


def scan_typed(spark, folder):
    orders = table(spark, folder, "orders").withColumn("o_orderpriority", F.expr(PRIORITY)).drop("o_orderdate")
    scanned = s.read_table(spark, _written(spark, orders, "orders.tsv", sep="\t"), delimiter="\t")
    return rounded(scanned.groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.sum("o_custkey").alias("keys"), F.sum("o_totalprice").alias("total")
    ), 2)


def scan_relaxed(spark, folder):
    """Lines of different length: short rows are padded, blank rows are skipped."""
    customers = table(spark, folder, "customer")
    line = F.when(F.col("c_custkey") % 4 == 0, F.concat_ws(",", "c_custkey", "c_name")).when(
        F.col("c_custkey") % 4 == 1, F.lit("")
    ).otherwise(F.concat_ws(",", "c_custkey", "c_name", "c_nationkey", "c_mktsegment"))
    path = _written(
        spark, customers.select(line.alias("custkey,name,nation,segment")), "ragged.csv",
        quote="", sep="\u0001", emptyValue="",
    )
    rows = s.read_delimited(spark, path, relaxed=True)
    return rows.groupBy(F.col("segment").isNull().alias("short")).agg(
        F.count("*").alias("n"), F.count("nation").alias("nations"), F.min("name").alias("first")
    )


def missing_tokens(spark, folder):
    orders = table(spark, folder, "orders").withColumn("priority", F.expr(PRIORITY))
    clean = s.normalise_missing(orders.select("o_orderkey", "priority"))
    return clean.groupBy("priority").agg(F.count("*").alias("n"))


def physical_types(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("key"), F.expr(_spark(BALANCE_TEXT)).alias("balance"),
        F.col("c_acctbal").cast("string").alias("amount"), F.expr("CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'FALSE' END").alias("flag"),
    )
    return s.physical_types(customers)


def coerced_numbers(spark, folder):
    customers = table(spark, folder, "customer").withColumn("balance", F.expr(_spark(BALANCE_TEXT)))
    return rounded(s.coerce_numeric(customers, ["balance"]).select("c_custkey", "balance"), 2)


def first_rows(spark, folder):
    return rounded(s.sample_rows(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 100), 2)


def sample_values(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return rounded(s.sample_values(orders, ["o_orderkey"]))


# ---- profiles ------------------------------------------------------------------------------------

PROFILED = {
    "gender": "CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END",
    "region_code": "c_nationkey",
    "pain_level": "c_custkey % 11",
    "answer": "c_custkey % 5",
    "flag": "c_custkey % 2",
    "flag_gaps": "CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 2 END",
    "word": "CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'no ' END",
    "balance": "c_acctbal",
    "balance_gaps": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END",
    "constant": "7",
    "segment": "c_mktsegment",
    "mostly_missing": "CASE WHEN c_custkey % 10 = 0 THEN c_acctbal END",
}


def _profiled(spark, folder):
    return table(spark, folder, "customer").selectExpr(*[f"{e} AS {n}" for n, e in PROFILED.items()])


def column_profile(spark, folder):
    found = p.profile(_profiled(spark, folder))
    return rounded(found.select(
        "column", "type", "coded", "code_uncertain", "constant", "min", "max", "mean", "median", "null_count",
        "null_pct", F.concat_ws(",", "unique_values").alias("unique_values"),
    ))


def missing_report(spark, folder):
    return rounded(p.missing_report(p.profile(_profiled(spark, folder))), 2)


def usable_columns(spark, folder):
    return p.usable_columns(p.profile(_profiled(spark, folder))).select("column")


def value_types(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderstatus").alias("status"),
        (F.col("o_orderkey") % 2).cast("string").alias("bit"), (F.col("o_orderkey") % 7).cast("string").alias("weekday"),
        F.col("o_totalprice").cast("string").alias("total"), F.lit(None).cast("string").alias("nothing"),
        F.expr("CASE WHEN o_orderkey % 2 = 0 THEN 'Yes' ELSE 'No' END").alias("answer"),
        F.expr("concat('c', o_custkey)").alias("customer"),
    )
    return p.value_types(orders)


def missing_report_by_value(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.expr("CASE WHEN o_orderkey % 10 <> 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') END").alias("day"),
        F.expr("CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_totalprice AS STRING) END").alias("total"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END").alias("status"),
    )
    return rounded(p.missing_report_by_value(orders, p.value_types(orders)), 2)


def duplicate_row_count(spark, folder):
    return p.duplicate_row_count(table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


def _nation_book(spark, folder):
    return table(spark, folder, "nation").select(
        F.lit("c_nationkey").alias("column"), F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("label")
    )


def codebook_types(spark, folder):
    customers = table(spark, folder, "customer").select("c_nationkey", "c_acctbal")
    found = p.apply_codebook(p.profile(customers), _nation_book(spark, folder))
    return found.select("column", "type", "coded", "code_uncertain", F.coalesce(F.size("labels"), F.lit(0)).cast("bigint").alias("label_count"))


def codebook_labels(spark, folder):
    customers = table(spark, folder, "customer").withColumn(
        "c_nationkey", F.expr("CASE WHEN c_custkey % 20 = 0 THEN 99 ELSE c_nationkey END")
    )
    labelled = p.label_values(customers, _nation_book(spark, folder), ["c_nationkey"])
    return labelled.groupBy("c_nationkey_label").agg(F.count("*").alias("n"))


def detected_codes(spark, folder):
    found = p.profile(_profiled(spark, folder).select("answer", "flag", "balance"))
    doubtful = p.uncertain_columns(found).select(
        "column", F.lit(True).alias("is_coded"), F.create_map(F.lit("0"), F.lit("never")).alias("found_labels")
    )
    merged = p.merge_detected_codes(found, doubtful)
    return merged.select("column", "coded", "code_uncertain", F.coalesce(F.element_at("labels", F.lit("0")), F.lit("")).alias("label"))


# ---- cleaning ------------------------------------------------------------------------------------

def tidy_text(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.expr(SEGMENT).alias("segment"), F.expr("concat('  o''neil   ab-cd ', c_name)").alias("name")
    )
    return c.standardise_text(customers, ["segment", "name"])


def tidy_text_upper(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", F.expr(SEGMENT).alias("segment"))
    upper = c.standardise_text(customers, ["segment"], "upper")
    return upper.join(c.standardise_text(customers, ["segment"], "capitalize").withColumnRenamed("segment", "sentence"), "c_custkey")


def text_changes(spark, folder):
    return c.text_changes(table(spark, folder, "customer").select(F.expr(SEGMENT).alias("segment"), "c_name"), case="upper")


def states_exact(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", F.expr(STATE).alias("state"))
    full = c.standardise_states(customers, ["state"], fuzzy=False)
    return full.join(
        c.standardise_states(customers, ["state"], "abbrev", fuzzy=False).withColumnRenamed("state", "short"), "c_custkey"
    )


def states_similar(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", F.expr(STATE).alias("state"))
    return c.standardise_states(customers, ["state"]).groupBy("state").agg(F.count("*").alias("n"))


def _dated(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", F.expr(DATE_TEXT.format("date_format(o_orderdate, 'yyyy-MM-dd')")).alias("day"), "o_orderstatus"
    )


def date_parsing(spark, folder):
    parsed = c.parse_dates(_dated(spark, folder), ["day", "o_orderstatus"])
    return parsed.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def date_report(spark, folder):
    return c.date_report(_dated(spark, folder), ["day", "o_orderstatus"])


def known_typos(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", F.expr(SEGMENT).alias("segment"))
    fixed = c.correct_with(customers, {"segment": {"building": "HOUSES", "Machinery": "MACHINES"}})
    return fixed.groupBy("segment").agg(F.count("*").alias("n"))


def known_typos_joined(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", F.expr(SEGMENT).alias("segment"))
    names = table(spark, folder, "customer").select(
        F.lit("segment").alias("column"), F.col("c_mktsegment").alias("wrong"), F.expr("lower(c_mktsegment)").alias("right")
    ).distinct()
    fixed = c.correct_values(customers, names, ["segment"])
    return fixed.groupBy("segment").agg(F.count("*").alias("n"))


def likely_typos(spark, folder):
    """A value that occurs once and resembles a common one, in part types and customer names."""
    parts = table(spark, folder, "part").withColumn(
        "p_type", F.expr("CASE WHEN p_partkey = 13 THEN left(p_type, length(p_type) - 1) ELSE p_type END")
    )
    fixed = c.repair_typos(parts, ["p_type"])
    return fixed.groupBy("p_type").agg(F.count("*").alias("n"))


# ---- duplicates ----------------------------------------------------------------------------------

def _repeated(spark, folder):
    customers = table(spark, folder, "customer").withColumn("row", F.col("c_custkey"))
    return customers.union(customers.where("c_custkey % 10 = 0").withColumn("row", F.col("row") + 1_000_000_000))


def exact_duplicates(spark, folder):
    return d.duplicate_report(_repeated(spark, folder).drop("row"))


def duplicates_kept_first(spark, folder):
    return rounded(d.drop_duplicates(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], ["o_custkey"]), 2)


def duplicates_kept_last(spark, folder):
    kept = d.drop_duplicates(_repeated(spark, folder), ["row"], keep="last")
    return rounded(kept.select("row", "c_custkey", "c_acctbal"), 2)


def duplicates_kept_none(spark, folder):
    return rounded(d.drop_duplicates(_repeated(spark, folder), ["row"], keep="none").select("row", "c_custkey"))


def duplicate_documents(spark, folder):
    return d.duplicate_groups(table(spark, folder, "documents"), ["text"]).select(F.md5("text").alias("digest"), "copies")


def fuzzy_duplicates(spark, folder):
    """Near-duplicate names of parts; the price is kept out of the comparison."""
    return d.fuzzy_groups(table(spark, folder, "part"), "p_partkey", ["p_name", "p_type"])


def fuzzy_duplicates_dropped(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    return d.drop_fuzzy_duplicates(parts, "p_partkey", ["p_name", "p_brand"], keep="last")


def fuzzy_by_edits(spark, folder):
    """Near-duplicate names of parts by edit distance."""
    return d.fuzzy_groups(table(spark, folder, "part"), "p_partkey", ["p_name", "p_type"], form="levenshtein")


def fuzzy_by_edits_dropped(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand")
    return d.drop_fuzzy_duplicates(parts, "p_partkey", ["p_name", "p_brand"], keep="last", form="levenshtein")


# ---- missing values ------------------------------------------------------------------------------

def _gappy_events(spark, folder):
    return table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type", F.expr(EVENT_VALUE).alias("value"), F.expr(EVENT_TYPE).alias("kind")
    )


def rows_dropped(spark, folder):
    kept = m.apply_strategies(_gappy_events(spark, folder), {"value": "drop_rows", "kind": "drop_column"})
    return rounded(kept.drop("ts"))


def mean_filled(spark, folder):
    return rounded(m.fill_mean(_gappy_events(spark, folder), ["value"], ["event_type"]).select("event_id", "value"))


def median_filled(spark, folder):
    return rounded(m.fill_median(_gappy_events(spark, folder), ["value"]).select("event_id", "value"))


def mode_filled(spark, folder):
    return m.fill_mode(_gappy_events(spark, folder), ["kind"]).select("event_id", "kind")


def zero_filled(spark, folder):
    return rounded(m.fill_zero(_gappy_events(spark, folder), ["value"]).select("event_id", "value"))


def forward_filled(spark, folder):
    filled = m.fill_carried(_gappy_events(spark, folder), ["value"], ["ts", "event_id"], ["user_id"])
    return rounded(filled.select("event_id", "value"))


def backward_filled(spark, folder):
    filled = m.fill_carried(_gappy_events(spark, folder), ["value", "kind"], ["ts", "event_id"], forward=False)
    return rounded(filled.select("event_id", "value", "kind"))


def forward_filled_spread(spark, folder):
    """The same order without segments, stitched together from ranges."""
    filled = m.fill_carried(_gappy_events(spark, folder), ["value", "kind"], ["ts", "event_id"], task_rows=0)
    return rounded(filled.select("event_id", "value", "kind"))


def model_filled(spark, folder):
    lineitem = table(spark, folder, "lineitem").withColumns({"quantity": F.expr(QUANTITY), "flag": F.expr("CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END")})
    filled = m.fill_for_model(lineitem, "l_extendedprice", ["quantity", "flag"])
    return rounded(filled.groupBy("flag").agg(F.sum("quantity").alias("quantity"), F.count("*").alias("n")), 4)


def type_filled(spark, folder):
    events = _gappy_events(spark, folder)
    filled = m.fill_by_type(events, {"value": "ordinal", "kind": "categorical"})
    return rounded(filled.select("event_id", "value", "kind"))


def suggested_filled(spark, folder):
    data = _profiled(spark, folder).select("balance", "flag_gaps", "pain_level", "mostly_missing")
    filled = m.apply_suggested(data, p.missing_report(p.profile(data)))
    return rounded(filled.groupBy("pain_level").agg(F.sum("flag_gaps").alias("flags"), F.count("flag_gaps").alias("n")))


def neighbour_filled(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", F.expr(PRICE_GAPS).alias("price"), F.expr(SIZE_GAPS).alias("size"))
    filled = k.fill_nearest(parts, ["price", "size"], ["p_partkey"])
    return rounded(filled)


def neighbours_of_measures(spark, folder):
    """Four measures with gaps in each; only the filled rows are given."""
    rows = table(spark, folder, "lineitem").select(*GAP_KEY, *[F.expr(gap).alias(c) for c, gap in MEASURE_GAPS.items()])
    filled = k.fill_nearest(rows, list(MEASURE_GAPS), GAP_KEY)
    return rounded(filled.where(" OR ".join(f"l_orderkey % {n} = 0" for n in GAP_STEPS)))


def iterative_filled(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", F.expr(PRICE_GAPS).alias("price"), F.expr(SIZE_GAPS).alias("size"), F.col("p_partkey").cast("double").alias("key"))
    return rounded(m.fill_iterative(parts, ["price", "size", "key"]).select("p_partkey", "price", "size"))


def iterative_filled_line(spark, folder):
    """One gappy column: the chained equations settle on its least-squares line."""
    parts = table(spark, folder, "part").select("p_partkey", F.expr(PRICE_GAPS).alias("price"), F.col("p_partkey").cast("double").alias("key"))
    return rounded(m.fill_iterative(parts, ["price", "key"]).select("p_partkey", "price"), 4)


QUERIES = {
    f.__name__: f
    for f in (
        scan_delimited, scan_typed, scan_relaxed, missing_tokens, physical_types, coerced_numbers, first_rows, sample_values,
        column_profile, missing_report, usable_columns, value_types, missing_report_by_value, duplicate_row_count,
        codebook_types, codebook_labels, detected_codes, tidy_text, tidy_text_upper, text_changes, states_exact,
        states_similar, date_parsing, date_report, known_typos, known_typos_joined, likely_typos, exact_duplicates,
        duplicates_kept_first, duplicates_kept_last, duplicates_kept_none, duplicate_documents, fuzzy_duplicates,
        fuzzy_duplicates_dropped, rows_dropped, mean_filled, median_filled, mode_filled, zero_filled,
        forward_filled, backward_filled, forward_filled_spread, model_filled, type_filled, suggested_filled,
        neighbour_filled, neighbours_of_measures, iterative_filled, iterative_filled_line, fuzzy_by_edits, fuzzy_by_edits_dropped,
    )
}



def _edit_groups(*columns, threshold=0.9):
    """Greedy groups of the parts: pairs in order, where a row that follows another leads nobody."""
    tidy = ", ".join(f"lower(trim({c})) AS {c}" for c in columns)
    near = " AND ".join(
        f"1.0 - CAST(levenshtein(a.{c}, b.{c}) AS DOUBLE) / greatest(length(a.{c}), length(b.{c})) >= {threshold}" for c in columns
    )
    lengths = " AND ".join(f"least(length(a.{c}), length(b.{c})) >= {threshold} * greatest(length(a.{c}), length(b.{c})) - 1e-9" for c in columns)
    return f"""tidy AS (SELECT p_partkey, {tidy} FROM part),
reps AS (SELECT min(p_partkey) AS id, {", ".join(columns)} FROM tidy GROUP BY ALL),
pairs AS (SELECT a.id AS i, b.id AS j FROM reps a JOIN reps b ON a.id < b.id WHERE {lengths} AND {near}),
followers AS (
    SELECT unnest(list_reduce(list_prepend(CAST([] AS BIGINT[]), list([CAST(i AS BIGINT), CAST(j AS BIGINT)] ORDER BY i, j)),
        lambda acc, p: CASE WHEN list_contains(acc, p[1]) OR list_contains(acc, p[2]) THEN acc ELSE list_append(acc, p[2]) END)) AS id FROM pairs
),
led AS (SELECT j AS id, min(i) AS leader FROM pairs WHERE i NOT IN (SELECT id FROM followers) GROUP BY j),
assigned AS (
    SELECT tidy.p_partkey, coalesce(led.leader, reps.id) AS leader
    FROM tidy JOIN reps USING ({", ".join(columns)}) LEFT JOIN led ON led.id = reps.id
),
groups AS (SELECT p_partkey, leader FROM (SELECT *, count(*) OVER (PARTITION BY leader) AS size FROM assigned) WHERE size > 1)"""


_EVENTS = f"(SELECT event_id, ts, user_id, event_type, {EVENT_VALUE} AS value, {EVENT_TYPE} AS kind FROM events)"
_TITLE = "array_to_string(list_transform(regexp_extract_all(lower({}), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '')"
_TIDY = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_CODED = {
    # type, coded, uncertain, constant
    "gender": ("binary", True, False, False), "region_code": ("categorical", False, False, False),
    "pain_level": ("ordinal", True, False, False), "answer": ("ordinal", None, True, False),
    "flag": ("binary", False, False, False), "flag_gaps": ("ordinal", False, False, False),
    "word": ("binary", False, False, False), "balance": ("continuous", False, False, False),
    "balance_gaps": ("continuous", False, False, False), "constant": ("ordinal", True, False, True),
    "segment": ("categorical", False, False, False), "mostly_missing": ("continuous", False, False, False),
}


def _profile_sql():
    rows = []
    for name, e in PROFILED.items():
        kind, coded, uncertain, constant = _CODED[name]
        measured = kind in ("continuous", "ordinal")
        numbers = ", ".join(
            f"{r(f'{f}({e})') if measured else 'CAST(NULL AS DOUBLE)'} AS {alias}"
            for f, alias in (("min", "min"), ("max", "max"), ("avg", "mean"), ("median", "median"))
        )
        listed = kind not in ("continuous", "datetime")
        values = f"(SELECT coalesce(string_agg(CAST(v AS VARCHAR), ',' ORDER BY v), '') FROM (SELECT DISTINCT {e} AS v FROM customer))" if listed else "''"
        rows.append(f"""SELECT '{name}' AS "column", '{kind}' AS type, {'NULL' if coded is None else coded} AS coded,
          {uncertain} AS code_uncertain, {constant} AS constant, {numbers}, count(*) - count({e}) AS null_count,
          round(100.0 * (count(*) - count({e})) / count(*), 2) AS null_pct, {values} AS unique_values FROM customer""")
    return " UNION ALL ".join(rows)


def _missing_sql(where=""):
    return f"""SELECT "column", null_count, null_pct, CASE WHEN null_pct > 50 THEN 'drop_column'
      WHEN null_pct > 20 AND type = 'continuous' THEN 'knn' WHEN type = 'continuous' THEN 'mean'
      WHEN type = 'ordinal' THEN 'median' ELSE 'mode' END AS strategy, null_pct > 30 AND null_pct <= 50 AS warning,
      null_count > 0 AS requires_attention FROM ({_profile_sql()})"""


_STATES = {"ny": ("New York", "NY"), "New York": ("New York", "NY"), "texas": ("Texas", "TX"), "TX": ("Texas", "TX"), "Virginia": ("Virginia", "VA")}


def _state_case(short):
    whens = " ".join(f"WHEN '{k}' THEN '{v[short]}'" for k, v in _STATES.items())
    return f"CASE trim({STATE}) {whens} ELSE trim({STATE}) END"


_NEAREST = """(SELECT p_partkey, CAST({price} AS DOUBLE) AS price, CAST({size} AS DOUBLE) AS size FROM part)""".format(
    price=PRICE_GAPS, size=SIZE_GAPS
)


def _nearest(column, other):
    """Exact nearest rows by distance over the shared columns, ties to the smaller value."""
    return f"""(SELECT q.p_partkey, avg(v) AS v FROM (SELECT q.p_partkey, d.{column} AS v,
        row_number() OVER (PARTITION BY q.p_partkey ORDER BY
          sqrt((q.{other} - d.{other}) * (q.{other} - d.{other}) * 2 / 1), d.{column}) AS place
      FROM {_NEAREST} q JOIN {_NEAREST} d ON q.{column} IS NULL AND d.{column} IS NOT NULL
        AND q.{other} IS NOT NULL AND d.{other} IS NOT NULL) q WHERE place <= 5 GROUP BY q.p_partkey)"""


def _nearest_measure(target):
    """The mean of the five nearest rows that hold the measure, for each row without it."""
    squares = " + ".join(f"coalesce((q.{c} - d.{c}) * (q.{c} - d.{c}), 0.0)" for c in MEASURE_GAPS)
    shared = " + ".join(f"CASE WHEN q.{c} IS NULL OR d.{c} IS NULL THEN 0 ELSE 1 END" for c in MEASURE_GAPS)
    return f"""SELECT l_orderkey, l_linenumber, l_partkey, list_avg(list_transform(near, lambda x: x.v)) AS f_{target} FROM (
        SELECT q.l_orderkey, q.l_linenumber, q.l_partkey, min({{'d': sqrt(({squares}) * {len(MEASURE_GAPS)} / ({shared})), 'v': d.{target}}}, 5) AS near
        FROM asked q JOIN gaps d ON q.{target} IS NULL AND d.{target} IS NOT NULL AND ({shared}) > 0 GROUP BY ALL)"""


ORACLES = {
    "scan_delimited": f"""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
      CAST(length(ltrim({SEGMENT})) AS INTEGER) AS segment_length FROM customer""",
    "scan_typed": """SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
      count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
    "scan_relaxed": """SELECT c_custkey % 4 = 0 AS short, count(*) AS n, count(CASE WHEN c_custkey % 4 > 1 THEN 1 END) AS nations,
      min(c_name) AS first FROM customer WHERE c_custkey % 4 <> 1 GROUP BY 1""",
    "missing_tokens": """SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority,
      count(*) AS n FROM orders GROUP BY 1""",
    "physical_types": f"""SELECT 'key' AS "column", CASE WHEN count(TRY_CAST(CAST(c_custkey AS VARCHAR) AS BIGINT)) = count(*)
        THEN 'bigint' ELSE 'string' END AS type, count(*) AS present FROM customer
      UNION ALL SELECT 'balance', CASE WHEN count(TRY_CAST({BALANCE_TEXT} AS DOUBLE)) = count(*) THEN 'double' ELSE 'string' END, count(*) FROM customer
      UNION ALL SELECT 'amount', CASE WHEN count(TRY_CAST(CAST(c_acctbal AS VARCHAR) AS DOUBLE)) = count(*) THEN 'double' ELSE 'string' END, count(*) FROM customer
      UNION ALL SELECT 'flag', 'boolean', count(*) FROM customer""",
    "coerced_numbers": f"SELECT c_custkey, {r(f'TRY_CAST({BALANCE_TEXT} AS DOUBLE)', 2)} AS balance FROM customer",
    "first_rows": "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100",
    "sample_values": " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", row_number() OVER (ORDER BY o_orderkey) - 1 AS position, CAST({n} AS VARCHAR) AS value
        FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5)"""
        for n in ("o_orderkey", "o_custkey", "o_orderstatus")
    ),
    "column_profile": _profile_sql(),
    "missing_report": _missing_sql(),
    "usable_columns": f"""SELECT "column" FROM ({_profile_sql()}) WHERE null_pct <= 80""",
    "value_types": """SELECT unnest(['day', 'status', 'bit', 'weekday', 'total', 'nothing', 'answer', 'customer']) AS "column",
      unnest(['datetime', 'categorical', 'binary', 'ordinal', 'continuous', 'categorical', 'binary', 'categorical']) AS type""",
    "missing_report_by_value": " UNION ALL ".join(
        f"""SELECT '{n}' AS "column", count(*) - count({e}) AS null_count,
        round(100.0 * (count(*) - count({e})) / count(*), 2) AS null_pct,
        CASE WHEN 100.0 * (count(*) - count({e})) / count(*) > 50 THEN 'drop_column' ELSE '{f}' END AS strategy,
        100.0 * (count(*) - count({e})) / count(*) > 5 AS requires_attention FROM orders"""
        for n, e, f in (
            ("day", "CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END", "drop_rows"),
            ("total", "CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice END", "mean"),
            ("status", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END", "mode"),
        )
    ),
    "duplicate_row_count": """SELECT count(*) AS row_count, count(*) - (SELECT count(*) FROM (SELECT DISTINCT
      l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem)) AS duplicate_row_count FROM lineitem""",
    "codebook_types": """SELECT 'c_nationkey' AS "column", 'categorical' AS type, true AS coded, false AS code_uncertain,
      count(*) AS label_count FROM nation UNION ALL SELECT 'c_acctbal', 'continuous', false, false, 0""",
    "codebook_labels": """SELECT coalesce(n_name, '99') AS c_nationkey_label, count(*) AS n FROM customer
      LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 20 = 0 THEN 99 ELSE c_nationkey END GROUP BY 1""",
    "detected_codes": """SELECT 'answer' AS "column", true AS coded, false AS code_uncertain, 'never' AS label
      UNION ALL SELECT 'flag', false, false, '' UNION ALL SELECT 'balance', false, false, ''""",
    "tidy_text": f"""SELECT c_custkey, {_TITLE.format(_TIDY.format(SEGMENT))} AS segment,
      {_TITLE.format(_TIDY.format("'  o''neil   ab-cd ' || c_name"))} AS name FROM customer""",
    "tidy_text_upper": f"""SELECT c_custkey, upper({_TIDY.format(SEGMENT)}) AS segment,
      upper({_TIDY.format(SEGMENT)}[1]) || lower({_TIDY.format(SEGMENT)}[2:]) AS sentence FROM customer""",
    "text_changes": f"""SELECT 'segment' AS "column", count(*) FILTER (WHERE s <> upper({_TIDY.format('s')})) AS values_changed,
        count(DISTINCT s) AS old_unique_count, count(DISTINCT upper({_TIDY.format('s')})) AS new_unique_count
      FROM (SELECT {SEGMENT} AS s FROM customer)
      UNION ALL SELECT 'c_name', count(*) FILTER (WHERE c_name <> upper(c_name)), count(DISTINCT c_name),
        count(DISTINCT upper(c_name)) FROM customer""",
    "states_exact": f"SELECT c_custkey, {_state_case(0)} AS state, {_state_case(1)} AS short FROM customer",
    "date_parsing": """SELECT strftime(CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END, '%Y-%m') AS month,
      count(*) AS n FROM orders GROUP BY 1""",
    "date_report": """SELECT 'day' AS "column", count(*) FILTER (WHERE o_orderkey % 50 <> 0) AS parsed,
      count(*) FILTER (WHERE o_orderkey % 50 = 0) AS failed, true AS accepted FROM orders""",
    "known_typos": f"""SELECT CASE lower(trim({SEGMENT})) WHEN 'building' THEN 'HOUSES' WHEN 'machinery' THEN 'MACHINES'
      ELSE {SEGMENT} END AS segment, count(*) AS n FROM customer GROUP BY 1""",
    "known_typos_joined": "SELECT lower(c_mktsegment) AS segment, count(*) AS n FROM customer GROUP BY 1",
    "likely_typos": "SELECT p_type, count(*) AS n FROM part GROUP BY 1",
    "exact_duplicates": """SELECT count(*) AS total_rows, count(*) - count(DISTINCT c_custkey) AS exact_duplicate_count,
      count(DISTINCT c_custkey) AS rows_remaining
      FROM (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey % 10 = 0)""",
    "duplicates_kept_first": """SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
    "duplicates_kept_last": """SELECT CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS row,
      c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer""",
    "duplicates_kept_none": "SELECT c_custkey AS row, c_custkey FROM customer WHERE c_custkey % 10 <> 0",
    "duplicate_documents": "SELECT md5(text) AS digest, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1",
    "rows_dropped": f"SELECT event_id, user_id, event_type, {r('value')} AS value FROM {_EVENTS} WHERE value IS NOT NULL",
    "mean_filled": f"""SELECT event_id, {r('coalesce(value, avg(value) OVER (PARTITION BY event_type))')} AS value FROM {_EVENTS}""",
    "median_filled": f"SELECT event_id, {r(f'coalesce(value, (SELECT median(value) FROM {_EVENTS}))')} AS value FROM {_EVENTS}",
    "mode_filled": f"""SELECT event_id, coalesce(kind, (SELECT kind FROM {_EVENTS} WHERE kind IS NOT NULL GROUP BY kind
      ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM {_EVENTS}""",
    "zero_filled": f"SELECT event_id, {r('coalesce(value, 0)')} AS value FROM {_EVENTS}",
    "forward_filled": f"""SELECT event_id, {r('last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)')} AS value FROM {_EVENTS}""",
    "backward_filled": f"""SELECT event_id,
      {r('last_value(value IGNORE NULLS) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING)')} AS value,
      last_value(kind IGNORE NULLS) OVER (ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS kind FROM {_EVENTS}""",
    "forward_filled_spread": f"""SELECT event_id,
      {r('last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)')} AS value,
      last_value(kind IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS kind FROM {_EVENTS}""",
    "model_filled": f"""SELECT coalesce(f, (SELECT l_returnflag FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1
        ORDER BY count(*) DESC, 1 LIMIT 1)) AS flag, round(sum(coalesce(q, m)), 4) AS quantity, count(*) AS n
      FROM (SELECT {QUANTITY} AS q, avg({QUANTITY}) OVER () AS m, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_returnflag END AS f
        FROM lineitem) GROUP BY 1""",
    "type_filled": f"""SELECT event_id, {r(f'coalesce(value, (SELECT median(value) FROM {_EVENTS}))')} AS value,
      coalesce(kind, (SELECT kind FROM {_EVENTS} WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind
      FROM {_EVENTS}""",
    "suggested_filled": f"""SELECT c_custkey % 11 AS pain_level, CAST(sum(coalesce(f, md)) AS DOUBLE) AS flags, count(*) AS n
      FROM (SELECT c_custkey, {PROFILED['flag_gaps']} AS f, (SELECT median({PROFILED['flag_gaps']}) FROM customer) AS md FROM customer)
      GROUP BY 1""",
    "neighbour_filled": f"""SELECT p.p_partkey,
        {r('coalesce(p.price, a.v, (SELECT avg(price) FROM ' + _NEAREST + '))')} AS price,
        {r('coalesce(p.size, b.v, (SELECT avg(size) FROM ' + _NEAREST + '))')} AS size
      FROM {_NEAREST} p LEFT JOIN {_nearest('price', 'size')} a ON a.p_partkey = p.p_partkey
      LEFT JOIN {_nearest('size', 'price')} b ON b.p_partkey = p.p_partkey""",
    "neighbours_of_measures": f"""WITH gaps AS (
        SELECT l_orderkey, l_linenumber, l_partkey, {", ".join(f"{gap} AS {c}" for c, gap in MEASURE_GAPS.items())} FROM lineitem
      ),
      asked AS (SELECT * FROM gaps WHERE {" OR ".join(f"l_orderkey % {n} = 0" for n in GAP_STEPS)})
      SELECT q.l_orderkey, CAST(q.l_linenumber AS BIGINT) AS l_linenumber, l_partkey, {", ".join(r(f"coalesce(q.{c}, f_{c}, (SELECT avg({c}) FROM gaps))") + f" AS {c}" for c in MEASURE_GAPS)}
      FROM asked q {" ".join(f"LEFT JOIN ({_nearest_measure(c)}) USING (l_orderkey, l_linenumber, l_partkey)" for c in MEASURE_GAPS)}""",
    "fuzzy_by_edits": f"WITH {_edit_groups('p_name', 'p_type')} SELECT p_partkey, leader FROM groups",
    "fuzzy_by_edits_dropped": f"""WITH {_edit_groups('p_name', 'p_brand')}
      SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey NOT IN (
        SELECT p_partkey FROM groups WHERE p_partkey NOT IN (SELECT max(p_partkey) FROM groups GROUP BY leader))""",
    "iterative_filled_line": f"""SELECT p_partkey, {r('coalesce(price, a + b * p_partkey)', 4)} AS price
      FROM (SELECT p_partkey, {PRICE_GAPS} AS price FROM part),
        (SELECT regr_intercept(price, p_partkey) AS a, regr_slope(price, p_partkey) AS b FROM (SELECT p_partkey, {PRICE_GAPS} AS price FROM part))""",
}
