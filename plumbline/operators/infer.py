"""Correlations, hypothesis tests and least-squares regression, per table or per segment."""

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.bands import correlation_label
from ..functions.distributions import chi2_pvalue, f_pvalue, t_pvalue
from ..functions.linalg import least_squares
from ..plans.moments import complete_moments, pairwise_sums
from ..plans.order import average_ranks
from ..plans.segments import TASK_ROWS, attach, largest_group, measure, numeric_columns
from ..plans.staging import cut

FEW_VALUES = 15
MANY_PAIRS = 30
ALPHA = 0.05
Z_95 = 1.96


# ---- correlation ---------------------------------------------------------------------------------

def _pair_rows(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str]) -> DataFrame:
    """(by..., column_a, column_b, x, y): one row per pair and complete row."""
    structs = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), measure(a).alias("x"), measure(b).alias("y"))
        for a, b in pairs
    ]
    return df.select(*by, F.explode(F.array(*structs)).alias("_p")).select(*by, "_p.*").dropna(subset=["x", "y"])


def _few_valued(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> set[tuple[str, str]]:
    """Pairs in which a side has at most 15 distinct values among the complete rows."""
    sketches = {}
    for i, (a, b) in enumerate(pairs):
        both = measure(a).isNotNull() & measure(b).isNotNull()
        sketches[f"a{i}"] = F.approx_count_distinct(F.when(both, measure(a)))
        sketches[f"b{i}"] = F.approx_count_distinct(F.when(both, measure(b)))
    rough = df.agg(*[e.alias(k) for k, e in sketches.items()]).first()
    # Only columns near the limit are counted exactly, and those have few values by then.
    near = [i for i in range(len(pairs)) if min(rough[f"a{i}"], rough[f"b{i}"]) <= 2 * FEW_VALUES]
    if not near:
        return set()
    rows = _pair_rows(df, [pairs[i] for i in near], [])
    sides = []
    for side, column in (("a", "x"), ("b", "y")):
        wanted = [pairs[i] for i in near if rough[f"{side}{i}"] <= 2 * FEW_VALUES]
        if wanted:
            names = [f"{a}\x00{b}" for a, b in wanted]
            chosen = rows.where(F.concat_ws("\x00", "column_a", "column_b").isin(names))
            values = chosen.select("column_a", "column_b", F.col(column).alias("value")).distinct()
            sides.append(values.groupBy("column_a", "column_b").count().where(F.col("count") <= FEW_VALUES))
    few = set()
    for counted in sides:
        few |= {(r["column_a"], r["column_b"]) for r in counted.collect()}
    return few


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_a, column_b, n, r) over pairwise complete rows, all pairs in one pass."""
    # From covariances rather than corr, which fails on a constant side.
    used = sorted({c for pair in pairs for c in pair})
    narrow = df.select(*by, *[measure(c).alias(f"_v{i}") for i, c in enumerate(used)])
    if len(pairs) > MANY_PAIRS and not by:
        return _matrix_pearson(narrow, pairs, used)
    place = {c: F.col(f"_v{i}") for i, c in enumerate(used)}
    aggregates = []
    for i, (a, b) in enumerate(pairs):
        both = place[a].isNotNull() & place[b].isNotNull()
        x, y = F.when(both, place[a]), F.when(both, place[b])
        spread = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
        varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        r = F.when(varies, F.greatest(F.least(F.covar_pop(x, y) / spread, F.lit(1.0)), F.lit(-1.0)))
        aggregates += [F.count_if(both).alias(f"n{i}"), r.alias(f"r{i}")]
    wide = narrow.groupBy(*by).agg(*aggregates)
    rows = [
        F.struct(
            F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
            F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return wide.select(*by, F.explode(F.array(*rows)).alias("_p")).select(*by, "_p.*")


def _matrix_pearson(narrow: DataFrame, pairs: Sequence[tuple[str, str]], used: list[str]) -> DataFrame:
    """The same from matrix products, for very many pairs."""
    place = {c: i for i, c in enumerate(used)}
    wanted = F.explode(F.array(*[
        F.struct(
            F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
            F.lit(min(place[a], place[b])).alias("i"), F.lit(max(place[a], place[b])).alias("j"),
        )
        for a, b in pairs
    ]))
    sums = pairwise_sums(narrow, [f"_v{i}" for i in range(len(used))])
    listed = sums.where((F.col("i") == 0) & (F.col("j") == 0)).select(wanted.alias("_p")).select("_p.*")
    n = F.nullif(F.col("n"), F.lit(0.0))
    x = F.col("sxx") - F.col("sx") * F.col("sx") / n
    y = F.col("syy") - F.col("sy") * F.col("sy") / n
    cross = F.col("sxy") - F.col("sx") * F.col("sy") / n
    # What remains of a constant column after centring is rounding noise.
    varies = (x > 1e-12 * F.col("sxx")) & (y > 1e-12 * F.col("syy"))
    r = F.when(varies, F.greatest(F.least(cross / (F.sqrt(x) * F.sqrt(y)), F.lit(1.0)), F.lit(-1.0)))
    return listed.join(sums, ["i", "j"]).select("column_a", "column_b", F.col("n").cast("long").alias("n"), r.alias("r"))


def _rank_columns(df: DataFrame, columns: Sequence[str], by: Sequence[str], task_rows: int) -> DataFrame:
    """(by..., _r0, _r1, ...): the average ranks of complete columns, from one dictionary of ranks a column."""
    narrow = df.select(*by, *[measure(c).alias(f"_v{i}") for i, c in enumerate(columns)])
    fits = True if largest_group(df, by) <= task_rows else None
    for i in range(len(columns)):
        ranks = cut(average_ranks(narrow.select(*by, f"_v{i}"), f"_v{i}", by, f"_r{i}", task_rows, fits).drop("n_value"))
        narrow = attach(narrow, ranks, [*by, f"_v{i}"], "inner").drop(f"_v{i}")
    return narrow


def spearman(
    df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = (), task_rows: int = TASK_ROWS
) -> DataFrame:
    """(by..., column_a, column_b, n, r): correlation of average ranks.

    Columns without gaps are ranked once, and one pass over the ranks serves all of their pairs. The complete rows of any
    other pair are its own, so such pairs are ranked one by one.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    gaps = df.agg(*[F.coalesce(F.bool_or(measure(c).isNull()), F.lit(False)).alias(f"_g{i}") for i, c in enumerate(columns)]).first()
    whole = [c for i, c in enumerate(columns) if not gaps[f"_g{i}"]]
    together = [p for p in pairs if p[0] in whole and p[1] in whole]
    apart = [p for p in pairs if p not in together]
    parts = [_spearman_of_pairs(df, apart, by, task_rows)] if apart else []
    if together:
        used = [c for c in whole if any(c in p for p in together)]
        ranks = _rank_columns(df, used, by, task_rows)
        if len(together) > 1:
            ranks = cut(ranks)
        found = pearson(ranks, [(f"_r{used.index(a)}", f"_r{used.index(b)}") for a, b in together], by)
        names = F.array(*[F.lit(c) for c in used])
        named = [F.element_at(names, F.substring(side, 3, 10).cast("int") + 1).alias(side) for side in ("column_a", "column_b")]
        parts.append(found.where("n > 0").select(*by, *named, "n", "r"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _spearman_of_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str], task_rows: int) -> DataFrame:
    """The same from counted (x, y) pairs; each side's ranks are joined to them by value."""
    keys = [*by, "column_a", "column_b"]
    rows = _pair_rows(df, pairs, by)
    counted = rows.groupBy(*keys, "x", "y").agg(F.count("*").alias("w"))
    fits = True if largest_group(rows, keys) <= task_rows else None
    for value, rank in (("x", "rank_x"), ("y", "rank_y")):
        ranks = average_ranks(rows, value, keys, rank, task_rows, fits).drop("n_value")
        # As many ranks as values: Spark sees their size when they are ready and splits a hot value.
        counted = attach(counted, ranks, [*keys, value], "inner", few=False)
    totals = counted.groupBy(*keys).agg(F.sum("w").alias("n"))
    centred = attach(counted, totals, keys, few=None if by else True)
    dx, dy = F.col("rank_x") - (F.col("n") + 1) / 2, F.col("rank_y") - (F.col("n") + 1) / 2
    w = F.col("w")
    spread = F.sqrt(F.sum(w * dx * dx)) * F.sqrt(F.sum(w * dy * dy))
    return centred.groupBy(*keys).agg(
        F.max("n").alias("n"), (F.sum(w * dx * dy) / F.nullif(spread, F.lit(0.0))).alias("r")
    )


def _judged(found: DataFrame) -> DataFrame:
    """Add label, p-value and the 95 percent interval to (n, r)."""
    r, n = F.col("r"), F.col("n")
    known = found.where((n >= 3) & r.isNotNull())
    t = r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))
    interval = (F.abs(r) < 1) & (n > 3)
    # The guard keeps the square root and the inverse tangent inside their domains.
    safe_n, safe_r = F.when(n > 3, n), F.when(F.abs(r) < 1, r)
    half = Z_95 / F.sqrt(safe_n - 3)
    p = F.when(F.abs(r) >= 1, F.when(n > 2, F.lit(0.0))).otherwise(t_pvalue(t, n - 2))
    return known.select(
        "*",
        correlation_label(r).alias("label"),
        p.alias("p_value"),
        F.when(interval, F.tanh(F.atanh(safe_r) - half)).alias("ci_lower"),
        F.when(interval, F.tanh(F.atanh(safe_r) + half)).alias("ci_upper"),
    )


def correlations(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]],
    by: Sequence[str] = (),
    types: dict[str, str] | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """(by..., column_a, column_b, method, n, r, label, p_value, ci_lower, ci_upper).

    Spearman where a side is ordinal, binary or has at most 15 distinct values; Pearson elsewhere.
    Pairs with fewer than three rows or a constant side are left out.
    """
    pairs = [p for p in pairs if p[0] in df.columns and p[1] in df.columns]
    types = types or {}
    ranked = {p for p in pairs if {types.get(p[0]), types.get(p[1])} & {"ordinal", "binary"}}
    open_pairs = [p for p in pairs if p not in ranked]
    if open_pairs:
        ranked |= _few_valued(df, open_pairs)
    parts = []
    plain = [p for p in pairs if p not in ranked]
    if plain:
        parts.append(pearson(df, plain, by).withColumn("method", F.lit("pearson")))
    if ranked:
        chosen = [p for p in pairs if p in ranked]
        parts.append(spearman(df, chosen, by, task_rows).withColumn("method", F.lit("spearman")))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _judged(found)


def all_correlations(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: Sequence[str] = (),
    types: dict[str, str] | None = None,
    max_null_share: float = 0.8,
) -> DataFrame:
    """``correlations`` of every pair of numeric columns that are not mostly missing."""
    columns = list(columns or numeric_columns(df, exclude=by))
    shares = df.agg(*[F.avg(measure(c).isNull().cast("double")).alias(c) for c in columns]).first()
    kept = [c for c in columns if shares[c] is not None and shares[c] <= max_null_share]
    return correlations(df, list(combinations(kept, 2)), by, types)


def correlation_matrix(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., column_a, column_b, r): the full symmetric grid, 1 on the diagonal, 0 below three rows."""
    upper = pearson(df, list(combinations(columns, 2)), by)
    cell = F.when(F.col("n") >= 3, F.coalesce(F.col("r"), F.lit(0.0))).otherwise(0.0)
    both = F.array(
        F.struct(F.col("column_a").alias("a"), F.col("column_b").alias("b")),
        F.struct(F.col("column_b").alias("a"), F.col("column_a").alias("b")),
    )
    grid = upper.select(*by, cell.alias("r"), F.explode(both).alias("_c")).select(
        *by, F.col("_c.a").alias("column_a"), F.col("_c.b").alias("column_b"), "r"
    )
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_a")
    segments = df.groupBy(*by).agg(F.count("*").alias("_n"))
    diagonal = segments.select(*by, names).select(*by, "column_a", F.col("column_a").alias("column_b"), F.lit(1.0).alias("r"))
    return grid.unionByName(diagonal)


def point_biserial(df: DataFrame, binary: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson r of a two-valued text column (the larger text is 1) with a numeric column."""
    text = F.col(binary).cast("string")
    ends = df.where(F.col(binary).isNotNull()).groupBy(*by).agg(
        F.min(text).alias("_low"), F.max(text).alias("_high"),
        F.count_if(measure(value).isNull()).alias("_ignored"),
    ).drop("_ignored")
    coded = attach(df, ends, by).withColumn(
        "_code", F.when(text == F.col("_high"), 1.0).when(text == F.col("_low"), 0.0)
    )
    others = coded.where(F.col(binary).isNotNull() & F.col("_code").isNull()).groupBy(*by).agg(
        F.count("*").alias("_others")
    )
    found = pearson(coded, [("_code", value)], by).withColumn("column_a", F.lit(binary))
    if by:
        found = attach(found, others, by, few=False)
    else:
        found = found.withColumn("_others", F.lit(others.first()["_others"]))
    return _judged(found.where(F.coalesce(F.col("_others"), F.lit(0)) == 0).drop("_others")).withColumn(
        "method", F.lit("point-biserial")
    )


# ---- hypothesis tests ----------------------------------------------------------------------------

def _verdict(stats: DataFrame, test: str, p_value: Column, by: Sequence[str]) -> DataFrame:
    """(by..., test, statistic, dof1, dof2, p_value, significant)."""
    judged = stats.withColumn("p_value", p_value)
    return judged.select(
        *by, F.lit(test).alias("test"), "statistic", F.col("dof1").cast("double").alias("dof1"),
        F.col("dof2").cast("double").alias("dof2"), "p_value", (F.col("p_value") < ALPHA).alias("significant"),
    )


def welch_t_test(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Two-sample t-test without equal variances; segments with other than two groups are left out."""
    clean = df.select(*by, F.col(group).alias("_g"), measure(value).alias("_v")).dropna(subset=["_g", "_v"])
    groups = clean.groupBy(*by, "_g").agg(
        F.struct(F.count("*").alias("n"), F.avg("_v").alias("m"), F.var_samp("_v").alias("s")).alias("g")
    )
    sides = groups.groupBy(*by).agg(
        F.count("*").alias("k"), F.min_by("g", "_g").alias("a"), F.max_by("g", "_g").alias("b")
    ).where("k = 2 and a.n >= 2 and b.n >= 2")
    va, vb = F.col("a.s") / F.col("a.n"), F.col("b.s") / F.col("b.n")
    total = va + vb
    dof = total * total / F.nullif(va * va / (F.col("a.n") - 1) + vb * vb / (F.col("b.n") - 1), F.lit(0.0))
    stats = sides.select(
        *by, ((F.col("a.m") - F.col("b.m")) / F.nullif(F.sqrt(total), F.lit(0.0))).alias("statistic"),
        F.coalesce(dof, F.lit(0.0)).alias("dof1"), F.lit(None).cast("double").alias("dof2"),
    )
    return _verdict(stats, "t-test", t_pvalue(F.col("statistic"), F.col("dof1")), by)


def one_sample_t_test(df: DataFrame, value: str, mean: float = 0.0, by: Sequence[str] = ()) -> DataFrame:
    clean = df.select(*by, measure(value).alias("_v")).dropna(subset=["_v"])
    stats = clean.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("_v").alias("m"), F.stddev_samp("_v").alias("s")
    ).where("n >= 2").select(
        *by, ((F.col("m") - mean) / F.nullif(F.col("s") / F.sqrt("n"), F.lit(0.0))).alias("statistic"),
        (F.col("n") - 1).alias("dof1"), F.lit(None).cast("double").alias("dof2"),
    )
    return _verdict(stats, "one-sample t-test", t_pvalue(F.col("statistic"), F.col("dof1")), by)


def chi_square_test(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Independence of two columns read as text, with the Yates correction at one degree of freedom.

    Only cells that occur are kept; the expected mass of the empty cells is added as a remainder,
    so the full grid of categories is never built.
    """
    text = df.select(*by, F.col(a).cast("string").alias("_a"), F.col(b).cast("string").alias("_b"))
    cells = text.dropna(subset=["_a", "_b"]).groupBy(*by, "_a", "_b").agg(F.count("*").alias("o"))
    rows = cells.groupBy(*by, "_a").agg(F.sum("o").alias("r"))
    cols = cells.groupBy(*by, "_b").agg(F.sum("o").alias("c"))
    shape = rows.groupBy(*by).agg(
        F.count("*").alias("nr"), F.sum("r").alias("n"), F.min("_a").alias("a0"),
        F.min_by("r", "_a").alias("r0"),
    )
    width = cols.groupBy(*by).agg(F.count("*").alias("nc"), F.min("_b").alias("b0"), F.min_by("c", "_b").alias("c0"))
    shape = attach(shape, width, by, few=False)
    placed = attach(attach(attach(cells, rows, [*by, "_a"]), cols, [*by, "_b"]), shape, by)
    expected = F.col("r") * F.col("c") / F.col("n")
    gap = F.col("o") - expected
    facts = placed.groupBy(*by).agg(
        F.sum(gap * gap / expected).alias("seen"), F.sum(expected).alias("mass"), F.count("*").alias("cells"),
        F.max("n").alias("n"), F.max("nr").alias("nr"), F.max("nc").alias("nc"),
        F.max("r0").alias("r0"), F.max("c0").alias("c0"),
        F.coalesce(
            F.max(F.when((F.col("_a") == F.col("a0")) & (F.col("_b") == F.col("b0")), F.col("o"))), F.lit(0)
        ).alias("o0"),
    ).where("nr * nc >= 2")
    n = F.col("n").cast("double")
    empty = F.when(F.col("cells") < F.col("nr") * F.col("nc"), n - F.col("mass")).otherwise(0.0)
    r0, c0 = F.col("r0").cast("double"), F.col("c0").cast("double")
    corrected = F.greatest(F.abs(F.col("o0") - r0 * c0 / n) - 0.5, F.lit(0.0))
    sides = F.nullif((r0 / n) * ((n - r0) / n) * (c0 / n) * ((n - c0) / n), F.lit(0.0))
    yates = corrected * corrected / (sides * n)
    dof = (F.col("nr") - 1) * (F.col("nc") - 1)
    stats = facts.select(
        *by,
        F.when(dof == 0, F.lit(0.0)).when(dof == 1, yates).otherwise(F.col("seen") + empty).alias("statistic"),
        dof.alias("dof1"), F.lit(None).cast("double").alias("dof2"),
    )
    p = F.when(F.col("dof1") == 0, F.lit(1.0)).otherwise(chi2_pvalue(F.col("statistic"), F.col("dof1")))
    return _verdict(stats, "chi-square", p, by)


def anova(df: DataFrame, value: str, group: str, by: Sequence[str] = ()) -> DataFrame:
    """One-way analysis of variance over the groups that hold at least two values."""
    clean = df.select(*by, F.col(group).alias("_g"), measure(value).alias("_v")).dropna(subset=["_g", "_v"])
    groups = clean.groupBy(*by, "_g").agg(
        F.count("*").alias("n"), F.avg("_v").alias("m"), F.var_samp("_v").alias("s")
    ).where("n >= 2")
    grand = groups.groupBy(*by).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_grand"))
    gap = F.col("m") - F.col("_grand")
    sums = attach(groups, grand, by).groupBy(*by).agg(
        F.count("*").alias("k"), F.sum("n").alias("total"),
        F.sum(F.col("n") * gap * gap).alias("between"), F.sum((F.col("n") - 1) * F.col("s")).alias("within"),
    ).where("k >= 2")
    dof1, dof2 = F.col("k") - 1, F.col("total") - F.col("k")
    stats = sums.select(
        *by, ((F.col("between") / dof1) / F.nullif(F.col("within") / dof2, F.lit(0.0))).alias("statistic"),
        dof1.alias("dof1"), dof2.alias("dof2"),
    )
    return _verdict(stats, "anova", f_pvalue(F.col("statistic"), F.col("dof1"), F.col("dof2")), by)


# ---- regression ----------------------------------------------------------------------------------

MIN_REGRESSION_ROWS = 3


def varying(df: DataFrame, columns: Sequence[str], complete: Sequence[str]) -> list[str]:
    """The columns that are not constant over the rows complete in ``complete``."""
    rows = df.select(*[measure(c).alias(c) for c in complete]).dropna()
    ends = rows.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if ends[c]]


def regression(df: DataFrame, dependent: str, predictors: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., dependent, predictors, n, intercept, coefficients, r2, adjusted_r2, mse, rmse, vif, ridge).

    Least squares over complete rows; predictors that are constant over the table are dropped.
    """
    predictors = varying(df, list(predictors), [dependent, *predictors])
    if not predictors:
        raise ValueError("no predictor varies")
    return fit_terms(df, measure(dependent), {p: measure(p) for p in predictors}, by, MIN_REGRESSION_ROWS).select(
        *by, F.lit(dependent).alias("dependent"),
        F.array(*[F.lit(p) for p in predictors]).alias("predictors"),
        "n", "intercept", "coefficients", "r2", "adjusted_r2", "mse", "rmse", "vif", "ridge",
    )


def fit_terms(
    df: DataFrame, target: Column, terms: dict[str, Column], by: Sequence[str] = (), min_rows: int = 3
) -> DataFrame:
    """(by..., n, fit columns): least squares of the target on arbitrary terms."""
    moments = complete_moments(df, {"__target": target, **terms}, by).where(F.col("n") >= min_rows)
    solved = moments.withColumn("_fit", least_squares(F.col("n"), F.col("means"), F.col("covariance")))
    return solved.select(*by, "n", "_fit.*")


def predict_terms(
    df: DataFrame, fit: DataFrame, target: Column | None, terms: dict[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Add ``prediction`` (and ``residual``) as columns; null where a term is missing."""
    known = attach(df, fit.select(*by, F.col("intercept").alias("_b0"), F.col("coefficients").alias("_b")), by)
    prediction = F.col("_b0")
    for i, term in enumerate(terms.values()):
        prediction = prediction + F.get(F.col("_b"), F.lit(i)) * term.cast("double")
    known = known.withColumn("prediction", prediction)
    if target is not None:
        known = known.withColumn("residual", target.cast("double") - F.col("prediction"))
    return known.drop("_b0", "_b")


def with_predictions(
    df: DataFrame, fit: DataFrame, dependent: str, predictors: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """The table with ``prediction`` and ``residual`` of a linear fit."""
    return predict_terms(df, fit, measure(dependent), {p: measure(p) for p in predictors}, by)


def inferential_report(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]] = (),
    tests: Sequence[dict] = (),
    models: Sequence[tuple[str, Sequence[str]]] = (),
    by: Sequence[str] = (),
) -> dict[str, DataFrame]:
    """Correlations, tests (type, columns) and regressions in one call."""
    report = {}
    if pairs:
        report["correlations"] = correlations(df, pairs, by)
    runs = {"t-test": welch_t_test, "chi-square": chi_square_test, "anova": anova}
    rows = None
    for test in tests:
        a, b = test["columns"][:2]
        row = runs[test["type"]](df, a, b, by).withColumn("columns", F.array(F.lit(a), F.lit(b)))
        rows = row if rows is None else rows.unionByName(row)
    if rows is not None:
        report["tests"] = rows
    for dependent, predictors in models:
        report[f"regression:{dependent}"] = regression(df, dependent, predictors, by)
    return report
