"""Which features drive a model, and how."""

from collections.abc import Callable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.bands import IMPORTANCE_BANDS, above
from ..functions.linalg import least_squares
from ..plans.order import positions
from ..plans.quantiles import wide_percentiles
from ..plans.segments import TASK_ROWS, attach, measure, quoted
from ..plans.staging import scratch_path, stored, swept
from .evaluate import regression_metrics
from .models import score_linear, with_score

REPEATS = 10
LOCAL_SAMPLES = 1000
GRID_POINTS = 50
GRID_ENDS = (0.05, 0.95)
SEED = 42
# A hash's leading bits that name a bucket of nearby hashes.
HASH_BITS, BUCKET_BITS = 64, 10

Predict = Callable[[DataFrame], DataFrame]


def predictor(model, features: Sequence[str], as_score: bool = False) -> Predict:
    """A function that adds ``prediction`` to rows holding the feature columns of a fitted model."""

    def predict(df: DataFrame) -> DataFrame:
        names = [f"_x{i}" for i in range(len(features))]
        assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
        placed = df.withColumns({n: quoted(f) for n, f in zip(names, features)})
        scored = with_score(model.transform(assembler.transform(placed))).drop(*names)
        if as_score and "score" in scored.columns:
            scored = scored.withColumn("prediction", F.col("score"))
        extra = [c for c in ("features", "rawPrediction", "probability", "score") if c in scored.columns and c not in df.columns]
        return scored.drop(*extra)

    return predict


def linear_predictor(intercept: float, coefficients: dict[str, float]) -> Predict:
    return lambda df: score_linear(df, intercept, coefficients)


def _ranked(found: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``rank`` by falling value; one row per feature, so the window is small."""
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(value), "feature")
    return found.withColumn("rank", F.row_number().over(order))


def _with_share(found: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(*(by or [F.lit(0)])))
    return found.withColumn("share", F.coalesce(F.col(value) / F.nullif(total, F.lit(0.0)) * 100, F.lit(0.0)))


def _noise(key: Sequence[str], *parts) -> Column:
    """A uniform number in (0, 1) fixed by the key and the parts."""
    hashed = F.xxhash64(*[F.col(k) for k in key], *parts)
    return (F.pmod(hashed, F.lit(2**52)) + 0.5) / float(2**52)


def permutation_importance(
    df: DataFrame,
    predict: Predict,
    features: Sequence[str],
    label: str,
    key: Sequence[str],
    classification: bool,
    repeats: int = REPEATS,
    seed: int = SEED,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """(feature, importance, std, rank): loss of accuracy or R2 when a column is shuffled.

    Each repeat hands every row another row as donor by an equi-join of two global positions; the
    copies of all features and repeats are scored together. Of more than ``task_rows`` rows one repeat is on disk at a time.
    """
    rows = df.select(*key, measure(label).alias("_y"), *[measure(f).alias(f) for f in features]).dropna()
    # One position per repeat in two orders: by key, and by a hash of key and repeat.
    placed = positions(rows, key, name="_place", task_rows=task_rows)
    hashed = F.xxhash64(*[F.col(k) for k in key], F.col("_repeat"), F.lit(seed))

    def together() -> DataFrame:
        turns = placed.withColumn("_repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        shuffled = positions(turns.withColumn("_h", hashed), ["_h", *key], ["_repeat"], name="_spot", task_rows=task_rows)
        donors = shuffled.select("_repeat", F.col("_spot").alias("_place"), F.struct(*features).alias("_donor"))
        return turns.join(donors, ["_repeat", "_place"])

    def alone(base: DataFrame, repeat: int, folder: str) -> DataFrame:
        """Rows of nearby hashes make a bucket; sizes of the buckets before it and the place inside it give the position."""
        turn = base.withColumn("_repeat", F.lit(repeat)).withColumn("_h", hashed)
        turn = turn.withColumn("_bucket", F.shiftright("_h", HASH_BITS - BUCKET_BITS))
        before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = turn.groupBy("_bucket").count().select("_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
        inside = Window.partitionBy("_bucket").orderBy("_h", "_place")
        spots = turn.select("_bucket", "_h", "_place", *features).withColumn("_spot", F.row_number().over(inside) - 1).join(F.broadcast(starts), "_bucket")
        donors = stored(spots.select((F.col("_start") + F.col("_spot")).alias("_place"), *features), folder)
        own = base.select("_place", "_y", *features).withColumn("_repeat", F.lit(repeat))
        return own.join(donors.select("_place", F.struct(*features).alias("_donor")), "_place")

    copies = F.explode(F.array(*[
        F.struct(
            F.lit(f).alias("feature"),
            *[(F.col(f"_donor.{g}") if g == f else F.col(g)).alias(g) for g in features],
        )
        for f in features
    ])).alias("_c")

    def scored(paired: DataFrame) -> DataFrame:
        changed = predict(paired.select("_repeat", "_y", copies).select("_repeat", "_y", "_c.*"))
        if classification:
            return changed.groupBy("feature", "_repeat").agg(F.avg((F.col("_y") == F.col("prediction")).cast("double")).alias("score"))
        return regression_metrics(changed, "_y", "prediction", ["feature", "_repeat"]).select("feature", "_repeat", F.col("r2").alias("score"))

    if rows.count() <= task_rows:
        scores = scored(together())
    else:
        held, folder, spark = stored(placed), scratch_path(df.sparkSession, "donors"), df.sparkSession
        found = []
        for repeat in range(repeats):
            with swept(spark):
                found += [tuple(r) for r in scored(alone(held, repeat, folder)).collect()]
        scores = spark.createDataFrame(found, "feature string, _repeat int, score double")
    base = predict(rows)
    if classification:
        start = base.agg(F.avg((F.col("_y") == F.col("prediction")).cast("double"))).first()[0]
    else:
        start = regression_metrics(base, "_y", "prediction").first()["r2"]
    drops = scores.groupBy("feature").agg(
        F.avg(F.lit(start) - F.col("score")).alias("importance"), F.stddev_pop("score").alias("std")
    )
    return _ranked(drops, "importance")


def shapley_linear(df: DataFrame, coefficients: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, mean_abs, share, rank): exact attributions w (x - mean) of a linear model over all rows."""
    names = list(coefficients)
    complete = df.dropna(subset=names)
    means = complete.groupBy(*by).agg(*[F.avg(measure(c)).alias(f"_m_{c}") for c in names])
    values = attach(complete.select(*by, *names), means, by)
    sums = values.groupBy(*by).agg(*[
        F.avg(F.abs(F.lit(float(w)) * (measure(c) - F.col(f"_m_{c}")))).alias(c) for c, w in coefficients.items()
    ])
    long = sums.unpivot(list(by), names, "feature", "mean_abs")
    return _ranked(_with_share(long, "mean_abs", by), "mean_abs", by)


def shapley_sampled(
    df: DataFrame,
    predict: Predict,
    features: Sequence[str],
    key: Sequence[str],
    rows: int | None = None,
    orders: int = 8,
    seed: int = SEED,
) -> DataFrame:
    """(feature, mean_abs, share, rank) over all complete rows, for any model; over ``rows`` of them if given.

    Every row gets random feature orders and a background row each; along an order the features switch
    from background to row, and the change of the prediction is the attribution. A prediction counts for the
    feature that switched last and against the one that switches next, so sums per row and feature suffice.
    """
    features = list(features)
    hashed = df.dropna(subset=features).select(
        *key, *[measure(f).alias(f) for f in features], F.xxhash64(*key, F.lit(seed)).alias("_h")
    )
    if rows is not None:
        hashed = hashed.orderBy("_h", *key).limit(rows)
    sample = stored(positions(hashed, ["_h", *key], name="_i").select("_i", *features))
    n = sample.count()
    turns = sample.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))))
    turns = turns.withColumn("_b", F.pmod(F.col("_i") + 1 + F.pmod(F.xxhash64("_i", "_m"), F.lit(max(n - 1, 1))), F.lit(n)))
    background = sample.select(F.col("_i").alias("_b"), F.struct(*features).alias("_back"))
    paired = turns.join(background, "_b")
    order = F.array_sort(F.array(*[
        F.struct(F.xxhash64("_i", "_m", F.lit(j)).alias("h"), F.lit(j).alias("j")) for j in range(len(features))
    ]))
    paired = paired.withColumn("_order", F.transform(order, lambda x: x["j"]))
    steps = paired.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    place = {f: F.array_position("_order", F.lit(j)) for j, f in enumerate(features)}
    mixed = steps.select(
        "_i", "_m", "_step", "_order",
        *[F.when(place[f] <= F.col("_step"), F.col(f)).otherwise(F.col(f"_back.{f}")).alias(f) for f in features],
    )
    names = F.array(*[F.lit(f) for f in features])
    # get() is null before the first and after the last feature
    switch = lambda at: F.get(names, F.get("_order", at))
    sides = F.explode(F.array(
        F.struct(switch(F.col("_step") - 1).alias("feature"), F.col("prediction").alias("_gain")),
        F.struct(switch(F.col("_step")).alias("feature"), (-F.col("prediction")).alias("_gain")),
    )).alias("_g")
    gains = predict(mixed).select("_i", sides).select("_i", "_g.*").where(F.col("feature").isNotNull())
    # one row of sums for all features, so a key and its shuffle are paid once
    phi = {f"_phi{j}": F.sum(F.when(F.col("feature") == f, F.col("_gain"))) / orders for j, f in enumerate(features)}
    means = gains.groupBy("_i").agg(*[total.alias(name) for name, total in phi.items()]).agg(
        F.count("*").alias("_n"), *[F.avg(F.abs(name)).alias(name) for name in phi]
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_phi{j}").alias("mean_abs")) for j, f in enumerate(features)]))
    found = means.where("_n > 0").select(pairs.alias("_p")).select("_p.*")
    return _ranked(_with_share(found, "mean_abs"), "mean_abs")


def local_surrogate(
    df: DataFrame,
    predict: Predict,
    features: Sequence[str],
    key: Sequence[str],
    instances: DataFrame,
    samples: int = LOCAL_SAMPLES,
    top: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """(key..., feature, contribution, rank): a weighted linear fit around each instance.

    Noise of one standard deviation per feature, weighted by closeness; one row of weighted sums per
    instance is solved where it lives. ``top`` keeps that many features of each instance.
    """
    features = list(features)
    spread = df.agg(*[F.stddev_pop(measure(f)).alias(f) for f in features]).first()
    width = 0.75 * len(features) ** 0.5
    draws = instances.select(*key, *[measure(f).alias(f"_o_{f}") for f in features]).withColumn(
        "_s", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    )
    shifts = {
        f"_z{j}": F.sqrt(-2 * F.ln(_noise(key, F.col("_s"), F.lit(2 * j), F.lit(seed))))
        * F.cos(2 * F.pi() * _noise(key, F.col("_s"), F.lit(2 * j + 1), F.lit(seed)))
        for j in range(len(features))
    }
    moved = draws.withColumns(shifts)
    moved = moved.withColumns({
        f: F.col(f"_o_{f}") + F.col(f"_z{j}") * F.lit(float(spread[f] or 0.0)) for j, f in enumerate(features)
    })
    scored = predict(moved.drop(*[f"_o_{f}" for f in features]))
    square = sum((F.col(f"_z{j}") * F.col(f"_z{j}") for j in range(1, len(features))), F.col("_z0") * F.col("_z0"))
    weighted = scored.withColumn("_w", F.sqrt(F.exp(-square / (width * width))))
    terms = [F.col("prediction"), *[F.col(f"_z{j}") for j in range(len(features))]]
    w, total = F.col("_w"), F.sum("_w")
    means = [F.sum(w * t) / total for t in terms]
    upper = [
        F.sum(w * terms[i] * terms[j]) / total - means[i] * means[j] for i in range(len(terms)) for j in range(i, len(terms))
    ]
    sums = weighted.groupBy(*key).agg(total.alias("n"), F.array(*means).alias("means"), F.array(*upper).alias("covariance"))
    solved = sums.withColumn("_fit", least_squares(F.col("n"), F.col("means"), F.col("covariance")))
    pairs = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"), F.col("_fit.coefficients").alias("value"))
    long = solved.select(*key, F.explode(pairs).alias("_p")).select(
        *key, F.col("_p").getField("feature").alias("feature"), F.col("_p").getField("value").alias("contribution")
    )
    order = Window.partitionBy(*key).orderBy(F.desc(F.abs("contribution")), "feature")
    ranked = long.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def grids(df: DataFrame, features: Sequence[str], points: int = GRID_POINTS) -> dict[str, list[float]]:
    """Evenly spaced values between the 5th and 95th percentile; all values where there are fewer."""
    ends = wide_percentiles(df, features, list(GRID_ENDS)).first()
    rough = df.agg(*[F.approx_count_distinct(measure(f)).alias(f) for f in features]).first()
    found = {}
    for f in features:
        if rough[f] <= 2 * points:
            values = df.where(measure(f).isNotNull()).select(measure(f).alias("v")).distinct().limit(points).collect()
            if len(values) < points:
                found[f] = sorted(r["v"] for r in values)
                continue
        low, high = ends[f"pct__{f}"]
        found[f] = [low + (high - low) * i / (points - 1) for i in range(points)]
    return found


def partial_dependence(
    df: DataFrame, predict: Predict, features: Sequence[str], of: Sequence[str] | None = None, points: int = GRID_POINTS
) -> DataFrame:
    """(feature, value, average): mean prediction over all rows with one feature set to each grid value.

    Copies of a row are made and summed inside its task; only one sum per grid value is shuffled.
    """
    of = list(of or features)
    rows = df.select(*[measure(f).alias(f) for f in features]).dropna()
    values = grids(rows, of, points)
    settings = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.lit(float(v)).alias("value")) for f in of for v in values[f]
    ])).alias("_g")
    copies = rows.select("*", settings).select(
        "_g.feature", "_g.value",
        *[(F.when(F.col("_g.feature") == f, F.col("_g.value")).otherwise(F.col(f)) if f in of else F.col(f)).alias(f) for f in features],
    )
    return predict(copies).groupBy("feature", "value").agg(F.avg("prediction").alias("average"))


def partial_dependence_linear(
    df: DataFrame, intercept: float, coefficients: dict[str, float], of: Sequence[str] | None = None, points: int = GRID_POINTS
) -> DataFrame:
    """The same for a linear model in closed form: one mean per feature."""
    names = list(coefficients)
    of = list(of or names)
    rows = df.dropna(subset=names)
    values = grids(rows, of, points)
    means = rows.agg(*[F.avg(measure(c)).alias(c) for c in names])
    centre = F.lit(float(intercept))
    for c, w in coefficients.items():
        centre = centre + F.lit(float(w)) * F.col(c)
    settings = F.explode(F.array(*[
        F.struct(
            F.lit(f).alias("feature"), F.lit(float(v)).alias("value"),
            (centre + F.lit(float(coefficients[f])) * (F.lit(float(v)) - F.col(f))).alias("average"),
        )
        for f in of for v in values[f]
    ])).alias("_g")
    return means.select(settings).select("_g.*")


def coefficient_table(coefficients: DataFrame, by: Sequence[str] = (), classification: bool = False) -> DataFrame:
    """(by..., feature, coefficient, share, direction, odds_ratio, rank) from (by..., feature, coefficient)."""
    sized = coefficients.withColumn("_size", F.abs("coefficient"))
    ranked = _ranked(_with_share(sized, "_size", by), "_size", by)
    odds = F.exp("coefficient") if classification else F.lit(None).cast("double")
    return ranked.select(
        *by, "feature", "coefficient", "share",
        F.when(F.col("coefficient") > 0, "positive").otherwise("negative").alias("direction"),
        odds.alias("odds_ratio"), "rank",
    )


def fit_coefficients(fit: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, coefficient) from the coefficient arrays of fitted segments."""
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("coefficients").alias("coefficient"))
    return fit.select(*by, F.explode(pairs).alias("_p")).select(
        *by, F.col("_p").getField("feature").alias("feature"), F.col("_p").getField("coefficient").alias("coefficient")
    )


def builtin_importance(spark, model, features: Sequence[str]) -> DataFrame:
    """(feature, importance, share, rank) that a tree model reports of itself."""
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    found = spark.createDataFrame(rows, "feature string, importance double")
    return _ranked(_with_share(found, "importance"), "importance")


def importance_levels(importances: DataFrame, value: str = "importance", by: Sequence[str] = ()) -> DataFrame:
    """Add ``share`` in percent and ``level``: dominant, major, moderate or minor."""
    shared = _with_share(importances, value, by)
    return shared.withColumn("level", above(F.col("share"), IMPORTANCE_BANDS, "minor"))


def top_features(ranked: DataFrame, k: int = 5) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def consensus(ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, average_rank, methods, consensus_rank) from (by..., method, feature, rank)."""
    means = ranks.groupBy(*by, "feature").agg(F.avg("rank").alias("average_rank"), F.count("*").alias("methods"))
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("average_rank", "feature")
    return means.withColumn("consensus_rank", F.row_number().over(order))


def explain(
    train: DataFrame,
    test: DataFrame,
    model,
    features: Sequence[str],
    label: str,
    key: Sequence[str],
    classification: bool,
    repeats: int = REPEATS,
    local_instances: int = 1,
    top: int | None = None,
) -> dict[str, DataFrame]:
    """Every method that suits the model, the consensus of their ranks and partial dependence of the features.

    ``train`` and ``test`` hold the feature columns. ``local`` explains the first ``local_instances`` test rows;
    ``top`` keeps that many leading features in the partial dependence.
    """
    features = list(features)
    spark = train.sparkSession
    predict = predictor(model, features)
    report: dict[str, DataFrame] = {}
    if hasattr(model, "featureImportances"):
        report["builtin"] = builtin_importance(spark, model, features)
    report["permutation"] = permutation_importance(test, predict, features, label, key, classification, repeats)
    weights = None
    if hasattr(model, "coefficients"):
        weights = {f: float(w) for f, w in zip(features, model.coefficients)}
        table = spark.createDataFrame(list(weights.items()), "feature string, coefficient double")
        report["coefficients"] = coefficient_table(table, classification=classification)
    soft = predictor(model, features, as_score=True)
    if weights and not classification:
        report["shapley"] = shapley_linear(train, weights)
    else:
        report["shapley"] = shapley_sampled(train, soft, features, key)
    chosen = test.dropna(subset=features).orderBy(*key).limit(local_instances)
    report["local"] = local_surrogate(train, soft, features, key, chosen)
    ranked = None
    for method in ("builtin", "permutation", "shapley", "coefficients"):
        if method in report:
            part = report[method].select(F.lit(method).alias("method"), "feature", "rank")
            ranked = part if ranked is None else ranked.unionByName(part)
    report["consensus"] = consensus(ranked)
    lead = next(m for m in ("shapley", "permutation", "builtin", "coefficients") if m in report)
    leading = [r["feature"] for r in report[lead].orderBy("rank").collect()]
    report["partial_dependence"] = partial_dependence(train, soft, features, leading[:top])
    return report

