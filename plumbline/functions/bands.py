"""Words for numbers: labels of correlations, skewness, model metrics and importances."""

from pyspark.sql import Column, functions as F

# Cut points and words.
CORRELATION_BANDS = [(0.7, "strong"), (0.4, "moderate")]
SKEWNESS_BANDS = [(0.5, "symmetric"), (1.0, "moderate")]
R2_BANDS = [(0.8, "excellent"), (0.6, "good"), (0.4, "moderate"), (0.2, "weak")]
ERROR_SHARE_BANDS = [(5.0, "highly accurate"), (15.0, "acceptable"), (30.0, "improvable")]
ERROR_RATIO_BANDS = [(0.5, "much better than the mean"), (1.0, "better than the mean")]
ACCURACY_BANDS = [(0.9, "highly reliable"), (0.8, "good"), (0.7, "acceptable"), (0.6, "marginal")]
PRECISION_BANDS = [(0.85, "very trustworthy"), (0.7, "few false alarms"), (0.5, "moderate false alarms")]
RECALL_BANDS = [(0.85, "very few missed"), (0.7, "some missed"), (0.5, "many missed")]
F1_BANDS = [(0.85, "strong"), (0.7, "good"), (0.5, "moderate")]
AUC_BANDS = [(0.9, "excellent"), (0.8, "good"), (0.7, "moderate"), (0.6, "weak")]
REGRESSION_CONFIDENCE = [(0.7, "high"), (0.4, "moderate")]
CLASS_CONFIDENCE = [(0.85, "high"), (0.7, "moderate")]
IMPORTANCE_BANDS = [(30.0, "dominant"), (15.0, "major"), (5.0, "moderate")]
LOW_ERROR_SHARE = 10.0
BALANCED_SHARE = (0.3, 0.7)


def above(value: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """The first word whose cut point the value exceeds; null stays null."""
    word = F.lit(otherwise)
    for cut_point, name in reversed(bands):
        word = F.when(value > cut_point, name).otherwise(word)
    return F.when(value.isNotNull(), word)


def below(value: Column, bands: list[tuple[float, str]], otherwise: str) -> Column:
    """The first word whose cut point the value stays under; null stays null."""
    word = F.lit(otherwise)
    for cut_point, name in reversed(bands):
        word = F.when(value < cut_point, name).otherwise(word)
    return F.when(value.isNotNull(), word)


def correlation_label(r: Column) -> Column:
    sign = F.when(r > 0, " positive").otherwise(" negative")
    word = F.lit("weak")
    for cut_point, name in reversed(CORRELATION_BANDS):
        word = F.when(F.abs(r) >= cut_point, F.concat(F.lit(name), sign)).otherwise(word)
    return F.when(r.isNotNull(), word)


def skewness_label(skewness: Column) -> Column:
    return below(F.abs(skewness), SKEWNESS_BANDS, "skewed")


def regression_bands(r2: Column, rmse: Column, mean_target: Column, std_target: Column) -> dict[str, Column]:
    share = F.abs(rmse / F.nullif(mean_target, F.lit(0.0))) * 100
    return {
        "quality": above(r2, R2_BANDS, "poor"),
        "error_share": share,
        "error_band": below(share, ERROR_SHARE_BANDS, "needs refinement"),
        "error_magnitude": F.when(share.isNull(), "unknown").when(share < LOW_ERROR_SHARE, "low").otherwise("medium"),
        "error_vs_spread": below(
            rmse / F.when(std_target > 0, std_target), ERROR_RATIO_BANDS, "not better than the mean"
        ),
        "confidence": above(r2, REGRESSION_CONFIDENCE, "low"),
    }


def classification_bands(
    accuracy: Column, precision: Column, recall: Column, f1: Column, auc: Column, prevalence: Column
) -> dict[str, Column]:
    low, high = BALANCED_SHARE
    score = F.when(f1.isNotNull() & auc.isNotNull(), (f1 + auc) / 2).otherwise(accuracy)
    return {
        "accuracy_band": above(accuracy, ACCURACY_BANDS, "not reliable"),
        "precision_band": above(precision, PRECISION_BANDS, "high false alarm rate"),
        "recall_band": above(recall, RECALL_BANDS, "most missed"),
        "f1_band": above(f1, F1_BANDS, "poor"),
        "auc_band": above(auc, AUC_BANDS, "no better than random"),
        "balance": F.when((prevalence > low) & (prevalence < high), "balanced").otherwise("imbalanced"),
        "confidence": above(score, CLASS_CONFIDENCE, "low"),
    }
