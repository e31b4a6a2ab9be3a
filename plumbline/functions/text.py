"""Text clean-up expressions and the sequence-matching similarity."""

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def single_blanks(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def title_case(text: Column) -> Column:
    """First letter of every run of letters upper, the rest lower: ``O'Neil Abc-Def``."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), run.substr(F.lit(2), F.length(run)))), "")


def sentence_case(text: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))


CASES = {
    "lower": F.lower,
    "upper": F.upper,
    "title": title_case,
    "capitalize": sentence_case,
    "none": lambda text: text,
}


def tidy(text: Column, case: str = "title", strip: bool = True, collapse: bool = True) -> Column:
    if strip:
        text = strip_blanks(text)
    if collapse:
        text = single_blanks(text)
    return CASES[case](text)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters of the two texts; the order of the arguments matters."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype=float)


def edit_ratio(a: Column, b: Column) -> Column:
    """1 less the share of the longer text's characters that must be inserted, deleted or replaced."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


# The ways to score two texts; an edit ratio never passes where the bounds of the similarity join forbid it.
RATIOS = {"sequence": sequence_ratio, "levenshtein": edit_ratio}
