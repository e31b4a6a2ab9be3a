"""What a column's name says about its meaning."""

import re

# Whole words in a column name that hint at its meaning.
BINARY_WORDS = {
    "sex", "gender", "sexe", "gen", "married", "marital", "alive", "survival", "survived", "pregnant",
    "smoker", "smoking", "obese", "diabetic", "hypertensive", "infected", "positive", "dead", "deceased",
    "pass", "fail",
}
CATEGORY_WORDS = {
    "category", "categor", "cat", "class", "clas", "group", "grp", "grpcd", "type", "typ", "kind", "status",
    "education", "school", "occupation", "job", "profession", "region", "state", "country", "province",
    "sector", "sect", "company", "species", "breed", "race", "ethnic", "religion", "ward", "location",
    "department", "diagnosis", "symptom", "disease", "condition", "treatment", "drug", "outcome", "reason",
    "mode", "color", "colour", "tier",
}
ORDER_WORDS = {
    "level", "stage", "rank", "band", "grade", "order", "quartile", "decile", "percentile", "agecat",
    "agegrp", "agegroup", "grp", "group", "class", "clas",
}


def hints(column: str) -> tuple[bool, bool, bool]:
    """Whether the name hints at a binary, a categorical and an ordinal column.

    Names are split at everything that is not a letter, so ``Sex/Category`` holds two words.
    """
    words = set(re.findall(r"[a-z]+", column.lower()))
    return bool(words & BINARY_WORDS), bool(words & CATEGORY_WORDS), bool(words & ORDER_WORDS)
