"""Small dictionaries as literals: the shape is that of the technology dictionaries a user supplies as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Pseudo-categories of function words that do occur in the test documents: category, keyword, weight, parent category.
KEYWORDS = [
    ("english", "the", 5.0), ("english", "and", 4.0), ("english", "that", 3.0), ("english", "of the", 6.0), ("english", "is", 2.0), ("english", "version 2.0", 3.0), ("english", "ing#", 2.5), ("english", "th.", 1.5),
    ("german", "der", 5.0), ("german", "und", 4.0), ("german", "die", 3.0), ("german", "ist", 3.0),
    ("french", "les", 5.0), ("french", "une", 4.0), ("french", "est", 3.0), ("french", "de la", 6.0),
    ("spanish", "los", 5.0), ("spanish", "que", 4.0), ("spanish", "una", 4.0), ("spanish", "el", 2.0), ("spanish", "ción", 1.5),
    ("roman", "la", 2.0), ("roman", "de", 2.0),
]
#: category, parent, is_tech, place in the file, place in the order of priority.
CATEGORIES = [("english", None, True, 1, 2), ("german", None, True, 2, 1), ("french", "roman", True, 3, 4), ("spanish", "roman", True, 4, 3), ("roman", None, False, 5, 5)]
#: category, keyword, penalty.
NEGATIVES = [("english", "und", 5.0), ("english", "les", 5.0), ("german", "the", 5.0), ("roman", "der", 5.0), ("french", "licen", 4.0), ("spanish", "apache license", 3.0)]


def word(w: str) -> str:
    """Expression for a whole word, the same in every dialect."""
    return rf"(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])"


#: place, pattern, categories, weight, strength.
PATTERNS = [
    (1, word("the"), ["english"], 20.0, "strong"), (2, word("der"), ["german"], 15.0, "potential"), (3, word("de"), ["french", "spanish"], 12.0, "adjacent"),
    (4, word("of"), ["english"], 18.0, "ambiguous"), (5, word("que"), [], 25.0, "ambiguous"),
]
STRENGTHS = ("strong", "potential", "adjacent", "ambiguous")
#: alias, canonical name.
ALIASES = [("das", "der"), ("el", "los"), ("an", "a")]
#: policy, tech_minimum, minimum_margin, min_confidence.
POLICIES = [("default", 8.0, 3.0, 0.15), ("conservative", 12.0, 4.0, 0.25), ("permissive", 5.0, 2.0, 0.08)]
#: policy, category, tech_minimum, minimum_margin.
OVERRIDES = [("default", "roman", 6.0, None), ("conservative", "english", None, 5.0)]
#: Country spellings; currencies and their value in dollars.
COUNTRIES = {"china": "CN", "india": "IN", "japan": "JP", "france": "FR", "germany": "DE", "russia": "RU", "united states": "US", "united kingdom": "GB", "brazil": "BR", "canada": "CA", "us": "US", "uk": "GB"}
COUNTRY_CURRENCY = {"US": "USD", "GB": "GBP", "CA": "CAD", "DE": "EUR", "FR": "EUR", "IN": "INR", "JP": "JPY", "CN": "CNY", "BR": "BRL"}
USD = {"USD": 1.0, "EUR": 1.08, "GBP": 1.27, "CAD": 0.73, "INR": 0.012, "JPY": 0.0067, "CNY": 0.14, "BRL": 0.2}
#: code -> name, own name, icon.
LANGUAGES = {
    "en": ("English", "English", "🇬🇧"), "de": ("German", "Deutsch", "🇩🇪"), "fr": ("French", "Français", "🇫🇷"), "it": ("Italian", "Italiano", "🇮🇹"),
    "nl": ("Dutch", "Nederlands", "🇳🇱"), "pt": ("Portuguese", "Português", "🇵🇹"),
}
UNKNOWN_ICON = "🌐"


def keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KEYWORDS, "category string, keyword string, weight double")


def negatives(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NEGATIVES, "category string, keyword string, penalty double")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "category string, parent string, is_tech boolean, file_rank int, priority_rank int")


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICIES, "policy string, tech_minimum double, minimum_margin double, min_confidence double")


def overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OVERRIDES, "policy string, category string, tech_minimum double, minimum_margin double")


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "alias string, canonical string")
