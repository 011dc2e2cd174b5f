"""Tokens, similarities and canonical strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a product.
STOPWORDS = ("the", "and", "for", "with", "from", "monitor", "camera", "digital", "body", "kit", "pcpartpicker", "canada")
# Model numbers, in titles and model fields.
MODEL_TOKEN = r"(?i)\b[A-Z]{0,6}[0-9]{2,6}[A-Z0-9-]*\b"


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """Runs of letters and digits, lower case, in order, repeats included."""
    return F.regexp_extract_all(F.lower(F.replace(text(c), F.lit("_"), F.lit(" "))), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(c: Column) -> Column:
    return F.array_distinct(words(c))


def informative_tokens(c: Column) -> Column:
    return F.array_sort(F.filter(tokens(c), lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS)))


def spec_key(c: Column) -> Column:
    return F.array_join(words(c), "_")


def model_number(c: Column) -> Column:
    return F.upper(F.regexp_replace(text(c), "[^A-Za-z0-9]", ""))


def model_tokens(c: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text(c), F.lit(MODEL_TOKEN), F.lit(0)), model_number)
    whole = model_number(c)
    also = F.when(whole.rlike("[0-9]"), F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_union(found, also), lambda t: F.length(t) >= 3)


def model_families(models: Column) -> Column:
    """Of an array of model numbers: first four letters with all digits, and the digits alone."""
    def both(m: Column) -> Column:
        digits = F.regexp_replace(model_number(m), "[^0-9]", "")
        letters = F.substring(F.regexp_replace(model_number(m), "[^A-Z]", ""), 1, 4)
        return F.when(digits != "", F.array_distinct(F.array(F.concat(letters, digits), digits))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(models, both)))


def qgrams(c: Column, size: int = 3) -> Column:
    """All substrings of ``size``; a shorter text is its own only one, an empty text has none."""
    n = F.length(c)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(size)))
    return F.when(n > 0, grams).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def jaccard_of_sets(a: Column, b: Column) -> Column:
    """``jaccard``, the union's size taken from those of both and what they share."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def char_similarity(a: Column, b: Column) -> Column:
    grams = lambda c: F.array_distinct(qgrams(F.lower(text(c)), 3))
    return jaccard(grams(a), grams(b))


def name_similarity(a: Column, b: Column) -> Column:
    alike = F.greatest(jaccard(tokens(a), tokens(b)), char_similarity(a, b) * 0.85)
    return F.when(spec_key(a) == spec_key(b), 1.0).otherwise(alike)


def title_case(c: Column) -> Column:
    """Capitals after every non-letter, small letters elsewhere (not only after spaces)."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))), "")
