"""Canonical values and units of product attributes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from knitwork.functions.text import collapse_space, model_number, text, title_case

# Patterns, units and names that decide the canonical form.
PRICE = r"(?iU)([$€£]|usd|eur|gbp)?\s*(\d+(?:[.,]\d+)?)"
NUMBER_UNIT = r"""(?iU)(-?\d+(?:[.,]\d+)?)\s*("|inch|inches|in|hz|ms|mp|megapixels|gb|tb|mm|cm|kg|g|w|cd/m2|cd/m²|nits)?"""
MEASURES = "size|resolution|brightness|response|refresh|weight|height|width|depth|dimension|megapixel|mp|hz"
BRANDS = {"hewlett packard": "HP", "hp": "HP", "lg": "LG", "aoc": "AOC"}
UNITS = {'"': "inch", "inch": "inch", "inches": "inch", "in": "inch", "mp": "MP", "megapixels": "MP", "tb": "GB", "gb": "GB", "cd/m²": "cd/m2", "cd/m2": "cd/m2", "nits": "cd/m2"}
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
RESULT = "struct<value:string,unit:string,method:string,confidence:double>"


def as_float(c: Column) -> Column:
    """A double where the trimmed text is a plain number, else null."""
    trimmed = F.trim(text(c))
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def brand(c: Column) -> Column:
    clean = collapse_space(text(c))
    out = title_case(clean)
    for name, short in BRANDS.items():
        out = F.when(F.lower(clean) == name, short).otherwise(out)
    return out


def category(c: Column) -> Column:
    clean = F.lower(collapse_space(text(c)))
    return (
        F.when(clean.contains("mirrorless"), "mirrorless camera").when(clean.contains("slr"), "dslr camera")
        .when(clean.rlike("monitor|display"), "monitor").when(clean.contains("camera"), "camera").otherwise(clean)
    )


def boolean(c: Column) -> Column:
    v = F.lower(F.trim(text(c)))
    return F.when(v.isin("yes", "true", "1", "y"), "true").when(v.isin("no", "false", "0", "n"), "false").otherwise(v)


def currency(c: Column) -> Column:
    v = F.lower(F.trim(text(c)))
    return F.when(v.rlike(r"\$|usd"), "USD").when(v.rlike("€|eur"), "EUR").when(v.rlike("£|gbp"), "GBP").otherwise(F.upper(v))


def price(c: Column) -> Column:
    """struct<amount, currency>: the first number, a comma in it read as the decimal point; the
    currency only where it stands before the number (else empty); text without a number stays."""
    amount = F.replace(F.regexp_extract(text(c), PRICE, 2), F.lit(","), F.lit("."))
    found = amount != ""
    # rounded half to even on the double, as printf would by exact value
    return F.struct(F.when(found, F.format_string("%.2f", amount.try_cast("double"))).otherwise(F.trim(text(c))).alias("amount"), F.when(found, currency(F.regexp_extract(text(c), PRICE, 1))).alias("currency"))


def measurement_like(attribute: Column) -> Column:
    return F.lower(attribute).rlike(MEASURES)


def canonical_unit(unit: Column, attribute: Column) -> Column:
    low = F.lower(unit)
    out = low
    for name, short in UNITS.items():
        out = F.when(low == name, short).otherwise(out)
    return F.when(unit == "", F.when(F.lower(attribute).contains("resolution"), "px")).otherwise(out)


def measurement(raw: Column, attribute: Column) -> Column:
    """struct<value, unit>, null where the text has no number or neither unit nor name of one."""
    low = F.replace(F.lower(F.trim(text(raw))), F.lit("″"), F.lit('"'))
    number = F.replace(F.regexp_extract(low, NUMBER_UNIT, 1), F.lit(","), F.lit("."))
    unit = canonical_unit(F.regexp_extract(low, NUMBER_UNIT, 2), attribute)
    value = number.try_cast("double") * F.when((unit == "GB") & low.contains("tb"), 1024).otherwise(1)
    shown = F.rtrim(F.rtrim(F.format_string("%.4f", value), F.lit("0")), F.lit("."))
    known = (number != "") & (unit.isNotNull() | measurement_like(attribute))
    return F.when(known, F.struct(shown.alias("value"), F.coalesce(unit, F.lit("")).alias("unit")))


def normalize_value(target: Column, raw: Column, source_attribute: Column) -> Column:
    """The canonical form by target attribute: struct of value, unit, method and confidence."""
    t, v = F.lower(target), F.trim(text(raw))

    def out(value: Column, unit: Column | None, method: str, confidence: float) -> Column:
        return F.struct(F.coalesce(value, F.lit("")).alias("value"), (unit if unit is not None else F.lit(None)).cast("string").alias("unit"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence")).cast(RESULT)

    attribute = F.when(text(source_attribute) != "", source_attribute).otherwise(target)
    measured = measurement(v, attribute)
    return (
        F.when(t == "title", out(collapse_space(v), None, "title_text", 0.98))
        .when(t == "brand", out(brand(v), None, "brand_alias_case", 0.98))
        .when(t == "model_number", out(model_number(v), None, "model_number", 0.95))
        .when(t == "category", out(category(v), None, "category_vocab", 0.9))
        .when(t == "description", out(collapse_space(v), None, "description_text", 0.95))
        .when(t == "price", out(price(v)["amount"], price(v)["currency"], "price_decimal", 0.9))
        .when(t == "currency", out(currency(v), None, "currency_code", 0.95))
        .when(t.startswith("has_") | t.startswith("is_"), out(boolean(v), None, "boolean", 0.9))
        .when(measured.isNotNull(), out(measured["value"], measured["unit"], "measurement_parse", 0.88))
        .otherwise(out(F.lower(collapse_space(v)), None, "normalized_text", 0.8))
    )


def price_similarity(a: Column, b: Column) -> Column:
    relative = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return F.when(a.isNull() | b.isNull(), 0.0).when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - relative))


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def f1(precision: Column, recall: Column) -> Column:
    return safe_div(2 * precision * recall, precision + recall)


def record_uid(source_id: Column, record_id: Column) -> Column:
    """source:record, null where either is blank or the record id is only a name of a row position."""
    ok = (F.trim(text(source_id)) != "") & (F.trim(text(record_id)) != "") & ~F.lower(F.trim(text(record_id))).isin("row_number", "rownumber", "row_index", "index")
    return F.when(ok, F.concat_ws(":", F.trim(source_id), F.trim(record_id)))


def canonical_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*sorted(columns)))


def content_id(prefix: str, length: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length))
