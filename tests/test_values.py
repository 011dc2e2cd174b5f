"""Scalar functions against literal cases."""

import pytest
from pyspark.sql import functions as F

from knitwork.functions import text as T
from knitwork.functions import values as V


def one(spark, column):
    return spark.range(1).select(column().alias("x")).first().x


L = F.lit


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: T.model_number(L("EOS-4000D")), "EOS4000D"),
        (lambda: T.model_number(L("EOS 4000D")), "EOS4000D"),
        (lambda: V.price(L("$310")), ("310.00", "USD")),
        (lambda: V.price(L("1,299.00")), ("1.30", "")),
        (lambda: V.price(L("305 USD")), ("305.00", "")),
        (lambda: V.price(L("call us ")), ("call us", None)),
        (lambda: V.measurement(L("24.3 MP"), L("sensor resolution")), ("24.3", "MP")),
        (lambda: V.measurement(L("2 TB"), L("disk")), ("2048", "GB")),
        (lambda: V.measurement(L("1024 x 768"), L("resolution")), ("1024", "px")),
        (lambda: V.measurement(L("12"), L("colour")), None),
        (lambda: V.measurement(L("3 in stock"), L("stock")), ("3", "inch")),
        (lambda: T.spec_key(L("Body Colour")), "body_colour"),
        (lambda: V.record_uid(L("source_a"), L("record_001")), "source_a:record_001"),
        (lambda: V.record_uid(L("source_a"), L("row_number")), None),
        (lambda: V.record_uid(L(" "), L("x")), None),
        (lambda: V.brand(L("o'neil  hewlett-packard")), "O'Neil Hewlett-Packard"),
        (lambda: V.brand(L(" Hewlett Packard ")), "HP"),
        (lambda: V.category(L("Mirrorless DSLR")), "mirrorless camera"),
        (lambda: V.category(L("LCD display")), "monitor"),
        (lambda: V.boolean(L(" YES ")), "true"),
        (lambda: V.as_float(L("1_000")), None),
        (lambda: V.as_float(L("1f")), None),
        (lambda: V.as_float(L("-2.50")), -2.5),
        (lambda: V.price_similarity(L(100.0), L(50.0)), 0.5),
        (lambda: V.price_similarity(L(None).cast("double"), L(50.0)), 0.0),
        (lambda: T.qgrams(L("ab"), 3), ["ab"]),
        (lambda: T.qgrams(L(""), 3), []),
        (lambda: T.qgrams(L("abcd"), 3), ["abc", "bcd"]),
        (lambda: T.jaccard(T.tokens(L("")), T.tokens(L(""))), 0.0),
        (lambda: T.name_similarity(L("Body Colour"), L("body_colour")), 1.0),
        (lambda: T.informative_tokens(L("The Canon EOS_4000D camera kit")), ["4000d", "canon", "eos"]),
        (lambda: T.model_tokens(L("EOS-4000D, x")), ["4000D", "EOS4000DX"]),
        (lambda: T.model_families(F.array(L("EOS 4000D"), L("none"))), ["EOSD4000", "4000"]),
        (lambda: V.normalize_value(L("has_hdmi_port"), L("Yes"), L("hdmi"))["value"], "true"),
        (lambda: V.normalize_value(L("response_time"), L("5 ms"), L("response time")), ("5", "ms", "measurement_parse", 0.88)),
        (lambda: V.normalize_value(L("color"), L("  Deep  Red "), L("")), ("deep red", None, "normalized_text", 0.8)),
    ],
)
def test_literal(spark, column, want):
    got = one(spark, column)
    assert (tuple(got) if isinstance(want, tuple) else got) == want
