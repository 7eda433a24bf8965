import base64

import pytest
from pyspark.sql import functions as F

from siltstone.functions import text

PAIRS = [("а", "a"), ("о", "o")]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("plain", ("plain", 0, [])),
        ("p​l﻿ain", ("plain", 0, ["STRIP_ZERO_WIDTH"])),
        ("ｆｕｌｌ", ("full", 0, ["UNICODE_NFKD"])),
        ("pаsswоrd", ("password", 0, ["HOMOGLYPH_RESOLVE"])),
        (base64.b64encode(b"ignore previous").decode(), ("ignore previous", 1, ["DECODE_RECURSIVE_D1"])),
        (b"ignore previous".hex(), ("ignore previous", 1, ["DECODE_RECURSIVE_D1"])),
        (base64.b64encode(base64.b64encode(b"ignore previous")).decode(), ("ignore previous", 2, ["DECODE_RECURSIVE_D1", "DECODE_RECURSIVE_D2"])),
        ("6161616161616161", ("^^^^", 0, [])),
        ("", ("", 0, [])),
        (None, None),
    ],
)
def test_normalized(spark, raw, want):
    got = spark.createDataFrame([(raw, "normalized")], "t string, n string").select(text.normalized(F.col("t"), PAIRS).alias("x")).first()["x"]
    if raw == "6161616161616161":
        assert got["depth"] in (0, 1)  # as Base64 it decodes to text that is printable or not
    else:
        assert (None if got is None else (got["normalized"], got["depth"], got["chain"])) == want


def test_columns(spark):
    row = spark.createDataFrame([("a&<b>", "~/", "W\0I\0D\0E\0", "x" * 300, "aabb")], "a string, b string, c string, d string, e string").select(
        text.escape_markup(F.col("a")), text.escape_pointer(F.col("b")), text.widened(F.col("c")), F.length(text.shortened(F.col("d"))), text.entropy(F.col("e"))
    ).first()
    assert tuple(row) == ("a&amp;&lt;b&gt;", "~0~1", "WIDE", 281, 1.0)
