"""The text of bytes, arrays, maps and structs: Python's own."""

from datetime import date, datetime
from decimal import Decimal

import pytest

from relweave.functions.text import normalize_value
from relweave.functions.values import as_text

TEXTS = [
    "", "a", "it's", 'say "x"', "it's \"x\"", "back\\slash", "two\nlines\tand\rmore", "\x00\x1f\x7f\x80\xa0\xad", "主轴 é ß", " 　​", "𐍈😀", " ", "\\n", "'", '"', "\\'",
]


def as_python(value):
    if isinstance(value, bytearray):
        return bytes(value)
    if hasattr(value, "asDict"):
        return {k: as_python(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [as_python(v) for v in value]
    if isinstance(value, dict):
        return {as_python(k): as_python(v) for k, v in value.items()}
    return value


CASES = [
    ("array<string>", [TEXTS, [], [None, "x"], None]),
    ("array<int>", [[1, None, -3], []]),
    ("array<double>", [[1.0, 0.1, 1e16, 1e-5, float("nan"), float("inf"), -2.5e-7, None]]),
    ("array<float>", [[1.0, 0.5, 0.10000000149011612]]),
    ("array<boolean>", [[True, False, None]]),
    ("binary", [b"", b"ab", bytes(range(256)), b"it's", b'it\'s "x"', b'"', None]),
    ("array<binary>", [[b"a\\", None]]),
    ("map<string,int>", [{"k": 1, "it's": None}, {}]),
    ("map<int,array<string>>", [{1: ["a", None], 2: []}]),
    ("struct<p:int,q:string>", [(1, "x"), (None, None)]),
    ("array<struct<d:date,t:timestamp_ntz,n:decimal(10,2)>>", [[(date(2024, 1, 2), datetime(2024, 1, 2, 3, 4), Decimal("1.50")), (None, datetime(2024, 1, 2, 3, 4, 5, 60), None), (None, datetime(2024, 12, 2, 0, 0, 7), Decimal("-3.00"))]]),
    ("array<array<string>>", [[["a"], [], None]]),
]


@pytest.mark.parametrize("kind, values", CASES)
def test_text_of_nested_values(spark, kind, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    got = {r.i: (r.v, r.t) for r in df.select("i", "v", as_text("v", df.schema["v"].dataType).alias("t")).collect()}
    for value, text in got.values():
        assert text == (None if value is None else str(as_python(value)))


def test_normalised_text_of_a_list(spark):
    df = spark.createDataFrame([(["Ａ b", "C'"],)], "v array<string>")
    assert df.select(normalize_value(as_text("v", df.schema["v"].dataType))).first()[0] == """['ab',"c'"]"""
