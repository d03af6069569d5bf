"""Text, JSON and sort-key forms of typed values; entity ids."""

import json
import random
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F, types as T

from relweave.functions import identity
from relweave.functions.values import as_text, order_text, typed_json

DOUBLES = [0.0, 1.0, -2.5, 1e7, 12345678.9, 1e15, 9.9e15, 1e16, 1.5e16, 1.25e22, 0.001, 0.00012, -0.0005, 1e-5, 1.5e-7, 0.1 + 0.2,
           float("inf"), float("-inf"), float("nan"), 123456789012345.67, 2e-3, 1e23, 1.7976931348623157e308, -1.5e-300, 2.0**-44]
_RNG = random.Random(11)
DOUBLES += [_RNG.uniform(-1, 1) * 10.0 ** _RNG.randint(-25, 25) for _ in range(300)] + [round(_RNG.uniform(-1e9, 1e9), 2) for _ in range(100)]


def test_double_text_is_pythons(spark):
    df = spark.createDataFrame([(x,) for x in DOUBLES], "x double")
    assert [r[0] for r in df.select(as_text("x", T.DoubleType())).collect()] == [str(x) for x in DOUBLES]


def test_other_texts(spark):
    df = spark.createDataFrame(
        [(True, datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 60), date(2024, 1, 2), Decimal("1.50"), None)],
        "b boolean, t timestamp_ntz, u timestamp_ntz, d date, n decimal(10,2), m int",
    )
    row = df.select(*[as_text(c, df.schema[c].dataType).alias(c) for c in df.columns]).first()
    assert tuple(row) == ("True", "2024-01-02 03:04:05", "2024-01-02 03:04:05.000060", "2024-01-02", "1.50", None)


def test_typed_json(spark):
    df = spark.createDataFrame(
        [(2**53, 7, float("nan"), 1.5, 'a"b', Decimal("1.50"), datetime(2024, 1, 2, 3, 4, 5), bytearray(b"ab"), [1, None], {"k": None}, (1, "x"), None, True)],
        "big long, small long, bad double, x double, s string, n decimal(10,2), t timestamp_ntz, raw binary, a array<int>, m map<string,double>, "
        "r struct<p:int,q:string>, missing string, flag boolean",
    )
    row = df.select(*[typed_json(c, df.schema[c].dataType).alias(c) for c in df.columns]).first().asDict()
    assert {k: json.loads(v) for k, v in row.items()} == {
        "big": {"$type": "integer", "value": str(2**53)}, "small": 7, "bad": {"$type": "float", "value": "nan"}, "x": 1.5, "s": 'a"b',
        "n": {"$type": "decimal", "value": "1.50"}, "t": {"$type": "datetime", "value": "2024-01-02T03:04:05"},
        "raw": {"$type": "bytes", "encoding": "base64", "value": "YWI="}, "a": [1, None], "m": {"k": None}, "r": {"p": 1, "q": "x"},
        "missing": None, "flag": True,
    }


def test_order_text_sorts_like_the_value(spark):
    values = [-(2**63), -10, -9, 0, 2, 10, 2**63 - 1]
    df = spark.createDataFrame([(x,) for x in values], "x long")
    texts = [r[0] for r in df.select(order_text("x", T.LongType())).collect()]
    assert texts == sorted(texts) and len(set(texts)) == len(values)


def test_entity_ids_never_collide(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c")], "p string, q string")
    assert [r[0] for r in df.select(identity.entity_id(df, "links", ["p", "q"])).collect()] == ["links:a%7Cb|c", "links:a|b%7Cc"]
    one = spark.createDataFrame([(42,)], "id int")
    assert one.select(identity.entity_id(one, "catalog:archive", ["id"])).first()[0] == "catalog%3Aarchive:42"
    odd = spark.createDataFrame([(" /*~é%+",)], "id string")
    from urllib.parse import quote

    assert odd.select(identity.entity_id(odd, "t", ["id"])).first()[0] == "t:" + quote(" /*~é%+", safe="")


def test_edge_id_counts_code_points(spark):
    df = spark.createDataFrame([("件:1", "b")], "s string, t string")
    assert df.select(identity.edge_id("entity", F.col("s"), F.col("t"))).first()[0] == "entity:3:件:11:b"
