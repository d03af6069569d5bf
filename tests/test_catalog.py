"""Column roles, scopes, profiles and snapshots."""

import pytest
from pyspark.sql import functions as F

from relweave import Catalog, EntityTable, ForeignKey
from relweave.operators import documents as docs
from relweave.sources import catalog as cat, profile, snapshot


def small(spark):
    users = spark.createDataFrame([(1, "Ann", "a@x", "U"), (2, " ", None, "U")], "id int, name string, email string, class_name string")
    orders = spark.createDataFrame([(1, 1, 5, "o1", "O"), (2, None, 6, "o2", None)], "id int, user_id int, amount int, name string, className string")
    categories = spark.createDataFrame([], "id int, class string, label string")
    return Catalog.of(
        [EntityTable("users", users, ("id",), ("email", "name", "id")), EntityTable("orders", orders, ("id",), ("amount", "user_id")),
         EntityTable("categories", categories, ("id",))],
        [ForeignKey("orders", ("user_id",), "users", ("id",))],
    )


def test_roles():
    assert cat.NAME in cat.column_roles(" Name ") and cat.NAME not in cat.column_roles("user_name")
    assert all(cat.CLASS in cat.column_roles(c) for c in ("class_name", "className", "class", "ClassName", "CLASSNAME", "classname"))
    assert [cat.column_roles(c).get(cat.CODE) for c in ("partCode", "serial_no", "modelId", "code_number", "nodes")] == [0, 2, 4, 0, None]


def test_scan_and_dimensions(spark):
    catalog = small(spark)
    assert catalog.scan("users").columns == ["email", "name", "id", "class_name"]
    assert catalog.auxiliary_dimensions("users") == ["email"]
    assert catalog.auxiliary_dimensions("orders") == ["amount"]
    assert catalog.allowed_dimensions("users") == ["name", "email"]
    assert catalog.eligible_tables() == ["users", "orders"]
    with pytest.raises(ValueError):
        catalog.scoped(["nothing"])


def test_fingerprint_follows_the_metadata(spark):
    catalog = small(spark)
    first = catalog.fingerprint()
    catalog.require_fingerprint(first)
    renamed = Catalog.of([EntityTable("users", catalog.tables["users"].frame.withColumnRenamed("email", "mail"), ("id",))])
    assert renamed.fingerprint() != first
    with pytest.raises(ValueError):
        renamed.require_fingerprint(first)


def test_profiles(spark):
    catalog = small(spark)
    counts = {r["table_name"]: r["row_count"] for r in profile.row_counts(catalog).collect()}
    assert counts == {"users": 2, "orders": 2, "categories": 0}
    keys = {(r["table_name"], r["key_kind"]): r for r in profile.key_profile(catalog).collect()}
    assert keys["orders", "foreign"]["null_rows"] == 1 and keys["users", "primary"]["distinct_keys"] == 2
    assert keys["categories", "primary"]["row_count"] == 0
    summary = {r["table_name"]: r for r in profile.table_summary(catalog.scoped(["users", "orders"])).collect()}
    assert summary["users"]["name_samples"] == ["Ann"] and summary["orders"]["class_name_samples"] == ["O"]
    assert summary["users"]["column_names"] == ["id", "name", "email", "class_name"]
    flags = {r["table_name"]: r["has_blank_name"] for r in docs.quality_flags(catalog).collect()}
    assert flags == {"users": True, "orders": False}


@pytest.mark.parametrize(
    "proposals, status",
    [([("users", "用户")], "inferred"), ([("users", "用户"), ("nope", "x")], "fallback"), ([("users", "用户"), ("users", "人")], "fallback"),
     ([("users", "Ann")], "fallback"), ([("users", "secret = 1")], "fallback"), ([("users", " ")], "fallback")],
)
def test_inferred_names_are_taken_whole_or_not(spark, proposals, status):
    summary = profile.table_summary(small(spark).scoped(["users", "orders"]))
    inferred = spark.createDataFrame(proposals, "table_name string, semantic_name string")
    merged = {r["table_name"]: r for r in profile.merge_inferred_names(summary, inferred).collect()}
    assert merged["users"]["status"] == status and merged["orders"]["semantic_name"] == "Orders 数据"


def test_table_search(spark):
    summary = profile.merge_inferred_names(
        profile.table_summary(small(spark).scoped(["users", "orders"])), spark.createDataFrame([("users", "用户")], "table_name string, semantic_name string")
    )
    assert [r["table_name"] for r in profile.search_tables(summary, " 用户").collect()] == ["users"]
    assert profile.search_tables(summary, "ORD").count() == 1 and profile.search_tables(summary, "").count() == 2


def test_documents(spark):
    rows = {r["entity_id"]: r for r in docs.build_documents(small(spark).scoped(["users", "orders"])).collect()}
    assert rows["users:1"]["search_text"] == "Ann；U；email：a@x"
    assert rows["users:2"]["display_name"] == "未命名对象" and rows["users:2"]["search_text"] == "未命名对象；U；email：None"
    assert rows["users:2"]["normalized_dimensions"] == {"email": ""} and rows["users:2"]["typed_dimensions"] == {"email": "null"}
    assert rows["orders:2"]["class_name"] is None


def test_signatures_split_by_name_and_class(spark):
    rows = [(1, "X", "A", "same"), (2, "x ", "A", "SAME"), (3, "X", "B", "same"), (4, "Y", "A", "same")]
    df = spark.createDataFrame(rows, "id int, name string, class_name string, v string")
    documents = docs.build_documents(Catalog.of([EntityTable("t", df, ("id",), ("v",))]))
    groups = docs.signature_groups(documents)
    assert sorted((r["representative_id"], r["member_count"]) for r in groups.collect()) == [("t:1", 2), ("t:3", 1), ("t:4", 1)]
    members = docs.signature_members(documents, groups).where("entity_id = 't:2'").first()
    assert members["representative_id"] == "t:1"


def test_document_conflicts(spark):
    df = spark.createDataFrame([(1, "a", "K", "x"), (1, "a", "K", "x"), (2, "b", "K", "x"), (2, "b", "K", "y")], "id int, name string, class_name string, v string")
    documents = docs.build_documents(Catalog.of([EntityTable("t", df, ("id",), ("v",))]))
    assert [(r["entity_id"], r["versions"]) for r in docs.document_conflicts(documents).collect()] == [("t:2", 2)]
    with pytest.raises(ValueError):
        docs.checked_documents(documents)
    assert docs.checked_documents(documents.where("entity_id = 't:1'")).count() == 1


def test_snapshot_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("t:1", {"a": "1"}, 2.5)], "id string, dimensions map<string,string>, x double")
    snapshot.write_snapshot({"entity_nodes": nodes}, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p" / "entity_nodes")).collect() == nodes.collect()
    snapshot.write_snapshot({"entity_nodes": nodes}, str(tmp_path / "j"), "json")
    assert spark.read.text(str(tmp_path / "j" / "entity_nodes")).first()[0] == '{"id":"t:1","dimensions":{"a":"1"},"x":2.5}'
    legacy = snapshot.legacy_json_value(spark.sql("select timestamp_ntz'2024-01-02 03:04:05' as t, cast(1.5 as decimal(5,2)) as d, date'2024-01-02' as e")).first()
    assert tuple(legacy) == ("2024-01-02T03:04:05", 1.5, "2024-01-02")
    with pytest.raises(ValueError):
        snapshot.write_snapshot({"other": nodes}, str(tmp_path / "q"))
