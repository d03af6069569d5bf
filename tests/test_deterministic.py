"""Keys, identifiers, equal values and relation tables."""

import pytest
from pyspark.sql import functions as F

from relweave import Catalog, EntityTable, ForeignKey
from relweave.operators import deterministic as det, documents as docs


def table(spark, name, rows, schema, pk=("id",), dims=(), unique=()):
    df = spark.createDataFrame(rows, schema)
    for column, value in (("name", name), ("class_name", name.title())):
        if column not in df.columns:
            df = df.withColumn(column, F.lit(value))
    return EntityTable(name, df, pk, dims, unique)


def pairs(df):
    return sorted((r["source"], r["target"]) for r in df.select("source", "target").collect())


def test_fk_on_primary_key_and_nulls(spark):
    parent = table(spark, "parent", [(1,), (2,)], "id int")
    child = table(spark, "child", [(10, 1), (11, None), (12, 9), (13, 2)], "id int, p long")
    edges = det.fk_edges(Catalog.of([parent, child], [ForeignKey("child", ("p",), "parent", ("id",))]))
    assert pairs(edges) == [("child:10", "parent:1"), ("child:13", "parent:2")]
    row = edges.where("source = 'child:10'").first()
    assert (row["relation_type"], row["strength"], row["confidence"], row["direction"]) == ("外键关联", "strong", 1.0, "source_to_target")
    assert row["evidence"][0]["reason"] == "child.p references parent.id" and row["evidence"][0]["source_value"] == "1"


def test_fk_on_other_column_last_row_wins(spark):
    parent = table(spark, "parent", [(1, "a"), (2, "a"), (10, "a"), (3, None)], "id int, code string")
    child = table(spark, "child", [(1, "a"), (2, None)], "id int, code string")
    edges = det.fk_edges(Catalog.of([parent, child], [ForeignKey("child", ("code",), "parent", ("code",))]))
    assert pairs(edges) == [("child:1", "parent:10")]


def test_composite_fk(spark):
    parent = table(spark, "parent", [(1, "x"), (1, "y")], "a int, b string", pk=("a", "b"))
    child = table(spark, "child", [(5, "y", 1), (6, None, 1), (7, "x", 2)], "id int, kb string, ka int")
    edges = det.fk_edges(Catalog.of([parent, child], [ForeignKey("child", ("kb", "ka"), "parent", ("b", "a"))]))
    assert pairs(edges) == [("child:5", "parent:1|y")]
    assert [e["source_field"] for e in edges.first()["evidence"]] == ["kb", "ka"]


def test_repeated_parent_rows_do_not_fan_out(spark):
    parent = table(spark, "parent", [(1,), (1,)], "id int")
    child = table(spark, "child", [(10, 1)], "id int, p int")
    assert pairs(det.fk_edges(Catalog.of([parent, child], [ForeignKey("child", ("p",), "parent", ("id",))]))) == [("child:10", "parent:1")]


def test_types_of_different_families_never_match(spark):
    parent = table(spark, "parent", [(1,)], "id int")
    child = table(spark, "child", [(10, "1")], "id int, p string")
    with pytest.raises(ValueError):
        det.fk_edges(Catalog.of([parent, child], [ForeignKey("child", ("p",), "parent", ("id",))]))
    doubles = table(spark, "doubles", [(10, 1.0), (11, float("nan"))], "id int, p double")
    assert pairs(det.fk_edges(Catalog.of([parent, doubles], [ForeignKey("doubles", ("p",), "parent", ("id",))]))) == [("doubles:10", "parent:1")]


def identifiers(spark, left, right, unique=True):
    l = table(spark, "l", left, "id int, key string", dims=("key",), unique=(("key",),) if unique else ())
    r = table(spark, "r", right, "id int, key string", dims=("key",), unique=(("key",),))
    plan = det.IdentifierPlan("l", "key", "r", "key", "same", "undirected", "why")
    return det.unique_identifier_edges(Catalog.of([l, r]), [plan])


def test_identifiers(spark):
    edges = identifiers(spark, [(1, " E-7 "), (2, None), (3, "dup"), (4, "DUP"), (5, "")], [(1, "e-7"), (2, None), (3, "dup"), (4, "")])
    assert pairs(edges) == [("l:1", "r:1"), ("l:5", "r:4")]
    proof = edges.where("source = 'l:1'").first()["evidence"][0]
    assert (proof["source_value"], proof["target_value"], proof["method"]) == (" E-7 ", "e-7", "unique_identifier")
    assert pairs(identifiers(spark, [(1, "a")], [(1, "a")], unique=False)) == []


def test_value_equality_and_merge(spark):
    a = table(spark, "a", [(1, 5), (2, 5), (3, None)], "id int, v int")
    b = table(spark, "b", [(1, 5, 1), (2, 5, 2), (3, None, None)], "id int, v int, a_id int")
    catalog = Catalog.of([a, b], [ForeignKey("b", ("a_id",), "a", ("id",))])
    match = det.FieldMatch("a", "v", "b", "v", 0.7)
    equal = det.value_equality_pairs(catalog, [match])
    assert len(pairs(equal)) == 4
    groups = det.value_equality_groups(catalog, [match]).first()
    assert (groups["source_rows"], groups["target_rows"], groups["pair_count"]) == (2, 2, 4)
    merged = {(r["source"], r["target"]): r for r in det.merge_labels(det.fk_pairs(catalog).unionByName(equal)).collect()}
    assert merged["b:1", "a:1"]["labels"] == ["值相等(v↔v)", "外键关联"] and merged["b:1", "a:1"]["confidence"] == 1.0
    assert merged["a:1", "b:2"]["labels"] == ["值相等(v↔v)"] and merged["a:1", "b:2"]["confidence"] == 0.7


def bridge(spark, rows, name="MetargeTRL", rules=det.OrientationRules()):
    process = table(spark, "processes", [(1,), (2,)], "id int").frame.withColumn("class_name", F.lit("MEProcess"))
    operation = table(spark, "operations", [(1,), (3,)], "id int").frame.withColumn("class_name", F.lit("MEOperation"))
    part = table(spark, "parts", [(7,)], "id int").frame.withColumn("class_name", F.lit("Assembly"))
    twin = table(spark, "twins", [(7,)], "id int").frame.withColumn("class_name", F.lit("Twin"))
    twin2 = table(spark, "twins2", [(7,)], "id int").frame.withColumn("class_name", F.lit("Twin"))
    tables = [EntityTable(n, f, ("id",)) for n, f in (("processes", process), ("operations", operation), ("parts", part), ("twins", twin), ("twins2", twin2))]
    frame = spark.createDataFrame(rows, "left_id string, right_id string, left_class string, right_class string")
    found = det.find_relation_tables({name: frame, "other": frame})
    return det.relation_table_edges(found, docs.build_documents(Catalog.of(tables)), rules)


def test_relation_tables(spark):
    edges = bridge(
        spark,
        [("1", "3", "MEProcess", "MEOperation"), ("1", "3", "MEProcess", "MEOperation"), ("3", "1", "MEOperation", "MEProcess"),
         ("1", "2", "MEProcess", "MEProcess"), ("7", "3", "Assembly", "MEOperation"), ("1", "7", "MEProcess", "Twin"), ("9", "3", "MEProcess", "MEOperation"),
         (None, "3", "MEProcess", "MEOperation"), ("3", "1", "MEOperation", "Unknown")],
    )
    rows = {(r["source"], r["target"], r["relation_type"]): r for r in edges.collect()}
    assert set(rows) == {("processes:1", "operations:3", "包含工序"), ("operations:3", "parts:7", "关联物料")}
    proofs = rows["processes:1", "operations:3", "包含工序"]["evidence"]
    assert sorted((p["source_field"], p["reason"]) for p in proofs) == [
        ("left_id", "MetargeTRL records MEProcess to MEOperation"), ("right_id", "MetargeTRL records MEOperation to MEProcess"),
    ]
    assert rows["operations:3", "parts:7", "关联物料"]["evidence"][0]["source_field"] == "right_id"


def test_opposite_unknown_rows_stay_two_relations(spark):
    edges = bridge(spark, [("1", "3", "MEProcess", "MEOperation"), ("3", "1", "MEOperation", "MEProcess")], rules=det.OrientationRules({}))
    assert pairs(edges) == [("operations:3", "processes:1"), ("processes:1", "operations:3")]
    assert {r["relation_type"] for r in edges.collect()} == {"结构关联"}


def test_relation_table_names(spark):
    frame = spark.createDataFrame([], "left_id string, right_id string, left_class string, right_class string")
    assert set(det.find_relation_tables({"Relation_ID": frame, "x": frame, "metargetrl": frame.drop("left_id")})) == {"Relation_ID"}


def test_relation_tables_are_put_together_before_their_ends_are_looked_up(spark):
    """Equal to the steps one by one, and no text that follows from others is in a shuffle."""
    from relweave.operators import deterministic as det

    rows = [("1", "7", "Order", "Part"), ("1", "7", "Order", "Part"), ("2", "9", "Order", "Part"), (None, "7", "Order", "Part"), ("3", "x", "Order", "Part")]
    turned = [("7", "1", "Part", "Order"), ("9", "9", "Part", "Part")]
    schema = "left_id string, right_id string, left_class string, right_class string"
    tables = {"metargetrl": spark.createDataFrame(rows, schema), "relation_id": spark.createDataFrame(turned, schema)}
    ids = [("orders", "Order", "1"), ("orders", "Order", "2"), ("part", "Part", "7"), ("part", "Part", "9"), ("part", "Part", "x"), ("other", "Part", "x")]
    documents = spark.createDataFrame([(f"{t}:{k}", t, c, k) for t, c, k in ids], "entity_id string, table_name string, class_name string, single_key string")
    rules = det.OrientationRules({("Order", "Part"): "contains"})
    found = det.relation_table_edges(tables, documents, rules)
    stepwise = det.relation_dedupe(det.oriented_relation_rows(tables, det.endpoint_index(documents), rules))
    assert sorted(map(str, found.collect())) == sorted(map(str, stepwise.collect())) and found.count() == 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "ObjectHashAggregate" in line or "SortAggregate" in line and "collect_set" in line]
