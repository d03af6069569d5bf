"""Edge merging, the roll-up to tables and run totals."""

import random

import pytest

from relweave.operators import graph, relations as rel
from relweave.operators.deterministic import relation_schema

PROOF = [("f", "1", "g", "1", "foreign_key", "why")]


def relation(source, target, kind="k", strength="weak", confidence=0.5, direction="source_to_target", label="相关"):
    return (source, target, source.split(":")[0], target.split(":")[0], kind, label, direction, strength, confidence, "because", PROOF, None, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, relation_schema())


def shown(spark, rows):
    return {(r["source_table"], r["target_table"]): r for r in graph.table_edges(rel.edge_relations(frame(spark, rows))).collect()}


def test_gate(spark):
    three = [relation(f"a:{i}", f"b:{i}") for i in range(3)]
    assert shown(spark, three)["a", "b"]["weak_count"] == 3
    assert shown(spark, three[:2]) == {}
    assert shown(spark, [*three[:2], relation("a:9", "b:9", kind="other")]) == {}
    one = shown(spark, [relation("b:1", "a:1", strength="strong", confidence=1.0)])
    assert one["a", "b"]["id"] == "table:1:a1:b"
    assert shown(spark, [relation("a:1", "a:2", strength="strong")]) == {}


def test_roll_up(spark):
    rows = [relation("a:1", "b:1", "x", "strong", 1.0), relation("b:1", "a:1", "y", "weak", 0.1), relation("a:2", "b:1", "x", "strong", 0.2)]
    edge = shown(spark, rows)["a", "b"]
    assert (edge["relation_types"], edge["strong_count"], edge["weak_count"], edge["entity_edge_count"]) == (["x", "y"], 2, 1, 2)
    assert edge["average_confidence"] == round((1.0 + 0.1 + 0.2) / 3, 12)
    edges = rel.edge_relations(frame(spark, rows))
    support = graph.table_edge_support(edges, graph.table_edges(edges))
    assert sorted(r["edge_id"] for r in support.collect()) == ["entity:3:a:13:b:1", "entity:3:a:23:b:1"]


def test_edges_keep_every_relation_in_one_order(spark):
    rows = [relation("a:1", "b:1", "x", "strong", 1.0), relation("b:1", "a:1", "x", "strong", 1.0), relation("a:1", "b:1", "y"), relation("a:1", "b:1", "y")]
    rows += [relation(f"a:{i}", f"c:{i % 3}", "z", confidence=i / 10) for i in range(9)]
    expected = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        merged = graph.entity_edges(rel.edge_relations(frame(spark, rows).repartition(seed + 1)))
        got = sorted((r["edge_id"], r["relation_count"], str(r["relations"])) for r in merged.collect())
        expected = expected or got
        assert got == expected
    first = next(r for r in merged.collect() if r["edge_id"] == "entity:3:a:13:b:1")
    assert first["relation_count"] == 4 and [x["copies"] for x in first["relations"]].count(2) == 1


def test_sort_key_keeps_nulls_and_orders_keys(spark):
    rows = frame(spark, [relation("a:1", "b:1")])
    key = rows.select(graph.relation_sort_key(rows)).first()[0]
    assert key.startswith('{"confidence":0.5,"direction":"source_to_target","display_label":"相关","evidence":[{"method":"foreign_key"')
    assert '"model_id":null' in key


def test_hot_pair_collapses_before_it_is_gathered(spark):
    hot = frame(spark, [relation("a:1", "b:1")]).crossJoin(spark.range(20000)).drop("id")
    merged = graph.entity_edges(rel.edge_relations(hot)).first()
    assert merged["relation_count"] == 20000 and len(merged["relations"]) == 1


def test_endpoints(spark):
    relations = frame(spark, [relation("a:1", "b:1"), relation("a:2", "b:9")])
    documents = spark.createDataFrame([("a:1",), ("a:2",), ("b:1",)], "entity_id string")
    assert [r["missing"] for r in graph.dangling_relations(relations, documents).collect()] == ["b:9"]
    with pytest.raises(ValueError):
        graph.require_endpoints(relations, documents)
    assert graph.require_endpoints(relations.limit(1), documents).count() == 1


@pytest.mark.parametrize(
    "outcomes, edges, flags, status",
    [([], 0, {}, "complete"), (["failed"], 0, {}, "failed"), (["failed"], 1, {}, "partial"), (["failed", "completed"], 0, {}, "partial"),
     (["pending"], 0, {}, "partial"), (["completed"], 1, {}, "complete"), ([], 0, {"planner_failed": True}, "failed"), ([], 1, {"structural_failed": True}, "partial"),
     ([], 0, {"timed_out": True}, "partial")],
)
def test_status(spark, outcomes, edges, flags, status):
    documents = spark.range(4)
    judged = spark.createDataFrame([("p", "s", 2, o) for o in outcomes], "plan_id string, source_id string, candidate_count int, status string")
    totals = graph.diagnostics(documents, spark.range(2), judged, frame(spark, [relation("a:1", "b:1")] * edges))
    row = graph.run_status(totals, **flags).first()
    assert row["status"] == status and row["entities_read"] == 4 and row["plans_created"] == 2
    assert (row["warning"] is not None) == (status == "complete" and edges == 0)
    assert row["candidates_pending"] == 2 * sum(o != "completed" for o in outcomes)
    counts = graph.outcome_counts(judged).first()
    assert counts["failed_groups"] == outcomes.count("failed") and counts["completed_candidates"] == 2 * outcomes.count("completed")


def test_plans_move_no_edge_ids(spark):
    """Ids of edges are made after a shuffle, and the ends of an edge travel once."""
    from relweave.operators import explore, ladder

    edges = rel.edge_relations(frame(spark, [relation("a:1", "b:1")]))
    frames = [
        graph.entity_edges(edges), graph.edge_ends(edges), explore.visible_edges(edges, 0.5), explore.adjacency_index(edges, 0.5),
        explore.neighbor_union(edges), explore.label_lists(edges, ["edge_source", "edge_target"]), ladder.edge_ladder(edges),
    ]
    for moved in frames:
        plan = moved._jdf.queryExecution().executedPlan().toString()
        shuffles = [line for line in plan.splitlines() if "Exchange" in line and "AdaptiveSparkPlan" not in line]
        assert len(shuffles) == 1, plan
        assert "edge_id" not in shuffles[0]


def test_tasks_are_bounded_by_rows(spark, monkeypatch):
    """What is grouped by edge is dealt by the number of relations, not by their compressed size, and not grouped before it is dealt."""
    from relweave import session
    from relweave.operators import deterministic, documents, explore, ladder
    from relweave.sources.catalog import Catalog, EntityTable

    monkeypatch.setattr(session, "ROWS_PER_TASK", 10)
    edges = rel.edge_relations(frame(spark, [relation(f"a:{i}", f"b:{i % 7}") for i in range(300)]))
    tables = graph.table_edges(edges)
    frames = [
        graph.entity_edges(edges), graph.edge_ends(edges), graph.crossing_ends(edges), graph.table_edge_support(edges, tables), explore.visible_edges(edges, 0.4),
        explore.neighbor_union(edges), explore.label_lists(edges, ["edge_id"]), explore.label_lists(edges, ["edge_source", "edge_target"]), ladder.edge_ladder(edges),
    ]
    assert [f.rdd.getNumPartitions() for f in frames] == [30] * len(frames)
    assert [f.count() for f in frames] == [300] * 5 + [600] + [300] * 3
    assert tables.first()["entity_edge_count"] == 300
    names = [(i, "n", kind) for kind in ("A", "B") for i in range(20)]
    named = spark.createDataFrame(names, "id int, name string, class_name string")
    catalog = Catalog.of([EntityTable(kind.lower(), named.where(f"class_name = '{kind}'"), ("id",)) for kind in ("A", "B")])
    lines = spark.createDataFrame([(i, j, "A", "B") for i in range(20) for j in range(20)], "left_id int, right_id int, left_class string, right_class string")
    found = deterministic.relation_table_edges({"relation_id": lines.union(lines)}, documents.build_documents(catalog))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and found.count() == 400
