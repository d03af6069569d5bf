"""Questions to relations that are read by buckets of their edge's smaller end: the same answers, and hardly a row moved."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from relweave.operators import explore, graph, relations as rel
from relweave.plans import q_graph
from relweave.sources import snapshot


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    pick = random.Random(3)
    ids = [f"{t}:{i}" for t in "abc" for i in (*range(8, 12), *range(98, 103))]
    rows = [(pick.choice(ids), pick.choice([*ids, "x:1"]), pick.choice(["contains", "uses"])) for _ in range(200)] + [("a:8", "a:8", "uses")]
    df = spark.createDataFrame(rows, "source string, target string, relation_type string")
    tables = {f"{side}_table": F.substring(side, 1, 1) for side in ("source", "target")}
    proof = F.array(rel.evidence("f", F.lit("v"), "g", F.lit("w"), "m", "r"))
    edges = rel.edge_relations(rel.as_relations(df, **tables, explanation="e", evidence=proof)).cache()
    path, of = str(tmp_path_factory.mktemp("stored")), snapshot.Buckets(3, "edge_source", ("edge_source", "edge_target"))
    parts = {"relations": rel.stored_form(edges).repartition(3, "edge_source")}
    stored = rel.from_stored_form(snapshot.commit_snapshot(spark, parts, path, "f", buckets={"relations": of}).parts(spark)["relations"])
    names = [(i, i[0], f"name {i}", "") for i in [*ids, "a:9", "lone:1"] if i != "b:99"]
    shown = spark.createDataFrame(names, "id string, table_id string, primary string, secondary string").cache()
    return edges, stored, shown


def rows(df):
    return sorted(map(repr, map(tuple, df.select(*sorted(df.columns)).collect())))


def moved(df, column):
    """Exchanges of a plan by a column."""
    return re.findall(rf"Exchange hashpartitioning\({column}#", df._jdf.queryExecution().executedPlan().toString())


def test_stored_form_keeps_every_column(case):
    edges, stored, _ = case
    assert stored.columns == edges.columns and rows(stored) == rows(edges)


def test_same_answers(case):
    edges, stored, shown = case
    nodes = shown.withColumn("display_name", F.col("primary"))
    for ask in (
        lambda e: explore.drill_down(graph.table_edge_support(e, graph.table_edges(e)), e, shown),
        lambda e: explore.drill_down(graph.support_ends(e, graph.table_edges(e)), e, shown),
        lambda e: explore.node_chains(nodes, e, shown), lambda e: explore.degrees(shown, e), lambda e: explore.connected_components(shown, e),
        lambda e: explore.table_edge_view(graph.table_edges(e), graph.support_ends(e, graph.table_edges(e)), e, 0.5),
        lambda e: explore.node_detail(e, shown), graph.entity_edges, graph.table_edges,
    ):
        assert rows(ask(stored)) == rows(ask(edges))


def test_first_edges_by_their_ids(case):
    """Lengths count before ids do: the text of an edge's id begins with them."""
    edges, stored, _ = case
    ends = edges.select("edge_id", *graph.ENDS).distinct().collect()
    first = {}
    for e in ends:
        for node, other in ((e["edge_source"], e["edge_target"]), (e["edge_target"], e["edge_source"])):
            first[node] = min(first.get(node, (e["edge_id"], other)), (e["edge_id"], other))
    for frame in (edges, stored):
        found = graph.with_edge_id(explore.first_edges(frame))
        assert {r["id"]: (r["edge_id"], r["other"]) for r in found.collect()} == first


def test_edges_move_once_for_both_names(spark, case, monkeypatch):
    """They moved for their labels, for their support, for each of their names and for their id."""
    _, stored, shown = case
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = explore.drill_down(graph.support_ends(stored, graph.table_edges(stored)), stored, shown)
        assert "Bucketed: true" in found._jdf.queryExecution().executedPlan().toString()
        # Of the exchanges by an end, one is of the names for it.
        assert (len(moved(found, "edge_source")), len(moved(found, "edge_target")), moved(found, "edge_id")) == (1, 2, [])
        assert not [m for frame in (graph.entity_edges(stored), graph.crossing_ends(stored)) for m in ("edge_source", "edge_target") if moved(frame, m)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_a_question_to_nodes_finds_no_relations(spark, monkeypatch):
    """A search of nodes used to wait for all relations to be found and stored."""
    def found(*args):
        raise AssertionError("relations are not asked for")

    monkeypatch.setattr(q_graph, "_stored_edges", found)
    assert q_graph.QUERIES["node_search"](spark, "/root/testdata/sf0.001").count() > 0
