"""Visibility, focus, components, hubs, names and search on small graphs."""

import random
from collections import Counter

from pyspark.sql import functions as F

from relweave.operators import explore, graph, ranking, relations as rel
from test_graph import frame, relation


def node(spark, ids, name=lambda i: i, code=lambda i: None, source="name"):
    rows = [(i, i.split(":")[0], name(i), source, code(i), "K", {}) for i in ids]
    return spark.createDataFrame(rows, "id string, table_id string, display_name string, display_name_source string, display_code string, class_name string, dimensions map<string,string>")


def edges_of(spark, rows):
    return rel.edge_relations(frame(spark, rows))


def test_visibility(spark):
    nan = float("nan")
    edges = edges_of(spark, [relation("a:1", "b:1", "x", "strong", 0.1), relation("a:1", "b:1", "y", "weak", nan), relation("a:2", "b:1", "x", "weak", 0.7), relation("a:3", "b:1", "x", "weak", 0.2)])
    got = {r["edge_id"]: r["visible_count"] for r in explore.visible_edges(edges, 0.5).collect()}
    assert got == {"entity:3:a:13:b:1": 1, "entity:3:a:23:b:1": 1}


def test_projection_and_degrees(spark):
    nodes = node(spark, ["a:1", "a:2", "b:1", "c:1"])
    edges = edges_of(spark, [relation("a:1", "b:1"), relation("b:1", "a:1", "y"), relation("a:2", "a:2"), relation("a:1", "gone:1")])
    kept, inside = explore.project_graph(nodes, edges, False)
    assert sorted(r["id"] for r in kept.collect()) == ["a:1", "a:2", "b:1"] and inside.count() == 3
    assert explore.project_graph(nodes, edges, True)[0].count() == 4
    assert tuple(explore.isolated_count(nodes, edges).first()) == (4, 1)
    assert {r["id"]: r["degree"] for r in explore.degrees(nodes, edges).collect()} == {"a:1": 1, "a:2": 1, "b:1": 1, "c:1": 0}
    legacy = spark.createDataFrame([("a:1", "b:1"), ("a:2", "a:2")], "source string, target string")
    assert {r["id"]: r["degree"] for r in explore.legacy_degrees(nodes, legacy).collect()} == {"a:1": 1, "a:2": 2, "b:1": 1, "c:1": 0}


def test_focus(spark):
    edges = edges_of(spark, [relation("a:1", "b:1", confidence=0.9), relation("a:1", "c:1", confidence=0.1)])
    adjacency = explore.adjacency_index(edges, 0.5)
    selections = spark.createDataFrame([("a:1", "c:1"), (None, "c:1"), (None, None)], "hovered_id string, selected_id string")
    rows = {(r["active_id"], r["node_id"]) for r in explore.one_hop_focus(adjacency, selections).collect()}
    assert rows == {("a:1", "a:1"), ("a:1", "b:1"), ("c:1", "c:1")}


def test_focus_of_many_moves_edges_once(spark):
    """The adjacency is dealt by node once; the join with the active nodes takes it as it is."""
    edges = edges_of(spark, [relation(f"a:{i}", f"b:{i % 7}", confidence=0.9) for i in range(300)] + [relation("a:1", "a:1"), relation("a:1", "gone:1", confidence=0.1)])
    selections = node(spark, [f"a:{i}" for i in range(300)]).select(F.lit(None).cast("string").alias("hovered_id"), F.col("id").alias("selected_id"))
    frames = [explore.one_hop_focus(adjacency(edges, 0.5), selections) for adjacency in (explore.adjacency_by_node, explore.adjacency_index)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "90")
    try:
        focus = explore.one_hop_focus(explore.adjacency_by_node(edges, 0.5), selections)
        plan = focus._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert plan.count("hashpartitioning(node#") == 1 and "REPARTITION_BY_NUM" in plan
    got, known = (sorted(map(str, f.collect())) for f in frames)
    assert got == known and len(got) == 601


def components_by_union(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        if a in parent and b in parent:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(2)
    ids = [f"n:{i}" for i in range(220)]
    pairs = [(f"n:{rng.randrange(150)}", f"n:{rng.randrange(150)}") for _ in range(90)]
    pairs += [(f"n:{i}", f"n:{i + 1}") for i in range(150, 200)] + [("n:210", "n:" + str(i)) for i in range(211, 220)] + [("n:3", "n:999")]
    edges = edges_of(spark, [relation(a, b) for a, b in pairs])
    got = {r["id"]: r["component"] for r in explore.connected_components(node(spark, ids), edges).collect()}
    assert got == components_by_union(ids, pairs)


def test_hubs(spark):
    rows = [(f"a:{i:02d}", "a", 5) for i in range(30)] + [("b:1", "b", 1), ("b:0", "b", 1), ("c:1", "c", 0)]
    degrees = spark.createDataFrame(rows, "id string, table_id string, degree long")
    got = sorted(r["id"] for r in explore.hub_nodes(degrees).collect())
    assert got == [f"a:{i:02d}" for i in range(24)] + ["b:0"]


def test_names(spark):
    names = {"a:1": "阀门", "a:2": " 阀门", "a:10": "阀门", "b:1": "泵", "c:1": "Ｐump", "c:2": "pump"}
    nodes = node(spark, list(names), names.get, lambda i: "C-2" if i == "a:2" else " ")
    shown = {r["id"]: r for r in explore.presentations(nodes, spark.createDataFrame([("b:1", 3)], "id string, degree long")).collect()}
    assert [shown[i]["secondary"] for i in ("a:1", "a:10", "a:2", "b:1", "c:1", "c:2")] == ["同名 1", "同名 2", "C-2", "", "同名 1", "同名 2"]
    assert shown["b:1"]["accessible_label"] == "泵；3 个关系" and shown["a:2"]["search_text"] == "阀门 c-2"
    assert not shown["b:1"]["is_duplicate"] and shown["c:1"]["is_duplicate"]


def test_row_numbers_of_a_hot_group(spark):
    rng = random.Random(4)
    rows = [("hot", "t", f"t:{i}") for i in rng.sample(range(10**7), 3000)] + [("hot", "u", f"u:{i:05d}") for i in range(500)] + [(f"g{i % 7}", "t", f"t:x{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "g string, space string, id string")
    got = {r["id"]: r["n"] for r in ranking.grouped_row_number(df, ["g"], "id", "n").collect()}
    expected = {}
    for group in {r[0] for r in rows}:
        for position, identifier in enumerate(sorted(r[2] for r in rows if r[0] == group), 1):
            expected[identifier] = position
    assert got == expected


def test_ranges_split_keys_that_look_alike(spark):
    rows = spark.range(6000).selectExpr("'same' AS g", "concat(if(id % 3 = 0, 'http', 'https'), '://www.example.org/item/', id) AS id")
    sizes = [r["count"] for r in ranking.ranged(rows, ["g"], "id", 32).groupBy("_part").count().collect()]
    assert max(sizes) < 600 and sum(sizes) == 6000
    got = {r["id"]: r["n"] for r in ranking.grouped_row_number(rows, ["g"], "id", "n", 32).collect()}
    assert got == {i: n for n, i in enumerate(sorted(got), 1)}


def test_percentiles(spark):
    rng = random.Random(6)
    rows = [("a", float(rng.choice([1, 1, 1, 5, 9]))) for _ in range(300)] + [("b", rng.random() ** 20 * 1e9) for _ in range(500)] + [("c", 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for percent, accuracy in ((1, 10000), (50, 20), (95, 10000), (100, 10000)):
        got = {r["g"]: r["percentile_value"] for r in ranking.nearest_rank_percentile(df, ["g"], "v", percent, accuracy).collect()}
        expected = {}
        for group in "abc":
            values = sorted(v for g, v in rows if g == group)
            expected[group] = values[max(1, -(-len(values) * percent // 100)) - 1]
        assert got == expected


def test_ranges_split_keys_that_look_alike(spark):
    rows = spark.range(6000).selectExpr("'same' AS g", "concat(if(id % 3 = 0, 'http', 'https'), '://www.example.org/item/', id) AS id")
    sizes = [r["count"] for r in ranking.ranged(rows, ["g"], "id", 32).groupBy("_part").count().collect()]
    assert max(sizes) < 600 and sum(sizes) == 6000
    got = {r["id"]: r["n"] for r in ranking.grouped_row_number(rows, ["g"], "id", "n", 32).collect()}
    assert got == {i: n for n, i in enumerate(sorted(got), 1)}


def test_search(spark):
    shown = spark.createDataFrame([("a:1", "主轴 A", "", "Part"), ("a:2", "端盖", "C-9", "Cover"), ("a:3", "螺钉", "", None)], "id string, primary string, secondary string, class_name string")
    find = lambda q: [r["id"] for r in explore.node_search(shown, q).collect()]
    assert find("  ") == [] and find("ｃ-9 PART") in (["a:1", "a:2"], ["a:2", "a:1"]) and find("a:3") == ["a:3"]


def test_labels_directions_weights(spark):
    edges = edges_of(spark, [relation("a:1", "b:1", "contains"), relation("b:1", "a:1", "uses", direction="target_to_source"), relation("a:2", "b:1", "foreign_key", "strong"), relation("a:3", "b:1", direction="undirected")])
    labels = {r["edge_id"][-7:]: r["labels"] for r in explore.label_lists(edges, ["edge_id"]).collect()}
    assert "使用 · 包含" in labels.values() or "包含 · 使用" in labels.values()
    directions = Counter(r["direction"] for r in explore.edge_directions(edges).collect())
    assert directions == {"undirected": 2, "forward": 1}
    assert sorted(r["weight"] for r in explore.edge_weights(edges).collect()) == [0.35, 0.35, 1.0]


def test_table_edge_view_and_drill_down(spark):
    edges = edges_of(spark, [relation("a:1", "b:1", "contains", "strong", 1.0), relation("a:2", "b:1", "uses", "weak", 0.3)])
    tables = graph.table_edges(edges)
    support = graph.table_edge_support(edges, tables)
    view = explore.table_edge_view(tables, support, edges, 0.5).first()
    assert (view["label"], view["line_style"], view["direction"]) == ("包含", "solid", "forward")
    weak = edges_of(spark, [relation(f"a:{i}", "b:1", "uses", "weak", 0.3) for i in range(3)])
    shown = graph.table_edges(weak)
    assert explore.table_edge_view(shown, graph.table_edge_support(weak, shown), weak, 0.5).count() == 0
    lost = support.withColumn("edge_id", F.lit("entity:gone"))
    unresolved = explore.table_edge_view(tables, lost, edges, 0.99).first()
    assert (unresolved["label"], unresolved["line_style"], unresolved["direction"]) == ("相关", "solid", "undirected")
    names = spark.createDataFrame([("a:1", "轴", ""), ("b:1", "泵", "")], "id string, primary string, secondary string")
    rows = explore.drill_down(support.union(lost.limit(1)), edges, names).collect()
    assert {(r["source_name"], r["target_name"], r["labels"]) for r in rows} == {("轴", "泵", "包含"), ("未命名对象", "泵", "使用"), (None, None, "支撑关系不可用")}
    detail = explore.node_detail(edges, names, spark.createDataFrame([("b:1",)], "id string")).collect()
    assert {(r["other"], r["other_primary"]) for r in detail} == {("a:1", "轴"), ("a:2", "未命名对象")}
    chains = {r["id"]: (r["relation"], r["target_name"]) for r in explore.node_chains(node(spark, ["a:1", "c:1"]), edges, names).collect()}
    assert chains == {"a:1": ("包含", "泵"), "c:1": ("等待更多关系", "暂无相邻对象")}
    assert explore.table_edge_detail(tables).first()["confidence_band"] == "较可信"
    counts = explore.graph_overview(spark.range(2), spark.range(3), tables, edges).first()
    assert tuple(counts) == (2, 3, 1, 2)


def test_components_by_numbers_in_the_order_of_ids(spark):
    """Rounds move numbers; the smallest number is that of the smallest id, and dangling edges join nothing."""
    ids = ["a:10", "a:9", "b:1", "b:2", "ä:1", "c:5"]
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    numbered = {r["id"]: r["number"] for r in explore._numbered(nodes).frame.collect()}
    assert sorted(ids, key=numbered.get) == sorted(ids, key=lambda i: i.encode())
    edges = spark.createDataFrame([("a:9", "b:1"), ("a:10", "b:1"), ("b:2", "ä:1"), ("b:2", "x:1"), ("c:5", "x:1")], "edge_source string, edge_target string")
    found = {r["id"]: r["component"] for r in explore.connected_components(nodes, edges).collect()}
    assert found == {"a:10": "a:10", "a:9": "a:10", "b:1": "a:10", "b:2": "b:2", "ä:1": "b:2", "c:5": "c:5"}


def test_no_edge_is_looked_up_when_none_dangles(spark):
    """Degrees and connected nodes move each edge once at most, whatever dangles."""
    nodes = node(spark, ["a:1", "a:2", "b:1", "c:1"])
    sound = [relation("a:1", "b:1"), relation("b:1", "a:1", "y"), relation("a:2", "a:2")]
    for edges in (edges_of(spark, sound), edges_of(spark, [*sound, relation("a:1", "gone:1"), relation("gone:2", "c:1")])):
        degrees, connected = explore.degrees(nodes, edges), explore.connected_nodes(nodes, edges)
        assert {r["id"]: r["degree"] for r in degrees.collect()} == {"a:1": 1, "a:2": 1, "b:1": 1, "c:1": 0}
        assert sorted(r["id"] for r in connected.collect()) == ["a:1", "a:2", "b:1"]
        assert tuple(explore.isolated_count(nodes, edges).first()) == (4, 1)
    edges = edges_of(spark, sound)
    for found in (explore.degrees(nodes, edges), explore.connected_nodes(nodes, edges)):
        assert "edge_source" not in found._jdf.queryExecution().executedPlan().toString()


def test_components_of_stars_and_paths(spark):
    """Hubs with the largest id, with the smallest one and between, and paths in rising and mixed order."""
    rng = random.Random(5)
    ids = [f"n:{i:04d}" for i in range(400)]
    pairs = [(99, i) for i in range(90)] + [(100, 100 + i) for i in range(1, 40)] + [(150, i) for i in range(145, 160)]
    pairs += [(i, i + 1) for i in range(200, 260)] + [(300 + (i * 37) % 60, 300 + (i * 37 + 37) % 60) for i in range(50)]
    pairs += [(rng.randrange(360, 400), rng.randrange(360, 400)) for _ in range(30)]
    named = [(ids[a], ids[b]) for a, b in pairs]
    got = explore.connected_components(node(spark, ids), edges_of(spark, [relation(a, b) for a, b in named]))
    assert {r["id"]: r["component"] for r in got.collect()} == components_by_union(ids, named)


def test_components_take_few_rounds(spark, monkeypatch):
    """Most pairs of a dense graph fall inside a tree at once, so later rounds read few."""
    rng, stars, stored = random.Random(3), [], explore.Stored

    def storing(frame, name):
        kept = stored(frame, name)
        if name == "star":
            stars.append(kept.frame.count())
        return kept

    monkeypatch.setattr(explore, "Stored", storing)
    pairs = sorted({(f"n:{rng.randrange(200, 1000)}", f"n:{rng.randrange(200)}") for _ in range(4000)})
    ids = sorted({i for pair in pairs for i in pair})
    got = explore.connected_components(node(spark, ids), edges_of(spark, [relation(a, b) for a, b in pairs]))
    assert {r["id"]: r["component"] for r in got.collect()} == components_by_union(ids, pairs)
    assert stars[0] == len(pairs) and sum(stars[1:]) < len(pairs)
