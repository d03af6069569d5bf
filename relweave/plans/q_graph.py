"""Queries over graph assembly and exploration."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from relweave.operators import adjacency, documents as docs, explore, factored, graph, judging, ladder, ranking, relations as rel, search_index
from relweave.operators.deterministic import fk_edges
from relweave.operators.judging import JUDGED_METHOD
from relweave.plans import views
from relweave.plans.oracle_views import BRIDGE, DEGREE, ENT, EXTRA, FK, GRAPH, PASSAGES, SHOWN, graph_sql
from relweave.plans.q_relations import strong_relations
from relweave.plans.q_retrieval import CHECKED, answers_in_time, judged, weak_relations
from relweave.session import ROWS_PER_TASK, application_folder, buckets_of, materialize
from relweave.sources import snapshot
from relweave.sources.catalog import union_all

QUERIES = {}
ORACLE = {}
THRESHOLD = 0.95


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def extra_relations(spark, sf_dir):
    """Second relations of some pairs, against the direction of the first, and a table pair with too few weak ones to be shown."""
    customers = views.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    orders = views.read(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").join(customers, "o_custkey")
    items = views.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("r_regionkey"))
    regions = views.read(spark, sf_dir, "region").where("r_regionkey < 2").join(items, "r_regionkey")

    def one(df, source_table, source_key, target_table, target_key, **columns):
        proof = rel.evidence(source_key, F.col(source_key).cast("string"), target_key, F.col(target_key).cast("string"), JUDGED_METHOD, "stated")
        return rel.as_relations(
            df, source=F.concat(F.lit(f"{source_table}:"), source_key), target=F.concat(F.lit(f"{target_table}:"), target_key),
            source_table=source_table, target_table=target_table, strength="weak", explanation="stated", evidence=F.array(proof), **columns,
        )

    return rel.union_relations(
        one(orders, "orders", "o_orderkey", "customer", "o_custkey", relation_type="places", confidence=0.97, direction="target_to_source"),
        one(regions, "region", "r_regionkey", "benchmark", "r_regionkey", relation_type="mentions", confidence=0.7),
    )


def all_relations(spark, sf_dir, deal=None):
    """Every relation; ``deal`` moves them before the texts that follow from their ends are made."""
    return _with_strong(spark, sf_dir, rel.union_relations(weak_relations(spark, sf_dir), extra_relations(spark, sf_dir)), deal)


def explicit_relations(spark, sf_dir, deal=None):
    """Every relation that is not judged."""
    return _with_strong(spark, sf_dir, extra_relations(spark, sf_dir), deal)


def _with_strong(spark, sf_dir, others, deal):
    return rel.union_relations(strong_relations(spark, sf_dir, deal), others if deal is None else deal(others))


def _stored(spark, sf_dir, part, make, which="all"):
    """A part of the graph of the whole test data, from a snapshot that is made anew when tables or metadata changed.

    Exploring a graph means asking a stored snapshot, here as in the analysis.  Nodes and relations are snapshots of their own with the
    same fingerprint, so that a question to the nodes does not need the relations.
    """
    catalog = views.catalog(spark, sf_dir)
    tables = snapshot.tables_state(spark, [f"{sf_dir}/{name}.parquet" for name in (*catalog.tables, "lineitem")])
    fingerprint = hashlib.sha256("\n".join([catalog.fingerprint(), *tables]).encode()).hexdigest()
    folder = f"{application_folder(spark)}/graph-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}/{part}-{which}"
    try:
        parts = snapshot.open_snapshot(spark, folder, fingerprint)
    except (snapshot.NoSnapshot, snapshot.StaleSnapshot):
        frame, buckets = make(catalog)
        parts = snapshot.commit_snapshot(spark, {part: frame}, folder, fingerprint, buckets=buckets).parts(spark)
    return parts[part]


#: Relations in a bucket of the stored graph, about.
ROWS_PER_BUCKET = 2 * ROWS_PER_TASK


def stored_graph(spark, sf_dir):
    """Nodes and relations of the whole test data."""
    return nodes_of(spark, sf_dir), edges_of(spark, sf_dir)


def edges_of(spark, sf_dir):
    return _stored_edges(spark, sf_dir, "all", all_relations)


def _stored_edges(spark, sf_dir, which, relations):
    """Relations in buckets of their edge's smaller end: they move once, with little but their ends, and grouping them by edge or looking up
    that end moves them no more."""

    def make(catalog):
        found_in = [views.read(spark, sf_dir, key.source_table) for key in catalog.foreign_keys]
        rows = sum(frame.count() for frame in [*found_in, *views.relation_tables(spark, sf_dir).values()])
        count = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_BUCKET))

        def by_smaller_end(rows):
            return rows.repartition(count, F.least("source", "target")).withColumn("edge_source", F.least("source", "target"))

        edges = rel.edge_relations(relations(spark, sf_dir, by_smaller_end))
        return rel.stored_form(edges), {"relations": snapshot.Buckets(count, "edge_source", ("edge_source", "edge_target"))}

    return rel.from_stored_form(_stored(spark, sf_dir, "relations", make, which))


def nodes_of(spark, sf_dir):
    return _stored(spark, sf_dir, "entity_nodes", lambda catalog: (graph.entity_nodes(docs.build_documents(catalog)), {}))


def shown_of(spark, sf_dir):
    nodes, edges = stored_graph(spark, sf_dir)
    return explore.presentations(nodes, explore.degrees(nodes, edges))


@query("discover_graph", graph_sql("SELECT relation_type, strength, count(*) AS relations, sum(confidence) AS confidence FROM rel GROUP BY ALL"))
def discover_graph(spark, sf_dir):
    """All relations found anew from the tables."""
    found = all_relations(spark, sf_dir)
    return found.groupBy("relation_type", "strength").agg(
        F.count(F.lit(1)).alias("relations"), F.sum(F.col("confidence").cast("decimal(20,4)")).cast("double").alias("confidence")
    )


@query("entity_nodes", f"WITH {ENT} SELECT entity_id AS id, table_name AS table_id, display_name, 'name' AS display_name_source, display_code, class_name FROM ent")
def entity_nodes(spark, sf_dir):
    return graph.entity_nodes(docs.build_documents(views.catalog(spark, sf_dir))).drop("dimensions")


@query("table_nodes", f"WITH {ENT} SELECT table_name AS id, table_name AS display_name, count(*) AS entity_count FROM ent GROUP BY 1")
def table_nodes(spark, sf_dir):
    return graph.table_nodes(graph.entity_nodes(docs.build_documents(views.catalog(spark, sf_dir))))


@query(
    "entity_edges",
    graph_sql(
        "SELECT edge_id, a AS edge_source, b AS edge_target, count(*) AS relation_count, "
        "string_agg(relation_type || '/' || strength, ',' ORDER BY relation_type) AS relations FROM edge GROUP BY ALL"
    ),
)
def entity_edges(spark, sf_dir):
    merged = graph.entity_edges(edges_of(spark, sf_dir))
    shown = F.transform("relations", lambda r: F.concat_ws("/", r["relation_type"], r["strength"]))
    return merged.select("edge_id", "edge_source", "edge_target", "relation_count", F.array_join(F.array_sort(shown), ",").alias("relations"))


_TABLES_SQL = """tpt AS (SELECT least(source_table, target_table) AS ta, greatest(source_table, target_table) AS tb, relation_type,
    count(*) FILTER (strength = 'strong') AS strong, count(*) FILTER (strength = 'weak') AS weak FROM rel WHERE source_table <> target_table GROUP BY ALL),
  tp AS (SELECT least(source_table, target_table) AS ta, greatest(source_table, target_table) AS tb, count(DISTINCT edge_id) AS edges,
    round(avg(confidence), 9) AS mean FROM edge WHERE source_table <> target_table GROUP BY ALL),
  te AS (SELECT 'table:' || length(tp.ta) || ':' || tp.ta || length(tp.tb) || ':' || tp.tb AS id, tp.ta AS source_table, tp.tb AS target_table,
    string_agg(relation_type, ',' ORDER BY relation_type) AS relation_types, CAST(sum(strong) AS BIGINT) AS strong_count, CAST(sum(weak) AS BIGINT) AS weak_count,
    any_value(edges) AS entity_edge_count, any_value(mean) AS average_confidence, sum(strong) > 0 OR max(weak) >= 3 AS is_shown
    FROM tp JOIN tpt ON tp.ta = tpt.ta AND tp.tb = tpt.tb GROUP BY tp.ta, tp.tb)"""


def _flat_tables(df):
    return df.withColumn("relation_types", F.array_join("relation_types", ",")).withColumn("average_confidence", F.round("average_confidence", 9))


@query("table_edges", graph_sql("SELECT * EXCLUDE (is_shown) FROM te WHERE is_shown", _TABLES_SQL))
def table_edges(spark, sf_dir):
    return _flat_tables(graph.table_edges(edges_of(spark, sf_dir)))


@query("table_edge_gate", graph_sql("SELECT id, strong_count, weak_count, is_shown FROM te", _TABLES_SQL))
def table_edge_gate(spark, sf_dir):
    return graph.table_edge_candidates(edges_of(spark, sf_dir)).select("id", "strong_count", "weak_count", "is_shown")


_SUPPORT_SQL = """support AS (SELECT DISTINCT te.id AS table_edge_id, e.edge_id FROM edge e JOIN te ON te.is_shown
  AND te.source_table = least(e.source_table, e.target_table) AND te.target_table = greatest(e.source_table, e.target_table))"""


@query("table_edge_support", graph_sql("SELECT * FROM support", _TABLES_SQL, _SUPPORT_SQL))
def table_edge_support(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    return graph.table_edge_support(edges, graph.table_edges(edges))


@query(
    "stable_order",
    graph_sql(
        "SELECT id, relation_types, row_number() OVER (ORDER BY source_table, target_table) AS position FROM te WHERE is_shown", _TABLES_SQL
    ),
)
def stable_order(spark, sf_dir):
    """Table edges in order; there is one row per table pair, so the window is small."""
    from pyspark.sql import Window

    shown = table_edges(spark, sf_dir)
    return shown.select("id", "relation_types", F.row_number().over(Window.orderBy("source_table", "target_table")).alias("position"))


# Runs over the whole catalog: every table's entities, all strong relations, and what each way of judging adds.

_STRONG_SQL = "strong AS (SELECT source_table, relation_type FROM fk UNION ALL SELECT source_table, relation_type FROM bridge)"
_OF_STATUS = ", ".join(
    f"count(*) FILTER (status = '{s}') AS {s}_groups, coalesce(sum(n) FILTER (status = '{s}'), 0) AS {s}_candidates" for s in ("completed", "failed", "pending")
)
_RUNS_SQL = f"""g AS (SELECT sid, count(*) AS n, {CHECKED} AS judge, 'completed' AS rules FROM cand GROUP BY sid),
  judged_weak AS (SELECT count(*) AS n FROM weak JOIN src_all s ON weak.source = 'benchmark:' || s.id JOIN g ON g.sid = s.id WHERE g.judge = 'completed'),
  of_judge AS (SELECT {_OF_STATUS} FROM (SELECT judge AS status, n FROM g)), of_rules AS (SELECT {_OF_STATUS} FROM (SELECT rules AS status, n FROM g)),
  of_none AS (SELECT {_OF_STATUS} FROM (SELECT judge AS status, n FROM g WHERE false)),
  of_broken AS (SELECT {_OF_STATUS} FROM (SELECT 'failed' AS status, n FROM g)),
  both_strong AS (SELECT count(*) AS n FROM strong), keys_only AS (SELECT count(*) AS n FROM fk)"""


@query(
    "diagnostics",
    f"""WITH {ENT}, {FK}, {BRIDGE}, {EXTRA}, {PASSAGES}, {_STRONG_SQL}, {_RUNS_SQL}
SELECT (SELECT count(*) FROM ent) AS entities_read, 1 AS plans_created,
  completed_candidates + failed_candidates + pending_candidates AS candidates_retrieved, completed_candidates AS candidates_completed,
  failed_candidates + pending_candidates AS candidates_pending, completed_groups, failed_groups, pending_groups,
  (SELECT n FROM both_strong) AS strong_edges_created, (SELECT n FROM judged_weak) + (SELECT count(*) FROM extra) AS weak_edges_created FROM of_judge""",
)
def diagnostics(spark, sf_dir):
    """Counters of a run over every table, with groups that complete, fail and come too late."""
    documents, rows, members, pairs = judged(spark, sf_dir)
    checked = judging.check_responses(materialize(answers_in_time(pairs), "answers"), rows)
    weak = judging.expand_representatives(judging.approved_decisions(checked), members, documents)
    found = rel.union_relations(strong_relations(spark, sf_dir), weak, extra_relations(spark, sf_dir))
    return graph.diagnostics(docs.build_documents(views.catalog(spark, sf_dir)), rows, judging.judgement_outcomes(checked), found)


def _run_sql(run: str, strong: str, weak: str, outcomes: str, step_failed: bool = False) -> str:
    return (
        f"SELECT '{run}' AS run, ({strong}) AS strong_edges_created, ({weak}) AS weak_edges_created, completed_groups, failed_groups, pending_groups, "
        f"{str(step_failed).lower()} AS step_failed FROM {outcomes}"
    )


_NONE, _STRONG_N, _KEYS_N, _WEAK_N = "SELECT count(*) FROM fk WHERE false", "SELECT n FROM both_strong", "SELECT n FROM keys_only", "SELECT count(*) FROM weak"


@query(
    "run_status",
    f"""WITH {FK}, {BRIDGE}, {PASSAGES}, {_STRONG_SQL}, {_RUNS_SQL}, runs AS (""" + " UNION ALL ".join([
        _run_sql("rules", _STRONG_N, _WEAK_N, "of_rules"), _run_sql("judge", _STRONG_N, "SELECT n FROM judged_weak", "of_judge"),
        _run_sql("broken judge", _STRONG_N, _NONE, "of_broken"), _run_sql("broken judge, no keys", _NONE, _NONE, "of_broken"),
        _run_sql("planner failed", _STRONG_N, _NONE, "of_none", True), _run_sql("planner failed, no keys", _NONE, _NONE, "of_none", True),
        _run_sql("relation tables failed", _KEYS_N, _WEAK_N, "of_rules", True), _run_sql("nothing to judge", _NONE, _NONE, "of_none"),
    ]) + f""")
SELECT * EXCLUDE (step_failed), CASE WHEN strong_edges_created + weak_edges_created = 0 AND (step_failed OR (failed_groups > 0 AND completed_groups = 0 AND pending_groups = 0)) THEN 'failed'
    WHEN step_failed OR failed_groups > 0 OR pending_groups > 0 THEN 'partial' ELSE 'complete' END AS status,
  CASE WHEN strong_edges_created + weak_edges_created = 0 AND NOT step_failed AND failed_groups = 0 AND pending_groups = 0 THEN '{graph.NO_RELATIONS_WARNING}' END AS warning
FROM runs""",
)
def run_status(spark, sf_dir):
    """Runs that end well, in part, not at all, and without a finding; some lose a step, some have no keys to fall back on."""
    documents, rows, members, pairs = judged(spark, sf_dir)
    requests, catalog = materialize(judging.judge_requests(pairs), "requests"), views.catalog(spark, sf_dir)
    entities = docs.build_documents(catalog)
    strong, keys_only = materialize(strong_relations(spark, sf_dir), "strong"), fk_edges(catalog)

    def broken_judge(request):
        raise RuntimeError("no answer")

    def asked(answers):
        checked = judging.check_responses(materialize(answers, "answers"), rows)
        return judging.judgement_outcomes(checked), judging.approved_decisions(checked)

    none = pairs.where(F.lit(False))
    by_rules = judging.rule_outcomes(pairs), judging.rule_decisions(pairs, views.PASSAGE_RULES)
    nothing = judging.rule_outcomes(none), judging.rule_decisions(none, views.PASSAGE_RULES)
    broken = asked(judging.ask_judge(requests, broken_judge))
    no_keys = strong.where(F.lit(False))
    runs = [
        ("rules", strong, by_rules, {}), ("judge", strong, asked(answers_in_time(pairs)), {}), ("broken judge", strong, broken, {}),
        ("broken judge, no keys", no_keys, broken, {}), ("planner failed", strong, nothing, {"planner_failed": True}),
        ("planner failed, no keys", no_keys, nothing, {"planner_failed": True}), ("relation tables failed", keys_only, by_rules, {"structural_failed": True}),
        ("nothing to judge", no_keys, nothing, {}),
    ]
    frames = []
    for run, certain, (outcomes, decisions), failed in runs:
        found = rel.union_relations(certain, judging.expand_representatives(decisions, members, documents))
        totals = graph.run_status(graph.diagnostics(entities, rows, outcomes, found), **failed)
        frames.append(totals.select(
            F.lit(run).alias("run"), "strong_edges_created", "weak_edges_created", "completed_groups", "failed_groups", "pending_groups", "status", "warning"
        ))
    return union_all(frames)


_PARTS_SQL = """SELECT 'table_nodes' AS part, count(DISTINCT table_name) AS stored_rows FROM ent UNION ALL SELECT 'entity_nodes', count(*) FROM ent
UNION ALL SELECT 'table_edges', count(*) FROM te WHERE is_shown UNION ALL SELECT 'table_edge_support', count(*) FROM support
UNION ALL SELECT 'relations', count(*) FROM edge UNION ALL SELECT 'diagnostics', 1 UNION ALL SELECT 'warnings', 1"""


@query("export_snapshot", graph_sql(f"SELECT part, stored_rows, stored_rows AS json_rows, 0 AS differing_rows FROM ({_PARTS_SQL})", _TABLES_SQL, _SUPPORT_SQL))
def export_snapshot(spark, sf_dir):
    """Writes all parts of a snapshot in both formats, reads them back, and compares every row with what was written."""
    nodes, edges = stored_graph(spark, sf_dir)
    shown = materialize(graph.table_edges(edges), "table-edges")
    documents, rows, _, pairs = judged(spark, sf_dir)
    parts = {
        "table_nodes": graph.table_nodes(nodes), "entity_nodes": nodes, "table_edges": shown, "table_edge_support": graph.table_edge_support(edges, shown),
        "relations": edges, "diagnostics": graph.run_status(graph.diagnostics(documents, rows, judging.rule_outcomes(pairs), edges)),
        "warnings": spark.createDataFrame([("none",)], "warning string"),
    }
    folder, fingerprint = f"{application_folder(spark)}/snapshot-{uuid.uuid4().hex}", views.catalog(spark, sf_dir).fingerprint()
    for format in ("parquet", "json"):
        snapshot.commit_snapshot(spark, parts, f"{folder}/{format}", fingerprint, format)
    stored, texts = (snapshot.open_snapshot(spark, f"{folder}/{format}", fingerprint) for format in ("parquet", "json"))

    def digests(part, lines, is_text):
        return lines.select(F.lit(part).alias("part"), F.xxhash64("value").alias("digest"), F.lit(is_text).alias("is_text"))

    # A digest of each row of both formats moves once, and is counted there.
    each = union_all([
        digests(part, lines, is_text) for part in snapshot.PARTS for lines, is_text in ((snapshot.public_json(stored[part]), False), (texts[part], True))
    ]).groupBy("part", "digest").agg(F.count_if(~F.col("is_text")).alias("stored"), F.count_if("is_text").alias("json"))
    return each.groupBy("part").agg(
        F.sum("stored").alias("stored_rows"), F.sum("json").alias("json_rows"), F.sum(F.abs(F.col("stored") - F.col("json"))).alias("differing_rows")
    )


# Labels, directions and weights of edges.


@query("relation_label_list", graph_sql("SELECT edge_id, string_agg(DISTINCT label, ' · ' ORDER BY label) AS labels FROM edge GROUP BY 1"))
def relation_label_list(spark, sf_dir):
    return graph.with_edge_id(explore.label_lists(edges_of(spark, sf_dir), [*graph.ENDS])).select("edge_id", "labels")


@query(
    "edge_direction",
    graph_sql("SELECT edge_id, CASE WHEN count(DISTINCT direction) > 1 THEN 'undirected' WHEN any_value(direction) = 'source_to_target' THEN 'forward' "
              "WHEN any_value(direction) = 'target_to_source' THEN 'reverse' ELSE 'undirected' END AS direction FROM edge GROUP BY 1"),
)
def edge_direction(spark, sf_dir):
    return explore.edge_directions(edges_of(spark, sf_dir))


@query("edge_weight", graph_sql("SELECT edge_id, CASE WHEN bool_or(strength = 'strong') THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END AS weight FROM edge GROUP BY 1"))
def edge_weight(spark, sf_dir):
    return explore.edge_weights(edges_of(spark, sf_dir))


# Exploration.

_VISIBLE = f"(strength = 'strong' OR confidence >= {THRESHOLD})"


@query("visible_relations", graph_sql(f"SELECT edge_id, relation_type, strength, confidence FROM edge WHERE {_VISIBLE}"))
def visible_relations(spark, sf_dir):
    return explore.visible_relations(edges_of(spark, sf_dir), THRESHOLD).select("edge_id", "relation_type", "strength", "confidence")


@query("visible_edges", graph_sql(f"SELECT edge_id, a AS edge_source, b AS edge_target, count(*) AS visible_count FROM edge WHERE {_VISIBLE} GROUP BY ALL"))
def visible_edges(spark, sf_dir):
    return explore.visible_edges(edges_of(spark, sf_dir), THRESHOLD)


_STEPS = (0.5, 0.94, THRESHOLD, 0.98)


@query(
    "ladder_visible_edges",
    graph_sql("SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {t}::DOUBLE AS threshold, edge_id, count(*) AS visible_count FROM edge WHERE strength = 'strong' OR confidence >= {t} GROUP BY ALL" for t in _STEPS
    ) + ")"),
)
def ladder_visible_edges(spark, sf_dir):
    """``visible_edges`` at several thresholds from one ladder."""
    steps = materialize(ladder.edge_ladder(edges_of(spark, sf_dir)), "edge-ladder")
    return union_all([ladder.visible_edges(steps, t).select(F.lit(t).alias("threshold"), "edge_id", "visible_count") for t in _STEPS])


@query("project_graph", graph_sql("SELECT entity_id AS id, table_name AS table_id FROM ent WHERE entity_id IN (SELECT a FROM edge UNION ALL SELECT b FROM edge)"))
def project_graph(spark, sf_dir):
    nodes, edges = stored_graph(spark, sf_dir)
    return explore.connected_nodes(nodes, edges).select("id", "table_id")


@query(
    "isolated_count",
    graph_sql("SELECT count(*) AS node_count, count(*) FILTER (entity_id NOT IN (SELECT a FROM edge UNION ALL SELECT b FROM edge)) AS isolated_count FROM ent"),
)
def isolated_count(spark, sf_dir):
    return explore.isolated_count(*stored_graph(spark, sf_dir))


@query("neighbor_union", graph_sql("SELECT DISTINCT node, neighbor FROM (SELECT a AS node, b AS neighbor FROM edge UNION ALL SELECT b, a FROM edge)"))
def neighbor_union(spark, sf_dir):
    return explore.neighbor_union(edges_of(spark, sf_dir))


_ADJACENT = f"adj AS (SELECT DISTINCT node, neighbor, edge_id FROM (SELECT a AS node, b AS neighbor, edge_id FROM edge WHERE {_VISIBLE} UNION ALL SELECT b, a, edge_id FROM edge WHERE {_VISIBLE}))"


@query("adjacency_index", graph_sql("SELECT * FROM adj", _ADJACENT))
def adjacency_index(spark, sf_dir):
    return explore.adjacency_index(edges_of(spark, sf_dir), THRESHOLD)


@query(
    "one_hop_focus",
    graph_sql("SELECT entity_id AS active_id, entity_id AS node_id, NULL AS edge_id FROM ent UNION ALL SELECT node, neighbor, edge_id FROM adj", _ADJACENT),
)
def one_hop_focus(spark, sf_dir):
    """The focus of every node in turn; half of them are hovered while the root is selected."""
    nodes, edges = stored_graph(spark, sf_dir)
    hovered = F.when(F.xxhash64("id") % 2 == 0, F.col("id"))
    selections = nodes.select(hovered.alias("hovered_id"), F.col("id").alias("selected_id"))
    return explore.one_hop_focus(explore.adjacency_by_node(edges, THRESHOLD), selections)


def laid_out(spark, sf_dir, threshold=None):
    """The graph, or what is visible of it at a threshold, in bucketed tables."""
    nodes, edges = stored_graph(spark, sf_dir)
    seen = edges if threshold is None else explore.visible_relations(edges, threshold)
    key = uuid.uuid4().hex
    # As many buckets as those of the relations, so that a bucket fits a task and names are in the buckets of the ends they are looked up for.
    layout = adjacency.Layout(f"graph_{key}", f"{application_folder(spark)}/adjacency-{key}", max(16, buckets_of(edges, "edge_source")))
    return adjacency.lay_out(seen, explore.named_nodes(nodes), layout)


@query("laid_out_focus", ORACLE["one_hop_focus"])
def laid_out_focus(spark, sf_dir):
    """``one_hop_focus`` from bucketed tables."""
    layout = laid_out(spark, sf_dir, THRESHOLD)
    return adjacency.one_hop_focus(spark, layout, layout.table(spark, "names").select(F.lit(None).cast("string").alias("hovered_id"), F.col("id").alias("selected_id")))


@query("laid_out_degrees", graph_sql("SELECT id, table_id, degree FROM degree", DEGREE))
def laid_out_degrees(spark, sf_dir):
    return adjacency.degrees(spark, laid_out(spark, sf_dir))


@query("degrees", graph_sql("SELECT id, table_id, degree FROM degree", DEGREE))
def degrees(spark, sf_dir):
    return explore.degrees(*stored_graph(spark, sf_dir))


@query(
    "connected_components",
    "WITH RECURSIVE " + ", ".join([ENT, GRAPH]) + """, u AS (SELECT DISTINCT a AS x, b AS y FROM edge UNION SELECT DISTINCT b, a FROM edge),
  cc(id, component) USING KEY (id) AS (SELECT entity_id, entity_id FROM ent UNION
    (SELECT me.id, min(near.component) FROM recurring.cc AS me JOIN u ON u.x = me.id JOIN cc AS near ON near.id = u.y
     WHERE near.component < me.component GROUP BY me.id))
SELECT id, component FROM cc""",
)
def connected_components(spark, sf_dir):
    nodes, edges = stored_graph(spark, sf_dir)
    return explore.connected_components(nodes.select("id"), edges)


def factored_graph(spark, sf_dir):
    """The same graph with the judged relations left as decisions between groups."""
    documents, _, members, pairs = judged(spark, sf_dir)
    family = factored.decided(judging.rule_decisions(pairs, views.PASSAGE_RULES), members, documents)
    nodes = graph.entity_nodes(docs.build_documents(views.catalog(spark, sf_dir)))
    return materialize(nodes.select("id", "table_id"), "nodes"), _stored_edges(spark, sf_dir, "explicit", explicit_relations), [family]


@query("factored_table_edges", ORACLE["table_edges"])
def factored_table_edges(spark, sf_dir):
    """``table_edges`` without expanding a decision."""
    _, edges, families = factored_graph(spark, sf_dir)
    return _flat_tables(factored.table_edges(edges, families))


@query("factored_degrees", ORACLE["degrees"])
def factored_degrees(spark, sf_dir):
    return factored.degrees(*factored_graph(spark, sf_dir))


@query("factored_components", ORACLE["connected_components"])
def factored_components(spark, sf_dir):
    return factored.connected_components(*factored_graph(spark, sf_dir))


@query(
    "hub_nodes",
    graph_sql(
        """SELECT table_id, id, degree FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY degree DESC, id) AS rt,
  row_number() OVER (ORDER BY degree DESC, id) AS rg FROM degree WHERE degree > 0) WHERE rt = 1 OR rg <= 24""", DEGREE,
    ),
)
def hub_nodes(spark, sf_dir):
    return explore.hub_nodes(explore.degrees(*stored_graph(spark, sf_dir)))


@query(
    "duplicate_names",
    graph_sql(
        """SELECT s.id, s.table_id, s.class_name, s."primary", s.secondary, s.is_duplicate, concat_ws('；', s."primary", nullif(s.secondary, ''), degree || ' 个关系') AS accessible_label,
  lower(concat_ws(' ', s."primary", nullif(s.secondary, ''))) AS search_text FROM shown s JOIN degree d ON d.id = s.id""", DEGREE, SHOWN,
    ),
)
def duplicate_names(spark, sf_dir):
    return shown_of(spark, sf_dir)


@query(
    "grouped_row_number",
    "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY CAST(event_id AS VARCHAR)) AS number FROM events",
)
def grouped_row_number(spark, sf_dir):
    rows = views.read(spark, sf_dir, "events").select("event_id", "event_type", F.col("event_id").cast("string").alias("id"))
    return ranking.grouped_row_number(rows, ["event_type"], "id", "number").select("event_id", "event_type", "number")


@query(
    "node_search",
    graph_sql(
        """SELECT id, "primary", secondary FROM shown WHERE contains(lower(concat_ws(' ', "primary", nullif(secondary, ''), class_name, id)), 'nation_1')
  OR contains(lower(concat_ws(' ', "primary", nullif(secondary, ''), class_name, id)), 'widget')""", SHOWN,
    ),
)
def node_search(spark, sf_dir):
    return explore.node_search(explore.named_nodes(nodes_of(spark, sf_dir)), "  Widget \n NATION_1 ").select("id", "primary", "secondary")


def _search_index(spark, sf_dir):
    return search_index.build(explore.named_nodes(nodes_of(spark, sf_dir)), f"{application_folder(spark)}/search-{uuid.uuid4().hex}")


@query("indexed_node_search", ORACLE["node_search"])
def indexed_node_search(spark, sf_dir):
    """``node_search`` from trigram postings."""
    return search_index.node_search(spark, _search_index(spark, sf_dir), "  Widget \n NATION_1 ").select("id", "primary", "secondary")


@query(
    "indexed_short_search",
    graph_sql(
        """SELECT id, "primary" FROM shown WHERE contains(lower(concat_ws(' ', "primary", nullif(secondary, ''), class_name, id)), 'n7')
  OR contains(lower(concat_ws(' ', "primary", nullif(secondary, ''), class_name, id)), 'q')""", SHOWN,
    ),
)
def indexed_short_search(spark, sf_dir):
    """Words of two letters and one."""
    return search_index.node_search(spark, _search_index(spark, sf_dir), "N7 q").select("id", "primary")


_CHAIN = """lab AS (SELECT edge_id, a, b, string_agg(DISTINCT label, ' · ' ORDER BY label) AS labels FROM edge GROUP BY ALL)"""


@query(
    "node_detail",
    graph_sql(
        """SELECT node, other, o."primary" AS other_primary, o.secondary AS other_secondary, edge_id, labels
FROM (SELECT a AS node, b AS other, edge_id, labels FROM lab UNION ALL SELECT b, a, edge_id, labels FROM lab WHERE a <> b) JOIN shown o ON o.id = other""", _CHAIN, SHOWN,
    ),
)
def node_detail(spark, sf_dir):
    return explore.node_detail(edges_of(spark, sf_dir), shown_of(spark, sf_dir))


@query("laid_out_detail", ORACLE["node_detail"])
def laid_out_detail(spark, sf_dir):
    """``node_detail`` as a scan of a bucketed table."""
    return adjacency.details(spark, laid_out(spark, sf_dir))


@query(
    "node_chains",
    graph_sql(
        """SELECT e.entity_id AS id, e.display_name AS source_name, coalesce(l.labels, '等待更多关系') AS relation, coalesce(o.display_name, '暂无相邻对象') AS target_name
FROM ent e LEFT JOIN (SELECT node, min(struct_pack(a := edge_id, b := other)) AS f FROM (SELECT a AS node, b AS other, edge_id FROM lab UNION ALL SELECT b, a, edge_id FROM lab) GROUP BY 1) n
  ON n.node = e.entity_id LEFT JOIN lab l ON l.edge_id = n.f.a LEFT JOIN ent o ON o.entity_id = n.f.b""", _CHAIN,
    ),
)
def node_chains(spark, sf_dir):
    nodes, edges = stored_graph(spark, sf_dir)
    return explore.node_chains(nodes, edges, shown_of(spark, sf_dir))


_VIEW_SQL = f"""SELECT te.id, string_agg(DISTINCT label, ' · ' ORDER BY label) AS label, CASE WHEN bool_or(strength = 'strong') THEN 'solid' ELSE 'dashed' END AS line_style,
  CASE WHEN count(DISTINCT direction) > 1 THEN 'undirected' WHEN any_value(direction) = 'source_to_target' THEN 'forward' WHEN any_value(direction) = 'target_to_source' THEN 'reverse'
  ELSE 'undirected' END AS direction FROM te JOIN edge e ON te.source_table = least(e.source_table, e.target_table) AND te.target_table = greatest(e.source_table, e.target_table)
WHERE is_shown AND (strength = 'strong' OR confidence >= {{threshold}}) GROUP BY 1"""


@query("table_edge_view", graph_sql(_VIEW_SQL.format(threshold=THRESHOLD), _TABLES_SQL))
def table_edge_view(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    shown = materialize(graph.table_edges(edges), "table-edges")
    return explore.table_edge_view(shown, graph.support_ends(edges, shown), edges, THRESHOLD)


@query(
    "ladder_table_view",
    graph_sql("SELECT * FROM (" + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, * FROM ({_VIEW_SQL.format(threshold=t)})" for t in _STEPS) + ")", _TABLES_SQL),
)
def ladder_table_view(spark, sf_dir):
    """``table_edge_view`` at several thresholds from the confidences of each kind of relation."""
    edges = edges_of(spark, sf_dir)
    shown = materialize(graph.table_edges(edges), "table-edges")
    kinds = materialize(ladder.table_kinds(graph.support_ends(edges, shown), edges), "table-kinds")
    return union_all([ladder.table_edge_view(shown, kinds, t).withColumn("threshold", F.lit(t)) for t in _STEPS])


@query(
    "drill_down",
    graph_sql(
        """SELECT table_edge_id, l.edge_id, s.display_name AS source_name, t.display_name AS target_name, labels, false AS is_missing FROM support JOIN lab l ON l.edge_id = support.edge_id
JOIN ent s ON s.entity_id = l.a JOIN ent t ON t.entity_id = l.b""", _TABLES_SQL, _SUPPORT_SQL, _CHAIN,
    ),
)
def drill_down(spark, sf_dir):
    edges = edges_of(spark, sf_dir)
    support = graph.support_ends(edges, graph.table_edges(edges))
    return explore.drill_down(support, edges, shown_of(spark, sf_dir))


@query(
    "graph_overview",
    graph_sql(
        "SELECT (SELECT count(DISTINCT table_name) FROM ent) AS table_node_count, (SELECT count(*) FROM ent) AS entity_node_count, "
        "(SELECT count(*) FROM te WHERE is_shown) AS table_edge_count, (SELECT count(DISTINCT edge_id) FROM edge) AS entity_edge_count", _TABLES_SQL,
    ),
)
def graph_overview(spark, sf_dir):
    nodes, edges = stored_graph(spark, sf_dir)
    return explore.graph_overview(graph.table_nodes(nodes), nodes, graph.table_edges(edges), edges)
