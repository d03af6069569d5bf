"""Queries over relationship discovery: keys, identifiers, equal values and relation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.functions import identity, labels
from relweave.operators import deterministic as det, documents as docs, factored, graph, judging, relations as rel
from relweave.plans import views
from relweave.plans.oracle_views import BRIDGE, ENT, FK, norm
from relweave.sources.catalog import Catalog, EntityTable, ForeignKey

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def bridge_relations(spark, sf_dir, deal=None):
    catalog = views.catalog(spark, sf_dir, "orders", "part", "supplier", "customer")
    tables = det.find_relation_tables(views.relation_tables(spark, sf_dir))
    return det.relation_table_edges(tables, docs.build_documents(catalog), views.ORIENTATION, deal)


_PROOF = ["evidence.source_field[0] as source_field", "evidence.source_value[0] as source_value",
          "evidence.target_field[0] as target_field", "evidence.target_value[0] as target_value"]


@query(
    "fk_edges",
    f"WITH {FK} SELECT source, target, source_table, target_table, relation_type, direction, strength, confidence, source_field, source_value, "
    "target_field, target_value, source_table || '.' || source_field || ' references ' || target_table || '.' || target_field AS reason FROM fk",
)
def fk_edges(spark, sf_dir):
    edges = det.fk_edges(views.catalog(spark, sf_dir))
    return edges.selectExpr(
        "source", "target", "source_table", "target_table", "relation_type", "direction", "strength", "confidence", *_PROOF, "evidence.reason[0] as reason"
    )


_ODD_FK_SQL = """orders2 AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS buyer FROM orders),
  packs AS (SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE l_linenumber + l_partkey % 2 END AS next FROM lineitem),
  segments AS (SELECT c_mktsegment AS segment, max(c_custkey) AS last FROM customer WHERE c_custkey % 3 <> 0 GROUP BY 1),
  odd AS (SELECT 'orders2:' || id AS source, 'customer2:' || c_custkey AS target, 'buyer' AS source_field, 'c_custkey' AS target_field FROM orders2 JOIN customer ON buyer = c_custkey
      WHERE c_custkey % 3 <> 0
    UNION ALL SELECT 'packs:' || o || '|' || n, 'packs2:' || o || '|' || next, 'o,next', 'o,n' FROM packs WHERE (o, next) IN (SELECT (o, n) FROM packs)
    UNION ALL SELECT 'customer:' || c_custkey, 'customer2:' || last, 'c_mktsegment', 'c_mktsegment' FROM customer JOIN segments ON c_mktsegment = segment)"""


def odd_keys_catalog(spark, sf_dir):
    """Keys with nulls and dangling values, of two columns with a null part, and on a column that is no key and repeats."""
    orders, customers, lines = (views.read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    buyer = F.expr("case when o_orderkey % 7 = 0 then null when o_orderkey % 11 = 0 then o_custkey + 10000000 else o_custkey end")
    named = {"name": F.lit("n"), "class_name": F.lit("C")}
    packs = lines.select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"),
        F.expr("case when l_partkey % 4 = 0 then null else l_linenumber + l_partkey % 2 end").alias("next"),
    ).withColumns(named)
    tables = [
        EntityTable("orders2", orders.select(F.col("o_orderkey").alias("id"), buyer.alias("buyer")).withColumns(named), ("id",)),
        EntityTable("customer2", customers.where("c_custkey % 3 <> 0").withColumns(named), ("c_custkey",)),
        EntityTable("customer", customers.withColumns(named), ("c_custkey",)),
        EntityTable("packs", packs, ("o", "n")), EntityTable("packs2", packs, ("o", "n")),
    ]
    return Catalog.of(tables, [
        ForeignKey("orders2", ("buyer",), "customer2", ("c_custkey",)), ForeignKey("packs", ("o", "next"), "packs2", ("o", "n")),
        ForeignKey("customer", ("c_mktsegment",), "customer2", ("c_mktsegment",)),
    ])


@query("fk_edges_odd_keys", f"WITH {_ODD_FK_SQL} SELECT source, target, source_field, target_field FROM odd")
def fk_edges_odd_keys(spark, sf_dir):
    """What does not resolve has no relation; a key of two columns needs both; of repeated targets the last row counts."""
    fields = [F.array_join(f"evidence.{f}", ",").alias(f) for f in ("source_field", "target_field")]
    return det.fk_edges(odd_keys_catalog(spark, sf_dir)).select("source", "target", *fields)


@query(
    "fk_edges_legacy_merge",
    f"""WITH {FK}, {_ODD_FK_SQL}, labelled AS (SELECT source, target, '外键关联' AS label, 1.0::DOUBLE AS confidence FROM (SELECT source, target FROM fk UNION ALL SELECT source, target FROM odd)
  UNION ALL SELECT 'events:' || event_id, 'customer:' || c_custkey, '值相等(user_id↔c_custkey)', 0.9 FROM events JOIN customer ON user_id = c_custkey WHERE event_id % 3 = 0)
SELECT source, target, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(confidence) AS confidence FROM labelled GROUP BY 1, 2""",
)
def fk_edges_legacy_merge(spark, sf_dir):
    """Declared keys, odd ones too, merged with equal values of some of the same pairs."""
    events = views.catalog(spark, sf_dir, "events", "customer")
    some = Catalog.of([EntityTable(t.name, t.frame.where("event_id % 3 = 0") if t.name == "events" else t.frame, t.primary_key) for t in events.tables.values()])
    equal = det.value_equality_pairs(some, views.FIELD_MATCHES[:1])
    pairs = det.fk_pairs(views.catalog(spark, sf_dir)).unionByName(det.fk_pairs(odd_keys_catalog(spark, sf_dir))).unionByName(equal)
    merged = det.merge_labels(pairs).withColumn("labels", F.array_sort("labels"))
    return merged.select("source", "target", F.array_join("labels", ",").alias("labels"), "confidence")


@query(
    "unique_identifier_edges",
    f"""WITH c AS (SELECT c_custkey AS id, c_name AS raw, {norm('c_name')} AS v FROM customer),
  k AS (SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN NULL WHEN c_nationkey = 4 AND c_mktsegment = 'BUILDING' THEN 'shared'
    ELSE '  ' || upper(c_name) || ' ' END AS raw FROM customer),
  kk AS (SELECT id, raw, {norm('raw')} AS v FROM k WHERE raw IS NOT NULL),
  c1 AS (SELECT v, any_value(id) AS id, any_value(raw) AS raw FROM c GROUP BY v HAVING count(*) = 1),
  k1 AS (SELECT v, any_value(id) AS id, any_value(raw) AS raw FROM kk GROUP BY v HAVING count(*) = 1)
SELECT 'customer:' || c1.id AS source, 'contact:' || k1.id AS target, c1.raw AS source_value, k1.raw AS target_value,
  'unique_identifier' AS relation_type, 'strong' AS strength, 1.0::DOUBLE AS confidence FROM c1 JOIN k1 ON c1.v = k1.v""",
)
def unique_identifier_edges(spark, sf_dir):
    edges = det.unique_identifier_edges(views.contact_catalog(spark, sf_dir), views.IDENTIFIER_PLANS)
    return edges.selectExpr("source", "target", _PROOF[1], _PROOF[3], "relation_type", "strength", "confidence")


_EQUAL_SQL = """SELECT 'events:' || event_id AS source, 'customer:' || c_custkey AS target, '值相等(user_id↔c_custkey)' AS label, 0.9::DOUBLE AS confidence
  FROM events JOIN customer ON user_id = c_custkey
UNION ALL SELECT 'labels:' || l.doc_id, 'documents:' || d.doc_id, '值相等(doc_id↔doc_id)', 0.5::DOUBLE FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


@query("value_equality_edges", _EQUAL_SQL)
def value_equality_edges(spark, sf_dir):
    return det.value_equality_pairs(views.catalog(spark, sf_dir), views.FIELD_MATCHES).drop("sequence")


@query(
    "value_equality_groups",
    """SELECT 'orders.o_custkey' AS source_field, 'events.user_id' AS target_field, CAST(s.v AS VARCHAR) AS value, s.n AS source_rows, t.n AS target_rows,
  s.n * t.n AS pair_count FROM (SELECT o_custkey AS v, count(*) AS n FROM orders GROUP BY 1) s JOIN (SELECT user_id AS v, count(*) AS n FROM events GROUP BY 1) t
  ON s.v = t.v""",
)
def value_equality_groups(spark, sf_dir):
    matches = [det.FieldMatch("orders", "o_custkey", "events", "user_id")]
    return det.value_equality_groups(views.catalog(spark, sf_dir), matches)


_SHARED = [("orders", "o_orderkey", "o_custkey", "events", "event_id", "user_id"), ("events", "event_id", "user_id", "customer", "c_custkey", "c_custkey"),
           ("orders", "o_orderkey", "o_orderkey", "events", "event_id", "event_id")]
_SHARED_SQL = " UNION ".join(
    f"SELECT '{s}:' || s.{sk} AS a, '{t}:' || t.{tk} AS b FROM {s} s JOIN {t} t ON s.{sc} = t.{tc}" for s, sk, sc, t, tk, tc in _SHARED
)


@query(
    "value_equality_degrees",
    f"WITH pairs AS ({_SHARED_SQL}) SELECT id, count(*) AS degree FROM (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY 1",
)
def value_equality_degrees(spark, sf_dir):
    """Distinct neighbours by equal values, some pairs by two of them, from the groups of each value."""
    catalog = views.catalog(spark, sf_dir, "orders", "events", "customer")
    families = [factored.equal_values(catalog, det.FieldMatch(s, sc, t, tc)) for s, _, sc, t, _, tc in _SHARED]
    return factored.neighbour_counts(families).groupBy(F.col("entity_id").alias("id")).agg(F.sum("neighbours").alias("degree"))


@query(
    "merge_labels",
    f"""WITH {FK}, eq AS ({_EQUAL_SQL}), pairs AS (SELECT source, target, '外键关联' AS label, 1.0 AS confidence FROM fk UNION ALL SELECT * FROM eq)
SELECT least(source, target) AS low, greatest(source, target) AS high, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
  CAST(max(confidence) AS DOUBLE) AS confidence FROM pairs GROUP BY 1, 2""",
)
def merge_labels(spark, sf_dir):
    catalog = views.catalog(spark, sf_dir)
    pairs = det.fk_pairs(catalog).unionByName(det.value_equality_pairs(catalog, views.FIELD_MATCHES))
    low, high = identity.pair_columns()
    return det.merge_labels(pairs).select(
        low.alias("low"), high.alias("high"), F.array_join("labels", ",").alias("labels"), "confidence"
    )


@query(
    "endpoint_index",
    f"""WITH {ENT} SELECT class_name, single_key, any_value(entity_id) AS entity_id, any_value(table_name) AS table_name FROM ent
WHERE single_key IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1""",
)
def endpoint_index(spark, sf_dir):
    return det.endpoint_index(docs.build_documents(views.catalog(spark, sf_dir)))


@query(
    "relation_table_edges",
    f"WITH {BRIDGE} SELECT source, target, source_table, target_table, relation_type, source_field, source_value, target_field, target_value, reason FROM bridge",
)
def relation_table_edges(spark, sf_dir):
    return bridge_relations(spark, sf_dir).selectExpr(
        "source", "target", "source_table", "target_table", "relation_type", *_PROOF, "evidence.reason[0] as reason"
    )


@query(
    "relation_orientation",
    """SELECT relation_type, is_reversed, count(*) AS relation_rows FROM (
  SELECT DISTINCT l_orderkey, l_partkey, NULL AS s, 'contains' AS relation_type, false AS is_reversed FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_partkey IN (SELECT p_partkey FROM part)
  UNION ALL SELECT DISTINCT NULL, l_partkey, l_suppkey, 'supplied_by', true FROM lineitem
    WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT p_partkey FROM part)) GROUP BY ALL""",
)
def relation_orientation(spark, sf_dir):
    catalog = views.catalog(spark, sf_dir, "orders", "part", "supplier")
    index = det.endpoint_index(docs.build_documents(catalog))
    rows = det.oriented_relation_rows(views.relation_tables(spark, sf_dir), index, views.ORIENTATION)
    return rows.groupBy("relation_type", "is_reversed").agg(F.count(F.lit(1)).alias("relation_rows"))


@query(
    "relation_dedupe",
    f"""WITH {BRIDGE}, again AS (SELECT DISTINCT 'orders:' || o_orderkey AS source, 'part:' || p_partkey AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 2), every AS (
  SELECT source, target, relation_type, reason FROM bridge UNION ALL SELECT source, target, 'contains', 'relation_id records Part to Order' FROM again)
SELECT source, target, relation_type, count(*) AS evidence_count, string_agg(reason, '; ' ORDER BY reason) AS reasons FROM every GROUP BY ALL""",
)
def relation_dedupe(spark, sf_dir):
    """A third relation table records some pairs again, the other way round: one relation with two proofs."""
    catalog, lines = views.catalog(spark, sf_dir, "orders", "part", "supplier", "customer"), views.read(spark, sf_dir, "lineitem")
    again = lines.where("l_linenumber <= 2").select(
        F.col("l_partkey").alias("left_id"), F.col("l_orderkey").alias("right_id"), F.lit("Part").alias("left_class"), F.lit("Order").alias("right_class"),
    )
    tables = det.find_relation_tables({**views.relation_tables(spark, sf_dir), "relation_id": again})
    merged = det.relation_table_edges(tables, docs.build_documents(catalog), views.ORIENTATION)
    reasons = F.array_join(F.array_sort(F.transform("evidence", lambda e: e["reason"])), "; ")
    return merged.select("source", "target", "relation_type", F.size("evidence").alias("evidence_count"), reasons.alias("reasons"))


_STRONG = f"WITH {FK}, {BRIDGE}, strong AS (SELECT DISTINCT least(source, target) AS low, greatest(source, target) AS high FROM (SELECT source, target FROM fk UNION ALL SELECT source, target FROM bridge)) "


def strong_relations(spark, sf_dir, deal=None):
    return rel.union_relations(det.fk_edges(views.catalog(spark, sf_dir), deal), bridge_relations(spark, sf_dir, deal))


@query(
    "union_relations",
    f"WITH {FK}, {BRIDGE} SELECT source_table, target_table, relation_type, count(*) AS relation_count FROM (SELECT source_table, target_table, relation_type FROM fk "
    "UNION ALL SELECT source_table, target_table, relation_type FROM bridge) GROUP BY ALL",
)
def union_relations(spark, sf_dir):
    return strong_relations(spark, sf_dir).groupBy("source_table", "target_table", "relation_type").agg(F.count(F.lit(1)).alias("relation_count"))


@query("strong_pairs", _STRONG + "SELECT low, high FROM strong")
def strong_pairs(spark, sf_dir):
    return rel.strong_pairs(strong_relations(spark, sf_dir))


_CANDIDATE_SQL = "SELECT 'events:' || event_id AS source_id, 'customer:' || c_custkey AS target_id FROM events JOIN customer ON CAST(floor(value) AS BIGINT) = c_custkey"


@query(
    "exclude_strong_pairs",
    _STRONG + f", c AS ({_CANDIDATE_SQL}) SELECT source_id, target_id FROM c WHERE NOT EXISTS (SELECT 1 FROM strong WHERE low = least(source_id, target_id) AND high = greatest(source_id, target_id))",
)
def exclude_strong_pairs(spark, sf_dir):
    """Candidates from an unrelated equality (event value against customer key), minus strong pairs."""
    events, customers = views.read(spark, sf_dir, "events"), views.read(spark, sf_dir, "customer")
    candidates = events.join(customers, F.floor("value") == F.col("c_custkey")).selectExpr(
        "concat('events:', event_id) as source_id", "concat('customer:', c_custkey) as target_id"
    )
    return judging.exclude_strong_pairs(candidates, rel.strong_pairs(strong_relations(spark, sf_dir)))


@query(
    "endpoint_integrity",
    "SELECT 'events:' || event_id AS source, 'customer:' || CAST(floor(value * 100) AS BIGINT) AS target, 'customer:' || CAST(floor(value * 100) AS BIGINT) AS missing "
    "FROM events WHERE CAST(floor(value * 100) AS BIGINT) NOT IN (SELECT c_custkey FROM customer)",
)
def endpoint_integrity(spark, sf_dir):
    """Relations to customers that may not exist, checked against the documents."""
    events = views.read(spark, sf_dir, "events")
    made_up = events.selectExpr(
        "concat('events:', event_id) as source", "concat('customer:', floor(value * 100)) as target", "'guess' as relation_type"
    )
    documents = docs.build_documents(views.catalog(spark, sf_dir, "events", "customer"))
    return graph.dangling_relations(made_up, documents).drop("relation_type")


@query("edge_id", f"WITH {FK} SELECT source, target, 'fk:' || length(source) || ':' || source || length(target) || ':' || target AS edge_id FROM fk")
def edge_id(spark, sf_dir):
    edges = det.fk_edges(views.catalog(spark, sf_dir))
    return edges.select("source", "target", identity.edge_id("fk", F.col("source"), F.col("target")).alias("edge_id"))


@query("canonical_pair", f"WITH {FK} SELECT source, target, least(source, target) AS low, greatest(source, target) AS high FROM fk")
def canonical_pair(spark, sf_dir):
    low, high = identity.pair_columns()
    return det.fk_edges(views.catalog(spark, sf_dir)).select("source", "target", low.alias("low"), high.alias("high"))


_LABEL_CASES = [("click", "uses"), ("view", "Contains"), ("purchase", "下单商品"), ("signup", "语义关联"), ("error", "x")]


@query(
    "relation_label",
    """SELECT event_type, kind, CASE event_type WHEN 'click' THEN '使用' WHEN 'view' THEN '包含' WHEN 'purchase' THEN '下单商品'
  ELSE CASE kind WHEN 'owns' THEN '拥有' ELSE '相关' END END AS label, count(*) AS events
FROM (SELECT event_type, CASE WHEN value >= 50 THEN 'owns' ELSE 'none' END AS kind FROM events) GROUP BY ALL""",
)
def relation_label(spark, sf_dir):
    given = F.expr("case event_type " + " ".join(f"when '{a}' then '{b}'" for a, b in _LABEL_CASES) + " end")
    kind = F.expr("if(value >= 50, 'owns', 'none')")
    rows = views.read(spark, sf_dir, "events").select("event_type", given.alias("given"), kind.alias("kind"))
    counted = rows.groupBy("event_type", "given", "kind").agg(F.count(F.lit(1)).alias("events"))
    return counted.select("event_type", "kind", labels.relation_label(F.col("given"), F.col("kind")).alias("label"), "events")


@query(
    "relation_summary",
    f"""WITH {FK}, {BRIDGE} SELECT 'foreign_key' AS method, '两个业务对象通过已确认的数据引用建立关系。' AS summary, '已确认存在稳定的数据引用。' AS evidence_summary, count(*) AS relations FROM fk
UNION ALL SELECT 'relation_table', '业务系统记录了这两个对象之间的结构关系。', '业务结构记录提供支持。', count(*) FROM bridge""",
)
def relation_summary(spark, sf_dir):
    methods = F.array_distinct(F.col("evidence.method"))
    counted = strong_relations(spark, sf_dir).groupBy(methods.alias("methods")).agg(F.count(F.lit(1)).alias("relations"))
    return counted.select(
        F.array_join("methods", ",").alias("method"),
        labels.relation_summary(F.col("methods")).alias("summary"),
        labels.evidence_summary(F.col("methods")[0]).alias("evidence_summary"),
        "relations",
    )
