"""Queries over scans, table profiles and column functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from relweave.functions import identity, labels, text, vectors
from relweave.functions.values import as_text, encoded_object
from relweave.operators import documents as docs, deterministic as det, ranking
from relweave.operators.plans import RelationshipPlan, check_plans, plans_frame
from relweave.plans import views
from relweave.plans.oracle_views import ENT, ENTITIES, norm, tokens
from relweave.session import shared_folder
from relweave.sources import profile, snapshot
from relweave.sources.catalog import Catalog, EntityTable, union_all

VIEW_SQL = {
    "region": "SELECT *, r_name AS name, 'Region' AS class_name FROM region",
    "nation": "SELECT *, n_name AS name, 'Nation' AS class_name FROM nation",
    "customer": "SELECT *, c_name AS name, 'Customer' AS class_name, CAST(c_custkey AS VARCHAR) AS customer_no FROM customer",
    "supplier": "SELECT *, s_name AS name, 'Supplier' AS class_name, s_name AS supplier_code FROM supplier",
    "part": "SELECT *, p_name AS name, 'Part' AS class_name, nullif(p_brand, 'Brand#1') AS part_code, p_type AS model FROM part",
    "orders": "SELECT *, CAST(o_orderkey AS VARCHAR) AS name, 'Order' AS class_name FROM orders",
    "events": "SELECT *, event_type AS name, 'Event' AS class_name FROM events",
    "documents": "SELECT *, source AS name, 'Document' AS class_name FROM documents",
    "labels": "SELECT *, CAST(doc_id AS VARCHAR) AS name, 'Label' AS class_name FROM labels",
    "benchmark": "SELECT *, CAST(item_id AS VARCHAR) AS name, 'Passage' AS class_name FROM benchmark",
    "pages": "SELECT *, url AS name, 'Page' AS class_name FROM pages",
    "conversations": "SELECT *, role AS name, 'Turn' AS class_name FROM conversations",
    "embeddings": "SELECT *, CAST(vec_id AS VARCHAR) AS name, 'Vector' AS class_name FROM embeddings",
}
PRIMARY_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey",
    "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "benchmark": "item_id",
    "pages": "page_id", "conversations": "conv_id,turn", "embeddings": "vec_id",
}
SOURCE_KEYS = {"nation": "n_regionkey", "customer": "c_nationkey", "supplier": "s_nationkey", "orders": "o_custkey",
               "events": "user_id", "labels": "doc_id"}

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


COUNTS_SQL = _union([f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in VIEW_SQL])


@query(
    "scoped_scan",
    "SELECT o_orderstatus, o_orderpriority, o_totalprice, CAST(o_orderkey AS VARCHAR) AS name, 'Order' AS class_name, "
    "o_orderkey, o_custkey FROM orders",
)
def scoped_scan(spark, sf_dir):
    return views.catalog(spark, sf_dir, "nation", "customer", "orders", "region").scoped(["nation", "customer", "orders"]).scan("orders")


@query("aux_projection", "SELECT 'customer:' || c_custkey AS entity_id, c_mktsegment, c_acctbal FROM customer")
def aux_projection(spark, sf_dir):
    catalog = views.catalog(spark, sf_dir, "customer", "nation", "orders", "events")
    frame = catalog.scan("customer")
    return frame.select(
        identity.entity_id(frame, "customer", ["c_custkey"]).alias("entity_id"), *catalog.auxiliary_dimensions("customer")
    )


_ROLE_SQL = _union(
    [
        f"SELECT '{t}' AS table_name, column_name, non_null_count, list_contains(string_split('{PRIMARY_KEYS[t]}', ','), column_name)"
        f" AS is_primary_key, column_name = '{SOURCE_KEYS.get(t, '')}' AS is_foreign_key"
        f" FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM ({sql})) ON COLUMNS(*) INTO NAME column_name VALUE non_null_count)"
        for t, sql in VIEW_SQL.items()
    ]
)


@query(
    "column_roles",
    f"""SELECT table_name, column_name, non_null_count, is_primary_key, is_foreign_key, column_name = 'name' AS is_name,
  column_name = 'class_name' AS is_class_name,
  CASE WHEN list_contains(string_split(column_name, '_'), 'code') THEN 0
       WHEN list_contains(string_split(column_name, '_'), 'number') THEN 1
       WHEN list_contains(string_split(column_name, '_'), 'no') THEN 2
       WHEN list_contains(string_split(column_name, '_'), 'serial') THEN 3
       WHEN list_contains(string_split(column_name, '_'), 'model') THEN 4 END AS code_priority
FROM ({_ROLE_SQL})""",
)
def column_roles(spark, sf_dir):
    return profile.column_roles(views.catalog(spark, sf_dir)).drop("position", "type")


def _key_sql(table: str, kind: str, columns: str) -> str:
    complete = " AND ".join(f"{c} IS NOT NULL" for c in columns.split(","))
    return (
        f"SELECT '{table}' AS table_name, '{kind}' AS key_kind, '{columns}' AS key_columns, "
        f"CAST(sum(n) AS BIGINT) AS row_count, CAST(coalesce(sum(n) FILTER (NOT ({complete})), 0) AS BIGINT) AS null_rows, "
        f"count(*) FILTER ({complete}) AS distinct_keys, count(*) FILTER ({complete} AND n > 1) AS repeated_keys "
        f"FROM (SELECT {columns}, count(*) AS n FROM {table} GROUP BY ALL)"
    )


@query(
    "key_profile",
    _union(
        [_key_sql(t, "primary", k) for t, k in PRIMARY_KEYS.items()]
        + [_key_sql("customer", "unique", "c_name")]
        + [_key_sql(t, "foreign", k) for t, k in SOURCE_KEYS.items()]
        + [_key_sql("lineitem", "primary", "l_orderkey,l_linenumber")]
    ),
)
def key_profile(spark, sf_dir):
    return profile.key_profile(_with_lines(spark, sf_dir))


def _with_lines(spark, sf_dir) -> Catalog:
    catalog = views.catalog(spark, sf_dir)
    lines = EntityTable("lineitem", views.read(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))
    return Catalog.of([*catalog.tables.values(), lines], catalog.foreign_keys)


@query("eligible_tables", COUNTS_SQL)
def eligible_tables(spark, sf_dir):
    return profile.eligible_tables(_with_lines(spark, sf_dir))


@query(
    "nested_values",
    """SELECT event_id, '[''' || event_type || ''', ''' || user_id || ''', ' || CASE WHEN event_id % 3 = 0 THEN 'None' ELSE '"it''s"' END || ']' AS as_list,
  '{''' || event_type || ''': [' || user_id || ', None]}' AS as_map, 'b''' || event_type || chr(92) || 'n''' AS as_bytes,
  '{''kind'': ''' || event_type || ''', ''late'': ' || CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END || '}' AS as_fields FROM events""",
)
def nested_values(spark, sf_dir):
    """The text of arrays, maps, bytes and structs."""
    rows = views.read(spark, sf_dir, "events").selectExpr(
        "event_id", "array(event_type, cast(user_id as string), if(event_id % 3 = 0, null, \"it's\")) as as_list", "map(event_type, array(user_id, null)) as as_map",
        "encode(concat(event_type, '\\n'), 'utf-8') as as_bytes", "named_struct('kind', event_type, 'late', event_id % 2 = 0) as as_fields",
    )
    return rows.select("event_id", *[as_text(c, rows.schema[c].dataType).alias(c) for c in rows.columns[1:]])


_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "FLOAT[]": "array<float>", "TIMESTAMP": "timestamp_ntz"}


def _fingerprint_sql() -> str:
    """The same JSON from what DuckDB tells of the views, and its digest."""
    tables = []
    for table, sql in VIEW_SQL.items():
        kind = "CASE column_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items()) + " ELSE lower(column_type) END"
        keys = "', '".join(PRIMARY_KEYS[table].split(","))
        flags = ", ".join(f"""'"{name}": ' || CAST({test} AS VARCHAR)""" for name, test in (
            ("is_class_name", "column_name = 'class_name'"), ("is_foreign_key", f"column_name = '{SOURCE_KEYS.get(table, '')}'"),
            ("is_name", "column_name = 'name'"), ("is_primary_key", f"column_name IN ('{keys}')"),
        ))
        column = f"""'{{' || concat_ws(', ', {flags}, '"name": ' || to_json(column_name), '"type": ' || to_json({kind})) || '}}'"""
        tables.append(f"""SELECT '{table}' AS t, '{{"columns": [' || string_agg(c, ', ' ORDER BY n) || '], "name": "{table}"}}' AS j
  FROM (SELECT {column} AS c, row_number() OVER () AS n FROM (DESCRIBE {sql}))""")
    return f"SELECT table_name, row_count, 'sha256:' || (SELECT sha256('[' || string_agg(j, ', ' ORDER BY t) || ']') FROM ({_union(tables)})) AS fingerprint FROM ({COUNTS_SQL})"


@query("schema_fingerprint", _fingerprint_sql())
def schema_fingerprint(spark, sf_dir):
    return profile.schema_fingerprint(views.catalog(spark, sf_dir))


def _summary_sql(table: str, sql: str) -> str:
    keys = PRIMARY_KEYS[table]
    order = ", ".join(keys.split(","))
    usable = f"SELECT trim(name) AS n, trim(class_name) AS c, row_number() OVER (ORDER BY {order}) AS rn FROM ({sql}) WHERE trim(name) <> ''"
    return (
        f"SELECT '{table}' AS table_name, (SELECT count(*) FROM {table}) AS row_count, "
        f"(SELECT string_agg(left(n, 80), '|' ORDER BY rn) FROM ({usable}) WHERE rn <= 3) AS name_samples, "
        f"(SELECT string_agg(left(c, 80), '|' ORDER BY rn) FROM ({usable}) WHERE rn <= 3) AS class_name_samples"
    )


@query("table_summary", _union([_summary_sql(t, s) for t, s in VIEW_SQL.items()]))
def table_summary(spark, sf_dir):
    summary = profile.table_summary(views.catalog(spark, sf_dir))
    return summary.select(
        "table_name", "row_count",
        F.array_join("name_samples", "|").alias("name_samples"), F.array_join("class_name_samples", "|").alias("class_name_samples"),
    )


@query(
    "sample_redaction",
    """SELECT source, rn AS sample_rank, left(t, 80) AS sample FROM (
  SELECT source, t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
  FROM (SELECT source, doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents) WHERE t <> '' AND NOT regexp_matches(t,
    '(?i)(?:api[_-]?key|password|secret|access[_-]?token)\\s*[:=]|\\bsk-[a-z0-9_-]{6,}')) WHERE rn <= 3""",
)
def sample_redaction(spark, sf_dir):
    return profile.grouped_samples(views.read(spark, sf_dir, "documents"), "source", "text", "doc_id")


_FALLBACK_SQL = "concat(upper(table_name[1]), lower(table_name[2:]), ' 数据')"


@query("fallback_table_name", f"SELECT table_name, row_count, {_FALLBACK_SQL} AS semantic_name FROM ({COUNTS_SQL})")
def fallback_table_name(spark, sf_dir):
    counts = profile.row_counts(views.catalog(spark, sf_dir))
    return counts.withColumn("semantic_name", text.fallback_table_name(F.col("table_name")))


@query(
    "summary_merge",
    f"""SELECT table_name, row_count, coalesce(CASE table_name WHEN 'customer' THEN '客户' WHEN 'orders' THEN '订单' END,
  {_FALLBACK_SQL}) AS semantic_name,
  CASE WHEN table_name IN ('customer', 'orders') THEN 'inferred' ELSE 'fallback' END AS status FROM ({COUNTS_SQL})""",
)
def summary_merge(spark, sf_dir):
    summary = profile.table_summary(views.catalog(spark, sf_dir))
    inferred = spark.createDataFrame([("customer", "客户"), ("orders", " 订单 ")], "table_name string, semantic_name string")
    return profile.merge_inferred_names(summary, inferred).drop("name_samples")


@query("snapshot_table_nodes", f"SELECT table_name AS id, table_name AS display_name, row_count AS entity_count FROM ({COUNTS_SQL})")
def snapshot_table_nodes(spark, sf_dir):
    """Writes the node tables as a snapshot and reads the table nodes back."""
    from relweave.operators import graph

    nodes = graph.entity_nodes(docs.build_documents(views.catalog(spark, sf_dir)))
    path = f"{shared_folder(spark)}/relweave-snapshot-{uuid.uuid4().hex}"
    snapshot.write_snapshot({"table_nodes": graph.table_nodes(nodes)}, path)
    return spark.read.parquet(f"{path}/table_nodes")


@query(
    "plan_samples",
    """SELECT 'part' AS table_name, unnest(['p_brand', 'p_type', 'p_size', 'p_retailprice']) AS dimension,
  unnest([to_json(p_brand), to_json(p_type), CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR)]) AS sample_value,
  unnest(['string', 'string', 'int', 'double']) AS type FROM (SELECT * FROM part ORDER BY p_partkey LIMIT 1)
UNION ALL SELECT 'orders', unnest(['o_orderstatus', 'o_orderpriority', 'o_totalprice']),
  unnest([to_json(o_orderstatus), to_json(o_orderpriority), CAST(o_totalprice AS VARCHAR)]), unnest(['string', 'string', 'double'])
  FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1)""",
)
def plan_samples(spark, sf_dir):
    return profile.plan_samples(views.catalog(spark, sf_dir, "part", "orders"))


@query("table_search", f"SELECT table_name, row_count, {_FALLBACK_SQL} AS semantic_name FROM ({COUNTS_SQL}) WHERE contains(lower(table_name), 'er')")
def table_search(spark, sf_dir):
    return profile.search_tables(fallback_table_name(spark, sf_dir), " ER ")


# Column functions.


@query("normalize_value", f"SELECT doc_id, {norm('text')} AS normalized FROM documents")
def normalize_value(spark, sf_dir):
    return views.read(spark, sf_dir, "documents").select("doc_id", text.normalize_value(F.col("text")).alias("normalized"))


@query(
    "entity_id",
    """SELECT 'pages:' || replace(replace(replace(url_encode(url), '+', '%20'), '*', '%2A'), '%7E', '~') AS entity_id FROM pages
UNION ALL SELECT 'conversations:' || conv_id || '|' || turn || '|' || role FROM conversations""",
)
def entity_id(spark, sf_dir):
    pages, turns = views.read(spark, sf_dir, "pages"), views.read(spark, sf_dir, "conversations")
    return pages.select(identity.entity_id(pages, "pages", ["url"]).alias("entity_id")).union(
        turns.select(identity.entity_id(turns, "conversations", ["conv_id", "turn", "role"]))
    )


def _partly_named(spark, sf_dir) -> Catalog:
    frame = views.read(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "case c_nationkey when 5 then '   ' when 6 then null else concat(' ', c_name) end as name",
        "nullif(c_mktsegment, 'BUILDING') as className",
    )
    return Catalog.of([EntityTable("client", frame, ("c_custkey",))])


@query(
    "display_name",
    "SELECT 'client:' || c_custkey AS entity_id, CASE WHEN c_nationkey IN (5, 6) THEN '未命名对象' ELSE c_name END AS display_name, "
    "c_nationkey IN (5, 6) AS is_blank_name FROM customer",
)
def display_name(spark, sf_dir):
    return docs.build_documents(_partly_named(spark, sf_dir)).select("entity_id", "display_name", "is_blank_name")


@query("class_name", "SELECT 'client:' || c_custkey AS entity_id, nullif(c_mktsegment, 'BUILDING') AS class_name FROM customer")
def class_name(spark, sf_dir):
    return docs.build_documents(_partly_named(spark, sf_dir)).select("entity_id", "class_name")


@query(
    "display_name_legacy",
    "SELECT 'task:' || o_orderkey AS entity_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus WHEN o_orderpriority <> '1-URGENT' "
    "THEN o_orderpriority ELSE 'task:' || o_orderkey END AS display_name FROM orders",
)
def display_name_legacy(spark, sf_dir):
    frame = views.read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "if(o_orderstatus = 'P', ' ', o_orderstatus) as state", "nullif(o_orderpriority, '1-URGENT') as urgency"
    )
    catalog = Catalog.of([EntityTable("task", frame, ("o_orderkey",), ("state", "urgency"))])
    return docs.build_documents(catalog).select("entity_id", "display_name")


@query("display_code", f"WITH {ENT} SELECT entity_id, display_code FROM ent WHERE display_code IS NOT NULL")
def display_code(spark, sf_dir):
    return docs.build_documents(views.catalog(spark, sf_dir)).where("display_code is not null").select("entity_id", "display_code")


def _search_sql(table: str, dims: list[str]) -> str:
    shown = "".join(f" || '；{d}：' || coalesce(CAST({d} AS VARCHAR), 'None')" for d in dims)
    keys = " || '|' || ".join(PRIMARY_KEYS[table].split(","))
    return f"SELECT '{table}:' || {keys} AS entity_id, '{table}' AS table_name, name || '；' || class_name{shown} AS search_text FROM ({VIEW_SQL[table]})"


_DIMS = {
    "customer": ["c_mktsegment", "c_acctbal"], "supplier": ["s_acctbal"], "part": ["p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderstatus", "o_orderpriority", "o_totalprice"], "events": ["value", "props"], "documents": ["text", "lang"],
    "labels": ["quality", "toxic"], "benchmark": ["text"], "pages": ["html"], "conversations": ["text"], "embeddings": ["label"],
}


@query("build_documents", _union([_search_sql(t, _DIMS.get(t, [])) for t in VIEW_SQL]))
def build_documents(spark, sf_dir):
    return docs.build_documents(views.catalog(spark, sf_dir)).select("entity_id", "table_name", "search_text")


@query(
    "dimension_text",
    f"""SELECT 'part:' || p_partkey AS entity_id, concat_ws('；', {norm('p_type')}, {norm('p_brand')}) AS dimension_text FROM part
UNION ALL SELECT 'documents:' || doc_id, concat_ws('；', nullif({norm('lang')}, ''), nullif({norm('text')}, '')) FROM documents""",
)
def dimension_text(spark, sf_dir):
    documents = docs.build_documents(views.catalog(spark, sf_dir, "part", "documents"))
    names = F.when(F.col("table_name") == "part", F.array(F.lit("p_type"), F.lit("p_brand"))).otherwise(F.array(F.lit("lang"), F.lit("text")))
    return documents.select("entity_id", text.dimension_text(F.col("normalized_dimensions"), names).alias("dimension_text"))


@query("keyword_tokens", f"SELECT conv_id, turn, array_to_string(list_sort({tokens('lower(text)')}), ' ') AS tokens FROM conversations")
def keyword_tokens(spark, sf_dir):
    turns = views.read(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.array_join(F.array_sort(text.keyword_tokens(F.col("text"))), " ").alias("tokens"))


@query(
    "public_json",
    """SELECT '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":'
  || CAST(o_totalprice AS VARCHAR) || ',"o_orderdate":{"$type":"datetime","value":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
  || '"},"o_orderpriority":"' || o_orderpriority || '"}' AS value FROM orders""",
)
def public_json(spark, sf_dir):
    return snapshot.public_json(views.read(spark, sf_dir, "orders"))


@query(
    "safe_label",
    """SELECT label, length(label) BETWEEN 2 AND 12 AND regexp_full_match(label, '[\\x{3400}-\\x{9fff}]+') AS is_safe, count(*) AS events
FROM (SELECT CASE event_type WHEN 'click' THEN '点击' WHEN 'view' THEN '看' WHEN 'purchase' THEN '购买A' WHEN 'signup' THEN '注册成为会员' ELSE event_type END
  AS label FROM events) GROUP BY ALL""",
)
def safe_label(spark, sf_dir):
    known = F.expr("case event_type when 'click' then '点击' when 'view' then '看' when 'purchase' then '购买A' when 'signup' then '注册成为会员' else event_type end")
    counted = views.read(spark, sf_dir, "events").groupBy(known.alias("label")).agg(F.count(F.lit(1)).alias("events"))
    return counted.withColumn("is_safe", text.safe_label(F.col("label")))


_CONFIDENCE_SQL = "CASE event_type WHEN 'error' THEN 'nan'::DOUBLE ELSE value / (value + 10) END"


@query(
    "confidence_band",
    f"""SELECT event_id, CASE WHEN isnan(c) THEN '可能有关' WHEN c >= 0.85 THEN '明确' WHEN c >= 0.6 THEN '较可信' ELSE '可能有关' END AS band,
  CASE WHEN isnan(c) THEN 'NaN%' ELSE CAST(CAST(floor(c * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' END AS percent
FROM (SELECT event_id, {_CONFIDENCE_SQL} AS c FROM events)""",
)
def confidence_band(spark, sf_dir):
    confidence = F.expr("case when event_type = 'error' then double('NaN') else value / (value + 10) end")
    return views.read(spark, sf_dir, "events").withColumn("c", confidence).select(
        "event_id", labels.confidence_band(F.col("c")).alias("band"), labels.confidence_percent(F.col("c")).alias("percent")
    )


@query(
    "business_name",
    """SELECT id, CASE WHEN named THEN n WHEN lower(n) IN ('0', '1') OR n IN ('error') THEN '未命名对象' ELSE n END AS business_name FROM (
  SELECT 'events:' || event_id AS id, event_type AS n, value >= 50 AS named FROM events
  UNION ALL SELECT 'orders:' || o_orderkey, o_orderstatus, false FROM orders
  UNION ALL SELECT 'embeddings:' || vec_id, CAST(label AS VARCHAR), false FROM embeddings)""",
)
def business_name(spark, sf_dir):
    parts = [
        views.read(spark, sf_dir, "events").selectExpr("concat('events:', event_id) as id", "event_type as n", "if(value >= 50, 'name', null) as src"),
        views.read(spark, sf_dir, "orders").selectExpr("concat('orders:', o_orderkey)", "o_orderstatus", "cast(null as string)"),
        views.read(spark, sf_dir, "embeddings").selectExpr("concat('embeddings:', vec_id)", "cast(label as string)", "cast(null as string)"),
    ]
    rows = parts[0].union(parts[1]).union(parts[2])
    return rows.select("id", labels.business_name(F.lit(None).cast("string"), F.col("n"), F.col("src")).alias("business_name"))


@query("search_text_norm", "SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS search_text FROM documents")
def search_text_norm(spark, sf_dir):
    return views.read(spark, sf_dir, "documents").select("doc_id", text.search_norm(F.col("text")).alias("search_text"))


@query(
    "usable_vector",
    """SELECT vec_id, label NOT IN (0, 1, 2, 3) AS is_usable FROM embeddings""",
)
def usable_vector(spark, sf_dir):
    broken = F.expr(
        "case label when 0 then slice(embedding, 1, 10) when 1 then transform(embedding, x -> float('NaN')) "
        "when 2 then transform(embedding, x -> float(0)) when 3 then cast(null as array<float>) else embedding end"
    )
    return views.read(spark, sf_dir, "embeddings").select("vec_id", vectors.usable_vector(broken, 64).alias("is_usable"))


@query(
    "l2_normalize",
    """SELECT vec_id, position, CAST(CAST(x / sqrt(norm2) AS FLOAT) AS DOUBLE) AS value FROM (
  SELECT vec_id, unnest(range(0, len(embedding))) AS position, unnest(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS x,
    list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) AS norm2 FROM embeddings)""",
)
def l2_normalize(spark, sf_dir):
    rows = views.read(spark, sf_dir, "embeddings")
    unit = vectors.l2_normalize(F.col("embedding"))
    return rows.select("vec_id", F.posexplode(unit).alias("position", "v")).select(
        "vec_id", F.col("position").cast("bigint").alias("position"), F.col("v").cast("double").alias("value")
    )


# Documents and their groups.


@query(
    "signature_groups",
    f"""WITH s AS (
  SELECT 'part' AS table_name, 'part:' || p_partkey AS id, p_partkey AS k, {norm('p_name')} || '|' || {norm('p_brand')} || '|' || p_type || '|' || p_size
    || '|' || p_retailprice AS sig FROM part
  UNION ALL SELECT 'documents', 'documents:' || doc_id, doc_id, source || '|' || {norm('lang')} || '|' || {norm('text')} FROM documents
  UNION ALL SELECT 'events', 'events:' || event_id, event_id, event_type || '|' || value || '|' || {norm('props')} FROM events)
SELECT table_name, arg_min(id, k) AS representative_id, count(*) AS member_count FROM s GROUP BY table_name, sig""",
)
def signature_groups(spark, sf_dir):
    documents = docs.build_documents(views.catalog(spark, sf_dir, "part", "documents", "events"))
    return docs.signature_groups(documents).drop("signature")


@query(
    "document_conflicts",
    """SELECT 'orders:' || l_orderkey || '%7C' || l_linenumber AS entity_id, count(DISTINCT (l_partkey, l_quantity)) AS versions, count(*) AS copies
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT (l_partkey, l_quantity)) > 1""".replace("'orders:' || l_orderkey || '%7C'", "'lineitem:' || l_orderkey || '|'"),
)
def document_conflicts(spark, sf_dir):
    frame = views.read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "'line' as name", "'Line' as class_name", "l_partkey", "l_quantity"
    )
    catalog = Catalog.of([EntityTable("lineitem", frame, ("l_orderkey", "l_linenumber"), ("l_partkey", "l_quantity"))])
    return docs.document_conflicts(docs.build_documents(catalog))


@query(
    "quality_flags",
    "SELECT 'client' AS table_name, false AS missing_name_column, false AS missing_class_column, bool_or(c_nationkey IN (5, 6)) AS has_blank_name, "
    "count(*) AS row_count FROM customer UNION ALL SELECT 'lineitem', true, true, NULL, count(*) FROM lineitem "
    + "".join(f" UNION ALL SELECT '{t}', false, false, bool_or(name IS NULL OR trim(name) = ''), count(*) FROM ({s})" for t, s in VIEW_SQL.items()),
)
def quality_flags(spark, sf_dir):
    tables = [*_with_lines(spark, sf_dir).tables.values(), *_partly_named(spark, sf_dir).tables.values()]
    return docs.quality_flags(Catalog.of(tables))


# Plans.

_PLAN_ROWS = [
    views.PASSAGE_PLAN,
    views.TURN_PLAN,
    RelationshipPlan("part", "part", "same", "同类零件", "undirected", ("p_type",), ("p_type",), ("keyword",), 5, ""),
    RelationshipPlan("part", "orders", "keyed", "引用订单", "undirected", ("p_type",), ("o_orderkey",), ("keyword",), 5, ""),
]


@query(
    "validate_plans",
    """SELECT 'contains_passage' AS relation_type, (SELECT count(*) FROM benchmark) AS source_rows, (SELECT count(*) FROM documents) AS target_rows,
  NULL AS problem
UNION ALL SELECT 'quoted', (SELECT count(*) FROM benchmark), (SELECT count(*) FROM conversations), NULL
UNION ALL SELECT 'same', (SELECT count(*) FROM part), (SELECT count(*) FROM part), 'same table'
UNION ALL SELECT 'keyed', (SELECT count(*) FROM part), (SELECT count(*) FROM orders), 'target dimension out of scope'""",
)
def validate_plans(spark, sf_dir):
    catalog = views.catalog(spark, sf_dir)
    checked = check_plans(plans_frame(spark, _PLAN_ROWS), catalog)
    counts = profile.row_counts(catalog)
    for side in ("source", "target"):
        sizes = counts.select(F.col("table_name").alias(f"{side}_table"), F.col("row_count").alias(f"{side}_rows"))
        checked = checked.join(sizes, f"{side}_table", "left")
    return checked.select("relation_type", "source_rows", "target_rows", "problem")


@query(
    "allowed_dimensions",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{d}' AS dimension, count({d}) AS non_null_count FROM {t}"
        for t, dims in {**_DIMS, "customer": ["c_nationkey", "c_mktsegment", "c_acctbal"]}.items()
        for d in dims
    ),
)
def allowed_dimensions(spark, sf_dir):
    catalog = views.catalog(spark, sf_dir)
    frames = []
    for table, spec in catalog.tables.items():
        allowed = catalog.allowed_dimensions(table)
        if allowed:
            counts = spec.frame.agg(*[F.count(F.col(c)).alias(c) for c in allowed])
            frames.append(counts.unpivot([], allowed, "dimension", "non_null_count").withColumn("table_name", F.lit(table)))
    return union_all(frames)


@query(
    "nearest_rank_percentile",
    """SELECT event_type, arg_min(value, rn) AS percentile_value FROM (
  SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events)
WHERE rn >= greatest(1, ceil(n * 95 / 100)) GROUP BY event_type""",
)
def nearest_rank_percentile(spark, sf_dir):
    return ranking.nearest_rank_percentile(views.read(spark, sf_dir, "events"), ["event_type"], "value", 95)


@query(
    "fk_target_dedupe",
    "SELECT o_custkey, 'orders:' || max(o_orderkey) AS entity_id FROM orders GROUP BY o_custkey",
)
def fk_target_dedupe(spark, sf_dir):
    orders = views.read(spark, sf_dir, "orders")
    return det.fk_target_dedupe(orders, ["o_custkey"], ["o_orderkey"], "orders")


@query(
    "relation_table_discovery",
    "SELECT 'metargetrl' AS table_name, true AS is_relation_table, count(*) AS row_count FROM lineitem "
    "UNION ALL SELECT 'bom_temp_view_data', true, count(*) FROM lineitem UNION ALL SELECT 'Relation_ID', false, count(*) FROM orders "
    "UNION ALL SELECT 'lineitem', false, count(*) FROM lineitem",
)
def relation_table_discovery(spark, sf_dir):
    frames = dict(views.relation_tables(spark, sf_dir))
    frames["Relation_ID"] = views.read(spark, sf_dir, "orders")
    frames["lineitem"] = views.read(spark, sf_dir, "lineitem")
    return det.relation_table_columns(frames)
