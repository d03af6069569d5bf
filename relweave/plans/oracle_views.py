"""The same entity views in DuckDB SQL, as common table expressions for the oracles."""

from __future__ import annotations


def _entity(table: str, keys: tuple[str, ...], name: str, class_name: str, code: str = "NULL") -> str:
    key_text = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    single = f"CAST({keys[0]} AS VARCHAR)" if len(keys) == 1 else "NULL"
    second = keys[1] if len(keys) > 1 else "0"
    return (
        f"SELECT '{table}:' || {key_text} AS entity_id, '{table}' AS table_name, CAST({keys[0]} AS BIGINT) AS k1, "
        f"CAST({second} AS BIGINT) AS k2, {single} AS single_key, {name} AS display_name, {code} AS display_code, "
        f"'{class_name}' AS class_name FROM {table}"
    )


ENTITIES = {
    "region": _entity("region", ("r_regionkey",), "r_name", "Region"),
    "nation": _entity("nation", ("n_nationkey",), "n_name", "Nation"),
    "customer": _entity("customer", ("c_custkey",), "c_name", "Customer", "CAST(c_custkey AS VARCHAR)"),
    "supplier": _entity("supplier", ("s_suppkey",), "s_name", "Supplier", "s_name"),
    "part": _entity("part", ("p_partkey",), "p_name", "Part", "CASE WHEN p_brand <> 'Brand#1' THEN p_brand ELSE p_type END"),
    "orders": _entity("orders", ("o_orderkey",), "CAST(o_orderkey AS VARCHAR)", "Order"),
    "events": _entity("events", ("event_id",), "event_type", "Event"),
    "documents": _entity("documents", ("doc_id",), "source", "Document"),
    "labels": _entity("labels", ("doc_id",), "CAST(doc_id AS VARCHAR)", "Label"),
    "benchmark": _entity("benchmark", ("item_id",), "CAST(item_id AS VARCHAR)", "Passage"),
    "pages": _entity("pages", ("page_id",), "url", "Page"),
    "conversations": _entity("conversations", ("conv_id", "turn"), "role", "Turn"),
    "embeddings": _entity("embeddings", ("vec_id",), "CAST(vec_id AS VARCHAR)", "Vector"),
}

ENT = "ent AS (" + " UNION ALL ".join(ENTITIES.values()) + ")"


def _fk(source: str, key: str, column: str, target: str, target_key: str) -> str:
    return (
        f"SELECT '{source}:' || s.{key} AS source, '{target}:' || t.{target_key} AS target, '{source}' AS source_table, "
        f"'{target}' AS target_table, '外键关联' AS relation_type, 'strong' AS strength, 1.0::DOUBLE AS confidence, "
        f"'source_to_target' AS direction, '引用' AS label, '{column}' AS source_field, '{target_key}' AS target_field, "
        f"CAST(s.{column} AS VARCHAR) AS source_value, CAST(t.{target_key} AS VARCHAR) AS target_value "
        f"FROM {source} s JOIN {target} t ON s.{column} = t.{target_key}"
    )


FK = "fk AS (" + " UNION ALL ".join(
    [
        _fk("nation", "n_nationkey", "n_regionkey", "region", "r_regionkey"),
        _fk("customer", "c_custkey", "c_nationkey", "nation", "n_nationkey"),
        _fk("supplier", "s_suppkey", "s_nationkey", "nation", "n_nationkey"),
        _fk("orders", "o_orderkey", "o_custkey", "customer", "c_custkey"),
        _fk("events", "event_id", "user_id", "customer", "c_custkey"),
        _fk("labels", "doc_id", "doc_id", "documents", "doc_id"),
    ]
) + ")"

BRIDGE = """bridge AS (
  SELECT DISTINCT 'orders:' || o_orderkey AS source, 'part:' || p_partkey AS target, 'orders' AS source_table,
    'part' AS target_table, 'contains' AS relation_type, 'strong' AS strength, 1.0::DOUBLE AS confidence,
    'source_to_target' AS direction, '包含' AS label, 'left_id' AS source_field, 'right_id' AS target_field,
    CAST(o_orderkey AS VARCHAR) AS source_value, CAST(p_partkey AS VARCHAR) AS target_value,
    'metargetrl records Order to Part' AS reason
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  UNION ALL
  SELECT DISTINCT 'part:' || p_partkey, 'supplier:' || s_suppkey, 'part', 'supplier', 'supplied_by', 'strong',
    1.0::DOUBLE, 'source_to_target', '相关', 'right_id', 'left_id', CAST(p_partkey AS VARCHAR),
    CAST(s_suppkey AS VARCHAR), 'bom_temp_view_data records Supplier to Part'
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
)"""

_REL_COLUMNS = "source, target, source_table, target_table, relation_type, strength, confidence, direction, label"


def norm(text: str) -> str:
    """Normalised value; the test data holds no character that NFKC changes."""
    return f"regexp_replace(lower(coalesce({text}, '')), '\\s+', '', 'g')"


def tokens(text: str) -> str:
    return f"list_distinct(regexp_extract_all({text}, '[a-z0-9]+|[\\x{{3400}}-\\x{{9fff}}]+'))"


# Passages and documents as signature groups, keyword candidates over representatives, and the rules.
PASSAGES = f"""src_all AS (
    SELECT item_id AS id, {norm("text")} AS t, text FROM benchmark),
  src_sig AS (SELECT *, min(id) OVER (PARTITION BY t, id) AS rep FROM src_all),
  tgt_all AS (SELECT doc_id AS id, {norm("text")} AS t, {norm("lang")} AS l, {norm("source")} AS n, lang FROM documents),
  tgt_sig AS (SELECT *, min(id) OVER (PARTITION BY n, t, l) AS rep FROM tgt_all),
  tgt_rep AS (SELECT id, concat_ws('；', nullif(t, ''), nullif(l, '')) AS doc, lang FROM tgt_sig WHERE id = rep),
  post AS (SELECT token, id, row_number() OVER (PARTITION BY token ORDER BY id) AS place
    FROM (SELECT id, unnest({tokens("doc")}) AS token FROM tgt_rep)),
  hit AS (SELECT s.id AS sid, p.id AS tid, min(struct_pack(a := s.token, b := p.place)) AS seen
    FROM (SELECT id, unnest({tokens("t")}) AS token FROM src_sig WHERE id = rep) s
    JOIN post p ON s.token = p.token AND p.place <= 20 GROUP BY 1, 2),
  cand AS (SELECT sid, tid, rk FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY seen, tid) AS rk FROM hit)
    WHERE rk <= 20),
  approved AS (SELECT c.sid, c.tid FROM cand c JOIN tgt_rep r ON r.id = c.tid WHERE starts_with(r.lang, 'en')),
  weak AS (SELECT 'benchmark:' || s.id AS source, 'documents:' || t.id AS target, 'benchmark' AS source_table,
      'documents' AS target_table, 'contains_passage' AS relation_type, 'weak' AS strength, 0.94::DOUBLE AS confidence,
      'target_to_source' AS direction, '包含段落' AS label, s.text AS source_value, t.lang AS target_value
    FROM approved a JOIN src_sig s ON s.rep = a.sid JOIN tgt_sig t ON t.rep = a.tid)"""

# Second relations of some pairs, against the direction of the first, and a table pair with too few weak ones to be shown.
EXTRA = """extra AS (
  SELECT 'orders:' || o_orderkey AS source, 'customer:' || o_custkey AS target, 'orders' AS source_table, 'customer' AS target_table,
    'places' AS relation_type, 'weak' AS strength, 0.97::DOUBLE AS confidence, 'target_to_source' AS direction, '下单' AS label
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 = 0
  UNION ALL
  SELECT 'region:' || r_regionkey, 'benchmark:' || item_id, 'region', 'benchmark', 'mentions', 'weak', 0.7::DOUBLE, 'source_to_target', '相关'
  FROM region JOIN benchmark ON r_regionkey = item_id WHERE r_regionkey < 2)"""

REL = f"rel AS (SELECT {_REL_COLUMNS} FROM fk UNION ALL SELECT {_REL_COLUMNS} FROM extra UNION ALL SELECT {_REL_COLUMNS} FROM bridge UNION ALL SELECT {_REL_COLUMNS} FROM weak)"

EDGE = """edge AS (SELECT *, least(source, target) AS a, greatest(source, target) AS b,
  'entity:' || length(least(source, target)) || ':' || least(source, target) || length(greatest(source, target)) || ':'
  || greatest(source, target) AS edge_id FROM rel)"""

GRAPH = ", ".join([FK, EXTRA, BRIDGE, PASSAGES, REL, EDGE])

DEGREE = """ends AS (SELECT DISTINCT edge_id, a, b FROM edge),
  degree AS (SELECT entity_id AS id, table_name AS table_id, count(e.node) AS degree FROM ent
    LEFT JOIN (SELECT a AS node FROM ends UNION ALL SELECT b FROM ends WHERE b <> a) e ON e.node = entity_id GROUP BY 1, 2)"""

SHOWN = """shown AS (SELECT entity_id AS id, table_name AS table_id, class_name, display_name AS "primary",
    CASE WHEN cnt > 1 THEN coalesce(nullif(display_code, ''), '同名 ' || num) ELSE '' END AS secondary, cnt > 1 AS is_duplicate
  FROM (SELECT *, count(*) OVER (PARTITION BY lower(display_name)) AS cnt,
    row_number() OVER (PARTITION BY lower(display_name) ORDER BY entity_id) AS num FROM ent))"""


def graph_sql(body: str, *more: str) -> str:
    """A query over the graph expressions."""
    return "WITH " + ", ".join([ENT, GRAPH, *more]) + " " + body
