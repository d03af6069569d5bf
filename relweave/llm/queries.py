"""The registered queries of this subpackage, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relweave.llm import decontamination, embeddings, exact_duplicates, language, lexical, manifest, mixing, near_duplicates, paragraphs, pii, quality, repeated_substrings, token_counts
from relweave.llm.tables import keep, read

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; its source is the host, and its language in it the path."""
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return quality.judged(documents, labels, F.col("source"), F.col("lang"))


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold ten words in a row of which benchmark items."""
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE["op2_decontaminate"] = f"""
WITH dw AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS ws FROM documents),
iw AS (SELECT item_id, {_WORDS.format('text')} AS ws FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS w, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT w FROM windows),
places AS (
  SELECT doc_id, w, i, array_to_string(ws[i:i + w - 1], ' ') AS k
  FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM dw, sizes WHERE len(ws) >= w)),
found AS (SELECT doc_id, i, p.w, item_id FROM places p JOIN windows USING (w, k)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + w)) AS j FROM (SELECT DISTINCT doc_id, i, w FROM found)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids, list(id ORDER BY id) AS id_list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AS contaminated
FROM dw d LEFT JOIN hit h USING (doc_id) LEFT JOIN items i USING (doc_id)
"""


@query
def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return embeddings.near_vectors(read(spark, sf_dir, "embeddings"))


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents with a weighted Jaccard similarity of 0.8 or more."""
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of every document repeat an earlier paragraph nearly or exactly."""
    return paragraphs.repeated_paragraphs(read(spark, sf_dir, "documents"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after all documents came, the same batch came again, the toxic ones went, and a word of some others was respelt."""
    documents = read(spark, sf_dir, "documents")
    counts = keep(token_counts.counted(documents), "token-counts")
    toxic = read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    # What changes is told by the text itself and counted where it is read, so no text is joined with anything.
    old = documents.where(F.contains("text", F.lit("License")))
    new = old.withColumn("text", F.replace("text", F.lit("License"), F.lit("Licence")))
    inserted, deleted = (token_counts.counted(rows).join(toxic, "doc_id", "left_anti") for rows in (new, old))
    rollup = token_counts.Rollup(spark)
    rollup.commit("all documents", token_counts.differences(inserted=counts))
    rollup.commit("all documents", token_counts.differences(inserted=counts))
    rollup.commit("toxic documents", token_counts.differences(deleted=counts.join(toxic, "doc_id", "left_semi")))
    rollup.compact()
    rollup.commit("respelt documents", token_counts.differences(inserted=inserted, deleted=deleted))
    return rollup.totals()


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from two thirds of them."""
    documents = read(spark, sf_dir, "documents")
    return language.identify(documents, language.learn(documents))


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked sampling probability of every document, and whether it is drawn."""
    return mixing.calibrated(read(spark, sf_dir, "documents"))


def _mixing_sql() -> str:
    parts = ["""rows AS (
  SELECT doc_id, source, lang,
    CASE WHEN contains(coalesce(text, ''), 'License') OR contains(coalesce(text, ''), 'All rights reserved') THEN 'licensed'
         WHEN contains(coalesce(text, ''), ' | ') THEN 'tabular' WHEN length(coalesce(text, '')) < 1000 THEN 'short' ELSE 'prose' END AS topic,
    CASE WHEN coalesce(length(text), 0) > 0
         THEN length(text) - length(replace(replace(text, ' ', ''), chr(10), '')) + 1 ELSE 0 END AS tokens
  FROM documents),
cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM rows GROUP BY ALL)"""]
    for margin in mixing.MARGINS:
        parts.append(f"""goal_{margin} AS (
  SELECT {margin} AS v, p / sum(p) OVER () AS share
  FROM (SELECT {margin}, CASE WHEN sum(tokens) > 0 THEN pow(sum(tokens), {mixing.TEMPER}) ELSE 0 END AS p FROM cells GROUP BY ALL))""")
    joins = " ".join(f"LEFT JOIN goal_{m} g_{m} ON c.{m} IS NOT DISTINCT FROM g_{m}.v" for m in mixing.MARGINS)
    shares = ", ".join(f"g_{m}.share AS t_{m}" for m in mixing.MARGINS)
    parts.append(f"step_0 AS MATERIALIZED (SELECT c.*, CAST(tokens AS DOUBLE) AS weight, {shares} FROM cells c {joins})")
    step = 0
    for _ in range(mixing.ROUNDS):
        for margin in mixing.MARGINS:
            held = f"sum(weight) OVER (PARTITION BY {margin})"
            parts.append(f"""step_{step + 1} AS MATERIALIZED (
  SELECT * REPLACE (CASE WHEN {held} > 0 THEN weight * t_{margin} / {held} ELSE 0 END AS weight) FROM step_{step})""")
            step += 1
    parts.append(f"chances AS (SELECT *, round(coalesce(weight / nullif(tokens, 0) / (SELECT max(weight / nullif(tokens, 0)) FROM step_{step}), 1), {mixing.DIGITS}) AS probability FROM step_{step})")
    same = " AND ".join(f"r.{m} IS NOT DISTINCT FROM c.{m}" for m in mixing.MARGINS)
    drawn = "CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) / 281474976710656.0 < probability"
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, r.source, r.lang, r.topic, r.tokens, probability, {drawn} AS sampled FROM rows r LEFT JOIN chances c ON {same}"""


ORACLE["op8_mixing"] = _mixing_sql()


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, with its places."""
    return pii.find(read(spark, sf_dir, "documents"))


@query
def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 50 bytes that an earlier document has."""
    return repeated_substrings.repeats(read(spark, sf_dir, "documents"), with_kept=False)


@query
def op11_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays of every group of equal texts."""
    return exact_duplicates.deduplicate(spark, f"{sf_dir}/documents.parquet")


ORACLE["op11_exact_duplicates"] = r"""
WITH rows AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM rows
"""


@query
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document in the hash tree of all, and whether it holds after some were tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    claimed = F.when(tampered, manifest.leaf_hash(n_chars=more)).otherwise(manifest.leaf_hash())
    return manifest.proofs(manifest.leaves(read(spark, sf_dir, "documents"), claimed))


def _manifest_sql() -> str:
    def leaf(n_chars: str) -> str:
        values = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
        return "sha256(concat(" + ", ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + "))"

    bits = "list_transform(range(8 * length(s)), lambda i: CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"
    grow = """SELECT g, lvl + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM {0} WHERE n > 1 GROUP BY g, lvl, p // 2, n"""
    steps = """SELECT l.r, {1} + t.lvl AS step, s.h AS partner, t.p % 2 AS odd FROM leaves l {2} JOIN {0} t ON {3} AND t.n > 1
  LEFT JOIN {0} s ON s.g = t.g AND s.lvl = t.lvl AND s.p = xor(t.p, 1)"""
    return f"""
WITH RECURSIVE crcs AS (SELECT *, CASE WHEN doc_id IS NOT NULL THEN {crc} END AS crc FROM (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents)),
hashed AS (SELECT doc_id, lang, {leaf('n_chars')} AS leaf, CASE WHEN crc % 7 = 0 THEN {leaf('n_chars + 1')} ELSE {leaf('n_chars')} END AS claimed FROM crcs),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
    count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) AS g
  FROM hashed),
tree(g, lvl, p, n, h) AS (SELECT g, 0, p, n, leaf FROM leaves UNION ALL {grow.format('tree')}),
tops(g, lvl, p, n, h) AS (
  SELECT 0, 0, row_number() OVER (ORDER BY g) - 1, count(*) OVER (), h FROM tree WHERE n = 1 UNION ALL {grow.format('tops')}),
steps AS (
  {steps.format('tree', 0, '', 't.g = l.g AND t.p = l.p >> t.lvl')}
  UNION ALL {steps.format('tops', 1000, '', 't.p = (l.g - 1) >> t.lvl')}),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY r ORDER BY step) AS k FROM steps),
folded(r, k, h) AS (
  SELECT r, 0, claimed FROM leaves
  UNION ALL
  SELECT f.r, f.k + 1, sha256(CASE WHEN partner IS NULL THEN h WHEN odd = 1 THEN partner || h ELSE h || partner END)
  FROM folded f JOIN numbered s ON s.r = f.r AND s.k = f.k + 1),
proofs AS (SELECT r, sha256(coalesce(string_agg(partner, '' ORDER BY k), '')) AS proof, count(*) AS depth FROM numbered GROUP BY r)
SELECT l.doc_id, l.leaf, t.h AS subroot, root.h AS root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root.h AS verified
FROM leaves l JOIN tree t ON t.g = l.g AND t.n = 1 CROSS JOIN (SELECT h FROM tops WHERE n = 1) root
LEFT JOIN proofs p ON p.r = l.r JOIN folded f ON f.r = l.r AND f.k = coalesce(depth, 0)
"""


ORACLE["op12_manifest"] = _manifest_sql()


@query
def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for every benchmark item."""
    return lexical.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


ORACLE["op13_lexical"] = f"""
WITH dt AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS t FROM documents),
dtf AS (SELECT doc_id, t, count(*) AS tf FROM dt GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM dtf GROUP BY ALL),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM sizes),
weights AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM dtf, total GROUP BY t, nd),
parts AS (
  SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nd) // l)))) AS part
  FROM dtf JOIN sizes USING (doc_id) JOIN weights USING (t), total),
it AS (SELECT DISTINCT item_id, unnest({_WORDS.format('text')}) AS t FROM benchmark),
scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM it JOIN parts USING (t) GROUP BY ALL HAVING sum(part) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= {lexical.TOP}
"""
