"""Queries over candidate retrieval and judgement."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from relweave.functions.vectors import hashing_encoder, usable_vector, vector_norm
from relweave.operators import cell_index, documents as docs, index_store, judging, plans as planning, ranking, retrieval, vector_search
from relweave.plans import views
from relweave.session import application_folder, materialize
from relweave.plans.oracle_views import PASSAGES, norm, tokens

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def _texts(spark, sf_dir, plans=(views.PASSAGE_PLAN,)):
    """Sides of the passage plans over all documents."""
    names = sorted({t for p in plans for t in (p.source_table, p.target_table)})
    documents = docs.build_documents(views.catalog(spark, sf_dir, *names))
    rows = planning.plans_frame(spark, list(plans))
    return documents, rows, retrieval.plan_texts(documents, rows, "source"), retrieval.plan_texts(documents, rows, "target")


def _keyword(sources, targets, rows):
    """Keyword candidates and the postings they come from."""
    limit = planning.largest_limit(rows)
    postings = retrieval.first_postings(retrieval.keyword_index(targets), limit, retrieval.source_tokens(sources))
    return retrieval.keyword_candidates(sources, postings, limit), postings


_TARGET = f"SELECT doc_id AS id, unnest({tokens('doc')}) AS token FROM (SELECT doc_id, concat_ws('；', nullif({norm('text')}, ''), nullif({norm('lang')}, '')) AS doc FROM documents)"
_SOURCE = f"SELECT item_id AS id, unnest({tokens(norm('text'))}) AS token FROM benchmark"
_KEYWORD = f"""post AS (SELECT token, id, row_number() OVER (PARTITION BY token ORDER BY id) AS place FROM ({_TARGET})),
  hit AS (SELECT s.id AS sid, p.id AS tid, min(struct_pack(a := s.token, b := p.place)) AS seen FROM ({_SOURCE}) s JOIN post p ON s.token = p.token AND p.place <= 20 GROUP BY 1, 2),
  cand AS (SELECT sid, tid, rk, seen FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY seen, tid) AS rk FROM hit) WHERE rk <= 20)"""


@query("keyword_index", f"SELECT token, 'documents:' || id AS entity_id FROM ({_TARGET})")
def keyword_index(spark, sf_dir):
    _, _, _, targets = _texts(spark, sf_dir)
    return retrieval.keyword_index(targets).select("token", "entity_id")


@query("keyword_topk", f"WITH {_KEYWORD} SELECT 'benchmark:' || sid AS source_id, 'documents:' || tid AS target_id, rk AS rank FROM cand")
def keyword_topk(spark, sf_dir):
    _, rows, sources, targets = _texts(spark, sf_dir)
    return _keyword(sources, targets, rows)[0].select("source_id", "target_id", "rank")


@query(
    "embed_text",
    f"""WITH t AS (SELECT 'documents:' || doc_id AS entity_id, concat_ws('；', nullif({norm('text')}, ''), nullif({norm('lang')}, '')) AS doc FROM documents)
SELECT entity_id, 16 AS dimension, 1.0::DOUBLE AS length, min(entity_id) OVER (PARTITION BY doc) AS first_equal FROM t WHERE doc <> ''""",
)
def embed_text(spark, sf_dir):
    """Equal texts have equal vectors, different ones here have not; every vector has unit length."""
    from dataclasses import replace

    plan = replace(views.PASSAGE_PLAN, retrieval_modes=("semantic",))
    _, _, _, targets = _texts(spark, sf_dir, [plan])
    vectors = retrieval.embed_plan_texts(targets, hashing_encoder)
    shown = vectors.select(
        "entity_id", F.size("vector").alias("dimension"), F.round(vector_norm(F.col("vector")), 6).alias("length"),
        F.sha2(F.array_join(F.transform("vector", lambda x: x.cast("string")), ","), 256).alias("key"),
    )
    first = shown.groupBy("key").agg(F.min("entity_id").alias("first_equal"))
    return shown.join(first, "key").drop("key")


_COSINE = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"


def _vector_sides(spark, sf_dir, k: int):
    rows = views.read(spark, sf_dir, "embeddings")
    one = rows.where(usable_vector(F.col("embedding"))).select(
        F.lit("vectors").alias("plan_id"), "vec_id", F.col("embedding").alias("vector"), F.lit(k).alias("k"), "label"
    )
    return (
        one.withColumn("entity_id", F.concat(F.lit("query_vectors:"), "vec_id")),
        one.withColumn("entity_id", F.concat(F.lit("corpus_vectors:"), "vec_id")),
    )


@query(
    "vector_topk",
    f"""SELECT source_id, target_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY similarity DESC, target_id) AS rank FROM (
  SELECT 'query_vectors:' || q.vec_id AS source_id, 'corpus_vectors:' || c.vec_id AS target_id, round({_COSINE}, 9) AS similarity
  FROM embeddings q, embeddings c)) WHERE rank <= 10""",
)
def vector_topk(spark, sf_dir):
    sources, targets = _vector_sides(spark, sf_dir, 10)
    return retrieval.semantic_candidates(sources, targets, 10).select("source_id", "target_id", "rank")


@query(
    "approximate_topk",
    "SELECT count(*) * 10 AS wanted, 0 AS wrongly_scored, true AS recall_reached, 0.5::DOUBLE AS probed_share_below FROM embeddings",
)
def approximate_topk(spark, sf_dir):
    """The approximate search against the exact one, with cells so small that there are many.

    No similarity differs, the documented recall is reached, and the share of the cells probed is told in steps of a half.
    """
    sources, targets = (materialize(x.select("plan_id", "entity_id", "vector"), "vectors") for x in _vector_sides(spark, sf_dir, 10))
    index = cell_index.build(targets, cell_rows=16)
    unit = sources.withColumn("vector", vector_search.l2_normalize_double(F.col("vector")))
    probes = cell_index.calibrated_probes(unit, index, 10)
    asked, cells = cell_index.probed_cells(unit, index, probes), index.nodes.where("leaf")
    counts = [x.agg(F.count(F.lit(1))).scalar() for x in (asked, cells, sources)]
    share = F.ceil(2 * counts[0] / (counts[1] * counts[2])) / 2
    exact = vector_search.nearest_vectors(sources, targets, 10)
    found = cell_index.approximate_nearest(sources, index, 10, probes)
    pair = ["source_id", "target_id"]
    near = exact.select(*pair, F.col("similarity").alias("exact")).join(found.select(*pair, F.col("similarity").alias("told")), pair, "left")
    return near.agg(
        F.count(F.lit(1)).alias("wanted"), F.count_if(F.abs(F.col("told") - F.col("exact")) > 1e-9).alias("wrongly_scored"),
        (F.count("told") >= cell_index.LEAST_RECALL * F.count(F.lit(1))).alias("recall_reached"),
    ).withColumn("probed_share_below", share)


@query(
    "hybrid_topk",
    f"""WITH kw AS (SELECT q.vec_id AS sid, c.vec_id AS tid, 0 AS stage, c.place AS rk FROM embeddings q JOIN
    (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings) c ON q.label = c.label AND c.place <= 50),
  sem AS (SELECT sid, tid, 1 AS stage, rk FROM (SELECT sid, tid, row_number() OVER (PARTITION BY sid ORDER BY s DESC, 'corpus_vectors:' || tid) AS rk
    FROM (SELECT q.vec_id AS sid, c.vec_id AS tid, round({_COSINE}, 9) AS s FROM embeddings q, embeddings c)) WHERE rk <= 50),
  seen AS (SELECT sid, tid, min(struct_pack(a := stage, b := rk)) AS m FROM (SELECT * FROM kw UNION ALL SELECT * FROM sem) GROUP BY 1, 2)
SELECT 'query_vectors:' || sid AS source_id, 'corpus_vectors:' || tid AS target_id, rank, CASE WHEN m.a = 0 THEN 'keyword' ELSE 'semantic' END AS via
FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY m, 'corpus_vectors:' || tid) AS rank FROM seen) WHERE rank <= 50""",
)
def hybrid_topk(spark, sf_dir):
    return _hybrid(spark, sf_dir)[2].select("source_id", "target_id", "rank", "via")


def _hybrid(spark, sf_dir):
    documents = docs.build_documents(views.vector_catalog(spark, sf_dir))
    rows = planning.plans_frame(spark, [views.VECTOR_PLAN])
    sources, targets = retrieval.plan_texts(documents, rows, "source"), retrieval.plan_texts(documents, rows, "target")
    keyword, _ = _keyword(sources, targets, rows)
    plan = F.lit(rows.first()["plan_id"])
    left, right = (side.withColumn("plan_id", plan) for side in _vector_sides(spark, sf_dir, 50))
    semantic = retrieval.semantic_candidates(left, right, 50)
    return documents, rows, retrieval.hybrid_candidates(sources, keyword, semantic, limit=planning.largest_limit(rows))


@query(
    "retrieval_stats",
    f"""WITH {_KEYWORD} SELECT (SELECT count(*) FROM benchmark) AS groups, count(*) AS candidates, max(rk) AS peak_list, 0 AS beyond_limit FROM cand""",
)
def retrieval_stats(spark, sf_dir):
    _, rows, sources, targets = _texts(spark, sf_dir)
    found, _ = _keyword(sources, targets, rows)
    return retrieval.retrieval_stats(retrieval.hybrid_candidates(sources, found, limit=planning.largest_limit(rows)), rows).drop("plan_id")


@query(
    "postings_examined",
    f"""WITH {_KEYWORD}, stop AS (SELECT sid, seen FROM cand WHERE rk = 20)
SELECT 'benchmark:' || s.id AS source_id, count(*) AS postings_examined FROM ({_SOURCE}) s JOIN post p ON s.token = p.token AND p.place <= 20
LEFT JOIN stop ON stop.sid = s.id WHERE stop.sid IS NULL OR struct_pack(a := s.token, b := p.place) <= stop.seen GROUP BY 1""",
)
def postings_examined(spark, sf_dir):
    _, rows, sources, targets = _texts(spark, sf_dir)
    found, postings = _keyword(sources, targets, rows)
    return retrieval.postings_examined(sources, postings, found).drop("plan_id")


@query(
    "top_k_per_source",
    "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3",
)
def top_k_per_source(spark, sf_dir):
    events = views.read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return ranking.top_k(events, ["user_id"], [F.desc("value"), F.col("event_id")], 3, "rank").drop("value")


# Judgement, over representatives of the passage plan.


def found_candidates(spark, sf_dir):
    """Documents, plan, signature members, representatives and their keyword candidates."""
    catalog = views.catalog(spark, sf_dir, "benchmark", "documents")
    documents = materialize(docs.signed(docs.build_documents(catalog)), "documents")
    rows = planning.validate_plans(planning.plans_frame(spark, [views.PASSAGE_PLAN]), catalog)
    groups = docs.signature_groups(documents)
    members = docs.signature_members(documents, groups)
    leaders = docs.representatives(documents, groups)
    sources, targets = retrieval.plan_texts(leaders, rows, "source"), retrieval.plan_texts(leaders, rows, "target")
    found, _ = _keyword(sources, targets, rows)
    return documents, rows, members, leaders, found


def judged(spark, sf_dir):
    """Everything the passage plan leads to, up to expanded weak relations."""
    documents, rows, members, leaders, found = found_candidates(spark, sf_dir)
    return documents, rows, members, judging.candidate_pairs(found, rows, leaders)


@query(
    "validate_groups",
    f"""WITH {PASSAGES} SELECT 'benchmark:' || sid AS source_id, count(*) AS candidate_count, bool_and(source IS DISTINCT FROM 'src3') AS is_valid
FROM cand JOIN documents ON doc_id = tid GROUP BY 1""",
)
def validate_groups(spark, sf_dir):
    """Groups are refused when a candidate lacks a planned dimension: here the documents of one source do."""
    _, rows, _, leaders, found = found_candidates(spark, sf_dir)
    lacking = F.coalesce(F.col("display_name") == "src3", F.lit(False))
    fewer = F.when(lacking, F.map_filter("dimensions", lambda name, _: name != "lang")).otherwise(F.col("dimensions"))
    return judging.validate_groups(judging.candidate_pairs(found, rows, leaders.withColumn("dimensions", fewer))).drop("plan_id")


@query(
    "judge_requests",
    f"""WITH {PASSAGES} SELECT 'benchmark:' || sid AS source_id, count(*) AS candidate_count, string_agg('documents:' || tid, ',' ORDER BY rk) AS target_ids,
  any_value(to_json(s.text)) AS source_text, string_agg(to_json(d.text), ',' ORDER BY rk) AS target_texts
FROM cand JOIN benchmark s ON s.item_id = sid JOIN documents d ON d.doc_id = tid GROUP BY 1""",
)
def judge_requests(spark, sf_dir):
    _, _, _, pairs = judged(spark, sf_dir)
    requests = judging.judge_requests(pairs)
    evidence = "struct<text:string>"
    parsed = F.from_json(
        "request", f"struct<source:struct<auxiliary_evidence:{evidence}>,candidates:array<struct<auxiliary_evidence:{evidence}>>>"
    )
    again = {"ignoreNullFields": "false"}

    def as_json(text):
        wrapped = F.to_json(F.struct(text.alias("v")), again)
        return F.substring(wrapped, F.lit(6), F.char_length(wrapped) - 6)

    return requests.withColumn("p", parsed).select(
        "source_id", "candidate_count", F.array_join("target_ids", ",").alias("target_ids"),
        as_json(F.col("p.source.auxiliary_evidence.text")).alias("source_text"),
        F.array_join(F.transform("p.candidates.auxiliary_evidence.text", as_json), ",").alias("target_texts"),
    )


def english_judge(request: dict) -> dict:
    """Approves documents in English; contradicts itself on sources whose key ends in 7."""
    plan, source = request["plan"], request["source"]
    decisions = []
    for candidate in request["candidates"]:
        decision = {
            "approved": candidate["auxiliary_evidence"]["lang"].startswith("en"),
            "source": source["entity_id"], "target": candidate["entity_id"], "relation_type": plan["relation_type"],
            "display_label": plan["display_label"], "direction": plan["direction"], "strength": "weak", "confidence": 0.94,
            "explanation": "an English document shares wording",
            "evidence": [
                {"source_field": "text", "target_field": "lang", "method": judging.JUDGED_METHOD, "reason": "language fits"}
            ],
        }
        decisions.append(decision)
    if source["entity_id"].endswith("7"):
        decisions.append({**decisions[0], "confidence": 0.5})
    return {"decisions": decisions}


def moody_judge(request: dict) -> dict:
    """The same judge, without an answer for sources whose key ends in 5."""
    if request["source"]["entity_id"].endswith("5"):
        raise RuntimeError("no answer")
    return english_judge(request)


def answers_in_time(pairs):
    """Sources whose key ends in 3 come after the deadline."""
    requests, late = judging.judge_requests(pairs), F.col("source_id").endswith("3")
    in_time = judging.ask_judge(requests.where(~late), moody_judge)
    return in_time.union(judging.ask_judge(requests.where(late), moody_judge, deadline=0.0))


def _answers(spark, sf_dir):
    documents, rows, members, pairs = judged(spark, sf_dir)
    return documents, rows, members, answers_in_time(pairs)


_OUTCOME = "CASE WHEN ends_with(CAST(sid AS VARCHAR), '3') THEN 'pending' WHEN ends_with(CAST(sid AS VARCHAR), '5'){} THEN 'failed' ELSE 'completed' END"
#: The status of a group before and after its answer is checked: a contradiction fails it.
ANSWERED, CHECKED = _OUTCOME.format(""), _OUTCOME.format(" OR ends_with(CAST(sid AS VARCHAR), '7')")


@query(
    "judge_candidates",
    f"WITH {PASSAGES} SELECT 'benchmark:' || sid AS source_id, count(*) AS candidate_count, {ANSWERED} AS status FROM cand GROUP BY sid",
)
def judge_candidates(spark, sf_dir):
    return _answers(spark, sf_dir)[3].select("source_id", "candidate_count", "status")


_OF_PLAN = "SELECT '{0}' AS plan, 'benchmark:' || sid AS source_id, 'documents:' || tid AS target_id, rk AS rank FROM (WITH {1} SELECT * FROM cand)"


@query("stored_candidates", " UNION ALL ".join(_OF_PLAN.format(k, PASSAGES.replace("<= 20", f"<= {k}")) for k in (20, 5)))
def stored_candidates(spark, sf_dir):
    """Two plans over one corpus of targets, the second time from the stored index."""
    from dataclasses import replace

    documents = materialize(docs.signed(docs.build_documents(views.catalog(spark, sf_dir, "benchmark", "documents"))), "documents")
    leaders = docs.representatives(documents, docs.signature_groups(documents))
    plans = [replace(views.PASSAGE_PLAN, candidate_limit=k, relation_type=f"passage_{k}") for k in (20, 5)]
    rows, states = planning.plans_frame(spark, plans), index_store.document_states(leaders)
    path = f"{application_folder(spark)}/indexes-{uuid.uuid4().hex}"
    found = [index_store.candidates(index_store.IndexStore(spark, path), leaders, rows, states) for _ in range(2)][1]
    of_plan = rows.select("plan_id", F.col("candidate_limit").cast("string").alias("plan"))
    return found.where("target_id IS NOT NULL").join(of_plan, "plan_id").select("plan", "source_id", "target_id", "rank")


@query(
    "validate_judgements",
    f"""WITH {PASSAGES} SELECT 'benchmark:' || sid AS source_id, 'documents:' || tid AS target_id, 0.94::DOUBLE AS confidence FROM approved
WHERE {CHECKED} = 'completed'""",
)
def validate_judgements(spark, sf_dir):
    _, rows, _, answers = _answers(spark, sf_dir)
    return judging.approved_decisions(judging.check_responses(answers, rows)).select("source_id", "target_id", "confidence")


@query(
    "outcome_counts",
    f"""WITH {PASSAGES}, g AS (SELECT sid, count(*) AS n, {CHECKED} AS status FROM cand GROUP BY 1)
SELECT """ + ", ".join(
        f"count(*) FILTER (status = '{s}') AS {s}_groups, coalesce(sum(n) FILTER (status = '{s}'), 0) AS {s}_candidates" for s in ("completed", "failed", "pending")
    ) + " FROM g",
)
def outcome_counts(spark, sf_dir):
    from relweave.operators import graph

    _, rows, _, answers = _answers(spark, sf_dir)
    return graph.outcome_counts(judging.judgement_outcomes(judging.check_responses(answers, rows)))


@query(
    "rule_judge",
    f"WITH {PASSAGES} SELECT 'benchmark:' || sid AS source_id, 'documents:' || tid AS target_id, 'contains_passage' AS relation_type, 0.94::DOUBLE AS confidence FROM approved",
)
def rule_judge(spark, sf_dir):
    _, _, _, pairs = judged(spark, sf_dir)
    return judging.rule_decisions(pairs, views.PASSAGE_RULES).select("source_id", "target_id", "relation_type", "confidence")


@query(
    "rule_judge_equal",
    """SELECT 'query_vectors:' || q.vec_id AS source_id, 'corpus_vectors:' || c.vec_id AS target_id, 0.97::DOUBLE AS confidence FROM embeddings q JOIN
  (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings) c ON q.label = c.label AND c.place <= 50""",
)
def rule_judge_equal(spark, sf_dir):
    documents = docs.build_documents(views.vector_catalog(spark, sf_dir))
    rows = planning.plans_frame(spark, [views.VECTOR_PLAN])
    sources, targets = retrieval.plan_texts(documents, rows, "source"), retrieval.plan_texts(documents, rows, "target")
    found, _ = _keyword(sources, targets, rows)
    pairs = judging.candidate_pairs(found, rows, documents)
    return judging.rule_decisions(pairs, views.VECTOR_RULES).select("source_id", "target_id", "confidence")


_EVIDENCE = "source, target, strength, confidence, source_value, target_value"
_SHOW = ["source", "target", "strength", "confidence", "evidence.source_value[0] as source_value", "evidence.target_value[0] as target_value"]


@query(
    "hydrate_evidence",
    f"""WITH {PASSAGES} SELECT 'benchmark:' || sid AS source, 'documents:' || tid AS target, 'weak' AS strength, 0.94::DOUBLE AS confidence,
  s.text AS source_value, d.lang AS target_value FROM approved JOIN benchmark s ON s.item_id = sid JOIN documents d ON d.doc_id = tid""",
)
def hydrate_evidence(spark, sf_dir):
    documents, _, _, pairs = judged(spark, sf_dir)
    return judging.hydrate_evidence(judging.rule_decisions(pairs, views.PASSAGE_RULES), documents).selectExpr(*_SHOW)


@query("expand_representatives", f"WITH {PASSAGES} SELECT {_EVIDENCE} FROM weak")
def expand_representatives(spark, sf_dir):
    return weak_relations(spark, sf_dir).selectExpr(*_SHOW)


@query(
    "representative_decisions",
    f"""WITH {PASSAGES}, s AS (SELECT rep, count(*) AS n FROM src_sig GROUP BY 1), t AS (SELECT rep, count(*) AS n FROM tgt_sig GROUP BY 1)
SELECT 'benchmark:' || sid AS source_id, 'documents:' || tid AS target_id, s.n AS source_members, t.n AS target_members, s.n * t.n AS pair_count
FROM approved JOIN s ON s.rep = sid JOIN t ON t.rep = tid""",
)
def representative_decisions(spark, sf_dir):
    _, _, members, pairs = judged(spark, sf_dir)
    found = judging.representative_decisions(judging.rule_decisions(pairs, views.PASSAGE_RULES), members)
    return found.select("source_id", "target_id", "source_members", "target_members", "pair_count")


def weak_relations(spark, sf_dir):
    documents, _, members, pairs = judged(spark, sf_dir)
    return judging.expand_representatives(judging.rule_decisions(pairs, views.PASSAGE_RULES), members, documents)


_MATCH_SQL = """SELECT DISTINCT event_type, mod(CAST(floor(value) AS BIGINT), 3) AS m, round(value / 80, 1) AS c FROM events"""


@query(
    "validate_field_matches",
    f"""SELECT source_table, source_field, target_table, target_field, algorithm, n, CASE WHEN algorithm = 'exact_match' THEN 1.0::DOUBLE WHEN c >= 1 THEN 0.95::DOUBLE ELSE c END
  AS confidence FROM (SELECT 'events' AS source_table, 'user_id' AS source_field, CASE event_type WHEN 'click' THEN 'events' ELSE 'customer' END AS target_table,
    CASE event_type WHEN 'view' THEN 'nope' ELSE 'c_custkey' END AS target_field,
    CASE m WHEN 0 THEN 'exact_match' WHEN 1 THEN 'edit_distance' ELSE 'jaccard' END AS algorithm, c, count(*) AS n
  FROM ({_MATCH_SQL.replace('DISTINCT ', '')}) GROUP BY event_type, m, c)
WHERE source_table <> target_table AND target_field <> 'nope' AND algorithm <> 'jaccard'""",
)
def validate_field_matches(spark, sf_dir):
    """Proposals derived from the events, some of them out of scope."""
    from relweave.sources.catalog import column_catalog

    proposals = (
        views.read(spark, sf_dir, "events")
        .selectExpr("event_type", "floor(value) % 3 as m", "round(value / 80, 1) as c")
        .groupBy("event_type", "m", "c")
        .agg(F.count(F.lit(1)).alias("n"))
        .selectExpr(
            "'events' as source_table", "'user_id' as source_field", "if(event_type = 'click', 'events', 'customer') as target_table",
            "if(event_type = 'view', 'nope', 'c_custkey') as target_field",
            "case m when 0 then 'exact_match' when 1 then 'edit_distance' else 'jaccard' end as algorithm", "cast(c as string) as confidence", "n",
        )
    )
    return planning.validate_field_matches(proposals, column_catalog(views.catalog(spark, sf_dir)))
