"""The whole analysis: documents, the four ways of finding relations, judgement and graph."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from relweave.functions.vectors import Encoder, hashing_encoder
from relweave.operators import deterministic, documents as docs, graph, judging, retrieval
from relweave.operators.plans import PlanError, RelationshipPlan, largest_limit, plans_frame, validate_plans
from relweave.operators.relations import edge_relations, strong_pairs, union_relations
from relweave.session import materialize
from relweave.sources.catalog import Catalog

MISSING_NAME_WARNING = "缺少业务名称字段。"
MISSING_CLASS_WARNING = "缺少对象类型信息，无法进行主要关系判断。"
BLANK_NAME_WARNING = "部分对象缺少业务名称。"

# What a step may fail with and leave the other steps' relations alone.
STEP_ERRORS = (ValueError, KeyError, PySparkException)


@dataclass
class Analysis:
    """All parts of a result, lazily defined."""

    documents: DataFrame
    relations: DataFrame
    edges: DataFrame
    entity_nodes: DataFrame
    table_nodes: DataFrame
    table_edges: DataFrame
    table_edge_support: DataFrame
    outcomes: DataFrame
    diagnostics: DataFrame
    warnings: list[str] = field(default_factory=list)

    def parts(self) -> dict[str, DataFrame]:
        spark = self.documents.sparkSession
        return {
            "table_nodes": self.table_nodes,
            "entity_nodes": self.entity_nodes,
            "table_edges": self.table_edges,
            "table_edge_support": self.table_edge_support,
            "relations": self.edges,
            "diagnostics": self.diagnostics,
            "warnings": spark.createDataFrame([(w,) for w in self.warnings], "warning string"),
        }


def candidates_for(
    representatives: DataFrame, plans: DataFrame, make_encoder: Callable[[], Encoder] = hashing_encoder
) -> DataFrame:
    """Keyword then semantic candidates of every plan."""
    sources = retrieval.plan_texts(representatives, plans, "source")
    targets = retrieval.plan_texts(representatives, plans, "target")
    limit = largest_limit(plans)
    postings = retrieval.first_postings(retrieval.keyword_index(targets), limit, retrieval.source_tokens(sources))
    stages = [retrieval.keyword_candidates(sources, postings, limit)]
    if plans.where(F.array_contains("retrieval_modes", retrieval.SEMANTIC)).take(1):
        embedded = [retrieval.embed_plan_texts(side, make_encoder) for side in (sources, targets)]
        stages.append(retrieval.semantic_candidates(*embedded, limit))
    return retrieval.hybrid_candidates(sources, *stages, limit=limit)


def analyze(
    catalog: Catalog,
    plans: Sequence[RelationshipPlan] = (),
    rules: Sequence[judging.Rule] = (),
    judge: Callable[[dict], dict] | None = None,
    relation_tables: Mapping[str, DataFrame] | None = None,
    orientation: deterministic.OrientationRules = deterministic.OrientationRules(),
    make_encoder: Callable[[], Encoder] = hashing_encoder,
    deadline: float | None = None,
    concurrency: int | None = None,
    fingerprint: str | None = None,
) -> Analysis:
    """Relations between the rows of the tables in scope, as a graph.

    With the ``fingerprint`` the catalog had when the scope was chosen, a catalog that has changed since is refused.

    Judgement uses ``judge`` when given, else ``rules``.  A plan set that must not be used, unusable relation
    tables and a failed retrieval or judgement lose their own relations only: the warnings and the status in
    the diagnostics tell.  Tables without names or classes, and documents that contradict each other, are refused.
    """
    spark = next(iter(catalog.tables.values())).frame.sparkSession
    if fingerprint is not None:
        catalog.require_fingerprint(fingerprint)
    warnings = []
    if any(t.name_column is None for t in catalog.tables.values()):
        warnings.append(MISSING_NAME_WARNING)
    if any(t.class_column is None for t in catalog.tables.values()):
        warnings.append(MISSING_CLASS_WARNING)
    if warnings:
        raise ValueError(" ".join(warnings))

    # The texts are normalised once; everything below reads the stored table.
    signed = docs.checked_documents(materialize(docs.signed(docs.build_documents(catalog)), "documents"))
    documents = signed.drop("signature")
    if documents.where("is_blank_name").take(1):
        warnings.append(BLANK_NAME_WARNING)

    usable = [p for p in plans if len(catalog.tables) > 1]
    plan_rows, failed = plans_frame(spark, usable), {"planner_failed": False, "structural_failed": False, "retrieval_failed": False}
    try:
        plan_rows = validate_plans(plan_rows, catalog) if usable else plan_rows
    except PlanError as error:
        usable, plan_rows, failed["planner_failed"] = [], plans_frame(spark, []), True
        warnings.append(str(error))

    strong = [deterministic.fk_edges(catalog)]
    try:
        if relation_tables and (found := deterministic.find_relation_tables(relation_tables)):
            strong.append(materialize(deterministic.relation_table_edges(found, documents, orientation), "structural"))
    except STEP_ERRORS as error:
        failed["structural_failed"] = True
        warnings.append(_reason(error))
    identifiers = [
        deterministic.IdentifierPlan(
            p.source_table, p.source_dimensions[0], p.target_table, p.target_dimensions[0], p.relation_type, p.direction, p.reason
        )
        for p in usable
        if len(p.source_dimensions) == 1 and len(p.target_dimensions) == 1
    ]
    strong.append(deterministic.unique_identifier_edges(catalog, identifiers))
    found = union_relations(*strong)

    outcomes = spark.createDataFrame([], "plan_id string, source_id string, candidate_count int, status string")
    if usable:
        try:
            outcomes, judged = _judged(signed, usable, plan_rows, strong_pairs(found), rules, judge, make_encoder, deadline, concurrency)
            judged = graph.require_endpoints(materialize(judged, "judged"), documents)
            found = union_relations(found, judged)
        except STEP_ERRORS as error:
            failed["retrieval_failed"] = True
            warnings.append(_reason(error))

    # The graph parts and every later question read the relations; they are found once.
    relations = materialize(found, "relations")
    edges = edge_relations(relations)
    nodes = graph.entity_nodes(documents)
    shown = graph.table_edges(edges)
    return Analysis(
        documents=documents,
        relations=relations,
        edges=edges,
        entity_nodes=nodes,
        table_nodes=graph.table_nodes(nodes),
        table_edges=shown,
        table_edge_support=graph.table_edge_support(edges, shown),
        outcomes=outcomes,
        diagnostics=graph.run_status(graph.diagnostics(documents, plan_rows, outcomes, relations), **failed),
        warnings=warnings,
    )


def _reason(error: Exception) -> str:
    return str(error).split("\n")[0][:200]


def _judged(signed, plans, plan_rows, strong, rules, judge, make_encoder, deadline, concurrency) -> tuple[DataFrame, DataFrame]:
    """Outcomes per group, and the weak relations that judgement finds."""
    planned = sorted({t for p in plans for t in (p.source_table, p.target_table)})
    in_plans = signed.where(F.col("table_name").isin(planned))
    groups = docs.signature_groups(in_plans)
    members = docs.signature_members(in_plans, groups)
    leaders = docs.representatives(in_plans, groups)
    candidates = judging.exclude_strong_pairs(candidates_for(leaders, plan_rows, make_encoder), strong)
    pairs = judging.candidate_pairs(candidates, plan_rows, leaders)
    if judge is not None:
        # The judge may be slow or costly, so its answers are kept before two steps read them.
        answers = materialize(judging.ask_judge(judging.judge_requests(pairs), judge, deadline, concurrency), "answers")
        checked = judging.check_responses(answers, plan_rows)
        outcomes, decisions = judging.judgement_outcomes(checked), judging.approved_decisions(checked)
    else:
        outcomes, decisions = judging.rule_outcomes(pairs), judging.rule_decisions(pairs, rules)
    return outcomes, judging.expand_representatives(decisions, members, in_plans)
