"""Judgement of candidate groups by a caller's function, and the checks around it.

The judge is either a column expression over candidate pairs (``rule_decisions``) or a Python
function over request rows (``ask_judge``).  A request holds one source and at most K candidates,
so no group grows with the data.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from relweave.functions.identity import pair_columns
from relweave.functions.values import encoded_object
from relweave.operators.plans import with_plan
from relweave.operators.relations import as_relations
from relweave.sources.catalog import union_all

# Fixed value: the evidence method of judged relations.
JUDGED_METHOD = "llm_semantic_reasoning"

# The fields of a response.
DECISION_FIELDS = (
    "approved", "source", "target", "relation_type", "display_label", "direction", "strength", "confidence",
    "explanation", "evidence",
)
PROOF_FIELDS = ("source_field", "target_field", "method", "reason")
RESPONSE_SCHEMA = (
    "struct<decisions:array<struct<approved:boolean,source:string,target:string,relation_type:string,"
    "display_label:string,direction:string,strength:string,confidence:double,explanation:string,"
    "evidence:array<struct<source_field:string,target_field:string,method:string,reason:string>>>>>"
)

DECISION_SCHEMA = (
    "plan_id string, source_id string, target_id string, source_table string, target_table string, relation_type string, "
    "display_label string, direction string, confidence double, explanation string, "
    "evidence array<struct<source_field:string,target_field:string,method:string,reason:string>>"
)

COMPLETED, FAILED, PENDING = "completed", "failed", "pending"


def exclude_strong_pairs(candidates: DataFrame, strong: DataFrame) -> DataFrame:
    """Candidates whose unordered pair has no strong relation; groups left empty disappear."""
    low, high = pair_columns("source_id", "target_id")
    keyed = candidates.where("target_id is not null").withColumns({"low": low, "high": high})
    return keyed.join(strong, ["low", "high"], "left_anti").drop("low", "high")


def _document_side(documents: DataFrame, side: str) -> DataFrame:
    return documents.select(
        F.col("entity_id").alias(f"{side}_id"),
        F.col("table_name").alias(f"{side}_in"),
        F.col("display_name").alias(f"{side}_name"),
        F.col("class_name").alias(f"{side}_class"),
        F.col("dimensions").alias(f"{side}_values"),
        F.col("typed_dimensions").alias(f"{side}_typed"),
    )


def candidate_pairs(candidates: DataFrame, plans: DataFrame, documents: DataFrame) -> DataFrame:
    """Candidates with their plan, both documents, and whether the pair fits the plan."""
    pairs = (
        candidates.where("target_id is not null")
        .select("plan_id", "source_id", "target_id", "rank")
        .transform(with_plan, plans)
        .join(_document_side(documents, "source"), "source_id")
        .join(_document_side(documents, "target"), "target_id")
    )
    return pairs.withColumn("is_valid", _fits_plan("source") & _fits_plan("target"))


def _fits_plan(side: str) -> Column:
    """The document comes from the planned table and has every planned dimension."""
    values = F.col(f"{side}_values")
    has_all = F.forall(F.col(f"{side}_dimensions"), lambda name: F.map_contains_key(values, name))
    return (F.col(f"{side}_in") == F.col(f"{side}_table")) & has_all


def validate_groups(pairs: DataFrame) -> DataFrame:
    """Per group: its size, and whether all of its pairs fit the plan."""
    return pairs.groupBy("plan_id", "source_id").agg(
        F.count(F.lit(1)).alias("candidate_count"), F.bool_and("is_valid").alias("is_valid")
    )


def _entity_json(side: str) -> Column:
    context = F.to_json(
        F.struct(F.col(f"{side}_name").alias("name"), F.col(f"{side}_class").alias("class_name")),
        {"ignoreNullFields": "false"},
    )
    head = F.to_json(F.struct(F.col(f"{side}_id").alias("entity_id")))
    return F.concat(
        F.substring(head, F.lit(1), F.char_length(head) - 1),
        F.lit(',"business_context":'),
        context,
        F.lit(',"auxiliary_evidence":'),
        encoded_object(F.col(f"{side}_typed"), F.col(f"{side}_dimensions")),
        F.lit("}"),
    )


PLAN_FIELDS = (
    "source_table", "target_table", "relation_type", "display_label", "direction", "source_dimensions",
    "target_dimensions", "retrieval_modes", "candidate_limit", "reason",
)


def judge_requests(pairs: DataFrame) -> DataFrame:
    """One request per group: plan, source and candidates in rank order, with plan dimensions only."""
    plan_json = F.to_json(F.struct(*PLAN_FIELDS))
    candidate = F.struct("rank", F.col("target_id").alias("id"), _entity_json("target").alias("entity"))
    grouped = pairs.groupBy("plan_id", "source_id").agg(
        F.first(plan_json).alias("plan_json"),
        F.first(_entity_json("source")).alias("source_json"),
        F.array_sort(F.collect_list(candidate)).alias("candidates"),
        F.bool_and("is_valid").alias("is_valid"),
    )
    request = F.concat(
        F.lit('{"plan":'), F.col("plan_json"),
        F.lit(',"source":'), F.col("source_json"),
        F.lit(',"candidates":['), F.array_join(F.col("candidates.entity"), ","), F.lit("]}"),
    )
    return grouped.select(
        "plan_id",
        "source_id",
        F.size("candidates").alias("candidate_count"),
        F.col("candidates.id").alias("target_ids"),
        "is_valid",
        request.alias("request"),
    )


def ask_judge(
    requests: DataFrame, judge: Callable[[dict], dict], deadline: float | None = None, concurrency: int | None = None
) -> DataFrame:
    """Run a Python judge over request rows; a failing group fails alone.

    ``deadline`` is a wall-clock time; groups not begun by then stay pending.  ``concurrency`` spreads
    the requests over that many tasks, for a judge that is slow per call.
    """
    if concurrency is not None:
        if concurrency < 1:
            raise ValueError("the judge needs a concurrency of at least 1")
        requests = requests.repartition(concurrency, "plan_id", "source_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            statuses, responses = [], []
            for request, is_valid in zip(batch["request"], batch["is_valid"]):
                status, response = _ask_one(judge, request, is_valid, deadline)
                statuses.append(status)
                responses.append(response)
            yield batch.drop(columns=["request", "is_valid"]).assign(status=statuses, response=responses)

    schema = "plan_id string, source_id string, candidate_count int, target_ids array<string>, status string, response string"
    return requests.mapInPandas(run, schema)


def _ask_one(judge, request: str, is_valid: bool, deadline: float | None) -> tuple[str, str | None]:
    if deadline is not None and time.time() >= deadline:
        return PENDING, None
    if not is_valid:
        return FAILED, None
    try:
        return COMPLETED, json.dumps(judge(json.loads(request)), ensure_ascii=False)
    except Exception:
        return FAILED, None


def check_responses(responses: DataFrame, plans: DataFrame) -> DataFrame:
    """Parsed responses with their final status.

    A response must have exactly the expected fields and types, stay inside its group and plan, and
    not contradict itself; otherwise the whole group fails.  The check needs only the row itself.
    """
    parsed = with_plan(responses, plans).withColumn("decisions", F.from_json("response", RESPONSE_SCHEMA)["decisions"])
    loose = F.from_json("response", "struct<decisions:array<map<string,string>>>")["decisions"]
    decision_names = F.array(*[F.lit(f) for f in DECISION_FIELDS])
    proof_names = F.array(*[F.lit(f) for f in PROOF_FIELDS])

    def exact(entry: Column, names: Column) -> Column:
        keys = F.map_keys(entry)
        return (F.size(keys) == F.size(names)) & (F.size(F.array_except(keys, names)) == 0)

    shape = (F.json_object_keys("response") == F.array(F.lit("decisions"))) & F.forall(
        loose,
        lambda d: exact(d, decision_names)
        & F.forall(F.from_json(d["evidence"], "array<map<string,string>>"), lambda e: exact(e, proof_names)),
    )
    inside = F.forall("decisions", _inside_group)
    keys = F.transform("decisions", lambda d: F.struct(d["source"], d["target"], d["relation_type"], d["direction"]))
    consistent = F.size(F.array_distinct(keys)) == F.size(F.array_distinct("decisions"))
    valid = F.coalesce(shape & inside & consistent, F.lit(False))
    return parsed.withColumn(
        "status", F.when((F.col("status") == COMPLETED) & ~valid, F.lit(FAILED)).otherwise(F.col("status"))
    )


def _inside_group(decision: Column) -> Column:
    proofs = decision["evidence"]
    checks = (
        decision["approved"].isNotNull()
        & (decision["source"] == F.col("source_id"))
        & F.array_contains("target_ids", decision["target"])
        & (decision["relation_type"] == F.col("relation_type"))
        & (decision["display_label"] == F.col("display_label"))
        & (decision["direction"] == F.col("direction"))
        & (decision["strength"] == "weak")
        & decision["confidence"].between(0, 1)
        & decision["explanation"].isNotNull()
        & (F.size(proofs) > 0)
        & F.forall(
            proofs,
            lambda e: F.array_contains("source_dimensions", e["source_field"])
            & F.array_contains("target_dimensions", e["target_field"])
            & (e["method"] == JUDGED_METHOD)
            & e["reason"].isNotNull(),
        )
    )
    return F.coalesce(checks, F.lit(False))


def judgement_outcomes(checked: DataFrame) -> DataFrame:
    return checked.select("plan_id", "source_id", "candidate_count", "status")


DECISION_COLUMNS = (
    "plan_id", "source_id", "target_id", "source_table", "target_table", "relation_type", "display_label",
    "direction", "confidence", "explanation", "evidence",
)


def approved_decisions(checked: DataFrame) -> DataFrame:
    """Approved decisions of completed groups; identical repeats count once."""
    rows = checked.where(F.col("status") == COMPLETED).select(
        "plan_id", "source_id", "source_table", "target_table", F.explode(F.array_distinct("decisions")).alias("d")
    )
    return rows.where("d.approved").select(
        "plan_id", "source_id", F.col("d.target").alias("target_id"), "source_table", "target_table",
        "d.relation_type", "d.display_label", "d.direction", "d.confidence", "d.explanation", "d.evidence",
    )


@dataclass(frozen=True)
class Rule:
    """A deterministic judge for plans of one relation type.

    ``equal`` lists (source field, target field) pairs that must be equal; ``prefix`` is a target
    field and the text it must start with.  ``proofs`` are the (source field, target field, reason)
    evidence of an approval.
    """

    relation_type: str
    confidence: float
    explanation: str
    proofs: tuple[tuple[str, str, str], ...]
    equal: tuple[tuple[str, str], ...] = ()
    prefix: tuple[str, str] | None = None

    def condition(self) -> Column:
        holds = (F.col("relation_type") == self.relation_type) & F.col("is_valid")
        for source_field, target_field in self.equal:
            holds = holds & (F.col("source_values")[source_field] == F.col("target_values")[target_field])
        if self.prefix is not None:
            holds = holds & F.startswith(F.col("target_values")[self.prefix[0]], F.lit(self.prefix[1]))
        return holds


def rule_decisions(pairs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Decisions of deterministic judges: plain filters, nothing leaves the JVM."""
    frames = []
    for rule in rules:
        proofs = F.array(
            *[
                F.struct(
                    F.lit(s).alias("source_field"), F.lit(t).alias("target_field"),
                    F.lit(JUDGED_METHOD).alias("method"), F.lit(reason).alias("reason"),
                )
                for s, t, reason in rule.proofs
            ]
        )
        frames.append(
            pairs.where(rule.condition()).select(
                "plan_id", "source_id", "target_id", "source_table", "target_table", "relation_type",
                "display_label", "direction", F.lit(rule.confidence).alias("confidence"),
                F.lit(rule.explanation).alias("explanation"), proofs.alias("evidence"),
            )
        )
    return union_all(frames, pairs.sparkSession.createDataFrame([], DECISION_SCHEMA))


def rule_outcomes(pairs: DataFrame) -> DataFrame:
    """Outcomes of deterministic judges: a group completes when it fits its plan."""
    groups = validate_groups(pairs)
    status = F.when(F.col("is_valid"), F.lit(COMPLETED)).otherwise(F.lit(FAILED))
    return groups.select("plan_id", "source_id", "candidate_count", status.alias("status"))


def hydrate_evidence(decisions: DataFrame, documents: DataFrame) -> DataFrame:
    """Decisions as weak relations; evidence values are read from the documents."""
    values = documents.select("entity_id", "dimensions")
    source = values.select(F.col("entity_id").alias("source_id"), F.col("dimensions").alias("source_values"))
    target = values.select(F.col("entity_id").alias("target_id"), F.col("dimensions").alias("target_values"))
    joined = decisions.join(source, "source_id").join(target, "target_id")
    proofs = F.transform(
        "evidence",
        lambda e: F.struct(
            e["source_field"].alias("source_field"),
            F.col("source_values")[e["source_field"]].alias("source_value"),
            e["target_field"].alias("target_field"),
            F.col("target_values")[e["target_field"]].alias("target_value"),
            e["method"].alias("method"),
            e["reason"].alias("reason"),
        ),
    )
    return as_relations(
        joined, source=F.col("source_id"), target=F.col("target_id"), strength="weak",
        confidence=F.col("confidence"), display_label=F.col("display_label"), direction=F.col("direction"),
        evidence=proofs,
    )


def representative_decisions(decisions: DataFrame, members: DataFrame) -> DataFrame:
    """Decisions between representatives with the number of documents each stands for: the linear form.

    ``expand_representatives`` gives all pairs of members instead, quadratically many for two large groups.
    """
    sizes = members.groupBy("representative_id").agg(F.count(F.lit(1)).alias("n"))
    sources = sizes.select(F.col("representative_id").alias("source_id"), F.col("n").alias("source_members"))
    targets = sizes.select(F.col("representative_id").alias("target_id"), F.col("n").alias("target_members"))
    counted = decisions.join(sources, "source_id").join(targets, "target_id")
    return counted.withColumn("pair_count", F.col("source_members") * F.col("target_members"))


def expand_representatives(decisions: DataFrame, members: DataFrame, documents: DataFrame) -> DataFrame:
    """A decision between representatives applied to all members of both signatures.

    Evidence values are read again for each member.  Decisions on anything that is no
    representative are dropped by the joins.
    """
    source = members.select(F.col("representative_id").alias("source_rep"), F.col("entity_id").alias("source_id"))
    target = members.select(F.col("representative_id").alias("target_rep"), F.col("entity_id").alias("target_id"))
    renamed = decisions.withColumnsRenamed({"source_id": "source_rep", "target_id": "target_rep"})
    expanded = renamed.join(source, "source_rep").join(target, "target_rep").drop("source_rep", "target_rep")
    return hydrate_evidence(expanded, documents)
