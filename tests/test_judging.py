"""Judgement: requests, checks of answers, expansion, and the whole analysis."""

import json
import time

import pytest
from pyspark.sql import functions as F

from relweave import Catalog, EntityTable, ForeignKey
from relweave.operators import documents as docs, judging
from relweave.operators.plans import RelationshipPlan, plans_frame
from relweave.plans.discovery import analyze

PLAN = RelationshipPlan("a", "b", "r", "使用", "source_to_target", ("x",), ("y",), ("keyword",), 5, "")


def decision(target="b:1", **changes):
    base = {
        "approved": True, "source": "a:1", "target": target, "relation_type": "r", "display_label": "使用", "direction": "source_to_target", "strength": "weak",
        "confidence": 0.8, "explanation": "e", "evidence": [{"source_field": "x", "target_field": "y", "method": "llm_semantic_reasoning", "reason": "w"}],
    }
    return {**base, **changes}


def judge_once(spark, payload, status="completed"):
    plans = plans_frame(spark, [PLAN])
    plan_id = plans.first()["plan_id"]
    text = payload if isinstance(payload, str) else json.dumps(payload)
    responses = spark.createDataFrame(
        [(plan_id, "a:1", 2, ["b:1", "b:2"], status, text)],
        "plan_id string, source_id string, candidate_count int, target_ids array<string>, status string, response string",
    )
    checked = judging.check_responses(responses, plans)
    return judging.judgement_outcomes(checked).first()["status"], judging.approved_decisions(checked).collect()


GOOD = [
    ({"decisions": []}, 0), ({"decisions": [decision()]}, 1), ({"decisions": [decision(), decision()]}, 1), ({"decisions": [decision(), decision("b:2")]}, 2),
    ({"decisions": [decision(approved=False)]}, 0), ({"decisions": [decision(confidence=1)]}, 1),
]
BAD = [
    {"decisions": [decision(), decision(confidence=0.7)]}, {"decisions": [decision("b:3")]}, {"decisions": [decision(source="a:2")]}, {"decisions": [decision(relation_type="q")]},
    {"decisions": [decision(display_label="包含")]}, {"decisions": [decision(direction="undirected")]}, {"decisions": [decision(strength="strong")]},
    {"decisions": [decision(confidence=1.2)]}, {"decisions": [decision(evidence=[])]}, {"decisions": [decision(approved="true")]}, {"decisions": [decision(extra=1)]},
    {"decisions": [decision(evidence=[{"source_field": "z", "target_field": "y", "method": "llm_semantic_reasoning", "reason": "w"}])]},
    {"decisions": [decision(evidence=[{"source_field": "x", "target_field": "y", "method": "llm_semantic_reasoning", "reason": "w", "source_value": "v"}])]},
    {"decisions": [decision(evidence=[{"source_field": "x", "target_field": "y", "method": "guess", "reason": "w"}])]},
    {"decisions": [{k: v for k, v in decision().items() if k != "explanation"}]}, {"decisions": None}, {"other": []}, {"decisions": [], "other": 1}, "no json",
]


@pytest.mark.parametrize("payload, count", GOOD)
def test_good_answers(spark, payload, count):
    status, decisions = judge_once(spark, payload)
    assert status == "completed" and len(decisions) == count


def test_bad_answers_fail_their_group(spark):
    plans = plans_frame(spark, [PLAN])
    plan_id = plans.first()["plan_id"]
    rows = [(plan_id, "a:1", i, ["b:1", "b:2"], "completed", p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(BAD)]
    rows += [(plan_id, "a:1", 99, ["b:1"], "pending", None)]
    responses = spark.createDataFrame(rows, "plan_id string, source_id string, candidate_count int, target_ids array<string>, status string, response string")
    checked = judging.check_responses(responses, plans)
    status = {r["candidate_count"]: r["status"] for r in judging.judgement_outcomes(checked).collect()}
    assert status == {**{i: "failed" for i in range(len(BAD))}, 99: "pending"}
    assert judging.approved_decisions(checked).count() == 0


def business(spark):
    common = "id int, name string, class_name string, private_note string"
    requirements = spark.createDataFrame([(1, "电机需求", "Requirement", "hidden", "电机", "李明", "E-1")], common + ", title string, creator_name string, creator_employee_no string")
    operations = spark.createDataFrame(
        [(101, "编写", "Operation", None, "编写方案", "李明", "E-1"), (102, "评审", "Operation", None, "评审方案", "李明", "E-1"),
         (103, "归档", "Operation", None, "归档方案", "李明", "E-1"), (104, "领料", "Operation", None, "领取物料", "李明", "E-2")],
        common + ", action string, operator_name string, operator_employee_no string",
    )
    processes = spark.createDataFrame([(1, "装配工艺", "Process", None, "转子装配", "装配轴、铁芯与端盖")], common + ", process_name string, description string")
    parts = spark.createDataFrame(
        [(201, "轴", "Part", None, "轴", "RTR-1", "转子轴"), (202, "铁芯", "Part", None, "铁芯", "RTR-2", "转子铁芯"), (203, "端盖", "Part", None, "端盖", "RTR-3", "端盖"),
         (204, "说明书", "Part", None, "装配说明", "DOC-1", "转子装配说明")],
        common + ", part_name string, part_code string, description string",
    )
    tables = [EntityTable(n, f, ("id",), tuple(f.columns[4:])) for n, f in
              (("requirements", requirements), ("operations", operations), ("processes", processes), ("parts", parts))]
    plans = [
        RelationshipPlan("requirements", "operations", "人员行为", "人员行为", "source_to_target", ("creator_name", "creator_employee_no"),
                         ("operator_name", "operator_employee_no", "action"), ("semantic",), 4, "people"),
        RelationshipPlan("processes", "parts", "工艺涉及零件", "工艺涉及零件", "source_to_target", ("description", "process_name"), ("part_name", "part_code"), ("semantic",), 4, "parts"),
    ]
    rules = [
        judging.Rule("人员行为", 0.97, "same person", (("creator_name", "operator_name", "name"), ("creator_employee_no", "operator_employee_no", "number")),
                     equal=(("creator_name", "operator_name"), ("creator_employee_no", "operator_employee_no"))),
        judging.Rule("工艺涉及零件", 0.94, "named part", (("description", "part_name", "named"),), prefix=("part_code", "RTR-")),
    ]
    return Catalog.of(tables), plans, rules


def check_business(result):
    relations = result.edges.collect()
    assert sorted((r["source"], r["target"]) for r in relations) == sorted(
        [("requirements:1", f"operations:{i}") for i in (101, 102, 103)] + [("processes:1", f"parts:{i}") for i in (201, 202, 203)]
    )
    assert all(r["strength"] == "weak" for r in relations)
    tables = {(r["source_table"], r["target_table"]): r for r in result.table_edges.collect()}
    assert set(tables) == {("operations", "requirements"), ("parts", "processes")} and all(t["weak_count"] == 3 for t in tables.values())
    nodes = {r["id"] for r in result.entity_nodes.collect()}
    assert {"operations:104", "parts:204"} <= nodes and len(nodes) == 10
    totals = result.diagnostics.first()
    assert (totals["status"], totals["entities_read"], totals["candidates_completed"], totals["weak_edges_created"]) == ("complete", 10, 8, 6)
    assert not any("hidden" in r["search_text"] for r in result.documents.collect())


def test_business_flow_with_rules(spark):
    catalog, plans, rules = business(spark)
    check_business(analyze(catalog, plans, rules))


def make_judge():
    """A judge that travels to the workers by value."""

    def business_judge(request):
        plan, source = request["plan"], request["source"]
        decisions = []
        for candidate in request["candidates"]:
            mine, theirs = source["auxiliary_evidence"], candidate["auxiliary_evidence"]
            if plan["relation_type"] == "人员行为":
                fits = (mine["creator_name"], mine["creator_employee_no"]) == (theirs["operator_name"], theirs["operator_employee_no"])
                fields = ("creator_name", "operator_name")
            else:
                fits, fields = theirs["part_code"].startswith("RTR-"), ("description", "part_name")
            decisions.append(
                {"approved": fits, "source": source["entity_id"], "target": candidate["entity_id"], "relation_type": plan["relation_type"],
                 "display_label": plan["display_label"], "direction": plan["direction"], "strength": "weak", "confidence": 0.9, "explanation": "x",
                 "evidence": [{"source_field": fields[0], "target_field": fields[1], "method": "llm_semantic_reasoning", "reason": "y"}]}
            )
        return {"decisions": decisions}

    return business_judge


def test_business_flow_with_a_python_judge(spark):
    catalog, plans, _ = business(spark)
    result = analyze(catalog, plans, judge=make_judge(), concurrency=3)
    check_business(result)
    proof = result.edges.where("target = 'parts:201'").first()["evidence"][0]
    assert (proof["source_value"], proof["target_value"]) == ("装配轴、铁芯与端盖", "轴")


def test_failing_judge_is_isolated_and_deadline_leaves_pending(spark):
    catalog, plans, _ = business(spark)
    answer = make_judge()

    def fails_on_parts(request):
        if request["plan"]["target_table"] == "parts":
            raise RuntimeError("down")
        return answer(request)

    totals = analyze(catalog, plans, judge=fails_on_parts).diagnostics.first()
    assert (totals["status"], totals["completed_groups"], totals["failed_groups"], totals["weak_edges_created"]) == ("partial", 1, 1, 3)
    late = analyze(catalog, plans, judge=make_judge(), deadline=time.time() - 1).diagnostics.first()
    assert (late["status"], late["pending_groups"], late["candidates_pending"]) == ("partial", 2, 8)


def test_strong_pairs_are_not_judged_and_members_are_expanded(spark):
    a = spark.createDataFrame([(1, "n", "A", "Key", 1), (2, "N", "A", "KEY ", None)], "id int, name string, class_name string, x string, b_id int")
    b = spark.createDataFrame([(1, "m", "B", "key"), (2, "m", "B", "KEY"), (3, "other", "B", "key")], "id int, name string, class_name string, y string")
    catalog = Catalog.of([EntityTable("a", a, ("id",), ("x",)), EntityTable("b", b, ("id",), ("y",))], [ForeignKey("a", ("b_id",), "b", ("id",))])
    rule = judging.Rule("r", 0.8, "e", (("x", "y", "w"),))
    result = analyze(catalog, [PLAN], [rule])
    # a:1 stands for both rows of a; its candidate b:1 is a strong pair already, b:3 is judged.
    weak = {(r["source"], r["target"]): r["evidence"][0]["source_value"] for r in result.edges.where("strength = 'weak'").collect()}
    assert weak == {("a:1", "b:3"): "Key", ("a:2", "b:3"): "KEY "}


def test_groups_must_fit_their_plan(spark):
    a = spark.createDataFrame([(1, "n", "A", "v")], "id int, name string, class_name string, x string")
    b = spark.createDataFrame([(1, "n", "B", "v")], "id int, name string, class_name string, y string")
    documents = docs.build_documents(Catalog.of([EntityTable("a", a, ("id",), ("x",)), EntityTable("b", b, ("id",))]))
    plans = plans_frame(spark, [PLAN])
    candidates = plans.select("plan_id", F.lit("a:1").alias("source_id"), F.lit("b:1").alias("target_id"), F.lit(1).alias("rank"))
    pairs = judging.candidate_pairs(candidates, plans, documents)
    assert judging.validate_groups(pairs).first()["is_valid"] is False
    assert judging.ask_judge(judging.judge_requests(pairs), make_judge()).first()["status"] == "failed"
    assert judging.rule_outcomes(pairs).first()["status"] == "failed"
