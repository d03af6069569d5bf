"""A whole analysis: steps that fail, documents that repeat, limits and encoders."""

import pytest
from pyspark.sql import functions as F

from relweave import Catalog, EntityTable, ForeignKey
from relweave.functions.vectors import hashing_encoder
from relweave.operators import judging, retrieval
from relweave.operators.plans import RelationshipPlan, largest_limit, plans_frame
from relweave.plans.discovery import analyze
from relweave.sources.catalog import union_all

USERS = "id int, name string, class_name string, city string"
ORDERS = "id int, name string, class_name string, user_id int, town string"


def catalog(spark, users=None, keys=True):
    users = users or [(1, "ann", "User", "rome"), (2, "bob", "User", "oslo"), (3, "cid", "User", None)]
    orders = [(1, "o1", "Order", 1, "rome"), (2, "o2", "Order", 2, "rome"), (3, "o3", "Order", None, "oslo")]
    tables = [
        EntityTable("users", spark.createDataFrame(users, USERS), ("id",), ("city",)),
        EntityTable("orders", spark.createDataFrame(orders, ORDERS), ("id",), ("town",)),
    ]
    return Catalog.of(tables, [ForeignKey("orders", ("user_id",), "users", ("id",))] if keys else [])


def plan(**changes):
    fields = dict(
        source_table="orders", target_table="users", relation_type="near", display_label="相关", direction="source_to_target",
        source_dimensions=("town",), target_dimensions=("city",), retrieval_modes=("keyword",), candidate_limit=5, reason="same place",
    )
    return RelationshipPlan(**{**fields, **changes})


RULES = [judging.Rule("near", 0.9, "same place", (("town", "city", "equal"),), equal=(("town", "city"),))]


def state(result):
    row = result.diagnostics.first()
    return row["status"], row["strong_edges_created"], row["weak_edges_created"]


def test_a_good_run_is_complete(spark):
    assert state(analyze(catalog(spark), [plan()], RULES)) == ("complete", 2, 2)


@pytest.mark.parametrize("keys, expected", [(True, ("partial", 2, 0)), (False, ("failed", 0, 0))])
def test_a_bad_plan_loses_only_its_relations(spark, keys, expected):
    result = analyze(catalog(spark, keys=keys), [plan(), plan(target_dimensions=("nothing",))], RULES)
    assert state(result) == expected and result.warnings


def test_a_failing_judge_and_no_rules(spark):
    def judge(request):
        raise RuntimeError("no answer")

    assert state(analyze(catalog(spark), [plan()], judge=judge)) == ("partial", 2, 0)
    assert state(analyze(catalog(spark, keys=False), [plan()], judge=judge)) == ("failed", 0, 0)
    assert state(analyze(catalog(spark), [plan()]))[1:] == (2, 0)


def test_a_failing_encoder_keeps_the_strong_edges(spark):
    def encoder():
        def encode(texts):
            raise RuntimeError("no model")

        return encode

    assert state(analyze(catalog(spark), [plan(retrieval_modes=("semantic",))], RULES, make_encoder=encoder)) == ("partial", 2, 0)


def test_unusable_relation_tables(spark):
    broken = {"metargetrl": spark.createDataFrame([(1,)], "left_id int").select(F.raise_error(F.lit("broken")).alias("left_id"))}
    result = analyze(catalog(spark), [plan()], RULES, relation_tables=broken)
    assert state(result)[1:] == (2, 2)


def test_repeated_documents(spark):
    same = [(1, "ann", "User", "rome"), (1, "ann", "User", "rome")]
    assert analyze(catalog(spark, same)).entity_nodes.where("table_id = 'users'").count() == 1
    with pytest.raises(ValueError, match="users:1"):
        analyze(catalog(spark, [(1, "ann", "User", "rome"), (1, "ann", "User", "oslo")]))


def test_nothing_in_scope(spark):
    lone = Catalog.of([EntityTable("users", spark.createDataFrame([(1, "a", "U", "x")], USERS), ("id",))], [ForeignKey("orders", ("u",), "users", ("id",))])
    assert state(analyze(lone)) == ("complete", 0, 0)
    with pytest.raises(IndexError):
        union_all([])


def side(spark, name, count, k, plan_id):
    return spark.range(count).select(
        F.lit(plan_id).alias("plan_id"), F.concat(F.lit(name), F.lpad(F.col("id").cast("string"), 4, "0")).alias("entity_id"),
        F.array(F.lpad(F.col("id").cast("string"), 4, "0")).alias("key_order"), F.lit(k).alias("k"),
        F.array(F.lit("keyword"), F.lit("semantic")).alias("retrieval_modes"), F.lit("word").alias("text"),
    )


def test_more_than_fifty_candidates(spark):
    rows = plans_frame(spark, [plan(candidate_limit=80)])
    limit, key = largest_limit(rows), rows.first()["plan_id"]
    sources, targets = side(spark, "s", 3, 80, key), side(spark, "t", 200, 80, key)
    postings = retrieval.first_postings(retrieval.keyword_index(targets), limit, retrieval.source_tokens(sources))
    found = retrieval.keyword_candidates(sources, postings, limit)
    vectors = [x.withColumn("vector", F.array(F.lit(1.0), F.lit(2.0))) for x in (sources, targets)]
    near = retrieval.semantic_candidates(*vectors)
    for frame in (found, near, retrieval.hybrid_candidates(sources, found, near, limit=limit)):
        assert {(r["source_id"], r["count"]) for r in frame.groupBy("source_id").count().collect()} == {(f"s000{i}", 80) for i in range(3)}


def test_each_text_is_encoded_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def encoder():
        plain = hashing_encoder(8)

        def encode(texts):
            calls.add(len(texts))
            return plain(texts)

        return encode

    sources, targets = side(spark, "s", 40, 3, "p"), side(spark, "t", 60, 3, "p")
    sources = sources.withColumn("text", F.concat(F.lit("text"), F.substring("entity_id", 5, 1)))
    targets = targets.withColumn("text", F.when(F.col("entity_id") != "t0000", F.concat(F.lit("word"), F.substring("entity_id", 4, 1))).otherwise(""))
    embedded = [retrieval.embed_plan_texts(x, encoder) for x in (sources, targets)]
    assert retrieval.semantic_candidates(*embedded).count() == 120
    assert calls.value <= 10 + 6


def test_vectors_of_other_lengths_are_skipped(spark):
    schema = "plan_id string, entity_id string, k int, vector array<double>"
    targets = spark.createDataFrame([("p", "t1", 2, [1.0, 0.0]), ("p", "t2", 2, [0.0, 1.0]), ("p", "t3", 2, [1.0, 1.0, 1.0]), ("q", "t4", 2, [1.0])], schema)
    sources = spark.createDataFrame([("p", "s1", 2, [1.0, 0.1]), ("p", "s2", 2, [1.0]), ("q", "s3", 2, [2.0]), ("r", "s4", 2, [1.0])], schema)
    found = {(r["source_id"], r["target_id"]) for r in retrieval.semantic_candidates(sources, targets).collect()}
    assert found == {("s1", "t1"), ("s1", "t2"), ("s3", "t4")}


def test_plans_meet_documents_without_a_join(spark):
    from relweave.operators import documents as docs

    rows = plans_frame(spark, [plan(), plan(relation_type="other")])
    documents = docs.build_documents(catalog(spark))
    texts = retrieval.plan_texts(documents, rows, "source")
    assert texts.count() == 6
    assert "Join" not in texts._jdf.queryExecution().toString() and "Exchange" not in texts._jdf.queryExecution().toString()


def test_a_catalog_that_changed_is_refused(spark):
    from relweave.plans.discovery import analyze
    from relweave.sources.catalog import Catalog, EntityTable

    rows = spark.createDataFrame([(1, "n", "A")], "id int, name string, class_name string")
    catalog = Catalog.of([EntityTable("a", rows, ("id",))])
    assert analyze(catalog, fingerprint=catalog.fingerprint()).documents.count() == 1
    with pytest.raises(ValueError, match="changed"):
        analyze(catalog, fingerprint="sha256:0")
