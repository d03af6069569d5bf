"""Indexes for (table, dimensions) shared by plans and runs."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from relweave.operators import documents as docs, index_store
from relweave.operators.plans import RelationshipPlan, plans_frame
from relweave.plans.discovery import candidates_for
from relweave.functions.vectors import hashing_encoder
from relweave.sources.catalog import Catalog, EntityTable

PLAN = RelationshipPlan("a", "b", "r", "使用", "undirected", ("x",), ("y",), ("keyword", "semantic"), 3, "why")
PLANS = [PLAN, replace(PLAN, relation_type="s", candidate_limit=2), replace(PLAN, relation_type="t", source_table="c", retrieval_modes=("semantic",))]


def documents_of(spark, changed=""):
    def table(name, column, texts):
        rows = [(i, f"{name}{i}", name, t) for i, t in enumerate(texts)]
        return EntityTable(name, spark.createDataFrame(rows, f"id int, name string, class_name string, {column} string"), ("id",), (column,))

    words = ["red-part", "blue-part", "red-axle", "", "green-wheel-part"]  # normal form has no spaces
    catalog = Catalog.of([table("a", "x", words), table("b", "y", [f"{w}-{k}{changed}" for k in range(3) for w in words]), table("c", "x", words[:3])])
    return docs.build_documents(catalog)


def rows(df):
    return sorted(map(tuple, df.select("plan_id", "source_id", "target_id", "rank", "via").collect()), key=repr)


def test_indexes_are_built_once(spark, tmp_path):
    documents, plans, path = documents_of(spark), plans_frame(spark, PLANS), str(tmp_path)
    states = index_store.document_states(documents)
    first = index_store.IndexStore(spark, path)
    found = rows(index_store.candidates(first, documents, plans, states))
    assert found == rows(candidates_for(documents, plans)) and {"keyword", "semantic"} <= {r[4] for r in found}
    # One corpus of targets for three plans, and two of sources for the vectors.
    assert sorted((k["part"], k["table"]) for k in first.built) == [("postings", "b"), ("vectors", "a"), ("vectors", "b"), ("vectors", "c")]

    def no_encoder():
        raise AssertionError("nothing is left to encode")

    def everything(store, documents, states):
        read = [index_store.stored_vectors(store, documents, plans, side, states, no_encoder, "hashing-16") for side in ("source", "target")]
        return [frame.count() for frame in (*read, index_store.stored_postings(store, documents, plans, states))]

    second = index_store.IndexStore(spark, path)
    assert min(everything(second, documents.repartition(3), states)) > 0 and second.built == []

    changed = documents_of(spark, "!")
    third, now = index_store.IndexStore(spark, path), index_store.document_states(changed)
    assert now["a"] == states["a"] and now["b"] != states["b"]
    index_store.stored_postings(third, changed, plans, now)
    with pytest.raises(Exception, match="nothing is left to encode"):  # the vectors of b are gone
        everything(third, changed, now)
    assert [k["table"] for k in third.built] == ["b"]


def test_another_encoder_has_vectors_of_its_own(spark, tmp_path):
    documents, plans = documents_of(spark), plans_frame(spark, PLANS[:1])
    states, store = index_store.document_states(documents), index_store.IndexStore(spark, str(tmp_path))
    for encoder, size in (("hashing-16", 16), ("hashing-8", 8), ("hashing-16", 16)):
        vectors = index_store.stored_vectors(store, documents, plans, "target", states, lambda n=size: hashing_encoder(n), encoder)
        assert {r[0] for r in vectors.select(F.size("vector")).distinct().collect()} == {size}
    assert [k["encoder"] for k in store.built] == ["hashing-16", "hashing-8"]


def test_a_failed_build_leaves_no_index(spark, tmp_path):
    store, key = index_store.IndexStore(spark, str(tmp_path)), {"table": "b"}
    with pytest.raises(Exception, match="lost"):
        store.get("postings", key, lambda: spark.range(3).select(F.raise_error(F.lit("lost")).cast("string").alias("token")))
    assert store.get("postings", key, lambda: spark.range(3).toDF("token")).count() == 3 and len(store.built) == 1


def test_plans_without_a_mode(spark, tmp_path):
    documents, plans = documents_of(spark), plans_frame(spark, [replace(PLAN, retrieval_modes=("keyword",))])
    store, states = index_store.IndexStore(spark, str(tmp_path)), index_store.document_states(documents)
    assert index_store.stored_vectors(store, documents, plans, "source", states, hashing_encoder, "e") is None
    assert index_store.candidates(store, documents, plans, states).where("target_id IS NOT NULL").count() > 0
    assert [k["part"] for k in store.built] == ["postings"]
