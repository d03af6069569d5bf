"""Postings and vectors kept for each (table, dimensions), shared by plans and by runs.

An index is found by a digest of what it is made from: the state of its table, the table's name, the dimensions, and for vectors the
encoder's name.  Each is a snapshot of its own: built aside and committed in one step, so a run that fails half-way leaves none, and a
second run with the same state builds nothing.  A changed table has another digest and is built anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from relweave.functions.vectors import Encoder, hashing_encoder
from relweave.operators import retrieval
from relweave.operators.plans import MAX_CANDIDATES, largest_limit
from relweave.sources import snapshot
from relweave.sources.catalog import union_all


class IndexStore:
    """Indexes under a folder that executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.built: list[dict] = []  # keys of what this store had to build

    def get(self, part: str, key: dict, build: Callable[[], DataFrame]) -> DataFrame:
        """The committed index of a key, built first if there is none."""
        digest = hashlib.sha256(json.dumps([part, key], sort_keys=True, ensure_ascii=False).encode()).hexdigest()
        folder = f"{self.path}/{part}/{digest}"
        try:
            return snapshot.open_snapshot(self.spark, folder, digest)[part]
        except snapshot.NoSnapshot:
            pass
        try:
            parts = snapshot.commit_snapshot(self.spark, {part: build()}, folder, digest).parts(self.spark)
            self.built.append({"part": part, **key})
        except snapshot.LostCommit:  # another run built the same in the meantime
            parts = snapshot.open_snapshot(self.spark, folder, digest)
        return parts[part]


def document_states(documents: DataFrame) -> dict[str, str]:
    """For each table a text that changes when its documents do, whatever their order: one row for each table comes back."""
    line = F.xxhash64("entity_id", F.to_json(F.struct("key_order", "normalized_dimensions")))
    rows = documents.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(line.cast("decimal(20,0)")).alias("total"), F.bit_xor(line).alias("mixed")
    )
    return {r["table_name"]: f"{r['n']} {r['total']} {r['mixed']}" for r in rows.collect()}


def _corpora(plans: list[Row], side: str, mode: str) -> dict[tuple, list[Row]]:
    """Plans by the table and dimensions of a side."""
    found: dict[tuple, list[Row]] = {}
    for plan in plans:
        if mode in plan["retrieval_modes"]:
            found.setdefault((plan[f"{side}_table"], *plan[f"{side}_dimensions"]), []).append(plan)
    return found


def _key(states: dict[str, str], corpus: tuple, **more: str) -> dict:
    table, *dimensions = corpus
    return {"state": states[table], "table": table, "dimensions": dimensions, **more}


def _texts(documents: DataFrame, plans: DataFrame, plan: Row, side: str, mode: str) -> DataFrame:
    """The texts of a corpus, taken from the first of its plans."""
    texts = retrieval.plan_texts(documents, plans.where(F.col("plan_id") == plan["plan_id"]), side)
    return texts.withColumn("retrieval_modes", F.array(F.lit(mode))).withColumn("k", F.lit(MAX_CANDIDATES))


def _of_plan(index: DataFrame, plan: Row) -> DataFrame:
    return index.withColumns({"plan_id": F.lit(plan["plan_id"]), "k": F.lit(plan["candidate_limit"])})


def stored_postings(store: IndexStore, documents: DataFrame, plans: DataFrame, states: dict[str, str]) -> DataFrame | None:
    """``retrieval.first_postings`` of all keyword plans, from one index for each corpus of targets."""
    frames = []
    for corpus, members in _corpora(plans.collect(), "target", retrieval.KEYWORD).items():
        def build(plan: Row = members[0]) -> DataFrame:
            texts = _texts(documents, plans, plan, "target", retrieval.KEYWORD)
            return retrieval.first_postings(retrieval.keyword_index(texts), MAX_CANDIDATES).select("token", "entity_id", "place")

        index = store.get("postings", _key(states, corpus), build)
        frames += [_of_plan(index, plan).where(F.col("place") <= F.col("k")) for plan in members]
    return union_all(frames) if frames else None


def stored_vectors(
    store: IndexStore, documents: DataFrame, plans: DataFrame, side: str, states: dict[str, str], make_encoder: Callable[[], Encoder], encoder: str
) -> DataFrame | None:
    """``retrieval.embed_plan_texts`` of all semantic plans, each corpus encoded once for all plans and runs."""
    frames = []
    for corpus, members in _corpora(plans.collect(), side, retrieval.SEMANTIC).items():
        def build(plan: Row = members[0]) -> DataFrame:
            texts = _texts(documents, plans, plan, side, retrieval.SEMANTIC)
            return retrieval.embed_plan_texts(texts, make_encoder).select("entity_id", "key_order", "vector")

        index = store.get("vectors", _key(states, corpus, encoder=encoder), build)
        frames += [_of_plan(index, plan) for plan in members]
    return union_all(frames) if frames else None


def candidates(
    store: IndexStore, documents: DataFrame, plans: DataFrame, states: dict[str, str], make_encoder: Callable[[], Encoder] = hashing_encoder, encoder: str = "hashing-16"
) -> DataFrame:
    """Keyword then semantic candidates of every plan, as ``discovery.candidates_for`` finds them, from stored indexes.

    ``states`` tells the state of each table's documents; the name of the encoder stands for all its settings.
    """
    sources, limit, stages = retrieval.plan_texts(documents, plans, "source"), largest_limit(plans), []
    postings = stored_postings(store, documents, plans, states)
    if postings is not None:
        stages.append(retrieval.keyword_candidates(sources, postings, limit))
    both = [stored_vectors(store, documents, plans, side, states, make_encoder, encoder) for side in ("source", "target")]
    if both[0] is not None:
        stages.append(retrieval.semantic_candidates(*both, limit))
    if not stages:
        return sources.select("plan_id", F.col("entity_id").alias("source_id"), *[F.lit(None).cast(t).alias(c) for c, t in (("target_id", "string"), ("rank", "int"), ("via", "string"))])
    return retrieval.hybrid_candidates(sources, *stages, limit=limit)
