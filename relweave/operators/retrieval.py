"""Candidate retrieval: keyword postings, embedded dimension text, and their merge.

The reference point for "first" is the primary-key order of the target table, because a frame has
no row order of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from relweave.functions.text import dimension_text, keyword_tokens
from relweave.functions.vectors import Encoder, embed_text, usable_vector
from relweave.operators.plans import plan_constants, with_plan
from relweave.operators.ranking import top_k
from relweave.operators.vector_search import nearest_vectors
from relweave.session import materialize
from relweave.sources.catalog import union_all

KEYWORD, SEMANTIC = "keyword", "semantic"


def plan_texts(documents: DataFrame, plans: DataFrame, side: str) -> DataFrame:
    """The dimension text of every document on one side of every plan.

    The plans are constants of the projection: a document meets the plans of its table without a join.
    """
    constants = plan_constants(
        plans, plan_id="plan_id", table=f"{side}_table", dims=f"{side}_dimensions", k="candidate_limit", retrieval_modes="retrieval_modes"
    )
    tables = {r["plan_id"]: r[f"{side}_table"] for r in plans.select("plan_id", f"{side}_table").collect()}
    by_table: dict[str, list] = {}
    for plan, value in constants.items():
        by_table.setdefault(tables[plan], []).append(value)
    if not by_table:
        return documents.where(F.lit(False)).select(
            F.lit("").alias("plan_id"), "entity_id", "key_order", F.lit(0).alias("k"),
            F.array().cast("array<string>").alias("retrieval_modes"), F.lit("").alias("text"),
        )
    known = F.create_map(*[part for table, values in by_table.items() for part in (F.lit(table), F.array(*values))])
    wanted = documents.where(F.col("table_name").isin(*by_table)).withColumn("_plan", F.explode(known[F.col("table_name")]))
    return wanted.select(
        "_plan.plan_id", "entity_id", "key_order", "_plan.k", "_plan.retrieval_modes",
        dimension_text(F.col("normalized_dimensions"), F.col("_plan.dims")).alias("text"),
    )


def keyword_index(texts: DataFrame) -> DataFrame:
    """Inverted index in long form: one row per plan, token and target, with the target's position.

    Sorting a token's rows by ``key_order`` gives its posting list; a frequent token is never
    gathered in one place.
    """
    return texts.where(F.array_contains("retrieval_modes", KEYWORD)).select(
        "plan_id", F.explode(keyword_tokens(F.col("text"))).alias("token"), "entity_id", "key_order", "k"
    )


def _limit(frame: DataFrame) -> int:
    return frame.agg(F.max("k")).first()[0] or 1


def source_tokens(sources: DataFrame) -> DataFrame:
    """The distinct tokens of each plan's sources."""
    tokens = sources.where(F.array_contains("retrieval_modes", KEYWORD)).select("plan_id", F.explode(keyword_tokens(F.col("text"))).alias("token"))
    return tokens.distinct()


def first_postings(index: DataFrame, limit: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """The first K postings of each token with their place in the list, stored as the index to search.

    ``limit`` is the largest K of the plans, read from the index if not given; ``wanted`` (plan_id, token)
    leaves out tokens nobody asks for before anything is ranked.
    """
    if wanted is not None:
        index = index.join(wanted, ["plan_id", "token"], "left_semi")
    most = limit or _limit(index)
    ranked = top_k(index, ["plan_id", "token"], [F.col("key_order"), F.col("entity_id")], most, "place")
    return materialize(ranked.where(F.col("place") <= F.col("k")).drop("key_order"), "postings")


def keyword_candidates(sources: DataFrame, postings: DataFrame, limit: int | None = None) -> DataFrame:
    """Up to K targets per source, visiting the source's tokens in order.

    Tokens after the first one with a full posting list can add nothing, because that list alone
    fills the K places; they are dropped before the join with the postings.
    """
    tokens = sources.where(F.array_contains("retrieval_modes", KEYWORD)).select(
        "plan_id", F.col("entity_id").alias("source_id"), "k", F.explode(keyword_tokens(F.col("text"))).alias("token")
    )
    full = postings.where(F.col("place") == F.col("k")).select("plan_id", "token", F.lit(True).alias("is_full"))
    # A source's tokens are no more than its text holds.
    stop = F.min(F.when(F.col("is_full"), F.col("token"))).over(Window.partitionBy("plan_id", "source_id"))
    needed = (
        tokens.join(full, ["plan_id", "token"], "left")
        .withColumn("stop", stop)
        .where(F.col("stop").isNull() | (F.col("token") <= F.col("stop")))
    )
    hits = needed.join(
        postings.select("plan_id", "token", "place", F.col("entity_id").alias("target_id")), ["plan_id", "token"]
    )
    first = hits.groupBy("plan_id", "source_id", "target_id").agg(
        F.min(F.struct("token", "place")).alias("seen"), F.first("k").alias("k")
    )
    ranked = top_k(first, ["plan_id", "source_id"], [F.col("seen"), F.col("target_id")], limit or _limit(sources), "rank")
    return ranked.where(F.col("rank") <= F.col("k")).select(
        "plan_id", "source_id", "target_id", "rank", F.lit(KEYWORD).alias("via")
    )


def embed_plan_texts(
    texts: DataFrame, make_encoder: Callable[[], Encoder], batch_size: int = 256
) -> DataFrame:
    """Unit vectors of the non-empty texts of semantic plans."""
    wanted = texts.where(F.array_contains("retrieval_modes", SEMANTIC) & (F.col("text") != "")).select(
        "plan_id", "entity_id", "key_order", "k", "text", F.sha2("text", 256).alias("digest")
    )
    # An encoder may be slow: each distinct text is encoded once, and the vectors are stored before anything reads them.
    distinct = wanted.groupBy("digest").agg(F.min("text").alias("text"))
    vectors = materialize(distinct.select("digest", embed_text(F.col("text"), make_encoder, batch_size).alias("vector")), "vectors")
    return wanted.drop("text").join(vectors, "digest").drop("digest")


def _comparable(vectors: DataFrame, dimensions: dict[str, int] | None = None) -> DataFrame:
    usable = vectors.where(usable_vector(F.col("vector"))).select("plan_id", "entity_id", "vector")
    if dimensions is None:
        return usable
    if not dimensions:
        return usable.where(F.lit(False))
    wanted = F.create_map(*[F.lit(part) for pair in dimensions.items() for part in pair])
    return usable.where(F.size("vector") == wanted[F.col("plan_id")])


def plan_dimensions(targets: DataFrame) -> dict[str, int]:
    """The usual vector length of each plan's targets: the most frequent one, the smaller of equally frequent ones."""
    lengths = targets.groupBy("plan_id", F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()
    best: dict[str, tuple[int, int]] = {}
    for row in lengths:
        best[row["plan_id"]] = max(best.get(row["plan_id"], (0, 0)), (row["rows"], -row["n"]))
    return {plan: -length for plan, (_, length) in best.items()}


def semantic_candidates(sources: DataFrame, targets: DataFrame, k: int | None = None) -> DataFrame:
    """Nearest targets by cosine per source and plan.

    Both frames have plan_id, entity_id, k and vector.  Vectors that cannot be compared are skipped, and so are those of
    another length than the plan's targets have.
    """
    right = materialize(_comparable(targets), "target-vectors")
    dimensions = plan_dimensions(right)
    left = materialize(_comparable(sources, dimensions), "source-vectors")
    near = nearest_vectors(left, _comparable(right, dimensions), k or _limit(sources))
    limits = sources.select("plan_id", F.col("entity_id").alias("source_id"), "k")
    return (
        near.join(limits, ["plan_id", "source_id"])
        .where(F.col("rank") <= F.col("k"))
        .select("plan_id", "source_id", "target_id", "rank", F.lit(SEMANTIC).alias("via"))
    )


def hybrid_candidates(sources: DataFrame, *stages: DataFrame, limit: int | None = None) -> DataFrame:
    """Keyword candidates first, semantic ones after them, distinct, K per source.

    A source without candidates keeps one row with a null target, so its group exists.
    """
    staged = union_all([s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)])
    first = staged.groupBy("plan_id", "source_id", "target_id").agg(
        F.min(F.struct("stage", "rank", "via")).alias("seen")
    )
    groups = sources.select("plan_id", F.col("entity_id").alias("source_id"), "k")
    ranked = (
        top_k(first, ["plan_id", "source_id"], [F.col("seen"), F.col("target_id")], limit or _limit(sources), "place")
        .join(groups, ["plan_id", "source_id"])
        .where(F.col("place") <= F.col("k"))
        .select("plan_id", "source_id", "target_id", F.col("place").alias("rank"), F.col("seen.via").alias("via"))
    )
    return groups.select("plan_id", "source_id").join(ranked, ["plan_id", "source_id"], "left")


def retrieval_stats(candidates: DataFrame, plans: DataFrame) -> DataFrame:
    """Per plan: sources, candidates, the longest list and rows beyond K (zero by construction)."""
    per_source = candidates.groupBy("plan_id", "source_id").agg(F.count("target_id").alias("n"))
    return (
        with_plan(per_source, plans, "candidate_limit")
        .groupBy("plan_id")
        .agg(
            F.count(F.lit(1)).alias("groups"),
            F.sum("n").alias("candidates"),
            F.max("n").alias("peak_list"),
            F.sum(F.greatest(F.col("n") - F.col("candidate_limit"), F.lit(0))).alias("beyond_limit"),
        )
    )


def postings_examined(sources: DataFrame, postings: DataFrame, candidates: DataFrame) -> DataFrame:
    """How many postings each source visits until its list is full or its tokens run out.

    A list that fills up stops at the posting of its last candidate; any other visits everything.
    """
    tokens = sources.where(F.array_contains("retrieval_modes", KEYWORD)).select(
        "plan_id", F.col("entity_id").alias("source_id"), "k", F.explode(keyword_tokens(F.col("text"))).alias("token")
    )
    lengths = postings.groupBy("plan_id", "token").agg(F.max("place").alias("length"))
    last = (
        candidates.where(F.col("via") == KEYWORD)
        .join(tokens.select("plan_id", "source_id", "k", "token"), ["plan_id", "source_id"])
        .where(F.col("rank") == F.col("k"))
        .join(
            postings.select("plan_id", "token", "place", F.col("entity_id").alias("target_id")),
            ["plan_id", "token", "target_id"],
        )
        .groupBy("plan_id", "source_id")
        .agg(F.min(F.struct("token", "place")).alias("last"))
    )
    visited = tokens.join(lengths, ["plan_id", "token"]).join(last, ["plan_id", "source_id"], "left")
    steps = (
        F.when(F.col("last").isNull() | (F.col("token") < F.col("last.token")), F.col("length"))
        .when(F.col("token") == F.col("last.token"), F.col("last.place"))
        .otherwise(F.lit(0))
    )
    return visited.groupBy("plan_id", "source_id").agg(F.sum(steps).alias("postings_examined"))
