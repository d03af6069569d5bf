"""Assembly of the entity graph and its roll-up to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relweave.functions.identity import edge_id
from relweave.operators.relations import EVIDENCE_FIELDS
from relweave.session import dealt

MIN_WEAK_SUPPORT = 3

ENDS = ("edge_source", "edge_target")
RELATION_FIELDS = (
    "confidence", "direction", "display_label", "evidence", "explanation", "model_id", "relation_type", "source", "strength", "target", "task_id",
)

# Sums of confidences are exact decimals, so the average does not depend on the row order.
_EXACT = "decimal(38,15)"


def entity_nodes(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("entity_id").alias("id"),
        F.col("table_name").alias("table_id"),
        "display_name",
        F.lit("name").alias("display_name_source"),
        "display_code",
        "class_name",
        "dimensions",
    )


def table_nodes(nodes: DataFrame) -> DataFrame:
    counts = nodes.groupBy("table_id").agg(F.count(F.lit(1)).alias("entity_count"))
    return counts.select(F.col("table_id").alias("id"), F.col("table_id").alias("display_name"), "entity_count")


def relation_sort_key(relations: DataFrame) -> Column:
    """Canonical JSON of a relation, keys in order and nulls kept."""
    return _sort_key(F.struct(*RELATION_FIELDS))


def _sort_key(relation: Column) -> Column:
    proof = F.transform(relation["evidence"], lambda e: F.struct(*[e[f].alias(f) for f in sorted(EVIDENCE_FIELDS)]))
    columns = [(proof if f == "evidence" else relation[f]).alias(f) for f in RELATION_FIELDS]
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def entity_edges(edges: DataFrame) -> DataFrame:
    """One row per unordered pair with its relations in canonical order.

    Relations travel once, dealt by pair.  Equal ones are counted there before they are gathered; what is gathered is bounded
    by the keys, relation tables and plans.  The canonical text is made last, since it is several times as long as its columns.
    """
    by_pair = dealt(edges.select(*ENDS, *RELATION_FIELDS), ENDS, edges)
    counted = by_pair.groupBy(*ENDS, *RELATION_FIELDS).agg(F.count(F.lit(1)).alias("copies"))
    merged = counted.groupBy(*ENDS).agg(F.collect_list(F.struct(*RELATION_FIELDS, "copies")).alias("relations"), F.sum("copies").alias("relation_count"))
    shown = ("relation_type", "display_label", "direction", "strength", "confidence", "copies")
    in_order = F.array_sort(F.transform("relations", lambda r: F.struct(_sort_key(r).alias("sort_key"), *[r[f].alias(f) for f in shown])))
    return with_edge_id(merged.withColumn("relations", in_order)).select("edge_id", *ENDS, "relations", "relation_count")


def with_edge_id(rows: DataFrame) -> DataFrame:
    """The id of the edge between ``edge_source`` and ``edge_target``, as ``edge_relations`` gives it.  It is as long as both ends,
    so it is made anew after a shuffle instead of being moved."""
    return rows.withColumn("edge_id", edge_id("entity", F.col("edge_source"), F.col("edge_target")))


def distinct_ends(edges: DataFrame) -> DataFrame:
    """The two ends of each edge once.  Few pairs repeat, so they are dealt at once instead of being grouped before the shuffle, too."""
    return dealt(edges.select(*ENDS), ENDS, edges).distinct()


def edge_ends(edges: DataFrame) -> DataFrame:
    """Distinct edges with their two ends."""
    return with_edge_id(distinct_ends(edges)).select("edge_id", *ENDS)


def crossing_ends(edges: DataFrame) -> DataFrame:
    """The two ends of each edge between tables once for each pair of tables: table_a, table_b and the ends."""
    return dealt(edges.where("source_table <> target_table").select(*_table_pair(), *ENDS), ENDS, edges).distinct()


def _table_pair() -> list[Column]:
    return [
        F.least("source_table", "target_table").alias("table_a"),
        F.greatest("source_table", "target_table").alias("table_b"),
    ]


def table_pair_types(edges: DataFrame) -> DataFrame:
    """Counts per table pair and relation type over cross-table relations; a row without a type holds the pair's number of edges.

    Only the two ends of each edge are moved, to be counted once.
    """
    counted = crossing_ends(edges).groupBy("table_a", "table_b").agg(F.count(F.lit(1)).alias("edges"))
    nothing = [F.lit(0).cast("long").alias(c) for c in ("strong", "weak", "n")]
    of_pair = counted.select("table_a", "table_b", F.lit(None).cast("string").alias("relation_type"), *nothing, F.lit(0).cast(_EXACT).alias("confidence"), "edges")
    return relation_type_counts(edges).union(of_pair)


def relation_type_counts(edges: DataFrame) -> DataFrame:
    """The rows of ``table_pair_types`` with a type: they combine before they travel."""
    return edges.where("source_table <> target_table").groupBy(*_table_pair(), "relation_type").agg(
        F.count_if(F.col("strength") == "strong").alias("strong"),
        F.count_if(F.col("strength") == "weak").alias("weak"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("confidence").cast(_EXACT)).cast(_EXACT).alias("confidence"),
        F.lit(0).cast("long").alias("edges"),
    )


def table_edge_candidates(edges: DataFrame) -> DataFrame:
    """Every cross-table pair with its totals and whether it has enough support to be shown."""
    return rolled_up(table_pair_types(edges))


def rolled_up(types: DataFrame) -> DataFrame:
    """Table pairs from their counts by relation type; rows without a type only add edges."""
    totals = types.groupBy("table_a", "table_b").agg(
        F.array_sort(F.collect_set("relation_type")).alias("relation_types"),
        F.sum("strong").alias("strong_count"),
        F.sum("weak").alias("weak_count"),
        F.sum("edges").alias("entity_edge_count"),
        (F.sum("confidence").cast("double") / F.sum("n")).alias("mean"),
        F.max("weak").alias("best_weak"),
    )
    shown = (F.col("strong_count") > 0) | (F.col("best_weak") >= MIN_WEAK_SUPPORT)
    return totals.select(
        edge_id("table", F.col("table_a"), F.col("table_b")).alias("id"),
        F.col("table_a").alias("source_table"),
        F.col("table_b").alias("target_table"),
        "relation_types",
        "strong_count",
        "weak_count",
        "entity_edge_count",
        F.bround("mean", 12).alias("average_confidence"),
        shown.alias("is_shown"),
    )


def table_edges(edges: DataFrame) -> DataFrame:
    """Table pairs with a strong relation, or three weak ones of one type.

    The entity edges behind a table edge are ``table_edge_support``: a pair of large tables has too
    many for an array.
    """
    return table_edge_candidates(edges).where("is_shown").drop("is_shown")


def table_edge_support(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """The entity edges behind each shown table edge, one row each."""
    return with_edge_id(support_ends(edges, shown)).select("table_edge_id", "edge_id")


def support_ends(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """``table_edge_support`` with the two ends of each edge in place of its id."""
    # A row for each pair of tables, so it is no larger than the catalog allows.
    tables = F.broadcast(shown.select(F.col("source_table").alias("table_a"), F.col("target_table").alias("table_b"), F.col("id").alias("table_edge_id")))
    return crossing_ends(edges).join(tables, ["table_a", "table_b"]).select("table_edge_id", *ENDS)


def dangling_relations(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """Relations with an end that is no supplied document, with the missing ends."""
    ids = documents.select(F.col("entity_id").alias("id"))
    missing_source = relations.join(ids, relations["source"] == ids["id"], "left_anti").select(
        "source", "target", "relation_type", F.col("source").alias("missing")
    )
    missing_target = relations.join(ids, relations["target"] == ids["id"], "left_anti").select(
        "source", "target", "relation_type", F.col("target").alias("missing")
    )
    return missing_source.unionByName(missing_target)


def require_endpoints(relations: DataFrame, documents: DataFrame) -> DataFrame:
    """The relations unchanged; raises when one of them dangles."""
    dangling = dangling_relations(relations, documents).take(1)
    if dangling:
        raise ValueError(f"relationships must reference supplied entity documents: {dangling[0]['missing']}")
    return relations


def side_by_side(*totals: DataFrame) -> DataFrame:
    """One-row frames with different columns as one row: a union and an aggregate, no join."""
    rows = totals[0]
    for total in totals[1:]:
        rows = rows.unionByName(total, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Groups and candidates per judgement status, in one row."""
    columns = []
    for status in ("completed", "failed", "pending"):
        is_status = F.col("status") == status
        columns.append(F.count_if(is_status).alias(f"{status}_groups"))
        columns.append(F.coalesce(F.sum(F.when(is_status, F.col("candidate_count"))), F.lit(0)).alias(f"{status}_candidates"))
    return outcomes.agg(*columns)


def diagnostics(documents: DataFrame, plans: DataFrame, outcomes: DataFrame, relations: DataFrame) -> DataFrame:
    """Counters of a run in one row."""
    entities = documents.agg(F.count(F.lit(1)).alias("entities_read"))
    planned = plans.agg(F.count(F.lit(1)).alias("plans_created"))
    judged = outcomes.agg(
        F.coalesce(F.sum("candidate_count"), F.lit(0)).alias("candidates_retrieved"),
        F.coalesce(F.sum(F.when(F.col("status") == "completed", F.col("candidate_count"))), F.lit(0)).alias("candidates_completed"),
        F.coalesce(F.sum(F.when(F.col("status") != "completed", F.col("candidate_count"))), F.lit(0)).alias("candidates_pending"),
        F.count_if(F.col("status") == "completed").alias("completed_groups"),
        F.count_if(F.col("status") == "failed").alias("failed_groups"),
        F.count_if(F.col("status") == "pending").alias("pending_groups"),
    )
    found = relations.agg(
        F.count_if(F.col("strength") == "strong").alias("strong_edges_created"),
        F.count_if(F.col("strength") == "weak").alias("weak_edges_created"),
    )
    return side_by_side(entities, planned, judged, found)


NO_RELATIONS_WARNING = "No relationships were found after all planned candidates completed."


def run_status(
    totals: DataFrame, planner_failed: bool = False, structural_failed: bool = False, timed_out: bool = False, retrieval_failed: bool = False
) -> DataFrame:
    """Failed, partial or complete, from the one-row diagnostics."""
    empty = (F.col("strong_edges_created") + F.col("weak_edges_created")) == 0
    all_failed = (F.col("completed_groups") == 0) & (F.col("failed_groups") > 0) & (F.col("pending_groups") == 0)
    incomplete = (
        F.lit(timed_out or planner_failed or structural_failed or retrieval_failed) | (F.col("failed_groups") > 0) | (F.col("pending_groups") > 0)
    )
    status = (
        F.when(empty & (F.lit(planner_failed or structural_failed or retrieval_failed) | all_failed), F.lit("failed"))
        .when(incomplete, F.lit("partial"))
        .otherwise(F.lit("complete"))
    )
    return totals.select("*", status.alias("status")).withColumn(
        "warning", F.when((F.col("status") == "complete") & empty, F.lit(NO_RELATIONS_WARNING))
    )
