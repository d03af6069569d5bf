"""The long relations frame every discovery method produces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from relweave.functions.identity import edge_id, pair_columns
from relweave.functions.labels import DEFAULT_LABEL, relation_label
from relweave.sources.catalog import union_all

EVIDENCE_FIELDS = ("source_field", "source_value", "target_field", "target_value", "method", "reason")

RELATION_COLUMNS = (
    "source", "target", "source_table", "target_table", "relation_type", "display_label", "direction",
    "strength", "confidence", "explanation", "evidence", "model_id", "task_id",
)


def evidence(source_field, source_value, target_field, target_value, method: str, reason) -> Column:
    parts = dict(
        zip(EVIDENCE_FIELDS, (source_field, source_value, target_field, target_value, method, reason), strict=True)
    )
    return F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in parts.items()])


def as_relations(df: DataFrame, **columns: Column | str | float | None) -> DataFrame:
    """Bring a frame into the relation schema; missing columns take the given constants."""
    defaults = {
        "display_label": DEFAULT_LABEL, "direction": "source_to_target", "strength": "strong",
        "confidence": 1.0, "model_id": None, "task_id": None,
    }
    values = {**defaults, **columns}
    selected = []
    for name in RELATION_COLUMNS:
        if name in columns or name not in df.columns:
            value = values[name]
            value = value if isinstance(value, Column) else F.lit(value)
        else:
            value = F.col(name)
        if name == "confidence":
            value = value.cast("double")
        elif name != "evidence":
            value = value.cast("string")
        selected.append(value.alias(name))
    return df.select(*selected)


def union_relations(*frames: DataFrame) -> DataFrame:
    """UNION ALL of relations found in different ways."""
    return union_all([f.select(*RELATION_COLUMNS) for f in frames])


def strong_pairs(relations: DataFrame) -> DataFrame:
    """Distinct unordered pairs of strong relations."""
    low, high = pair_columns()
    return relations.where("strength = 'strong'").select(low.alias("low"), high.alias("high")).distinct()


def stored_form(edges: DataFrame) -> DataFrame:
    """``edge_relations`` without what follows from the two ends: the edge's id, and which of them is the source.  Ids are never null."""
    return edges.withColumn("is_turned", F.col("source") != F.col("edge_source")).drop("edge_id", "source", "target")


def from_stored_form(rows: DataFrame) -> DataFrame:
    """The columns of ``edge_relations`` from its stored form."""
    low, high = F.col("edge_source"), F.col("edge_target")
    ends = {"source": F.when(F.col("is_turned"), high).otherwise(low), "target": F.when(F.col("is_turned"), low).otherwise(high)}
    return rows.select(
        edge_id("entity", low, high).alias("edge_id"), "edge_source", "edge_target", *[value.alias(name) for name, value in ends.items()],
        *[c for c in RELATION_COLUMNS if c not in ("source", "target", "display_label")], "display_label",
    )


def edge_relations(relations: DataFrame) -> DataFrame:
    """Relations with the edge they belong to and their business label.

    This long form is the source of truth of the graph: one row per relation, whatever the number
    of relations between two entities or two tables.
    """
    low, high = pair_columns()
    return relations.select(
        edge_id("entity", low, high).alias("edge_id"),
        low.alias("edge_source"),
        high.alias("edge_target"),
        *[c for c in RELATION_COLUMNS if c != "display_label"],
        relation_label(F.col("display_label"), F.col("relation_type")).alias("display_label"),
    )
