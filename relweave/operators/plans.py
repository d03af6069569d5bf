"""Relationship plans: which tables and dimensions to compare, and how."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from relweave.functions.text import safe_label
from relweave.sources.catalog import Catalog

PLAN_LIMIT = 20
MAX_CANDIDATES = 50
DIRECTIONS = ("source_to_target", "target_to_source", "undirected")
MODES = ("keyword", "semantic")


@dataclass(frozen=True)
class RelationshipPlan:
    source_table: str
    target_table: str
    relation_type: str
    display_label: str
    direction: str
    source_dimensions: tuple[str, ...]
    target_dimensions: tuple[str, ...]
    retrieval_modes: tuple[str, ...]
    candidate_limit: int = 20
    reason: str = ""


PLAN_SCHEMA = (
    "source_table string, target_table string, relation_type string, display_label string, direction string, "
    "source_dimensions array<string>, target_dimensions array<string>, retrieval_modes array<string>, "
    "candidate_limit int, reason string"
)


class PlanError(ValueError):
    """A plan set that must not be used."""


def plans_frame(spark: SparkSession, plans: Sequence[RelationshipPlan]) -> DataFrame:
    """The plans as data; ``plan_id`` is the digest of a plan's content."""
    rows = [tuple(list(v) if isinstance(v, tuple) else v for v in asdict(p).values()) for p in plans]
    frame = spark.createDataFrame(rows, PLAN_SCHEMA)
    return frame.withColumn("plan_id", F.sha2(F.to_json(F.struct(*frame.columns)), 256).substr(1, 16))


def literal(value, kind: str) -> Column:
    """A driver value, lists included, as a constant of the plan."""
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value]).cast(kind)
    return F.lit(value).cast(kind)


def plan_constants(plans: DataFrame, **columns: str) -> dict[str, Column]:
    """The plans by id as constant structs: new field name = column.  Plans are few, and known to the driver."""
    kinds = {f.name: f.dataType.simpleString() for f in plans.schema}
    rows = {r["plan_id"]: r for r in plans.collect()}
    return {
        plan: F.struct(*[literal(row[c], kinds[c]).alias(name) for name, c in columns.items()]) for plan, row in sorted(rows.items())
    }


def with_plan(df: DataFrame, plans: DataFrame, *columns: str) -> DataFrame:
    """Rows of known plans with the plan's columns (all by default): constants in the projection, no join."""
    names = columns or tuple(c for c in plans.columns if c != "plan_id")
    constants = plan_constants(plans, **{c: c for c in names})
    if not constants:
        kinds = {f.name: f.dataType.simpleString() for f in plans.schema}
        return df.where(F.lit(False)).select("*", *[F.lit(None).cast(kinds[c]).alias(c) for c in names])
    by_id = F.create_map(*[part for plan, value in constants.items() for part in (F.lit(plan), value)])
    return df.withColumn("_plan", by_id[F.col("plan_id")]).where("_plan IS NOT NULL").select(*[f"`{c}`" for c in df.columns], "_plan.*")


def largest_limit(plans: DataFrame) -> int:
    """The largest number of candidates any of the plans wants."""
    return max((r[0] for r in plans.select("candidate_limit").collect()), default=1)


def check_plans(plans: DataFrame, catalog: Catalog) -> DataFrame:
    """Every plan with the reason to reject it, if any.  It needs metadata only."""
    spark = plans.sparkSession
    allowed = spark.createDataFrame([(t, catalog.allowed_dimensions(t)) for t in catalog.tables], "table_name string, allowed array<string>")
    source = allowed.select(F.col("table_name").alias("source_table"), F.col("allowed").alias("source_allowed"))
    target = allowed.select(F.col("table_name").alias("target_table"), F.col("allowed").alias("target_allowed"))
    known = plans.join(source, "source_table", "left").join(target, "target_table", "left")
    problem = (
        F.when(F.col("source_table") == F.col("target_table"), "same table")
        .when(F.col("source_allowed").isNull() | F.col("target_allowed").isNull(), "unknown table")
        .when((F.size("source_dimensions") == 0) | (F.size("target_dimensions") == 0), "no dimensions")
        .when(F.size(F.array_except("source_dimensions", "source_allowed")) > 0, "source dimension out of scope")
        .when(F.size(F.array_except("target_dimensions", "target_allowed")) > 0, "target dimension out of scope")
        .when(~F.col("direction").isin(*DIRECTIONS), "unknown direction")
        .when(F.size(F.array_except("retrieval_modes", F.array(*[F.lit(m) for m in MODES]))) > 0, "unknown retrieval mode")
        .when(~F.col("candidate_limit").between(1, MAX_CANDIDATES), "candidate limit out of range")
        .when(~safe_label(F.col("display_label")), "label is not a short business label")
    )
    return known.select(*plans.columns, problem.alias("problem"))


def validate_plans(plans: DataFrame, catalog: Catalog, limit: int = PLAN_LIMIT) -> DataFrame:
    """The distinct plans; raises when one is out of scope or there are more than ``limit``."""
    if limit < 1:
        raise PlanError("the plan limit must be positive")
    bad = check_plans(plans, catalog).where("problem is not null").select("problem").take(1)
    if bad:
        raise PlanError(f"a plan is outside the scope: {bad[0]['problem']}")
    distinct = plans.dropDuplicates(["plan_id"])
    if len(distinct.select("plan_id").take(limit + 1)) > limit:
        raise PlanError("more plans than allowed")
    return distinct


# Comparison methods a field match may name.
ALGORITHMS = ("edit_distance", "numeric_difference", "exact_match")


def validate_field_matches(raw: DataFrame, columns: DataFrame) -> DataFrame:
    """Usable field matches with corrected confidences, best first.

    ``raw`` has text columns source_table, source_field, target_table, target_field, algorithm and
    confidence, and may have more; ``columns`` lists table_name and column_name.
    """
    core = {"source_table", "source_field", "target_table", "target_field", "algorithm", "confidence"}
    extra = [c for c in raw.columns if c not in core]
    names = columns.select("table_name", "column_name").distinct()
    source = names.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_field"))
    target = names.select(F.col("table_name").alias("target_table"), F.col("column_name").alias("target_field"))
    number = F.col("confidence").try_cast("double")
    usable = raw.where(
        (F.col("source_table") != F.col("target_table")) & F.col("algorithm").isin(*ALGORITHMS) & number.isNotNull()
    )
    # Python's max(0.0, min(1.0, nan)) is 1.0, and so is clipping here.
    clipped = F.when(F.isnan(number), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    corrected = (
        F.when(F.col("algorithm") == "exact_match", F.lit(1.0)).when(clipped >= 1.0, F.lit(0.95)).otherwise(clipped)
    )
    return (
        usable.join(source, ["source_table", "source_field"], "left_semi")
        .join(target, ["target_table", "target_field"], "left_semi")
        .select("source_table", "source_field", "target_table", "target_field", "algorithm", corrected.alias("confidence"), *extra)
        .orderBy(F.desc("confidence"))
    )
