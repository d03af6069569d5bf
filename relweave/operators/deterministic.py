"""Strong relations from declared keys, unique identifiers and relation tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from relweave.functions.identity import entity_id, key_order, pair_columns
from relweave.functions.text import normalize_value
from relweave.functions.values import as_text, is_floating, is_integral, require_comparable
from relweave.operators.relations import RELATION_COLUMNS, as_relations, evidence
from relweave.session import dealt
from relweave.sources.catalog import Catalog, ForeignKey, no_rows, union_all

# Relation types and relation-table names.
FOREIGN_KEY_TYPE = "外键关联"
DIRECTED_TYPES = {("MEProcess", "MEOperation"): "包含工序", ("MEOperation", "MEStep"): "包含工步"}
MATERIAL_CLASS = "Assembly"
MATERIAL_TYPE = "关联物料"
STRUCTURE_TYPE = "结构关联"
RELATION_TABLE_NAMES = ("bom_temp_view_data", "metargetrl", "relation_id")
RELATION_TABLE_COLUMNS = ("left_id", "right_id", "left_class", "right_class")


def _present(frame: DataFrame, columns: Sequence[str]) -> Column:
    """All key parts are values that can equal something."""
    condition = F.lit(True)
    for column in columns:
        condition = condition & F.col(column).isNotNull()
        if is_floating(frame.schema[column].dataType):
            condition = condition & ~F.isnan(column)
    return condition


PAIR_SCHEMA = "source string, target string, label string, confidence double, sequence int"


def fk_matches(catalog: Catalog, key: ForeignKey) -> DataFrame:
    """Resolved rows of one foreign key: both entity ids and the text of the key parts.

    A key on the whole primary key needs no columns of the target, only its existence, so it is a
    semi join.  Otherwise the target is reduced to one row per key first; the last row by primary
    key wins.
    """
    source, target = catalog.tables[key.source_table], catalog.tables[key.target_table]
    pairs = list(zip(key.source_columns, key.target_columns, strict=True))
    for s, t in pairs:
        require_comparable(
            source.frame.schema[s].dataType, target.frame.schema[t].dataType,
            f"{key.source_table}.{s} = {key.target_table}.{t}",
        )
    left = source.frame.where(_present(source.frame, key.source_columns)).select(
        entity_id(source.frame, key.source_table, source.primary_key).alias("source"),
        *[F.col(s).alias(f"_k{i}") for i, (s, _) in enumerate(pairs)],
        *[as_text(s, source.frame.schema[s].dataType).alias(f"_s{i}") for i, (s, _) in enumerate(pairs)],
    )
    joined = [f"_k{i}" for i in range(len(pairs))]
    keys = target.frame.where(_present(target.frame, key.target_columns))
    if _same_text(source.frame, target.frame, pairs) and set(key.target_columns) == set(target.primary_key):
        existing = keys.select(*[F.col(t).alias(f"_k{i}") for i, (_, t) in enumerate(pairs)])
        matched = left.join(existing, joined, "left_semi")
        by_target = {t: f"_k{i}" for i, (_, t) in enumerate(pairs)}
        renamed = matched.select("*", *[F.col(by_target[t]).alias(f"_pk_{t}") for t in target.primary_key])
        target_id = entity_id(renamed, key.target_table, [f"_pk_{t}" for t in target.primary_key])
        values = [F.col(f"_s{i}").alias(f"_t{i}") for i in range(len(pairs))]
        return renamed.select("source", target_id.alias("target"), *[f"_s{i}" for i in range(len(pairs))], *values)
    last = fk_target_dedupe(keys, key.target_columns, target.primary_key, key.target_table)
    last = last.select(
        *[F.col(t).alias(f"_k{i}") for i, (_, t) in enumerate(pairs)],
        *[as_text(t, target.frame.schema[t].dataType).alias(f"_t{i}") for i, (_, t) in enumerate(pairs)],
        F.col("entity_id").alias("target"),
    )
    return left.join(last, joined).drop(*joined)


def _same_text(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> bool:
    """Equal values also have equal text, so the id of the target follows from the source."""
    for s, t in pairs:
        a, b = left.schema[s].dataType, right.schema[t].dataType
        if a != b and not (is_integral(a) and is_integral(b)):
            return False
    return True


def fk_target_dedupe(frame: DataFrame, key: Sequence[str], primary_key: Sequence[str], table: str) -> DataFrame:
    """One row per key: the last one by primary key.  An aggregate, so hot keys combine map-side."""
    winner = F.max_by(entity_id(frame, table, primary_key), key_order(frame, primary_key))
    return frame.groupBy(*key).agg(winner.alias("entity_id"))


def fk_edges(catalog: Catalog, deal: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Strong relations of every foreign key with both ends in scope.

    ``deal`` moves the pairs (source, target and the values of the key) before the texts that follow from them are made.
    """
    keys = [key for key in catalog.foreign_keys if key.source_table in catalog.tables and key.target_table in catalog.tables]
    if not keys:
        return _no_relations(catalog)
    found = [fk_matches(catalog, key).withColumn("_key", F.lit(number)) for number, key in enumerate(keys)]
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more, allowMissingColumns=True)
    if deal is not None:
        pairs = deal(pairs)

    def proofs(key: ForeignKey) -> Column:
        reason = f"{key.source_table}.{{}} references {key.target_table}.{{}}"
        return F.array(*[
            evidence(s, F.col(f"_s{i}"), t, F.col(f"_t{i}"), "foreign_key", reason.format(s, t))
            for i, (s, t) in enumerate(zip(key.source_columns, key.target_columns, strict=True))
        ])

    def by_key(value: Callable[[ForeignKey], Column]) -> Column:
        return F.coalesce(*[F.when(F.col("_key") == number, value(key)) for number, key in enumerate(keys)])

    return as_relations(
        pairs,
        source_table=by_key(lambda key: F.lit(key.source_table)),
        target_table=by_key(lambda key: F.lit(key.target_table)),
        relation_type=FOREIGN_KEY_TYPE,
        explanation=by_key(lambda key: F.lit(f"{key.source_table} declares a foreign key to {key.target_table}")),
        evidence=by_key(proofs),
    )


def fk_pairs(catalog: Catalog) -> DataFrame:
    """Foreign-key pairs with their label only, the input of ``merge_labels``."""
    frames = [
        fk_matches(catalog, key).select(
            "source", "target", F.lit(FOREIGN_KEY_TYPE).alias("label"), F.lit(1.0).alias("confidence"),
            F.lit(number).alias("sequence"),
        )
        for number, key in enumerate(catalog.foreign_keys)
        if key.source_table in catalog.tables and key.target_table in catalog.tables
    ]
    return union_all(frames, no_rows(catalog, PAIR_SCHEMA))


@dataclass(frozen=True)
class FieldMatch:
    """A decision that equal values of two columns relate their rows."""

    source_table: str
    source_field: str
    target_table: str
    target_field: str
    confidence: float = 0.5


def value_equality_pairs(catalog: Catalog, matches: Sequence[FieldMatch], first_sequence: int = 1000) -> DataFrame:
    """Every pair of rows with equal non-null values, per field match.

    A value that is frequent on both sides has quadratically many pairs; all of them are the
    result.  ``value_equality_groups`` gives the same relation in linear size.
    """
    frames = []
    for number, match in enumerate(matches):
        left, right = value_sides(catalog, match)
        frames.append(
            left.join(right, "value").select(
                F.col("source_id").alias("source"),
                F.col("target_id").alias("target"),
                F.lit(f"值相等({match.source_field}↔{match.target_field})").alias("label"),
                F.lit(float(match.confidence)).alias("confidence"),
                F.lit(first_sequence + number).alias("sequence"),
            )
        )
    return union_all(frames, no_rows(catalog, PAIR_SCHEMA))


def value_equality_groups(catalog: Catalog, matches: Sequence[FieldMatch]) -> DataFrame:
    """Per field match and shared value: how many rows carry it on each side, and the pair count."""
    frames = []
    for match in matches:
        left, right = value_sides(catalog, match)
        sources = left.groupBy("value").agg(F.count(F.lit(1)).alias("source_rows"))
        targets = right.groupBy("value").agg(F.count(F.lit(1)).alias("target_rows"))
        frames.append(
            sources.join(targets, "value").select(
                F.lit(f"{match.source_table}.{match.source_field}").alias("source_field"),
                F.lit(f"{match.target_table}.{match.target_field}").alias("target_field"),
                F.col("value").cast("string").alias("value"),
                "source_rows",
                "target_rows",
                (F.col("source_rows") * F.col("target_rows")).alias("pair_count"),
            )
        )
    return union_all(frames)


def value_sides(catalog: Catalog, match: FieldMatch) -> tuple[DataFrame, DataFrame]:
    source, target = catalog.tables[match.source_table], catalog.tables[match.target_table]
    require_comparable(
        source.frame.schema[match.source_field].dataType,
        target.frame.schema[match.target_field].dataType,
        f"{match.source_table}.{match.source_field} = {match.target_table}.{match.target_field}",
    )
    sides = []
    for spec, column, name in ((source, match.source_field, "source_id"), (target, match.target_field, "target_id")):
        sides.append(
            spec.frame.where(_present(spec.frame, [column])).select(
                F.col(column).alias("value"), entity_id(spec.frame, spec.name, spec.primary_key).alias(name)
            )
        )
    return sides[0], sides[1]


def merge_labels(pairs: DataFrame) -> DataFrame:
    """One edge per unordered pair: sorted labels, highest confidence, orientation first seen."""
    low, high = pair_columns()
    # One row per pair and label first: copies of a pair combine before they travel, and the label
    # set is then no longer than the list of keys and field matches.
    first = F.min(F.struct("sequence", "source", "target"))
    per_label = pairs.groupBy(low.alias("low"), high.alias("high"), "label").agg(
        first.alias("seen"), F.max("confidence").alias("confidence")
    )
    merged = per_label.groupBy("low", "high").agg(
        F.min("seen").alias("seen"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.max("confidence").alias("confidence"),
    )
    return merged.select(F.col("seen.source").alias("source"), F.col("seen.target").alias("target"), "labels", "confidence")


@dataclass(frozen=True)
class IdentifierPlan:
    """One source and one target column whose equal values identify the same thing."""

    source_table: str
    source_dimension: str
    target_table: str
    target_dimension: str
    relation_type: str
    direction: str
    reason: str
    display_label: str = "相关"


def unique_identifier_edges(catalog: Catalog, plans: Sequence[IdentifierPlan]) -> DataFrame:
    """Strong relations between rows that alone carry a normalised identifier on either side.

    Only columns with a unique index outside the primary key take part.  Null is no value; the
    empty string is one.
    """
    frames = []
    for plan in plans:
        source, target = catalog.tables.get(plan.source_table), catalog.tables.get(plan.target_table)
        if source is None or target is None:
            continue
        if not source.has_unique_column(plan.source_dimension) or not target.has_unique_column(plan.target_dimension):
            continue
        left = _single_carriers(catalog, plan.source_table, plan.source_dimension, "source")
        right = _single_carriers(catalog, plan.target_table, plan.target_dimension, "target")
        proof = evidence(
            plan.source_dimension, F.col("source_value"), plan.target_dimension, F.col("target_value"),
            "unique_identifier", plan.reason,
        )
        frames.append(
            as_relations(
                left.join(right, "identifier"),
                source_table=plan.source_table,
                target_table=plan.target_table,
                relation_type=plan.relation_type,
                direction=plan.direction,
                explanation=plan.reason,
                evidence=F.array(proof),
            )
        )
    return union_all(frames, _no_relations(catalog))


def _single_carriers(catalog: Catalog, table: str, column: str, side: str) -> DataFrame:
    spec = catalog.tables[table]
    dtype = spec.frame.schema[column].dataType
    text = as_text(column, dtype)
    rows = spec.frame.where(F.col(column).isNotNull()).select(
        normalize_value(text, ascii_only=not isinstance(dtype, T.StringType)).alias("identifier"),
        text.alias("value"),
        entity_id(spec.frame, table, spec.primary_key).alias("id"),
    )
    single = rows.groupBy("identifier").agg(
        F.count(F.lit(1)).alias("n"), F.first("value").alias(f"{side}_value"), F.first("id").alias(side)
    )
    return single.where("n = 1").drop("n")


def _no_relations(catalog: Catalog) -> DataFrame:
    spark = next(iter(catalog.tables.values())).frame.sparkSession
    return spark.createDataFrame([], relation_schema())


def relation_schema() -> str:
    fields = "source_field string, source_value string, target_field string, target_value string, method string, reason string"
    types = {"confidence": "double", "evidence": f"array<struct<{fields.replace(' string', ':string')}>>"}
    return ", ".join(f"{c} {types.get(c, 'string')}" for c in RELATION_COLUMNS)


def find_relation_tables(
    frames: Mapping[str, DataFrame], names: Sequence[str] = RELATION_TABLE_NAMES
) -> dict[str, DataFrame]:
    """Frames with a relation-table name, whatever its case, and the four columns of one."""
    wanted = {n.lower() for n in names}
    return {
        name: frame
        for name, frame in frames.items()
        if name.lower() in wanted and set(RELATION_TABLE_COLUMNS) <= set(frame.columns)
    }


def relation_table_columns(frames: Mapping[str, DataFrame], names: Sequence[str] = RELATION_TABLE_NAMES) -> DataFrame:
    """Every frame with its row count and whether it qualifies as a relation table."""
    found = find_relation_tables(frames, names)
    return union_all(
        [
            frame.agg(F.count(F.lit(1)).alias("row_count")).select(
                F.lit(name).alias("table_name"), F.lit(name in found).alias("is_relation_table"), "row_count"
            )
            for name, frame in frames.items()
        ]
    )


def endpoint_index(documents: DataFrame) -> DataFrame:
    """(class, key text) to the only document carrying it; ambiguous keys resolve to nothing."""
    usable = documents.where("single_key is not null and class_name is not null")
    return (
        usable.groupBy("class_name", "single_key")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("entity_id").alias("entity_id"),
            F.min("table_name").alias("table_name"),
        )
        .where("n = 1")
        .drop("n")
    )


@dataclass(frozen=True)
class OrientationRules:
    """Class pairs in the order their relation runs; the reversed pair is turned round."""

    directed: Mapping[tuple[str, str], str] = None
    material_class: str = MATERIAL_CLASS
    material_type: str = MATERIAL_TYPE
    default_type: str = STRUCTURE_TYPE

    def table(self) -> Mapping[tuple[str, str], str]:
        return DIRECTED_TYPES if self.directed is None else self.directed

    def columns(self, left: Column, right: Column) -> tuple[Column, Column]:
        """Relation type, and whether left and right change places."""
        entries = [F.lit(x) for (a, b), kind in self.table().items() for x in (f"{a}\x1f{b}", kind)]
        known = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
        forward = F.try_element_at(known, F.concat_ws("\x1f", left, right))
        backward = F.try_element_at(known, F.concat_ws("\x1f", right, left))
        material = F.when((left == self.material_class) | (right == self.material_class), F.lit(self.material_type))
        kind = F.coalesce(forward, backward, material, F.lit(self.default_type))
        reversed_ = F.coalesce(
            F.when(forward.isNotNull(), False),
            F.when(backward.isNotNull(), True),
            (left == self.material_class) & (right != self.material_class),
        )
        return kind, reversed_


def relation_rows(relation_tables: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct rows of all relation tables.  Repeats collapse map-side, before any join."""
    frames = []
    for name, frame in relation_tables.items():
        columns = [as_text(c, frame.schema[c].dataType).alias(c) for c in RELATION_TABLE_COLUMNS]
        frames.append(frame.select(F.lit(name).alias("relation_table"), *columns).na.drop())
    return union_all(frames).distinct()


def _resolved(rows: DataFrame, index: DataFrame, sides: tuple[str, str]) -> DataFrame:
    """Rows whose classes and keys of both sides are known, between different tables, with entities and tables."""
    for side in sides:
        known = index.select(
            F.col("class_name").alias(f"{side}_class"),
            F.col("single_key").alias(f"{side}_id"),
            F.col("entity_id").alias(f"{side}_entity"),
            F.col("table_name").alias(f"{side}_table"),
        )
        rows = rows.join(known, [f"{side}_class", f"{side}_id"])
        rows = rows.select(*sorted(rows.columns, key=lambda c: c.endswith(("_id", "_entity"))))
    return rows.where(F.col(f"{sides[0]}_table") != F.col(f"{sides[1]}_table"))


def oriented_relation_rows(
    relation_tables: Mapping[str, DataFrame], index: DataFrame, rules: OrientationRules = OrientationRules()
) -> DataFrame:
    """Relation-table rows with both ends resolved and put in the direction of their rule."""
    resolved = _resolved(relation_rows(relation_tables), index, ("left", "right"))
    kind, reversed_ = rules.columns(F.col("left_class"), F.col("right_class"))
    oriented = resolved.withColumn("relation_type", kind).withColumn("is_reversed", reversed_)

    def pick(when_forward: str, when_reversed: str) -> Column:
        return F.when(F.col("is_reversed"), F.col(when_reversed)).otherwise(F.col(when_forward))

    return oriented.select(
        pick("left_entity", "right_entity").alias("source"),
        pick("right_entity", "left_entity").alias("target"),
        pick("left_table", "right_table").alias("source_table"),
        pick("right_table", "left_table").alias("target_table"),
        "relation_type",
        "is_reversed",
        pick("left_id", "right_id").alias("source_value"),
        pick("right_id", "left_id").alias("target_value"),
        F.concat_ws(" ", "relation_table", F.lit("records"), "left_class", F.lit("to"), "right_class").alias("reason"),
    )


def relation_dedupe(rows: DataFrame) -> DataFrame:
    """One relation per (source, target, type) with the set of its evidence.

    Rows are distinct, so a relation's evidence is no longer than twice the number of relation tables.
    """
    source_field = F.when(F.col("is_reversed"), F.lit("right_id")).otherwise(F.lit("left_id"))
    target_field = F.when(F.col("is_reversed"), F.lit("left_id")).otherwise(F.lit("right_id"))
    proof = evidence(
        source_field, F.col("source_value"), target_field, F.col("target_value"), "relation_table", F.col("reason")
    )
    merged = rows.groupBy("source", "target", "source_table", "target_table", "relation_type").agg(
        F.min("reason").alias("explanation"), F.array_sort(F.collect_set(proof)).alias("evidence")
    )
    return as_relations(merged)


def relation_table_edges(
    relation_tables: Mapping[str, DataFrame], documents: DataFrame, rules: OrientationRules = OrientationRules(),
    deal: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Strong relations recorded in relation tables between entities of different tables.

    The same as ``relation_dedupe`` of the oriented rows.  Rows are looked up and dealt by their ends with nothing but classes, keys and
    the way they were recorded; equal ones are put together there, and texts that follow from the rest are made last.  ``deal`` decides
    how they are dealt (source, target and what else there is), and may add columns that follow from the two ends.
    """
    # Which tables record a relation, and which way round, is a number until it is a set of bits.
    ways = [(name, way) for name in sorted(relation_tables) for way in (False, True)]
    rows = [
        frame.select(F.lit(ways.index((name, False))).alias("_way"), *[as_text(c, frame.schema[c].dataType).alias(c) for c in RELATION_TABLE_COLUMNS]).na.drop()
        for name, frame in relation_tables.items()
    ]
    turned = union_all(rows).withColumn("is_reversed", rules.columns(F.col("left_class"), F.col("right_class"))[1])

    def pick(when_forward: str, when_reversed: str) -> Column:
        return F.when(F.col("is_reversed"), F.col(when_reversed)).otherwise(F.col(when_forward))

    ends = [
        pick("left_class", "right_class").alias("source_class"), pick("left_id", "right_id").alias("source_id"),
        pick("right_class", "left_class").alias("target_class"), pick("right_id", "left_id").alias("target_id"),
    ]
    way = (F.col("_way") + F.col("is_reversed").cast("int")).alias("_way")
    known = documents.select("class_name", "single_key", "entity_id", "table_name")
    index = endpoint_index(dealt(known, ("class_name", "single_key"), *relation_tables.values(), joined=True))
    # What most rows share comes first, and what tells them apart last, so that rows pack well.
    found = _resolved(turned.select(ends[0], ends[2], way, ends[1], ends[3]), index, ("source", "target"))
    found = found.withColumnsRenamed({"source_entity": "source", "target_entity": "target"}).select(
        "source_class", "target_class", "source_table", "target_table", "_way", "source", "target", "source_id", "target_id"
    )
    by_ends = dealt(found, ("source", "target"), *relation_tables.values()) if deal is None else deal(found)
    seen = [F.bool_or(F.col("_way") == i).alias(f"_seen{i}") for i in range(len(ways))]
    merged = by_ends.groupBy(*[c for c in by_ends.columns if c != "_way"]).agg(*seen)

    def proof(name: str, way: bool) -> Column:
        fields, classes = (("right_id", "left_id"), ("target_class", "source_class")) if way else (("left_id", "right_id"), ("source_class", "target_class"))
        reason = F.concat_ws(" ", F.lit(name), F.lit("records"), F.col(classes[0]), F.lit("to"), F.col(classes[1]))
        return evidence(fields[0], F.col("source_id"), fields[1], F.col("target_id"), "relation_table", reason)

    proofs = [F.when(F.col(f"_seen{i}"), proof(name, way)) for i, (name, way) in enumerate(ways)]
    every = F.array_sort(F.array_compact(F.array(*proofs))) if proofs else F.array()
    return as_relations(
        merged.withColumn("evidence", every), relation_type=rules.columns(F.col("source_class"), F.col("target_class"))[0],
        explanation=F.array_min(F.transform("evidence", lambda e: e["reason"])), evidence=F.col("evidence"),
    )
