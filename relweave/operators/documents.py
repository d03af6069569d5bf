"""Entity documents and their signature groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from relweave.functions.identity import entity_id, key_order
from relweave.functions.labels import UNNAMED
from relweave.functions.text import normalize_value, strip_to_null
from relweave.functions.values import as_text, typed_json
from relweave.sources.catalog import Catalog, EntityTable, union_all


def _map(entries: list[tuple[str, Column]]) -> Column:
    if not entries:
        return F.create_map().cast("map<string,string>")
    return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in entries]), F.array(*[v for _, v in entries]))


def _normalized(spec: EntityTable, column: str) -> Column:
    dtype = spec.frame.schema[column].dataType
    return normalize_value(as_text(column, dtype), ascii_only=not isinstance(dtype, T.StringType))


def display_name(spec: EntityTable, dimensions: list[str], fallback_id: Column) -> Column:
    """The stripped name; without a name column, the first dimension with text, else the id."""
    schema = spec.frame.schema
    if spec.name_column is not None:
        shown = strip_to_null(as_text(spec.name_column, schema[spec.name_column].dataType))
        return F.coalesce(shown, F.lit(UNNAMED))
    first = [F.when(_normalized(spec, c) != "", as_text(c, schema[c].dataType)) for c in dimensions]
    return F.coalesce(*first, fallback_id)


def display_code(spec: EntityTable) -> Column:
    """First non-blank business code, best column first."""
    schema = spec.frame.schema
    codes = [strip_to_null(as_text(c, schema[c].dataType)) for c in spec.code_columns]
    return F.coalesce(*codes) if codes else F.lit(None).cast("string")


def class_name(spec: EntityTable) -> Column:
    column = spec.class_column
    if column is None:
        return F.lit(None).cast("string")
    return strip_to_null(as_text(column, spec.frame.schema[column].dataType))


def legacy_class_name(df: DataFrame) -> Column:
    """Class by the fixed column order class_name, className, class; kept as it is."""
    present = [F.col(c).cast("string") for c in ("class_name", "className", "class") if c in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def table_documents(catalog: Catalog, table: str, dimensions: list[str] | None = None) -> DataFrame:
    """One document per row of a table."""
    spec = catalog.tables[table]
    frame = catalog.scan(table)
    schema = frame.schema
    dims = catalog.auxiliary_dimensions(table) if dimensions is None else dimensions
    texts = [(c, as_text(c, schema[c].dataType)) for c in dims]
    own_id = entity_id(frame, table, spec.primary_key)
    shown = display_name(spec, dims, own_id)
    class_text = class_name(spec)
    evidence = [F.concat(F.lit(f"{c}："), F.coalesce(t, F.lit("None"))) for c, t in texts]
    single = spec.primary_key[0] if len(spec.primary_key) == 1 else None
    blank = F.lit(False) if spec.name_column is None else strip_to_null(
        as_text(spec.name_column, schema[spec.name_column].dataType)
    ).isNull()
    return frame.select(
        own_id.alias("entity_id"),
        F.lit(table).alias("table_name"),
        key_order(frame, spec.primary_key).alias("key_order"),
        (as_text(single, schema[single].dataType) if single else F.lit(None).cast("string")).alias("single_key"),
        shown.alias("display_name"),
        display_code(spec).alias("display_code"),
        class_text.alias("class_name"),
        _map(texts).alias("dimensions"),
        _map([(c, typed_json(c, schema[c].dataType)) for c in dims]).alias("typed_dimensions"),
        _map([(c, _normalized(spec, c)) for c in dims]).alias("normalized_dimensions"),
        F.concat_ws("；", shown, F.coalesce(class_text, F.lit("")), *evidence).alias("search_text"),
        blank.alias("is_blank_name"),
    )


def build_documents(catalog: Catalog, tables: list[str] | None = None) -> DataFrame:
    """The documents of every table in scope, or of some; unused columns are pruned down to the scan."""
    return union_all([table_documents(catalog, table) for table in tables or catalog.tables])


def quality_flags(catalog: Catalog) -> DataFrame:
    """Per table with rows: missing roles, and whether any row lacks a business name."""
    frames = []
    for table, spec in catalog.tables.items():
        blank = F.lit(None).cast("boolean")
        if spec.name_column is not None:
            blank = strip_to_null(as_text(spec.name_column, spec.frame.schema[spec.name_column].dataType)).isNull()
        frames.append(
            spec.frame.select(
                F.lit(table).alias("table_name"),
                F.lit(spec.name_column is None).alias("missing_name_column"),
                F.lit(spec.class_column is None).alias("missing_class_column"),
                blank.alias("is_blank"),
            )
        )
    return union_all(frames).groupBy("table_name", "missing_name_column", "missing_class_column").agg(
        F.bool_or("is_blank").alias("has_blank_name"), F.count(F.lit(1)).alias("row_count")
    )


def signature(documents: DataFrame) -> Column:
    """Digest of table, normalised name, class and dimensions."""
    name = normalize_value(F.col("display_name"))
    class_text = normalize_value(F.col("class_name"))
    dims = F.to_json(F.array_sort(F.map_entries("normalized_dimensions")))
    return F.sha2(F.to_json(F.array(F.col("table_name"), name, class_text, dims)), 256)


def signed(documents: DataFrame) -> DataFrame:
    """Documents with their signature, to be computed once and read by many."""
    return documents.withColumn("signature", signature(documents))


def _with_signature(documents: DataFrame) -> DataFrame:
    return documents if "signature" in documents.columns else signed(documents)


def signature_groups(documents: DataFrame) -> DataFrame:
    """One row per signature: its representative (first by key) and its size.

    The members stay in long form (``signature_members``): one signature may cover a large share
    of a table, so they are never collected into an array.
    """
    keyed = _with_signature(documents).select("signature", "table_name", "entity_id", "key_order")
    return keyed.groupBy("signature").agg(
        F.first("table_name").alias("table_name"),
        F.min(F.struct("key_order", "entity_id")).alias("_first"),
        F.count(F.lit(1)).alias("member_count"),
    ).select("signature", "table_name", F.col("_first.entity_id").alias("representative_id"), "member_count")


def signature_members(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """Each document with the representative of its signature."""
    keyed = _with_signature(documents).select("signature", "entity_id")
    return keyed.join(groups.select("signature", "representative_id"), "signature")


def representatives(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents that stand for their signature."""
    return documents.join(groups.select(F.col("representative_id").alias("entity_id")), "entity_id", "left_semi")


def document_versions(documents: DataFrame) -> DataFrame:
    """Per id: how many different documents carry it, and how many rows there are."""
    content = F.sha2(
        F.to_json(
            F.struct(
                "table_name", "display_name", "display_code", "class_name", "search_text",
                F.array_sort(F.map_entries("typed_dimensions")).alias("dimensions"),
            ),
            {"ignoreNullFields": "false"},
        ),
        256,
    )
    return (
        documents.select("entity_id", content.alias("content"))
        .groupBy("entity_id", "content").agg(F.count(F.lit(1)).alias("copies"))
        .groupBy("entity_id").agg(F.count(F.lit(1)).alias("versions"), F.sum("copies").alias("copies"))
    )


def document_conflicts(documents: DataFrame) -> DataFrame:
    """Ids carried by documents that differ; identical copies are no conflict."""
    return document_versions(documents).where("versions > 1")


def checked_documents(documents: DataFrame) -> DataFrame:
    """One document per id; raises where an id has conflicting documents.  Most often nothing is repeated, and nothing is moved."""
    worst = document_versions(documents).agg(
        F.max("versions"), F.max("copies"), F.min(F.when(F.col("versions") > 1, F.col("entity_id")))
    ).first()
    if (worst[0] or 1) > 1:
        raise ValueError(f"conflicting entity documents for {worst[2]}")
    return documents.dropDuplicates(["entity_id"]) if (worst[1] or 1) > 1 else documents
