"""Profiles of tables and declared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from relweave.functions.identity import key_order
from relweave.functions.text import (
    bounded_samples,
    fallback_table_name,
    is_sensitive,
    strip_to_null,
)
from relweave.functions.values import as_text, typed_json
from relweave.operators.ranking import top_k
from relweave.sources.catalog import Catalog, EntityTable, column_catalog, no_rows, union_all

SAMPLE_LIMIT = 3
SAMPLE_LENGTH = 80


def column_roles(catalog: Catalog) -> DataFrame:
    """Role of every column, with how many rows carry a value in it."""
    counts = []
    for table, spec in catalog.tables.items():
        row = spec.frame.agg(*[F.count(F.col(c)).alias(c) for c in spec.columns])
        counts.append(
            row.unpivot([], spec.columns, "column_name", "non_null_count").withColumn("table_name", F.lit(table))
        )
    return column_catalog(catalog).join(union_all(counts), ["table_name", "column_name"])


def eligible_tables(catalog: Catalog) -> DataFrame:
    """Tables with a name and a class column, with their row counts."""
    roles = column_catalog(catalog).groupBy("table_name").agg(
        F.bool_or("is_name").alias("has_name"), F.bool_or("is_class_name").alias("has_class")
    )
    eligible = roles.where("has_name and has_class").select("table_name")
    return eligible.join(row_counts(catalog), "table_name")


def row_counts(catalog: Catalog) -> DataFrame:
    """Rows per table, zero for an empty one.  One aggregation over all scans, without any column."""
    spark = next(iter(catalog.tables.values())).frame.sparkSession
    rows = [s.frame.select(F.lit(t).alias("table_name"), F.lit(1).alias("n")) for t, s in catalog.tables.items()]
    names = spark.createDataFrame([(t, 0) for t in catalog.tables], "table_name string, n int")
    return union_all([*rows, names]).groupBy("table_name").agg(F.sum("n").alias("row_count"))


def schema_fingerprint(catalog: Catalog) -> DataFrame:
    """The catalog digest next to the size of every table it covers."""
    return row_counts(catalog).select("table_name", "row_count", F.lit(catalog.fingerprint()).alias("fingerprint"))


def key_profile(catalog: Catalog) -> DataFrame:
    """Rows, rows with a null part, and distinct values of every declared key."""
    profiles = []
    for table, spec in catalog.tables.items():
        declared = [("primary", spec.primary_key)] + [("unique", c) for c in spec.unique_columns]
        declared += [("foreign", k.source_columns) for k in catalog.foreign_keys if k.source_table == table]
        for kind, columns in declared:
            profiles.append(_one_key(spec, table, kind, list(columns)))
    return union_all(profiles)


def _one_key(spec: EntityTable, table: str, kind: str, columns: list[str]) -> DataFrame:
    # Grouping by the key first keeps a hot key to one row per map task.
    groups = spec.frame.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    complete = F.lit(True)
    for column in columns:
        complete = complete & F.col(column).isNotNull()
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(~complete, F.col("n"))), F.lit(0)).alias("null_rows"),
        F.count_if(complete).alias("distinct_keys"),
        F.count_if(complete & (F.col("n") > 1)).alias("repeated_keys"),
    ).select(F.lit(table).alias("table_name"), F.lit(kind).alias("key_kind"),
             F.lit(",".join(columns)).alias("key_columns"), "*")


def table_samples(catalog: Catalog) -> DataFrame:
    """Up to three (name, class) samples per table in key order, trimmed and cut."""
    frames = []
    for table, spec in catalog.tables.items():
        name, class_name = spec.name_column, spec.class_column
        if name is None or class_name is None:
            raise ValueError(f"{table} needs a name and a class column")
        schema = spec.frame.schema
        shown = spec.frame.select(
            strip_to_null(as_text(name, schema[name].dataType)).alias("name_sample"),
            strip_to_null(as_text(class_name, schema[class_name].dataType)).alias("class_sample"),
            key_order(spec.frame, spec.primary_key).alias("key_order"),
        ).where("name_sample is not null and class_sample is not null")
        # Three rows of each task leave it; the table is not sorted.
        frames.append(shown.orderBy("key_order").limit(SAMPLE_LIMIT).withColumn("table_name", F.lit(table)))
    ranked = top_k(union_all(frames), ["table_name"], [F.col("key_order")], SAMPLE_LIMIT, "sample_rank")
    return ranked.select(
        "table_name",
        "sample_rank",
        F.substring("name_sample", 1, SAMPLE_LENGTH).alias("name_sample"),
        F.substring("class_sample", 1, SAMPLE_LENGTH).alias("class_sample"),
    )


def table_summary(catalog: Catalog) -> DataFrame:
    """Row count, bounded samples and column list per table."""
    entry = F.struct("sample_rank", "name_sample", "class_sample")
    samples = table_samples(catalog).groupBy("table_name").agg(F.array_sort(F.collect_list(entry)).alias("s"))
    columns = column_catalog(catalog).groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("position", "column_name"))).alias("c")
    )
    return (
        row_counts(catalog)
        .join(columns, "table_name")
        .join(samples, "table_name", "left")
        .select(
            "table_name",
            "row_count",
            bounded_samples(F.coalesce(F.col("s.name_sample"), F.array())).alias("name_samples"),
            bounded_samples(F.coalesce(F.col("s.class_sample"), F.array())).alias("class_name_samples"),
            F.col("c.column_name").alias("column_names"),
        )
    )


def grouped_samples(df: DataFrame, group: str, text: str, order: str) -> DataFrame:
    """First three usable samples of a text column per group.

    Unusable texts are dropped before the ranking, so each map task sends at most three rows
    per group on.
    """
    usable = df.select(group, order, strip_to_null(F.col(text)).alias("sample"))
    usable = usable.where(F.col("sample").isNotNull() & ~is_sensitive(F.col("sample")))
    ranked = top_k(usable, [group], [F.col(order)], SAMPLE_LIMIT, "sample_rank")
    return ranked.select(group, "sample_rank", F.substring("sample", 1, SAMPLE_LENGTH).alias("sample"))


def merge_inferred_names(summary: DataFrame, inferred: DataFrame) -> DataFrame:
    """Inferred table names where the whole set is valid, readable fallbacks otherwise.

    ``inferred`` has table_name and semantic_name.  One unknown table, repeated table, blank or
    overlong name, name equal to a sample, or sensitive name rejects the whole set.
    """
    proposals = inferred.select(
        strip_to_null(F.col("table_name")).alias("table_name"), strip_to_null(F.col("semantic_name")).alias("semantic_name")
    )
    checked = proposals.join(
        summary.select("table_name", "name_samples", "class_name_samples", F.lit(True).alias("known")), "table_name", "left"
    )
    name = F.col("semantic_name")
    bad = (
        F.col("known").isNull()
        | name.isNull()
        | (F.char_length(name) > 40)
        | F.coalesce(F.array_contains("name_samples", name), F.lit(False))
        | F.coalesce(F.array_contains("class_name_samples", name), F.lit(False))
        | F.coalesce(is_sensitive(name), F.lit(False))
    )
    verdict = checked.agg(
        F.coalesce(F.bool_or(bad), F.lit(False)).alias("any_bad"),
        (F.count("table_name") > F.count_distinct("table_name")).alias("any_repeat"),
    ).select((F.col("any_bad") | F.col("any_repeat")).alias("rejected"))
    accepted = proposals.where(~verdict.scalar())
    return summary.join(accepted, "table_name", "left").select(
        "table_name",
        F.coalesce("semantic_name", fallback_table_name(F.col("table_name"))).alias("semantic_name"),
        "row_count",
        "name_samples",
        F.when(F.col("semantic_name").isNotNull(), F.lit("inferred")).otherwise(F.lit("fallback")).alias("status"),
    )


def plan_samples(catalog: Catalog) -> DataFrame:
    """The first row of each table by key, one output row per allowed dimension."""
    frames = []
    for table, spec in catalog.tables.items():
        allowed = catalog.allowed_dimensions(table)
        if not allowed:
            continue
        schema = spec.frame.schema
        first = (
            spec.frame.select(*spec.primary_key, *allowed)
            .withColumn("_order", key_order(spec.frame, spec.primary_key))
            .orderBy("_order")
            .limit(1)
        )
        values = first.select(*[typed_json(c, schema[c].dataType).alias(c) for c in allowed])
        types = F.create_map(*[F.lit(x) for c in allowed for x in (c, schema[c].dataType.simpleString())])
        frames.append(
            values.unpivot([], allowed, "dimension", "sample_value")
            .withColumn("type", types[F.col("dimension")])
            .withColumn("table_name", F.lit(table))
        )
    return union_all(frames, no_rows(catalog, "dimension string, sample_value string, type string, table_name string"))


def search_tables(summary: DataFrame, query: str) -> DataFrame:
    """Tables whose own or semantic name contains the query, whatever the case; all for a blank one."""
    wanted = query.strip().lower()
    return summary.where(
        F.lower("table_name").contains(wanted) | F.coalesce(F.lower("semantic_name").contains(wanted), F.lit(False))
    )
