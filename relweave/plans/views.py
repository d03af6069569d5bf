"""Entity views over the driver's tables: names, classes, keys and relation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from relweave.operators.deterministic import FieldMatch, IdentifierPlan, OrientationRules
from relweave.operators.judging import Rule
from relweave.operators.plans import RelationshipPlan
from relweave.sources.catalog import Catalog, EntityTable, ForeignKey

FOREIGN_KEYS = [
    ForeignKey("nation", ("n_regionkey",), "region", ("r_regionkey",)),
    ForeignKey("customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("supplier", ("s_nationkey",), "nation", ("n_nationkey",)),
    ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)),
    ForeignKey("events", ("user_id",), "customer", ("c_custkey",)),
    ForeignKey("labels", ("doc_id",), "documents", ("doc_id",)),
]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _named(df: DataFrame, name: str, class_name: str, **extra: str) -> DataFrame:
    columns = {"name": F.expr(name), "class_name": F.lit(class_name)}
    columns.update({k: F.expr(v) for k, v in extra.items()})
    return df.withColumns(columns)


def catalog(spark: SparkSession, sf_dir: str, *names: str) -> Catalog:
    """The named tables of the test data, or every one with an identity of its own."""
    wanted = names or tuple(_TABLES)
    keys = [k for k in FOREIGN_KEYS if k.source_table in wanted and k.target_table in wanted]
    return Catalog.of([_TABLES[name](read(spark, sf_dir, name)) for name in wanted], keys)


_TABLES = {
    "region": lambda t: EntityTable("region", _named(t, "r_name", "Region"), ("r_regionkey",)),
    "nation": lambda t: EntityTable("nation", _named(t, "n_name", "Nation"), ("n_nationkey",)),
    "customer": lambda t: EntityTable(
        "customer", _named(t, "c_name", "Customer", customer_no="cast(c_custkey as string)"),
        ("c_custkey",), ("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"), (("c_name",),),
    ),
    "supplier": lambda t: EntityTable("supplier", _named(t, "s_name", "Supplier", supplier_code="s_name"), ("s_suppkey",), ("s_acctbal",)),
    "part": lambda t: EntityTable(
        "part", _named(t, "p_name", "Part", part_code="nullif(p_brand, 'Brand#1')", model="p_type"),
        ("p_partkey",), ("p_brand", "p_type", "p_size", "p_retailprice"),
    ),
    "orders": lambda t: EntityTable(
        "orders", _named(t, "cast(o_orderkey as string)", "Order"),
        ("o_orderkey",), ("o_orderstatus", "o_orderpriority", "o_totalprice"),
    ),
    "events": lambda t: EntityTable("events", _named(t, "event_type", "Event"), ("event_id",), ("value", "props")),
    "documents": lambda t: EntityTable("documents", _named(t, "source", "Document"), ("doc_id",), ("text", "lang")),
    "labels": lambda t: EntityTable("labels", _named(t, "cast(doc_id as string)", "Label"), ("doc_id",), ("quality", "toxic")),
    "benchmark": lambda t: EntityTable("benchmark", _named(t, "cast(item_id as string)", "Passage"), ("item_id",), ("text",)),
    "pages": lambda t: EntityTable("pages", _named(t, "url", "Page"), ("page_id",), ("html",)),
    "conversations": lambda t: EntityTable("conversations", _named(t, "role", "Turn"), ("conv_id", "turn"), ("text",)),
    "embeddings": lambda t: EntityTable("embeddings", _named(t, "cast(vec_id as string)", "Vector"), ("vec_id",), ("label",)),
}


def vector_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """All vectors once as queries and once as the corpus."""
    frame = _named(read(spark, sf_dir, "embeddings"), "cast(vec_id as string)", "Vector")
    return Catalog.of([EntityTable(name, frame, ("vec_id",), ("label",)) for name in ("query_vectors", "corpus_vectors")])


def contact_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """Customers next to a contact list derived from them, whose keys differ in case and spaces,
    are missing for one nation and collide for one segment of another."""
    customers = read(spark, sf_dir, "customer")
    contacts = customers.select(
        F.col("c_custkey").alias("contact_id"),
        F.expr(
            "case when c_nationkey = 3 then null when c_nationkey = 4 and c_mktsegment = 'BUILDING' then 'shared' "
            "else concat('  ', upper(c_name), ' ') end"
        ).alias("contact_key"),
    )
    return Catalog.of(
        [
            EntityTable("customer", _named(customers, "c_name", "Customer"), ("c_custkey",), ("c_name",), (("c_name",),)),
            EntityTable(
                "contact", _named(contacts, "cast(contact_id as string)", "Contact"), ("contact_id",), ("contact_key",), (("contact_key",),)
            ),
        ]
    )


IDENTIFIER_PLANS = [
    IdentifierPlan("customer", "c_name", "contact", "contact_key", "unique_identifier", "undirected", "same account key")
]

FIELD_MATCHES = [
    FieldMatch("events", "user_id", "customer", "c_custkey", 0.9),
    FieldMatch("labels", "doc_id", "documents", "doc_id"),
]

ORIENTATION = OrientationRules({("Order", "Part"): "contains", ("Part", "Supplier"): "supplied_by"})


def relation_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Line items as two relation tables; the second one is written against its direction."""
    lines = read(spark, sf_dir, "lineitem")
    return {
        "metargetrl": lines.select(
            F.col("l_orderkey").alias("left_id"), F.col("l_partkey").alias("right_id"),
            F.lit("Order").alias("left_class"), F.lit("Part").alias("right_class"),
        ),
        "bom_temp_view_data": lines.select(
            F.col("l_suppkey").alias("left_id"), F.col("l_partkey").alias("right_id"),
            F.lit("Supplier").alias("left_class"), F.lit("Part").alias("right_class"),
        ),
    }


PASSAGE_PLAN = RelationshipPlan(
    "benchmark", "documents", "contains_passage", "包含段落", "target_to_source",
    ("text",), ("text", "lang"), ("keyword",), 20, "documents may repeat passages",
)
TURN_PLAN = RelationshipPlan(
    "benchmark", "conversations", "quoted", "引用段落", "undirected",
    ("text",), ("text",), ("keyword",), 8, "turns may quote passages",
)
PASSAGE_RULES = [
    Rule("contains_passage", 0.94, "an English document shares wording", (("text", "lang", "language fits"),), prefix=("lang", "en")),
    Rule("quoted", 0.97, "the turn is the passage", (("text", "text", "same text"),), equal=(("text", "text"),)),
]
VECTOR_PLAN = RelationshipPlan(
    "query_vectors", "corpus_vectors", "similar", "内容相近", "undirected",
    ("label",), ("label",), ("keyword", "semantic"), 50, "vectors of one label",
)
VECTOR_RULES = [Rule("similar", 0.97, "equal labels", (("label", "label", "same label"),), equal=(("label", "label"),))]
