"""Headline timings as one JSON line.

plans, K = 8, 16-dimensional vectors, retrieval and judgement end to end.  BENCH_SHAPE_ROWS scales
the rows per table.  The other queries run over the Parquet tables in BENCH_SF_DIR.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from relweave import Catalog, EntityTable
from relweave.functions.vectors import hashing_encoder
from relweave.operators import documents as docs, judging
from relweave.operators.plans import RelationshipPlan, plans_frame
from relweave.plans import q_graph, registry
from relweave.plans.discovery import candidates_for
from relweave.session import local_session, materialize

HEADLINES = (
    "build_documents", "key_profile", "fk_edges", "relation_table_edges", "unique_identifier_edges", "merge_labels", "signature_groups",
    "keyword_topk", "vector_topk", "expand_representatives", "discover_graph", "entity_edges", "table_edges", "degrees", "connected_components",
    "duplicate_names", "node_search", "alias_tagging",
)
GRAPH_HEADLINES = ("entity_edges", "table_edges", "degrees", "connected_components", "duplicate_names", "node_search")
PLAN_TABLES = ((0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (4, 5), (5, 6), (6, 0))


def shape(spark, rows: int):
    """Candidates and judgement of the synthetic workload; the judge approves nothing."""
    tables = []
    for i in range(7):
        frame = spark.range(rows).select(
            F.col("id").cast("int").alias("id"),
            F.format_string(f"table_{i}-entity-%d", F.col("id")).alias("title"),
            F.concat(F.lit("category-"), F.col("id") % 25).alias("category"),
            F.lit("Synthetic").alias("class_name"),
        ).withColumn("name", F.col("title"))
        tables.append(EntityTable(f"table_{i}", frame, ("id",), ("title", "category")))
    catalog = Catalog.of(tables)
    plans = [
        RelationshipPlan(f"table_{s}", f"table_{t}", f"relation_{n}", "相关", "source_to_target", ("title", "category"), ("title", "category"),
                         ("keyword", "semantic"), 8, "synthetic")
        for n, (s, t) in enumerate(PLAN_TABLES)
    ]
    documents = materialize(docs.build_documents(catalog), "bench-documents")
    plan_rows = plans_frame(spark, plans)
    found = candidates_for(documents, plan_rows, hashing_encoder)
    pairs = judging.candidate_pairs(found, plan_rows, documents)
    requests = judging.judge_requests(pairs)
    return judging.ask_judge(requests, lambda request: {"decisions": []})


def build_seconds(spark, sf_dir: str) -> float:
    started = time.perf_counter()
    q_graph.stored_graph(spark, sf_dir)
    return round(time.perf_counter() - started, 3)


def timed(run) -> float:
    started = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    rows = int(os.environ.get("BENCH_SHAPE_ROWS", "1000"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, memory="12g")
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()

    timings = {}
    if not only or "shape_7000" in only:
        timings[f"shape_{7 * rows}"] = timed(lambda: shape(spark, rows))
    if not only or set(only) & set(GRAPH_HEADLINES):
        # The graph queries read one stored graph; building it is a line of its own.
        timings["graph_build"] = build_seconds(spark, sf_dir)
        print("graph_build", timings["graph_build"], file=sys.stderr, flush=True)
    for name in HEADLINES:
        if not only or name in only:
            timings[name] = timed(lambda: registry.QUERIES[name](spark, sf_dir))
            print(name, timings[name], file=sys.stderr, flush=True)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
