"""Keyword and vector candidates against sequential statements of the same rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relweave.functions.vectors import embed_text, hashing_encoder, l2_normalize, usable_vector
from relweave.operators import cell_index, retrieval, vector_search
from relweave.operators.plans import PlanError, RelationshipPlan, plans_frame, validate_field_matches, validate_plans
from relweave.sources.catalog import Catalog, EntityTable

TEXTS = "plan_id string, entity_id string, key_order array<string>, k int, retrieval_modes array<string>, text string"


def sequential(query_tokens, postings, k):
    found = []
    for token in sorted(query_tokens):
        for target in postings.get(token, [])[:k]:
            if target not in found:
                found.append(target)
            if len(found) >= k:
                return found
    return found


def test_keyword_candidates_match_the_sequential_rule(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    sources, targets, expected = [], [], set()
    for plan in range(12):
        k = rng.randint(1, 4)
        corpus = {f"t{i:02d}": rng.sample(words, rng.randint(0, 4)) for i in range(rng.randint(1, 12))}
        for target, tokens in corpus.items():
            targets.append((f"p{plan}", target, [target], k, ["keyword"], ";".join(tokens)))
        postings = {w: [t for t in sorted(corpus) if w in corpus[t]] for w in words}
        for s in range(10):
            tokens = rng.sample(words, rng.randint(0, 5))
            sources.append((f"p{plan}", f"s{s}", [str(s)], k, ["keyword"], ";".join(tokens)))
            expected |= {(f"p{plan}", f"s{s}", t, r + 1) for r, t in enumerate(sequential(tokens, postings, k))}
    postings = retrieval.first_postings(retrieval.keyword_index(spark.createDataFrame(targets, TEXTS)))
    got = retrieval.keyword_candidates(spark.createDataFrame(sources, TEXTS), postings)
    assert {(r["plan_id"], r["source_id"], r["target_id"], r["rank"]) for r in got.collect()} == expected


def test_hot_token_keeps_its_first_postings(spark):
    targets = spark.range(5000).select(
        F.lit("p").alias("plan_id"), F.concat(F.lit("t"), "id").alias("entity_id"), F.array(F.lpad(F.col("id").cast("string"), 8, "0")).alias("key_order"),
        F.lit(3).alias("k"), F.array(F.lit("keyword")).alias("retrieval_modes"), F.lit("common").alias("text"),
    )
    index = retrieval.keyword_index(targets)
    assert [r["entity_id"] for r in retrieval.first_postings(index).orderBy("place").collect()] == ["t0", "t1", "t2"]
    from relweave.operators.ranking import top_k

    plan = top_k(index, ["plan_id", "token"], [F.col("key_order")], 50, "place")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def vectors(rows):
    return [("p", name, [float(x) for x in v]) for name, v in rows]


@pytest.mark.parametrize("pivots, block_rows, k", [(1, 8192, 5), (7, 16, 5), (20, 3, 9), (40, 8192, 300)])
def test_nearest_vectors_are_exact(spark, pivots, block_rows, k):
    rng = np.random.default_rng(pivots)
    centres = rng.normal(size=(6, 8))
    target = np.vstack([centres[rng.integers(6, size=180)] + 0.2 * rng.normal(size=(180, 8)), np.tile(centres[:1], (90, 1))])
    source = centres[rng.integers(6, size=40)] + 0.3 * rng.normal(size=(40, 8))
    schema = "plan_id string, entity_id string, vector array<double>"
    got = vector_search.nearest_vectors(
        spark.createDataFrame(vectors((f"s{i:03d}", v) for i, v in enumerate(source)), schema),
        spark.createDataFrame(vectors((f"t{i:03d}", v) for i, v in enumerate(target)), schema), k, pivots, block_rows,
    ).collect()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cosine = np.round(unit(source) @ unit(target).T, 9)
    expected = set()
    for i in range(len(source)):
        order = sorted(range(len(target)), key=lambda j: (-cosine[i, j], j))[:k]
        expected |= {(f"s{i:03d}", f"t{j:03d}", r + 1) for r, j in enumerate(order)}
    assert {(r["source_id"], r["target_id"], r["rank"]) for r in got} == expected


def test_unusable_vectors_are_skipped(spark):
    rows = [("a", [1.0, 0.0]), ("b", []), ("c", [0.0, 0.0]), ("d", None), ("e", [float("nan"), 1.0]), ("f", [float("inf"), 1.0]), ("g", [1.0])]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    assert [r[0] for r in df.where(usable_vector(F.col("v"), 2)).select("id").collect()] == ["a"]
    assert spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>").select(l2_normalize(F.col("v"))).collect()[0][0] == pytest.approx([0.6, 0.8])
    assert spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(l2_normalize(F.col("v"))).first()[0] == [0.0, 0.0]


def test_empty_text_is_never_embedded(spark):
    def encoder():
        def encode(texts):
            assert all(texts)
            return hashing_encoder(8)(texts)

        return encode

    df = spark.createDataFrame([("a",), ("",), (None,), ("a",)], "t string")
    got = [r[0] for r in df.select(embed_text(F.col("t"), encoder, 1)).collect()]
    assert got[1] is None and got[2] is None and got[0] == got[3] and sum(x * x for x in got[0]) == pytest.approx(1.0)


def test_hybrid_order_and_empty_groups(spark):
    sources = spark.createDataFrame([("p", "s1", 3), ("p", "s2", 3)], "plan_id string, entity_id string, k int")
    stage = "plan_id string, source_id string, target_id string, rank int, via string"
    keyword = spark.createDataFrame([("p", "s1", "b", 1, "keyword"), ("p", "s1", "a", 2, "keyword")], stage)
    semantic = spark.createDataFrame([("p", "s1", x, i + 1, "semantic") for i, x in enumerate("acd")], stage)
    merged = retrieval.hybrid_candidates(sources, keyword, semantic)
    rows = sorted((r["source_id"], r["rank"] or 0, r["target_id"], r["via"]) for r in merged.collect())
    assert rows == [("s1", 1, "b", "keyword"), ("s1", 2, "a", "keyword"), ("s1", 3, "c", "semantic"), ("s2", 0, None, None)]
    plans = spark.createDataFrame([("p", 3)], "plan_id string, candidate_limit int")
    stats = retrieval.retrieval_stats(merged, plans).first()
    assert (stats["groups"], stats["candidates"], stats["peak_list"], stats["beyond_limit"]) == (2, 3, 3, 0)


def test_approximate_search_finds_the_obvious(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8))
    schema = "plan_id string, entity_id string, vector array<double>"
    df = spark.createDataFrame(vectors((f"v{i}", v) for i, v in enumerate(base)), schema)
    got = cell_index.approximate_nearest(df, df, 1, cell_rows=4, block_rows=4)
    assert {(r["source_id"], r["target_id"]) for r in got.collect()} == {(f"v{i}", f"v{i}") for i in range(30)}
    other = df.withColumn("plan_id", F.lit("q")).where("entity_id < 'v2'")
    both = cell_index.approximate_nearest(df.union(other), df.union(other), 30, cell_rows=4)
    assert both.where("plan_id = 'q'").count() == other.count() ** 2 or both.where("plan_id = 'q' AND target_id >= 'v2'").count() == 0
    assert cell_index.approximate_nearest(df, df.where("false"), 1).count() == 0


def make_plan(**changes):
    fields = dict(source_table="a", target_table="b", relation_type="r", display_label="使用", direction="undirected", source_dimensions=("x",),
                  target_dimensions=("y",), retrieval_modes=("keyword",), candidate_limit=5, reason="")
    return RelationshipPlan(**{**fields, **changes})


def plan_catalog(spark):
    a = spark.createDataFrame([(1, "n", "A", "v")], "id int, name string, class_name string, x string")
    b = spark.createDataFrame([(1, "n", "B", "v")], "id int, name string, class_name string, y string")
    return Catalog.of([EntityTable("a", a, ("id",), ("x", "id")), EntityTable("b", b, ("id",), ("y",))])


def test_plans_are_taken_whole_or_rejected(spark):
    catalog = plan_catalog(spark)
    good = plans_frame(spark, [make_plan(), make_plan(), make_plan(relation_type="s")])
    assert validate_plans(good, catalog).count() == 2
    with pytest.raises(PlanError):
        validate_plans(good, catalog, limit=1)
    bad = [dict(target_table="a"), dict(source_table="zz"), dict(source_dimensions=()), dict(source_dimensions=("id",)), dict(target_dimensions=("nope",)),
           dict(candidate_limit=51), dict(display_label="uses"), dict(direction="up"), dict(retrieval_modes=("magic",))]
    from relweave.operators.plans import check_plans

    checked = check_plans(plans_frame(spark, [make_plan(**c) for c in bad]), catalog)
    assert checked.where("problem is null").count() == 0
    with pytest.raises(PlanError):
        validate_plans(plans_frame(spark, [make_plan(), make_plan(target_table="a")]), catalog)


def test_field_matches(spark):
    columns = spark.createDataFrame([("a", "x"), ("b", "y")], "table_name string, column_name string")
    raw = [("a", "x", "b", "y", "exact_match", "0.2"), ("a", "x", "b", "y", "edit_distance", "1.7"), ("a", "x", "b", "y", "numeric_difference", "-1"),
           ("a", "x", "a", "x", "exact_match", "1"), ("a", "q", "b", "y", "exact_match", "1"), ("a", "x", "b", "y", "soundex", "1"), ("a", "x", "b", "y", "exact_match", "high")]
    got = validate_field_matches(spark.createDataFrame(raw, "source_table string, source_field string, target_table string, target_field string, algorithm string, confidence string"), columns)
    assert [(r["algorithm"], r["confidence"]) for r in got.collect()] == [("exact_match", 1.0), ("edit_distance", 0.95), ("numeric_difference", 0.0)]


def test_sources_are_copied_for_blocks_of_cells_outside_python(spark):
    """Python gives one row for each source, whatever the cells it needs, and cells are searched together up to a block."""
    import numpy as np
    import pandas as pd

    from relweave.operators import vector_search

    class Sent:
        def __init__(self, value):
            self.value = value

    centres = np.eye(40)
    cell_ids, sizes = np.arange(40), np.full(40, 100)
    units = vector_search._units(centres, cell_ids, sizes, 1000)
    assert sorted(units) == list(range(40)) and set(units.values()) == set(range(4))
    bounds = Sent({"p": (cell_ids, sizes, np.full(40, 2.0), [np.zeros(3)] * 40)})
    batch = pd.DataFrame({"plan_id": "p", "entity_id": [str(i) for i in range(1200)], "vector": list(np.tile(centres, (30, 1)))})
    parts = list(vector_search._choose_units(Sent({"p": centres}), bounds, Sent({"p": units}), 10)(iter([batch])))
    assert sum(map(len, parts)) == 1200 and max(map(len, parts)) <= vector_search.CHUNK_ROWS
    assert all(list(c) == [0, 1, 2, 3] for part in parts for c in part["cells"])
