"""Site-level quality, raked mixing and the pipeline."""

import numpy as np
import pytest
import small
from pyspark.sql import functions as F

import corpus_pipeline
from relweave.llm import mixing, quality


def sites(spark):
    """A good and a bad host with many documents, and one with a single document."""
    junk = "Thor Thor Thor Thor | Thor Thor | Thor"
    rows = [(i, junk if i % 10 else small.prose(i, 60), "bad", "p") for i in range(200)]
    rows += [(i, small.prose(i, 60) if i % 10 else junk, "good", f"p{i % 2}") for i in range(200, 400)]
    rows += [(400, small.prose(400, 60), "lone", None), (401, None, None, "p"), (None, small.prose(7, 60), "good", "p0")]
    labels = [(i, int(rows[i][1] != junk), None) for i in range(0, 400, 3)] + [(1, None, 0), (None, 1, 0), (3, 0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, host string, path string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, none):
    documents, labels = sites(spark)
    rows = quality.judged(documents, labels, F.col("host"), F.col("path")).collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == documents.count() and all(0 <= r.quality <= 1 for r in rows)
    assert found[210].host_mean > 0.7 and found[10].host_mean < 0.3
    assert 0.3 < found[400].path_mean < 0.7  # one document says little about its site
    assert not found[11].keep and found[213].keep
    assert np.isclose(found[400].host_mean, found[400].path_mean, atol=1e-6)  # nothing else is known of its path
    assert quality.judged(documents, labels.where("false"), F.col("host"), F.col("path")).agg(F.count_distinct("p_text")).first()[0] == 1
    assert quality.judged(none, labels, F.col("source"), F.col("lang")).count() == 0


def test_quality_of_the_labelled(spark, sf_dir):
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.judged(documents, labels, F.col("source"), F.col("lang")).join(labels.withColumnRenamed("quality", "label"), "doc_id")
    pairs = found.select("keep", "label").collect()
    assert np.mean([r.keep == (r.label == 1) for r in pairs]) > 0.95


def test_raking_reaches_the_targets(spark):
    cells = spark.createDataFrame(
        [("a", "x", "t", 500), ("a", "y", "t", 100), ("b", "x", "t", 300), ("b", "y", "u", 50), ("b", "x", "u", 70), (None, "x", "u", 10), ("c", "y", "t", 0)],
        "source string, lang string, topic string, tokens long",
    )
    goals = {"source": {"a": 0.3, "b": 0.6, None: 0.1}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"t": 0.6, "u": 0.4}}
    targets = {m: spark.createDataFrame(list(g.items()), "value string, share double") for m, g in goals.items()}
    rows = mixing.raked(cells, targets, rounds=60).collect()
    for margin, goal in goals.items():
        for value, share in goal.items():
            assert sum(r.weight for r in rows if r[margin] == value) == pytest.approx(share, abs=1e-6)


def test_mix(spark, odd, none):
    rows = mixing.calibrated(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.probability <= 1 for r in rows)
    assert {r.doc_id: r.tokens for r in rows if r.doc_id in (5, 6, 8)} == {5: 0, 6: 0, 8: 2}
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert sorted(str(r.doc_id) for r in mixed.collect()) == sorted(str(r.doc_id) for r in rows if r.sampled)
    assert mixing.calibrated(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_plan_has_no_python(odd):
    plan = mixing.calibrated(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_sampled_shares_follow_the_targets(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.calibrated(documents).collect()
    total = sum(r.tokens * r.probability for r in rows)
    raised = {}
    for r in rows:
        raised[r.lang] = raised.get(r.lang, 0) + r.tokens
    raised = {k: v**mixing.TEMPER for k, v in raised.items()}
    for lang, value in raised.items():
        got = sum(r.tokens * r.probability for r in rows if r.lang == lang) / total
        assert got == pytest.approx(value / sum(raised.values()), abs=0.02)


def test_pipeline(spark, sf_dir):
    """Every stage on its predecessor's rows, against what the stages say one by one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [small.words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(len(w) - 9)}
    sizes = [docs.count()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert len(kept[name]) == docs.count()
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > 0.95 * sizes[0] and sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    before = {i: r.text for i, r in kept["language_id"].items()}
    of = small.classes(small.near_links(before), before)
    assert set(kept["near_duplicates"]) == set(of.values())
    clean = {i for i, r in kept["near_duplicates"].items() if not any(tuple(w[k : k + 10]) in windows for w in [small.words(r.text)] for k in range(len(w) - 9))}
    assert set(kept["decontamination"]) == clean
    assert set(kept["personal_data"]) == clean
    assert not [r for r in kept["personal_data"].values() if "@mail" in r.text]
    assert all(r.n_chars == len(r.text) for r in kept["personal_data"].values())


def test_pipeline_on_odd_rows(spark, odd, none, sf_dir):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == odd.columns
        docs.collect()
