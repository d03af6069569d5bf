"""Lengths, magnitudes, narrow clouds and full leaves of the embedding forest."""

import numpy as np
import pytest
import small

from relweave.llm import embeddings


def linked(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    return near


def found(spark, rows, kind="double"):
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"vec_id long, embedding array<{kind}>")
    return {r.vec_id: r for r in embeddings.near_vectors(frame).collect()}


def narrow(count: int, size: int, lean: float, seed: int) -> np.ndarray:
    """Clusters of four around directions whose mean cosine is about ``lean``."""
    pick = np.random.default_rng(seed)
    axis = np.zeros(size)
    axis[0] = np.sqrt(size * lean / (1 - lean))
    centres = axis + pick.standard_normal((count // 4, size))
    spread = 0.2 * np.sqrt(1 / (1 - lean))
    return centres[np.arange(count) % len(centres)] + spread * pick.standard_normal((count, size))


def test_lengths_and_magnitudes(spark):
    pick = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(pick.standard_normal((6, 3)))]
    rows += [(10, [1.0, 2.0]), (11, [2.0, 4.0]), (12, [-1.0, 5.0])]
    rows += [(20, [1e200, 2e200, 0, 1e200]), (21, [1e200, 2e200, 0, 1e200]), (22, [1e-200, 2e-200, 0, 1e-200]), (23, [3e-320, 6e-320, 0, 3e-320]), (24, [0, 0, 1e200, 0])]
    got = found(spark, rows)
    assert (got[10].n_links, got[11].component_id, got[12].n_links) == (1, 10, 0)
    assert [got[i].n_links for i in (20, 21, 22, 23, 24)] == [3, 3, 3, 3, 0] and got[23].component_id == 20
    near = linked(np.array([v for i, v in rows[:6]]))
    assert [got[i].n_links for i in range(6)] == near.sum(axis=1).tolist()


@pytest.mark.parametrize("lean", [0.0, 0.6, 0.8])
def test_narrow_clouds_are_split_without_losing_links(spark, monkeypatch, lean):
    monkeypatch.setattr(embeddings, "LEAF", 60)
    vectors = narrow(3_000, 48, lean, 3)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    _, _, free = embeddings.grow(unit, np.random.default_rng(1), 60, 0)
    assert free > 20  # the leaves of one tree
    near = linked(vectors)
    got = found(spark, enumerate(vectors))
    told = np.array([got[i].n_links for i in range(len(vectors))])
    assert (told <= near.sum(axis=1)).all() and told.sum() >= 0.95 * near.sum()


def test_full_leaves_are_split_further(spark, monkeypatch):
    """Trees fitted on a sample too small for them, and copies that nothing parts."""
    for name, value in (("SAMPLE", 60), ("LEAF", 30), ("OVERFULL", 2), ("LEAF_SAMPLE", 400), ("SPLIT_BLOCK", 100), ("BLOCK", 200)):
        monkeypatch.setattr(embeddings, name, value)
    cloud = narrow(1_600, 32, 0.3, 5)
    bundle = np.ones(32) + 0.02 * np.random.default_rng(6).standard_normal((150, 32))
    vectors = np.concatenate([cloud, bundle])
    near = linked(vectors)
    got = found(spark, enumerate(vectors))
    told = np.array([got[i].n_links for i in range(len(vectors))])
    assert (told <= near.sum(axis=1)).all() and told.sum() >= 0.95 * near.sum()
    assert {got[i].n_links for i in range(1_600, 1_750)} == {149}


def test_recall_on_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    held = [(r.vec_id, r.embedding) for r in rows.collect() if r.embedding is not None]
    near = linked(np.array([v for _, v in held], dtype=np.float64))
    got = {r.vec_id: r for r in embeddings.near_vectors(rows).collect()}
    told = np.array([got[i].n_links for i, _ in held])
    assert len(got) == rows.count() and (told <= near.sum(axis=1)).all() and told.sum() >= 0.95 * near.sum()
    links = [(held[a][0], held[b][0]) for a, b in zip(*np.nonzero(np.triu(near)), strict=True)]
    assert np.mean([got[i].component_id == c for i, c in small.classes(links, [i for i, _ in held]).items()]) > 0.95
