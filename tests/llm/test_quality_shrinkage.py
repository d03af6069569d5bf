"""Site means and quality against plain Python, and accuracy on labels that were not fitted."""

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import small
from pyspark.sql import functions as F

from relweave.llm import quality


def strength(groups: list[tuple]) -> float:
    """From (n, total, prior)."""
    low, high = quality.STRENGTHS
    some = [(n, t / n, p) for n, t, p in groups if n > 1]
    spread = sum(n * (m - p) ** 2 for n, m, p in some)
    chance, full = sum(p * (1 - p) for _, _, p in some), sum(n * p * (1 - p) for n, _, p in some)
    if full <= chance or spread <= chance:
        return high
    between = (spread - chance) / (full - chance)
    return min(high, max(low, (1 - between) / between if between < 1 else low))


def odds(p: float) -> float:
    p = max(min(p, 1 - 1e-6), 1e-6)
    return math.log(p / (1 - p))


def brute(rows: list[tuple]) -> list[tuple]:
    """Of (doc_id, host, path, label, p_text): doc_id, host_mean, path_mean, quality."""
    own = [p if label is None else label for _, _, _, label, p in rows]
    paths, hosts = defaultdict(lambda: [0, 0.0]), defaultdict(lambda: [0, 0.0])
    for (_, host, path, _, _), e in zip(rows, own, strict=True):
        for sums in (paths[(host, path)], hosts[host]):
            sums[0] += 1
            sums[1] += e
    overall = sum(own) / len(own)
    wide = strength([(n, t, overall) for n, t in hosts.values()])
    prior = {h: (t + wide * overall) / (n + wide) for h, (n, t) in hosts.items()}
    narrow = strength([(n, t, prior[h]) for (h, _), (n, t) in paths.items()])
    out = []
    for (i, host, path, _, p), e in zip(rows, own, strict=True):
        (n, t), (hn, ht) = paths[(host, path)], hosts[host]
        host_mean = (ht - e + wide * overall) / (hn - 1 + wide)
        path_mean = (t - e + narrow * host_mean) / (n - 1 + narrow)
        out.append((i, host_mean, path_mean, 1 / (1 + math.exp(-(odds(p) + odds(path_mean) - odds(overall))))))
    return out


def tables(spark):
    """Hosts of very different sizes and quality, paths within them, odd texts, and labels for a third."""
    junk, pick = "Thor Thor Thor Thor | Thor Thor | Thor", np.random.default_rng(3)
    rows = []
    for i in range(240):
        host = None if i % 40 == 39 else f"h{min(i // 30, i % 4)}"
        good = pick.random() < (0.9 if host == "h0" else 0.3)
        rows.append((i, small.prose(i, 20 + i % 50) if good else junk, host, f"p{i % 3}" if i % 5 else None, int(good)))
    rows += [(500, None, "h9", "p", 0), (501, "", "h9", "q", 0), (502, small.prose(1, 20_000), "h0", "p1", 1), (503, "?!" * 50, None, None, 0)]
    documents = spark.createDataFrame([(*r[:4], 1.0) for r in rows], "doc_id long, text string, host string, path string, quality double")
    labels = spark.createDataFrame([(r[0], r[4], "x") for r in rows if r[0] % 3 == 0], "doc_id long, quality int, host string")
    return rows, documents, labels


def test_every_column(spark):
    rows, documents, labels = tables(spark)
    known = {r.doc_id: r.quality for r in labels.collect()}
    found = {r.doc_id: r for r in quality.judged(documents, labels, F.col("host"), F.col("path")).collect()}
    assert len(found) == len(rows)
    x = quality.features_of(pa.record_batch([pa.array([r[1] for r in rows])], ["text"]))
    some = [k for k, r in enumerate(rows) if r[0] in known]
    y = np.array([known[rows[k][0]] for k in some], dtype=float)
    order = np.lexsort(np.concatenate([x[some].T, y[None, :]]))
    mean, deviation, weights = quality.fit(x[some][order], y[order])
    z = np.clip((x - mean) / deviation, -5, 5)
    p = 1 / (1 + np.exp(-(z @ weights[: z.shape[1]] + z**2 @ weights[z.shape[1] : -1] + weights[-1])))
    plain = brute([(r[0], r[2], r[3], known.get(r[0]), p[k]) for k, r in enumerate(rows)])
    for k, (i, host_mean, path_mean, score) in enumerate(plain):
        row = found[i]
        assert (row.p_text, row.host_mean, row.path_mean, row.quality) == pytest.approx((p[k], host_mean, path_mean, score), abs=1e-9)
        assert row.keep == (row.quality >= quality.LEAST_QUALITY)


def test_labels_that_were_not_fitted(spark, sf_dir):
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = quality.judged(documents, labels.where(~held), F.col("source"), F.col("lang"))
    pairs = found.join(labels.where(held).withColumnRenamed("quality", "label"), "doc_id").select("keep", "label").collect()
    assert len(pairs) > 10 and np.mean([r.keep == (r.label == 1) for r in pairs]) >= 0.9
