"""Quality of documents: a text classifier combined with hierarchical empirical Bayes over sites.

The classifier is a logistic regression on a fixed number of statistics of the text (``FEATURES``), fitted on at
most about ``LABELLED`` labelled documents, taken by a hash of their id.  Every document then gives evidence for
its host and its path: its label if it has one, else the classifier's probability.  By grouped aggregation the
host's mean is shrunk toward the global one, and the path's toward its host's; the strength of each prior, in
documents, is estimated by moments from the spread between sites beyond what chance explains, so that sparse
sites stay near their prior and large ones speak for themselves.  A document's own evidence is left out of its
site's mean before both are combined as log odds.

Only a few numbers for each site and document are shuffled, never texts; a host with a third of all documents is
one row for each task before the shuffle.

A null text counts as empty.  Null hosts and paths are sites of their own.  Labels that are null, and all but one
of several labels of an id (the least), are ignored.  Without labels of both kinds the classifier says the global
mean for all (a half without any label).  Rows that share an id each get a row.  Empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from relweave.llm.shingles import bags
from relweave.llm.tables import keep
from relweave.llm.words import chunks, texts_of, words_of

#: Labelled documents the classifier is fitted on, at most about.
LABELLED = 20_000
#: A document is kept from this probability of being good.
LEAST_QUALITY = 0.5
#: Strengths of a prior lie between these numbers of documents.
STRENGTHS = (1.0, 10_000.0)

FEATURES = (
    "log_words", "word_length", "symbols", "digits", "capitals", "beyond_ascii", "distinct_words", "commonest_word", "repeated_neighbours",
    "distinct_lines", "bars", "exclamations", "line_ends",
)


def features_of(part: pa.RecordBatch) -> np.ndarray:
    """Text x statistic."""
    texts = texts_of(part.column("text"))
    data, offsets = texts
    n, size = len(offsets) - 1, np.maximum(np.diff(offsets), 1)
    words = words_of(texts)
    count = np.diff(words.first)
    some = np.maximum(count, 1)
    owner = np.repeat(np.arange(n), np.diff(offsets))

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=n) / size

    def within(lo: int, hi: int) -> np.ndarray:
        return (data >= lo) & (data <= hi)

    distinct = bags(words.text, words.code)
    commonest = np.zeros(n)
    np.maximum.at(commonest, distinct.text, distinct.count)
    twin = np.flatnonzero((words.code[1:] == words.code[:-1]) & (words.text[1:] == words.text[:-1]))
    capital, space = within(65, 90), (data == 32) | (data == 10)
    symbol = (data < 128) & ~within(48, 57) & ~capital & ~within(97, 122) & ~space & (data != 44) & (data != 46)
    line = np.concatenate([[0], np.cumsum(data == 10)])[words.start] + words.text if len(words.start) else words.text
    begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else line
    line_code = np.add.reduceat(words.code, begin) if len(line) else words.code
    lines = bags(words.text[begin], line_code)
    line_count = np.maximum(np.bincount(words.text[begin], minlength=n), 1)
    return np.stack([
        np.log1p(count), np.bincount(words.text, words.end - words.start, n) / some, share(symbol), share(within(48, 57)), share(capital),
        share(data >= 128), np.bincount(distinct.text, minlength=n) / some, commonest / some, np.bincount(words.text[twin], minlength=n) / some,
        np.bincount(lines.text, minlength=n) / line_count, share(data == 124), share(data == 33), share(data == 10),
    ], axis=1)


def _expanded(x: np.ndarray) -> np.ndarray:
    """Statistics, their squares and a constant."""
    return np.concatenate([x, x * x, np.ones((len(x), 1))], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and deviation of the statistics and the weights, by Newton's method."""
    mean, deviation = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = _expanded(np.clip((x - mean) / deviation, -5, 5))
    weights = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        slope = z.T @ (y - p) - ridge * len(y) * weights
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.eye(len(weights)), slope)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, deviation, weights


def _measured(rows: DataFrame) -> DataFrame:
    def look(batches):
        for batch in batches:
            for part in chunks(batch):
                flat = features_of(part).ravel()
                places = pa.array(np.arange(len(part) + 1) * len(FEATURES), pa.int32())
                yield pa.RecordBatch.from_pydict({
                    **{c: part.column(c) for c in ("doc_id", "host", "path")}, "x": pa.ListArray.from_arrays(places, pa.array(flat)),
                })

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "host", "path", "text").mapInArrow(look, f"doc_id {kind}, host string, path string, x array<double>")


def _log_odds(p: Column) -> Column:
    bounded = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(bounded / (1 - bounded))


def _strength(groups: DataFrame, prior: str) -> float:
    """Documents a prior counts for, from groups (n, total, prior): moments of the spread of their means."""
    mean = F.col("total") / F.col("n")
    row = groups.where("n > 1").agg(
        F.sum(F.col("n") * (mean - F.col(prior)) ** 2), F.sum(F.col(prior) * (1 - F.col(prior))),
        F.sum(F.col("n") * F.col(prior) * (1 - F.col(prior))),
    ).first()
    spread, chance, full = (float(v or 0.0) for v in row)
    low, high = STRENGTHS
    beyond = spread - chance
    if full <= chance or beyond <= 0:
        return high
    between = beyond / (full - chance)  # share of the variance that lies between the groups
    return min(high, max(low, (1 - between) / between if between < 1 else low))


def judged(documents: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """One row per document: doc_id, p_text, host_mean, path_mean, quality (0 to 1), keep."""
    rows = documents.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.least(F.greatest(F.min("quality"), F.lit(0)), F.lit(1)).cast("double").alias("label")
    )
    measured = _measured(rows)
    measured = keep(measured.join(known, F.col("doc_id") == F.col("label_id"), "left").drop("label_id"), "features")
    total, good = measured.agg(F.count("label"), F.sum("label")).first()
    share = min(1.0, LABELLED / max(total, 1))
    sample = measured.where(F.col("label").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30))).select("x", "label")
    table = sample.toArrow()
    y = table.column("label").to_numpy() if table.num_rows else np.zeros(0)
    usual = good / total if total else 0.5
    if 0 < y.sum() < len(y):
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), len(FEATURES))
        order = np.lexsort(np.concatenate([x.T, y[None, :]]))  # the same sums on every run
        mean, deviation, weights = fit(x[order], y[order])
        k = len(FEATURES)
        z = [F.greatest(F.least((F.col("x")[i] - float(mean[i])) / float(deviation[i]), F.lit(5.0)), F.lit(-5.0)) for i in range(k)]
        measured = measured.withColumns({f"z{i}": z[i] for i in range(k)})
        score = F.lit(float(weights[-1]))
        for i in range(k):
            score = score + F.col(f"z{i}") * float(weights[i]) + F.col(f"z{i}") * F.col(f"z{i}") * float(weights[k + i])
        p_text = 1 / (1 + F.exp(-score))
    else:
        p_text = F.lit(float(usual))
    evidence = measured.select("doc_id", "host", "path", "label", p_text.alias("p_text")).withColumn("evidence", F.coalesce("label", "p_text"))
    paths = keep(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("total")), "site-paths")
    count, total = paths.agg(F.sum("n"), F.sum("total")).first()
    overall = float(total) / count if count else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).withColumn("prior", F.lit(overall))
    host_weight = _strength(hosts, "prior")
    host_means = hosts.select(
        F.col("host").alias("h_host"), F.col("n").alias("h_n"), F.col("total").alias("h_total"),
        ((F.col("total") + host_weight * overall) / (F.col("n") + host_weight)).alias("prior"),
    )
    sites = keep(paths.join(host_means, F.col("host").eqNullSafe(F.col("h_host"))), "sites")
    path_weight = _strength(sites, "prior")
    sites = sites.select(F.col("host").alias("s_host"), F.col("path").alias("s_path"), "n", "total", "h_n", "h_total")
    same = F.col("host").eqNullSafe(F.col("s_host")) & F.col("path").eqNullSafe(F.col("s_path"))
    own = F.col("evidence")
    joined = evidence.join(sites, same, "left")
    host_mean = (F.col("h_total") - own + host_weight * overall) / (F.col("h_n") - 1 + host_weight)
    path_mean = (F.col("total") - own + path_weight * F.col("host_mean")) / (F.col("n") - 1 + path_weight)
    joined = joined.withColumn("host_mean", host_mean).withColumn("path_mean", path_mean)
    odds = _log_odds(F.col("p_text")) + _log_odds(F.col("path_mean")) - _log_odds(F.lit(overall))
    return joined.select("doc_id", "p_text", "host_mean", "path_mean", (1 / (1 + F.exp(-odds))).alias("quality")).withColumn(
        "keep", F.col("quality") >= LEAST_QUALITY
    )
