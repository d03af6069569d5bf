"""Ranked lexical search by an exact sparse ball tree.

Terms are the runs of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]`` of whole texts after A-Z became a-z.  With N
documents that have terms, L terms in all, n in a document, df documents that hold a term and tf its occurrences in one,
a term weighs ``floor(1000 * ln((2N + 2) / (2df + 1)))`` and counts for a document that times
``(1000000000 * tf) div (1000 * tf + 20 * m)``, where m is ``50 + (50 * n * N) div L``.  The score of a document is the sum
over the distinct terms of an item: the inner product of two sparse vectors of integers.

1. The items' terms go to the executors in blocks of about ``BLOCK_TERMS`` (dealt by item), block after block.
2. Each document becomes its sparse vector of the block's terms, stored; statistics are sums over those.  Terms that no item
   has matter for n alone.
3. A task builds a ball tree for every ``SHARD_DOCUMENTS`` of its documents: nodes are halved along the line between
   two far documents.  A node has a centroid and, for every group of terms, a radius: how far a document of it lies
   above the centroid there (lying below it adds nothing, as no weight is negative).  By Cauchy and Schwarz no document of the
   node scores more than the centroid does plus, for each group, the radius times the item's norm in it.  The bound is
   rounded up beyond the error of its numbers.  One group of all terms is the plain ball, which excludes next to nothing among
   texts; each term is a group of its own unless told otherwise.
4. Each item walks the tree best-first and stops when the best bound left is below its ``k``-th score so far, which is
   carried from tree to tree.  Documents of leaves are scored in 64-bit integers.  Equal bounds are still opened, so ties go
   to the smaller doc_id.
5. The best ``k`` of each task meet in one ranking by item.

Nothing is capped: every document is in a tree, and only bounds exclude it.  Terms are told apart by 64-bit hashes (two differ and
collide with a chance of about 2**-64).

A null text has no terms.  Items without terms, and terms that no document has, find nothing.  Rows that share an item_id are one
item with the terms of all; rows that share a doc_id are ranked each for itself; a null doc_id comes last among equal
scores.  Very long texts are cut between terms and summed up.  Empty tables give no rows.  Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from relweave.llm.tables import keep
from relweave.llm.words import CHUNK_BYTES, IS_WORD, Texts, chunks, texts_of, words_of
from relweave.operators.ranking import top_k

#: Documents returned for each item.
TOP = 50
#: Terms of the items of one block: what is broadcast at once.
BLOCK_TERMS = 16_384
#: Documents of one tree, and of one leaf.
SHARD_DOCUMENTS = 8_192
LEAF_DOCUMENTS = 32

_NO_ID = np.iinfo(np.int64).max


class Statistics(NamedTuple):
    documents: int  # with a term
    terms: int  # of all documents
    weight: np.ndarray  # of each term of the block


class Items(NamedTuple):
    """A block of items; the terms of the i-th are ``term[first[i]:first[i + 1]]``, places in ``codes``."""

    ids: list
    codes: np.ndarray
    first: np.ndarray
    term: np.ndarray


class Vectors(NamedTuple):
    """Sparse vectors; the i-th has the entries ``first[i]:first[i + 1]``."""

    id: np.ndarray
    no_id: np.ndarray
    first: np.ndarray
    term: np.ndarray
    value: np.ndarray  # 64-bit integers


def pieces(batch: pa.RecordBatch, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, Texts]]:
    """The texts in pieces of bounded size, with the row of the first; a long text is cut between its terms."""
    row = 0
    for chunk in chunks(batch, limit=limit):
        texts = texts_of(chunk.column("text"))
        if chunk.num_rows > 1 or len(texts.data) <= limit:
            yield row, texts
        else:
            begin = 0
            while begin < len(texts.data):
                end = min(begin + limit, len(texts.data))
                while end < len(texts.data) and IS_WORD[texts.data[end]]:
                    end += 1
                yield row, Texts(texts.data[begin:end], np.array([0, end - begin]))
                begin = end
        row += chunk.num_rows


def item_terms(items: DataFrame) -> DataFrame:
    """The distinct terms of each item: item_id, code."""
    schema = StructType([items.schema["item_id"]]).add("code", "long")
    kind = to_arrow_type(items.schema["item_id"].dataType)

    def terms(batches):
        for batch in batches:
            ids = batch.column("item_id").cast(kind)
            for row, texts in pieces(batch):
                words = words_of(texts)
                for i in range(len(texts.offsets) - 1):
                    codes = np.unique(words.code[words.first[i] : words.first[i + 1]])
                    if len(codes):
                        yield pa.record_batch([ids.take(pa.array([row + i] * len(codes))), pa.array(codes.view(np.int64))], ["item_id", "code"])

    return items.select("item_id", F.col("text").cast("string").alias("text")).mapInArrow(terms, schema).distinct()


def _block(terms: DataFrame) -> Items:
    rows = terms.toArrow().combine_chunks()
    ids = rows.column("item_id").to_pylist()
    names = sorted(set(ids), key=lambda x: (x is None, x))
    number = {name: k for k, name in enumerate(names)}
    codes, term = np.unique(rows.column("code").to_numpy().view(np.uint64), return_inverse=True)
    item = np.array([number[i] for i in ids], dtype=np.int64)
    order = np.lexsort((term, item))
    return Items(names, codes, np.searchsorted(item[order], np.arange(len(names) + 1)), term[order])


def vectors(documents: DataFrame, codes: np.ndarray) -> DataFrame:
    """For each document doc_id, n (its terms), and the terms of the block it has with their occurrences."""
    spread = documents.sparkSession.sparkContext.broadcast(codes)

    def count(batches):
        known = spread.value
        for batch in batches:
            n = np.zeros(batch.num_rows, dtype=np.int64)
            keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row, texts in pieces(batch):
                words = words_of(texts)
                n[row : row + len(texts.offsets) - 1] += np.diff(words.first)
                place = np.minimum(np.searchsorted(known, words.code), len(known) - 1)
                hit = known[place] == words.code
                key, occurrences = np.unique((words.text[hit] + row) * len(known) + place[hit], return_counts=True)
                keys.append(key)
                counts.append(occurrences)
            key, which = np.unique(np.concatenate(keys), return_inverse=True)
            tf = np.bincount(which, np.concatenate(counts), len(key)).astype(np.int64)
            first = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * len(known)).astype(np.int32))
            yield pa.record_batch([
                batch.column("doc_id").cast(pa.int64()), pa.array(n),
                pa.ListArray.from_arrays(first, pa.array((key % len(known)).astype(np.int32))), pa.ListArray.from_arrays(first, pa.array(tf)),
            ], ["doc_id", "n", "terms", "tfs"])

    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def statistics(rows: DataFrame, n_terms: int) -> Statistics:
    """Sums over all vectors; one row for each term of the block comes back."""
    documents, terms = rows.select(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
    df = np.zeros(n_terms, dtype=np.int64)
    for row in held:
        df[row.term] = row.df
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df]
    return Statistics(documents, terms, np.array(weight, dtype=np.int64))


def scored(batch: pa.RecordBatch, known: Statistics) -> Vectors:
    """Vectors whose entries are what a term counts for a document."""
    n = batch.column("n").to_numpy()
    terms, tfs = batch.column("terms"), batch.column("tfs")
    first = terms.offsets.to_numpy().astype(np.int64)
    term = terms.values.to_numpy()[first[0] : first[-1]]
    tf = tfs.values.to_numpy()[tfs.offsets[0].as_py() : tfs.offsets[-1].as_py()]
    m = 50 + (50 * n * known.documents) // max(known.terms, 1)
    value = known.weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, np.diff(first))))
    ids = batch.column("doc_id")
    return Vectors(ids.fill_null(_NO_ID).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), first - first[0], term, value)


def _joined(parts: list[Vectors]) -> Vectors:
    shift = np.cumsum([0, *(len(p.term) for p in parts)])
    first = np.concatenate([p.first[:-1] + s for p, s in zip(parts, shift, strict=False)] + [shift[-1:]])
    return Vectors(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("id", "no_id")], first, *[np.concatenate([getattr(p, f) for p in parts]) for f in ("term", "value")])


def _picked(v: Vectors, rows: np.ndarray) -> Vectors:
    size = np.diff(v.first)[rows]
    first = np.concatenate([[0], np.cumsum(size)])
    entry = np.arange(first[-1]) + np.repeat(v.first[rows] - first[:-1], size)
    return Vectors(v.id[rows], v.no_id[rows], first, v.term[entry], v.value[entry])


def _sums(v: Vectors, entries: np.ndarray) -> np.ndarray:
    """Sum of the entries of each vector."""
    total = np.concatenate([[0], np.cumsum(entries)])
    return total[v.first[1:]] - total[v.first[:-1]]


class BallTree:
    """Documents in tree order; node i covers ``begin[i]:end[i]``, its children are 2i+1 and 2i+2 unless it is a leaf."""

    def __init__(self, v: Vectors, n_terms: int, leaf: int = LEAF_DOCUMENTS, groups: int | None = None):
        self.n_terms, self.groups = n_terms, max(1, min(groups or n_terms, n_terms))
        # No document of these terms alone: nothing can find it.
        v = _picked(v, np.flatnonzero(np.diff(v.first) > 0))
        depth = max(0, math.ceil(math.log2(max(len(v.id), 1) / leaf)))
        self.begin, self.end = np.zeros(2 ** (depth + 1) - 1, np.int64), np.zeros(2 ** (depth + 1) - 1, np.int64)
        self.end[0], self.leaves = len(v.id), 2**depth - 1
        for node in range(self.leaves):
            begin, end = self.begin[node], self.end[node]
            middle = (begin + end + 1) // 2
            self.begin[2 * node + 1 : 2 * node + 3], self.end[2 * node + 1 : 2 * node + 3] = (begin, middle), (middle, end)
        order = np.arange(len(v.id))
        for node in range(self.leaves):
            rows = order[self.begin[node] : self.end[node]]
            if len(rows) > 1:
                rows[:] = rows[np.argsort(self._side(_picked(v, rows)), kind="stable")]
        self.v = _picked(v, order)
        self._balls()

    def _side(self, v: Vectors) -> np.ndarray:
        """Where each vector lies between two that are far from each other."""
        value = v.value.astype(np.float64)
        norm = _sums(v, value**2)
        centre = np.bincount(v.term, value, self.n_terms) / len(v.id)
        away = norm - 2 * _sums(v, value * centre[v.term])
        one = self._distances(v, value, norm, int(away.argmax()))
        return one - self._distances(v, value, norm, int(one.argmax()))

    def _distances(self, v: Vectors, value: np.ndarray, norm: np.ndarray, row: int) -> np.ndarray:
        point = np.zeros(self.n_terms)
        point[v.term[v.first[row] : v.first[row + 1]]] = value[v.first[row] : v.first[row + 1]]
        return norm + norm[row] - 2 * _sums(v, value * point[v.term])

    def _balls(self) -> None:
        nodes, v = len(self.begin), self.v
        self.centre, self.radius = np.zeros((nodes, self.n_terms), np.float32), np.zeros((nodes, self.groups), np.float32)
        for node in range(nodes):
            begin, end = int(self.begin[node]), int(self.end[node])
            if begin == end:
                continue
            some = slice(int(v.first[begin]), int(v.first[end]))
            term, value = v.term[some], v.value[some].astype(np.float64)
            centre = (np.bincount(term, value, self.n_terms) / (end - begin)).astype(np.float32)
            above = np.maximum(value - centre[term], 0)
            if self.groups == self.n_terms:
                radius = np.zeros(self.groups)
                np.maximum.at(radius, term, above)
            else:
                row = np.repeat(np.arange(end - begin), np.diff(v.first[begin : end + 1]))
                cells = row * self.groups + term % self.groups
                radius = np.sqrt(np.bincount(cells, above**2, (end - begin) * self.groups).reshape(-1, self.groups).max(axis=0))
            self.centre[node] = centre
            self.radius[node] = np.nextafter(radius.astype(np.float32), np.float32(np.inf))

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """For each node a number that no score in it exceeds."""
        group, shared = np.unique(terms % self.groups, return_counts=True)
        at_most = self.centre[:, terms].sum(axis=1, dtype=np.float64) + self.radius[:, group] @ np.sqrt(shared)
        return np.where(self.begin < self.end, at_most * (1 + 1e-9) + 1, -1.0)

    def scores(self, leaf: int, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of a leaf's documents; ``wanted`` is 1 for the item's terms."""
        first = self.v.first[self.begin[leaf] : self.end[leaf] + 1]
        some = slice(int(first[0]), int(first[-1]))
        return np.add.reduceat(self.v.value[some] * wanted[self.v.term[some]], first[:-1] - first[0])

    def search(self, terms: np.ndarray, best: Best) -> int:
        """Take the documents that belong to the best; returns the number of leaves opened."""
        bound = self.bounds(terms)
        wanted = np.zeros(self.n_terms, dtype=np.int64)
        wanted[terms] = 1
        heap, opened = [(-bound[0], 0)], 0
        while heap and -heap[0][0] >= best.least:
            _, node = heapq.heappop(heap)
            if node >= self.leaves:
                rows = slice(self.begin[node], self.end[node])
                best.add(self.scores(node, wanted), self.v.id[rows], self.v.no_id[rows])
                opened += 1
            else:
                for child in (2 * node + 1, 2 * node + 2):
                    if bound[child] >= best.least:
                        heapq.heappush(heap, (-bound[child], child))
        return opened


class Best:
    """The best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.id, self.no_id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        good = score >= self.least
        if not good.any():
            return
        score, ids, no_id = (np.concatenate([old, new[good]]) for old, new in ((self.score, score), (self.id, ids), (self.no_id, no_id)))
        order = np.lexsort((ids, no_id, -score))[: self.k]
        self.score, self.id, self.no_id = score[order], ids[order], no_id[order]
        if len(order) == self.k:
            self.least = int(self.score[-1])


def shards(batches: Iterator[pa.RecordBatch], known: Statistics, documents: int = SHARD_DOCUMENTS) -> Iterator[Vectors]:
    held: list[Vectors] = []
    for batch in batches:
        for begin in range(0, batch.num_rows, documents):
            part = scored(batch.slice(begin, documents), known)
            if held and sum(len(p.id) for p in held) + len(part.id) > documents:
                yield _joined(held)
                held = []
            held.append(part)
    if held:
        yield _joined(held)


def _found(rows: DataFrame, block: Items, known: Statistics, k: int, item_id) -> DataFrame:
    """The best documents of each task for each item: item_id, doc_id, score."""
    spread = rows.sparkSession.sparkContext.broadcast((block, known))
    kind = to_arrow_type(item_id.dataType)

    def search(batches):
        items, stats = spread.value
        best = [Best(k) for _ in items.ids]
        for shard in shards(batches, stats):
            tree = BallTree(shard, len(items.codes))
            for i, mine in enumerate(best):
                tree.search(items.term[items.first[i] : items.first[i + 1]], mine)
        for name, mine in zip(items.ids, best, strict=True):
            if len(mine.score):
                yield pa.record_batch(
                    [pa.array([name] * len(mine.score), kind), pa.array(mine.id, mask=mine.no_id), pa.array(mine.score)], ["item_id", "doc_id", "score"]
                )

    return rows.mapInArrow(search, StructType([item_id]).add("doc_id", "long").add("score", "long"))


def ranked(documents: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of each item with a score above 0."""
    terms = keep(item_terms(items), "item-terms")
    item_id = items.schema["item_id"]
    blocks = terms.count() // block_terms + 1
    found = []
    for b in range(blocks):
        block = _block(terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b))
        if len(block.codes):
            rows = keep(vectors(documents, block.codes), "term-vectors")
            found.append(keep(_found(rows, block, statistics(rows, len(block.codes)), k, item_id), "lexical-hits"))
    if not found:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    best = top_k(hits, ["item_id"], [F.desc("score"), F.asc_nulls_last("doc_id")], k, "rank")
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
