"""Benchmark decontamination by suffix arrays over the training text.

Every task builds a word suffix array over each shard of whole documents it reads, and looks up every
suffix of the benchmark in it by binary search, one word deeper at a time.  The interval that is left
after ``k`` words holds all places of the shard where the suffix matches verbatim for ``k`` words; the
depth at which it becomes empty is the longest match.  Documents are never cut, so a document's matches
are complete within its shard and nothing is shuffled.

Only words the benchmark has can be part of a match.  Words outside its vocabulary end a suffix, and
runs of known words shorter than the shortest match looked for are left out of the array.

The benchmark is the query set.  It is read in blocks of at most ``BLOCK_WORDS`` words and each block is
broadcast, so what is sent has a fixed bound; further blocks are further passes in the same stage.

Nulls and odd input: a null text has no words, and an item without words matches nothing.  Items
without an id hit words but are not listed.  Equal rows each get a row of their own.  Empty tables give
no rows, or rows without hits.  Other columns of either table are ignored, except by ``decontaminate``,
which returns all columns of its input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relweave.llm.words import chunks, texts_of, words_of

#: Words of an item that must occur in a document one after the other.
WINDOW = 10
#: Words of the benchmark that are broadcast at once (8 bytes each, and their vocabulary).
BLOCK_WORDS = 2_000_000
#: Bytes of text in one suffix array.
SHARD_BYTES = 4 << 20


class Queries(NamedTuple):
    """A block of the benchmark: words as numbers from 1 on, a 0 after each item."""

    vocabulary: np.ndarray  # sorted word hashes
    words: np.ndarray
    item: np.ndarray  # number of the item of each word
    ids: list  # item_id as text, or None
    window: np.ndarray  # words that must match from each word on; 0: too few are left
    shortest: int
    longest: int


class Shard(NamedTuple):
    """Suffix array over the runs of known words of one shard."""

    words: np.ndarray  # known words, a 0 after each run
    place: np.ndarray  # number of each in the shard's words
    order: np.ndarray  # suffixes in order


def _block(rows: list[tuple], window: int) -> Queries:
    texts = pa.array([r[1] for r in rows], pa.large_string())
    found = words_of(texts_of(texts))
    vocabulary = np.unique(found.code)
    counts = np.diff(found.first)
    at = np.arange(len(found.code)) + found.text
    words = np.zeros(len(found.code) + len(rows), dtype=np.int32)
    words[at] = np.searchsorted(vocabulary, found.code) + 1
    item = np.repeat(np.arange(len(rows)), counts + 1)
    left = np.repeat(np.cumsum(counts + 1) - 1, counts + 1) - np.arange(len(words))
    wanted = np.repeat(np.minimum(counts, window), counts + 1)
    needed = np.where((left >= wanted) & (words > 0), wanted, 0)
    shortest = int(wanted[wanted > 0].min()) if (wanted > 0).any() else 0
    return Queries(vocabulary, words, item, [None if r[0] is None else str(r[0]) for r in rows], needed, shortest, int(counts.max(initial=0)))


def query_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Queries]:
    """The benchmark block by block; the driver holds one block at a time."""
    rows, held = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        size = len(row[1] or "") // 2 + 1
        if rows and held + size > block_words:
            yield _block(rows, window)
            rows, held = [], 0
        rows.append((row[0], row[1]))
        held += size
    if rows:
        yield _block(rows, window)


def build_shard(code: np.ndarray, text: np.ndarray, queries: Queries, shortest: int) -> Shard:
    """Sort the suffixes of the known words by prefix doubling, as deep as the longest item."""
    known = np.zeros(len(code), dtype=np.int32)
    if len(queries.vocabulary) and len(code):
        near = np.minimum(np.searchsorted(queries.vocabulary, code), len(queries.vocabulary) - 1)
        known = np.where(queries.vocabulary[near] == code, near + 1, 0).astype(np.int32)
    breaks = np.flatnonzero((known[1:] == 0) | (known[:-1] == 0) | (text[1:] != text[:-1])) + 1
    begin = np.concatenate([[0], breaks]).astype(np.int64)
    size = np.diff(np.concatenate([begin, [len(known)]]))
    good = (size >= max(shortest, 1)) & (known[begin] > 0) if len(known) else np.zeros(len(begin), dtype=bool)
    begin, size = begin[good], size[good]
    total = int(size.sum()) + len(size)
    words, place = np.zeros(total, dtype=np.int32), np.full(total, -1, dtype=np.int64)
    run = np.repeat(np.arange(len(size)), size)
    inner = np.arange(int(size.sum()))
    source = np.repeat(begin - (np.cumsum(size) - size), size) + inner
    words[inner + run], place[inner + run] = known[source], source
    rank, depth = words.astype(np.int64), 1
    while depth < queries.longest and total:
        later = np.zeros(total, dtype=np.int64)
        later[: max(total - depth, 0)] = rank[depth:]
        pair = np.where(words > 0, rank * (int(rank.max()) + 1) + later, 0)
        values, fresh = np.unique(pair, return_inverse=True)
        fresh = fresh.astype(np.int64) + (0 if values[0] == 0 else 1)
        if int(fresh.max()) == int((words > 0).sum()):
            rank = fresh
            break
        rank, depth = fresh, depth * 2
    order = np.argsort(rank, kind="stable")
    return Shard(words, place, order[words[order] > 0])


def search(shard: Shard, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Binary search of every suffix of the block.

    Returns the interval of each suffix after its window (empty if it has none), the length of its
    longest match, and the interval of that.
    """
    n, suffixes = len(shard.order), len(queries.words)
    low, high = np.zeros(suffixes, dtype=np.int64), np.full(suffixes, n, dtype=np.int64)
    window_low, window_high = np.zeros(suffixes, dtype=np.int64), np.zeros(suffixes, dtype=np.int64)
    length = np.zeros(suffixes, dtype=np.int64)
    active, depth = np.flatnonzero(queries.words > 0), 0
    column = np.concatenate([shard.words, np.zeros(1, dtype=np.int32)])
    while len(active) and n:
        wanted = queries.words[active + depth]
        active, wanted = active[wanted > 0], wanted[wanted > 0]
        if not len(active):
            break
        lower = _bisect(column, shard.order, low[active], high[active], depth, wanted, False)
        upper = _bisect(column, shard.order, lower, high[active], depth, wanted, True)
        found = upper > lower
        active = active[found]
        low[active], high[active] = lower[found], upper[found]
        depth += 1
        length[active] = depth
        full = active[queries.window[active] == depth]
        window_low[full], window_high[full] = low[full], high[full]
    return window_low, window_high, length, low, high


def _bisect(column, order, low, high, depth, wanted, after: bool):
    low, high = low.copy(), high.copy()
    while True:
        going = np.flatnonzero(low < high)
        if not len(going):
            return low
        middle = (low[going] + high[going]) // 2
        here = column[np.minimum(order[middle] + depth, len(column) - 1)]
        right = here <= wanted[going] if after else here < wanted[going]
        low[going] = np.where(right, middle + 1, low[going])
        high[going] = np.where(right, high[going], middle)


def _hits(batch: pa.RecordBatch, queries: Queries) -> pa.RecordBatch:
    """Add a block's hit spans and items to those found so far."""
    found = words_of(texts_of(batch.column("text")))
    shard = build_shard(found.code, found.text, queries, queries.shortest)
    low, high, *_ = search(shard, queries)
    some = np.flatnonzero(high > low)
    spans: list[list[int]] = batch.column("spans").to_pylist()
    items: list[list[str]] = batch.column("items").to_pylist()
    if len(some):
        # Windows of several lengths can begin at one suffix of the shard; start and length tell the words.
        key = low[some] * (int(queries.window.max()) + 1) + queries.window[some]
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        owners: list[set] = [set() for _ in one]
        for suffix, group in zip(some.tolist(), which.tolist(), strict=True):
            if (name := queries.ids[queries.item[suffix]]) is not None:
                owners[group].add(name)
        hit = np.zeros(len(found.code) + 1, dtype=np.int64)
        listed: dict[int, set] = {}
        for group, suffix in enumerate(some[one].tolist()):
            where = shard.place[shard.order[low[suffix] : high[suffix]]]
            np.add.at(hit, where, 1)
            np.add.at(hit, where + int(queries.window[suffix]), -1)
            for doc in np.unique(found.text[where]).tolist():
                listed.setdefault(doc, set()).update(owners[group])
        covered = np.cumsum(hit[:-1]) > 0
        for doc in listed:
            begin, end = found.first[doc], found.first[doc + 1]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], covered[begin:end], [False]]).astype(np.int8)))
            spans[doc] = spans[doc] + edge.tolist()
            items[doc] = sorted(listed[doc].union(items[doc]))
    columns = {
        **{name: batch.column(name) for name in batch.schema.names},
        "n_words": pa.array(np.diff(found.first), pa.int64()),
        "spans": pa.array(spans, pa.list_(pa.int64())),
        "items": pa.array(items, pa.list_(pa.string())),
    }
    return pa.RecordBatch.from_pydict(columns)


def _covered(spans: list[int]) -> int:
    """Words under spans that may overlap (those of several blocks)."""
    total, reached = 0, 0
    for begin, end in sorted(zip(spans[::2], spans[1::2], strict=True)):
        total += max(0, end - max(begin, reached))
        reached = max(reached, end)
    return total


def _found(documents: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """Documents (doc_id, text and what else they have) with n_words, spans and items of all blocks."""
    spark = documents.sparkSession
    frame = documents.withColumns({
        "n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<long>"), "items": F.array().cast("array<string>"),
    })
    blocks = [spark.sparkContext.broadcast(tuple(b)) for b in query_blocks(benchmark, window, block_words)]
    for block in blocks or [spark.sparkContext.broadcast(tuple(_block([(None, None)], window)))]:
        def look(batches, block=block):
            queries = Queries(*block.value)
            for batch in batches:
                for shard in chunks(batch, limit=SHARD_BYTES):
                    yield _hits(shard, queries)

        frame = frame.mapInArrow(look, frame.schema)
    return frame


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = _found(documents.select("doc_id", "text"), benchmark, window, block_words)

    def count(batches):
        for batch in batches:
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            hits = [_covered(s) for s in spans]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "n_words": batch.column("n_words"),
                "n_hit": pa.array(hits, pa.int64()),
                "n_items": pa.array(map(len, items), pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items], pa.string()),
                "contaminated": pa.array([h > 0 for h in hits], pa.bool_()),
            })

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.drop("text").mapInArrow(
        count, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents no window of the benchmark occurs in, with all their columns."""
    columns = documents.columns
    packed = documents.select("text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    clean = _found(packed, benchmark, window, block_words).where("size(spans) = 0")
    return clean.select("row.*")


def longest_matches(documents: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """For every suffix of every item its longest verbatim match: item_id, item_word, n_words, doc_id, doc_word.

    Of several equally long matches the smallest doc_id, then the first word, is told.  Suffixes of
    which not even the first word occurs have no row.  Each shard sends one row for each suffix at most.
    """
    spark = documents.sparkSession
    frame = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for queries in query_blocks(benchmark, WINDOW, block_words):
        block = spark.sparkContext.broadcast(tuple(queries))

        def look(batches, block=block):
            queries = Queries(*block.value)
            for batch in batches:
                for shard in chunks(batch, limit=SHARD_BYTES):
                    yield _longest(shard, queries)

        parts.append(frame.mapInArrow(look, "item_id string, item_word long, n_words long, doc_id long, doc_word long"))
    if not parts:
        return spark.createDataFrame([], "item_id string, item_word long, n_words long, doc_id long, doc_word long")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    best = F.max_by(F.struct("n_words", "doc_id", "doc_word"), F.struct("n_words", -F.col("doc_id"), -F.col("doc_word")))
    return rows.groupBy("item_id", "item_word").agg(best.alias("b")).select("item_id", "item_word", "b.*")


def _longest(batch: pa.RecordBatch, queries: Queries) -> pa.RecordBatch:
    found = words_of(texts_of(batch.column("text")))
    ids = batch.column("doc_id").to_pylist()
    by_id = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, i))
    number = np.empty(len(ids), dtype=np.int64)
    number[by_id] = np.arange(len(ids))
    shard = build_shard(found.code, found.text, queries, 1)
    *_, length, low, high = search(shard, queries)
    some = np.flatnonzero(length > 0)
    place = shard.place[shard.order]
    key = number[found.text[place]] * (len(found.code) + 1) + place if len(place) else place
    pairs = np.stack([low[some], high[some]], axis=1).ravel()
    best = np.minimum.reduceat(np.append(key, np.iinfo(np.int64).max), pairs)[::2] if len(some) else np.zeros(0, np.int64)
    word = best % (len(found.code) + 1)
    doc = found.text[word] if len(some) else word
    item_start = np.concatenate([[0], np.flatnonzero(np.diff(queries.item)) + 1])
    return pa.RecordBatch.from_pydict({
        "item_id": pa.array([queries.ids[i] for i in queries.item[some].tolist()], pa.string()),
        "item_word": pa.array(some - item_start[queries.item[some]], pa.int64()),
        "n_words": pa.array(length[some], pa.int64()),
        "doc_id": pa.array([ids[d] for d in doc.tolist()], pa.int64()),
        "doc_word": pa.array(word - found.first[doc], pa.int64()),
    })
