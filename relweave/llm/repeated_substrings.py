"""Exact substring deduplication by external induced sorting.

A byte goes when it is covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller
id.  To find those strings their suffixes are sorted by induction: suffixes at sampled places (anchors) are
sorted directly, and the suffixes before them are induced one byte at a time by prepending the byte before,
with common-prefix lengths carried along (a new common prefix is one more than the least one between the two
suffixes in the order before).  As anchors serve the minimisers of all LENGTH-byte windows: the window's
``GRAM`` bytes with the least hash.  They play the part of the locally minimal suffixes of induced sorting, but
have no gap over ``LENGTH - GRAM + 1`` bytes, and equal windows have equal anchors, so equal windows always
meet and induction never goes deeper than that.

Steps, all in one Spark job:

1. Documents are dealt into shards of about ``SHARD_BYTES`` by id.  A shard sends a 31-bit code of each
   distinct anchor to the bucket of the anchor's hash, and learns which anchors are not its alone.
2. For those it sends the suffix tuples (bytes from the anchor on, bytes before it, smallest id in the
   shard), equal ones once, to the bucket.  Everything else is unique and goes no further.
3. A bucket feeds the tuples to a queue that keeps sorted runs on disk and merges them by a heap, and
   induces the orders of all windows of a batch of anchors.  It returns one bit for each window: is there a
   smaller id?  A hot anchor is sent once for each shard and distinct surroundings, not once for each document.
4. The shard marks the bytes.  Within a shard, a tuple's other documents have larger ids and lose its windows.

A null text counts as empty.  A document without an id comes after all others: it may lose bytes and takes
none from others.  Rows that share an id do not count against each other, and each gets a row.  Empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relweave.llm.words import Texts, chunks, mix, span_codes, texts_of

#: Bytes of a repeated string.
LENGTH = 50
#: Bytes of an anchor.
GRAM = 20
#: Bytes of text in a shard; there are as many buckets as shards.
SHARD_BYTES = 16 << 20
#: Suffix tuples in one sorted run, and in one block of a run in memory.
RUN_TUPLES = 200_000
BLOCK_TUPLES = 20_000

_REACH = LENGTH - GRAM
_LOW = np.uint64(0xFFFFFFFF)
_LAST_ID = np.iinfo(np.int64).max

TUPLE = np.dtype([
    ("right", f"S{LENGTH}"), ("left", f"S{_REACH + 1}"), ("low", "u1"), ("high", "u1"), ("id", "i8"), ("row", "i4"), ("bit", "i8"),
])


class Anchors(NamedTuple):
    """Anchors of several texts in order, and the windows each stands for."""

    code: np.ndarray
    place: np.ndarray
    first: np.ndarray  # first window start
    last: np.ndarray  # last window start
    text: np.ndarray


def anchors_of(texts: Texts, length: int = LENGTH, gram: int = GRAM) -> Anchors:
    data, offsets = texts
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    total = int(counts.sum())
    if not total:
        none = np.zeros(0, dtype=np.int64)
        return Anchors(none.astype(np.uint64), none, none, none, none)
    starts = np.arange(len(data) - gram + 1)
    code = span_codes(data, starts, starts + gram)
    least = (code & ~_LOW) | starts.astype(np.uint64)  # the leftmost of equal ones
    width, wanted = 1, length - gram + 1
    while width * 2 <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wanted:
        least = np.minimum(least[: len(least) - (wanted - width)], least[wanted - width :])
    begin = np.cumsum(counts) - counts
    text = np.repeat(np.arange(len(counts)), counts)
    start = np.arange(total) + np.repeat(offsets[:-1] - begin, counts)
    place = (least[start] & _LOW).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(fresh[1:], total) - 1
    return Anchors(code[place[fresh]], place[fresh], start[fresh], start[last], text[fresh])


class Shard:
    """Anchors and suffix tuples of a shard.  Orders follow from contents, not from the order of rows."""

    def __init__(self, rows: pa.Table, buckets: int):
        self.buckets = buckets
        self.ids, self.texts, parts, base = [], [], [], 0
        self.edges = [0]  # where the pieces of about CHUNK_BYTES begin that arrays of every byte or window are made for
        for batch in rows.combine_chunks().to_batches():
            for chunk in chunks(batch):
                texts = texts_of(chunk.column("text"))
                found = anchors_of(texts)
                self.ids.append(chunk.column("id").to_numpy(zero_copy_only=False))
                self.texts.append(texts)
                parts.append((found, base, sum(map(len, self.ids[:-1]))))
                base += len(texts.data)
                self.edges.append(base)
        fields = [
            np.concatenate([getattr(a, f) + shift for a, *shifts in parts for shift in [_shift(f, *shifts)]] or [np.zeros(0, np.int64)])
            for f in Anchors._fields
        ]
        self.anchors = Anchors(*fields)
        self.data = np.concatenate([t.data for t in self.texts] or [np.zeros(0, np.uint8)])
        self.id = np.concatenate(self.ids or [np.zeros(0, np.int64)])
        bucket = (mix(self.anchors.code) >> np.uint64(32)) % np.uint64(buckets)
        self.key = (bucket << np.uint64(32)) | (self.anchors.code & np.uint64(0xFFFFFFFE))
        self.keys, self.which = np.unique(self.key, return_inverse=True)

    def sent(self) -> Iterator[tuple[int, bytes]]:
        """For each bucket its distinct codes in order; the last bit says that two ids of the shard have it."""
        ids = self.id[self.anchors.text]
        low, high = np.full(len(self.keys), _LAST_ID), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, ids)
        np.maximum.at(high, self.which, ids)
        value = ((self.keys & _LOW) | (low != high).astype(np.uint64)).astype(np.uint32)
        for bucket, begin, end in _slices(self.keys >> np.uint64(32)):
            yield bucket, value[begin:end].tobytes()

    def answered(self, replies: dict[int, bytes]) -> np.ndarray:
        """Which anchors other documents have too."""
        shared = np.zeros(len(self.keys), dtype=bool)
        for bucket, begin, end in _slices(self.keys >> np.uint64(32)):
            shared[begin:end] = np.unpackbits(np.frombuffer(replies[bucket], np.uint8), count=end - begin)
        return shared[self.which]

    def tuples(self, replies: dict[int, bytes]) -> None:
        """Find the distinct suffix tuples of the shared anchors."""
        self.chosen = np.flatnonzero(self.answered(replies))
        a = self.anchors
        code = np.zeros(len(self.chosen), dtype=np.uint64)
        for begin, end, some in self._pieces():
            own = self.chosen[some]
            code[some] = span_codes(self.data[begin:end], a.first[own] - begin, a.last[own] + LENGTH - begin)
        order = np.lexsort((code, self.key[self.chosen] >> np.uint64(32)))
        bucket, code = (self.key[self.chosen] >> np.uint64(32))[order], code[order]
        fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])]) if len(order) else np.zeros(0, bool)
        self.tuple_of = np.empty(len(order), dtype=np.int64)
        self.tuple_of[order] = np.cumsum(fresh) - 1
        self.example = self.chosen[order[fresh]]
        self.bucket = bucket[fresh]
        self.smallest = np.full(len(self.example), _LAST_ID)
        np.minimum.at(self.smallest, self.tuple_of, self.id[a.text[self.chosen]])
        windows = a.last[self.example] - a.first[self.example] + 1
        self.bits = np.cumsum(windows) - windows
        self.windows = windows

    def _pieces(self) -> Iterator[tuple[int, int, slice]]:
        """First and last byte of each piece, and which of the chosen anchors stand for its windows."""
        at = np.searchsorted(self.anchors.first[self.chosen], self.edges)
        for k in range(len(self.edges) - 1):
            yield self.edges[k], self.edges[k + 1], slice(int(at[k]), int(at[k + 1]))

    def packed(self) -> Iterator[dict]:
        a = self.anchors
        for bucket, begin, end in _slices(self.bucket):
            some = self.example[begin:end]
            first, size = a.first[some], a.last[some] + LENGTH - a.first[some]
            inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            yield {
                "bucket": bucket, "n": end - begin,
                "size": size.astype(np.uint8).tobytes(), "high": (a.place[some] - first).astype(np.uint8).tobytes(),
                "ids": self.smallest[begin:end].tobytes(),
                "data": pa.Codec("zstd", 1).compress(self.data[np.repeat(first, size) + inner].tobytes(), asbytes=True),
                "raw": int(size.sum()),
            }

    def removed(self, replies: dict[int, bytes]) -> np.ndarray:
        """Which bytes of the shard go."""
        bits = np.zeros(int(self.windows.sum()), dtype=bool)
        for bucket, begin, end in _slices(self.bucket):
            low, high = self.bits[begin], self.bits[end - 1] + self.windows[end - 1]
            bits[low:high] = np.unpackbits(np.frombuffer(replies[bucket], np.uint8), count=high - low)
        a, out = self.anchors, np.zeros(len(self.data), dtype=bool)
        for begin, end, some in self._pieces():
            chosen, tuple_of = self.chosen[some], self.tuple_of[some]
            if not len(chosen):
                continue
            count = self.windows[tuple_of]
            inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            gone = bits[np.repeat(self.bits[tuple_of], count) + inner]
            gone |= np.repeat(self.id[a.text[chosen]] > self.smallest[tuple_of], count)
            start = (np.repeat(a.first[chosen] - begin, count) + inner)[gone]
            edge = np.bincount(start, minlength=end - begin + 1) - np.bincount(start + LENGTH, minlength=end - begin + 1)
            out[begin:end] = np.cumsum(edge[:-1]) > 0
        return out


def _shift(field: str, bytes_before: int, texts_before: int):
    return {"code": np.uint64(0), "text": texts_before}.get(field, bytes_before)


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Bucket, begin and end of each stretch of equal ones."""
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, int)
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(bucket[begin]), begin, end


class SuffixQueue:
    """Suffix tuples in, batches in suffix order out.  Full runs are sorted and kept on the task's disk."""

    def __init__(self, folder: str, run_tuples: int = RUN_TUPLES, block_tuples: int = BLOCK_TUPLES):
        self.folder, self.run_tuples, self.block_tuples = folder, run_tuples, block_tuples
        self.held: list[np.ndarray] = []
        self.runs: list[str] = []

    def push(self, tuples: np.ndarray) -> None:
        self.held.append(tuples)
        if sum(map(len, self.held)) >= self.run_tuples:
            run = np.concatenate(self.held)
            self.held = []
            self.runs.append(f"{self.folder}/{len(self.runs)}")
            run[np.argsort(run["right"], kind="stable")].tofile(self.runs[-1])

    def batches(self) -> Iterator[np.ndarray]:
        """Merge: everything up to the least last key of the blocks in memory is complete and goes out."""
        rest = np.concatenate(self.held) if self.held else np.zeros(0, TUPLE)
        sources = [self._blocks(run) for run in self.runs] + [iter([rest[np.argsort(rest["right"], kind="stable")]])]
        blocks: dict[int, np.ndarray] = {}
        heap: list[tuple[bytes, int]] = []

        def load(k: int) -> None:
            for block in sources[k]:
                if len(block):
                    blocks[k] = block
                    heapq.heappush(heap, (bytes(block["right"][-1]), k))
                    return

        for k in range(len(sources)):
            load(k)
        while heap:
            bound, k = heapq.heappop(heap)
            out = [blocks.pop(k)]
            for other, block in blocks.items():
                cut = int(np.searchsorted(block["right"], np.bytes_(bound), side="right"))
                out.append(block[:cut])
                blocks[other] = block[cut:]
            ready = np.concatenate(out)
            yield ready[np.argsort(ready["right"], kind="stable")]
            empty = [other for other, block in blocks.items() if not len(block)]
            for other in empty:
                del blocks[other]
            heap = [x for x in heap if x[1] in blocks]
            heapq.heapify(heap)
            for other in [k, *empty]:
                load(other)

    def _blocks(self, run: str) -> Iterator[np.ndarray]:
        with open(run, "rb") as file:
            while len(block := np.fromfile(file, TUPLE, self.block_tuples)):
                yield block


def _anchor_groups(queue: SuffixQueue) -> Iterator[np.ndarray]:
    """Batches in suffix order that hold all tuples of each of their anchors."""
    held: list[np.ndarray] = []
    for batch in queue.batches():
        grams = batch["right"].astype(f"S{GRAM}")
        ends = np.flatnonzero(grams[1:] != grams[:-1])
        if held and len(batch) and held[-1]["right"][-1][:GRAM] != batch["right"][0][:GRAM]:
            yield np.concatenate(held)
            held = []
        if len(ends):
            cut = int(ends[-1]) + 1
            yield np.concatenate([*held, batch[:cut]])
            held, batch = [], batch[cut:]
        if len(batch):
            held.append(batch)
    if held:
        yield np.concatenate(held)


def smaller_exists(tuples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits (row, bit) of those windows that a tuple with a smaller id has too, by induction from sorted suffixes."""
    n = len(tuples)
    right = tuples["right"].copy().view(np.uint8).reshape(n, LENGTH)
    left = tuples["left"].copy().view(np.uint8).reshape(n, _REACH + 1)
    size = LENGTH - tuples["low"].astype(np.int64)
    common = np.zeros(n, dtype=np.int64)
    differs = right[1:] != right[:-1]
    common[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH)
    common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
    order = np.arange(n)
    rows, bits = [], []
    for depth in range(_REACH + 1):
        begin = np.flatnonzero(common < LENGTH)
        own = tuples["id"][order]
        least = np.repeat(np.minimum.reduceat(own, begin), np.diff(np.append(begin, len(order)))) if len(begin) else own
        hit = order[(least < own) & (tuples["low"][order] <= depth)]
        rows.append(tuples["row"][hit])
        bits.append(tuples["bit"][hit] + tuples["high"][hit] - depth)
        # Induce the order of the suffixes that start one byte earlier.
        there = np.flatnonzero(tuples["high"][order] > depth)
        if not len(there):
            break
        byte = left[order[there], depth]
        by_byte = np.argsort(byte, kind="stable")
        position, byte = there[by_byte], byte[by_byte]
        # Tuples apart by less than the anchor never have a window in common.
        piece = np.cumsum(common < GRAM + depth)[position]
        near = np.flatnonzero((byte[1:] == byte[:-1]) & (piece[1:] == piece[:-1])) + 1
        longer = np.zeros(len(position), dtype=np.int64)
        if len(near):
            ranges = np.stack([position[near - 1] + 1, position[near] + 1], axis=1).ravel()
            longer[near] = 1 + np.minimum.reduceat(np.append(common, 0), ranges)[::2]
        order, common = order[position], longer
    return np.concatenate(rows), np.concatenate(bits)


def _unpacked(row: dict, number: int) -> tuple[np.ndarray, int]:
    """The suffix tuples of one message, and its number of windows."""
    size = np.frombuffer(row["size"], np.uint8).astype(np.int64)
    high = np.frombuffer(row["high"], np.uint8)
    data = np.frombuffer(pa.Codec("zstd").decompress(row["data"], row["raw"], asbytes=True), np.uint8)
    begin = np.cumsum(size) - size
    windows = size - LENGTH + 1
    out = np.zeros(row["n"], TUPLE)
    # Bytes plus one: no byte of UTF-8 is 255, and 0 fills up.
    for name, width, place in (
        ("right", LENGTH, (begin + high)[:, None] + np.arange(LENGTH)),
        ("left", _REACH + 1, (begin + high)[:, None] - 1 - np.arange(_REACH + 1)),
    ):
        inside = (place >= begin[:, None]) & (place < (begin + size)[:, None])
        letters = np.where(inside, data[np.clip(place, 0, len(data) - 1)] + np.uint8(1), np.uint8(0))
        out[name] = np.ascontiguousarray(letters).view(f"S{width}").ravel()
    out["high"], out["low"] = high, high - (windows - 1)
    out["id"] = np.frombuffer(row["ids"], np.int64)
    out["row"] = number
    out["bit"] = np.cumsum(windows) - windows
    return out, int(windows.sum())


def repeats(documents: DataFrame, shard_bytes: int = SHARD_BYTES, with_kept: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and if wanted kept (the remaining bytes)."""
    total = documents.select(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(total) // shard_bytes + 1
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID))
    dealt_by = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit("no id"))).otherwise(F.xxhash64(known))  # they take no bytes from others
    rows = documents.select("doc_id", known.alias("id"), "text", F.pmod(dealt_by, F.lit(shards)).alias("shard"))
    dealt = rows.groupBy("shard")

    def send(key, table):
        shard = Shard(table, shards)
        sent = list(shard.sent())
        return pa.table({
            "bucket": pa.array([b for b, _ in sent], pa.int64()), "shard": pa.array([key[0].as_py()] * len(sent), pa.int64()),
            "codes": pa.array([c for _, c in sent], pa.binary()),
        })

    def meet(key, table):
        shard = table.column("shard").to_pylist()
        codes = [np.frombuffer(c, np.uint32) for c in table.column("codes").to_pylist()]
        value = np.concatenate(codes)
        plain, which, count = np.unique(value >> np.uint32(1), return_inverse=True, return_counts=True)
        shared = count > 1
        shared[which[(value & np.uint32(1)) > 0]] = True
        answer = shared[which]
        ends = np.cumsum([len(c) for c in codes])
        bits = [np.packbits(answer[e - len(c) : e]).tobytes() for c, e in zip(codes, ends.tolist(), strict=True)]
        return _replies(shard, key[0].as_py(), bits, 1)

    known_anchors = dealt.applyInArrow(send, "bucket long, shard long, codes binary").groupBy("bucket").applyInArrow(meet, REPLY)

    def send_tuples(key, table, replies):
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in _MESSAGE})
        shard = Shard(table, shards)
        shard.tuples(_by_bucket(replies, 1))
        packed = [{"shard": key[0].as_py(), **p} for p in shard.packed()]
        return pa.table({n: pa.array([p[n] for p in packed], t) for n, t in _MESSAGE})

    def induce(key, table):
        with tempfile.TemporaryDirectory() as folder:
            queue = SuffixQueue(folder)
            sizes = []
            for number in range(table.num_rows):
                tuples, windows = _unpacked({c: table.column(c)[number].as_py() for c in table.column_names}, number)
                sizes.append(windows)
                queue.push(tuples)
            offset = np.cumsum([0, *sizes])
            bits = np.zeros(int(offset[-1]), dtype=bool)
            for batch in _anchor_groups(queue):
                row, bit = smaller_exists(batch)
                bits[offset[row] + bit] = True
        answers = [np.packbits(bits[offset[k] : offset[k + 1]]).tobytes() for k in range(len(sizes))]
        return _replies(table.column("shard").to_pylist(), key[0].as_py(), answers, 2)

    messages = dealt.cogroup(known_anchors.groupBy("shard")).applyInArrow(
        send_tuples, "shard long, bucket long, n long, size binary, high binary, ids binary, data binary, raw long"
    )
    found = messages.groupBy("bucket").applyInArrow(induce, REPLY)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(key, table, replies):
        shard = Shard(table, shards)
        shard.tuples(_by_bucket(replies, 1))
        done = _cut(table, shard, shard.removed(_by_bucket(replies, 2)), with_kept)
        return done if with_kept else done.drop_columns(["kept"])

    columns = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return dealt.cogroup(known_anchors.union(found).groupBy("shard")).applyInArrow(cut, columns)


REPLY = "shard long, bucket long, step int, bits binary"

_MESSAGE = [
    ("shard", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("size", pa.binary()), ("high", pa.binary()), ("ids", pa.binary()),
    ("data", pa.binary()), ("raw", pa.int64()),
]


def _replies(shards: list[int], bucket: int, bits: list[bytes], step: int) -> pa.Table:
    return pa.table({
        "shard": pa.array(shards, pa.int64()), "bucket": pa.array([bucket] * len(shards), pa.int64()),
        "step": pa.array([step] * len(shards), pa.int32()), "bits": pa.array(bits, pa.binary()),
    })


def _by_bucket(replies: pa.Table, step: int) -> dict[int, bytes]:
    rows = zip(*(replies.column(c).to_pylist() for c in ("step", "bucket", "bits")), strict=True)
    return {bucket: bits for of, bucket, bits in rows if of == step}


def _cut(table: pa.Table, shard: Shard, gone: np.ndarray, with_kept: bool) -> pa.Table:
    edges = np.cumsum([0, *(int(n) for t in shard.texts for n in np.diff(t.offsets))])
    kept, digests, removed, spans = [], [], [], []
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        out = gone[begin:end]
        rest = shard.data[begin:end][~out].tobytes()
        digests.append(hashlib.sha256(rest).hexdigest())
        kept.append(rest if with_kept else None)
        removed.append(int(out.sum()))
        spans.append(int((out[1:] & ~out[:-1]).sum()) + int(out[:1].sum()))
    ids = table.combine_chunks().column("doc_id")
    return pa.table({
        "doc_id": ids, "n_bytes": pa.array(np.diff(edges), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "n_spans": pa.array(spans, pa.int64()),
        "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept, pa.binary()),
    })
