"""Near-duplicate documents by BagMinHash signatures of their multisets of word shingles.

Every shingle of a text has a weight, its number of occurrences.  Weights are discretised to whole
levels, and the levels of a shingle are grouped in dyadic blocks (1], (1, 2], (2, 4], (4, 8] ..  Each block
carries a Poisson process of points in time whose rate is the block's width; its points fall on one of the
signature's components and on one level of the block at random, all drawn from the shingle's hash.  A text
takes the points on levels up to its weight, and each component keeps the earliest one.  Two texts agree in
a component with a probability equal to their weighted Jaccard similarity.  Processes are followed only
until a time at which all components of the text are filled, so the work is about one draw for each
distinct shingle, whatever the weights and the size of the signature.

Signatures are cut in ``BANDS`` bands of ``ROWS`` components; texts that share a band are candidates.
Texts at similarity 0.8 share none with a chance of ``(1 - 0.8**ROWS)**BANDS``, below 3 in 100,000.  Every
candidate is verified on the whole multisets, so no link is below the threshold.

Equal word sequences are one class representative.  The members of a band's bucket are compared with one leader,
the member with the most company, and classes are joined; members outside the bucket's main class are then
compared with those members of other classes that an upper bound of their similarity allows.  So pairs inside
a class are not expanded, and no link between two classes that share a bucket is missed.  Large frames are always
joined by sorting, so that the plan is the same at every size.

Null texts and texts without words link with nothing.  Rows without an id are not compared: their class is
null and they are kept.  Rows that share an id count as one document; ``deduplicate``
keeps the one with the least text.  Empty tables give no rows; other
columns are ignored, except by ``deduplicate``, which returns all of its input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relweave.llm.shingles import Bags, bags, bags_of, overlaps, shingles_of
from relweave.llm.tables import keep
from relweave.llm.words import CHUNK_BYTES, chunks, mix, powers, texts_of, words_of
from relweave.operators.explore import smallest_reachable

#: Similarity of a link.
THRESHOLD = 0.8
BANDS = 20
ROWS = 4
#: A shingle of at most so many of the texts in question is rare; it only decides how pairs are found.
RARE = 20

_DRAW = np.uint64(0xA0761D6478BD642F)
_UNIT = 1.0 / (1 << 53)


def _unit(bits: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1]."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1) * _UNIT


def signatures(found: Bags, texts: int, components: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """BagMinHash signature of each text, and which texts have one."""
    sizes = np.bincount(found.text, found.count, texts)
    filled = sizes > 0
    earliest = np.full(texts * components, np.inf)
    point = np.zeros(texts * components, dtype=np.uint64)
    until = np.where(filled, components * (np.log(components) + 4) / np.maximum(sizes, 1), 0)
    pending = filled.copy()
    while pending.any():
        chosen = np.flatnonzero(pending[found.text])
        _draw(found.text[chosen], found.code[chosen], found.count[chosen], until, components, earliest, point)
        pending &= np.isinf(earliest.reshape(texts, components)).any(axis=1)
        until *= 2  # few: their points are drawn again, and more of them
    return point.reshape(texts, components), filled


def _draw(text, code, count, until, components, earliest, point) -> None:
    """Follow the process of every block of levels of every shingle until its text's time."""
    blocks = np.ceil(np.log2(count)).astype(np.int64) + 1
    which = np.repeat(np.arange(len(count)), blocks)
    block = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    text, weight = text[which], count[which]
    below = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    width = np.maximum(below, 1)
    seed = mix(code[which] + block.astype(np.uint64) * _DRAW)
    time = np.zeros(len(which))
    step = np.zeros(1, dtype=np.uint64)
    while len(seed):
        step += _DRAW
        bits = mix(seed + step)
        time = time - np.log(_unit(bits)) / width
        alive = np.flatnonzero(time <= until[text])
        seed, time, text, weight, below, width = (a[alive] for a in (seed, time, text, weight, below, width))
        bits = mix(bits[alive])
        level = below + 1 + (_unit(mix(bits)) * width).astype(np.int64) % width
        taken = np.flatnonzero(level <= weight)
        place = text[taken] * components + (bits[taken] % np.uint64(components)).astype(np.int64)
        np.minimum.at(earliest, place, time[taken])
        first = time[taken] == earliest[place]
        point[place[first]] = bits[taken][first]


def band_codes(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit code for each band of each signature."""
    parts = signature.reshape(len(signature), bands, rows)
    code = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(signature), 1), dtype=np.uint64)
    for k in range(rows):
        code = mix(code * powers(2)[1] + parts[:, :, k])
    return code


def _prints(rows: DataFrame) -> DataFrame:
    """doc_id, a 128-bit digest of the word sequence (null without words) and the band codes."""
    def look(batches):
        for batch in batches:
            for part in chunks(batch, limit=2 * CHUNK_BYTES):
                words = words_of(texts_of(part.column("text")))
                found = bags(*shingles_of(words))
                signature, filled = signatures(found, len(part))
                place = (np.arange(len(words.code)) - words.first[words.text]).astype(np.uint64)
                digest = np.zeros((len(part), 2), dtype=np.uint64)
                for k in range(2):
                    np.add.at(digest[:, k], words.text, mix(words.code + place * _DRAW + np.uint64(k)))
                bands = band_codes(signature).view(np.int64)
                width = bands.shape[1]
                places = np.arange(len(part) + 1, dtype=np.int32) * width
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "digest": pa.array([d.tobytes() if ok else None for d, ok in zip(digest, filled.tolist(), strict=True)], pa.binary()),
                    "bands": pa.ListArray.from_arrays(places, pa.array(bands.ravel())),
                })

    return rows.mapInArrow(look, "doc_id long, digest binary, bands array<long>")


def _similar(threshold: float):
    """A filter of pairs (u, v, text, other) by the weighted Jaccard similarity of their multisets."""
    def look(batches):
        for batch in batches:
            for half in chunks(batch, "text", CHUNK_BYTES):
                for part in chunks(half, "other", CHUNK_BYTES):
                    left, right = (bags_of(texts_of(part.column(c))) for c in ("text", "other"))
                    yield part.select(["u", "v"]).filter(pa.array(overlaps(left, right, len(part)) >= threshold))

    return look


def _verified(pairs: DataFrame, texts: DataFrame, similar) -> DataFrame:
    """Those pairs (u, v) of nodes whose texts are similar."""
    sides = pairs.join(texts.select(F.col("node").alias("u"), "text").hint("merge"), "u").join(
        texts.select(F.col("node").alias("v"), F.col("text").alias("other")).hint("merge"), "v"
    )
    return sides.select("u", "v", "text", "other").mapInArrow(similar, "u long, v long")


def _pairs(left: str, right: str):
    return [F.least(left, right).alias("u"), F.greatest(left, right).alias("v")]


def _weighed(batches):
    """node, code, weight, total: the shingles of every text with their numbers, and the text's number of all."""
    for batch in batches:
        for part in chunks(batch):
            found = bags_of(texts_of(part.column("text")))
            yield weights_batch(part.column("node"), found)


def weights_batch(node: pa.Array, found: Bags) -> pa.RecordBatch:
    total = np.bincount(found.text, found.count, len(node)).astype(np.int64)
    return pa.RecordBatch.from_pydict({
        "node": node.take(pa.array(found.text)), "code": pa.array(found.code.view(np.int64)),
        "weight": pa.array(found.count, pa.int64()), "total": pa.array(total[found.text]),
    })


def linked_classes(live: DataFrame, texts: DataFrame, similar, weighed, threshold: float, more: DataFrame | None = None) -> DataFrame:
    """Classes (id, component) of the nodes of buckets (bucket, node), linked where their texts are similar.

    A bucket's leader is the member with the most company over all its buckets.  All members are compared
    with it, then those outside the bucket's main class with all members of other classes that they can be
    similar to (see ``_between_classes``).
    """
    company = live.join(live.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")), "bucket").groupBy("node").agg(F.sum("size").alias("company"))
    rank = F.struct("company", (-F.col("node")).alias("order"), "node")
    leaders = live.join(company, "node").groupBy("bucket").agg(F.max(rank).getField("node").alias("leader"))
    tried = keep(live.join(leaders, "bucket").where("node <> leader").select(*_pairs("node", "leader")).distinct(), "pairs")
    links = keep(_verified(tried, texts, similar), "links")
    known = links if more is None else links.union(more)
    rest = _between_classes(live, smallest_reachable(known), texts, weighed, threshold)
    rest = keep(rest.join(tried, ["u", "v"], "left_anti"), "other-pairs")
    return smallest_reachable(known.union(_verified(rest, texts, similar)))


def _between_classes(live: DataFrame, classes: DataFrame, texts: DataFrame, weighed, threshold: float) -> DataFrame:
    """Pairs (u, v) of nodes that share a bucket, in different classes, that may be similar.

    Distant copies of a common text meet in many buckets without being similar, so the members of mixed buckets
    are paired in two ways that lose no link.  Of a text with total weight n let m be the weight of the shingles
    another of these texts has, and c that of the shingles more than ``RARE`` of them have.

    * Texts that share a shingle of at most ``RARE`` texts: a join on the shingle makes RARE pairs for each at most.
      They share no more than the lesser m, so their similarity is at most m / (n + n' - m).
    * Texts that share none of those share no more than the lesser c.  One of the two lies outside the bucket's
      most frequent class, and only those are paired whose c is large enough for any text of the bucket.

    Both are bounds, not estimates.
    """
    members = live.join(classes.withColumnRenamed("id", "node"), "node", "left").select(
        "bucket", "node", F.coalesce("component", "node").alias("class")
    )
    main = members.groupBy("bucket").agg(F.mode("class", True).alias("main"), F.min("class").alias("low"), F.max("class").alias("high"))
    mixed = keep(members.join(main.where("low <> high").select("bucket", "main"), "bucket"), "mixed-buckets")
    chosen = texts.join(mixed.select("node").distinct().hint("merge"), "node", "left_semi")
    parts = keep(chosen.select("node", "text").mapInArrow(weighed, "node long, code long, weight long, total long"), "weights")
    counted = keep(parts.join(parts.groupBy("code").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").hint("merge"), "code"), "shared-weights")
    sums = counted.groupBy("node").agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("texts") > RARE, F.col("weight"))).alias("c"))
    none = F.lit(0)
    sizes = parts.select("node", F.col("total").alias("n")).distinct().join(sums, "node", "left").join(mixed.select("node", "class").distinct(), "node")
    sizes = keep(sizes.select("node", "class", "n", F.coalesce("m", none).alias("m"), F.coalesce("c", none).alias("c")), "weight-sums")

    def possible(shared):
        # A hair of tolerance, so that rounding excludes nothing.
        return (F.col("other_class") != F.col("class")) & (shared >= (threshold - 1e-9) * (F.col("n") + F.col("other_n") - shared))

    other_sizes = sizes.select(*[F.col(c).alias(f"other_{c}") for c in sizes.columns])
    rare = counted.where(F.col("texts") <= RARE).select("code", "node")
    meeting = rare.join(rare.select("code", F.col("node").alias("other_node")), "code").where("other_node < node").select("node", "other_node").distinct()
    first = meeting.join(sizes, "node").join(other_sizes, "other_node").where(possible(F.least("m", "other_m")))
    sized = mixed.select("bucket", "node", "main").join(sizes, "node")
    least = sized.groupBy("bucket").agg(F.min("n").alias("least"))
    largest = F.col("c") * (1 + 1 / threshold) - F.col("n")  # a text that is similar by c has no greater weight
    outside = sized.where("class <> main").join(least, "bucket").where(F.col("least") <= largest + 1e-6)
    outside = outside.select("bucket", *[F.col(c).alias(f"other_{c}") for c in sizes.columns])
    once = (F.col("class") == F.col("main")) | (F.col("other_node") < F.col("node"))
    second = outside.join(sized, "bucket").where(possible(F.least("c", "other_c")) & once)
    return first.select(*_pairs("node", "other_node")).union(second.select(*_pairs("node", "other_node"))).distinct()


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), kept."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = keep(_prints(rows), "prints")
    named = prints.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    copies = named.groupBy("digest").agg(F.min("doc_id").alias("node"))
    # The representative's bands only: those of its copies are equal.
    banded = named.join(copies, "digest").where("doc_id = node").select("node", F.explode("bands").alias("bucket")).distinct()
    crowded = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    live = keep(banded.join(crowded, "bucket", "left_semi"), "buckets")
    texts = keep(rows.withColumnRenamed("doc_id", "node").join(live.select("node").distinct().hint("merge"), "node", "left_semi"), "candidates")
    same_id = named.join(copies, "digest").where("doc_id <> node").select(F.col("node").alias("u"), F.col("doc_id").alias("v"))
    classes = linked_classes(live, texts, _similar(threshold), _weighed, threshold, same_id)
    classes = classes.withColumnRenamed("id", "doc_id").withColumnRenamed("component", "class_id")
    found = prints.select("doc_id").join(classes, "doc_id", "left")
    class_id = F.coalesce("class_id", "doc_id")
    return found.select("doc_id", class_id.alias("class_id"), F.coalesce(class_id == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicate(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class, the one with the smallest id, with all columns."""
    classes = near_duplicates(documents, threshold)
    gone = classes.where("NOT kept").select(F.col("doc_id").alias("gone_id")).distinct().hint("merge")
    left = documents.join(gone, documents["doc_id"].cast("long") == gone["gone_id"], "left_anti")
    repeated = keep(documents.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if not repeated.isEmpty():
        row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
        # The same choice on every run; an aggregate, so a hot id is one row for each task.
        order = F.struct("text", F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256))
        chosen = left.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, order).alias("row")).select("row.*")
        left = left.join(repeated, "doc_id", "left_anti").unionByName(chosen).select(*[F.col(f"`{c}`") for c in documents.columns])
    return left
