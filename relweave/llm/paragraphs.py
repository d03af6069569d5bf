"""Substring deduplication of near-equal paragraphs by MinHash banding.

A paragraph is a line of a text with at least ``LEAST_WORDS`` words; shorter lines are left alone.  Its set of word
shingles has a MinHash signature, cut in bands that ``tuned`` chooses for the wanted recall.  Paragraphs that
share a band are candidates and are verified by their exact Jaccard similarity; classes are the connected
components of the links.  The first paragraph of a class, by document id and place, stays, the others go.

Equal paragraphs (the same words) are one node, so a passage that a third of all documents share is one row per
task before the first shuffle.  As with documents, a bucket's nodes are compared with one leader first, and
pairs inside a class are not expanded.

Lines say nothing about a passage inside a longer line or laid out in short ones.  So every run of
``PASSAGE_WORDS`` words, wherever the lines end, is a passage too: of equal passages the first one no word of
which went with a line stays, and all later ones are cut, also those that lost some lines already.  Only a
passage with an anchor (its run of ``PASSAGE_GRAM`` words with the least hash) that occurs again is looked at;
equal passages have equal anchors, so none is lost.  Passages are told apart by 64-bit hashes.  Inside one
document a passage that overlaps the first stays.

A null text has no paragraphs.  Rows with the same id and text count as one document; a document without an id
comes after all others.  Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from relweave.llm.near_duplicates import THRESHOLD, band_codes, linked_classes, weights_batch
from relweave.llm.repeated_substrings import anchors_of
from relweave.llm.shingles import bags, overlaps, shingles_of
from relweave.llm.tables import keep
from relweave.llm.words import CHUNK_BYTES, Texts, Words, chunks, mix, running_sums, span_codes, texts_of, words_of
from relweave.session import Stored

#: Words a paragraph needs to count.
LEAST_WORDS = 10
#: Wanted chance that a pair at the threshold shares a band, and the most bands for it.
RECALL = 0.999
MOST_BANDS = 10
#: Words of a passage that is cut wherever it stands, and of its anchor.
PASSAGE_WORDS = 50
PASSAGE_GRAM = 26

_SEED = np.uint64(0xE7037ED1A0B428DB)
_LAST_ID = (1 << 63) - 1


def tuned(threshold: float = THRESHOLD, recall: float = RECALL, most_bands: int = MOST_BANDS) -> tuple[int, int]:
    """Bands and rows: as many rows (few chance candidates) as the wanted recall allows with so many bands."""
    best = (most_bands, 1)
    for rows in range(1, 20):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands <= most_bands:
            best = (bands, rows)
    return best


def lines_of(texts: Texts) -> tuple[Texts, np.ndarray, np.ndarray]:
    """Every line as a text of its own, the text it is from, and its number there."""
    data, offsets = texts
    after = np.flatnonzero(data == 10) + 1
    starts = np.unique(np.concatenate([offsets, after]))
    starts = starts[starts < offsets[-1]]
    owner = np.searchsorted(offsets, starts, side="right") - 1
    number = np.arange(len(starts)) - np.searchsorted(owner, np.arange(len(offsets) - 1))[owner] if len(starts) else starts
    return Texts(data, np.append(starts, offsets[-1])), owner, number


def node_codes(words: Words) -> np.ndarray:
    """64-bit code of each text's word sequence."""
    place = (np.arange(len(words.code)) - words.first[words.text]).astype(np.uint64)
    code = np.zeros(len(words.first) - 1, dtype=np.uint64)
    np.add.at(code, words.text, mix(words.code + place * _SEED))
    return mix(code)


def minhashes(text: np.ndarray, code: np.ndarray, texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that have shingles, and their MinHash signatures."""
    order = np.argsort(text, kind="stable")
    text, code = text[order], code[order]
    some = np.unique(text)
    begin = np.searchsorted(text, some)
    out = np.empty((len(some), size), dtype=np.uint64)
    seeds = np.arange(1, size + 1, dtype=np.uint64) * _SEED
    for k in range(size if len(some) else 0):
        out[:, k] = np.minimum.reduceat(mix(code + seeds[k]), begin)
    return some, out


def _paragraphs(part: pa.RecordBatch):
    texts = texts_of(part.column("text"))
    lines, owner, number = lines_of(texts)
    words = words_of(lines)
    return lines, owner, number, words, np.flatnonzero(np.diff(words.first) >= LEAST_WORDS), node_codes(words).view(np.int64)


def _banded(rows: DataFrame, bands: int, size: int) -> DataFrame:
    """node, bucket: each once for every task's batch of texts."""
    def look(batches):
        for batch in batches:
            for part in chunks(batch):
                _, _, _, words, good, node = _paragraphs(part)
                _, one = np.unique(node[good], return_index=True)
                chosen = good[one]
                wanted = np.zeros(len(node), dtype=bool)
                wanted[chosen] = True
                text, code = shingles_of(words)
                inside = wanted[text]
                some, signature = minhashes(text[inside], code[inside], len(node), bands * size)
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array(np.repeat(node[some], bands)),
                    "bucket": pa.array(band_codes(signature, bands, size).view(np.int64).ravel()),
                })

    return rows.select("text").mapInArrow(look, "node long, bucket long")


def _occurrences(rows: DataFrame) -> DataFrame:
    """row, id, place, node of every paragraph."""
    def look(batches):
        for batch in batches:
            for part in chunks(batch):
                _, owner, number, _, good, node = _paragraphs(part)
                at = pa.array(owner[good])
                yield pa.RecordBatch.from_pydict({
                    "row": part.column("row").take(at), "id": part.column("id").take(at),
                    "place": pa.array(number[good], pa.int64()), "node": pa.array(node[good]),
                })

    return rows.select("row", "id", "text").mapInArrow(look, "row long, id long, place long, node long")


def _node_texts(rows: DataFrame) -> DataFrame:
    """node, text: each once for every task's batch of texts."""
    def look(batches):
        for batch in batches:
            for part in chunks(batch):
                lines, _, _, _, good, node = _paragraphs(part)
                _, one = np.unique(node[good], return_index=True)
                body, chosen = lines.data, good[one]
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array(node[chosen]),
                    "text": pa.array([body[lines.offsets[k] : lines.offsets[k + 1]].tobytes().decode() for k in chosen], pa.string()),
                })

    return rows.select("text").mapInArrow(look, "node long, text string")


def _similar(threshold: float):
    """Exact Jaccard similarity of the sets of shingles."""
    def look(batches):
        for batch in batches:
            for half in chunks(batch, "text", CHUNK_BYTES):
                for part in chunks(half, "other", CHUNK_BYTES):
                    sets = [bags(*shingles_of(words_of(texts_of(part.column(c))))) for c in ("text", "other")]
                    once = [s._replace(count=np.ones_like(s.count)) for s in sets]
                    yield part.select(["u", "v"]).filter(pa.array(overlaps(*once, len(part)) >= threshold))

    return look


def _weighed(batches):
    """The shingles of every paragraph, each once."""
    for batch in batches:
        for part in chunks(batch):
            found = bags(*shingles_of(words_of(texts_of(part.column("text")))))
            yield weights_batch(part.column("node"), found._replace(count=np.ones_like(found.count)))


def _anchors(words: Words):
    return anchors_of(Texts(words.code, words.first), PASSAGE_WORDS, PASSAGE_GRAM)


def _anchor_counts(batches):
    """Anchors of passages with their number in a batch of texts."""
    for batch in batches:
        for part in chunks(batch):
            code, n = np.unique(_anchors(words_of(texts_of(part.column("text")))).code, return_counts=True)
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(code.view(np.int64)), "n": pa.array(n, pa.int64())})


def _anchor_places(batches):
    """Anchors of passages with their text and their number there."""
    for batch in batches:
        for part in chunks(batch):
            found = _anchors(words_of(texts_of(part.column("text"))))
            number = np.arange(len(found.text)) - np.searchsorted(found.text, found.text)
            yield pa.RecordBatch.from_pydict({
                "anchor": pa.array(found.code.view(np.int64)), "row": part.column("row").take(pa.array(found.text)), "number": pa.array(number, pa.int32()),
            })


def _passages(batches):
    """Passages of the wanted anchors that lines have left a word of: bytes in the text, and whether it is whole."""
    for batch in batches:
        for part in chunks(batch):
            data, offsets = texts_of(part.column("text"))
            words = words_of(Texts(data, offsets))
            found = _anchors(words)
            base = np.searchsorted(found.text, np.arange(len(part)))
            wanted = np.unique(np.concatenate([np.asarray(x, np.int64) + base[i] for i, x in enumerate(part.column("numbers").to_pylist())]))
            size = found.last[wanted] - found.first[wanted] + 1
            start = np.arange(int(size.sum())) + np.repeat(found.first[wanted] - (np.cumsum(size) - size), size)
            breaks = np.flatnonzero(data == 10)
            line = np.searchsorted(breaks, words.start) - np.searchsorted(breaks, offsets[:-1])[words.text]
            lost = np.zeros(len(words.code) + 1, dtype=np.int64)
            for i, gone in enumerate(part.column("removed").to_pylist()):
                if gone:
                    inside = slice(words.first[i], words.first[i + 1])
                    lost[1:][inside] = np.isin(line[inside], gone)
            lost = np.cumsum(lost)
            without = lost[start + PASSAGE_WORDS] - lost[start]
            start, without = start[without < PASSAGE_WORDS], without[without < PASSAGE_WORDS]
            text = words.text[start]
            at = pa.array(text)
            yield pa.RecordBatch.from_pydict({
                "code": pa.array(span_codes(words.code, start, start + PASSAGE_WORDS, running_sums(words.code)).view(np.int64)),
                "id": part.column("id").take(at), "row": part.column("row").take(at),
                "begin": pa.array(words.start[start] - offsets[text]), "end": pa.array(words.end[start + PASSAGE_WORDS - 1] - offsets[text]),
                "whole": pa.array(without == 0),
            })


def _merged(batches):
    """The bytes under a text's passages: as many as there are stretches, and each as begin-end."""
    for batch in batches:
        cuts = []
        for spans in batch.column("spans").to_pylist():
            out: list[list[int]] = []
            for begin, end in sorted((x["begin"], x["end"]) for x in spans):
                if out and begin <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], end)
                else:
                    out.append([begin, end])
            cuts.append(out)
        yield pa.RecordBatch.from_pydict({
            "row": batch.column("row"), "n_cut": pa.array(map(len, cuts), pa.int64()),
            "cut": pa.array([",".join(f"{b}-{e}" for b, e in c) for c in cuts], pa.string()),
        })


def _cuts(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """row, n_cut, cut: the passages that go besides the lines that do."""
    texts = rows.select("row", "text")
    again = texts.select("text").mapInArrow(_anchor_counts, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    # Written first, so that a skewed join has a shuffle on both sides and can be split.
    again = keep(again.select("anchor"), "passage-anchors")
    places = texts.mapInArrow(_anchor_places, "anchor long, row long, number int").join(again, "anchor", "left_semi")
    numbers = places.groupBy("row").agg(F.collect_set("number").alias("numbers"))
    looked = rows.select("row", "id", "text").join(numbers, "row").join(gone, "row", "left").select("row", "id", "text", "numbers", "removed")
    passages = keep(looked.mapInArrow(_passages, "code long, id long, row long, begin long, end long, whole boolean"), "passages")
    first = F.min(F.when(F.col("whole"), F.struct("id", "row", "begin", "end")))
    firsts = keep(passages.groupBy("code").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"), "passage-firsts")
    later = (F.col("row") != F.col("first.row")) & (F.struct("id", "row") > F.struct("first.id", "first.row"))
    later = later | ((F.col("row") == F.col("first.row")) & (F.col("begin") >= F.col("first.end")))
    cut = passages.join(firsts, "code").where(later).select("row", "begin", "end")
    # A document's own passages only: as many as it has words at most.
    return cut.groupBy("row").agg(F.collect_set(F.struct("begin", "end")).alias("spans")).mapInArrow(_merged, "row long, n_cut long, cut string")


def _rows(documents: DataFrame, *columns) -> DataFrame:
    identity = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID))
    return documents.select("doc_id", identity.alias("id"), F.xxhash64("doc_id", "text").alias("row"), "text", *columns)


def _repeats(rows: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """By row: the paragraphs counted, the lines that go, the passages that go."""
    bands, size = tuned(threshold, recall)
    bands_of = Stored(_banded(rows, bands, size), "llm-paragraph-bands")
    # Dealt by bucket once, which a group and a join would not do; few rows of a task share a bucket.
    bucket = Window.partitionBy("bucket")
    crowded = bands_of.frame.select("bucket", "node", F.min("node").over(bucket).alias("low"), F.max("node").over(bucket).alias("high"))
    live = Stored(crowded.where("low <> high").select("bucket", "node").distinct(), "llm-paragraph-buckets")
    bands_of.remove()
    nodes = live.frame.select("node").distinct()
    texts = Stored(_node_texts(rows).join(nodes.hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "llm-paragraph-texts")
    linked = linked_classes(live.frame, texts.frame, _similar(threshold), _weighed, threshold)
    classes = linked.select(F.col("id").alias("node"), F.col("component").alias("class"))
    places = keep(_occurrences(rows), "paragraph-places")
    member = places.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    first = member.groupBy("class").agg(F.min(F.struct("id", "place", "row")).alias("first"), F.count(F.lit(1)).alias("size"))
    again = member.join(first.where("size > 1"), "class").where(F.struct("id", "place", "row") != F.col("first"))
    # A document's own paragraphs only: the list is as long as its text at most.
    gone = again.select("row", "place").distinct().groupBy("row").agg(F.array_sort(F.collect_list("place")).alias("removed"))
    gone = keep(gone, "paragraph-lines")
    # What only the classes were made from goes before the passages are written.
    for stored in (live, texts):
        stored.remove()
    counts = places.distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_paragraphs"))
    return counts, gone, _cuts(rows, gone)


def repeated_paragraphs(documents: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document.

    doc_id, n_paragraphs, n_removed, removed (numbers of the lines that go, from 0, comma-joined), n_cut, cut (the
    stretches of passages that go, as begin-end in bytes of the text, comma-joined; they may run into lines that go).
    """
    rows = _rows(documents)
    counts, gone, cuts = _repeats(rows, threshold, recall)
    found = rows.select("doc_id", "row").join(counts, "row", "left").join(gone, "row", "left").join(cuts, "row", "left")
    return found.select(
        "doc_id", F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed"),
        F.coalesce("n_cut", F.lit(0)).alias("n_cut"), F.coalesce("cut", F.lit("")).alias("cut"),
    )


def _left(text: str, removed: list[int], cut: str) -> str:
    data = text.encode()
    stays = np.ones(len(data) + 1, dtype=bool)
    for span in filter(None, cut.split(",")):
        begin, end = map(int, span.split("-"))
        stays[begin:end] = False
    out, at, joint, gone = [], 0, b"", set(removed)
    for number, line in enumerate(data.split(b"\n")):
        end = at + len(line)
        if number not in gone:
            out += [joint, np.frombuffer(line, np.uint8)[stays[at:end]].tobytes()]
            joint = b"\n" if stays[end] else b""
        at = end + 1
    return b"".join(out).decode()


def without_repeats(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with all columns; ``text`` lacks the paragraphs and passages that go, lines being joined again."""
    columns = [F.col(f"`{c}`") for c in documents.columns]
    rows = _rows(documents, F.struct(*columns).alias("document"))
    _, gone, cuts = _repeats(rows.drop("document"), threshold, RECALL)
    joined = rows.select("row", "text", "document").join(gone, "row", "left").join(cuts, "row", "left")
    joined = joined.select("document", "text", F.coalesce("removed", F.array().cast("array<long>")).alias("removed"), F.coalesce("cut", F.lit("")).alias("cut"))

    def look(batches):
        for batch in batches:
            told = zip(*(batch.column(c).to_pylist() for c in ("text", "removed", "cut")), strict=True)
            left = [t if t is None or not (r or c) else _left(t, r, c) for t, r, c in told]
            yield pa.RecordBatch.from_pydict({"document": batch.column("document"), "left": pa.array(left, pa.string())})

    kind = joined.schema["document"].dataType.simpleString()
    left = joined.mapInArrow(look, f"document {kind}, left string")
    return left.select(*[F.col("left").alias(c) if c == "text" else F.col(f"document.`{c}`") for c in documents.columns])
