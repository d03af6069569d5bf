"""Language identification by unigrams of pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary: lower-case letter strings, with or without the space
before a word, and every single byte, so that any text can be segmented.  For each language the
probabilities of the pieces are learnt by expectation maximisation.  A word (a space and a run of
letters) is scored by the forward algorithm, which sums the probabilities of all its segmentations; a
text has the product over all its words.  Pieces do not span words, so equal words are scored once.

Learning takes documents with a language whose crc32(doc_id) mod 3 is not 1, at most about
``TEXTS_PER_LANGUAGE`` of each language, taken by a hash of their id.  Their words are counted by Spark,
and each round of learning is one job that returns a number for each language and piece; the driver
holds that table, whose size follows from the vocabulary.  All documents are scored, over whole texts.

Null texts and texts without letters get ``und`` with score 0.  Without any document to learn from all
are ``und``.  Of equally probable languages the first by name is told.  A document without an id counts
as held out.  Words over 255 bytes are scored in parts of 255.  Equal rows each get a row; an empty
table gives none; other columns are ignored, except by ``accept``, which returns all of its input.
"""

from __future__ import annotations

import base64
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from relweave.llm.tables import keep
from relweave.llm.words import IS_LETTER, LOWER, Texts, chunks, mix, running_sums, span_codes, texts_of, words_of

#: Vocabulary file: a piece in base64 and its rank on each line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Learning takes about this many documents of a language at most.
TEXTS_PER_LANGUAGE = 2_000
#: Rounds of expectation maximisation.
ROUNDS = 4
#: Longest piece in bytes.
PIECE_BYTES = 12
#: Longest part of a word that is scored at once, with its space.
PART_BYTES = 256
#: Pseudo-count of every piece in every language.
SMOOTHING = 0.1
#: Words whose scores a task keeps between batches.
REMEMBERED = 400_000
#: A document is rejected below this probability of its language.
LEAST_SCORE = 0.5

UNDETERMINED = "und"


class Model(NamedTuple):
    languages: list[str]
    codes: np.ndarray  # sorted hashes of the pieces
    logp: np.ndarray  # piece x language


class Pieces(NamedTuple):
    """Flat bytes of several words and the piece that ends at each byte with each length."""

    first: np.ndarray  # first byte of each word, longest word first
    length: np.ndarray
    piece: np.ndarray  # byte x length; -1: no piece


def vocabulary(path: str = VOCABULARY) -> np.ndarray:
    """Sorted hashes of the pieces used, read from the driver's file."""
    kept = {bytes([b]) for b in range(256) if IS_LETTER[b] or b == 32}
    with open(path, "rb") as lines:
        for line in lines:
            piece = base64.b64decode(line.split()[0])
            body = np.frombuffer(piece[1:] if piece[:1] == b" " else piece, dtype=np.uint8)
            if len(body) and len(piece) <= PIECE_BYTES and IS_LETTER[body].all() and (LOWER[body] == body).all():
                kept.add(piece)
    flat = np.frombuffer(b"".join(kept), dtype=np.uint8)
    length = np.array([len(p) for p in kept])
    end = np.cumsum(length)
    return np.unique(span_codes(flat, end - length, end))


def pieces_of(flat: np.ndarray, first: np.ndarray, length: np.ndarray, codes: np.ndarray) -> Pieces:
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    inner = np.empty(len(flat), dtype=np.int64)
    inner[np.repeat(first, length) + (np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length))] = (
        np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    )
    prepared = running_sums(flat)
    piece = np.full((len(flat), PIECE_BYTES), -1, dtype=np.int32)
    for size in range(1, PIECE_BYTES + 1):
        end = np.flatnonzero(inner >= size - 1) + 1
        code = span_codes(flat, end - size, end, prepared)
        near = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        piece[end - 1, size - 1] = np.where(codes[near] == code, near, -1)
    return Pieces(first, length, piece)


def forward(words: Pieces, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of every prefix of every word, summed over segmentations; where each word's rows start."""
    base = words.first + np.argsort(np.argsort(words.first))
    alpha = np.full((int(words.length.sum()) + len(base), logp.shape[1]), -np.inf)
    alpha[base] = 0
    for at in range(1, int(words.length.max(initial=0)) + 1):
        count = int(np.searchsorted(-words.length, -at, side="right"))
        ends = words.first[:count] + at - 1
        options = []
        for size in range(1, min(PIECE_BYTES, at) + 1):
            piece = words.piece[ends, size - 1]
            options.append(np.where((piece >= 0)[:, None], alpha[base[:count] + at - size] + logp[piece], -np.inf))
        stacked = np.stack(options)
        top = stacked.max(axis=0)
        alpha[base[:count] + at] = top + np.log(np.exp(stacked - top).sum(axis=0))
    return alpha, base


def expected_pieces(words: Pieces, logp: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece over all segmentations of the words, times their weights."""
    alpha, base = forward(words, logp)
    alpha = alpha[:, 0]
    mass = np.zeros(len(alpha))
    mass[base + words.length] = weight
    total = np.zeros(len(logp))
    for at in range(int(words.length.max(initial=0)), 0, -1):
        count = int(np.searchsorted(-words.length, -at, side="right"))
        ends = words.first[:count] + at - 1
        here = base[:count] + at
        for size in range(1, min(PIECE_BYTES, at) + 1):
            piece = words.piece[ends, size - 1]
            some = np.flatnonzero(piece >= 0)
            share = mass[here[some]] * np.exp(alpha[here[some] - size] + logp[piece[some], 0] - alpha[here[some]])
            mass[here[some] - size] += share
            total += np.bincount(piece[some], share, len(total))
    return total


class Letters(NamedTuple):
    """Distinct words of some texts, and which of them each place has."""

    flat: np.ndarray
    first: np.ndarray
    length: np.ndarray
    code: np.ndarray
    text: np.ndarray  # of each place
    word: np.ndarray  # of each place


def letters_of(texts: Texts) -> Letters:
    """The words of texts with a space before each, in parts of at most PART_BYTES."""
    found = words_of(texts, IS_LETTER)
    start, end, text = found.start, found.end, found.text
    code = found.code
    if len(start) and int((end - start).max()) > PART_BYTES - 1:
        parts = -(-(end - start) // (PART_BYTES - 1))
        which = np.repeat(np.arange(len(start)), parts)
        part = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, end = start[which] + part * (PART_BYTES - 1), end[which]
        end, text = np.minimum(end, start + PART_BYTES - 1), text[which]
        code = mix(span_codes(LOWER[texts.data], start, end))
    distinct, one, word = np.unique(code, return_index=True, return_inverse=True)
    begin, size = start[one], end[one] - start[one]
    length = size + 1
    first = np.cumsum(length) - length
    flat = np.full(int(length.sum()), 32, dtype=np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    flat[np.repeat(first + 1, size) + inner] = LOWER[texts.data[np.repeat(begin, size) + inner]]
    return Letters(flat, first, length, distinct, text, word)


def _scores(words: Letters, wanted: np.ndarray, model: Model, block: int = 20_000) -> np.ndarray:
    """Log probability of some of the distinct words in every language."""
    out = np.empty((len(wanted), len(model.languages)))
    for begin in range(0, len(wanted), block):
        some = wanted[begin : begin + block]
        length = words.length[some]
        first = np.cumsum(length) - length
        inner = np.arange(int(length.sum())) - np.repeat(first, length)
        pieces = pieces_of(words.flat[np.repeat(words.first[some], length) + inner], first, length, model.codes)
        alpha, base = forward(pieces, model.logp)
        order = np.argsort(-length, kind="stable")
        out[begin + order] = alpha[base + pieces.length]
    return out


class Scorer:
    """Log probabilities of texts in every language; remembers a bounded number of words."""

    def __init__(self, model: Model):
        self.model = model
        self.codes = np.zeros(0, dtype=np.uint64)
        self.scores = np.zeros((0, len(model.languages)))

    def __call__(self, texts: Texts) -> np.ndarray:
        words = letters_of(texts)
        known = np.searchsorted(self.codes, words.code)
        near = np.minimum(known, max(len(self.codes) - 1, 0))
        old = self.codes[near] == words.code if len(self.codes) else np.zeros(len(words.code), dtype=bool)
        scores = np.empty((len(words.code), len(self.model.languages)))
        scores[old] = self.scores[near[old]]
        new = np.flatnonzero(~old)
        scores[new] = _scores(words, new, self.model)
        if len(new) and len(self.codes) + len(new) <= REMEMBERED:
            codes = np.concatenate([self.codes, words.code[new]])
            order = np.argsort(codes)
            self.codes, self.scores = codes[order], np.concatenate([self.scores, scores[new]])[order]
        count = len(texts.offsets) - 1
        return np.stack([np.bincount(words.text, scores[words.word, k], count) for k in range(scores.shape[1])], axis=1)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learn(
    documents: DataFrame, vocabulary_path: str = VOCABULARY, texts_per_language: int = TEXTS_PER_LANGUAGE, rounds: int = ROUNDS
) -> Model:
    """Piece probabilities of each language, from documents that are not held out."""
    codes = vocabulary(vocabulary_path)
    usable = documents.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], codes, np.zeros((len(codes), 0)))
    share = F.lit(0.0)
    for name in languages:
        share = F.when(F.col("lang") == name, min(1.0, texts_per_language / sizes[name])).otherwise(share)
    # Another hash than the one of the fold, so that the two are independent.
    chosen = usable.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < share * (1 << 30))
    counts = keep(_word_counts(chosen.select("lang", "text")), "language-words")
    logp = np.full((len(codes), len(languages)), -np.log(len(codes)))
    for _ in range(rounds):
        logp = _improved(counts, languages, codes, logp)
    return Model(languages, codes, logp)


def _word_counts(rows: DataFrame) -> DataFrame:
    def count(batches):
        for batch in batches:
            for part in chunks(batch):
                words = letters_of(texts_of(part.column("text")))
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                lang = np.array([names.index(x) for x in langs])
                pair, n = np.unique(lang[words.text] * len(words.code) + words.word, return_counts=True)
                body = words.flat.tobytes()
                where = pair % max(len(words.code), 1)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([names[i] for i in pair // max(len(words.code), 1)], pa.string()),
                    "word": pa.array([body[a : a + m] for a, m in zip(words.first[where], words.length[where], strict=True)], pa.binary()),
                    "n": pa.array(n, pa.int64()),
                })

    return rows.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _improved(counts: DataFrame, languages: list[str], codes: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """One round: expected uses of the pieces, added up by Spark, as new probabilities."""
    now = counts.sparkSession.sparkContext.broadcast((codes, logp))

    def expect(batches):
        pieces, current = now.value
        total = np.zeros(current.shape)
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), dtype=object)
            for k, name in enumerate(languages):
                rows = np.flatnonzero(lang == name)
                for begin in range(0, len(rows), 20_000):
                    part = batch.take(pa.array(rows[begin : begin + 20_000]))
                    body = [w for w in part.column("word").to_pylist()]
                    length = np.array([len(w) for w in body])
                    words = pieces_of(np.frombuffer(b"".join(body), np.uint8), np.cumsum(length) - length, length, pieces)
                    weight = part.column("n").to_numpy()[np.argsort(-length, kind="stable")].astype(float)
                    total[:, k] += expected_pieces(words, current[:, k : k + 1], weight)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({
            "piece": pa.array(piece, pa.int32()), "lang": pa.array(lang, pa.int32()), "n": pa.array(total[piece, lang], pa.float64()),
        })

    rows = counts.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
    total = np.full(logp.shape, SMOOTHING)
    total[rows.column("piece").to_numpy(), rows.column("lang").to_numpy()] += rows.column("n").to_numpy()
    now.destroy()
    return np.log(total) - np.log(total.sum(axis=0))


def _judged(batch: pa.RecordBatch, scorer: Scorer) -> tuple[list[str], np.ndarray]:
    """Language and probability of every text of a batch."""
    texts = texts_of(batch.column("text"))
    n = len(texts.offsets) - 1
    ascii_letter = np.concatenate([[0], np.cumsum(IS_LETTER[texts.data] & (texts.data < 128))])
    lettered = ascii_letter[texts.offsets[1:]] > ascii_letter[texts.offsets[:-1]]
    for i in np.flatnonzero(~lettered & (np.diff(texts.offsets) > 0)).tolist():
        lettered[i] = any(c.isalpha() for c in batch.column("text")[i].as_py())
    names, score = [UNDETERMINED] * n, np.zeros(n)
    if scorer.model.languages:
        logs = scorer(texts)
        best = logs.argmax(axis=1)
        share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        names = [scorer.model.languages[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
        score = np.where(lettered, share, 0.0)
    return names, score


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    shared = documents.sparkSession.sparkContext.broadcast(tuple(model))
    rows = documents.select("doc_id", held_out().alias("held_out"), "text")

    def look(batches):
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            for part in chunks(batch):
                names, score = _judged(part, scorer)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "held_out": part.column("held_out"),
                    "lang_pred": pa.array(names, pa.string()), "score": pa.array(score, pa.float64()),
                })

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(look, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accept(documents: DataFrame, model: Model, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents, with all their columns, whose language can be told with at least ``least_score``."""
    shared = documents.sparkSession.sparkContext.broadcast(tuple(model))

    def look(batches):
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            for part in chunks(batch):
                names, score = _judged(part, scorer)
                yield part.filter(pa.array((np.array(names) != UNDETERMINED) & (score >= least_score)))

    return documents.mapInArrow(look, documents.schema)

