"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums, so a batch of changes needs only its signed
differences: an insert adds a document's counts, a delete takes them away, a revision does both.  ``commit`` adds a
batch up by its keys, writes it aside and makes it count by renaming a small mark, named after the batch, into place: a
batch that is there already is not applied again, one of two writers wins, and a name used for other changes is refused.  A job that died
half-way leaves no mark and is simply run again.  ``totals`` adds the committed batches up, and ``compact`` folds them into one.

Counting is one pass over the texts in Arrow batches; what is shuffled is a row for each key and task.

A null text counts as a document without tokens.  Null sources and languages are keys of their own.  Equal rows count
each.  Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from relweave.llm.tables import keep
from relweave.llm.words import chunks
from relweave.session import application_folder, delete_folder
from relweave.sources.snapshot import Files

#: Vocabulary files of the tokenizers counted, by version; each line has a piece in base64 and its rank.
TOKENIZERS = {"byte-bpe-50k": "/opt/tokenizers/byte_bpe_50k.tiktoken"}
#: Fixed value: how the vocabulary's public tokenizer cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A version that needs no vocabulary: every byte of UTF-8 is a token.
BYTES = "utf8-bytes"
#: Bytes of text that are encoded as one piece of work.
PIECE_BYTES = 1 << 20

KEYS = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens")
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def counted(documents: DataFrame, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """One row for each document and tokenizer version: doc_id, source, lang, tokenizer, n_tokens."""
    vocabularies = {name: ranks_of(path) for name, path in (TOKENIZERS if tokenizers is None else tokenizers).items()}
    shared = documents.sparkSession.sparkContext.broadcast(vocabularies)

    def count(batches):
        import tiktoken

        encoders = {n: tiktoken.Encoding(n, pat_str=PATTERN, mergeable_ranks=r, special_tokens={}) for n, r in shared.value.items()}
        for batch in batches:
            for part in chunks(batch, limit=PIECE_BYTES):
                texts = [t or "" for t in part.column("text").to_pylist()]
                sizes = {name: [len(e.encode_ordinary(t)) for t in texts] for name, e in encoders.items()}
                sizes[BYTES] = [len(t.encode()) for t in texts]
                for name, n in sizes.items():
                    yield pa.RecordBatch.from_pydict({
                        **{c: part.column(c) for c in ("doc_id", "source", "lang")},
                        "tokenizer": pa.array([name] * len(texts), pa.string()), "n_tokens": pa.array(n, pa.int64()),
                    })

    rows = documents.select("doc_id", "source", "lang", "text")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(count, f"doc_id {kinds['doc_id']}, source {kinds['source']}, lang {kinds['lang']}, tokenizer string, n_tokens long")


def differences(inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """Signed sums by key of documents that came and went (frames of ``counted``); a revision is in both."""
    parts = [
        frame.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"))
        for frame, sign in ((inserted, 1), (deleted, -1)) if frame is not None
    ]
    rows = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


class Rollup:
    """Committed batches of signed sums in a folder of the shared store."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{application_folder(spark)}/token-rollup-{uuid.uuid4().hex}"
        self._files = Files(spark, self.folder)

    def _marks(self, kind: str) -> list[str]:
        return [name for name in self._files.names(self.folder) if name.startswith(f"{kind}-") and name.endswith(".json")]

    def _mark(self, name: str) -> dict:
        return json.loads(self._files.read(f"{self.folder}/{name}"))

    def _write(self, rows: DataFrame, name: str, **told) -> bool:
        """Write rows aside and make them count by renaming a mark into place; False if there is one of that name."""
        data = f"data/{uuid.uuid4().hex}"
        rows.select(*KEYS, *SUMS).write.parquet(f"{self.folder}/{data}")
        staged = f"{self.folder}/{data}/mark"
        self._files.write(staged, json.dumps({"data": data, **told}))
        if self._files.rename(staged, f"{self.folder}/{name}"):
            return True
        delete_folder(self.spark, f"{self.folder}/{data}")
        return False

    def batches(self) -> list[str]:
        """Marks of the committed batches, folded ones too."""
        return self._marks("batch")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was applied before.  A name that was used for other changes is refused."""
        name = f"batch-{hashlib.sha256(batch.encode()).hexdigest()}.json"
        changes = keep(changes.select(*KEYS, *SUMS), "token-changes")
        digest = _digest(changes)
        if name not in self.batches() and self._write(changes, name, digest=digest):
            return True
        if self._mark(name)["digest"] != digest:
            raise ValueError(f"batch {batch!r} was committed with other changes")
        return False

    def _base(self) -> tuple[int, dict]:
        """The newest fold of batches and its number; 0 if there is none."""
        numbers = [int(name[len("base-") : -len(".json")]) for name in self._marks("base")]
        if not numbers:
            return 0, {"batches": []}
        return max(numbers), self._mark(f"base-{max(numbers):012d}.json")

    def compact(self) -> bool:
        """Fold all committed batches into one frame of sums, so that totals read that and later ones; False if another was faster.

        The marks stay, so a folded batch is still known; so does the data of batches, for readers that began before.
        """
        number, _ = self._base()
        batches = self.batches()
        return self._write(self._sums(batches), f"base-{number + 1:012d}.json", batches=batches)

    def _sums(self, batches: list[str]) -> DataFrame:
        _, base = self._base()
        folders = [base["data"]] if "data" in base else []
        folders += [self._mark(name)["data"] for name in batches if name not in set(base["batches"])]
        if not folders:
            return self.spark.createDataFrame([], TOTALS)
        rows = self.spark.read.parquet(*[f"{self.folder}/{data}" for data in folders])
        return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all committed batches; keys whose documents all went are left out."""
        return self._sums(self.batches())


def _digest(changes: DataFrame) -> str:
    """Tells changes apart, whatever the order of their rows: one row for each key and batch is read."""
    line = F.xxhash64(F.to_json(F.struct(*KEYS, *SUMS), {"ignoreNullFields": "false"}))
    row = changes.agg(F.count(F.lit(1)), F.sum(line.cast("decimal(20,0)")), F.bit_xor(line)).first()
    return " ".join(str(v) for v in row)
