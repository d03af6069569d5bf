"""Exact deduplication of documents as a stream with keyed state on disk.

Two texts are equal when they are the same after every run of ``[\\x20\\x09-\\x0D]`` became one space.  Of equal
texts the row with the smallest doc_id stays.  Documents come as files of a Parquet table; every call of
``Deduplicator.update`` takes the files that came since the last one, so the table may grow for ever.

1. A stateless stream reads the new files and appends an arrival for each row: doc_id, content locator (file
   and row in it), SHA-256 of the normalised text.  The texts stay where they are.
2. A stateful stream groups the arrivals by digest.  Its state is the RocksDB store, on the executors' disks
   with changelogs in the checkpoint, has no watermark and so never expires: for each digest the smallest doc_id,
   that row's locator, and the number of rows.  Partial sums below the shuffle send one row for each task and
   digest, however hot it is.  A late row with a smaller id takes the place of the one that stayed.
3. ``rows`` reads the state as a table and joins it with the arrivals.  Every hit (a row whose digest another
   row has as well) is checked in full: the texts of hits and keepers are fetched by their locators and compared.
   The keeper of a large group is repeated for every ``ROWS_PER_COPY`` of its hits, so no group meets in one task.
4. Digests of which a check failed are grouped anew by their whole texts.

Everything is DataFrames and SQL functions: no Python runs on executors.  Both streams keep offsets and
commits in the folder, so a job that was cut off goes on where it stopped and takes no file twice.

A null text counts as empty.  A null doc_id comes after all others; if all rows of a group have none, keep_id is
null.  Among rows that share text and doc_id the first by locator stays, so exactly one row of a group does.  Every
row of the table gets a row, repeated ones too.  An empty table gives no rows.  Columns other than doc_id and text are
not read, whatever their names.  Files of the table are only ever added: one that is changed in place is not seen.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relweave.llm.tables import keep
from relweave.session import application_folder

#: Hits that are compared with one copy of their keeper's text.
ROWS_PER_COPY = 2_000
#: Bytes of the digest that keys the state.
DIGEST_BYTES = 32
#: New data taken by one micro-batch; a backlog is worked off batch by batch.
BATCH_BYTES = 256 << 30

_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Without this each partition of the state takes megabytes of disk in advance.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
}

_LOCATOR = ["file", "place"]


def normalised(text: str = "text") -> Column:
    """The text with every run of white space as one space; single spaces are not touched."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings that a stream takes over when it starts; the session's own come back afterwards."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


class Deduplicator:
    """Deduplication of a table that grows by files; its memory is the given folder, which executors must share."""

    def __init__(self, spark: SparkSession, folder: str, digest_bytes: int = DIGEST_BYTES, batch_bytes: int = BATCH_BYTES):
        self.spark, self.folder = spark, folder
        self.digest_bytes, self.batch_bytes = digest_bytes, batch_bytes

    def update(self, path: str) -> Deduplicator:
        """Take the files of the table at ``path`` that are new since the last call."""
        kind = self.spark.read.parquet(path).schema["doc_id"].dataType.simpleString()
        documents = self._stream(f"doc_id {kind}, text string", f"{path[:-1]}[{path[-1]}]")  # a pattern may also be a file
        arrivals = documents.select(
            "doc_id", *self._locator(), F.unhex(F.sha2(normalised(), 256)).alias("sha256")
        )
        self._run(arrivals.writeStream.format("parquet").outputMode("append").option("path", self._arrivals), "arrivals")
        first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", *_LOCATOR)
        state = (
            self._stream(arrivals.schema, self._arrivals)
            .groupBy(self._digest().alias("digest"))
            .agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
        )
        with _settings(self.spark, _STATE_CONF):
            self._run(state.writeStream.format("noop").outputMode("update"), "digests")
        self.path, self.kind = path, kind
        return self

    def state(self) -> DataFrame:
        """What the keyed state holds: digest, first (of the row that stays: doc_id, file, place), group_size."""
        stored = self.spark.read.format("statestore").load(f"{self.folder}/checkpoints/digests")
        fields = [F.col(part)[name] for part in ("key", "value") for name in stored.schema[part].dataType.names]
        return stored.select(*[field.alias(name) for field, name in zip(fields, ("digest", "first", "group_size"), strict=True)])

    def rows(self) -> DataFrame:
        """One row per document so far: doc_id, keep_id, group_size, kept, text_sha256."""
        state = self.state().select("digest", *[F.col(f"first.{c}").alias(f"keep_{c}") for c in ("doc_id", *_LOCATOR)], "group_size")
        arrived = self.spark.read.schema(f"doc_id {self.kind}, file string, place long, sha256 binary").parquet(self._arrivals)
        kept = (F.col("file") == F.col("keep_file")) & (F.col("place") == F.col("keep_place"))
        joined = arrived.withColumn("digest", self._digest()).join(state, "digest")
        found = keep(
            joined.select("doc_id", *_LOCATOR, "sha256", "digest", F.col("keep_doc_id").alias("keep_id"), "group_size", kept.alias("kept")), "arrived"
        )
        texts = self._texts(found.where("group_size > 1"))
        wrong = keep(self._differences(texts), "digest-collisions")
        if not wrong.isEmpty():
            found = self._by_text(found, texts, wrong)
        return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))

    @property
    def _arrivals(self) -> str:
        return f"{self.folder}/arrivals"

    def _digest(self) -> Column:
        return F.col("sha256") if self.digest_bytes == DIGEST_BYTES else F.expr(f"substring(sha256, 1, {self.digest_bytes})")

    @staticmethod
    def _locator() -> list[Column]:
        return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")]

    def _stream(self, schema, path: str) -> DataFrame:
        return self.spark.readStream.schema(schema).option("maxBytesPerTrigger", str(self.batch_bytes)).parquet(path)

    def _run(self, writer, name: str) -> None:
        writer.option("checkpointLocation", f"{self.folder}/checkpoints/{name}").trigger(availableNow=True).start().awaitTermination()

    def _texts(self, hits: DataFrame) -> DataFrame:
        """The hits with their normalised texts, read again from where the locators say."""
        documents = self.spark.read.schema("text string").parquet(self.path).select("text", *self._locator())
        return documents.join(hits, _LOCATOR).withColumn("text", normalised())

    def _differences(self, texts: DataFrame) -> DataFrame:
        """Digests of hits whose texts are not their keeper's."""
        copies = F.ceil(F.col("group_size") / ROWS_PER_COPY).cast("int")
        hits = texts.where("NOT kept").select("digest", "text", F.pmod(F.xxhash64(*_LOCATOR), copies).cast("int").alias("copy"))
        keepers = texts.where("kept").select(
            "digest", F.col("text").alias("keep_text"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("copy")
        )
        return hits.join(keepers, ["digest", "copy"]).where("text != keep_text").select("digest").distinct()

    def _by_text(self, found: DataFrame, texts: DataFrame, wrong: DataFrame) -> DataFrame:
        """The rows, with those of the given digests grouped by their whole texts."""
        some = keep(texts.join(wrong, "digest", "left_semi").select("doc_id", *_LOCATOR, "sha256", "digest", "text"), "collided-texts")
        first = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), *[F.col(c) for c in _LOCATOR])
        groups = some.groupBy("digest", "text").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size"))
        mended = some.join(groups, ["digest", "text"]).select(
            "doc_id", *_LOCATOR, "sha256", "digest", F.col("first.doc_id").alias("keep_id"), "group_size",
            ((F.col("file") == F.col("first.file")) & (F.col("place") == F.col("first.place"))).alias("kept"),
        )
        return found.join(wrong, "digest", "left_anti").select(mended.columns).union(mended)


def deduplicate(spark: SparkSession, path: str, **options) -> DataFrame:
    """``Deduplicator.rows`` of a table that is there as a whole, with a memory that goes when the driver exits."""
    return Deduplicator(spark, f"{application_folder(spark)}/exact-duplicates-{uuid.uuid4().hex}", **options).update(path).rows()
