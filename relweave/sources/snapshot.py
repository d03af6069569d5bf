"""Writing and reading a graph snapshot.

``write_snapshot`` exports parts to a folder.  ``commit_snapshot`` makes them the current version of a snapshot in one step: they go to
a fresh folder first, and a manifest, a small file with a running number, is renamed into place last.  Readers follow
the newest manifest, so they see a whole version or the one before; of two writers that claim one number, the file system lets
one rename succeed and the other is refused.  The manifest holds the fingerprint of what the version was made from, and readers that
expect another one are refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from relweave.functions.values import json_fields
from relweave.session import BUCKETED_BY, BUCKETS, COMPRESSION, delete_folder, unmarked

PARTS = ("table_nodes", "entity_nodes", "table_edges", "table_edge_support", "relations", "diagnostics", "warnings")
#: What ``relweave.operators.index_store`` commits in the same way.
INDEX_PARTS = ("postings", "vectors")


def public_json(df: DataFrame) -> DataFrame:
    """Every row as one JSON text with the types plain JSON would lose."""
    return df.select(json_fields(df.schema).alias("value"))


def legacy_json_value(df: DataFrame) -> DataFrame:
    """The older encoding: dates as ISO text, decimals as numbers, anything else as it is."""
    from pyspark.sql import types as T

    columns = []
    for field in df.schema.fields:
        column, dtype = F.col(field.name), field.dataType
        if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            fraction = F.date_format(column, "SSSSSS") != "000000"
            column = F.when(fraction, F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(
                F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
            )
        elif isinstance(dtype, T.DateType):
            column = column.cast("string")
        elif isinstance(dtype, T.DecimalType):
            column = column.cast("double")
        elif not isinstance(dtype, (T.NumericType, T.StringType, T.BooleanType)):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


@dataclass(frozen=True)
class Buckets:
    """A part in files by the value of a column, in an order: what groups and joins by the column moves no row of it.

    Its frame should be dealt by the column into as many partitions, so that a task writes one bucket.
    """

    count: int
    column: str
    order: tuple[str, ...]


def write_snapshot(parts: dict[str, DataFrame], path: str, format: str = "parquet", buckets: Mapping[str, Buckets] = {}) -> None:
    """One folder per part: Parquet for further queries, or compressed JSON lines in the public encoding."""
    for name, df in parts.items():
        if name not in PARTS + INDEX_PARTS:
            raise ValueError(f"unknown snapshot part {name}")
        if format == "json":
            public_json(df).write.mode("overwrite").option("compression", "gzip").text(f"{path}/{name}")
        elif name in buckets:
            of, writer = buckets[name], df.write.format(format).option("compression", COMPRESSION).option("path", f"{path}/{name}")
            writer.bucketBy(of.count, of.column).sortBy(*of.order).saveAsTable(_table(path, name))
        else:
            df.write.mode("overwrite").format(format).option("compression", COMPRESSION).save(f"{path}/{name}")


def _table(folder: str, part: str) -> str:
    """The name by which a session knows a part in buckets; the files are in the folder of the version."""
    return f"snapshot_{folder.rsplit('/', 1)[-1]}_{part}"


def read_snapshot(spark: SparkSession, path: str, format: str = "parquet") -> dict[str, DataFrame]:
    """The parts of a snapshot; columns added since it was written are absent and read as null."""
    return {name: spark.read.format(format).load(f"{path}/{name}") for name in PARTS}


class NoSnapshot(LookupError):
    """Nothing was committed to the folder yet."""


class StaleSnapshot(ValueError):
    """The current version was made from other data or metadata than the reader has."""


class LostCommit(RuntimeError):
    """Another writer committed first."""


@dataclass(frozen=True)
class Version:
    number: int
    folder: str
    format: str
    fingerprint: str
    schemas: dict[str, dict]
    buckets: dict[str, Buckets] = field(default_factory=dict)

    def parts(self, spark: SparkSession) -> dict[str, DataFrame]:
        """The parts with the schemas they were written with (texts, if they are JSON)."""
        reader = spark.read.format("text" if self.format == "json" else self.format)
        schemas = {name: "value string" if self.format == "json" else StructType.fromJson(s) for name, s in self.schemas.items()}
        return {
            name: self._by_bucket(spark, name, schema) if name in self.buckets else reader.schema(schema).load(f"{self.folder}/{name}")
            for name, schema in schemas.items()
        }

    def _by_bucket(self, spark: SparkSession, name: str, schema: StructType) -> DataFrame:
        of, table = self.buckets[name], _table(self.folder, name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING {self.format} CLUSTERED BY ({of.column}) SORTED BY ({', '.join(of.order)}) "
            f"INTO {of.count} BUCKETS LOCATION '{self.folder}/{name}'"
        )
        return spark.table(table).withMetadata(of.column, {BUCKETED_BY: of.column, BUCKETS: of.count})

    def remove(self, spark: SparkSession) -> None:
        _remove(spark, self.folder, self.buckets)


def _remove(spark: SparkSession, folder: str, buckets: Mapping[str, Buckets]) -> None:
    for name in buckets:
        spark.sql(f"DROP TABLE IF EXISTS {_table(folder, name)}")
    delete_folder(spark, folder)


class Files:
    """The few file operations of a commit, through the file system that Spark uses for the folder."""

    def __init__(self, spark: SparkSession, folder: str):
        context = spark.sparkContext
        self._jvm = context._jvm
        self._fs = self.path(folder).getFileSystem(context._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def write(self, name: str, text: str) -> None:
        stream = self._fs.create(self.path(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def make_folder(self, name: str) -> None:
        self._fs.mkdirs(self.path(name))

    def rename(self, old: str, new: str) -> bool:
        """Whether the file got the new name; it does not when there is one of that name."""
        target = self.path(new)
        return not self._fs.exists(target) and self._fs.rename(self.path(old), target)

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def states(self, name: str) -> list[str]:
        """Path, length and time of change of every file in a table's folder, or of the table that is one file."""
        found, files = [], self._fs.listFiles(self.path(name), True)
        while files.hasNext():
            status = files.next()
            found.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
        return sorted(found)


def _manifests(files: Files, path: str) -> list[int]:
    return [int(name[:-5]) for name in files.names(f"{path}/manifests") if name.endswith(".json") and name[:-5].isdigit()]


def current_version(spark: SparkSession, path: str) -> Version:
    files = Files(spark, path)
    numbers = _manifests(files, path)
    if not numbers:
        raise NoSnapshot(path)
    return _version(files, path, max(numbers))


def _version(files: Files, path: str, number: int) -> Version:
    manifest = json.loads(files.read(f"{path}/manifests/{number:012d}.json"))
    buckets = {name: Buckets(count, column, tuple(order)) for name, (count, column, order) in manifest.get("buckets", {}).items()}
    return Version(number, f"{path}/{manifest['folder']}", manifest["format"], manifest["fingerprint"], manifest["schemas"], buckets)


def commit_snapshot(
    spark: SparkSession, parts: dict[str, DataFrame], path: str, fingerprint: str, format: str = "parquet", buckets: Mapping[str, Buckets] = {}
) -> Version:
    """Make the parts the current version.  Whatever fails on the way, the version before stays current and readable."""
    files, name = Files(spark, path), f"versions/{uuid.uuid4().hex}"
    number = max(_manifests(files, path), default=0) + 1
    manifest = {
        "folder": name, "format": format, "fingerprint": fingerprint, "schemas": {part: unmarked(df.schema).jsonValue() for part, df in parts.items()},
        "buckets": {part: [of.count, of.column, of.order] for part, of in buckets.items()},
    }
    try:
        write_snapshot(parts, f"{path}/{name}", format, buckets)
        staged = f"{path}/{name}/manifest"
        files.write(staged, json.dumps(manifest, ensure_ascii=False))
        files.make_folder(f"{path}/manifests")
        if not files.rename(staged, f"{path}/manifests/{number:012d}.json"):
            raise LostCommit(f"version {number} of {path}")
    except BaseException:
        _remove(spark, f"{path}/{name}", buckets)
        raise
    return _version(files, path, number)


def open_snapshot(spark: SparkSession, path: str, fingerprint: str | None = None) -> dict[str, DataFrame]:
    """The parts of the current version; refused when it was not made from what the fingerprint stands for."""
    version = current_version(spark, path)
    if fingerprint is not None and version.fingerprint != fingerprint:
        raise StaleSnapshot(f"version {version.number} of {path} was made from {version.fingerprint}, not {fingerprint}")
    return version.parts(spark)


def remove_old_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Remove all but the newest versions, manifests first, and tell which went.  Readers of a removed one fail."""
    files = Files(spark, path)
    old = sorted(_manifests(files, path))[: -keep or None]
    for number in old:
        version = _version(files, path, number)
        delete_folder(spark, f"{path}/manifests/{number:012d}.json")
        version.remove(spark)
    return old


def tables_state(spark: SparkSession, paths: list[str]) -> list[str]:
    """What tells one state of stored tables from another: their files with lengths and times."""
    return [line for path in sorted(paths) for line in Files(spark, path).states(path)]
