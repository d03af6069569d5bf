"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("relweave")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster shares for intermediate data; a temporary one on a single machine."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
        configured = tempfile.mkdtemp(prefix="relweave-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        context.setCheckpointDir(configured)
    return configured


#: Codec of what is written; it takes about two thirds of the room of Spark's default.
COMPRESSION = "zstd"

#: Metadata of a column that says that rows are read by buckets of its values (and its name, since other columns are made from it), and by how many.
BUCKETED_BY, BUCKETS = "bucketed_by", "buckets"


def unmarked(schema: StructType) -> StructType:
    """The schema of a frame that is written in another layout than it was read from."""
    return StructType([StructField(f.name, f.dataType, f.nullable) for f in schema.fields])


class Stored:
    """A frame written as Parquet to the shared folder; its owner may remove it when all readers are done.

    Unlike a checkpoint it stays columnar, so every reader scans only the columns it needs, and a
    lost executor costs a re-read instead of the whole computation.  What nobody removes goes with
    the application's folder when the driver exits.
    """

    def __init__(self, df: DataFrame, name: str):
        self._spark = df.sparkSession
        self.path = f"{application_folder(self._spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", COMPRESSION).parquet(self.path)
        self.frame = self._spark.read.schema(unmarked(df.schema)).parquet(self.path)

    def remove(self) -> None:
        delete_folder(self._spark, self.path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Store a frame that several steps read, until the driver exits."""
    return Stored(df, name).frame


#: As many rows as a task groups in memory without spilling, with relations as wide as they get.
ROWS_PER_TASK = 200_000


def dealt(rows: DataFrame, keys: Sequence[str], *counted: DataFrame, joined: bool = False) -> DataFrame:
    """Rows dealt by keys into partitions of bounded size, by the number of rows of the counted frames (stored ones, so that counting reads
    no column).  Partitions merged by their compressed size, or grouped before the shuffle, grow with the input until they spill.

    What is ``joined`` by the keys is dealt in as many partitions as a join makes at least, or the join would deal it again.
    Rows that are read by buckets of one of the keys are dealt by it already, and groups and joins by the keys do not move them.
    """
    if any(buckets_of(rows, key) for key in keys):
        return rows
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions")) if joined else 1
    total = sum(frame.count() for frame in counted or (rows,))
    return rows.repartition(max(spark.sparkContext.defaultParallelism, least, -(-total // ROWS_PER_TASK)), *keys)


def buckets_of(rows: DataFrame, key: str) -> int | None:
    """How many buckets of a column's values the rows are read by, if they are."""
    metadata = rows.schema[key].metadata
    return metadata.get(BUCKETS) if metadata.get(BUCKETED_BY) == key else None


def dealt_like(rows: DataFrame, key: str, others: DataFrame, other_key: str) -> DataFrame:
    """Rows dealt as the buckets that the others are read by, if they are: a join by the two keys then moves the others no more."""
    count = buckets_of(others, other_key)
    return rows if count is None else rows.repartition(count, key)


_FOLDERS: dict[str, str] = {}


def application_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.applicationId not in _FOLDERS:
        folder = f"{shared_folder(spark)}/relweave-{context.applicationId}"
        _FOLDERS[context.applicationId] = folder
        atexit.register(_delete_at_exit, context._jvm, context._jsc.hadoopConfiguration(), folder)
    return _FOLDERS[context.applicationId]


def delete_folder(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    _delete(context._jvm, context._jsc.hadoopConfiguration(), path)


def _delete(jvm, configuration, path: str) -> None:
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(configuration).delete(folder, True)


def _delete_at_exit(jvm, configuration, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone, and nothing depends on the folder any more
        _delete(jvm, configuration, path)
