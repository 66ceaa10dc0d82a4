"""Session settings and the shared scratch folder."""

import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
VECTORS = "spark.sql.parquet.enableVectorizedReader"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def local_session(cores: int | str = "*", partitions: int = 8, name: str = "placelens") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def last_of_repeated_keys(spark: SparkSession):
    """JSON parsed to VARIANT by plans built inside takes the last value of a repeated key, as JSON parsers do.

    The setting is read when an expression is resolved, so it holds for these plans
    whenever they run, and for no others.
    """
    before = spark.conf.get(REPEATED_KEYS)
    spark.conf.set(REPEATED_KEYS, "true")
    try:
        yield
    finally:
        spark.conf.set(REPEATED_KEYS, before)


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for the jobs run inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="placelens-")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    Local sessions without one, as in tests, get a temporary folder. On a cluster its
    lack is an error, since executors do not see each other's disks.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/placelens/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Writes ``df`` to shared storage and reads it back.

    For results several jobs read whose plan is expensive. Unlike a cache it
    survives lost executors, and unlike a checkpoint later readers prune columns.
    Long texts take the least room with ``compression`` ``zstd``.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
