"""Intermediate tables of the operators, in the folder the cluster shares."""

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def _own_root() -> str:
    return tempfile.mkdtemp(prefix="llm-")


def new_path(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a local session without one gets a temporary folder.

    On a cluster without that setting it raises, because executors do not see each other's disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own_root()
    return f"{root.rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to shared storage and reads it back: cuts lineage, survives lost executors.

    The table stands for all that led to it, so its shuffle files are deleted as soon
    as it is written. A job of many steps would else fill the executors' disks.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
