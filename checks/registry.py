"""Registered queries and their SQL twins."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES = {}
ORACLES = {}


class Tables:
    """The given parquet tables of one scale, as views for binding SQL."""

    NAMES = "region nation customer supplier part orders lineitem events documents pages conversations".split()

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, **views: DataFrame) -> DataFrame:
        for name in self.NAMES:
            if f" {name} " in f" {text} ".replace("\n", " "):
                self.table(name).createOrReplaceTempView(name)
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(text)

    def events(self) -> DataFrame:
        """Events with their time in epoch milliseconds, whatever the session time zone."""
        df = self.table("events")
        if isinstance(df.schema["ts"].dataType, T.TimestampNTZType):
            ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
        else:
            ms = F.unix_millis("ts")
        return df.withColumn("ms", ms)


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
