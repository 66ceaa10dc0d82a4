"""Line dedup over levelled sorted runs of line hashes. Built-in expressions only."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens.llm.storage import new_path, staged

LAST = 9223372036854775807
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


class LineRuns:
    """Known line hashes as sorted runs on levels, each with the first document that holds it.

    A run is a table bucketed and sorted by hash, so a batch joins it by merging
    sorted buckets, without moving the run. A batch adds its new hashes as a run of
    level 0; when a level has ``fanout`` runs they become one run of the next level.
    So each hash is rewritten once per level, and there are few runs to join.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root, self.name = new_path(spark, "line-runs"), f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.tables: list[str] = []

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _write(self, df: DataFrame) -> str:
        table = f"{self.name}_{len(self.tables)}"
        writer = df.write.format("parquet").bucketBy(self.buckets, "hash").sortBy("hash")
        writer.option("path", f"{self.root}/{len(self.tables)}").saveAsTable(table)
        self.tables.append(table)
        return table

    def unknown(self, hashes: DataFrame) -> DataFrame:
        """Rows of ``hashes`` (hash, owner) that no run holds: a merge anti join with every run."""
        for table in self.runs():
            hashes = hashes.join(self.spark.table(table).select("hash").hint("merge"), "hash", "left_anti")
        return hashes

    def add(self, hashes: DataFrame) -> None:
        """Adds hashes that are not known yet, and compacts full levels."""
        new, level = self._write(hashes), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            merged = self.spark.table(self.levels[level][0])
            for table in self.levels[level][1:]:
                merged = merged.unionByName(self.spark.table(table))
            new = self._write(merged)
            self.levels[level], level = [], level + 1

    def owners(self) -> DataFrame:
        """(hash, owner) of all runs; each hash is in one run."""
        tables = [self.spark.table(t).select("hash", "owner") for t in self.runs()]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def forget(self) -> None:
        """Drops the table names; files stay for readers of results not yet computed."""
        for table in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops every line that an earlier document also holds.

    Lines end at \\n. A line's key is without blanks at both ends and with A-Z in
    lower case; keys shorter than ``min_chars`` code points are left alone. Of a key
    in several documents, all lines go except those in the document of the smallest
    id, which keeps its own repeats. Returns all columns with the kept text, plus
    ``n_lines`` (before) and ``n_dropped``.

    Documents come in ``batches`` of rising id, so what a run knows is always from a
    smaller id. Null or empty text: one empty line. Rows with the same id are one
    document, of which each row loses only lines of its own: drops are kept by id and
    a hash of the text. Rows without an id are one document, which comes after all
    others. A null text stays null. An empty
    table gives an empty result. A line that is in very many documents is combined
    before its shuffle and its join is split by adaptive execution.
    """
    spark, columns = docs.sparkSession, [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    cuts = docs.select(F.percentile_approx(ident, [i / batches for i in range(1, batches)], 10000).alias("cuts")).first()["cuts"] if batches > 1 else []
    cuts = sorted(set(cuts or []))
    batch = sum(((F.col("_id") > c).cast("int") for c in cuts), F.lit(0))

    row = F.unhex(F.md5(F.coalesce(text_col, F.lit(""))))  # rows of equal id and text lose the same lines
    lines = docs.select(ident.alias("_id"), row.alias("_row"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line"))
    keys = lines.select("_id", "_row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    keys = keys.select("_id", "_row", "pos", F.unhex(F.md5("key")).alias("hash"), batch.alias("batch"))
    path = new_path(spark, "line-keys")
    keys.write.partitionBy("batch").parquet(path)
    keys = spark.read.schema(keys.schema).parquet(path)

    runs = LineRuns(spark, fanout)
    for b in range(len(cuts) + 1):
        own = keys.where(F.col("batch") == b).groupBy("hash").agg(F.min("_id").alias("owner"))
        runs.add(runs.unknown(own))
    gone = keys.join(runs.owners(), "hash").where(F.col("_id") != F.col("owner"))
    gone = gone.groupBy("_id", "_row").agg(F.collect_set("pos").alias("__llm_gone"))
    gone = staged(gone, "line-drops")
    runs.forget()

    # Drops grow with the input, so they are never broadcast, however few they are here.
    gone = gone.select(F.col("_id").alias("__llm_id"), F.col("_row").alias("__llm_row"), "__llm_gone")
    joined = docs.withColumn("__llm_id", ident).withColumn("__llm_row", row).join(gone.hint("merge"), ["__llm_id", "__llm_row"], "left")
    joined = joined.withColumn("__llm_parts", F.split(F.coalesce(text_col, F.lit("")), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__llm_parts") - 1), F.col("__llm_gone"))
    kept = F.array_join(F.transform(left, lambda i: F.col("__llm_parts")[i]), "\n")
    text = F.when(F.col("__llm_gone").isNull() | F.col(text_col).isNull(), F.col(text_col)).otherwise(kept)
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns],
        F.size("__llm_parts").cast("long").alias("n_lines"),
        F.coalesce(F.size("__llm_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
