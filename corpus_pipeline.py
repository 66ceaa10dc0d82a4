"""Corpus preparation: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.
"""

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens.llm.decontamination import drop_leaks
from placelens.llm.line_dedup import dedup_lines
from placelens.llm.ngram_join import near_duplicates
from placelens.llm.piece_codec import piece_ids, read_model
from placelens.llm.quality import fit_quality, score_quality
from placelens.llm.storage import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None  # classifiers, alignment and piece encoding are beyond SQL


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier scores 0.5 or more. It learns from the labels of two thirds of the documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return score_quality(docs.select(*COLUMNS), model, score_col="quality_score").where("quality_score >= 0.5").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that an earlier document holds; a document that loses all of its text goes."""
    kept = dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_dropped") > 0) & (F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) == 0)
    return kept.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word shingles link at a similarity of 0.8: the one of the smallest id.

    Each row is decided on by itself, by its id and a hash of its text: a row without an id goes
    where another of its group has one. Rows of equal id and text share their fate.
    """
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.unhex(F.md5("text")).alias("row"))
    groups = near_duplicates(docs.select(key.alias("key"), "text"), words=5, percent=80, id_col="key", count_links=False)
    gone = groups.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("gone")).distinct()
    # Drops grow with the input, so they are never broadcast.
    kept = docs.select(*COLUMNS, key.alias("key")).join(staged(gone, "near-drops").hint("merge"), F.col("key").eqNullSafe(F.col("gone")), "left_anti")
    return kept.select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, copied or edited."""
    return drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds piece ids, their number, and whether they decode to the text."""
    model = read_model(spark, public_tokenizers.path("piece_bpe_32k.model"))
    out = piece_ids(docs.select(*COLUMNS), model, decoded=True)
    return out.select(
        *COLUMNS,
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
