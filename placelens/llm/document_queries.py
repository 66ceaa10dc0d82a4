"""Queries over documents whose operators SQL cannot express at this size."""

import public_tokenizers
from pyspark.sql import functions as F

from placelens.llm.decontamination import find_leaks
from placelens.llm.neighbours import nearest_neighbours
from placelens.llm.ngram_join import near_duplicates
from placelens.llm.piece_codec import ids_digest, piece_ids, read_model
from placelens.llm.quality import fit_quality, score_quality
from placelens.llm.registry import query, table
from placelens.llm.substring_dedup import dedup_passages
from placelens.llm.toxicity import fit_toxicity, score_toxicity


@query("op3_ngram_jaccard")
def ngram_jaccard(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85, count_links=False)
    return found.withColumnRenamed("id", "doc_id")


@query("op5_sentencepiece")
def sentencepiece_round_trip(spark, sf_dir):
    model = read_model(spark, public_tokenizers.path("piece_bpe_32k.model"))
    docs = piece_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded=True)
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        ids_digest().alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def remainder(modulus: int):
    """The remainder that says which labels may be learnt from."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def scored_rows(scored, held_out):
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_toxicity")
def toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return scored_rows(score_toxicity(docs, model), remainder(5) == 0)


@query("op6_quality")
def quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return scored_rows(score_quality(docs, model), remainder(3) == 1)


@query("op2_decontamination")
def decontamination(spark, sf_dir):
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


@query("op8_substring_dedup")
def substring_dedup(spark, sf_dir):
    kept = dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op7_cross_polytope")
def cross_polytope(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)
