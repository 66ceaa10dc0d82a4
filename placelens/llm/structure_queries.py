"""Queries of conversation repair, packing and token alignment."""

import public_tokenizers
from pyspark.sql import functions as F

from placelens.llm.conversation_repair import repair_conversations, summarise_repairs
from placelens.llm.packing import pack, token_pieces
from placelens.llm.piece_codec import read_model
from placelens.llm.registry import query, table
from placelens.llm.storage import staged
from placelens.llm.token_alignment import align_tokens


def damaged(turns):
    """Turns as a faulty export leaves them, by a checksum of dialogue and turn number; nulls are one space there."""
    space = F.lit(" ")
    parts = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(parts[0], F.lit(":"), parts[1])) % 20
    rows = turns.withColumns({"kind": kind, "role": F.coalesce("role", space), "text": F.coalesce("text", space)}).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "role", "text")


@query("op11_conversation_repair")
def conversation_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    found = summarise_repairs(repair_conversations(damaged(turns))).withColumnRenamed("conv_id", "_conv")
    everyone = turns.select("conv_id").distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return everyone.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id",
        *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query("op12_best_fit_packing")
def best_fit_packing(spark, sf_dir):
    tokenizer = read_model(spark, public_tokenizers.path("word_bpe_49k.json"))
    pieces = staged(token_pieces(table(spark, sf_dir, "documents"), tokenizer, capacity=2048, with_ids=False), "pieces")
    return pack(pieces, capacity=2048).withColumnRenamed("id", "doc_id")


@query("op13_token_alignment")
def token_alignment(spark, sf_dir):
    a, b = (read_model(spark, public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = align_tokens(table(spark, sf_dir, "documents"), a, b, digest=True)
    return found.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})
