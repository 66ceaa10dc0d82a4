"""Sharding by rendezvous hashing of stable record keys. Built-in expressions only."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from placelens.llm.storage import staged

HEX_DIGITS = 13  # 52 bits of the digest: exact in a double


def _height(key: Column, shard: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{shard}/"), key))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard of a key: each shard draws a number from the key, the highest weighted draw wins.

    A shard's draw depends on nothing but the key and the shard's own number, so a
    further shard takes rows only into itself, and a changed weight moves only rows
    into or out of that shard. Shards get shares in proportion to their weights.
    Ties go to the lower shard; shards of weight 0 get nothing. A null key is the
    empty text.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("at least one weight must be above 0")
    key = F.coalesce(key.cast("string"), F.lit(""))
    live = [(i, float(w)) for i, w in enumerate(weights) if w > 0]
    if len({w for _, w in live}) == 1:
        draws = [F.struct(_height(key, i).alias("draw"), F.lit(-i).alias("other")) for i, _ in live]
    else:
        # -ln(u) / w is exponential with rate w: the least of them falls to a shard with chance w / sum.
        u = [((_height(key, i) + F.lit(0.5)) / F.lit(float(16**HEX_DIGITS)), i, w) for i, w in live]
        draws = [F.struct((F.log(x) / F.lit(w)).alias("draw"), F.lit(-i).alias("other")) for x, i, w in u]
    best = F.greatest(*draws) if len(draws) > 1 else draws[0]
    return (-best["other"]).cast("int")


def shard_rows(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, blocks: int = 256) -> DataFrame:
    """Adds ``shard``, ``slot`` (gapless from 0 within the shard, in key order) and ``grown_shard``.

    ``grown`` are the weights after a change of the shard count; without it
    ``grown_shard`` is null. Slots are counted in ``blocks`` runs of the key order,
    so no task holds a whole shard; one row per shard and run meets to add up.
    Keys may be of any type that has an order and a text. Equal keys share a shard;
    their slots follow the other columns' order. A null key comes first. An empty table gives an empty result. Columns of the input
    keep their values; the three new names replace columns of the same name.
    """
    df = df.drop("shard", "slot", "grown_shard")
    others = [F.col(f"`{c}`") for c in df.columns if c != key]
    out = df.withColumn("shard", rendezvous(F.col(key), weights))
    out = out.withColumn("grown_shard", rendezvous(F.col(key), grown) if grown else F.lit(None).cast("int"))
    if isinstance(df.schema[key].dataType, T.NumericType):
        cuts = df.select(F.percentile_approx(F.col(key), [i / blocks for i in range(1, blocks)], 100 * blocks).alias("cuts")).first()["cuts"]
        cuts = sorted(set(cuts or []))
        run = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(key))) if cuts else F.lit(0)
        run = F.coalesce(run, F.lit(0))
    else:  # keys that have no quantiles: ranges of their order, from Spark's own sample
        out, run = out.repartitionByRange(blocks, F.col(key).asc_nulls_first()), F.spark_partition_id()
    out = staged(out.withColumn("__llm_run", run), "shards")
    counts = out.groupBy("shard", "__llm_run").agg(F.count("*").alias("__llm_n"))
    earlier = Window.partitionBy("shard").orderBy("__llm_run").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("shard", "__llm_run", F.coalesce(F.sum("__llm_n").over(earlier), F.lit(0)).alias("__llm_before"))
    order = [F.col(key).asc_nulls_first(), F.xxhash64(*others) if others else F.lit(0)]
    placed = out.withColumn("__llm_at", F.row_number().over(Window.partitionBy("shard", "__llm_run").orderBy(*order)) - 1)
    joined = placed.join(before, ["shard", "__llm_run"])
    return joined.select(*df.columns, "shard", (F.col("__llm_at") + F.col("__llm_before")).cast("long").alias("slot"), "grown_shard")
