"""Which reviews of a location count: first copies, caps, stop rule, orders.

Tables here are keyed by location, which may be hot: see ``ordered`` for how
order-dependent work avoids one task per location.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelens import fixed_values as V
from placelens.operators.ordered import BLOCK_ROWS, Peak, block_of, first_n, ranked, running

PLACE = ["place_key"]
SEEN_ORDER = ("round", "pass_no", "pos", "review_id")
ROUNDS_PER_BLOCK = 1024


def seen_order(df: DataFrame) -> list[str]:
    return [c for c in SEEN_ORDER if c in df.columns]


def seen_blocks(df: DataFrame, width: int = BLOCK_ROWS) -> list[Column]:
    """Blocks along the seen order: pages, and stretches of positions inside a page."""
    pages = [F.col(c) for c in ("round", "pass_no") if c in df.columns]
    return [*pages, block_of(F.col("pos"), width)]


def _coarse(leading: int = 0) -> list[Column]:
    """Many rounds at a time, after ``leading`` block columns that come before the round."""
    first = [F.col(f"_block{i}") for i in range(leading)]
    return [*first, block_of(F.col(f"_block{leading}"), ROUNDS_PER_BLOCK)]


def _order_by(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in seen_order(df)]


def dedup_first_seen(reviews: DataFrame) -> DataFrame:
    """First copy of each review id per location, in (round, pass, position) order.

    Later copies never replace an earlier one, even when they hold more text.
    The aggregate combines copies before its shuffle, and its key includes the
    id, so a hot location spreads over all tasks.
    """
    order = [c for c in seen_order(reviews) if c != "review_id"]
    rest = [c for c in reviews.columns if c not in (*PLACE, "review_id", *order)]
    first = F.min(F.struct(*order, *rest)).alias("_row")
    return (
        reviews.groupBy(*PLACE, "review_id")
        .agg(first)
        .select(*[c if c in (*PLACE, "review_id") else F.col(f"_row.{c}") for c in reviews.columns])
    )


def cap_per_location(reviews: DataFrame, max_reviews: int, rank: str = "ordinal") -> DataFrame:
    """First ``max_reviews`` rows of each location with their 1-based ordinal."""
    if max_reviews <= 0:
        raise ValueError("max_reviews must be positive")
    return first_n(
        reviews, PLACE, seen_blocks(reviews), _order_by(reviews), max_reviews, rank, _coarse()
    )


def number_reviews(reviews: DataFrame, rank: str = "ordinal", total: str | None = None) -> DataFrame:
    """Ordinal of each review in collection order, and with ``total`` their number at its location.

    Reads ``reviews`` twice: store it first.
    """
    return ranked(reviews, PLACE, seen_blocks(reviews), _order_by(reviews), rank, _coarse(), total)


def round_counts(rounds: DataFrame, first_seen: DataFrame) -> DataFrame:
    """Rounds of each location with how many new reviews each one brought.

    ``rounds`` has one or more pages per (place_key, round) with ``loading``
    and optionally ``captured_ms``; ``first_seen`` is the deduplicated table.
    A round counts as loading when any of its pages showed the indicator.
    """
    new = first_seen.groupBy(*PLACE, "round").agg(F.count("*").alias("new_reviews"))
    time = {"captured_ms": F.min("captured_ms")} if "captured_ms" in rounds.columns else {}
    pages = rounds.groupBy(*PLACE, "round").agg(
        F.bool_or("loading").alias("loading"), *[c.alias(n) for n, c in time.items()]
    )
    return pages.join(new, [*PLACE, "round"], "left").withColumn(
        "new_reviews", F.coalesce("new_reviews", F.lit(0).cast("bigint"))
    )


def dry_counts(rounds: DataFrame, rounds_per_block: int = ROUNDS_PER_BLOCK) -> DataFrame:
    """Adds ``total_reviews`` so far and the ``dry_count`` after each round.

    A round with new reviews resets the count. A dry round adds one, but while
    a loading indicator shows only every third dry round does. Counted from
    running totals: those since the last productive round are the difference to
    their value there, which is the running total's peak over productive rounds.
    """
    productive = F.col("new_reviews") > 0
    blocks, order = [block_of(F.col("round"), rounds_per_block)], [F.col("round")]

    def one_if(c):
        return F.when(c, 1).otherwise(0).cast("bigint")

    counted = running(
        rounds,
        PLACE,
        blocks,
        order,
        sums={
            "total_reviews": F.col("new_reviews"),
            "_plain": one_if(~productive & ~F.col("loading")),
            "_spins": one_if(~productive & F.col("loading")),
        },
        peaks={
            f"{n}_base": Peak(n, F.when(productive, F.lit(0).cast("bigint"))) for n in ("_plain", "_spins")
        },
    )

    def since(n):
        return F.col(n) - F.coalesce(f"{n}_base", F.lit(0))

    spun = F.floor(since("_spins") / V.SPINNERS_PER_DRY_ROUND)
    return counted.withColumn("dry_count", since("_plain") + spun).drop(
        "_plain", "_spins", "_plain_base", "_spins_base"
    )


def stop_rounds(
    rounds: DataFrame,
    max_reviews: int | None = None,
    max_dry_rounds: int = V.MAX_DRY_ROUNDS,
) -> DataFrame:
    """First round at which each location's collection ends, and why.

    ``max`` when the cap is reached, ``exhausted`` at a dry round without a
    loading indicator once enough dry rounds have passed. The test is not made
    while the indicator shows, so a spinner that never goes away never stops
    the loop. Locations that did not end have no row.
    """
    counted = dry_counts(rounds)
    exhausted = (
        (F.col("new_reviews") == 0) & ~F.col("loading") & (F.col("dry_count") >= max_dry_rounds)
    )
    reason = F.when(exhausted, "exhausted")
    if max_reviews is not None:
        capped = (F.col("new_reviews") > 0) & (F.col("total_reviews") >= max_reviews)
        reason = F.when(capped, "max").otherwise(reason)
    ends = counted.withColumn("stop_reason", reason).filter(F.col("stop_reason").isNotNull())
    return ends.groupBy(*PLACE).agg(
        F.min("round").alias("stop_round"), F.min_by("stop_reason", "round").alias("stop_reason")
    )


def before_stop(reviews: DataFrame, stops: DataFrame) -> DataFrame:
    """Drops reviews first seen after the location's stop round."""
    return (
        reviews.join(stops.select(*PLACE, "stop_round"), PLACE, "left")
        .filter(F.col("stop_round").isNull() | (F.col("round") <= F.col("stop_round")))
        .drop("stop_round")
    )


def extraction_progress(first_seen: DataFrame) -> DataFrame:
    """New reviews per (location, round) and the running total."""
    new = first_seen.groupBy(*PLACE, "round").agg(F.count("*").alias("new_reviews"))
    return running(
        new,
        PLACE,
        [block_of(F.col("round"), ROUNDS_PER_BLOCK)],
        [F.col("round")],
        sums={"total_reviews": F.col("new_reviews")},
    )


def _rating_key(order: str):
    if order not in V.SORT_ORDERS:
        raise ValueError(f"sort order must be one of {V.SORT_ORDERS}")
    return {"highest": [-F.col("rating")], "lowest": [F.col("rating")]}.get(order, [])


def order_reviews(reviews: DataFrame, order: str, rank: str = "ordinal") -> DataFrame:
    """Ordinal of each review under an order; captured order breaks rating ties.

    ``newest`` and ``relevant`` are the captured order. Reads ``reviews`` twice:
    store an expensive one first.
    """
    key = _rating_key(order)
    return ranked(
        reviews, PLACE, [*key, *seen_blocks(reviews)], [*key, *_order_by(reviews)], rank,
        _coarse(len(key)),
    )


def top_n_reviews(reviews: DataFrame, order: str, n: int, rank: str = "ordinal") -> DataFrame:
    """First ``n`` reviews of each location under an order."""
    key = _rating_key(order)
    return first_n(
        reviews, PLACE, [*key, *seen_blocks(reviews)], [*key, *_order_by(reviews)], n, rank,
        _coarse(len(key)),
    )


def first_matching(
    candidates: DataFrame, keys: Sequence[str], text: str, pos: str, predicate
) -> DataFrame:
    """First text in document order that satisfies ``predicate``, per key."""
    return (
        candidates.filter(predicate)
        .groupBy(*keys)
        .agg(F.min_by(text, pos).alias(text), F.min(pos).alias(pos))
    )
