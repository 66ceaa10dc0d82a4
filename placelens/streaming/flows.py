"""The polling loop as Structured Streaming: captures in, reviews and stops out."""

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from placelens import fixed_values as V
from placelens.functions import reviews as R
from placelens.functions.text import trimmed
from placelens.operators import captures as C
from placelens.operators.locations import verify_identity
from placelens.operators.reviews import normalise_reviews
from placelens.session import ROCKSDB, STATE_STORE
from placelens.sinks.writers import commit_run_state
from placelens.streaming import collector

cloudpickle.register_pickle_by_value(collector)

PAYLOAD = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("author_url", T.StringType()),
        T.StructField("publish_time", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("original_text", T.StringType()),
        T.StructField("original_language", T.StringType()),
        T.StructField("photos", T.IntegerType()),
    ]
)


def stream_pages(
    captures: DataFrame,
    selectors: dict[str, str] | None = None,
    requests: DataFrame | None = None,
    sort_order: str | None = None,
) -> DataFrame:
    """Pages of a capture stream (or table) without their HTML, and whether each is ``ok``.

    A page is not ok in a wrong state, with ``requests`` (a table of ``place_key,
    place_id``) when it shows another place, and with ``sort_order`` when it does not
    announce that order. Such pages stay, as their rounds have to be counted past.
    Pages of places without a request go.
    """
    fields = ["body_text", "asks_sign_in", "loading", "cards", *(["sort_text"] if sort_order else [])]
    keys = ["place_key", "round", "pass_no", "resolved_url"]
    if requests is not None:
        captures, keys = verify_identity(captures, requests), [*keys, "verified"]
    pages = C.page_state(C.read_pages(captures, keys, selectors, fields))
    ok = F.col("page_state") == "ok"
    if requests is not None:
        ok = ok & F.col("verified")
    if sort_order:
        pages = C.sort_verified(pages, sort_order)
        ok = ok & F.col("sort_verified")
    return pages.select("place_key", "round", "pass_no", "resolved_url", "loading", "cards", F.coalesce(ok, F.lit(True)).alias("ok"))


def stream_reviews(
    captures: DataFrame,
    selectors: dict[str, str] | None = None,
    requests: DataFrame | None = None,
    sort_order: str | None = None,
) -> DataFrame:
    """Capture files to valid reviews of good pages. Stateless, so it scales with the files."""
    return normalise_reviews(C.card_rows(stream_pages(captures, selectors, requests, sort_order).filter("ok")))


def stream_dedup(
    reviews: DataFrame, run_key: str | None = None, event_time: str | None = None, within: str = "1 day"
) -> DataFrame:
    """Each (location, review id) once, or once per run with ``run_key``.

    State is keyed by location and id, so a hot location spreads over tasks.
    With ``event_time`` ids are forgotten after ``within`` without which they
    are kept as long as the stream runs.
    """
    keys = [*([run_key] if run_key else []), "place_key", "review_id"]
    if event_time is None:
        return reviews.dropDuplicates(keys)
    return reviews.withWatermark(event_time, within).dropDuplicatesWithinWatermark(keys)


def captured_reviews(pages: DataFrame) -> DataFrame:
    """One row per capture with its valid reviews as ``ARRAY<review_id, body>``.

    Keeps captures without reviews, which the stop rule counts, and pages that are
    not ok, without their reviews, which it counts past.
    """

    def review(card: Column) -> Column:
        text = R.trimmed_or_null(card["text"])
        author = R.trimmed_or(card["author"], V.ANONYMOUS_AUTHOR)
        time = R.trimmed_or(card["publish_time"], "")
        rating = R.card_rating(card["stars_label"])
        id_ = R.review_id(card["review_id"], author, time, rating, text)
        body = F.struct(
            id_.alias("review_id"),
            author.alias("author"),
            card["author_url"].alias("author_url"),
            time.alias("publish_time"),
            rating.alias("rating"),
            text.alias("text"),
            text.alias("original_text"),
            R.original_hint(text, F.lit(None).cast("string")).alias("original_language"),
            card["photos"].alias("photos"),
            R.owner_response(
                trimmed(card["owner_response_text"]), trimmed(card["owner_response_time"])
            ).alias("owner_response"),
        )
        broken = R.review_issues(id_, author, time, rating, card["photos"])
        return F.when(
            F.size(broken) == 0,
            F.struct(id_.alias("review_id"), F.to_json(body).alias("body")),
        )

    shown = F.when(F.col("ok"), F.col("cards")).otherwise(F.array().cast(pages.schema["cards"].dataType))
    with_id = F.filter(shown, lambda c: F.length(c["review_id"]) > 0)
    return pages.select(
        "place_key",
        "round",
        "pass_no",
        "ok",
        "loading",
        F.array_compact(F.transform(with_id, review)).alias("reviews"),
    )


def stream_collect(
    rounds: DataFrame,
    max_reviews: int | None = None,
    first_round: int = 0,
    timeout_ms: int | None = None,
    run_key: str | None = None,
    second_looks: bool = False,
    forget_ms: int | None = None,
) -> DataFrame:
    """First copies, cap and stop rule per location, one row per event.

    ``rounds`` has one row per page: ``place_key, round, loading, reviews`` and, if
    there, ``pass_no`` (0) and ``ok`` (true). Pages that arrive early wait in state
    until those before them are in, so the result does not depend on how files split
    them. A round whose pages are not ok brings nothing and is no dry round.

    With ``second_looks`` a page that shows the indicator and brings nothing new is
    followed by a second one of the same round (``pass_no`` 1), and the round ends
    with that. No other second page is taken; without the option one is an error.

    Accepted reviews come out as ``kind = review`` with their ordinal and ``body``;
    the end of a location as ``kind = stop`` with the reason; a page of a pass that is not
    taken as ``kind = rejected``, and the others go on. ``run_key`` names a
    column: each of its values is a run of its own. State is one small record per
    location and one key per id. Ids go when the location ends; the record stays, to
    pass over late pages, until ``forget_ms`` later. Needs the RocksDB state store.
    """
    keys = [*([run_key] if run_key else []), "place_key"]
    output = T.StructType([*[rounds.schema[k] for k in keys], *collector.EVENT])
    given = {"pass_no": F.lit(0), "ok": F.lit(True)}
    facts = [F.coalesce(*([F.col(c)] if c in rounds.columns else []), v).alias(c) for c, v in given.items()]
    processor = collector.LocationCollector(
        output.names, max_reviews, first_round, V.MAX_DRY_ROUNDS, V.SPINNERS_PER_DRY_ROUND,
        second_looks, timeout_ms, forget_ms,
    )
    pages = rounds.select(*keys, "round", "loading", "reviews", *facts)
    return pages.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=output,
        outputMode="Append",
        timeMode="None" if timeout_ms is None and forget_ms is None else "ProcessingTime",
    )


def start_with_rocksdb(df: DataFrame, start: Callable[[DataFrame], StreamingQuery]) -> StreamingQuery:
    """Starts a query with the RocksDB state store, leaving the session as it was.

    A started query keeps the settings it began with.
    """
    conf = df.sparkSession.conf
    before = conf.get(STATE_STORE)
    conf.set(STATE_STORE, ROCKSDB)
    try:
        return start(df)
    finally:
        conf.set(STATE_STORE, before)


def stream_batch_state(
    outcomes: DataFrame, state_path: str, checkpoint: str, write_batch: Callable[[DataFrame, int], None],
    **trigger,
) -> StreamingQuery:
    """Writes each batch of finished locations, then commits their inputs.

    ``outcomes`` has ``input`` and ``ok``. Output and state are keyed by batch
    id: a batch replayed after a failure replaces itself. The stream numbers its
    batches itself, so give it a state path of its own. ``trigger`` takes the options
    of a stream's trigger; by default all that is there is worked on.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id)
        commit_run_state(batch.filter("ok"), state_path, batch_id)

    return (
        outcomes.writeStream.foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_summary(outcomes: DataFrame, run_key: str = "run_id") -> DataFrame:
    """Running succeeded and failed counts per run; start it in update mode."""
    return outcomes.groupBy(run_key).agg(
        F.count_if(F.col("ok")).alias("succeeded"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.count("*").alias("total"),
    )
