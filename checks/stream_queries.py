"""Streams over derived capture files, run until all files are read."""

from pyspark.sql import functions as F

from checks import bindings as B
from checks import page_queries as P
from checks import run_queries as Q
from checks.registry import query
from placelens.session import scratch_path, staged
from placelens.sources.readers import read_run_state, stream_captures
from placelens.streaming import flows

FILES = 4


def _finish(df, spark, mode="append"):
    """Runs a stream to its end into a table and reads it back."""
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")

    def start(stream):
        return (
            stream.writeStream.format("parquet").outputMode(mode)
            .option("checkpointLocation", checkpoint).option("path", out)
            .trigger(availableNow=True).start()
        )

    flows.start_with_rocksdb(df, start).awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def _capture_stream(t):
    path = scratch_path(t.spark, "captures")
    P.captures(t).repartition(FILES, "place_key").write.parquet(path)
    return stream_captures(t.spark, path, max_files=2)


GOOD = "JOIN info i ON i.place_key = s.place_key AND i.round = s.round WHERE page_state = 'ok' AND rating <= 5"
VIEWS = {**P.SHOWN_VIEWS, "info": P.PAGE_INFO}


@query(
    "stream_reviews",
    B.with_views(
        f"SELECT s.place_key, s.round, pos, review_id, CAST(rating AS INTEGER) AS rating, text, text AS original_text, {B.hint('text')} AS original_language FROM shown s {GOOD}",
        **VIEWS,
    ),
)
def stream_reviews(t):
    reviews = flows.stream_reviews(_capture_stream(t)).select(
        "place_key", "round", "pos", "review_id", "rating", "text", "original_text", "original_language"
    )
    return _finish(reviews, t.spark)


@query(
    "stream_dedup",
    B.with_views(f"SELECT DISTINCT s.place_key, review_id, 'r' AS run_id FROM shown s {GOOD}", **VIEWS),
)
def stream_dedup(t):
    reviews = flows.stream_reviews(_capture_stream(t)).withColumn("run_id", F.lit("r"))
    return _finish(
        flows.stream_dedup(reviews.select("place_key", "review_id", "run_id"), "run_id"), t.spark
    )


COLLECTED = f"""
SELECT place_key, 'review' AS kind, CAST(ordinal AS BIGINT) AS ordinal, round, review_id, NULL AS stop_reason FROM (
 SELECT *, row_number() OVER (PARTITION BY place_key ORDER BY round, pos) AS ordinal FROM (
  SELECT s.place_key, s.round, pos, review_id, row_number() OVER (PARTITION BY s.place_key, review_id ORDER BY s.round, pos) AS copy
  FROM shown s {GOOD}) WHERE copy = 1) WHERE ordinal <= 2
"""


@query(
    "stream_collect_pages",
    B.with_views(
        f"""SELECT * FROM ({COLLECTED}) UNION ALL SELECT place_key, 'stop', ordinal, round, NULL, 'max'
        FROM ({COLLECTED}) WHERE ordinal = 2""",
        **VIEWS,
    ),
)
def stream_collect_pages(t):
    """Stored pages in a stream to at most two reviews per location."""
    rounds = flows.captured_reviews(flows.stream_pages(_capture_stream(t)))
    events = flows.stream_collect(rounds, max_reviews=2)
    return _finish(
        events.select("place_key", "kind", "ordinal", "round", "review_id", "stop_reason"), t.spark
    )


# Rounds from the events: some bring a new id, some repeat the first one.
STREAM_ROUNDS = Q.ROUNDS.replace("FROM events", ", event_id, event_type FROM events")
STREAM_IDS = """
SELECT place_key, round, loading, CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'e' || event_id
 WHEN event_type = 'click' THEN 'first' END AS id FROM stream_rounds
"""
STREAM_NEW = """
SELECT r.place_key, r.round, r.loading, CAST(CASE WHEN id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ids e
 WHERE e.place_key = r.place_key AND e.id = r.id AND e.round < r.round) THEN 1 ELSE 0 END AS BIGINT) AS new_reviews, id FROM ids r
"""


@query(
    "stream_collect",
    f"""WITH RECURSIVE stream_rounds AS ({STREAM_ROUNDS}), ids AS ({STREAM_IDS}), rounds AS ({STREAM_NEW}),
    {Q.FOLD.format(cap=10**9, until=" WHERE f.stop_reason IS NULL").strip()}
    SELECT f.place_key, 'review' AS kind, f.round, total AS ordinal, r.id AS review_id, NULL AS stop_reason
    FROM fold f JOIN rounds r USING (place_key, round) WHERE new_reviews = 1
    UNION ALL SELECT place_key, 'stop', round, total, NULL, stop_reason FROM fold WHERE stop_reason IS NOT NULL""",
)
def stream_collect(t):
    """Rounds scattered over files in no order: early ones wait for those before."""
    rounds = Q._rounds(t)
    events = t.events().select(
        F.col("user_id").cast("string").alias("place_key"), F.col("ms").alias("captured_ms"),
        "event_id", "event_type",
    )
    id_ = F.when(
        (F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0),
        F.concat(F.lit("e"), "event_id"),
    ).when(F.col("event_type") == "click", "first")
    review = F.when(id_.isNotNull(), F.struct(id_.alias("review_id"), F.lit("{}").alias("body")))
    rows = rounds.drop("new_reviews").join(events, ["place_key", "captured_ms"]).select(
        "place_key", "round", "loading", F.array_compact(F.array(review)).alias("reviews"), "event_id"
    )
    path = scratch_path(t.spark, "rounds")
    rows.repartition(FILES, F.col("event_id")).drop("event_id").write.parquet(path)
    stream = t.spark.readStream.schema(t.spark.read.parquet(path).schema).option(
        "maxFilesPerTrigger", FILES // 2
    ).parquet(path)
    return _finish(
        flows.stream_collect(stream).select(
            "place_key", "kind", "round", "ordinal", "review_id", "stop_reason"
        ),
        t.spark,
    )


def _outcome_stream(t):
    path = scratch_path(t.spark, "outcomes")
    outcomes = Q.runs.attempt_outcomes(Q._attempts(t)).select(
        F.col("place_key").alias("input"), "ok", F.length("place_key").cast("bigint").alias("run_id")
    )
    outcomes.repartition(FILES).write.parquet(path)
    return t.spark.readStream.schema(outcomes.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(
    "stream_batch_state",
    B.with_views("SELECT place_key AS input FROM outcomes WHERE ok", **Q.ATTEMPT_VIEWS, outcomes=Q.OUTCOMES),
)
def stream_batch_state(t):
    state, out = scratch_path(t.spark, "state"), scratch_path(t.spark, "out")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    flows.stream_batch_state(
        _outcome_stream(t), state, scratch_path(t.spark, "checkpoint"), write
    ).awaitTermination()
    return read_run_state(t.spark, state).select("input")


@query(
    "stream_summary",
    B.with_views(
        """SELECT CAST(length(place_key) AS BIGINT) AS run_id, CAST(count_if(ok) AS BIGINT) AS succeeded,
        CAST(count_if(NOT ok) AS BIGINT) AS failed, count(*) AS total FROM outcomes GROUP BY ALL""",
        **Q.ATTEMPT_VIEWS, outcomes=Q.OUTCOMES,
    ),
)
def stream_summary(t):
    """Update mode: every batch writes the counts it changed; the last one stands."""
    out = scratch_path(t.spark, "summary")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    (
        flows.stream_summary(_outcome_stream(t)).writeStream.outputMode("update")
        .foreachBatch(keep).option("checkpointLocation", scratch_path(t.spark, "checkpoint"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    written = t.spark.read.parquet(out)
    last = F.max_by(F.struct("succeeded", "failed", "total"), "batch_id").alias("x")
    return written.groupBy("run_id").agg(last).select("run_id", "x.*")
