"""Polling rounds, attempts, retries, schedules and run summaries."""

from pyspark.sql import functions as F

from checks import bindings as B
from checks.registry import query
from placelens import fixed_values as V
from placelens.operators import collect, runs
from placelens.operators.ordered import block_of, ranked
from placelens.session import scratch_path, staged
from placelens.sinks.writers import commit_run_state
from placelens.sources.readers import read_run_state

MESSAGES = [
    "Navigation timeout of 30000ms exceeded", "CAPTCHA detected", "net::ERR_CONNECTION_REFUSED",
    "browserType.launch: failed", "", "Sort verification failed: expected newest",
]
MESSAGE_SQL = "CASE WHEN event_type = 'error' THEN CASE event_id % 6 " + " ".join(
    f"WHEN {i} THEN '{m}'" for i, m in enumerate(MESSAGES)
) + " END END"

ATTEMPTS = f"""
SELECT CAST(user_id AS VARCHAR) AS place_key, event_id AS attempt_id, event_type <> 'error' AS ok, {MESSAGE_SQL} AS message,
 epoch_us(ts) // 1000 AS start_ms, CAST(floor(value * 1000 * (1 + event_id % 40)) AS BIGINT) AS duration_ms,
 epoch_us(ts) // 1000 + CAST(floor(value * 1000 * (1 + event_id % 40)) AS BIGINT) AS end_ms,
 row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS attempt_no FROM events
"""


def _attempts(t):
    duration = F.floor(F.col("value") * 1000 * (1 + F.col("event_id") % 40))
    return t.events().select(
        F.col("user_id").cast("string").alias("place_key"),
        F.col("event_id").alias("attempt_id"),
        (F.col("event_type") != "error").alias("ok"),
        F.expr(MESSAGE_SQL).alias("message"),
        F.col("ms").alias("start_ms"),
        duration.alias("duration_ms"),
        (F.col("ms") + duration).alias("end_ms"),
    )


PHRASE = " OR ".join("contains(lower(coalesce(message, '')), '" + p.replace("'", "''") + "')" for p in V.UNRECOVERABLE_PHRASES)
ATTEMPT_VIEWS = {"attempts": ATTEMPTS}


@query("is_unrecoverable", B.with_views(f"SELECT attempt_id, ({PHRASE}) AS unrecoverable FROM attempts", **ATTEMPT_VIEWS))
def is_unrecoverable(t):
    return _attempts(t).select(
        "attempt_id", runs.is_unrecoverable(F.col("message")).alias("unrecoverable")
    )


@query(
    "attempt_timed_out",
    B.with_views(
        """SELECT attempt_id, duration_ms > 300000 AS timed_out, ok AND duration_ms <= 300000 AS ok,
        CASE WHEN duration_ms > 300000 THEN 'Location timeout after 300s' ELSE message END AS message FROM attempts""",
        **ATTEMPT_VIEWS,
    ),
)
def attempt_timed_out(t):
    return runs.attempt_timed_out(_attempts(t)).select("attempt_id", "timed_out", "ok", "message")


OUTCOMES = f"""
SELECT place_key, count(*) AS attempts, arg_max(ok, attempt_no) AS ok,
 CASE WHEN NOT arg_max(ok, attempt_no) THEN max_by(coalesce(message, ''), attempt_no) END AS message,
 min(start_ms) AS started_ms, arg_max(end_ms, attempt_no) AS ended_ms
FROM attempts a WHERE attempt_no <= 2 AND NOT EXISTS (SELECT 1 FROM attempts b WHERE b.place_key = a.place_key
 AND b.attempt_no < a.attempt_no AND (b.ok OR {PHRASE.replace('message', 'b.message')})) GROUP BY place_key
"""


@query("attempt_outcomes", B.with_views(OUTCOMES, **ATTEMPT_VIEWS))
def attempt_outcomes(t):
    return runs.attempt_outcomes(_attempts(t))


@query(
    "batch_summary",
    B.with_views(
        """SELECT CAST(length(place_key) AS BIGINT) AS run_id, CAST(count_if(ok) AS BIGINT) AS succeeded, CAST(count_if(NOT ok) AS BIGINT) AS failed,
        count(*) AS total, max(ended_ms) - min(started_ms) AS elapsed_ms, CAST(max(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS exit_code
        FROM outcomes GROUP BY ALL""",
        **ATTEMPT_VIEWS, outcomes=OUTCOMES,
    ),
)
def batch_summary(t):
    outcomes = runs.attempt_outcomes(_attempts(t))
    return runs.batch_summary(outcomes.withColumn("run_id", F.length("place_key").cast("bigint")))


@query(
    "retry_gap_audit",
    B.with_views(
        """SELECT place_key, attempt_no, next_ms - end_ms AS observed_ms,
        CAST(least(2000 * power(4, least(attempt_no, 10)), 30000) AS BIGINT) AS required_ms,
        next_ms - end_ms < least(2000 * power(4, least(attempt_no, 10)), 30000) AS too_early
        FROM (SELECT *, lead(start_ms) OVER (PARTITION BY place_key ORDER BY attempt_no) AS next_ms FROM attempts)
        WHERE NOT ok AND next_ms IS NOT NULL""",
        **ATTEMPT_VIEWS,
    ),
)
def retry_gap_audit(t):
    return runs.retry_gap_audit(runs.number_attempts(_attempts(t)))


# --- polling rounds ----------------------------------------------------------
ROUNDS = """
SELECT CAST(user_id AS VARCHAR) AS place_key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS INTEGER) AS round,
 CAST(CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 1 + event_id % 4 ELSE 0 END AS BIGINT) AS new_reviews,
 event_type = 'view' AS loading, epoch_us(ts) // 1000 AS captured_ms FROM events
"""
# The loop as written: one round after the other.
FOLD = """
fold AS (
 SELECT place_key, -1 AS round, 0 AS stale, 0 AS spin, CAST(0 AS BIGINT) AS total, CAST(NULL AS VARCHAR) AS stop_reason, false AS dry FROM rounds WHERE round = 0
 UNION ALL
 SELECT r.place_key, r.round,
  CASE WHEN new_reviews > 0 THEN 0 WHEN r.loading THEN f.stale + CASE WHEN f.spin + 1 >= 3 THEN 1 ELSE 0 END ELSE f.stale + 1 END,
  CASE WHEN new_reviews > 0 THEN 0 WHEN r.loading THEN CASE WHEN f.spin + 1 >= 3 THEN 0 ELSE f.spin + 1 END ELSE f.spin END,
  f.total + new_reviews,
  CASE WHEN new_reviews > 0 THEN CASE WHEN f.total + new_reviews >= {cap} THEN 'max' END
   WHEN NOT r.loading AND f.stale + 1 >= 6 THEN 'exhausted' END,
  new_reviews = 0
 FROM fold f JOIN rounds r ON r.place_key = f.place_key AND r.round = f.round + 1{until})
"""


def _fold(body, cap=10**9, until=" WHERE f.stop_reason IS NULL"):
    fold = FOLD.format(cap=cap, until=until)
    return f"WITH RECURSIVE rounds AS ({ROUNDS}), {fold.strip()} {body}"


def _rounds(t):
    events = t.events().select(
        F.col("user_id").cast("string").alias("place_key"), "event_id", "event_type",
        F.col("ms").alias("captured_ms"),
    )
    new = F.when(
        (F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0), 1 + F.col("event_id") % 4
    ).otherwise(0)
    numbered = ranked(
        events, ["place_key"], [block_of(F.col("captured_ms"), runs.DAY_MS)],
        [F.col("captured_ms"), F.col("event_id")], "n",
    )
    rows = numbered.select(
        "place_key", (F.col("n") - 1).cast("int").alias("round"),
        new.cast("bigint").alias("new_reviews"), (F.col("event_type") == "view").alias("loading"),
        "captured_ms",
    )
    return staged(rows, "rounds")


@query("stop_rounds", _fold("SELECT place_key, round AS stop_round, stop_reason FROM fold WHERE stop_reason IS NOT NULL"))
def stop_rounds(t):
    return collect.stop_rounds(_rounds(t))


@query(
    "stop_rounds_capped",
    _fold("SELECT place_key, round AS stop_round, stop_reason FROM fold WHERE stop_reason IS NOT NULL", cap=8),
)
def stop_rounds_capped(t):
    return collect.stop_rounds(_rounds(t), max_reviews=8)


@query(
    "dry_counts",
    _fold("SELECT place_key, round, total AS total_reviews, CAST(stale AS BIGINT) AS dry_count FROM fold WHERE round >= 0", until=""),
)
def dry_counts(t):
    """Small blocks, so that running values cross many block borders."""
    return collect.dry_counts(_rounds(t), rounds_per_block=8).select(
        "place_key", "round", "total_reviews", "dry_count"
    )


@query(
    "poll_gap_audit",
    _fold(
        """SELECT f.place_key, f.round, CAST(stale AS BIGINT) AS dry_count, n.captured_ms - r.captured_ms AS observed_ms,
        CAST(least(600000 * power(2, greatest(stale - 1, 0)), 600000 * 4) AS BIGINT) AS expected_ms,
        n.captured_ms - r.captured_ms BETWEEN least(600000 * power(2, greatest(stale - 1, 0)), 600000 * 4) * CAST(0.85 AS DOUBLE) + 500
          AND least(600000 * power(2, greatest(stale - 1, 0)), 600000 * 4) * CAST(1.15 AS DOUBLE) + 500 AS in_range
        FROM fold f JOIN rounds r USING (place_key, round) JOIN rounds n ON n.place_key = f.place_key AND n.round = f.round + 1""",
        until="",
    ),
)
def poll_gap_audit(t):
    """A base wait of ten minutes suits the spacing of the given events."""
    return runs.poll_gap_audit(_rounds(t), base_ms=600000)


@query(
    "spaced_schedule",
    f"""WITH RECURSIVE reqs AS (SELECT event_type AS lane, event_id AS seq, epoch_us(ts) // 1000 AS arrival_ms,
      row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events),
    plan AS (SELECT lane, seq, i, arrival_ms, arrival_ms AS start_ms FROM reqs WHERE i = 1
      UNION ALL SELECT r.lane, r.seq, r.i, r.arrival_ms, greatest(r.arrival_ms, p.start_ms + 3600000) FROM plan p JOIN reqs r ON r.lane = p.lane AND r.i = p.i + 1)
    SELECT lane, seq, arrival_ms, start_ms FROM plan""",
)
def spaced_schedule(t):
    requests = t.events().select(
        F.col("event_type").alias("lane"), F.col("event_id").alias("seq"), F.col("ms").alias("arrival_ms")
    )
    return runs.spaced_schedule(requests, delay_ms=3600000).select("lane", "seq", "arrival_ms", "start_ms")


@query(
    "commit_run_state",
    "SELECT DISTINCT CAST(user_id AS VARCHAR) AS input, event_id % 2 AS batch_id FROM events WHERE event_type = 'purchase'",
)
def commit_state(t):
    """Two batches, the first written twice as after a replay."""
    path = scratch_path(t.spark, "state")
    done = t.events().filter("event_type = 'purchase'").select(
        F.col("user_id").cast("string").alias("input"), (F.col("event_id") % 2).alias("b")
    ).distinct()
    for batch in (0, 0, 1):
        commit_run_state(done.filter(F.col("b") == batch), path, batch)
    return read_run_state(t.spark, path).select("input", "batch_id")
