"""Collection runs: attempts, retries, pacing and their summary."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelens import fixed_values as V
from placelens.operators.collect import dry_counts
from placelens.operators.ordered import Peak, block_of, first_n, ranked, running

PLACE = ["place_key"]
DAY_MS = 86_400_000


def is_unrecoverable(message: Column, error_kind: Column | None = None) -> Column:
    """Errors that a retry cannot help: typed ones, and those with a known phrase."""
    text = F.lower(F.coalesce(message, F.lit("")))
    phrase = reduce(or_, [text.contains(p) for p in V.UNRECOVERABLE_PHRASES])
    return phrase if error_kind is None else error_kind.isNotNull() | phrase


def attempt_timed_out(attempts: DataFrame, limit_ms: int = V.LOCATION_TIMEOUT_MS) -> DataFrame:
    """Adds ``timed_out``; a timed-out attempt fails and its result is discarded."""
    late = F.col("duration_ms") > limit_ms
    seconds = f"{limit_ms / 1000:g}"
    return attempts.withColumns(
        {
            "timed_out": late,
            "ok": F.col("ok") & ~late,
            "message": F.when(late, f"Location timeout after {seconds}s").otherwise(
                F.col("message")
            ),
        }
    )


def number_attempts(attempts: DataFrame) -> DataFrame:
    """Adds the 0-based ``attempt_no`` of each attempt of a location."""
    order = [F.col("start_ms"), F.col("attempt_id")]
    numbered = ranked(attempts, PLACE, [block_of(F.col("start_ms"), DAY_MS)], order, "_n")
    return numbered.withColumn("attempt_no", F.col("_n") - 1).drop("_n")


def attempt_outcomes(
    attempts: DataFrame, max_retries: int = V.MAX_RETRIES, limit_ms: int | None = None
) -> DataFrame:
    """Outcome of each location from its attempts log.

    Attempts count in order until one succeeds, one fails unrecoverably, or the
    retries are used up; later rows are ignored. Only the first ``max_retries +
    1`` rows of a location can matter, so no location is ever gathered whole.
    With ``limit_ms`` a location whose attempts took longer in all has failed.
    """
    order = [F.col("start_ms"), F.col("attempt_id")]
    tried = first_n(
        attempts, PLACE, [block_of(F.col("start_ms"), DAY_MS)], order, max_retries + 1, "n"
    )
    kind = F.col("error_kind") if "error_kind" in attempts.columns else None
    ends = F.col("ok") | is_unrecoverable(F.col("message"), kind)
    before = Window.partitionBy(*PLACE).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    counted = tried.withColumn("_over", F.max(ends).over(before)).filter(
        ~F.coalesce("_over", F.lit(False))
    )
    last = F.max_by(F.struct("ok", "message", F.col("end_ms")), "n")
    outcomes = (
        counted.groupBy(*PLACE)
        .agg(
            F.count("*").alias("attempts"),
            last.alias("_last"),
            F.min("start_ms").alias("started_ms"),
        )
        .select(
            *PLACE,
            "attempts",
            F.col("_last.ok").alias("ok"),
            F.when(~F.col("_last.ok"), F.col("_last.message")).alias("message"),
            "started_ms",
            F.col("_last.end_ms").alias("ended_ms"),
        )
    )
    if limit_ms is None:
        return outcomes
    timed = outcomes.withColumn("duration_ms", F.col("ended_ms") - F.col("started_ms"))
    return attempt_timed_out(timed, limit_ms).drop("duration_ms", "timed_out")


def batch_summary(outcomes: DataFrame, run_key: str = "run_id") -> DataFrame:
    """Per run: succeeded, failed, total, elapsed time, and the exit code."""
    failed = F.count_if(~F.col("ok"))
    return outcomes.groupBy(run_key).agg(
        F.count_if(F.col("ok")).alias("succeeded"),
        failed.alias("failed"),
        F.count("*").alias("total"),
        (F.max("ended_ms") - F.min("started_ms")).alias("elapsed_ms"),
        F.when(failed > 0, 1).otherwise(0).cast("bigint").alias("exit_code"),
    )


def required_retry_wait(attempt_no: Column) -> Column:
    """Shortest wait in ms after the attempt with this 0-based number."""
    step = V.RETRY_BASE_MS * F.pow(F.lit(float(V.RETRY_FACTOR)), F.least(attempt_no, F.lit(10)))
    return F.least(step, F.lit(float(V.RETRY_CAP_MS))).cast("bigint")


def retry_gap_audit(attempts: DataFrame) -> DataFrame:
    """Waits between a failed attempt and the next one, against the required wait.

    Needs ``attempt_no``. The next attempt is found by an equi-join on (location,
    number), which spreads a location over all tasks; a window would not.
    """
    following = attempts.select(
        *PLACE,
        (F.col("attempt_no") - 1).alias("attempt_no"),
        F.col("start_ms").alias("next_start_ms"),
    )
    return (
        attempts.filter(~F.col("ok"))
        .select(*PLACE, "attempt_no", "end_ms")
        .join(following, [*PLACE, "attempt_no"])
        .select(
            *PLACE,
            "attempt_no",
            (F.col("next_start_ms") - F.col("end_ms")).alias("observed_ms"),
            required_retry_wait(F.col("attempt_no")).alias("required_ms"),
        )
        .withColumn("too_early", F.col("observed_ms") < F.col("required_ms"))
    )


def poll_delay(dry_count: Column, base_ms: int, multiplier: int) -> Column:
    """Wait after a round: doubles with each dry round up to a multiple of the base."""
    doubled = base_ms * F.pow(F.lit(2.0), F.greatest(dry_count - 1, F.lit(0)))
    return F.least(doubled, F.lit(float(base_ms * multiplier)))


def poll_gap_audit(
    rounds: DataFrame,
    base_ms: int = V.POLL_DELAY_MS,
    multiplier: int = V.POLL_DELAY_MULTIPLIER,
    jitter: float = V.POLL_JITTER,
    settle_ms: int = V.POLL_SETTLE_MS,
) -> DataFrame:
    """Waits between consecutive rounds against the expected wait and its jitter.

    After each jittered wait the page gets a fixed ``settle_ms`` to settle.
    """
    following = rounds.select(
        *PLACE, (F.col("round") - 1).alias("round"), F.col("captured_ms").alias("next_ms")
    )
    expected = poll_delay(F.col("dry_count"), base_ms, multiplier)
    gap = F.col("next_ms") - F.col("captured_ms")
    return (
        dry_counts(rounds)
        .join(following, [*PLACE, "round"])
        .select(
            *PLACE,
            "round",
            F.col("dry_count").cast("bigint").alias("dry_count"),
            gap.alias("observed_ms"),
            expected.cast("bigint").alias("expected_ms"),
        )
        .withColumn(
            "in_range",
            F.col("observed_ms").between(
                F.col("expected_ms") * (1 - jitter) + settle_ms,
                F.col("expected_ms") * (1 + jitter) + settle_ms,
            ),
        )
    )


def spaced_schedule(requests: DataFrame, delay_ms: int = V.LOCATION_DELAY_MS) -> DataFrame:
    """Start times at least ``delay_ms`` apart per lane, in ``seq`` order.

    A request starts when it arrives or one delay after the one before it,
    whichever is later; the first is not delayed. In closed form: the running
    maximum of (arrival - i * delay), plus i * delay.
    """
    spaced = running(
        requests,
        ["lane"],
        [block_of(F.col("seq"))],
        [F.col("seq")],
        sums={"_n": F.lit(1).cast("bigint")},
        peaks={"_slack": Peak("_n", F.col("arrival_ms"), -delay_ms)},
    )
    return spaced.withColumn("start_ms", F.col("_slack") + F.col("_n") * delay_ms).drop("_n", "_slack")
