"""End-to-end jobs: captured pages to documents, list to files, documents to issues."""

import time
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens.operators import captures as C
from placelens.operators import collect, naming, validation
from placelens.operators.assemble import assemble_documents, document_lines
from placelens.operators.locations import classify_locations, pending_locations, verify_identity
from placelens.operators.ordered import block_of, ranked
from placelens.operators.reviews import normalise_reviews
from placelens.session import staged
from placelens.sinks.writers import claim_batch, commit_run_state, write_files
from placelens.sources.readers import read_location_lists, read_raw_documents, read_run_state

PLACE = "place_key"
SENT_KEYS = 500_000  # location keys sent to every task, some tens of MB; results are the same beyond
PAGE_KEYS = (PLACE, "round", "pass_no", "resolved_url", "captured_ms")
PAGE_FIELDS = (
    "name", "address", "rating_text", "tab_text", "badge_text", "body_snippet",
    "body_text", "sort_text", "loading", "asks_sign_in", "cards",
)


class Collected(NamedTuple):
    headers: DataFrame
    reviews: DataFrame
    rejected: DataFrame

    def register_views(self, prefix: str = "") -> None:
        """Makes the tables available to Spark SQL under their names."""
        for name, table in self._asdict().items():
            table.createOrReplaceTempView(f"{prefix}{name}")

    def documents(self, sort_order: str) -> DataFrame:
        """One row per location."""
        return assemble_documents(self.headers, self.reviews, sort_order)

    def lines(self, sort_order: str, fmt: str) -> DataFrame:
        """One row per line of a location's file, for locations of any size."""
        return document_lines(self.headers, self.reviews, sort_order, fmt)


def _headers(pages: DataFrame) -> DataFrame:
    """Header of the last good page of each location, and the span of its captures."""
    fields = ("name", "address", "header_rating", "header_total_reviews", "count_source",
              "final_place_id", "final_url")
    latest = F.max_by(F.struct(*fields), F.struct("round", "pass_no")).alias("_h")
    last_ms = F.max("captured_ms")
    return (
        C.header_rows(pages)
        .groupBy(PLACE)
        .agg(
            latest,
            F.date_format(F.timestamp_millis(last_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias(
                "scrape_date"
            ),
            (last_ms - F.min("captured_ms")).alias("scrape_duration_ms"),
        )
        .select(PLACE, "_h.*", "scrape_date", "scrape_duration_ms")
        .withColumnsRenamed({"final_place_id": "place_id", "final_url": "url"})
    )


def collect_places(
    captures: DataFrame,
    requests: DataFrame,
    sort_order: str = "newest",
    max_reviews: int | None = None,
    check_sort: bool = True,
    selectors: dict[str, str] | None = None,
) -> Collected:
    """Captured pages of any number of locations to headers and reviews.

    HTML is read where it lies: pages become rows in a pass without a shuffle, and only
    those rows meet their requests. Where the requested keys are counted to be few, they
    are sent to all tasks first, so that no other page is read. The judged pages are
    stored; later steps read only the columns they need. The stored table also forgets
    the join's partitioning by location, which would else let a hot location stay in one
    task. Pages in a wrong state or of a wrong place are returned as ``rejected``, and
    unless ``check_sort`` is off also pages that do not announce the wanted order.
    """
    wanted = requests.select(PLACE).distinct()
    if wanted.limit(SENT_KEYS + 1).count() <= SENT_KEYS:
        captures = captures.join(F.broadcast(wanted), PLACE, "left_semi")
    read = C.read_pages(captures, PAGE_KEYS, selectors, PAGE_FIELDS)
    asked = verify_identity(read, requests)
    states = C.sort_verified(C.page_state(asked), sort_order).drop("body_text", "sort_text")
    reason = (
        F.when(F.col("page_state") != "ok", F.col("page_state"))
        .when(~F.col("verified"), F.col("error_kind"))
        .when(F.lit(check_sort) & ~F.col("sort_verified"), "SORT_VERIFY")
    )
    judged = staged(states.withColumn("reject_reason", reason), "pages")
    good = judged.filter(F.col("reject_reason").isNull())
    rejected = judged.filter(F.col("reject_reason").isNotNull()).select(
        PLACE, "round", "pass_no", "resolved_url", "reject_reason"
    )

    valid = normalise_reviews(C.card_rows(good))
    first_seen = staged(collect.dedup_first_seen(valid), "first-seen")
    rounds = staged(
        collect.round_counts(good.select(PLACE, "round", "loading"), first_seen), "rounds"
    )
    # Stored also for this: what follows would else stay dealt by location alone, as the join left it.
    reviews = staged(collect.before_stop(first_seen, collect.stop_rounds(rounds, max_reviews)), "kept-reviews")
    if max_reviews is not None:
        reviews = staged(collect.cap_per_location(reviews, max_reviews), "capped-reviews")
    return Collected(_headers(good), reviews, rejected)


class BatchRun(NamedTuple):
    summary: DataFrame  # one row, also for an empty run
    failures: DataFrame  # source_file, ordinal, input, reason: inputs without output
    files: DataFrame  # input, filename: what this run wrote


def batch_run(
    spark: SparkSession,
    list_path: str,
    captures: DataFrame,
    out_path: str,
    fmt: str = "json",
    sort_order: str = "newest",
    max_reviews: int | None = None,
    resume: bool = False,
    run_id: str = "run",
    batch_id: int | None = None,
    check_sort: bool = True,
) -> BatchRun:
    """List to files, run state, a summary row and the inputs that failed.

    ``captures`` holds the pages of this run and ``place_key`` the location input
    a page was loaded for. With ``resume`` only inputs that the last run, and those
    it resumed, did not complete are worked on; without it a new run begins, to
    which later resumed runs belong. An input listed twice gives two files.

    Files go to ``batch-<batch_id>``; by default the id is the next one that no run has
    claimed, so runs that start together keep apart. No
    committed file or state row is ever removed: names avoid all committed ones of
    the same format, and state only grows. State is written after the output, so a
    crash never marks unfinished work; files that the state does not name are left
    over from a stopped run, and the same work done again replaces them.

    Reasons of failures: ``INVALID_LOCATION``, ``NO_CAPTURE``, or why the location's
    last page was rejected. The exit code is 1 if a location failed or the list has
    no valid input, and 0 if nothing was left to do.
    """
    started_ms = int(time.time() * 1000)
    root = out_path.rstrip("/")
    state_path = f"{root}/_state"
    listed = staged(classify_locations(read_location_lists(spark, list_path)), "listed")
    valid = listed.filter(F.col("kind").isNotNull())
    state = read_run_state(spark, state_path).withColumn("run_no", F.coalesce("run_no", F.lit(0)))
    last = state.agg(F.max("batch_id").alias("batch"), F.max("run_no").alias("run")).first()
    if batch_id is None:
        batch_id = claim_batch(spark, state_path, 0 if last.batch is None else last.batch + 1)
    run_no = 0 if last.run is None else last.run + (0 if resume else 1)
    done = state.filter(F.lit(resume) & (F.col("run_no") == run_no))
    pending = staged(pending_locations(valid, done), "pending")
    arrival = ranked(
        pending.withColumn("_list", F.lit(1)),
        ["_list"],
        [F.col("source_file"), block_of(F.col("ordinal"))],
        [F.col("source_file"), F.col("ordinal")],
        "arrival",
    )
    entries = staged(
        arrival.select("source_file", "ordinal", F.col("input").alias(PLACE), "arrival", "place_id"),
        "entries",
    )
    requests = entries.groupBy(PLACE).agg(F.first("place_id").alias("place_id"))
    collected = collect_places(captures, requests, sort_order, max_reviews, check_sort)
    headers = staged(collected.headers, "headers")
    used = state.filter(F.col("file_stem").isNotNull()).select(
        F.concat("file_stem", F.lit("."), F.coalesce("format", F.lit(fmt))).alias("filename")
    )
    names = headers.select(PLACE, "name")
    planned = naming.file_plan(
        names.join(entries.select(PLACE, "arrival"), PLACE), used, f".{fmt}"
    )
    stem = F.expr(f"left(filename, length(filename) - {len(fmt) + 1})")
    stems = staged(planned.select(PLACE, "filename", stem.alias("file_stem")), "stems")
    lines = document_lines(headers, collected.reviews, sort_order, fmt)
    write_files(
        lines.join(stems.select(PLACE, "file_stem"), PLACE), f"{root}/batch-{batch_id}",
        mode="overwrite", dynamic=True,
    )
    commit_run_state(
        stems.select(
            F.col(PLACE).alias("input"), "file_stem", F.lit(fmt).alias("format"),
            F.lit(run_no).cast("bigint").alias("run_no"),
        ),
        state_path, batch_id, mode="append",
    )
    outcomes = entries.join(names, PLACE, "left")
    ended_ms, failed = int(time.time() * 1000), F.count_if(F.col("name").isNull())
    summary = outcomes.agg(
        F.count_if(F.col("name").isNotNull()).alias("succeeded"),
        failed.alias("failed"),
        F.count("*").alias("total"),
    ).select(
        F.lit(run_id).alias("run_id"), "succeeded", "failed", "total",
        F.lit(ended_ms - started_ms).cast("bigint").alias("elapsed_ms"),
        F.when((F.col("failed") > 0) | F.lit(valid.isEmpty()), 1).otherwise(0).cast("bigint").alias("exit_code"),
    )
    why = collected.rejected.groupBy(PLACE).agg(
        F.max_by("reject_reason", F.struct("round", "pass_no")).alias("reason")
    )
    failures = (
        outcomes.filter(F.col("name").isNull()).join(why, PLACE, "left")
        .select(
            "source_file", "ordinal", F.col(PLACE).alias("input"),
            F.coalesce("reason", F.lit("NO_CAPTURE")).alias("reason"),
        )
        .unionByName(
            listed.filter(F.col("kind").isNull()).select(
                "source_file", "ordinal", "input", F.lit("INVALID_LOCATION").alias("reason")
            )
        )
    )
    return BatchRun(summary, failures, stems.select(F.col(PLACE).alias("input"), "filename"))


def run_batch(*args, **options) -> DataFrame:
    """The summary row of ``batch_run``, which takes the same arguments."""
    return batch_run(*args, **options).summary


def validate_path(
    spark: SparkSession, path: str, one_per_file: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Issue rows and a summary row per document of a file or folder."""
    raw = read_raw_documents(spark, path, one_per_file)
    return (
        validation.validate_documents(raw, "source_file"),
        validation.document_summary(raw, "source_file"),
    )
