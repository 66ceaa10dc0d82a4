"""Plans stay the ones we want: narrow scans, few shuffles, no hot task."""

import re

import pytest
from pyspark.sql import functions as F

from placelens import schemas
from placelens.operators import captures, collect, locations, quality, runs, validation
from placelens import session
from placelens.operators.reviews import normalise_reviews
from placelens.plans import jobs


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def raw(spark, tmp_path):
    row = ("p", 0, 0, "r", "A", None, "t", 5, "x", None, 0, None, None)
    spark.createDataFrame([row], schemas.RAW_REVIEW).write.parquet(str(tmp_path / "raw"))
    return spark.read.parquet(str(tmp_path / "raw"))


def test_normalise_is_one_narrow_stage_with_pushed_filters(raw):
    text = plan(normalise_reviews(raw))
    assert "Exchange" not in text and "Python" not in text
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text)[1]
    for part in ("IsNotNull(author)", "IsNotNull(publish_time)", "LessThanOrEqual(rating,5)", "GreaterThanOrEqual(photos,0)"):
        assert part in pushed
    narrow = plan(normalise_reviews(raw).select("place_key", "rating"))
    read = re.search(r"ReadSchema: struct<(.*?)>", narrow)[1]
    assert "owner_response_text" not in read and "text:" not in read.replace("original_text", "")


def test_dedup_combines_before_its_one_shuffle(raw):
    text = plan(collect.dedup_first_seen(raw))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_min" in text and re.search(r"hashpartitioning\(place_key#\d+, review_id#\d+", text)


@pytest.mark.parametrize("n", [2, 200])
def test_caps_prune_before_the_shuffle_by_block(raw, n):
    """One plan for every cap: blocks keep their first rows on both sides of the shuffle, and only counts meet by location."""
    text = plan(collect.cap_per_location(raw, n))
    assert len(set(re.findall(r"ReadSchema: (struct<.*?>)\n", text))) == 2  # whole rows once, their keys and order once
    limits = re.findall(r"WindowGroupLimit \[(.*?)\].*?, (\d+), (Partial|Final)", text)
    assert {x[2] for x in limits} == {"Partial", "Final"} and {x[1] for x in limits} == {str(n)}
    assert all("_block0" in x[0] for x in limits)
    sample = plan(collect.cap_per_location(raw, 2))
    assert re.sub(r"#\d+L?|\b(2|200)\b|plan_id=\d+|\[id=.*?\]", "", text) == re.sub(r"#\d+L?|\b(2|200)\b|plan_id=\d+|\[id=.*?\]", "", sample)


@pytest.mark.parametrize("job", [
    lambda df: collect.cap_per_location(df, 5000),
    collect.number_reviews,
    lambda df: collect.order_reviews(df, "highest"),
])
def test_ranks_never_window_rows_by_location_alone(raw, job):
    text = plan(job(raw))
    for window in re.findall(r"Window \[.*?\], \[(.*?)\], \[", text):
        if "," not in window:  # by location alone: only over totals of coarse blocks
            assert "_coarse0" in text
    assert re.search(r"Window \[(?:sum\(1\)|row_number\(\)).*?\], \[place_key#\d+(, _block\d#\d+L?)+\]", text)


def test_stop_rule_windows_are_blockwise(spark, tmp_path):
    spark.createDataFrame([("p", 0, 0, False)], "place_key string, round int, new_reviews bigint, loading boolean").write.parquet(str(tmp_path / "r"))
    text = plan(collect.stop_rounds(spark.read.parquet(str(tmp_path / "r"))))
    assert "collect_list" not in text and "Python" not in text
    assert text.count("Scan parquet") <= 2


def test_schedule_reads_its_requests_twice(spark, tmp_path):
    spark.createDataFrame([("l", 0, 5)], "lane string, seq bigint, arrival_ms bigint").write.parquet(str(tmp_path / "s"))
    text = plan(runs.spaced_schedule(spark.read.parquet(str(tmp_path / "s"))))
    assert text.count("Scan parquet") <= 2


def test_pages_are_read_without_a_shuffle(spark, tmp_path):
    spark.createDataFrame([("p", 0, 0, "u", "<p>", 1)], schemas.CAPTURE).write.parquet(str(tmp_path / "c"))
    pages = captures.read_pages(spark.read.parquet(str(tmp_path / "c")), ("place_key", "round"), fields=["cards", "body_chars"])
    text = plan(quality.stale_selector_alerts(pages, "place_key"))
    assert "Exchange" not in text and "MapInArrow" in text
    read = re.search(r"ReadSchema: struct<(.*?)>", text)[1]
    assert read == "place_key:string,round:int,html:string"


def test_validation_is_one_narrow_stage(spark):
    docs = spark.createDataFrame([(1, "{}")], "i int, value string")
    text = plan(validation.validate_documents(docs, "i"))
    assert "Exchange" not in text and "Python" not in text
    assert text.count("parse_json") <= 2


def test_resume_leaves_the_join_to_the_optimizer(spark):
    inputs = spark.range(10).select(F.col("id").cast("string").alias("input"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(locations.pending_locations(inputs, inputs))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan(locations.pending_locations(inputs, inputs))


@pytest.fixture
def no_broadcasts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("cap", [None, 3])
@pytest.mark.parametrize("sent_keys", [0, 1000])
def test_collecting_places_never_shuffles_html(spark, tmp_path, monkeypatch, no_broadcasts, cap, sent_keys):
    """All plans that the job stores, and its results: no exchange carries HTML, and only stored reviews are ranked."""
    row = ("p", 0, 0, "u", "<h1>x</h1>", 1)
    spark.createDataFrame([row], schemas.CAPTURE).write.parquet(str(tmp_path / "c"))
    asked = spark.createDataFrame([("p", None)], "place_key string, place_id string")
    plans = {}

    def spy(df, label):
        plans[label] = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return session.staged(df, label)

    monkeypatch.setattr(jobs, "staged", spy)
    monkeypatch.setattr(jobs, "SENT_KEYS", sent_keys)
    found = jobs.collect_places(spark.read.parquet(str(tmp_path / "c")), asked, "newest", cap, check_sort=False)
    assert {"pages", "first-seen", "rounds", "kept-reviews"} <= set(plans)
    spy(found.headers, "headers")
    spy(found.lines("newest", "json"), "lines")
    read = [t for t in plans.values() if "html:string" in t]
    assert len(read) == 1 and "MapInArrow" in read[0] and ("LeftSemi" in read[0]) == (sent_keys > 0)
    for text in plans.values():
        for node in re.findall(r"\(\d+\) Exchange\n(?:.+\n)+", text):
            assert "html" not in node
    # What is shuffled by location alone has one row per location, block or round; reviews are dealt by more.
    ranks = re.findall(r"Exchange\nInput \[\d+\]: \[(.*?)\]\nArguments: hashpartitioning\(place_key#\d+, \d+\)", plans["lines"])
    assert all("author" not in columns for columns in ranks)
