"""The stream gives what the batch gives, however files split the rounds."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from placelens.operators import collect
from placelens.streaming import flows

SCHEMA = "place_key string, round int, loading boolean, reviews array<struct<review_id:string,body:string>>"
PAGES = f"{SCHEMA}, pass_no int, ok boolean, run string"


def run(spark, tmp_path, files, **options):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(files):
        lines = [json.dumps({"place_key": p, "round": r, "loading": load, "reviews": [{"review_id": x, "body": "{}"} for x in ids],
                             **dict(zip(("pass_no", "ok", "run"), more))})
                 for p, r, load, ids, *more in rows]
        file = folder / f"{i:03}.json"
        file.write_text("\n".join(lines))
        os.utime(file, (1_700_000_000 + i, 1_700_000_000 + i))  # the source reads oldest first
    stream = spark.readStream.schema(PAGES if len(files[0][0]) > 4 else SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    events = flows.stream_collect(stream, **options)

    def start(df):
        return (df.writeStream.format("parquet").option("path", str(tmp_path / "out"))
                .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())

    flows.start_with_rocksdb(events, start).awaitTermination()
    return spark.read.schema(events.schema).parquet(str(tmp_path / "out")).collect()


@pytest.mark.parametrize("seed,cap", [(1, None), (2, 7)])
def test_stream_equals_batch(spark, tmp_path, seed, cap):
    rng = random.Random(seed)
    rows = [(f"p{p}", r, rng.random() < 0.3, [f"i{rng.randrange(15)}" for _ in range(rng.choice([0, 0, 0, 2]))])
            for p in range(3) for r in range(25)]
    shuffled = rng.sample(rows, len(rows))
    got = run(spark, tmp_path, [shuffled[i::3] for i in range(3)], max_reviews=cap)

    cards = spark.createDataFrame(
        [(p, r, i, x) for p, r, _, ids in rows for i, x in enumerate(ids)], "place_key string, round int, pos bigint, review_id string"
    )
    pages = spark.createDataFrame([(p, r, load) for p, r, load, _ in rows], "place_key string, round int, loading boolean")
    first = collect.dedup_first_seen(cards)
    stops = collect.stop_rounds(collect.round_counts(pages, first), cap)
    kept = collect.before_stop(first, stops)
    kept = collect.cap_per_location(kept, cap) if cap else collect.number_reviews(kept)
    assert {(r.place_key, r.review_id, r.round, r.ordinal) for r in got if r.kind == "review"} == {
        (r.place_key, r.review_id, r.round, r.ordinal) for r in kept.collect()
    }
    assert {(r.place_key, r.round, r.stop_reason) for r in got if r.kind == "stop"} == {tuple(r) for r in stops.collect()}


def test_rows_after_the_end_are_ignored(spark, tmp_path):
    files = [[("p", 0, False, ["a"])], [("p", 1, False, ["b"]), ("p", 2, False, ["c"])], [("p", 0, False, ["z"])]]
    got = run(spark, tmp_path, files, max_reviews=2)
    assert sorted((r.kind, r.ordinal, r.review_id) for r in got) == [("review", 1, "a"), ("review", 2, "b"), ("stop", 2, None)]


def test_session_setting_is_restored(spark):
    from placelens.session import STATE_STORE

    before = spark.conf.get(STATE_STORE)
    seen = []
    flows.start_with_rocksdb(spark.range(1), lambda df: seen.append(df.sparkSession.conf.get(STATE_STORE)))
    assert "RocksDB" in seen[0] and spark.conf.get(STATE_STORE) == before


def test_dedup_within_watermark(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text("\n".join(
        json.dumps({"place_key": "p", "review_id": x, "at": "2025-01-01T00:00:00Z"}) for x in "aab"))
    stream = spark.readStream.schema("place_key string, review_id string, at timestamp").json(str(tmp_path / "d"))
    query = (flows.stream_dedup(stream, event_time="at").writeStream.format("memory").queryName("dd")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r.review_id for r in spark.table("dd").select(F.col("review_id")).collect()) == ["a", "b"]


def looked_at(rng, place):
    """Pages of one location as the loop takes them: a second look where the first one only shows the indicator."""
    known, pages = set(), []
    for r in range(25):
        for look in (0, 1):
            ok, load = rng.random() < 0.8, rng.random() < 0.4
            ids = [f"i{rng.randrange(12)}" for _ in range(rng.choice([0, 0, 2]))]
            pages.append((place, r, load, ids, look, ok))
            new = ok and not set(ids) <= known
            known |= set(ids) if ok else set()
            if new or not load:
                break
    return pages


@pytest.mark.parametrize("seed,cap", [(3, None), (4, 6)])
def test_rejected_pages_and_second_looks_equal_batch(spark, tmp_path, seed, cap):
    rng = random.Random(seed)
    rows = [page for p in range(4) for page in looked_at(rng, f"p{p}")]
    assert any(page[4] for page in rows) and any(not page[5] for page in rows)
    shuffled = rng.sample(rows, len(rows))
    got = run(spark, tmp_path, [shuffled[i::3] for i in range(3)], max_reviews=cap, second_looks=True)

    good = [page for page in rows if page[5]]
    cards = spark.createDataFrame(
        [(p, r, look, i, x) for p, r, _, ids, look, _ in good for i, x in enumerate(ids)],
        "place_key string, round int, pass_no int, pos bigint, review_id string",
    )
    pages = spark.createDataFrame([(p, r, load) for p, r, load, *_ in good], "place_key string, round int, loading boolean")
    first = collect.dedup_first_seen(cards)
    stops = collect.stop_rounds(collect.round_counts(pages, first), cap)
    kept = collect.before_stop(first, stops)
    kept = collect.cap_per_location(kept, cap) if cap else collect.number_reviews(kept)
    assert {(r.place_key, r.review_id, r.round, r.ordinal) for r in got if r.kind == "review"} == {
        (r.place_key, r.review_id, r.round, r.ordinal) for r in kept.collect()
    }
    assert {(r.place_key, r.round, r.stop_reason) for r in got if r.kind == "stop"} == {tuple(r) for r in stops.collect()}


def test_a_second_run_starts_anew(spark, tmp_path):
    files = [[("p", 0, False, ["a"], 0, True, "r1")], [("p", 0, False, ["a"], 0, True, "r2"), ("p", 1, False, ["b"], 0, True, "r1")]]
    got = run(spark, tmp_path, files, max_reviews=1, run_key="run")
    assert sorted((r.run, r.kind, r.review_id) for r in got) == [
        ("r1", "review", "a"), ("r1", "stop", None), ("r2", "review", "a"), ("r2", "stop", None),
    ]


class Values:
    """Stand-in for a value or map state."""

    def __init__(self):
        self.held = {}

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held[None]

    def update(self, value):
        self.held[None] = value

    def clear(self):
        self.held = {}

    def containsKey(self, key):
        return key in self.held

    def updateValue(self, key, value):
        self.held[key] = value


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


def test_the_record_goes_after_its_time():
    import pandas as pd

    from placelens.streaming.collector import EVENT, LocationCollector

    names, timers = ["place_key", *[f.name for f in EVENT]], []
    one = LocationCollector(names, 1, 0, 6, 3, False, 100, 50)
    one.progress, one.seen, one.waiting = Values(), Values(), Values()
    one.handle = type("Handle", (), {"registerTimer": staticmethod(timers.append)})
    page = pd.DataFrame([{"round": 0, "loading": False, "reviews": [{"review_id": "a", "body": "{}"}], "pass_no": 0, "ok": True}])
    events = pd.concat(one.handleInputRows(("p",), iter([page]), Clock(10)))
    assert list(events["kind"]) == ["review", "stop"] and timers == [110, 60] and not one.seen.exists()
    list(one.handleExpiredTimer(("p",), Clock(60), Clock(60)))
    assert not one.progress.exists()
    assert sum(map(len, one.handleExpiredTimer(("p",), Clock(110), Clock(110)))) == 0

    late = pd.DataFrame([{"round": 1, "loading": False, "reviews": [], "pass_no": 0, "ok": True}])
    list(one.handleInputRows(("q",), iter([late]), Clock(200)))
    events = pd.concat(one.handleExpiredTimer(("q",), Clock(300), Clock(300)))
    assert list(events["stop_reason"]) == ["timeout"] and timers[2:] == [300, 350] and not one.waiting.exists()


@pytest.mark.parametrize("second_looks", [False, True])
def test_a_page_of_an_unexpected_pass_is_rejected(second_looks):
    import pandas as pd

    from placelens.streaming.collector import EVENT, LocationCollector

    names = ["place_key", *[f.name for f in EVENT]]
    one = LocationCollector(names, None, 0, 6, 3, second_looks, None, None)
    one.progress, one.seen, one.waiting = Values(), Values(), Values()
    pages = [(0, 1 + second_looks, "x"), (0, 0, "a"), (1, 2, "y"), (1, 0, "b")]
    rows = [{"round": r, "loading": False, "reviews": [{"review_id": i, "body": "{}"}], "pass_no": k, "ok": True} for r, k, i in pages]
    events = pd.concat(one.handleInputRows(("p",), iter([pd.DataFrame(rows)]), Clock(10)))
    assert [(e.kind, e.review_id) for e in events.itertuples()] == [("rejected", None), ("review", "a"), ("rejected", None), ("review", "b")]


def test_stream_pages_check_place_and_order(spark):
    from placelens import schemas

    html = "<html><body><h1>X</h1>{}</body></html>".format
    order = '<div aria-live="polite" aria-atomic="true">Sorted: Newest</div>'
    url = "https://www.google.com/maps/place/P/data=!1s0x1:0x{}".format
    rows = [
        ("p", 0, 0, url(2), html(order), 1), ("p", 1, 0, url(3), html(order), 2), ("p", 2, 0, url(2), html(""), 3),
        ("p", 3, 0, url(2), html(order + "You see a limited view."), 4), ("other", 0, 0, url(2), html(order), 5),
    ]
    asked = spark.createDataFrame([("p", "0x1:0x2")], "place_key string, place_id string")
    pages = flows.stream_pages(spark.createDataFrame(rows, schemas.CAPTURE), None, asked, "newest")
    assert {(r.place_key, r.round, r.ok) for r in flows.captured_reviews(pages).collect()} == {
        ("p", 0, True), ("p", 1, False), ("p", 2, False), ("p", 3, False),
    }
