"""Order-dependent jobs against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from placelens.operators import collect, ordered, runs

CARD_SCHEMA = "place_key string, round int, pass_no int, pos bigint, review_id string, rating int, text string"


def random_cards(seed, places=3, rounds=6):
    rng = random.Random(seed)
    return [
        (f"p{p}", r, k, i * 40000, f"id{rng.randrange(12)}", rng.randrange(6), f"t{rng.random()}")
        for p in range(places) for r in range(rounds) for k in range(2) for i in range(rng.randrange(5))
    ]


def loop_dedup(rows):
    seen, out = set(), []
    for row in sorted(rows, key=lambda x: (x[0], x[1], x[2], x[3])):
        if (row[0], row[4]) not in seen:
            seen.add((row[0], row[4]))
            out.append(row)
    return out


@pytest.fixture(params=[1, 2])
def cards(request, spark):
    rows = random_cards(request.param)
    return rows, spark.createDataFrame(rows, CARD_SCHEMA).repartition(5)


def test_first_copy_wins_and_dedup_is_idempotent(cards):
    rows, df = cards
    once = collect.dedup_first_seen(df)
    assert sorted(map(tuple, once.collect())) == sorted(loop_dedup(rows))
    assert sorted(collect.dedup_first_seen(once).collect()) == sorted(once.collect())
    assert once.columns == df.columns


@pytest.mark.parametrize("n", [1, 4, 100])
def test_cap(cards, monkeypatch, n):
    monkeypatch.setattr(collect, "ROUNDS_PER_BLOCK", 2)
    rows, df = cards
    got = collect.cap_per_location(collect.dedup_first_seen(df), n)
    want = []
    for p in {r[0] for r in rows}:
        want += [(*r, i + 1) for i, r in enumerate([x for x in loop_dedup(rows) if x[0] == p][:n])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("order,key", [
    ("newest", lambda r: 0), ("relevant", lambda r: 0), ("highest", lambda r: -r[5]), ("lowest", lambda r: r[5]),
])
def test_orders(cards, monkeypatch, order, key):
    monkeypatch.setattr(collect, "ROUNDS_PER_BLOCK", 2)
    rows, df = cards
    first = collect.dedup_first_seen(df)
    want = {}
    for p in {r[0] for r in rows}:
        mine = sorted((r for r in loop_dedup(rows) if r[0] == p), key=lambda r: (key(r), r[1:4]))
        want.update({(p, r[4]): i + 1 for i, r in enumerate(mine)})
    got = {(r.place_key, r.review_id): r.ordinal for r in collect.order_reviews(first, order).collect()}
    assert got == want
    top = {(r.place_key, r.review_id): r.ordinal for r in collect.top_n_reviews(first, order, 3).collect()}
    assert top == {k: v for k, v in want.items() if v <= 3}


@pytest.mark.parametrize("coarse", [None, 3])
def test_running_values_in_one_pass(spark, coarse):
    """Sums, maxima, peaks and key totals against a loop, over blocks of four and blocks of those."""
    rng = random.Random(9)
    rows = [(f"k{k}", i, rng.randrange(-5, 9), rng.random() < 0.2) for k in range(3) for i in range(70 * k + 1)]
    df = spark.createDataFrame(rows, "k string, i int, v int, on boolean")
    got = ordered.running(
        df, ["k"], [ordered.block_of(F.col("i"), 4)], [F.col("i")],
        sums={"s": F.col("v"), "n": F.lit(1).cast("bigint")}, maxima={"m": F.col("v")},
        peaks={"p": ordered.Peak("s", F.when(F.col("on"), F.col("v"))), "q": ordered.Peak("n", F.col("v"), -2)},
        of_key={"s": "all_s"}, coarse=[ordered.block_of(F.col("_block0"), coarse)] if coarse else None,
    )
    want = []
    for k in {r[0] for r in rows}:
        s = n = 0
        m = p = q = None
        mine = [r for r in rows if r[0] == k]
        for _, i, v, on in mine:
            s, n, m = s + v, n + 1, v if m is None else max(m, v)
            p = max(x for x in (p, v + s) if x is not None) if on else p
            q = v - 2 * n if q is None else max(q, v - 2 * n)
            want.append((k, i, v, on, sum(r[2] for r in mine), s, n, m, p, q))
    assert sorted(map(tuple, got.select("k", "i", "v", "on", "all_s", "s", "n", "m", "p", "q").collect())) == sorted(want)


def test_arguments_are_checked(cards):
    with pytest.raises(ValueError):
        collect.cap_per_location(cards[1], 0)
    with pytest.raises(ValueError):
        collect.order_reviews(cards[1], "oldest")


def loop_stop(rounds, cap):
    """The polling loop for one location: rounds of (new, loading)."""
    total = stale = spin = 0
    dry = []
    stop = None
    for i, (new, loading) in enumerate(rounds):
        total += new
        if new:
            stale = spin = 0
            if cap is not None and total >= cap and stop is None:
                stop = (i, "max")
        elif loading:
            spin += 1
            if spin >= 3:
                stale, spin = stale + 1, 0
        else:
            stale += 1
            if stale >= 6 and stop is None:
                stop = (i, "exhausted")
        dry.append((total, stale))
    return stop, dry


@pytest.mark.parametrize("block", [1, 3, 1024])
@pytest.mark.parametrize("cap", [None, 5])
def test_stop_rule(spark, monkeypatch, block, cap):
    rng = random.Random(block)
    places = {
        f"p{p}": [(rng.choice([0] * (3 + p) + [1, 2]), rng.random() < 0.4) for _ in range(60)] for p in range(6)
    }
    places["spinner"] = [(0, True)] * 80
    places["late"] = [(0, True)] * 18 + [(0, False)]
    rows = [(p, i, n, load) for p, rs in places.items() for i, (n, load) in enumerate(rs)]
    df = spark.createDataFrame(rows, "place_key string, round int, new_reviews bigint, loading boolean")
    got = collect.dry_counts(df, block).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.total_reviews, r.dry_count) == loop_stop(places[r.place_key], None)[1][r.round]
    monkeypatch.setattr(collect, "ROUNDS_PER_BLOCK", block)
    stops = {r.place_key: (r.stop_round, r.stop_reason) for r in collect.stop_rounds(df, cap).collect()}
    assert stops == {p: s for p, rs in places.items() if (s := loop_stop(rs, cap)[0])}
    assert "spinner" not in stops and stops["late"] == (18, "exhausted")


def test_rounds_without_reviews_count_and_rows_after_the_stop_go(spark):
    seen = spark.createDataFrame(
        [("p", 0, "a"), ("p", 0, "b"), ("p", 9, "c")], "place_key string, round int, review_id string"
    )
    pages = spark.createDataFrame([("p", r, False) for r in range(10)], "place_key string, round int, loading boolean")
    counts = collect.round_counts(pages, seen)
    assert {r.round: r.new_reviews for r in counts.collect()} == {0: 2, 9: 1, **{r: 0 for r in range(1, 9)}}
    stops = collect.stop_rounds(counts)
    assert [tuple(r) for r in stops.collect()] == [("p", 6, "exhausted")]
    assert {r.review_id for r in collect.before_stop(seen, stops).collect()} == {"a", "b"}
    assert collect.before_stop(seen, stops.filter("false")).count() == 3


def test_first_matching(spark):
    df = spark.createDataFrame(
        [(1, 0, "menu"), (1, 2, "Reviews 4"), (1, 1, "review"), (2, 0, "none")], "page int, pos int, text string"
    )
    got = collect.first_matching(df, ["page"], "text", "pos", F.lower("text").contains("review"))
    assert [tuple(r) for r in got.collect()] == [(1, "review", 1)]


# --- runs --------------------------------------------------------------------
def test_attempt_outcomes(spark):
    rows = [
        ("a", 1, 0, 10, True, None), ("a", 2, 20, 30, False, "x"),
        ("b", 1, 0, 10, False, "net"), ("b", 2, 20, 30, True, None),
        ("c", 1, 0, 10, False, "CAPTCHA"), ("c", 2, 20, 30, True, None),
        ("d", 1, 0, 10, False, "1"), ("d", 2, 20, 30, False, "2"), ("d", 3, 40, 50, False, "3"), ("d", 4, 60, 70, True, None),
        ("e", 1, 0, 400000, True, None),
    ]
    df = spark.createDataFrame(
        rows, "place_key string, attempt_id bigint, start_ms bigint, end_ms bigint, ok boolean, message string"
    )
    got = {r.place_key: (r.attempts, r.ok, r.message) for r in runs.attempt_outcomes(df).collect()}
    assert got == {
        "a": (1, True, None), "b": (2, True, None), "c": (1, False, "CAPTCHA"), "d": (3, False, "3"), "e": (1, True, None),
    }
    timed = {r.place_key: (r.ok, r.message) for r in runs.attempt_outcomes(df, limit_ms=300000).collect()}
    assert timed["e"] == (False, "Location timeout after 300s") and timed["b"] == (True, None)
    summary = runs.batch_summary(runs.attempt_outcomes(df).withColumn("run_id", F.lit("r"))).collect()[0]
    assert (summary.succeeded, summary.failed, summary.total, summary.exit_code) == (3, 2, 5, 1)
    assert summary.elapsed_ms == 400000


def test_schedule_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(f"l{i % 2}", i, rng.randrange(200000)) for i in range(200)]
    df = spark.createDataFrame(rows, "lane string, seq bigint, arrival_ms bigint")
    want, last = {}, {}
    for lane, seq, arrival in rows:
        start = arrival if lane not in last else max(arrival, last[lane] + 1000)
        want[seq] = last[lane] = start
    got = {r.seq: r.start_ms for r in runs.spaced_schedule(df, 1000).collect()}
    assert got == want


def test_retry_gaps(spark):
    rows = [("a", 0, 0, 10, False), ("a", 1, 1500, 1600, False), ("a", 2, 9700, 9800, True), ("b", 0, 0, 5, True), ("b", 1, 6, 7, True)]
    df = spark.createDataFrame(rows, "place_key string, attempt_no bigint, start_ms bigint, end_ms bigint, ok boolean")
    got = sorted(map(tuple, runs.retry_gap_audit(df).collect()))
    assert got == [("a", 0, 1490, 2000, True), ("a", 1, 8100, 8000, False)]
