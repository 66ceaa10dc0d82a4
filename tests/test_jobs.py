"""Captured pages to files, with resume."""

import json

from placelens import schemas
from placelens.plans.jobs import batch_run, collect_places, run_batch, validate_path
from placelens.sources.readers import read_run_state

SHORT = "https://maps.app.goo.gl/"


def page(name, cards, extra="", count="9"):
    body = "".join(
        f'<div class="jftiEf"><b data-review-id="{i}"></b><div class="d4r55">Au</div>'
        f'<span class="kvMYJc" role="img" aria-label="{stars} stars"></span>'
        f'<div class="MyEned"><span class="wiI7pd">{text}</span></div></div>'
        for i, stars, text in cards
    )
    return f'<html><body><h1>{name}</h1><button role="tab">Reviews {count}</button>{extra}{body}</body></html>'


def capture(place, rnd, html, url="https://www.google.com/maps/place/x"):
    return (place, rnd, 0, url, html, 1_000_000 + rnd * 500)


def captures(spark):
    a, b, c, d = (f"{SHORT}{x}" for x in "abcd")
    rows = [
        capture(a, 0, page("Gym", [("1", 5, "one"), ("2", 9, "bad stars")])),
        capture(a, 1, page("Gym", [("1", 1, "one, longer"), ("2", 3, "two"), ("3", 4, "=three")], count="1,234")),
        capture(b, 0, page("Gym", [("1", 2, "other place")])),
        capture(c, 0, page("Cafe", [("1", 2, "x")], "You see a limited view.")),
        capture(c, 1, page("Cafe", [], "You see a limited view.")),
        capture(d, 0, page("Empty", [])),
    ]
    return spark.createDataFrame(rows, schemas.CAPTURE)


def requests(spark):
    return spark.createDataFrame([(f"{SHORT}{x}", None) for x in "abcd"], "place_key string, place_id string")


def test_collect_places(spark):
    found = collect_places(captures(spark), requests(spark), "newest", check_sort=False)
    docs = {r.place_key[-1]: r for r in found.documents("newest").collect()}
    assert set(docs) == {"a", "b", "d"}
    a = docs["a"]
    assert [(r.id, r.rating, r.text) for r in a.reviews] == [("1", 5, "one"), ("2", 3, "two"), ("3", 4, "=three")]
    assert (a.business.totalReviews, a.business.headerTotalReviews, a.business.rating) == (3, 1234, 1.0)
    assert (a.business.scrapeDate, a.metadata.scrapeDurationMs) == ("1970-01-01T00:16:40.500Z", 500.0)
    assert docs["d"].reviews == [] and docs["d"].business.rating is None
    assert {(r.place_key[-1], r.reject_reason) for r in found.rejected.collect()} == {("c", "limited_view")}
    found.register_views("run_")
    counts = spark.sql("SELECT place_key, count(*) AS n FROM run_reviews JOIN run_headers USING (place_key) GROUP BY 1")
    assert [(r.place_key[-1], r.n) for r in counts.filter("n > 1").collect()] == [("a", 3)]


def test_cap_and_wrong_place(spark):
    asked = spark.createDataFrame(
        [(f"{SHORT}a", None), (f"{SHORT}b", "0x1:0x2")], "place_key string, place_id string"
    )
    found = collect_places(captures(spark), asked, "newest", max_reviews=2, check_sort=False)
    docs = found.documents("newest").collect()
    assert [[r.id for r in d.reviews] for d in docs] == [["1", "2"]]
    assert {r.reject_reason for r in found.rejected.collect()} == {"NAV_VERIFY"}
    unsorted_ = collect_places(captures(spark), asked, "highest")
    assert unsorted_.documents("highest").count() == 0


def test_batch_with_resume(spark, tmp_path):
    (tmp_path / "one.txt").write_text(f"{SHORT}a\nnonsense\n")
    (tmp_path / "all.txt").write_text("\n".join(f"{SHORT}{x}" for x in "abcde"))
    out = str(tmp_path / "out")
    stored = captures(spark)
    first = run_batch(spark, str(tmp_path / "one.txt"), stored, out, "csv", batch_id=1, check_sort=False).collect()[0]
    assert (first.succeeded, first.failed, first.exit_code) == (1, 0, 0)
    second = run_batch(spark, str(tmp_path / "all.txt"), stored, out, "json", resume=True, batch_id=2, check_sort=False).collect()[0]
    assert (second.succeeded, second.failed, second.total, second.exit_code) == (2, 2, 4, 1)
    stems = sorted(p.parent.name for p in (tmp_path / "out").rglob("part-*.txt"))
    assert stems == ["file_stem=empty", "file_stem=gym", "file_stem=gym"]  # gym.csv and gym.json
    gym = next((tmp_path / "out" / "batch-2" / "file_stem=gym").rglob("*.txt"))
    assert json.loads(gym.read_text())["reviews"][0]["text"] == "other place"
    issues, summary = validate_path(spark, str(gym))
    assert issues.count() == 0
    assert [(r.valid, r.name, r.review_count) for r in summary.collect()] == [(True, "Gym", 1)]


def _left_behind(spark, out):
    files = sorted(str(p.relative_to(out).parent) + "|" + p.read_text() for p in out.rglob("part-*.txt"))
    state = sorted((r.input[-1], r.batch_id, r.run_no, r.file_stem) for r in read_run_state(spark, f"{out}/_state").collect())
    return files, state


def test_repeated_batches_remove_nothing(spark, tmp_path):
    (tmp_path / "list.txt").write_text("\n".join(f"{SHORT}{x}" for x in "aab"))
    out, stored = tmp_path / "out", captures(spark)
    for given in ({"batch_id": 7}, {}):
        options = {"resume": True, "check_sort": False, **given}
        run_batch(spark, str(tmp_path / "list.txt"), stored, str(out), **options).collect()
        before = _left_behind(spark, out)
        again = run_batch(spark, str(tmp_path / "list.txt"), stored, str(out), **options).collect()[0]
        assert _left_behind(spark, out) == before
        assert (again.total, again.exit_code) == (0, 0)
    files, state = before
    assert sorted(f.split("|")[0] for f in files) == [f"batch-7/file_stem={x}" for x in ("gym", "gym-2", "gym-3")]
    assert [s[:3] for s in state] == [("a", 7, 0), ("a", 7, 0), ("b", 7, 0)]
    fresh = batch_run(spark, str(tmp_path / "list.txt"), stored, str(out), check_sort=False)
    assert fresh.summary.collect()[0].total == 3
    assert {r.filename for r in fresh.files.collect()} == {"gym-4.json", "gym-5.json", "gym-6.json"}
    assert set(files) <= set(_left_behind(spark, out)[0])


def test_why_inputs_failed(spark, tmp_path):
    (tmp_path / "list.txt").write_text("\n".join([*(f"{SHORT}{x}" for x in "ace"), "nonsense"]))
    run = batch_run(spark, str(tmp_path / "list.txt"), captures(spark), str(tmp_path / "out"))
    assert {(r.input[-1], r.reason) for r in run.failures.collect()} == {
        ("a", "SORT_VERIFY"), ("c", "limited_view"), ("e", "NO_CAPTURE"), ("e", "INVALID_LOCATION"),
    }
    summary = run.summary.collect()[0]
    assert (summary.succeeded, summary.failed, summary.total, summary.exit_code) == (0, 3, 3, 1)
    (tmp_path / "bad.txt").write_text("nonsense")
    empty = run_batch(spark, str(tmp_path / "bad.txt"), captures(spark), str(tmp_path / "out")).collect()[0]
    assert (empty.total, empty.exit_code) == (0, 1)


def test_runs_that_start_together_keep_both_outputs(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    (tmp_path / "list.txt").write_text(f"{SHORT}a")
    stored, out = captures(spark), tmp_path / "out"

    def run(_):
        return batch_run(spark, str(tmp_path / "list.txt"), stored, str(out), check_sort=False).summary.first().succeeded

    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(run, range(2))) == [1, 1]
    assert sorted(p.name for p in out.glob("batch-*")) == ["batch-0", "batch-1"]
    assert len(list(out.rglob("part-*.txt"))) == 2
    assert sorted(r.batch_id for r in read_run_state(spark, f"{out}/_state").collect()) == [0, 1]
