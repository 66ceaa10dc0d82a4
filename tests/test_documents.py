"""Documents: assembly, exports, and validation of raw JSON."""

import copy
import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from placelens import schemas, session
from placelens.operators import assemble, validation
from placelens.operators.reviews import normalise_reviews, rejected_reviews, review_issue_rows
from placelens.sinks import writers
from placelens.sources import readers

HEADER = ("place_key string, name string, place_id string, url string, address string, header_rating double, "
          "header_total_reviews bigint, scrape_date string, scrape_duration_ms bigint")


def raw_row(i, **changes):
    row = dict(place_key="p", round=0, pos=i, review_id=f"r{i}", author="A", author_url=None, publish_time="t",
               rating=5, text=f"text {i}", original_text=None, photos=0, owner_response_text=None,
               owner_response_time=None)
    return {**row, **changes}


def raw(spark, rows):
    return spark.createDataFrame(rows, schemas.RAW_REVIEW)


def tables(spark, counts):
    """Headers and reviews of ``counts``: place -> (claimed, collected)."""
    heads = spark.createDataFrame(
        [(p, f"Name {p}", None, "u", None, 4.5, claimed, "2025-01-01T00:00:00Z", 7) for p, (claimed, _) in counts.items()],
        HEADER,
    )
    rows = [raw_row(i, place_key=p) for p, (_, n) in counts.items() for i in range(n)]
    return heads, normalise_reviews(raw(spark, rows))


def documents(spark, counts):
    return assemble.assemble_documents(*tables(spark, counts), "newest")


def files_of(lines, path):
    """What ``write_files`` writes, by stem; each stem has one file."""
    writers.write_files(lines.withColumn("file_stem", F.col("place_key")), str(path))
    found = sorted(path.rglob("*.txt"))
    texts = {f.parent.name.removeprefix("file_stem="): f.read_bytes().decode() for f in found}
    assert len(texts) == len(found)
    return texts


COUNTS = {"a": (90, 3), "b": (42, 42), "c": (10, 0), "d": (None, 5), "e": (None, 0), "f": (2, 11)}


def test_counts_are_reconciled(spark):
    for r in documents(spark, COUNTS).collect():
        claimed, collected = COUNTS[r.place_key]
        assert r.business.totalReviews == r.metadata.reviewsCollected == len(r.reviews) == collected
        assert r.business.headerTotalReviews == claimed
        assert [x.id for x in r.reviews] == [f"r{i}" for i in range(collected)]
        assert (r.metadata.provider, r.metadata.sortOrder, r.metadata.scrapeDurationMs) == ("playwright", "newest", 7.0)


def test_a_location_of_any_size_is_one_file(spark, tmp_path):
    """20,000 reviews in one location: one JSON and one CSV file, byte by byte."""
    counts = {"a": (None, 20_000), "b": (3, 1), "c": (None, 0)}
    heads, reviews = tables(spark, counts)
    reviews = reviews.repartition(7)
    docs = {r.place_key: r.asDict(recursive=True) for r in assemble.assemble_documents(heads, reviews, "newest").collect()}
    got = files_of(assemble.document_lines(heads, reviews, "newest", "json"), tmp_path / "j")
    for p, doc in docs.items():
        doc = {k: doc[k] for k in ("business", "reviews", "metadata")}
        doc["metadata"]["scrapeDurationMs"] = 7  # a whole number has no fraction
        assert got[p] == json.dumps(doc, indent=2, ensure_ascii=False) + "\n"
        assert len(doc["reviews"]) == doc["business"]["totalReviews"] == counts[p][1]
    lines = files_of(assemble.document_lines(heads, reviews, "newest", "csv"), tmp_path / "c")
    assert set(lines) == set(counts)
    for p, (_, n) in counts.items():
        text = [f"Name {p},r{i},A,,5,t,text {i},text {i},english,0,,\n" for i in range(n)]
        assert lines[p] == ",".join(writers.V.CSV_COLUMNS) + "\n" + "".join(text)


def test_json_texts_are_escaped(spark, tmp_path):
    odd = 'q"\\ \n\t\u0001 ünd 🙂 \u2028 </x>'
    heads, _ = tables(spark, {"a": (None, 0)})
    reviews = normalise_reviews(raw(spark, [raw_row(0, place_key="a", text=odd, owner_response_text=odd, author=odd)]))
    doc = json.loads(files_of(assemble.document_lines(heads, reviews, "lowest", "json"), tmp_path / "j")["a"])
    assert doc["reviews"][0]["text"] == doc["reviews"][0]["ownerResponse"]["text"] == doc["reviews"][0]["author"] == odd
    assert doc["metadata"]["sortOrder"] == "lowest" and doc["business"]["rating"] == 4.5


def test_json_spells_out_nulls_and_reads_back(spark, tmp_path):
    docs = documents(spark, {"a": (None, 2)})
    writers.write_documents_json(docs, str(tmp_path / "j"))
    text = spark.read.text(str(tmp_path / "j")).first()[0]
    doc = json.loads(text)
    assert doc["business"]["placeId"] is None and doc["business"]["headerTotalReviews"] is None
    assert doc["reviews"][0]["ownerResponse"] is None and set(doc) == {"business", "reviews", "metadata"}
    back = readers.read_review_documents(spark, str(tmp_path / "j"), one_per_file=False)
    assert back.collect() == docs.select("business", "reviews", "metadata").collect()


def test_pretty_printed_and_older_documents_read(spark, tmp_path):
    doc = valid_document()
    del doc["business"]["headerTotalReviews"]
    doc["extra"] = 1
    (tmp_path / "old.json").write_text(json.dumps(doc, indent=2))
    row = readers.read_review_documents(spark, str(tmp_path / "old.json")).first()
    assert row.business.headerTotalReviews is None and row.business.totalReviews == 312
    assert row.reviews[0].ownerResponse.text == "Thanks" and not hasattr(row, "extra")


def test_csv_per_location_is_byte_exact(spark, tmp_path):
    rows = [
        raw_row(0, author='A, "B"', text="=SUM(1)", owner_response_text="@x", owner_response_time="now"),
        raw_row(1, text="a\nb", original_text="مكان", photos=2, rating=0),
    ]
    heads = spark.createDataFrame([("p", "-N", None, "u", None, None, None, "d", 1), ("q", "Q", None, "u", None, None, None, "d", 1)], HEADER)
    reviews = normalise_reviews(raw(spark, rows))
    files = files_of(assemble.document_lines(heads, reviews, "lowest", "csv"), tmp_path / "c")
    head = ("business_name,review_id,author,author_url,rating,publish_time,text,original_text,original_language,"
            "photos,owner_response_text,owner_response_time\n")
    assert files["q"] == head
    assert files["p"] == head + (
        '"\t-N",r0,"A, ""B""",,5,t,"\t=SUM(1)","\t=SUM(1)",english,0,"\t@x",now\n'
        '"\t-N",r1,A,,0,t,"a\nb",مكان,arabic,2,,\n'
    )


def test_output_format_is_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        writers.write_output(documents(spark, {"a": (1, 1)}), str(tmp_path), "xml")
    with pytest.raises(ValueError):
        assemble.document_lines(*tables(spark, {"a": (1, 1)}), "newest", "xml")
    with pytest.raises(ValueError):
        assemble.document_lines(*tables(spark, {"a": (1, 1)}), "oldest", "csv")


def test_invalid_rows_go_to_the_rejects(spark):
    rows = [
        raw_row(0), raw_row(1, rating=6), raw_row(2, rating=-1), raw_row(3, author=None), raw_row(4, publish_time=None),
        raw_row(5, photos=-1), raw_row(6, rating=None), raw_row(7, rating=0), raw_row(8, review_id=""), raw_row(9, photos=None),
    ]
    df = raw(spark, rows)
    assert sorted(r.pos for r in normalise_reviews(df).collect()) == [0, 7, 8]
    assert sorted(r.pos for r in rejected_reviews(df).collect()) == [1, 2, 3, 4, 5, 6, 9]
    issues = {(r.pos, r.path, r.code) for r in review_issue_rows(df, "pos").collect()}
    assert {(1, "rating", "too_big"), (2, "rating", "too_small"), (3, "author", "required")} < issues
    fractional = df.withColumn("rating", F.lit(3.5))
    assert normalise_reviews(fractional).count() == 0
    assert ("rating", "not_integer") in {(r.path, r.code) for r in review_issue_rows(fractional, "pos").collect()}


# --- raw JSON ----------------------------------------------------------------
def valid_document():
    return {
        "business": {"name": "Demo", "placeId": "0x1:0x2", "url": "u", "address": None, "rating": 7.5,
                     "totalReviews": 312, "headerTotalReviews": None, "scrapeDate": "2025-01-01T00:00:00Z"},
        "reviews": [
            {"id": "r1", "author": "A", "authorUrl": None, "publishTime": "t", "rating": 5, "text": "x", "originalText": "x",
             "originalLanguage": "english", "photos": 0,
             "ownerResponse": {"text": "Thanks", "originalText": None, "originalLanguage": None, "publishTime": None}},
            {"id": "r2", "author": "B", "authorUrl": None, "publishTime": "t", "rating": 0, "text": None, "originalText": None,
             "originalLanguage": None, "photos": 3, "ownerResponse": None},
        ],
        "metadata": {"provider": "playwright", "scrapeDurationMs": -1.5, "reviewsCollected": -2, "sortOrder": "lowest"},
    }


DELETE = object()
FAULTS = [
    ("business.name", DELETE, "required"), ("business.name", None, "type"), ("business.name", 5, "type"),
    ("business.placeId", DELETE, "required"), ("business.rating", "4.5", "type"), ("business.totalReviews", -1, "too_small"),
    ("business.totalReviews", 2.5, "not_integer"), ("business.headerTotalReviews", "1568", "type"),
    ("business.headerTotalReviews", 3.5, "not_integer"), ("business.headerTotalReviews", -1, "too_small"),
    ("business", DELETE, "required"), ("business", None, "type"), ("business", [], "type"),
    ("reviews", DELETE, "required"), ("reviews", {}, "type"), ("reviews", None, "type"),
    ("reviews.1", 7, "type"), ("reviews.1", None, "type"), ("reviews.0.rating", 6, "too_big"),
    ("reviews.0.rating", -1, "too_small"), ("reviews.0.rating", 3.5, "not_integer"), ("reviews.0.rating", "5", "type"),
    ("reviews.0.author", DELETE, "required"), ("reviews.1.photos", -1, "too_small"), ("reviews.1.photos", DELETE, "required"),
    ("reviews.1.ownerResponse", DELETE, "required"), ("reviews.1.ownerResponse", "no", "type"),
    ("reviews.0.ownerResponse.text", 5, "type"), ("reviews.0.ownerResponse.publishTime", DELETE, "required"),
    ("metadata.provider", "other", "enum"), ("metadata.sortOrder", "random", "enum"), ("metadata.sortOrder", 5, "type"),
    ("metadata.reviewsCollected", 1.5, "not_integer"), ("metadata", DELETE, "required"),
]
FINE = [
    ("business.headerTotalReviews", DELETE), ("business.headerTotalReviews", 0), ("business.totalReviews", None),
    ("business.rating", None), ("reviews.0.rating", 5.0), ("reviews", []), ("metadata.scrapeDurationMs", 0.25),
    ("business.extra", {"a": 1}), ("business.totalReviews", 0),
]


def changed(path, value):
    doc = copy.deepcopy(valid_document())
    *parents, last = [int(p) if p.isdigit() else p for p in path.split(".")]
    at = doc
    for p in parents:
        at = at[p]
    if value is DELETE:
        del at[last]
    else:
        at[last] = value
    return json.dumps(doc)


def test_validation(spark):
    texts = [changed(p, v) for p, v, _ in FAULTS] + [changed(p, v) for p, v in FINE]
    texts += ["{not json}", "", "[1]", "5", '{"foo": "bar"}', None, "  \n" + changed("reviews", [])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")
    got = {}
    for r in validation.validate_documents(df, "i").collect():
        got.setdefault(r.i, set()).add((r.path, r.code))
    for i, (path, _, code) in enumerate(FAULTS):
        assert got.pop(i) == {(path, code)}, FAULTS[i]
    at = len(FAULTS) + len(FINE)
    assert got == {
        at: {("", "json")}, at + 1: {("", "json")}, at + 2: {("", "type")}, at + 3: {("", "type")},
        at + 4: {("business", "required"), ("reviews", "required"), ("metadata", "required")}, at + 5: {("", "unreadable")},
    }
    summary = {r.i: r for r in validation.document_summary(df, "i").collect()}
    assert not summary[0].valid and summary[at - 1].valid and summary[at - 1].name == "Demo"
    assert summary[at - 1].review_count == 2 and summary[at + 4].issue_count == 3


def test_the_last_of_repeated_keys_counts(spark):
    good = json.dumps(valid_document())
    inner = good.replace('"name": "Demo"', '"name": 5, "name": "Demo"').replace('"rating": 5,', '"rating": "x", "rating": 5,')
    outer = '{"reviews": 3, "business": null, ' + good[1:]
    worse = good[:-1] + ', "reviews": 3}'
    df = spark.createDataFrame(enumerate([inner, outer, worse]), "i int, value string")
    assert [(r.i, r.path, r.code) for r in validation.validate_documents(df, "i").collect()] == [(2, "reviews", "type")]
    assert {r.i: r.name for r in validation.document_summary(df, "i").collect()} == {0: "Demo", 1: "Demo", 2: "Demo"}
    assert spark.conf.get("spark.sql.variant.allowDuplicateKeys") == "false"
    states = spark.createDataFrame([('{"completed": 1, "completed": ["a"]}',), ('{"completed": ["a"], "completed": 1}',)], "value string")
    assert [r.input for r in readers.state_inputs(states).collect()] == ["a"]


def test_unreadable_files_are_rows(spark, tmp_path):
    from placelens.plans.jobs import validate_path

    good = json.dumps(valid_document())
    (tmp_path / "good.json").write_text(good)
    (tmp_path / "broken.json.gz").write_bytes(b"this is not what its name says")
    (tmp_path / "bytes.json").write_bytes(good.encode().replace(b"Demo", b"\xff\xfeDemo"))
    issues, summary = validate_path(spark, str(tmp_path))
    assert {(r.source_file.rsplit("/")[-1], r.code) for r in issues.collect()} == {("broken.json.gz", "unreadable")}
    rows = {r.source_file.rsplit("/")[-1]: (r.valid, r.name) for r in summary.collect()}
    assert rows == {"good.json": (True, "Demo"), "bytes.json": (True, "\ufffd\ufffdDemo"), "broken.json.gz": (False, None)}
    lines, _ = validate_path(spark, str(tmp_path), one_per_file=False)
    assert {(r.source_file.rsplit("/")[-1], r.code) for r in lines.collect()} == {("broken.json.gz", "unreadable")}


def test_files_of_many_chunks_keep_their_order(spark, tmp_path, monkeypatch):
    """Lines are joined in chunks, which alone are sorted by a file's one writer; null values are empty lines."""
    monkeypatch.setattr(writers, "LINES_PER_CHUNK", 7)
    rows = [("a", s, i, None if i == 50 else f"{s} {i}") for s in (0, 1, 2) for i in range(100)] + [("b", 0, 0, "x"), (None, 0, 0, "y")]
    lines = spark.createDataFrame(rows, "place_key string, section int, ordinal bigint, value string").repartition(5)
    texts = files_of(lines, tmp_path / "out")
    want = "".join(("" if i == 50 else f"{s} {i}") + "\n" for s in (0, 1, 2) for i in range(100))
    assert texts == {"a": want, "b": "x\n", "__HIVE_DEFAULT_PARTITION__": "y\n"}


def test_files_are_written_by_as_many_tasks_as_set(spark, tmp_path):
    """Small files cost by their number, so few bytes are no reason to give all files to one task (F6, F7)."""
    rows = spark.range(400).selectExpr("'s' || id AS file_stem", "0 AS section", "id AS ordinal", "'v' AS value")
    writers.write_files(rows, str(tmp_path / "out"))
    tasks = {f.name.split("-")[1] for f in (tmp_path / "out").rglob("part-*")}
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def shuffle_files(spark):
    """Shuffle files of this session that are on disk."""
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
    return {f for d in dirs for f in Path(d.toString()).rglob("shuffle_*.data")}


def test_writing_files_leaves_no_shuffle_behind(spark, tmp_path):
    """Beside the files only packed chunks stay on the disks; before, every shuffle of the lines did (F1, F2)."""
    names = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.parquet.enableVectorizedReader")
    settings = [spark.conf.get(n, None) for n in names]
    rows = spark.range(5000).selectExpr("'s' || id % 3 AS place_key", "1 AS section", "id AS ordinal", "'v' || id AS value").repartition(5)
    before = shuffle_files(spark)
    texts = files_of(rows, tmp_path / "out")
    assert texts == {f"s{k}": "".join(f"v{i}\n" for i in range(k, 5000, 3)) for k in range(3)}
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)  # they are removed beside the job
    assert not left
    assert [spark.conf.get(n, None) for n in names] == settings


def test_chunks_are_stored_packed(spark, tmp_path):
    """Chunks of a bounded number of lines are stored by zstd; the files are written from them (F1, F2)."""
    scratch = Path(session.scratch_path(spark, "x")).parent
    before = set(scratch.glob("file-chunks-*"))
    rows = spark.range(1000).selectExpr("'a' AS place_key", "1 AS section", "id AS ordinal", "'v' AS value")
    files_of(rows, tmp_path / "out")
    (stored,) = set(scratch.glob("file-chunks-*")) - before
    chunks = spark.read.parquet(str(stored))
    assert chunks.count() == 1000 / writers.LINES_PER_CHUNK and all(f.endswith(".zstd.parquet") for f in chunks.inputFiles())
