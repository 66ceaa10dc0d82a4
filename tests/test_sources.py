"""Location lists, run state, and the jobs that use them."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from placelens.operators import locations
from placelens.sinks.writers import commit_run_state
from placelens.sources import readers
from placelens.sources.json_blocks import Block, joined, unescaped

SHORT = "https://maps.app.goo.gl/"


def lists(spark, tmp_path):
    rows = readers.read_location_lists(spark, str(tmp_path)).collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.source_file, r.ordinal)):
        out.setdefault(r.source_file.rsplit("/", 1)[1], []).append(r.input)
    return out


CONTENT = {
    "lines.txt": f"# head\n{SHORT}a\n\n   \n  {SHORT}b  \r\nnonsense\n{SHORT}a\n#x",
    "array.json": json.dumps([f" {SHORT}a ", 5, "", "bad", None, f"{SHORT}a", ["x"]]),
    "pretty.json": json.dumps([f"{SHORT}a", f"{SHORT}b"], indent=2),
    "object.json": '{"a": 1}',
    "empty.txt": "",
    "broken.json": f"[{SHORT}a",
    "lines_of_arrays.txt": '["x"]\n["y"]',
}
WANT = {
    "lines.txt": [f"{SHORT}a", f"{SHORT}b", "nonsense", f"{SHORT}a"],
    "array.json": [f" {SHORT}a ", "bad", f"{SHORT}a"],
    "pretty.json": [f"{SHORT}a", f"{SHORT}b"],
    "object.json": ['{"a": 1}'],
    "broken.json": [f"[{SHORT}a"],
    "lines_of_arrays.txt": ['["x"]', '["y"]'],
}


def test_lists(spark, tmp_path):
    for name, text in CONTENT.items():
        (tmp_path / name).write_text(text)
    assert lists(spark, tmp_path) == WANT


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lists_are_read_in_splits(spark, tmp_path, small_splits):
    """Lines, and arrays that are printed over many lines, with items of all kinds, in splits of 5,000 bytes."""
    lines = [f"{SHORT}{i}" if i % 3 else f"# {i}" for i in range(3000)]
    items = [rng_item(i) for i in range(1500)]
    texts = {
        "big.txt": "\n".join(lines), "big.json": json.dumps(items, indent=1), "one_line.json": json.dumps(items),
        "late.json": "\n" * 12000 + json.dumps(items, indent=2, ensure_ascii=False), "cut.json": json.dumps(items, indent=1)[:-1],
        "more.json": json.dumps(items, indent=1) + "\n" * 9000 + "x", "object.json": json.dumps({"a": items}, indent=1),
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    found = lists(spark, tmp_path)
    as_lines = {n: [x for y in t.split("\n") if (x := y.strip()) and not x.startswith("#")] for n, t in texts.items()}
    wanted = [x for x in items if isinstance(x, str) and x.strip()]
    assert found == {**as_lines, **{n: wanted for n in ("big.json", "one_line.json", "late.json")}}
    ordinals = {r.ordinal for r in readers.read_location_lists(spark, str(tmp_path / "big.json")).collect()}
    assert ordinals == {i for i, x in enumerate(items) if isinstance(x, str) and x.strip()}


def test_texts_of_lists_are_stored_once_and_not_shuffled(spark, tmp_path):
    """Only where splits stand is sent to the texts, which are stored packed and stay where they are (F3)."""
    (tmp_path / "array.json").write_text(json.dumps([f"{SHORT}{i}" for i in range(100)], indent=2))
    rows = readers.read_location_lists(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "MapInArrow" not in plan
    assert rows.count() == 100 and any(f.endswith(".zstd.parquet") for f in rows.inputFiles())


def rng_item(i):
    return [f"{SHORT}{i}", i, None, {"a": [f"x{i}", {"b": "]}"}], "c": "d"}, [[], "y"], ' "[q], é\\\n', "", " "][i % 8]


def test_a_list_of_any_size_equals_its_small_twins(spark, tmp_path):
    """50 MB as an array, in one line and in many, and as lines."""
    items = [f"{SHORT}{i}/{'x' * 2500}" for i in range(20_000)]
    (tmp_path / "lines.txt").write_text("\n".join(items))
    (tmp_path / "array.json").write_text(json.dumps(items))
    (tmp_path / "pretty.json").write_text(json.dumps(items, indent=2))
    rows = readers.read_location_lists(spark, str(tmp_path)).groupBy("source_file").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("ordinal", "input").cast("decimal(38)")).alias("sum")
    ).collect()
    small = spark.createDataFrame(enumerate(items), "ordinal bigint, input string")
    want = small.agg(F.sum(F.xxhash64("ordinal", "input").cast("decimal(38)"))).first()[0]
    assert {(r.n, r.sum) for r in rows} == {(20_000, want)} and len(rows) == 3


@settings(max_examples=300, deadline=None)
@given(st.recursive(st.none() | st.integers() | st.text(alphabet='a"\\]}{[,:é\n', max_size=4), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("kq", max_size=2), x, max_size=3), max_leaves=12),
       st.sampled_from([None, 0, 1]), st.lists(st.integers(0, 40), max_size=3), st.integers(0, 200), st.sampled_from(["", ",", "]", "[", "}", '"', ":", "1", "\n"]), st.booleans())
def test_blocks_of_json_against_a_parser(doc, indent, cuts, at, mark, spoil):
    text = json.dumps(doc, indent=indent)
    if spoil:
        text = text[:at] + mark + text[at + 1 :]
    try:
        doc = json.loads(text)
    except ValueError:
        doc = None
    lines = text.split("\n")
    bounds = sorted({0, len(lines), *(c for c in cuts if c < len(lines))})
    blocks, found = [], []
    for a, b in zip(bounds, bounds[1:]):
        blocks.append(Block(first=a == 0))
        found.append([])
        for line in lines[a:b]:
            blocks[-1].read(line, found[-1])
    is_array, places = joined([b.summary() for b in blocks])
    assert is_array == isinstance(doc, list)
    if is_array:
        got = [(p.commas + n, unescaped(t)) for p, texts in zip(places, found) for depth, n, t in texts if depth + p.depth == 1]
        assert got == [(i, x) for i, x in enumerate(doc) if isinstance(x, str)]


def test_valid_and_rejected_split_the_inputs(spark, tmp_path):
    (tmp_path / "l.txt").write_text(CONTENT["lines.txt"])
    inputs = readers.read_location_lists(spark, str(tmp_path))
    assert [r.input for r in locations.valid_locations(inputs).collect()] == [f"{SHORT}a", f"{SHORT}b", f"{SHORT}a"]
    assert [r.input for r in locations.rejected_locations(inputs).collect()] == ["nonsense"]


def test_state(spark, tmp_path):
    path = str(tmp_path / "state")
    assert readers.read_run_state(spark, path).count() == 0
    done = spark.createDataFrame([("a",), ("b",)], "input string")
    commit_run_state(done, path, 1)
    commit_run_state(done, path, 1)
    commit_run_state(done.filter("input = 'a'"), path, 2)
    assert sorted((r.batch_id, r.input) for r in readers.read_run_state(spark, path).collect()) == [(1, "a"), (1, "b"), (2, "a")]
    assert readers.read_run_state(spark, path, resume=False).count() == 0
    inputs = spark.createDataFrame([("a",), ("c",), ("c",), ("a ",)], "input string")
    pending = locations.pending_locations(inputs, readers.read_run_state(spark, path))
    assert sorted(r.input for r in pending.collect()) == ["a ", "c", "c"]


def test_state_files(spark, tmp_path):
    texts = {
        "ok": '{"completed": ["x", "y"], "more": 1}', "empty": '{"completed": []}', "mixed": '{"completed": ["x", 1]}',
        "text": '{"completed": "x"}', "none": "{}", "array": '["x"]', "broken": "{",
        "trailing": '{"completed": ["x"]} more', "closed": '{"completed": ["x"]}],[', "member": '{"completed": ["x"]},"a":1',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        got = [r.input for r in readers.read_state_file(spark, str(tmp_path / name)).collect()]
        assert got == (["x", "y"] if name == "ok" else []), name
    assert readers.read_state_file(spark, str(tmp_path / "absent")).count() == 0
    assert readers.read_state_file(spark, str(tmp_path / "ok"), resume=False).count() == 0


def test_identity(spark):
    loaded = spark.createDataFrame(
        [("a", "https://x/data=!1s0xA:0xb"), ("b", "https://x/data=!1s0x9:0x9"), ("c", "https://x"), ("d", "https://x"), ("e", "https://x/?ftid=0x1:0x2")],
        "place_key string, resolved_url string",
    )
    asked = spark.createDataFrame(
        [("a", "0xa:0xB"), ("b", "0x1:0x1"), ("c", "0x1:0x1"), ("d", "ChIJxyz"), ("e", None)], "place_key string, place_id string"
    )
    got = {r.place_key: (r.verified, r.final_place_id, r.error_kind) for r in locations.verify_identity(loaded, asked).collect()}
    assert got == {
        "a": (True, "0xa:0xB", None), "b": (False, "0x1:0x1", "NAV_VERIFY"), "c": (False, "0x1:0x1", "NAV_VERIFY"),
        "d": (True, "ChIJxyz", None), "e": (True, "0x1:0x2", None),
    }


def test_navigation_urls(spark):
    df = spark.createDataFrame([("https://google.com/maps?hl=en",), (f"{SHORT}x",)], "url string")
    got = [(r.target_url, r.needs_locale_fix) for r in locations.navigation_urls(df).collect()]
    assert got == [("https://google.com/maps?hl=en", False), (f"{SHORT}x", True)]
    assert df.select(F.count("*")).first()[0] == 2


def test_digests_of_files_read_in_splits(spark, tmp_path, monkeypatch):
    """Equal to hashlib's over whole files, without a row that holds one (F1, F2)."""
    import hashlib

    texts = {"a": "é\r\n" + "long line " * 50 + "\n\n\n" + "x\n" * 3000, "b": "no newline at the end", "c": "\n", "d": "one\ntwo \U0001f600"}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    monkeypatch.setattr(readers, "CHUNK_BYTES", 256)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = readers.file_digests(spark, str(tmp_path))
        assert "WholeText" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r.source_file[-5]: (r.chars, r.content_sha256) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {n: (len(t), hashlib.sha256(t.encode()).hexdigest()) for n, t in texts.items()}
