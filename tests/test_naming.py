import random

import pytest

from placelens.functions.text import file_slug
from placelens.operators import naming


def plan(spark, names, existing, ext=".json"):
    names_df = spark.createDataFrame(list(enumerate(names)), "arrival bigint, name string")
    files = spark.createDataFrame([(f,) for f in existing], "filename string")
    rows = naming.file_plan(names_df, files, ext).collect()
    assert len(rows) == len(names)
    return [r.filename for r in sorted(rows, key=lambda r: r.arrival)]


def test_counters_and_existing_names(spark):
    got = plan(spark, ["A", "a!", "B", "A"], ["a.json", "a-3.json", "b.csv", "a-x.json"])
    assert got == ["a-2.json", "a-4.json", "b.json", "a-5.json"]


def test_no_existing_files(spark):
    assert plan(spark, ["X", "X", "Y"], [], ".csv") == ["x.csv", "x-2.csv", "y.csv"]


@pytest.mark.parametrize("names,want", [
    (["A", "A 2", "A"], ["a.json", "a-2.json", "a-3.json"]),
    (["A", "A", "A 2"], ["a.json", "a-2.json", "a-2-2.json"]),
    (["A 2", "A 2", "A 2 2", "A", "A"], ["a-2.json", "a-2-2.json", "a-2-2-2.json", "a.json", "a-3.json"]),
])
def test_slugs_that_meet(spark, names, want):
    got = plan(spark, names, [])
    assert sorted(got) == sorted(set(got)), "unique"
    assert got == want


def test_free_numbers_against_a_loop(spark):
    rng = random.Random(3)
    taken = {f"s{i}-{rng.randrange(1, 40)}" for i in range(3) for _ in range(15)} | {"s1"}
    names = [f"s{rng.randrange(3)}" for _ in range(60)]
    used, want = set(taken), []
    for n in names:
        k = 1
        while (n if k == 1 else f"{n}-{k}") in used:
            k += 1
        used.add(n if k == 1 else f"{n}-{k}")
        want.append(n if k == 1 else f"{n}-{k}")
    numbered = naming.name_counters(spark.createDataFrame(list(enumerate(names)), "arrival bigint, name string"))
    stems = spark.createDataFrame([(t,) for t in taken], "stem string")
    got = {r.arrival: r.stem for r in naming.free_filenames(numbered, stems).collect()}
    assert [got[i] for i in range(len(names))] == want


def test_slug_column_is_the_counter_key(spark):
    df = spark.createDataFrame([(0, "Ab"), (1, "a b"), (2, "AB")], "arrival bigint, name string")
    got = {r.arrival: (r.slug, r.n) for r in naming.name_counters(df).collect()}
    assert got == {0: ("ab", 1), 1: ("a-b", 1), 2: ("ab", 2)}
    assert df.select(file_slug(df.name)).first()[0] == "ab"
