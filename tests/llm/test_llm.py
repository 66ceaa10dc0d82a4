"""The training-data operators on small tables, against brute force and libraries."""

import hashlib
import math
import random
import sys
from array import array
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from compare import compare, duck  # noqa: E402
from placelens.llm.catalog import ORACLES, QUERIES  # noqa: E402
from placelens.llm.chat_format import rotate_perspectives  # noqa: E402
from placelens.llm.components import components  # noqa: E402
from placelens.llm.decontamination import align, drop_leaks, find_leaks  # noqa: E402
from placelens.llm.line_dedup import dedup_lines  # noqa: E402
from placelens.llm.neighbours import nearest_neighbours  # noqa: E402
from placelens.llm.ngram_join import near_duplicates, repeated_runs  # noqa: E402
from placelens.llm.piece_codec import PieceCodec, decode_ids, piece_ids  # noqa: E402
from placelens.llm.quality import FEATURES, feature_rows, fit_quality, fit_tables, score_quality  # noqa: E402
from placelens.llm.sharding import shard_rows  # noqa: E402
from placelens.llm.substring_dedup import dedup_passages  # noqa: E402
from placelens.llm.toxicity import fit_toxicity, fit_words, score_toxicity  # noqa: E402
from placelens.llm.words import word_hash  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
MODEL = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
DOCS = "doc_id long, text string, line string, hash long, _id int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows and ids, a long text, clashing column names."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "ÄPFEL", "eta", "theta", "iota"]
    body = [" ".join(rng.choices(words, k=60)) for _ in range(6)]
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, body[0]), (4, body[0]), (4, body[0]), (4, body[1]), (5, body[0].upper()), (6, "one two"), (7, "ONE  two")]
    rows += [(8, body[2] + "\n" + body[3]), (9, body[3] + "\n" + body[4]), (10, body[4].replace("alpha", "omega", 1)), (None, None), (11, " ".join(body) * 400)]
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)


@pytest.mark.parametrize("name", ORACLES)
def test_sql_twin(spark, name):
    assert compare(duck(SF_DIR), QUERIES[name](spark, SF_DIR), ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["op1_line_dedup", "op9_rendezvous_sharding", "op10_perspective_rotation"])
def test_native_plans_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow", "Cartesian") if x in plan]


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (
        dedup_lines(none), near_duplicates(none), dedup_passages(none), piece_ids(none, MODEL, decoded=True), find_leaks(none, bench),
        shard_rows(none, "doc_id", [1, 1]), score_quality(none, fit_quality(none, labels, F.lit(True))), score_toxicity(none, fit_toxicity(none, labels, F.lit(True))),
        nearest_neighbours(vectors, vectors), rotate_perspectives(turns),
    ):
        assert df.count() == 0
    assert find_leaks(odd, bench).count() == 0


def test_lines(spark, odd):
    rows = [(1, "same long line here\nkeep"), (2, " SAME long line here\t\nshort\nSame Long Line Here"), (3, "short\nother line that is long"), (None, "other line that is long\n")]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], DOCS)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped, r.line) for r in dedup_lines(df, batches=3, fanout=2).collect()}
    assert got == {1: (rows[0][1], 2, 0, "x"), 2: ("short", 3, 2, "x"), 3: (rows[2][1], 2, 0, "x"), None: ("", 2, 1, "x")}
    one = {(r.doc_id, r.text, r.n_dropped) for r in dedup_lines(odd, batches=1).collect()}
    assert one == {(r.doc_id, r.text, r.n_dropped) for r in dedup_lines(odd, batches=5, fanout=2).collect()}


def test_lines_of_rows_that_share_an_id(spark):
    """Against brute force: a row loses lines of its own only, whatever others of its id lose."""
    rng = random.Random(4)
    ids = [None] * 6 + [3] * 4 + [1, 2, 5, 9]
    rows = [(i, "\n".join(f"a line of number {rng.randrange(25)}" for _ in range(rng.randrange(1, 7)))) for i in ids] + [(None, None), (3, None)]
    owner = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            owner[line] = min(owner.get(line, math.inf), math.inf if i is None else i)
    want = []
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if not x or owner[x] == (math.inf if i is None else i)]
        want.append((i, None if t is None else "\n".join(kept)))
    got = [(r.doc_id, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_dedup_decides_per_row(spark):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    from corpus_pipeline import near_dedup

    words = [f"w{k}" for k in range(80)]
    near = [" ".join(words[:k] + ["new"] + words[k + 1 :]) for k in (0, 79)]
    rows = [(1, " ".join(words)), (5, near[0]), (5, "only this row holds these words"), (None, near[1]), (None, "nor does any other hold these words"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in near_dedup(spark, docs, SF_DIR).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)


def _sets(rows, n):
    out = []
    for t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset())
    return out


def _groups(ids, sets, percent):
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, i in zip(group, ids):
        least[g] = i if least.get(g) is None else least[g] if i is None else min(i, least[g])
    return [least[g] for g in group]


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80), (1, 50)])
def test_near_duplicates(spark, n, percent):
    rng = random.Random(n)
    texts = []
    for k in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 6, 20, 150, 700]))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(words) // 20) + 1)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += [None, "", "  ", "a", "A"]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in near_duplicates(df, n, percent).collect()}
    sets = _sets(texts, n)
    assert got == {i: (len(s), g) for i, s, g in zip(ids, sets, _groups(ids, sets, percent))}


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_words_of_regular_build_differ(spark):
    """Two words of 1,024 letters whose sums modulo a power of two are equal."""
    words = [thue_morse(1024, x) for x in ("ab", "ba")]
    assert len({word_hash(w) for w in words}) == 2
    text = " ".join(f"w{k}" for k in range(20))
    rows = [(i, f"{w} {text}") for i, w in enumerate(words)] + [(2, words[0]), (3, words[1]), (4, "A" * 40), (5, "a" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.component_id for r in near_duplicates(df, 4, 100).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4}
    kept = {r.doc_id: r.n_removed for r in dedup_passages(df.where("doc_id < 2")).collect()}
    assert kept == {0: 0, 1: 20}
    one = spark.createDataFrame([(0, " ".join([words[0], *text.split()[:19]])), (1, " ".join([words[1], *text.split()[:19]]))], "doc_id long, text string")
    assert {r.n_removed for r in dedup_passages(one).collect()} == {0}


@pytest.mark.parametrize("length", [12, 30, 44])
def test_unrelated_texts_are_hardly_compared(spark, length, monkeypatch):
    """Candidates of short random texts don't grow with the square of their number."""
    from placelens.llm import ngram_join

    rng = random.Random(length)
    counted = []
    monkeypatch.setattr(ngram_join, "_pairs", lambda rows, rule, pairs=ngram_join._pairs: counted.append(rows.count()) or pairs(rows, rule))
    for size in (1500, 3000):
        texts = [(k, " ".join(str(rng.randrange(10**9)) for _ in range(length))) for k in range(size)]
        assert all(r.id == r.component_id for r in near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 1, 80, count_links=False).collect())
    assert sum(counted) <= 20


def test_rows_that_share_an_id_are_cut_once(spark, monkeypatch):
    from placelens.llm import ngram_join

    sizes = {}
    monkeypatch.setattr(ngram_join, "staged", lambda df, label, keep=ngram_join.staged: (out := keep(df, label), sizes.setdefault(label, out.count()))[0])
    rows = [(None, f"a b c d e f g h i j k l m n o p q r s {k // 2} t u v w x y z{'' if k % 2 else ' 1'}") for k in range(200)] * 2
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80, count_links=False)
    assert got.count() == 400 and sizes["set-facts"] == 200 and sizes["set-parts"] <= 400
    with pytest.raises(ValueError, match="percent"):
        near_duplicates(spark.createDataFrame(rows[:2], "doc_id long, text string"), 2, 30)


def test_only_sets_that_may_link_are_compared(spark, monkeypatch):
    """Texts of a common passage alone are left out, and near copies that share many segments meet in one bucket."""
    from placelens.llm import ngram_join

    sizes = {}
    monkeypatch.setattr(ngram_join, "staged", lambda df, label, keep=ngram_join.staged: (out := keep(df, label), sizes.setdefault(label, out.count()))[0])
    rng = random.Random(5)
    common = [f"c{k}" for k in range(20)]
    texts = [" ".join(common + [f"w{rng.randrange(10**9)}" for _ in range(180)]) for _ in range(60)]
    texts += [f"{t} end" for t in texts[:3]] + texts[3:6]
    found = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4, 85, count_links=False)
    assert {r.id: r.component_id for r in found.collect()} == {k: k if k < 60 else k - 60 for k in range(66)}
    assert sizes["set-placed"] == 6 and sizes["set-texts"] == 6


def test_near_dedup_leaves_texts_without_partners_alone(spark, monkeypatch):
    """The pipeline's step cuts only those into segments that may link."""
    import corpus_pipeline
    from placelens.llm import ngram_join

    sizes = {}
    monkeypatch.setattr(ngram_join, "staged", lambda df, label, keep=ngram_join.staged: (out := keep(df, label), sizes.setdefault(label, out.count()))[0])
    rng = random.Random(6)
    texts = [" ".join([f"c{k}" for k in range(20)] + [f"w{rng.randrange(10**9)}" for _ in range(180)]) for _ in range(40)]
    texts += [f"{t} end" for t in texts[:2]]
    rows = [(k, t, "en", "web", len(t)) for k, t in enumerate(texts)] + [(None, texts[3], "en", "web", 1), (50, None, "en", "web", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [*range(40), 50]
    assert sizes["set-placed"] == 4 and sizes["set-texts"] == 4


@pytest.mark.parametrize("percent", [50, 80, 85, 99, 100])
def test_first_grams_of_linking_sets_meet(percent):
    """Also where the two sets share as few n-grams as a link needs, and those come last in the order."""
    from placelens.llm.ngram_join import Rule, _first_grams, _first_shared

    rule = Rule(4, percent)
    for a in (*range(1, 90), 997, 1000):
        for b in range(a, rule.largest_partner(a) + 1):
            overlap = -(-percent * (a + b) // (100 + percent))
            met = min(overlap, *(_first_grams(rule, n) - (n - overlap) for n in (a, b)))
            assert met >= max(_first_shared(rule, rule.least_shared(n)) for n in (a, b)) > 0


def test_links_are_all_counted(spark, monkeypatch):
    """Groups of many near copies, chains, copies and long texts, in one block and in several."""
    rng = random.Random(11)
    texts = []
    for size, length in ((40, 60), (3, 30), (2, 40), (12, 900), (1, 20)):
        words = [f"g{size}x{k}" for k in range(length)]
        for k in range(size):
            texts.append(" ".join(words))
            if k % 7 != 6:
                words = list(words) if rng.random() < 0.7 else [f"g{size}x{j}" for j in range(length)]
                words[rng.randrange(length)] = f"z{rng.randrange(10**6)}"
    texts += [None, "", texts[0].upper()]
    sets = _sets(texts, 3)
    kinds = set(sets) - {frozenset()}
    want = [sum(a != b and 100 * len(a & b) >= 80 * len(a | b) for b in kinds) if a else 0 for a in sets]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr("placelens.llm.ngram_join.BLOCK_SETS", 5)
    monkeypatch.setattr("placelens.llm.ngram_join.COLUMNS", 20)
    got = {r.id: r.n_links for r in near_duplicates(df, 3, 80).collect()}
    assert got == dict(enumerate(want))


def test_near_duplicates_odd_rows(spark, odd):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.id in (4, 5)} == {4}
    assert {(r.id, r.component_id) for r in rows if r.id in (1, 2, 3)} == {(1, 1), (2, 2), (3, 3)}
    assert {r.component_id for r in rows if r.id in (6, 7)} == {6}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "left long, right long")
    assert {r.node: r.group for r in components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_repeated_runs_over_batches():
    rows = [(1, 1), (1, 1), (2, 1), (2, 2), (2, 2), (2, 3), (3, 1), (4, 1), (4, 2)]
    for size in range(1, 10):
        batches = [pa.RecordBatch.from_pydict({"a": [a for a, _ in rows[i : i + size]], "b": [b for _, b in rows[i : i + size]]}) for i in range(0, len(rows), size)]
        got = [tuple(r.values()) for b in repeated_runs(iter(batches)) for r in b.to_pylist()]
        assert got == [(2, 1), (2, 2), (2, 3), (4, 1), (4, 2)]


def test_passages(spark, odd):
    rng = random.Random(2)
    shared = [f"s{i}" for i in range(45)]
    docs = {}
    for i in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(5, 120))]
        at, length = rng.randrange(len(words)), rng.randrange(0, 46)
        docs[i] = words[:at] + shared[:length] + words[at:] + (shared[45 - length :] if i % 3 else [])
    docs[30] = docs[4]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()] + [(40, None), (41, "")], "doc_id long, text string")
    first, want = set(), {40: (0, 0, ""), 41: (0, 0, "")}
    for i, w in docs.items():
        gone = set()
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            gone |= set(range(s, s + 20)) if key in first else set()
            first.add(key)
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    for shard_bytes in (500, 10**9):
        assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in dedup_passages(df, shard_bytes=shard_bytes).collect()} == want
    assert dedup_passages(odd).count() == odd.count()


def test_leaks(spark, odd):
    rng = random.Random(3)
    items = [[f"q{k}x{rng.randrange(400)}" for _ in range(40)] for k in range(5)]
    filler = lambda n: [f"f{rng.randrange(300)}" for _ in range(n)]
    edited = [("new" if k % 7 == 3 else w) for k, w in enumerate(items[1])]
    dropped = [w for k, w in enumerate(items[2]) if k % 9]
    texts = {1: filler(50) + items[0] + filler(9), 2: filler(5) + edited, 3: dropped + filler(90), 4: filler(200), 5: filler(30) + items[3][:8], 6: items[0] + filler(50) + items[4]}
    docs = spark.createDataFrame([(i, " ".join(w).title() + ".") for i, w in texts.items()] + [(7, None), (None, " ".join(items[4]))], "doc_id long, text string")
    bench = spark.createDataFrame([(k, ", ".join(w)) for k, w in enumerate(items)] + [(9, None), (10, "a b")], "item_id long, text string")
    want = {(1, 0), (2, 1), (3, 2), (6, 0), (6, 4), (None, 4)}
    for block_words in (10, 10**6):
        assert {(r.id, r.item_id) for r in find_leaks(docs, bench, block_words=block_words).collect()} == want
    assert {r.doc_id for r in drop_leaks(docs, bench).collect()} == {4, 5, 7}
    assert find_leaks(odd, bench).count() == 0


def test_leaks_against_alignment_of_everything(spark):
    """Edited, stretched and partial copies, many of each item, of which word n-grams survive in few or none."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(30)]
    items = [[rng.choice(common) if rng.random() < 0.4 else f"q{k}x{j}" for j in range(length)] for k, length in enumerate((4, 5, 7, 16, 40, 40))]
    texts = []
    for words in items:
        texts += [[w if j % 4 else "new" for j, w in enumerate(words)], [x for w in words for x in (w, "new")][:-1], [x for w in words for x in (w, "a", "b")]]
        texts += [words[: (len(words) * 21 + 39) // 40] for _ in range(30)] + [words] * 3
        for _ in range(25):
            own, share = [], rng.random() * 0.6
            for w in words[rng.randrange(len(words)) // 3 :]:
                kind = rng.random() / share if share else 9
                own += [w] if kind > 1 else [] if kind < 0.3 else ["new"] if kind < 0.6 else [w, rng.choice(common)]
            texts.append(own)
    texts = [[rng.choice(common) for _ in range(rng.randrange(40))] + t + [rng.choice(common) for _ in range(rng.randrange(40))] for t in texts]
    texts.append([w for t in texts[::5] for w in t])
    number = {}
    coded = lambda words: np.array([number.setdefault(w, len(number)) for w in words])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    scores = {(i, k): align(coded(item), coded(t))[0] / (2 * len(item)) for i, t in enumerate(texts) for k, item in enumerate(items)}
    for min_score in (0.5, 0.75, 0.3):
        got = {(r.id, r.item_id): r.score for r in find_leaks(docs, bench, min_score=min_score).collect()}
        assert got == {x: score for x, score in scores.items() if score >= min_score}


def test_alignment_by_cells():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 12)), rng.integers(0, 6, rng.integers(1, 20))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = max(0, table[i, j] + (2 if a[i] == b[j] else -1), table[i, j + 1] - 1, table[i + 1, j] - 1)
        assert align(a, b)[0] == table.max()


def test_codec_is_the_library(spark, odd):
    codec, library = PieceCodec(MODEL), sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    rng = random.Random(1)
    letters = [chr(i) for i in range(300)] + list("▁☃日本語한글aeiou  ") + ["the ", "ing", "    ", "<s>", "<0x41>", "😀", "́"]
    for _ in range(1500):
        text = "".join(rng.choices(letters, k=rng.randrange(40)))
        ids = array("i")
        codec.encode(text, ids)
        assert list(ids) == library.encode(text) and codec.decode(ids) == library.decode(list(ids))
        some = [rng.choice((rng.randrange(32000), rng.randrange(259))) for _ in range(rng.randrange(12))]
        assert codec.decode(some) == library.decode(some)
    rows = piece_ids(odd, MODEL, decoded=True).collect()
    assert all(r.ids == library.encode(r.text or "") and r.decoded == (r.text or "") for r in rows) and len(rows) == odd.count()
    assert all(r.decoded == (r.text or "") for r in decode_ids(piece_ids(odd, MODEL), MODEL).collect())


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(FEATURES)))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    model = fit_tables(x[:3000], y[:3000], rounds=20)
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert np.all(fit_tables(x[:0], y[:0]).score(x[:3]) == 0.5)


@pytest.mark.parametrize("name,label,least", [("op6_quality", "quality", 0.95), ("op4_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES[name](spark, sf_dir)
    assert rows.count() == 1000 and rows.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> int(score >= 0.5)").count() == 0
    held = rows.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out")
    assert held.select(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0] >= least


def test_scores_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 0, None), (None, 1, 1), (11, 1, 0)], "doc_id long, quality int, toxic int")
    for df in (score_quality(odd, fit_quality(odd, labels, F.lit(True))), score_toxicity(odd, fit_toxicity(odd, labels, F.lit(True)))):
        assert df.columns == [*odd.columns, "score"] and df.where("score BETWEEN 0 AND 1").count() == odd.count()
    assert all(r.features == [0.0] * len(FEATURES) for r in feature_rows(odd).where("doc_id < 4").collect())


def test_counterfactuals_take_weight_from_identity_terms():
    rng = random.Random(0)
    hashes = {w: word_hash(w) for w in ["gay", "lesbian", "scum", *[f"w{i}" for i in range(50)]]}
    rows, y = [], []
    for i in range(2000):
        toxic = i % 4 == 0
        words = {f"w{rng.randrange(50)}" for _ in range(10)} | ({"scum"} if toxic and rng.random() < 0.8 else set()) | ({"gay"} if rng.random() < (0.7 if toxic else 0.05) else set())
        rows.append(np.array(sorted(hashes[w] for w in words), np.uint64))
        y.append(float(toxic))
    weight = lambda m, w: dict(zip(m.hashes.tolist(), m.weights)).get(hashes[w], 0.0)
    plain, fair = fit_words(rows, np.array(y), swap_weight=0.0), fit_words(rows, np.array(y), swap_weight=20.0)
    assert abs(weight(fair, "gay")) < 0.3 * abs(weight(plain, "gay")) and weight(fair, "scum") > 1


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((600, 24)), 2)
    x[100:160] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 24), (902, [float("nan")] * 24), (903, [1.0, None]), (None, x[0].tolist()), (904, [1.0, 2.0]), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in nearest_neighbours(df, df.where("vec_id % 50 = 0 OR vec_id = 904"), 5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert 904 not in got and set(got) == {i for i in range(0, 600, 50)}
    hits = 0
    for q, found in got.items():
        score = (x * x[q]).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((x[q] * x[q]).sum()))
        score[q] = -9
        hits += len({i for i, _ in found} & set(np.lexsort((np.arange(600), -score))[:5].tolist()))
        assert len(found) == 5 and all(math.isclose(s, score[i], abs_tol=1e-12) for i, s in found)
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105] and hits >= 0.9 * 60
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert nearest_neighbours(few, few, 5).count() == 6


def test_sharding(spark, odd):
    df = spark.range(3000).withColumnRenamed("id", "doc_id")
    rows = shard_rows(df, "doc_id", [1.0] * 8, [1.0] * 9, blocks=16).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in rows) and 200 < sum(r.grown_shard == 8 for r in rows) < 470
    slots = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.doc_id):
        slots[r.shard].append(r.slot)
    assert len(slots) == 8 and all(s == list(range(len(s))) for s in slots.values())
    weighed = shard_rows(df, "doc_id", [1.0, 3.0, 0.0]).groupBy("shard").count().collect()
    assert {r.shard for r in weighed} == {0, 1} and 600 < min(r["count"] for r in weighed) < 900
    assert shard_rows(odd, "doc_id", [1, 1]).count() == odd.count()


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "<|im_end|>"), (None, 0, None, "x"), (2, 0, "system", "alone"), (1, None, "cy", "early")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, block string")
    out = rotate_perspectives(df, block_turns=2).orderBy("conv_id", "perspective", "seq").collect()
    ann = [r for r in out if r.conv_id == 1 and r.perspective == "ann"]
    text = "".join(r.rendered for r in ann)
    assert text.startswith("<|im_start|>user name=cy\nearly<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>")
    assert all(text[r.char_start : r.char_start + len(r.rendered)] == r.rendered for r in ann) and text.count("<|im_end|>") == 5
    assert {r.perspective for r in out if r.conv_id == 1} == {"ann", "bob", "cy"} and {r.perspective for r in out if r.conv_id is None} == {"unknown"}
    assert all((r.target_chars > 0) == (r.chat_role == "assistant") for r in out)


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    rows = out.collect()
    assert 100 < len(rows) < 200 and all(r.round_trip and r.n_tokens == len(r.ids) and r.n_chars == len(r.text) for r in rows)
    assert hashlib.sha256(b"").hexdigest()  # every text is whole: its tokens decode to it


@pytest.mark.parametrize("kind", ["string", "date", "long"])
def test_shards_of_any_key_against_hashlib(spark, kind):
    """Shards, slots and later shards of text, date and number keys, with columns named like helpers."""
    df = spark.range(300).select(F.expr(f"CASE WHEN id = 7 THEN NULL ELSE CAST({'date_add(DATE \'2020-01-01\', CAST(id % 90 AS INT))' if kind == 'date' else 'id % 90'} AS {kind}) END").alias("k"), F.col("id").alias("_run"), F.lit("x").alias("_at"), F.lit(None).cast("int").alias("slot"))
    rows = shard_rows(df, "k", [1.0] * 3, [1.0] * 4, blocks=8).collect()

    def best(key, n):
        return max(range(n), key=lambda i: (int(hashlib.md5(f"{i}/{'' if key is None else key}".encode()).hexdigest()[:13], 16), -i))

    assert sorted(r._run for r in rows) == list(range(300)) and {r._at for r in rows} == {"x"}
    for shard in range(3):
        mine = sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        keys = [("" if r.k is None else str(r.k)) if kind != "long" else (-1 if r.k is None else r.k) for r in mine]
        assert keys == sorted(keys)
    assert all((r.shard, r.grown_shard) == (best(r.k, 3), best(r.k, 4)) for r in rows)
