"""Conversation repair, packing and token alignment against brute force and the libraries."""

import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from placelens.llm.catalog import QUERIES  # noqa: E402
from placelens.llm.conversation_repair import Survivors, block_effect, compose, repair_conversations, summarise_repairs  # noqa: E402
from placelens.llm.packing import pack, pack_documents, plan_runs, token_pieces  # noqa: E402
from placelens.llm.structure_queries import damaged  # noqa: E402
from placelens.llm.token_alignment import align_tokens, aligned  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
FILES = {n: Path(public_tokenizers.path(n)).read_bytes() for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model")}
BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("none", "none", "truncated", "blank", "duplicate")


# Conversation repair


def edits_of(turns):
    """Every edit sequence with at most two inserts a gap, tried one by one: least cost, then least text."""
    best = None
    gaps = [(), ("I",), ("I", "I")]
    choices = ["D" if f in ("blank", "duplicate") else "DKR" for _, f in turns]
    for ops in itertools.product(*choices):
        for inserts in itertools.product(gaps, repeat=len(turns) + 1):
            audit, cost, roles, row = "", 0, [], 0
            for k in range(len(turns) + 1):
                for op in (*inserts[k], *([ops[k]] if k < len(turns) else [])):
                    audit += op
                    cost += {"I": 3, "D": 4, "K": 0, "R": 3}[op]
                    if op in "KR" and turns[row][1] == "truncated":
                        cost += 3
                    roles += [] if op == "D" else [turns[row][0] if op == "K" else "?"]
                    row += op != "I"
            text = "".join(roles)
            if len(text) and not fits(text):
                continue
            if best is None or (cost, audit) < best:
                best = cost, audit
    return best


def fits(roles):
    """Whether '?' can be read as u or a so that the whole is s?(ua)+."""
    if roles.startswith("s"):
        roles = roles[1:]
    return len(roles) > 0 and len(roles) % 2 == 0 and all(r in ("?", "ua"[k % 2]) for k, r in enumerate(roles))


def searched(turns):
    found, out = Survivors(0, True), ""
    for initial, fault in turns:
        found.step(initial, fault)
        out += found.settled()
    best = found.cheapest()
    return found.best[best][0], out + found.text(best)


def by_table(turns):
    """A plain search over whole texts, for dialogues too long to try all edits."""
    step = {0: 2, 1: 2, 2: 3, 3: 2}

    def closed(best):
        for _ in range(3):
            for x, (cost, text) in sorted(best.items()):
                new = (cost + 3, text + "I")
                best[step[x]] = min(best.get(step[x], new), new)
        return best

    best = closed({0: (0, "")})
    for initial, fault in turns:
        after = {}
        for x, (cost, text) in best.items():
            moves = [(x, cost + 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                moves.append((step[x], cost + 3 + more, "R"))
                to = 1 if (x, initial) == (0, "s") else 2 if initial == "u" and x != 2 else 3 if (x, initial) == (2, "a") else None
                moves += [(to, cost + more, "K")] if to else []
            for y, c, op in moves:
                after[y] = min(after.get(y, (c, text + op)), (c, text + op))
        best = closed(after)
    return min(best[x] for x in (0, 3) if x in best)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suatu"), st.sampled_from(FAULTS)), max_size=4))
def test_search_finds_the_least_edits(turns):
    want = edits_of(turns)
    assert searched(turns) == want == by_table(turns)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suattua"), st.sampled_from(FAULTS)), max_size=220), st.integers(1, 40), st.integers(0, 9))
def test_blocks_compose_to_the_whole(turns, width, seed):
    """Solving blocks by their composed effects gives what one search gives."""
    assert searched(turns) == by_table(turns)
    if not turns:
        return
    blocks = [[(i, f, 1) for i, f in turns[k : k + width]] for k in range(0, len(turns), width)]
    effects = [block_effect(b, k == 0) for k, b in enumerate(blocks)]
    text, cost = "", 0
    for k, (block, effect, (entry, end, before)) in enumerate(zip(blocks, effects, compose(effects))):
        assert before == len(text)
        found = Survivors(entry, k == 0)
        for i, f, _ in block:
            found.step(i, f)
            text += found.settled()
        text += found.text(end)
        cost += effect.costs[entry * 4 + end]
    assert (cost, text) == by_table(turns)


def test_memory_is_bounded_by_coalescence():
    rng = random.Random(3)
    found, given_, most = Survivors(0, True), 0, 0
    for k in range(20_000):
        found.step("ua"[k % 2] if rng.random() < 0.95 else rng.choice("sut"), rng.choice(FAULTS[:3]))
        given_ += len(found.settled())
        most = max(most, max(len(found.text(x)) for x in found.best))
    assert given_ > 19_000 and most < 1_000


def damaged_rows(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repaired_by_force(rows):
    """The contract's columns for each dialogue."""
    convs = defaultdict(list, {r[0]: [] for r in rows})
    for conv, turn, role, text in damaged_rows(rows):
        convs[conv].append((turn is not None, turn, hashlib.md5(f"{role}:{text}".encode()).digest(), role, text))
    out = {}
    for conv, turns in convs.items():
        seen, faults = set(), []
        for _, _, _, role, text in sorted(turns):
            end = text.rstrip(BLANKS)[-1:]
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "none" if end in ".!?" else "truncated")
            seen.add((role, text))
        turns = sorted(turns)
        cost, audit = by_table([(t[3][:1], f) for t, f in zip(turns, faults)])
        repaired, at = [], 0
        for op in audit:
            turn = turns[at] if op != "I" else None
            at += op != "I"
            if op == "D":
                continue
            n = len(repaired) - (repaired[:1] != [] and repaired[0].startswith("s"))
            role = turn[3] if op == "K" else ("user", "assistant")[n % 2]
            repaired.append(f"{role}:{turn[4] if turn else ''}")
        numbers = {t[1] for t in turns} - {None}
        initials = [t[3][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        count = Counter(faults)
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)
    return out


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("sf_dir", [SF_DIR, "/root/testdata/sf0.01"])
def test_repair_query(spark, sf_dir):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{sf_dir}/conversations.parquet'").fetchall()
    got = {r.conv_id: tuple(r[n] for n in COUNTS) for r in QUERIES["op11_conversation_repair"](spark, sf_dir).collect()}
    assert got == repaired_by_force(rows)


def test_repair_of_odd_turns(spark):
    """Null ids, turns, roles and texts, ties, repeated rows, odd roles, a dialogue over several blocks, clashing columns."""
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No", "", None, " \t", "Well?", "So!\n", "ünd", "x." * 30_000]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for c in (None, 1, 2, 3) for _ in range(15)]
    rows += [(4, 1, "user", "Same.")] * 5 + [(5, None, "user", "a."), (6, None, None, None)]
    rows += [(7, k, "ua"[k % 2] + "x" if rng.random() < 0.8 else rng.choice(roles), f"turn {k % 90}" + rng.choice([".", "", "?"])) for k in range(400)]
    turns = spark.createDataFrame([(*r, 1, "z") for r in rows], TURNS + ", seq int, KEY string")
    edits = repair_conversations(damaged(turns), block_rows=50)
    got = {r.conv_id: tuple(r[n] for n in COUNTS) for r in summarise_repairs(edits).collect()}
    want = {c: w for c, w in repaired_by_force(rows).items() if any(r[0] == c for r in damaged_rows(rows))}
    assert got == want
    assert repair_conversations(spark.createDataFrame([], TURNS)).count() == 0


# Packing


def best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fitting = [k for k, space in enumerate(free) if space >= n]
        if fitting:
            free[min(fitting, key=lambda k: free[k])] -= n
        else:
            free.append(capacity - n)
    return len(free)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 30), max_size=25))))
def test_plan_is_best_fit(case):
    capacity, counts = case
    bins, seen = defaultdict(list), defaultdict(set)
    for r in plan_runs(counts, capacity):
        for n in range(r.pieces):
            bins[r.sequence + n // r.each].append((r.offset + n % r.each * r.length, r.length))
            assert r.rank + n not in seen[r.length]
            seen[r.length].add(r.rank + n)
    assert {n: set(range(c)) for n, c in counts.items()} == dict(seen)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) == best_fit([n for n, c in counts.items() for _ in range(c)], capacity)


def word_ids(texts):
    library = tokenizers.Tokenizer.from_str(FILES["word_bpe_49k.json"].decode())
    return [[*(library.encode(t or "", add_special_tokens=False).ids), 0] for t in texts]


def check_packed(rows, ids_by_row, capacity):
    """Pieces hold the ids of their documents, and sequences are gapless."""
    want = Counter()
    for key, ids in ids_by_row:
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], "<u4")
            want[key, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(r[:5] for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r[5]].append((r[6], r[3]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(places) == best_fit([r[3] for r in rows], capacity)


def test_packing_query(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet'").fetchall()
    rows = [tuple(r) for r in QUERIES["op12_best_fit_packing"](spark, SF_DIR).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]
    check_packed(rows, zip((d for d, _ in docs), word_ids(t for _, t in docs)), 2048)


def test_packing_of_odd_documents(spark):
    """Also texts whose parts meet over blanks, special tokens and marks in the library's normaliser."""
    texts = [None, "", "  \t\n", "It's a ÄÖ Σας test's <|endoftext|>x <|startoftext|>", "é ́ a b c", "word " * 3000, "x" * 5000, "a\x1cb c\x85d", "<|endof text|> 'S 12a", "tie", "tie"]
    rows = [(k if k % 3 else None, t, "x", 5) for k, t in enumerate(texts)] + [(1, "tie", "x", 5)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int")
    packed = pack_documents(docs, FILES["word_bpe_49k.json"], 100)
    got = [tuple(r) for r in packed.select("id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]
    check_packed(got, zip((r[0] for r in rows), word_ids(r[1] for r in rows)), 100)
    assert all(len(r.ids) == r.length for r in packed.select("ids", "length").collect())
    assert pack_documents(docs.limit(0), FILES["word_bpe_49k.json"]).count() == 0
    pieces = token_pieces(docs, FILES["word_bpe_49k.json"], 100)
    with pytest.raises(ValueError, match="pieces have no length"):
        pack(pieces, 50)


def test_lengths_shared_by_many_are_ranked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("placelens.llm.packing.BLOCK_PIECES", 16)
    pieces = spark.range(500).select(F.col("id"), F.lit(0).alias("piece"), F.when(F.col("id") < 400, 7).otherwise(F.col("id") % 20 + 1).cast("long").alias("length"), F.lit(1).alias("ids_crc32"), F.lit("k").alias("OFFSET"))
    rows = pack(pieces, 20).collect()
    assert len(rows) == 500 and len({(r.sequence_id, r.offset) for r in rows}) == 500
    assert len({r.sequence_id for r in rows}) == best_fit([r.length for r in rows], 20)


# Token alignment


def aligned_by_force(docs):
    """Every pair of tokens is tried for an overlap."""
    a = tokenizers.Tokenizer.from_str(FILES["byte_bpe_50k.json"].decode())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=FILES["piece_bpe_32k.model"])
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(sorted({*range(256)} - {*printable}))}

    def spans(parts):
        at = 0
        for k, part in parts:
            yield k, at, at + len(part)
            at += len(part)

    facts, held = [], Counter()
    for key, text in docs:
        x = a.encode(" " + (text or ""), add_special_tokens=False).ids
        y = b.encode(text or "")
        left = [(k, bytes(byte[c] for c in a.id_to_token(k))) for k in x]
        right = [(k, bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()) for k in y]
        data = b" " + (text or "").encode()
        if not text or any(b"".join(p for _, p in side) != data for side in (left, right)):
            facts.append((key, 0, 0, 0, [], ""))
            continue
        p, q = list(spans(left)), list(spans(right))
        links = [(i, j) for i, s, e in p for j, u, v in q if s < v and u < e]
        ends = sorted({e for _, _, e in p} & {e for _, _, e in q})
        groups = []
        for low, high in zip([0, *ends], ends):
            groups.append("|".join(",".join(str(k) for k, s, e in side if low <= s and e <= high) for side in (p, q)))
        facts.append((key, len(x), len(y), len(groups), links, ";".join(groups)))
        held.update(set(links))
    highest = defaultdict(int)
    for (i, _), n in held.items():
        highest[i] = max(highest[i], n)
    return [(k, x, y, g, len(ls), sum(held[l] == highest[l[0]] for l in ls), sum(held[l] for l in ls), text) for k, x, y, g, ls, text in facts]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 120)), st.sets(st.integers(1, 120)))
def test_groups_of_ends(left, right):
    a, b = sorted(left | {121}), sorted(right | {121})
    runs, both = [], set(a) & set(b)
    for i, j, m, n in aligned(a, b):
        runs += [(i + k, j + k, 1, 1) for k in range(m)] if m == n and a[i] == b[j] else [(i, j, m, n)]
    assert [a[i + m - 1] for i, _, m, _ in runs] == sorted(both) == [b[j + n - 1] for _, j, _, n in runs]
    assert sum(r[2] for r in runs) == len(a) and sum(r[3] for r in runs) == len(b)


def test_alignment_query(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF_DIR}/documents.parquet' WHERE length(text) < 6000 OR text IS NULL").fetchall()
    small = spark.createDataFrame(docs, "doc_id long, text string")
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = [tuple(r[n] for n in names) for r in align_tokens(small.repartition(5), FILES["byte_bpe_50k.json"], FILES["piece_bpe_32k.model"]).collect()]
    assert sorted(got) == sorted(aligned_by_force(docs))
    whole = QUERIES["op13_token_alignment"](spark, SF_DIR).collect()
    assert len(whole) == 200 and all(r.n_links == r.n_a + r.n_b - r.n_groups for r in whole)


def test_alignment_of_odd_texts(spark, monkeypatch):
    texts = [None, "", " ", "\n\n  x", "<s> <|endoftext|> </s> <0x41>", "mark ▁ inside", "日本語 and 🙂 \x00 end", "a" * 700, "ÄÖ é", "the same words", "the same words", "  two  blanks "]
    rows = [(k if k % 4 else None, t, [k], "g") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links array<int>, CHUNK string")
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    found = align_tokens(docs, FILES["byte_bpe_50k.json"], FILES["piece_bpe_32k.model"])
    assert sorted([tuple(r[n] for n in names) for r in found.collect()], key=str) == sorted(aligned_by_force((r[0], r[1]) for r in rows), key=str)
    hashed = align_tokens(docs, FILES["byte_bpe_50k.json"], FILES["piece_bpe_32k.model"], digest=True)
    want = sorted(hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "" for r in aligned_by_force((r[0], r[1]) for r in rows))
    assert sorted(r.groups for r in hashed.collect()) == want
    assert align_tokens(docs.limit(0), FILES["byte_bpe_50k.json"], FILES["piece_bpe_32k.model"]).count() == 0


def test_phrases_are_spelt_in_few_symbols():
    """A node of the automaton tries its branches in turn: thousands of words must not all branch from its root (op8)."""
    from placelens.llm import substring_dedup

    count = 5000
    spelt = substring_dedup._symbols(np.arange(1, count + 1))
    places = [spelt[k :: substring_dedup.DIGITS] for k in range(substring_dedup.DIGITS)]
    assert len(set(zip(*places))) == count and 0 not in spelt
    assert max(len(set(p)) for p in places) <= 128 and not set(places[0]) & set(places[1])
    none = pa.table({c: pa.array([], pa.int64()) for c in ("w1", "w2", "first_id", "first_start")})
    found = substring_dedup._Dictionary(none, 4, 2)
    words = [b"%d" % i for i in range(count)]
    found.add_phrases(words, np.arange(0, count - 1, 2))
    found.automaton.make_automaton()
    numbers = np.array([found.numbers[w] for w in words[100:104]] + [0])
    assert [end // substring_dedup.DIGITS for end, _ in found.automaton.iter(substring_dedup._symbols(numbers))] == [1, 3]


def test_windows_hashed_where_wanted():
    from placelens.llm.words import grams, grams_at

    hashes = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    for starts in ([], [0], [3, 7, 480], list(range(481))):
        at = np.array(starts, np.int64)
        assert (grams_at(hashes, 20, at) == grams(hashes, 20)[at]).all()
