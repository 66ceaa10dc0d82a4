"""Substring dedup with sharded Aho-Corasick automata.

1. Phrases: of the runs of ``seed_words`` words inside each window, the one with the
   least hash. Equal windows have equal phrases, so only phrases that come twice can
   lie in a recurring window. Whole copies are told apart first and take no part.
2. Windows with such a phrase are hashed and counted: those that come twice are
   confirmed recurring passages, each with its first occurrence.
3. Documents are dealt into shards of bounded size. A shard compiles an automaton of
   the phrases of the confirmed windows that occur in its documents and streams them
   through it, so every document is read once, by one automaton, however large the
   corpus is. Each hit is checked against the confirmed windows around it.
"""

from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from placelens.llm.ngram_join import repeated_runs
from placelens.llm.storage import staged
from placelens.llm.words import grams, grams_at, in_chunks, mix

LAST = 9223372036854775807
SHARD_BYTES = 2_000_000
SECOND = np.uint64(0xD1B54A32D192ED03)
DIGITS, DIGIT_BITS = 2, 7
BASE = 1 << DIGIT_BITS


def _anchors(hashes: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Of each window of a text, the position of its anchor; empty if the text has no window."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    runs = np.lib.stride_tricks.sliding_window_view(grams(hashes, seed), window - seed + 1)
    return runs.argmin(axis=1) + np.arange(len(runs))


def _anchor_rows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("__llm_id").to_numpy()
            for at, _, words in in_chunks(batch.column("__llm_text"), lower=False):
                out = []
                for i in range(len(words.first) - 1):
                    hashes = words.hashes[words.first[i] : words.first[i + 1]]
                    places = np.unique(_anchors(hashes, window, seed))
                    if len(places):
                        out.append((grams(hashes, seed)[places], np.full(len(places), ids[at + i]), places))
                if out:
                    a, d, p = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(d), pa.array(p.astype(np.int32))], ["anchor", "id", "place"])

    return run


def _words_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _copy_keys(window: int):
    """(id, key) of texts that have a window; equal keys are equal word sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.encode().split() for t in batch.column("__llm_text").to_pylist()]
            long = [i for i, w in enumerate(words) if len(w) >= window]
            keys = pa.array([_words_key(words[i]) for i in long], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("__llm_id").take(pa.array(long, pa.int64())), keys], ["id", "key"])

    return run


WINDOWS = pa.schema([("w1", pa.int64()), ("w2", pa.int32()), ("id", pa.int64()), ("start", pa.int32())])


def _windows(window: int, seed: int):
    """The windows of a shard's documents that lie on recurring phrases: each distinct one at its first place here, and once more if it comes again."""

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        wanted = {}
        if found.num_rows:
            places = found.column("places").combine_chunks()
            for k, i in enumerate(found.column("__llm_id").to_pylist()):
                wanted[i] = places[k].values.to_numpy()
        parts = []
        ids = docs.column("__llm_id").to_numpy()
        for at, _, words in in_chunks(docs.column("__llm_text").combine_chunks(), lower=False) if wanted else ():
            for i in range(len(words.first) - 1):
                own = wanted.get(ids[at + i])
                if own is None:
                    continue
                hashes = words.hashes[words.first[i] : words.first[i + 1]]
                starts = np.flatnonzero(np.isin(_anchors(hashes, window, seed), own))
                if len(starts):
                    second = grams_at(mix(hashes ^ SECOND), window, starts) >> np.uint64(32)
                    parts.append((grams_at(hashes, window, starts), second, np.full(len(starts), ids[at + i]), starts))
        if not parts:
            return WINDOWS.empty_table()
        w1, w2, d, s = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((s, d, w2, w1))
        w1, w2, d, s = w1[order], w2[order], d[order], s[order]
        new = np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
        keep = new | np.concatenate([[False], new[:-1]])
        columns = (w1[keep].view(np.int64), w2[keep].astype(np.uint32).view(np.int32), d[keep], s[keep].astype(np.int32))
        return pa.Table.from_arrays([pa.array(x) for x in columns], schema=WINDOWS)

    return run


def _symbols(numbers: np.ndarray) -> tuple[int, ...]:
    """Digits of word numbers, most significant first; each place has symbols of its own, so words meet whole.

    A node of the automaton tries its branches in turn, so few branches make it fast.
    """
    digits = np.empty((len(numbers), DIGITS), np.int64)
    for k in range(DIGITS - 1, 0, -1):
        digits[:, k] = (numbers & (BASE - 1)) + k * BASE
        numbers = numbers >> DIGIT_BITS
    digits[:, 0] = numbers + DIGITS * BASE
    return tuple(digits.ravel().tolist())


class _Dictionary:
    """A shard's confirmed windows, each with its first place, and the automaton of their phrases."""

    def __init__(self, passages: pa.Table, window: int, seed: int):
        self.window, self.seed = window, seed
        order = np.lexsort((passages.column("w2").to_numpy(), passages.column("w1").to_numpy().view(np.uint64)))
        self.w1, self.w2, self.first_id, self.first_start = (passages.column(c).to_numpy()[order] for c in ("w1", "w2", "first_id", "first_start"))
        self.w1 = self.w1.view(np.uint64)
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)

    def add_phrases(self, words: list[bytes], places: np.ndarray) -> None:
        number = self.numbers
        for p in places.tolist():
            phrase = [number.setdefault(w, len(number) + 1) for w in words[p : p + self.seed]]
            self.automaton.add_word(_symbols(np.array(phrase)))

    def covered(self, doc: int, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Which words of a document lie in a window that starts earlier somewhere."""
        n, window = len(words), self.window
        numbers = np.fromiter(map(self.numbers.get, words, repeat(0)), np.int64, n)
        ends = [end // DIGITS for end, _ in self.automaton.iter(_symbols(numbers))]
        if not ends:
            return np.zeros(n, bool)
        reach = np.zeros(n + window + 2, np.int32)
        at = np.array(ends, np.int64) + 1 - self.seed  # windows around a phrase start at most this far before it
        np.add.at(reach, np.maximum(at - (window - self.seed), 0), 1)
        np.add.at(reach, at + 1, -1)
        starts = np.flatnonzero(np.cumsum(reach)[: n - window + 1] > 0)
        w1 = grams_at(hashes, window, starts)
        w2 = (grams_at(mix(hashes ^ SECOND), window, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        edges = np.zeros(n + 1, np.int32)
        row = np.searchsorted(self.w1, w1)
        open_ = np.flatnonzero(row < len(self.w1))
        while len(open_):  # rows of equal first halves follow each other
            open_ = open_[self.w1[row[open_]] == w1[open_]]
            same = open_[self.w2[row[open_]] == w2[open_]]
            later = same[(self.first_id[row[same]] != doc) | (self.first_start[row[same]] != starts[same])]
            np.add.at(edges, starts[later], 1)
            np.add.at(edges, starts[later] + window, -1)
            row[open_] += 1
            open_ = open_[row[open_] < len(self.w1)]
        return np.cumsum(edges[:-1]) > 0


def _located(window: int, seed: int, names: list[str], text_col: str, schema: pa.Schema):
    """Streams a shard's documents through its automaton and cuts covered words."""

    def run(docs: pa.Table, passages: pa.Table) -> pa.Table:
        ids = docs.column("__llm_id").to_numpy()
        texts = [(t or "").encode().split() for t in docs.column("__llm_text").to_pylist()]
        hashed = []
        for _, _, words in in_chunks(docs.column("__llm_text").combine_chunks(), lower=False):
            hashed += [words.hashes[a:b] for a, b in zip(words.first, words.first[1:])]
        copies: dict[int, set[bytes]] = {}
        for i, key in zip(passages.column("id").to_pylist(), passages.column("copy").to_pylist()):
            if key is not None:
                copies.setdefault(i, set()).add(key)
        passages = passages.filter(passages.column("copy").is_null())
        dictionary = None
        if passages.num_rows:
            dictionary = _Dictionary(passages, window, seed)
            local: dict[int, list[int]] = {}
            for i, start in zip(passages.column("id").to_pylist(), passages.column("start").to_pylist()):
                local.setdefault(i, []).append(start)
            for i, doc in enumerate(ids):
                starts = np.array(local.get(doc, ()), np.int64)
                starts = starts[starts + window <= len(texts[i])]
                if len(starts):
                    dictionary.add_phrases(texts[i], np.unique(_anchors(hashed[i], window, seed)[starts]))
            dictionary.automaton.make_automaton()
        kept, counts, removed = [], [], []
        for doc, words, hashes in zip(ids, texts, hashed):
            n, gone = len(words), 0
            if n >= window and doc in copies and _words_key(words) in copies[doc]:
                words, gone = [], n
            elif n >= window and dictionary is not None:
                covered = dictionary.covered(doc, words, hashes)
                gone = int(covered.sum())
                if gone:
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
            kept.append(b" ".join(words).decode())
            counts.append(n)
            removed.append(gone)
        columns = [pa.array(kept, pa.string()) if c == text_col else docs.column(c) for c in names]
        return pa.Table.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], schema=schema)

    return run


def dedup_passages(docs: DataFrame, window: int = 20, seed_words: int = 8, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes every word that lies in a window of ``window`` words which also starts earlier.

    Words are runs without blanks, unchanged. Earlier is a smaller id, or the same id
    and an earlier start; windows are judged on the input. Returns all columns, with
    the kept words joined by one space as text, plus ``n_words`` and ``n_removed``.

    Null or empty texts have no words, and give an empty text. A null id comes after
    all others. Rows that share an id are parts of one document: of a window at the
    same start in two of them, both stay. An empty table gives an empty result.
    Columns named like the new ones are replaced.
    """
    if not 0 < seed_words <= window:
        raise ValueError("seed_words must lie between 1 and window")
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    text = docs.withColumns({"__llm_id": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), "__llm_text": F.coalesce(F.col(text_col), F.lit(""))})
    total = text.select(F.sum(F.octet_length("__llm_text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    text = text.withColumn("__llm_shard", F.pmod(F.xxhash64("__llm_id"), F.lit(shards)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    slim = text.select("__llm_id", "__llm_text", "__llm_shard")
    keys = staged(slim.mapInArrow(_copy_keys(window), "id long, key binary"), "copy-keys")
    firsts = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    copies = staged(keys.join(firsts, "key").where("id <> least").select("id", "key").distinct(), "copies")

    anchors = slim.mapInArrow(_anchor_rows(window, seed_words), "anchor long, id long, place int")
    ordered = anchors.repartition(n, "anchor").sortWithinPartitions("anchor", "id", "place")
    recurring = ordered.mapInArrow(lambda batches: repeated_runs(batches, distinct=False), "anchor long, id long, place int")
    found = recurring.groupBy(F.col("id").alias("__llm_id")).agg(F.collect_set("place").alias("places"))
    # A copy's windows all start earlier. An id with other texts too is kept.
    alone = keys.groupBy("id").agg(F.count_distinct("key").alias("texts")).where("texts = 1").select("id")
    whole = copies.join(alone, "id", "left_semi").select(F.col("id").alias("__llm_id"))
    found = found.join(whole, "__llm_id", "left_anti")
    found = staged(found.withColumn("__llm_shard", F.pmod(F.xxhash64("__llm_id"), F.lit(shards))), "anchors")

    windows = slim.groupBy("__llm_shard").cogroup(found.groupBy("__llm_shard")).applyInArrow(_windows(window, seed_words), "w1 long, w2 int, id long, start int")
    # A window in very many documents has two rows per shard here at most.
    same = Window.partitionBy("w1", "w2")
    place = F.struct("id", "start")
    shard = F.pmod(F.xxhash64("id"), F.lit(shards))
    confirmed = (
        windows.repartition(n, "w1", "w2")
        .withColumns({"all": F.count("*").over(same), "first": F.min(place).over(same)})
        .where((F.col("all") > 1) & (F.col("first") != place))
        .select(shard.alias("__llm_shard"), "id", "start", "w1", "w2", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"), F.lit(None).cast("binary").alias("copy"))
    )
    none = [F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("w1", "long"), ("w2", "int"), ("first_id", "long"), ("first_start", "int"))]
    known = copies.select(shard.alias("__llm_shard"), "id", *none, F.col("key").alias("copy"))
    confirmed = staged(confirmed.unionByName(known), "passages")

    fields = [docs.schema[c] for c in names] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    schema = T.StructType(fields)
    run = _located(window, seed_words, names, text_col, to_arrow_schema(schema))
    return text.groupBy("__llm_shard").cogroup(confirmed.groupBy("__llm_shard")).applyInArrow(run, schema)
