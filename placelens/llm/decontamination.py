"""Benchmark decontamination: seeds of word pairs that no leak can lack, then Smith-Waterman alignment.

Let an alignment of an item of L words hold M matches and E edits (mismatches, gaps) and
reach ``min_score``: 2 M - E >= 2 L min_score. Of its M - 1 pairs of neighbouring matches
at most E / 2 <= M - L min_score have two or more edits between them. So at least
L min_score - 1 pairs have one edit or none: their two words are one or two apart both in
the item and in the text. And it spans at most M + E <= (3 - 2 min_score) L words of the
text. A text with fewer such pairs in every span can't hold a leak; all others are aligned.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.llm.words import STEP, in_chunks, mix, words_of

MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 1_000_000
INDEX_WORDS = 50_000
TABLE = 1 << 20
TABLE_CELLS = 20_000


def _pairs(words: np.ndarray, apart: int) -> np.ndarray:
    """A key of each word and the one ``apart`` words on; of the word alone with 0."""
    first = mix(words[: len(words) - apart] + STEP)
    return mix(first * STEP + words[apart:]) if apart else first


class Index:
    """Test items of bounded size together: their word hashes, their keys, and what a leak of each must hold."""

    def __init__(self, items: list[tuple[int, np.ndarray]], min_score: float):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        lengths = np.array([len(w) for w in self.words])
        # A little room for what floats lose.
        pairs = np.ceil(lengths * min_score - 1 - 1e-9).astype(np.int64)
        self.need = np.maximum(pairs, 1)
        self.span = np.floor((3 - 2 * min_score) * lengths + 1e-9).astype(np.int64)
        # Where one match is enough, single words are the keys.
        self.steps = sorted({d for k in pairs for d in ((1, 2) if k > 0 else (0,))})
        keys = [np.unique(np.concatenate([_pairs(w, d) for d in ((1, 2) if k > 0 else (0,))])) for w, k in zip(self.words, pairs)]
        items_of = np.repeat(np.arange(len(keys)), [len(x) for x in keys])
        keys = np.concatenate(keys)
        order = np.lexsort((items_of, keys))
        self.keys, self.items = keys[order], items_of[order]
        self.table = np.zeros(TABLE, bool)
        self.table[(keys & np.uint64(TABLE - 1)).astype(np.int64)] = True

    def hits(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, item) of each key of a run that an item has."""
        maybe = np.flatnonzero(self.table[(found & np.uint64(TABLE - 1)).astype(np.int64)])
        low, high = (np.searchsorted(self.keys, found[maybe], side) for side in ("left", "right"))
        count = high - low
        at = np.repeat(maybe, count)
        offset = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        return at, self.items[np.repeat(low, count) + offset]

    def passages(self, words: np.ndarray, first: np.ndarray, keys: dict[int, np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, begin, end) of runs of words in which every leak lies. ``first`` is each text's first word."""
        total = len(words)
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        codes = []
        for d in self.steps:
            at, items = self.hits(keys[d])
            inside = text_of[at] == text_of[at + d]
            codes.append(items[inside] * total + at[inside])
        code = np.unique(np.concatenate(codes))
        if not len(code):
            return
        items, places = np.divmod(code, total)
        texts = text_of[places]
        last = np.arange(len(code)) + self.need[items] - 1
        fits, last = last < len(code), np.minimum(last, len(code) - 1)
        fits &= (items[last] == items) & (texts[last] == texts) & (places[last] - places < self.span[items])
        items, texts, a, b = items[fits], texts[fits], places[fits], places[last[fits]]
        begin = np.maximum(first[texts], b + 1 - self.span[items])
        end = np.minimum(first[texts + 1], a + self.span[items])
        new = np.ones(len(items), bool)
        new[1:] = (items[1:] != items[:-1]) | (texts[1:] != texts[:-1]) | (begin[1:] >= end[:-1])
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(items)) - 1 if len(starts) else starts
        yield from zip(texts[starts].tolist(), items[starts].tolist(), begin[starts].tolist(), end[stops].tolist())


def _item_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words_of(data, np.array([0, len(data)]), True, True).hashes


def _in_parts(items: list[tuple[int, np.ndarray]], most: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Runs of items of at most ``most`` words together, or of one item."""
    rows, count = [], 0
    for row in items:
        if rows and count + len(row[1]) > most:
            yield rows
            rows, count = [], 0
        rows.append(row)
        count += len(row[1])
    if rows:
        yield rows


def _blocks(benchmark: DataFrame, n: int, block_words: int, id_col: str, text_col: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The benchmark in blocks of at most ``block_words`` words (or one item), so that a block fits in every task."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL AND i IS NOT NULL").toLocalIterator()
    items = ((row["i"], _item_words(row["t"])) for row in rows)
    return _in_parts((x for x in items if len(x[1]) >= n), block_words)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words: (best score, where it starts in the passage, where it ends).

    One row of the table at a time; runs of gaps along the row by a running maximum.
    """
    width = len(passage)
    steps = np.arange(width + 1) * -GAP
    above, above_from = np.zeros(width + 1, np.int64), np.arange(width + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = above[:-1] + np.where(passage == word, MATCH, MISMATCH)
        up = above[1:] + GAP
        row, start = np.zeros(width + 1, np.int64), np.arange(width + 1)
        take = np.maximum(diagonal, up)
        start[1:] = np.where(take <= 0, start[1:], np.where(diagonal >= up, above_from[:-1], above_from[1:]))
        row[1:] = np.maximum(take, 0)
        # Best of the row so far, less a gap for each step from it.
        lifted = row + steps
        peak = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == peak, np.arange(width + 1), 0))
        better = peak - steps > row
        row = np.where(better, peak - steps, row)
        start = np.where(better, start[source], start)
        at = int(row.argmax())
        if row[at] > best[0]:
            best = (int(row[at]), int(start[at]), at)
        above, above_from = row, start
    return best


def best_scores(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """The best score of each item with its passage. Rows of many tables at a time, so short ones cost little."""
    out = np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda i: len(passages[i]))
    while order:
        width = len(passages[order[-1]])
        size = max(1, TABLE_CELLS // (width + 1))
        order, now = order[:-size], order[-size:]
        # Fillers of both sides differ, so they never match.
        words = np.full((len(now), max(len(items[i]) for i in now)), 1, np.uint64)
        text = np.zeros((len(now), width), np.uint64)
        for row, i in enumerate(now):
            words[row, : len(items[i])] = items[i]
            text[row, : len(passages[i])] = passages[i]
        steps = (np.arange(width) * -GAP).astype(np.int32)
        above, best = np.zeros((len(now), width + 1), np.int32), np.zeros(len(now), np.int32)
        for j in range(words.shape[1]):
            row = np.where(text == words[:, j : j + 1], np.int32(MATCH), np.int32(MISMATCH))
            row += above[:, :-1]
            np.maximum(row, above[:, 1:] + np.int32(GAP), out=row)
            np.maximum(row, 0, out=row)
            row += steps
            np.maximum.accumulate(row, axis=1, out=row)
            row -= steps
            np.maximum(best, row.max(axis=1), out=best)
            above[:, 1:] = row
        out[now] = best
    return out


def _aligned(indexes: list[Index], min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = {d for index in indexes for d in index.steps}
        for batch in batches:
            out = []
            for at, _, words in in_chunks(batch.column("text"), lower=True, letters=True):
                if not len(words.hashes):
                    continue
                keys = {d: _pairs(words.hashes, min(d, len(words.hashes))) for d in steps}
                for index in indexes:
                    found = list(index.passages(words.hashes, words.first, keys))
                    scores = best_scores([index.words[item] for _, item, _, _ in found], [words.hashes[begin:end] for _, _, begin, end in found])
                    for (text, item, begin, end), score in zip(found, scores.tolist()):
                        own = index.words[item]
                        if score >= min_score * MATCH * len(own):
                            _, start, stop = align(own, words.hashes[begin:end])
                            begin -= int(words.first[text])
                            out.append((at + text, index.ids[item], score / (MATCH * len(own)), begin + start, begin + stop))
            if out:
                who, ids, scores, starts, ends = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(who)), pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                    ["id", "item_id", "score", "start_word", "end_word"],
                )

    return run


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 4,
    min_score: float = 0.5,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, item_id, score, start_word, end_word) of documents that hold a test item, copied or edited.

    Words are runs of letters and digits, A-Z lower-cased. The score is the best local
    alignment's share of what a full copy scores, from ``min_score`` on it is a leak;
    one row per document and item, its best passage (the earliest of equals). No leak
    is left out, however its words are edited and however many documents hold it: see
    above for the word pairs that decide which passages are aligned.

    The benchmark comes in blocks of ``block_words`` words, each with one pass over the
    documents. Null texts hold nothing, null items and items of fewer than ``n`` words
    match nothing; a null id is kept; rows with equal ids count as one document. Empty
    tables give an empty result.
    """
    if not 0 < min_score <= 1:
        raise ValueError("min_score must lie in (0, 1]")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, item_id long, score double, start_word long, end_word long"
    leaks = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark, n, block_words, item_col, item_text_col):
        indexes = [Index(part, min_score) for part in _in_parts(block, INDEX_WORDS)]
        leaks = leaks.unionByName(texts.mapInArrow(_aligned(indexes, min_score), schema))
    best = F.max(F.struct("score", (-F.col("start_word")).alias("back"), "end_word")).alias("best")
    found = leaks.groupBy("id", "item_id").agg(best)
    return found.select("id", "item_id", "best.score", (-F.col("best.back")).alias("start_word"), "best.end_word")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Documents without a leak, all columns kept. Rows without an id that hold a leak drop all rows without one."""
    leaked = find_leaks(docs, benchmark, id_col=id_col, **options).select(F.col("id").alias("__llm_leaked")).distinct()
    # Leaked ids grow with the input, so they are never broadcast.
    return docs.join(leaked.hint("merge"), docs[id_col].eqNullSafe(F.col("__llm_leaked")), "left_anti")
