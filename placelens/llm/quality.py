"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has one lookup table over its bins, each chosen pair of features one
over the grid of theirs. The tables are learnt by cyclic boosting of shallow trees;
scoring looks up a bin per table and adds.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelens.llm.words import Words, in_chunks

FEATURES = [
    "log_words", "word_length", "long_words", "upper", "digits", "closers", "symbols", "marks", "beyond_ascii",
    "distinct_words", "repeated_neighbours", "line_length", "distinct_lines", "words_ending_in_symbol", "capital_words", "top_word",
]


def _class_table() -> np.ndarray:
    """Class of each byte: 0 other, 1 upper case, 2 digit, 3 sentence end, 4 symbol, 5 other mark, 6 beyond ASCII."""
    table = np.zeros(256, np.int8)
    table[65:91] = 1
    table[48:58] = 2
    for code in b"#$%&*+<=>@^_`|~{}[]\\/":
        table[code] = 4
    for code in b"\"'(),-:;":
        table[code] = 5
    for code in b".!?":
        table[code] = 3
    table[128:] = 6
    return table


CLASSES = _class_table()


def text_features(data: np.ndarray, words: Words, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text between ``begin`` and ``end`` bytes. Without words all are 0."""
    kinds = CLASSES[data[begin[0] : end[-1]]]
    base = begin[0]
    totals = {k: np.zeros(len(kinds) + 1, np.int32) for k in range(1, 7)}
    for k, total in totals.items():
        np.cumsum(kinds == k, out=total[1:])
    out = np.zeros((len(begin), len(FEATURES)))
    for i, (b, e) in enumerate(zip(begin, end)):
        lo, hi = words.first[i], words.first[i + 1]
        n = int(hi - lo)
        if not n:
            continue
        share = {k: (totals[k][e - base] - totals[k][b - base]) / (e - b) for k in totals}
        lengths = words.ends[lo:hi] - words.starts[lo:hi]
        hashes = words.hashes[lo:hi]
        ordered = np.sort(hashes)
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        lines = data[b:e].tobytes().split(b"\n")
        out[i] = (
            np.log1p(n), lengths.mean(), (lengths > 12).mean(), share[1], share[2], share[3], share[4], share[5], share[6],
            (len(edges) - 1) / n, (hashes[1:] == hashes[:-1]).mean() if n > 1 else 0.0, np.log1p(n / len(lines)), len(set(lines)) / len(lines),
            np.isin(CLASSES[data[words.ends[lo:hi] - 1]], (3, 4)).mean(), (CLASSES[data[words.starts[lo:hi]]] == 1).mean(), np.diff(edges).max() / n,
        )
    return out


def _feature_batches(batch: pa.RecordBatch, column: str) -> np.ndarray:
    parts = []
    for _, data, words in in_chunks(batch.column(batch.schema.get_field_index(column)), lower=True):
        parts.append(text_features(data, words, words.bounds[:-1], words.bounds[1:]))
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


class Tables(NamedTuple):
    cuts: list[np.ndarray]  # per feature: inner bin borders
    coarse: list[np.ndarray]  # per feature: borders of the grid of pairs
    base: float
    single: np.ndarray  # features x bins
    pairs: list[tuple[int, int]]
    grid: np.ndarray  # pairs x coarse bins x coarse bins

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for rows of features."""
        total = np.full(len(x), self.base)
        for j, cuts in enumerate(self.cuts):
            total += self.single[j][np.searchsorted(cuts, x[:, j], "right")]
        bins = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.coarse)]
        for (a, b), table in zip(self.pairs, self.grid):
            total += table[bins[a], bins[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, int]:
    """Gain and place of the best cut of bins with gradients ``g`` and weights ``h``."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + lam) + (all_g - left_g) ** 2 / (all_h - left_h + lam) - all_g**2 / (all_h + lam)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, lam: float, leaves: int = 4) -> np.ndarray:
    """Values per bin of a tree of few leaves on one feature."""
    borders = [0, len(g)]
    while len(borders) <= leaves:
        options = [(*_best_cut(g[a:b], h[a:b], lam), a) for a, b in zip(borders, borders[1:])]
        gain, at, a = max(options)
        if gain <= 1e-9 or not at:
            break
        borders = sorted([*borders, a + at])
    out = np.zeros(len(g))
    for a, b in zip(borders, borders[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + lam)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a grid into four, one border per axis."""
    cg, ch = (np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (g, h))
    n = len(g)
    best, values = -1.0, np.zeros_like(g)
    i, j = np.meshgrid(np.arange(1, n), np.arange(1, n), indexing="ij")

    def quads(c):
        low = c[i, j]
        return low, c[i, n] - low, c[n, j] - low, c[n, n] - c[i, n] - c[n, j] + low

    qg, qh = quads(cg), quads(ch)
    gain = sum(a**2 / (b + lam) for a, b in zip(qg, qh)) - cg[n, n] ** 2 / (ch[n, n] + lam)
    at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    best = float(gain[at])
    a, b = at[0] + 1, at[1] + 1
    leaf = [x[at] / (y[at] + lam) for x, y in zip(qg, qh)]
    values[:a, :b], values[:a, b:], values[a:, :b], values[a:, b:] = leaf
    return best, values


def fit_tables(x: np.ndarray, y: np.ndarray, bins: int = 48, coarse: int = 8, n_pairs: int = 6, rounds: int = 120, pair_rounds: int = 40, rate: float = 0.1, lam: float = 5.0) -> Tables:
    """Learns the tables: rounds over all features in turn, then over the pairs with the largest gain.

    Without rows, or with one label only, the tables are 0 and the score is the
    smoothed share of label 1.
    """
    base_share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(base_share / (1 - base_share)))
    count = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(count)]
    rough = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, coarse + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(count)]
    single = np.zeros((count, bins + 1))
    if len(np.unique(y)) < 2:
        return Tables(cuts, rough, base, single, [], np.zeros((0, coarse, coarse)))
    total = np.full(len(y), base)
    at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(count):
            g, h = slopes()
            n = len(cuts[j]) + 1
            values = rate * _tree(np.bincount(at[j], g, n), np.bincount(at[j], h, n), lam)
            single[j, :n] += values
            total += values[at[j]]
    near = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(rough)]

    def grid(a, b, v):
        return np.bincount(near[a] * coarse + near[b], v, coarse * coarse).reshape(coarse, coarse)

    g, h = slopes()
    ranked = sorted(((_quadrants(grid(a, b, g), grid(a, b, h), lam)[0], a, b) for a in range(count) for b in range(a)), reverse=True)
    pairs = [(a, b) for _, a, b in ranked[:n_pairs]]
    tables = np.zeros((len(pairs), coarse, coarse))
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(pairs):
            g, h = slopes()
            values = rate * _quadrants(grid(a, b, g), grid(a, b, h), lam)[1]
            tables[k] += values
            total += values[near[a], near[b]]
    return Tables(cuts, rough, base, single, pairs, tables)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``max_rows`` documents with a usable 0/1 label, chosen by a hash of the id.

    The bound is what the driver can hold to fit a model; it bounds nothing else.
    A document with several labels counts as 1 if any is. Null ids and labels are left out.
    """
    ids = labels.where(usable & F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).alias("__llm_label"))
    ids = ids.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    return docs.join(F.broadcast(ids), id_col)


def feature_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``features`` of each text."""
    schema = T.StructType([*docs.schema.fields, T.StructField("features", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _feature_batches(batch, text_col)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.names)

    return docs.mapInArrow(run, schema)


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Tables:
    """Learns from at most ``max_rows`` labelled documents; features are computed on Spark."""
    sample = labelled_sample(docs.select(id_col, text_col), labels.select(id_col, label), label, usable, max_rows, id_col)
    rows = feature_rows(sample, text_col).select(id_col, F.col("__llm_label").alias("y"), "features").orderBy(id_col).toArrow()
    x = np.array(rows.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_tables(x, rows.column("y").to_numpy().astype(float))


def score_quality(docs: DataFrame, model: Tables, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the probability that a text has quality label 1.

    Null, empty and blank texts score what features of 0 score. Rows are independent,
    texts are read whole, other columns are kept; one of the same name is replaced.
    """
    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(_feature_batches(batch, text_col)))], names=schema.names)

    return docs.mapInArrow(run, schema)
