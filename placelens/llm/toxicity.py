"""Toxicity classifier that is regularised by counterfactuals.

A sparse logistic model over the words of a text. For each labelled sentence with an
identity term, copies are made in which the term is swapped for others of its group;
the training loss adds the squared change of the score between a sentence and its
copies. So mentions of a group carry no weight of their own, and neutral mentions
are not taken for attacks.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelens.llm.quality import labelled_sample
from placelens.llm.words import in_chunks, word_hash

IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "queer", "straight", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly", "teenage"),
)


class WordModel(NamedTuple):
    hashes: np.ndarray  # of the words with a weight, ordered
    weights: np.ndarray
    base: float

    def score(self, words: np.ndarray) -> float:
        """Probability of label 1 for the distinct word hashes of a text."""
        at = np.searchsorted(self.hashes, words)
        at[at == len(self.hashes)] = 0
        hit = at[self.hashes[at] == words] if len(self.hashes) else at[:0]
        return float(1 / (1 + np.exp(-np.clip(self.base + self.weights[hit].sum(), -30, 30))))


def _distinct_words(column: pa.Array) -> Iterator[np.ndarray]:
    """Ordered distinct hashes of each text's words: letters and digits, A-Z lower-cased."""
    for _, _, words in in_chunks(column, lower=True, letters=True):
        for a, b in zip(words.first, words.first[1:]):
            yield np.unique(words.hashes[a:b])


def word_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``words``, the distinct word hashes of each text."""
    schema = T.StructType([*docs.schema.fields, T.StructField("words", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            lists = [x.view(np.int64) for x in _distinct_words(batch.column(batch.schema.get_field_index(text_col)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=schema.names)

    return docs.mapInArrow(run, schema)


def _chosen_words(rows: list[np.ndarray], y: np.ndarray, identity: np.ndarray, max_words: int, min_docs: int, z_least: float) -> np.ndarray:
    """Words whose share among toxic texts differs from that among others by ``z_least`` standard errors, and identity terms."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    marks = np.repeat(y, [len(r) for r in rows]) if rows else np.zeros(0)
    words, at = np.unique(flat, return_inverse=True)
    n, k = np.bincount(at, minlength=len(words)), np.bincount(at, marks, len(words))
    share = k.sum() / max(1, n.sum())
    share = y.mean() if len(y) else share
    z = (k - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
    good = (n >= min_docs) & (np.abs(z) >= z_least)
    order = np.argsort(-np.abs(np.where(good, z, 0)), kind="stable")[: min(max_words, int(good.sum()))]
    return np.unique(np.concatenate([words[order], identity[np.isin(identity, words)]]))


def fit_words(rows: list[np.ndarray], y: np.ndarray, groups=IDENTITY_GROUPS, max_words: int = 4096, min_docs: int = 5, z_least: float = 4.0, l1: float = 3e-4, swap_weight: float = 1.0, steps: int = 200) -> WordModel:
    """Learns weights of words from texts given as distinct word hashes.

    With one label only, or no rows, there are no weights and the score is the
    smoothed share of label 1.
    """
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(share / (1 - share)))
    none = WordModel(np.zeros(0, np.uint64), np.zeros(0), base)
    if len(np.unique(y)) < 2:
        return none
    terms = [np.array([word_hash(t) for t in g], np.uint64) for g in groups]
    words = _chosen_words(rows, y, np.concatenate(terms), max_words, min_docs, z_least)
    if not len(words):
        return none
    row, col = [], []
    swaps: list[tuple[np.ndarray, np.ndarray]] = []  # words that a swap takes away, and brings
    for i, r in enumerate(rows):
        at = np.searchsorted(words, r)
        at[at == len(words)] = 0
        hit = at[words[at] == r]
        row.append(np.full(len(hit), i))
        col.append(hit)
        for g in terms:
            present, absent = g[np.isin(g, r)], g[~np.isin(g, r)]
            for a in present:
                for b in absent:
                    swaps.append((np.flatnonzero(words == a), np.flatnonzero(words == b)))
    row, col = np.concatenate(row), np.concatenate(col)
    count = np.bincount(col, minlength=len(words))
    w, b = np.zeros(len(words)), base
    m, v, mb, vb = np.zeros(len(words)), np.zeros(len(words)), 0.0, 0.0
    gone, came = (np.concatenate([s[k] for s in swaps]) if swaps else np.zeros(0, int) for k in (0, 1))
    gone_of, came_of = (np.repeat(np.arange(len(swaps)), [len(s[k]) for s in swaps]) if swaps else np.zeros(0, int) for k in (0, 1))
    class_weight = np.where(y == 1, min(4.0, (1 - share) / share), 1.0)
    class_weight /= class_weight.mean()
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], len(y)), -30, 30)))
        error = (p - y) * class_weight / len(y)
        grad = np.bincount(col, error[row], len(words))
        if swaps:  # squared change of the logit between a text and each of its copies
            change = np.bincount(gone_of, w[gone], len(swaps)) - np.bincount(came_of, w[came], len(swaps))
            change *= 2 * swap_weight / len(swaps)
            grad += np.bincount(gone, change[gone_of], len(words)) - np.bincount(came, change[came_of], len(words))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.999 * vb + 0.001 * error.sum() ** 2
        rate = 0.1 / np.sqrt(1 + t / 50)
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 * 10 / np.sqrt(1 + count / len(y)), 0)
        b = b - rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    kept = np.abs(w) > 1e-3
    return WordModel(words[kept], w[kept], float(b))


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", max_rows: int = 12_000, groups=IDENTITY_GROUPS, id_col: str = "doc_id", text_col: str = "text") -> WordModel:
    """Learns from at most ``max_rows`` labelled documents; words are hashed on Spark."""
    sample = labelled_sample(docs.select(id_col, text_col), labels.select(id_col, label), label, usable, max_rows, id_col)
    rows = word_rows(sample, text_col).select(id_col, F.col("__llm_label").alias("y"), "words").orderBy(id_col).toArrow()
    words = [np.array(x.values, np.int64).view(np.uint64) if len(x.values) else np.zeros(0, np.uint64) for x in rows.column("words")]
    return fit_words(words, rows.column("y").to_numpy().astype(float), groups)


def score_toxicity(docs: DataFrame, model: WordModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the probability that a text is toxic.

    Null, empty and blank texts score what no words score. Rows are independent, texts
    are read whole, other columns are kept; one of the same name is replaced.
    """
    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches):
        for batch in batches:
            scores = [model.score(x) for x in _distinct_words(batch.column(batch.schema.get_field_index(text_col)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)
