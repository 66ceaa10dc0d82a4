"""Alignment of the tokens of two tokenizers by diagonal run skipping.

Both cut the same bytes, so the places where both end a token cut a text into
groups. While tokens meet one to one, the end arrays agree at a fixed shift of
index: stretches are probed in doubling steps at that shift and jumped as a whole.
Where they part, the group is resolved token by token and sets the next shift.
"""

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelens.llm.storage import staged

CHUNK_CHARS = 3 << 20
ENCODE_CHARS = 1 << 20
CACHED_WORDS, CACHED_CHARS, WORDS_AT_ONCE = 150_000, 48, 4096
MARK = "▁"
BLANK_INSIDE = re.compile(f"[^{MARK}]{MARK}")
# Runs of blanks reach over words, and blanks at the ends of a text have no word.
UNSAFE_BLANKS = re.compile(r"\s \s|  |\A | \Z")


def aligned(a: list[int], b: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """Groups of tokens by the ends of both, as (first of a, first of b, number of a, number of b).

    A stretch of one-to-one groups is given as one: its numbers are equal, and each token
    of it ends with its partner. An irregular group is given alone; its numbers are equal
    only if it holds two tokens or more of each that end apart, which the caller tells
    by the ends. Both lists rise and end alike.
    """
    i = j = 0
    while i < len(a):
        width, run = 4, 0
        while a[i + run : i + run + width] == b[j + run : j + run + width] and i + run < len(a):
            run += min(width, len(a) - i - run)
            width *= 2
        while width > 1:  # halve back to the first place where the ends part
            width //= 2
            if a[i + run : i + run + width] == b[j + run : j + run + width] and i + run + width <= len(a):
                run += width
        if run:
            yield i, j, run, run
            i, j = i + run, j + run
        if i < len(a):
            x, y = i, j
            while a[x] != b[y]:
                if a[x] < b[y]:
                    x += 1
                else:
                    y += 1
            yield i, j, x + 1 - i, y + 1 - j
            i, j = x + 1, y + 1


class Aligned(NamedTuple):
    """Facts of texts in order: numbers of tokens of both and of groups, packed codes of linked pairs and how many each has, groups as text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    links: np.ndarray
    groups: list[bytes]


# What is kept of a word with a blank in front: the numbers of its tokens and the codes of its links, and its groups as text.
Unit = tuple[bytes, bytes]
NO_UNIT: Unit = (struct.pack("<2I", 0, 0), b"")


@cache
def _byte_alphabet() -> dict[str, int]:
    """The byte of each character of byte-level entries: printable ones stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


class _Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work; threads of a task would only add memory
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(byte_level.decode())
        self.a.encode_special_tokens = True
        alphabet = _byte_alphabet()
        self.a_bytes = {i: bytes(alphabet[c] for c in entry) for entry, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in alphabet for c in entry)}
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        entries = [p for i in range(self.b.get_piece_size()) if not self.b.is_byte(i) for p in [self.b.id_to_piece(i)]]
        # Words part at blanks in both: A's because its pattern does, B's if blanks are only in front of its pieces.
        self.by_word = not any(BLANK_INSIDE.search(p) for p in entries)
        self.blank = [self.b.piece_to_id(MARK)]  # what the library gives no text for
        self.known: dict[str, Unit] = {}
        self.older: dict[str, Unit] = {}

    def _encode(self, text: str) -> tuple[list[int], np.ndarray, list[int], np.ndarray] | None:
        """Ids and byte ends of a text with a blank in front, by both; nothing where their bytes are not those."""
        data = b" " + text.encode()
        x, y = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text) if text else self.blank
        p, q = [self.a_bytes.get(k, b"") for k in x], [self.b_bytes[k] for k in y]
        if b"".join(p) != data or b"".join(q) != data:
            return None
        return x, np.cumsum(list(map(len, p))), y, np.cumsum(list(map(len, q)))

    def _align(self, text: str, ends: np.ndarray) -> list[Unit] | None:
        """Units of a text that end at ``ends``; nothing where bytes differ or a token reaches over an end."""
        found = self._encode(text)
        if found is None:
            return None
        x, a, y, b = found
        of_a, of_b = np.searchsorted(a, ends), np.searchsorted(b, ends)
        if (a[of_a] != ends).any() or (b[of_b] != ends).any():
            return None
        groups, last_a, at_a, at_b = groups_and_links(x, a.tolist(), y, b.tolist())
        codes = np.array(x, np.uint32)[at_a] * np.uint32(len(self.b_bytes)) + np.array(y, np.uint32)[at_b]
        links, rows = codes.tobytes(), []
        group_ends, link_ends = np.searchsorted(last_a, of_a, "right").tolist(), np.searchsorted(at_a, of_a, "right").tolist()
        i = j = g = l = 0
        for m, n, h, k in zip((of_a + 1).tolist(), (of_b + 1).tolist(), group_ends, link_ends):
            rows.append((struct.pack("<2I", m - i, n - j) + links[4 * l : 4 * k], ";".join(groups[g:h]).encode()))
            i, j, g, l = m, n, h, k
        return rows

    def _learn(self, words: list[str]) -> None:
        """Aligns new words: many in one text, in which they stay apart; those with blanks at their ends and any that fail alone."""
        joined = [w for w in words if w and not w[0].isspace() and not w[-1].isspace() and MARK not in w and len(w) <= CACHED_CHARS]
        for at in range(0, len(joined), WORDS_AT_ONCE):
            some = joined[at : at + WORDS_AT_ONCE]
            ends = np.cumsum([len(w.encode()) + 1 for w in some])
            self.known.update(zip(some, self._align(" ".join(some), ends) or ()))
        for word in words:
            if word not in self.known:
                found = self._align(word, np.array([len(word.encode()) + 1]))
                self.known[word] = found[0] if found else NO_UNIT

    def aligned(self, texts: list[str]) -> Aligned:
        """Facts of each text. Each different word is aligned once, and looked up once for all texts together."""
        known, older = self.known, self.older
        whole = [n for n, t in enumerate(texts) if t and (not self.by_word or UNSAFE_BLANKS.search(t))]
        alone = set(whole)
        split = pc.split_pattern(pa.array(["" if n in alone else t for n, t in enumerate(texts)], pa.large_string()), " ")
        kinds = pa.large_list(pa.large_string())
        words = pa.concat_arrays([split.cast(kinds), pa.array([[texts[n]] for n in whole], kinds)])
        coded = words.flatten().dictionary_encode()
        unique = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        missing = [w for w in unique if w not in known]
        known.update((w, older[w]) for w in missing if w in older)
        new = [w for w in missing if w not in older]
        self._learn(new)
        units = [known[w] for w in unique]
        for word in new:
            if len(word) > CACHED_CHARS:
                del known[word]
        if len(known) >= CACHED_WORDS:
            self.known, self.older = {}, known

        flat = np.frombuffer(b"".join([u[0] for u in units]), "<u4")
        groups = [u[1] for u in units]
        sizes = np.fromiter((len(u[0]) for u in units), np.int64, len(units)) // 4
        starts = np.cumsum(sizes) - sizes
        counts = np.fromiter((g.count(b";") + 1 if g else 0 for g in groups), np.int64, len(units))
        bad = np.fromiter((not g for g in groups), bool, len(units))

        lengths = pc.list_value_length(words).to_numpy()
        at = coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(lengths)])
        # A whole text stands behind the others: its words are those, and not the empty one in its place.
        low, high = ends[: len(texts)].copy(), ends[1 : len(texts) + 1].copy()
        low[whole], high[whole] = ends[len(texts) : -1], ends[len(texts) + 1 :]
        spoilt = np.concatenate([[0], np.cumsum(bad[at])])
        empty = np.array([not t for t in texts], bool) | (spoilt[high] > spoilt[low])
        high[empty] = low[empty]

        # The words of each text again, now in the order of texts and without those that have no tokens.
        own = high - low
        at = at[np.repeat(low - (np.cumsum(own) - own), own) + np.arange(own.sum())]
        n_links = sizes[at] - 2
        places = np.repeat(starts[at] + 2 - (np.cumsum(n_links) - n_links), n_links) + np.arange(n_links.sum())
        bounds = np.concatenate([[0], np.cumsum(own)])
        shown = [b";".join(map(groups.__getitem__, at[i:j].tolist())) for i, j in zip(bounds, bounds[1:])]
        first = flat[starts].astype(np.int64) if len(units) else np.zeros(0, np.int64)
        second = flat[starts + 1].astype(np.int64) if len(units) else np.zeros(0, np.int64)
        before = coded.indices.to_numpy()

        def of_text(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values[before])])
            return total[high] - total[low]

        return Aligned(of_text(first), of_text(second), of_text(counts), of_text(sizes - 2), flat[places], shown)


def groups_and_links(x: list[int], a: list[int], y: list[int], b: list[int]) -> tuple[list[str], list[int], list[int], list[int]]:
    """The groups as text, the last token of A in each, and the indices of each pair of tokens whose bytes overlap."""
    groups, last_a, at_a, at_b = [], [], [], []
    for i, j, m, n in aligned(a, b):
        if m == n and a[i] == b[j]:
            groups += [f"{p}|{q}" for p, q in zip(x[i : i + m], y[j : j + n])]
            last_a += range(i, i + m)
            at_a += range(i, i + m)
            at_b += range(j, j + n)
            continue
        groups.append(",".join(map(str, x[i : i + m])) + "|" + ",".join(map(str, y[j : j + n])))
        last_a.append(i + m - 1)
        p, q, last = i, j, a[i + m - 1]
        while True:
            at_a.append(p)
            at_b.append(q)
            end = min(a[p], b[q])
            if end == last:
                break
            p, q = p + (a[p] == end), q + (b[q] == end)
    return groups, last_a, at_a, at_b


_PAIRS: dict[int, _Pair] = {}


def _aligned_chunks(byte_level: bytes, pieces: bytes, digest: bool, schema: T.StructType):
    """One row per chunk of texts: facts of each, pair codes with the number of texts that hold them, and all links as places among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((byte_level, pieces))
        pair = _PAIRS.get(key) or _PAIRS.setdefault(key, _Pair(byte_level, pieces))
        number, names = TaskContext.get().partitionId() << 32, schema.names

        def chunk(ids: list[pa.Array], facts: list[tuple], links: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            sizes = np.array([f[3] for f in facts], np.int64)
            codes, places = np.unique(np.concatenate(links), return_inverse=True)
            held = np.unique(np.repeat(np.arange(len(facts)), sizes) * max(1, len(codes)) + places) % max(1, len(codes))
            packed = pa.compress(places.astype(np.uint32).tobytes(), "zstd", asbytes=True) if len(places) else b""
            row = {
                "chunk": pa.array([number], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(facts)], pa.int32()), pa.concat_arrays(ids)),
                "links": pa.array([packed], pa.binary()),
                "codes": pa.array([codes.astype(np.int64)], pa.list_(pa.int64())),
                "docs": pa.array([np.bincount(held, minlength=len(codes))], pa.list_(pa.int64())),
            }
            for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links")):
                row[name] = pa.array([[f[k] for f in facts]], pa.list_(pa.int64()))
            row["groups"] = pa.array([[f[4] for f in facts]], pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([row[n] for n in names], names=names)

        ids, facts, links, size = [], [], [], 0
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                some, begin, chars = [], at, 0
                while at < batch.num_rows and chars < ENCODE_CHARS:
                    some.append(texts[at].as_py() or "")
                    chars += len(some[-1])
                    at += 1
                ids.append(keys.slice(begin, at - begin))
                found = pair.aligned(some)
                numbers = zip(*(x.tolist() for x in found[:4]))
                for own, text in zip(numbers, found.groups):
                    facts.append((*own, hashlib.sha256(text).hexdigest() if digest and text else text.decode()))
                links.append(found.links)
                size += chars
                if size >= CHUNK_CHARS:
                    yield chunk(ids, facts, links)
                    ids, facts, links, size = [], [], [], 0
        if facts:
            yield chunk(ids, facts, links)

    return run


def _scored(schema: T.StructType):
    """Rows of the documents of each chunk, with the sums over their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = {n: batch.column(k)[i] for k, n in enumerate(batch.schema.names)}
                sizes = cell["n_links"].values.to_numpy(zero_copy_only=False)
                total = int(sizes.sum())
                sums = np.zeros((2, total + 1), np.int64)
                if total:
                    places = np.frombuffer(pa.decompress(cell["links"].as_py(), total * 4, "zstd", asbytes=True), np.uint32)
                    found = cell["counts"].values.flatten()
                    order = np.argsort(found[0].to_numpy())
                    for k in (0, 1):
                        np.cumsum(found[k + 1].to_numpy()[order][places], out=sums[k, 1:])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                best, count = (pa.array(np.diff(s[ends]), pa.int64()) for s in sums)
                own = [cell[n].values for n in ("ids", "n_a", "n_b", "n_groups", "n_links")]
                yield pa.RecordBatch.from_arrays([*own, best, count, cell["groups"].values], names=schema.names)

    return run


def align_tokens(docs: DataFrame, byte_level: bytes, pieces: bytes, digest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups and links of the tokens that two tokenizers give each whole text with a space in front.

    A is the content of a byte-level tokenizer file, B of a piece model that adds the space
    itself; special tokens are plain text. One row per document: id, n_a, n_b, n_groups,
    n_links (pairs of token occurrences whose bytes overlap), n_best (links whose pair of
    ids is, of all pairs of its A id, in the most documents of the table, ties included),
    count_sum (documents that hold a link's pair, summed over the links), groups
    (``a1,a2|b1;a3|b2,b3``; with ``digest`` its SHA-256 in lowercase hex).

    A text that is null, empty or does not come back byte by byte from either has no
    tokens: zeros and an empty ``groups``. Repeated rows are documents of their own, also
    when they share an id or have none. Other columns are left out. An empty table gives
    an empty result.

    A text whose words are parted by single blanks is aligned word by word, as no token of
    either reaches over a blank in front of a word; words met lately are looked up. Others
    are aligned whole. Texts go through their task in chunks of about three million characters (a longer text
    is one alone), and pairs are summed up in a chunk before they move. So a pair that
    occurs everywhere has one row per chunk, and a document moves as the compressed
    places of its links among the pairs of its chunk.
    """
    of = docs.schema[id_col].dataType
    lists = {n: T.ArrayType(T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "codes", "docs")}
    lists |= {"ids": T.ArrayType(of), "groups": T.ArrayType(T.StringType()), "links": T.BinaryType(), "chunk": T.LongType()}
    schema = T.StructType([T.StructField(n, t) for n, t in lists.items()])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chunks = staged(texts.mapInArrow(_aligned_chunks(byte_level, pieces, digest, schema), schema), "aligned")

    base = _Pair(byte_level, pieces).b.get_piece_size()
    held = chunks.select("chunk", F.posexplode(F.arrays_zip("codes", "docs")).alias("place", "pair"))
    held = held.select("chunk", "place", F.col("pair.codes").alias("code"), F.col("pair.docs").alias("docs"))
    counts = staged(held.groupBy("code").agg(F.sum("docs").alias("count")).withColumn("a", F.floor(F.col("code") / base)), "pair-counts")
    # One row per id of A's vocabulary, whatever the data.
    highest = counts.groupBy("a").agg(F.max("count").alias("highest"))
    counts = counts.join(F.broadcast(highest), "a").select("code", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    marks = held.join(counts, "code").groupBy("chunk").agg(F.collect_list(F.struct("place", "best", "count")).alias("counts"))

    wanted = ["ids", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]
    out = T.StructType([T.StructField("id", of), *[T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], T.StructField("groups", T.StringType())])
    return chunks.select("chunk", *wanted).join(marks, "chunk", "left").select(*wanted, "counts").mapInArrow(_scored(out), out)
