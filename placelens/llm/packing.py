"""Best-fit packing, planned on the histogram of lengths.

Best fit by falling length needs only counts: bins of equal free space are one
group, and pieces of equal length fill it together. The plan says which ranks of a
length go where, and each piece takes its slot by its rank within its length. The
histogram and the plan are bounded by the capacity, not by the data.
"""

import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placelens.llm.storage import staged
from placelens.operators.ordered import ranked

MARKS = ".,;:!?"
# Composed letters below U+0250 that stay one letter in lower case, and a mark.
PLAIN = re.compile("([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?]?)")
CACHED_WORDS, CACHED_CHARS, WORDS_AT_ONCE = 500_000, 48, 4096
ENCODE_BYTES = 2 << 20
BLOCK_PIECES = 65_536
MAX_CAPACITY = 1 << 16
RANK_BITS = 40


class Run(NamedTuple):
    """Pieces of ranks ``rank`` to ``rank + pieces - 1`` of a length: ``each`` of them go to a sequence, from ``offset`` on."""

    length: int
    rank: int
    pieces: int
    each: int
    sequence: int
    offset: int


def plan_runs(counts: dict[int, int], capacity: int) -> list[Run]:
    """What best fit by falling length gives for ``counts`` pieces of each length.

    The tightest bins that a length fits in are filled first. As bins that were filled
    with it have no room for another, one walk over the free spaces serves a length.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, number) by free space
    runs: list[Run] = []
    sequences = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for space in range(length, capacity + 1):
            new = space == capacity  # the last resort: as many new sequences as are needed
            each = space // length
            if new and left:
                more = -(-left // each)
                free[space].append((sequences, more))
                sequences += more
            while left and free[space]:
                first, bins = free[space].pop()
                full = min(bins, left // each)
                for number, into in ((full, each), (1 if full < bins and left > full * each else 0, left - full * each)):
                    if number:
                        runs.append(Run(length, rank, number * into, into, first, capacity - space))
                        free[space - into * length].append((first, number))
                        first, bins, rank, left = first + number, bins - number, rank + number * into, left - number * into
                if bins:
                    free[space].append((first, bins))
            if not left:
                break
    return runs


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _WordIds:
    """Ids of texts by a tokenizer whose tokens never reach over blanks; words met lately are looked up.

    Words of Latin letters, with a mark or none after them, need nothing of the library
    but its model: composed letters stay as they are, and the mark is a word of its own.
    All other words go through the library whole.
    """

    def __init__(self, tokenizer: bytes):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_str(tokenizer.decode())
        self.model = self.tokenizer.model
        self.letter = dict(zip(range(256), sorted(tokenizers.pre_tokenizers.ByteLevel.alphabet(), key=_byte_of)))
        self.marks = {m: packed(self.tokenizer.encode(m, add_special_tokens=False).ids) for m in MARKS}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids_of_letters(self, core: str) -> bytes:
        lower = core.lower()
        shown = lower if lower.isascii() else "".join([self.letter[b] for b in lower.encode()])
        return packed([token.id for token in self.model.tokenize(shown)])

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that are not known; those of usual length are kept."""
        known, older, others, long = self.known, self.older, [], {}
        for word in words:
            if word in older:
                known[word] = older[word]
                continue
            plain = PLAIN.fullmatch(word)
            if plain and len(word) <= CACHED_CHARS:
                core, mark = plain.groups()
                ids = known.get(core) or older.get(core)
                if ids is None:
                    ids = known[core] = self._ids_of_letters(core)
                if mark:
                    known[word] = ids + self.marks[mark]
            else:
                others.append(word)
        for at in range(0, len(others), WORDS_AT_ONCE):
            some = others[at : at + WORDS_AT_ONCE]
            for word, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                (known if len(word) <= CACHED_CHARS else long)[word] = packed(found.ids)
        return long

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's begin in them. Each different word is looked up once."""
        parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        words = parts.flatten().dictionary_encode()
        unique = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        long = self._learn([w for w in unique if w not in known])
        ids = [known[w] if w in known else long[w] for w in unique]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, at = np.frombuffer(b"".join(ids), "<u4"), words.indices.to_numpy()
        lengths = sizes[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        places = np.repeat((np.cumsum(sizes) - sizes)[at] - ends[:-1], lengths) + np.arange(ends[-1])
        if len(known) >= CACHED_WORDS:
            self.known, self.older = {}, known
        return flat[places], ends[np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])]


def _byte_of(shown: str) -> int:
    """The byte that a character of byte-level entries stands for: printable ones for themselves, the rest from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return ord(shown) if ord(shown) in plain else sorted({*range(256)} - {*plain})[ord(shown) - 256]


_ENCODERS: dict[int, _WordIds] = {}


def token_pieces(
    docs: DataFrame, tokenizer: bytes, capacity: int = 2048, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Token ids of every whole text and ``end_id`` after them, cut where they exceed ``capacity``.

    One row per piece: id, piece (from 0), start (the document's ids before it), length,
    ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) and, with ``with_ids``,
    ids. ``tokenizer`` is the content of a tokenizer file whose tokens do not reach over
    blanks (space, 0x09-0x0D), as for word-end vocabularies: each word between blanks is
    encoded by the library and kept for the next time. A null or empty text has just the
    end id; a long text is cut, never shortened; repeated rows, also of one id, are pieces
    of their own; an empty table has none. Other columns are left out.
    """
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), False)))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tokenizer)
        encoder = _ENCODERS.get(key) or _ENCODERS.setdefault(key, _WordIds(tokenizer))

        last = np.array([end_id], "<u4")

        def flush():
            columns = [keys.take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            begins = np.concatenate([[0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))])
            end = 0
            while end < batch.num_rows:
                begin, end = end, max(end + 1, int(np.searchsorted(begins, begins[end] + ENCODE_BYTES, "right")) - 1)
                ids, bounds = encoder.encode(texts.slice(begin, end - begin))
                rows, numbers, starts, lengths, sums, kept = [], [], [], [], [], []
                for i, low, high in zip(range(begin, end), bounds, bounds[1:]):
                    own = np.append(ids[low:high], last)
                    for number, start in enumerate(range(0, len(own), capacity)):
                        piece = own[start : start + capacity]
                        rows.append(i), numbers.append(number), starts.append(start), lengths.append(len(piece)), sums.append(zlib.crc32(piece))
                        if with_ids:
                            kept.append(piece.view("<i4"))
                yield flush()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _slots(runs: list[Run], names: list[str]):
    """Sequence and offset of pieces, looked up by length and rank."""
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    code = (table[:, 0] << RANK_BITS) + table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("length", "__llm_rank"))
            at = np.searchsorted(code, (length << RANK_BITS) + rank - 1, "right") - 1
            nth = rank - 1 - table[at, 1]
            found = {
                "sequence_id": pa.array(table[at, 4] + nth // table[at, 3], pa.int64()),
                "offset": pa.array(table[at, 5] + nth % table[at, 3] * length, pa.int64()),
            }
            yield pa.RecordBatch.from_arrays([found[n] if n in found else batch.column(batch.schema.get_field_index(n)) for n in names], names=names)

    return run


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces as ``token_pieces`` gives them, or to any table with their id, piece, length and ids_crc32.

    Sequences hold at most ``capacity`` tokens and are as many as best fit by falling
    length needs; the offsets of a sequence are gapless from 0. The driver sees one
    count per length, and the plan goes to the tasks: both are bounded by ``capacity``
    (65,536 at most). Ranks within a length are counted in blocks of pieces, by a hash of
    id and piece, so that a length that many pieces share is not ranked in one task. A
    length below 1, above ``capacity`` or null is an error. Other columns stay as they
    are, but for those of the new names. ``pieces`` is read three times: hand in a
    stored table.
    """
    if not 1 <= capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be 1 to {MAX_CAPACITY}")
    pieces = pieces.drop("sequence_id", "offset")
    allowed = F.coalesce(F.col("length").between(1, capacity), F.lit(False))
    histogram = pieces.groupBy(F.when(allowed, F.col("length")).alias("length")).count()
    counts = {r["length"]: r["count"] for r in histogram.collect()}  # at most capacity + 1 rows
    if None in counts:
        raise ValueError(f"{counts[None]} pieces have no length of 1 to {capacity}")
    spark = pieces.sparkSession
    blocks = spark.createDataFrame([(n, 1 + c // BLOCK_PIECES) for n, c in counts.items()], "length long, __llm_blocks long")
    block = F.pmod(F.xxhash64("id", "piece"), F.col("__llm_blocks"))
    order = [F.col("id"), F.col("piece"), F.col("ids_crc32")]
    rows = pieces.withColumn("length", F.col("length").cast("long")).join(F.broadcast(blocks), "length")
    rows = ranked(rows, ["length"], [block], order, "__llm_rank").drop("__llm_blocks")
    names = [*pieces.columns, "sequence_id", "offset"]
    schema = T.StructType([*[rows.schema[n] for n in pieces.columns], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.mapInArrow(_slots(plan_runs(counts, capacity), names), schema)


def pack_documents(docs: DataFrame, tokenizer: bytes, capacity: int = 2048, **options) -> DataFrame:
    """``token_pieces`` of documents, stored once, with their places in packed sequences."""
    return pack(staged(token_pieces(docs, tokenizer, capacity, **options), "pieces"), capacity)
