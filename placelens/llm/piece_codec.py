"""Exact SentencePiece BPE encoding by backtracking, and decoding.

The encoding that merging gives is the only sequence of pieces whose neighbours are
all compatible: merging their joint text anew gives just the two. So the longest
piece that matches is tried first, a shorter one where its left neighbour does not
fit, and a step back is taken where none fits; a bit for each position remembers
that nothing follows from it.
"""

import codecs
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
BPE = 2
MAX_MODEL_BYTES = 64 << 20
CACHED_WORDS, CACHED_CHARS, CACHED_PAIRS = 250_000, 48, 1_000_000
OUT_BYTES = 4 << 20

codecs.register_error("each-byte", lambda e: ("�", e.start + 1))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""

    def number(at):
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        if tag & 7 == 0:
            value, at = number(at)
        else:
            size, at = (8, at) if tag & 7 == 1 else (4, at) if tag & 7 == 5 else number(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceCodec:
    """Encoder and decoder of one BPE model without a character map."""

    def __init__(self, model: bytes):
        self.pieces, self.scores, self.kinds = [], [], []
        spec = {}
        for field, value in _fields(model):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif field in (2, 3):
                spec[field] = dict(_fields(value))
        trainer, normal = spec.get(2, {}), spec.get(3, {})
        if trainer.get(3, 1) != BPE or not trainer.get(35, 0):
            raise ValueError("a BPE model with byte fallback is needed")
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("models with a character map, joined blanks, user-defined or unused pieces are not supported")
        self.prefix = SPACE if normal.get(3, 1) else ""
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        if any(c not in self.ids for p in self.ids for c in p) or any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("pieces with characters that are no pieces, or with a blank inside, are not supported")
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.controls = {i for i, k in enumerate(self.kinds) if k == CONTROL}
        self.table = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, k in zip(self.pieces, self.kinds)
        ]
        self.fits: dict[tuple[str, str], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.characters = {c for c in self.ids if len(c) == 1}
        other = "".join(map(re.escape, sorted(self.characters)))
        self.runs = re.compile(f"([{other}]+)|([^{other}])", re.DOTALL)
        # A piece that merging its own text does not give is never part of an encoding.
        usable = [p for p in self.ids if self.merged(p) == [p]]
        self.automaton = ahocorasick.Automaton()
        for p in usable:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        known = set(usable)
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in known), None) for p in usable}
        # Pieces hold blanks only in front, so merging never crosses from a word to the next blank.
        self.split = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text, by merging the best pair again and again."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fit(self, pair: tuple[str, str]) -> bool:
        """Whether the two stay apart, as they are, when their joint text is merged."""
        if len(self.fits) >= CACHED_PAIRS:
            self.fits.clear()
        known = self.fits[pair] = self.merged(pair[0] + pair[1]) == [*pair]
        return known

    def backtracked(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all pieces."""
        size, fits, shorter = len(text), self.fits, self.shorter
        longest = [0] * size
        for end, n in self.automaton.iter(text):  # by end, so the last for a start is the longest
            longest[end + 1 - n] = n
        open_ = bytearray(b"\1") * (size + 1)
        out: list[str] = []
        at, piece = 0, text[: longest[0]]
        while piece:
            end = at + len(piece)
            if open_[end] and (not out or ((known := fits.get(pair := (out[-1], piece))) or known is None and self.fit(pair))):
                out.append(piece)
                at = end
                piece = text[at : at + longest[at]] if at < size else ""
            elif shorter[piece]:
                piece = shorter[piece]
            else:
                open_[at] = 0
                piece = out.pop()
                at -= len(piece)
        return out

    def encode_word(self, word: str) -> tuple[int, ...]:
        ids = self.ids
        if self.characters.issuperset(word):
            return tuple([ids[p] for p in self.backtracked(word)])
        out: list[int] = []
        for run, other in self.runs.findall(word):
            out.extend(ids[p] for p in self.backtracked(run)) if run else out.extend(self.bytes[b] for b in other.encode())
        return tuple(out)

    def encode(self, text: str, into: array) -> None:
        """Appends the ids of a text. Words met lately are looked up."""
        words, extend = self.words, into.extend
        for word in self.split.findall(self.prefix + text.replace(" ", SPACE)) if text else ():
            ids = words.get(word)
            if ids is None:
                ids = self.older.get(word) or self.encode_word(word)
                if len(word) <= CACHED_CHARS:
                    words[word] = ids
            extend(ids)
        if len(words) >= CACHED_WORDS:
            self.words, self.older = {}, words

    def decode(self, ids) -> str:
        """The text of ids: blanks for their marks, the added one in front left out."""
        if not self.controls.isdisjoint(ids):  # a control id parts the bytes of a character
            parts = "".join(chr(0) if i in self.controls else chr(1) for i in ids)
            runs = [m.span() for m in re.finditer("\1+", parts)]
            text = "".join(b"".join(map(self.table.__getitem__, ids[a:b])).decode("utf-8", "each-byte") for a, b in runs).encode()
        else:
            text = b"".join(map(self.table.__getitem__, ids))
        first = next((self.pieces[i] for i in ids if self.kinds[i] != CONTROL), "")
        if self.prefix and first.startswith(SPACE):
            text = text[1:]
        return text.decode("utf-8", "each-byte")


_CODECS: dict[int, PieceCodec] = {}


def _codec(model: bytes) -> PieceCodec:
    """The model's codec, built once in a worker."""
    key = hash(model)
    if key not in _CODECS:
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


def read_model(spark, path: str) -> bytes:
    """A model file from any store that Spark reads; its size is checked, as it goes with every task."""
    row = spark.read.format("binaryFile").load(path).select("length", "content").first()
    if row is None or row["length"] > MAX_MODEL_BYTES:
        raise ValueError(f"no model of at most {MAX_MODEL_BYTES} bytes at {path}")
    return bytes(row["content"])


def piece_ids(docs: DataFrame, model: bytes, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Adds ``ids``, the piece ids of the whole text, and with ``decoded`` also ``decoded``, the text of those ids.

    No begin or end ids, no sampling. A null or empty text has no ids and decodes to
    the empty text. Characters without a piece become their UTF-8 bytes; the blank
    mark itself decodes to a blank. Texts of any length work in linear memory. Rows
    are independent: copies, ties and other columns are kept as they are; columns
    named like the new ones are replaced.
    """
    docs = docs.drop("ids", "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    if decoded:
        schema = schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            at = 0
            while at < batch.num_rows:
                flat, ends, back, begin, size = array("i"), [0], [], at, 0
                while at < batch.num_rows and size < OUT_BYTES:
                    text = texts[at].as_py() or ""
                    codec.encode(text, flat)
                    if decoded:
                        back.append(codec.decode(flat[ends[-1] :]))
                    ends.append(len(flat))
                    size += len(text)
                    at += 1
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
                columns = [*batch.slice(begin, at - begin).columns, ids, *([pa.array(back, pa.string())] if decoded else [])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def decode_ids(df: DataFrame, model: bytes, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of the ids in ``ids_col``; null ids give null."""
    df = df.drop("decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        codec = _codec(model)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            back = [None if x is None else codec.decode(x) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def ids_digest(ids: str = "ids"):
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)
