"""Readers: location lists, result documents, captured pages and run state."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens import schemas
from placelens.functions.text import strict_json, trimmed
from placelens.session import last_of_repeated_keys, staged
from placelens.sources.json_blocks import Block, Placed, joined, unescaped

ROWS_PER_OUTPUT_BATCH = 1000

SCANNED = "source_file string, block bigint, kind string, depth int, n bigint, text string"
PLACED = "source_file string, block bigint, is_array boolean, depth int, commas bigint, lines bigint"

CHUNK_BYTES = 1 << 20
CHUNKS = "source_file string, file_size bigint, block bigint, chunk bigint, chars bigint, size bigint, text binary"
DIGESTS = "source_file string, chars bigint, content_sha256 string"


def _schema(text):
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in text.split(", "))])


def _scanned(batches):
    """Of each block of a file: its lines, the texts that may be items, and what it does to JSON around it."""
    names = ("source_file", "block", "kind", "depth", "n", "text")
    types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string())
    place = block = None
    lines, rows = 0, []

    def ended():
        return (*place, "block", None, lines, block.summary())

    def flush():
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
        rows.clear()
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_PER_OUTPUT_BATCH):
            part = batch.slice(start, ROWS_PER_OUTPUT_BATCH)
            for file, at, line in zip(*(part.column(k).to_pylist() for k in range(3))):
                if (file, at) != place:
                    if place:
                        rows.append(ended())
                    place, block, lines = (file, at), Block(first=at == 0), 0
                rows.append((*place, "line", None, lines, line))
                lines += 1
                found = []
                block.read(line, found)
                rows += [(*place, "item", depth, commas, unescaped(text)) for depth, commas, text in found]
            if rows:
                yield flush()
    if place:
        rows.append(ended())
        yield flush()


def _placed(batches):
    """Form of each file and place of each of its blocks; rows come by file and block."""
    file, held = None, []

    def solved():
        is_array, places = joined([r["text"] for r in held])
        lines, out = 0, []
        for k, r in enumerate(held):
            place = places[k] if is_array else Placed(0, 0)
            out.append((file, r["block"], is_array, place.depth, place.commas, lines))
            lines += r["n"]
        types = (pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
        names = [part.split()[0] for part in PLACED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    for batch in batches:
        for r in batch.to_pylist():
            if held and r["source_file"] != file:
                yield solved()
                held = []
            file = r["source_file"]
            held.append(r)
    if held:
        yield solved()


def read_location_lists(spark: SparkSession, path: str) -> DataFrame:
    """``source_file, ordinal, input`` of every list file, in file order.

    A file that is one JSON array gives its non-blank text items, untrimmed; any other
    file gives its trimmed lines without blanks and ``#`` comments. Duplicates stay. Files
    of any size are read in splits of lines: each split tells what it does to the JSON
    around it, and only that meets per file, one row for each split. A line has to fit
    a row. Runs two jobs, which store what was read once, packed, and where each split
    stands; those rows have a known size, so while they are few no text is shuffled.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.make_valid_utf8("value").alias("value"),
    )
    scanned = staged(lines.mapInArrow(_scanned, SCANNED), "scanned-lists", "zstd")
    blocks = scanned.filter("kind = 'block'").select("source_file", "block", "n", "text")
    ordered = blocks.repartition("source_file").sortWithinPartitions("source_file", "block")
    placed = staged(ordered.mapInArrow(_placed, PLACED), "placed-lists")
    found = scanned.filter("kind <> 'block'").join(
        placed.select("source_file", "block", "is_array", F.col("depth").alias("_depth"), "commas", "lines"), ["source_file", "block"]
    )
    is_item = F.col("is_array") & (F.col("kind") == "item") & (F.col("depth") + F.col("_depth") == 1)
    is_line = ~F.col("is_array") & (F.col("kind") == "line")
    text = trimmed(F.col("text"))
    ordinal = F.col("n") + F.when(F.col("is_array"), F.col("commas")).otherwise(F.col("lines"))
    return found.filter((is_item & (text != "")) | (is_line & (text != "") & ~text.startswith("#"))).select(
        "source_file", ordinal.alias("ordinal"), F.when(F.col("is_array"), F.col("text")).otherwise(text).alias("input")
    )


def _chunked(batches):
    """Lines of each block of a file joined to chunks, which are packed and numbered; each line ends in a newline."""
    codec, schema = pa.Codec("zstd", compression_level=1), _schema(CHUNKS)
    place = number = None
    for batch in batches:
        files, blocks = batch.column("source_file"), batch.column("block").to_numpy()
        names = files.dictionary_encode().indices.to_numpy()
        sizes = pc.add(pc.binary_length(batch.column("value")), 1).to_numpy()
        edges = np.flatnonzero((names[1:] != names[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
            if place != (here := (files[begin].as_py(), int(blocks[begin]))):
                place, number = here, 0
            filled = (np.cumsum(sizes[begin:end]) - 1) // CHUNK_BYTES
            cuts = (np.flatnonzero(filled[1:] != filled[:-1]) + begin + 1).tolist()
            for a, b in zip([begin, *cuts], [*cuts, end]):
                lines = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column("value").slice(a, b - a))
                text = pc.binary_join(lines, b"\n")[0].as_buffer().to_pybytes() + b"\n"
                chars = pc.sum(batch.column("chars").slice(a, b - a)).as_py() + b - a
                row = (here[0], batch.column("file_size")[a].as_py(), here[1], number, chars, len(text), codec.compress(text, asbytes=True))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)
                number += 1


def _digested(batches):
    """SHA-256 of each file, fed chunk by chunk; chunks come by file and place."""
    codec, schema = pa.Codec("zstd"), _schema(DIGESTS)
    file = digest = None
    held, chars, size, want = b"", 0, 0, 0

    def ended():
        # The last line of a file need not end in a newline.
        missing = size > want
        digest.update(b"" if missing else held)
        row = (file, chars - missing, digest.hexdigest())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)

    for batch in batches:
        for k in range(batch.num_rows):
            r = {n: batch.column(n)[k] for n in batch.schema.names}
            if r["source_file"].as_py() != file:
                if digest:
                    yield ended()
                file, want, digest = r["source_file"].as_py(), r["file_size"].as_py(), hashlib.sha256()
                held, chars, size = b"", 0, 0
            text = codec.decompress(r["text"].as_buffer(), r["size"].as_py(), asbytes=True)
            digest.update(held)
            digest.update(memoryview(text)[:-1])
            held, chars, size = b"\n", chars + r["chars"].as_py(), size + len(text)
    if digest:
        yield ended()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``source_file, chars, content_sha256`` of every text file that holds something.

    Files of any size are read in splits of lines, which become chunks of about
    ``CHUNK_BYTES``. A digest is fed in order, so the packed chunks of a file meet in one
    task, which sorts them, with spilling, and holds one of them unpacked at a time.
    """
    meta = {"source_file": "file_path", "file_size": "file_size", "block": "file_block_start"}
    value = F.col("value").cast("binary").alias("value")
    lines = spark.read.option("lineSep", "\n").text(path).select(
        *[F.col(f"_metadata.{m}").alias(n) for n, m in meta.items()], F.length("value").cast("bigint").alias("chars"), value
    )
    chunks = lines.mapInArrow(_chunked, CHUNKS)
    return chunks.repartition("source_file").sortWithinPartitions("source_file", "block", "chunk").mapInArrow(_digested, DIGESTS)


def read_raw_documents(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Documents as text, for validation: ``source_file, value``.

    A file that cannot be read gives one row with a null value, which validation reports
    as unreadable, and the others go on. Bytes that are no UTF-8 become U+FFFD. Which
    files gave nothing is found by a second pass over their names, not their texts. Files
    of no bytes are left out: Spark's listing does not show them.
    """
    file = F.col("_metadata.file_path").alias("source_file")
    rows = (
        spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
        .text(path, wholetext=one_per_file)
        .select(file, F.make_valid_utf8("value").alias("value"))
    )
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source_file"))
    silent = listed.join(rows.select("source_file").distinct(), "source_file", "left_anti")
    return rows.unionByName(silent.withColumn("value", F.lit(None).cast("string")))


def read_review_documents(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Documents as columns. Older ones lack the header count: it reads as null."""
    return spark.read.schema(schemas.DOCUMENT).option("multiLine", one_per_file).json(path)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CAPTURE).parquet(path)


def stream_captures(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(schemas.CAPTURE)
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
    )


def read_run_state(spark: SparkSession, path: str, resume: bool = True) -> DataFrame:
    """Inputs completed by earlier runs. Empty without resume, or when there is no state."""
    empty = spark.createDataFrame([], schemas.RUN_STATE)
    if not resume:
        return empty
    try:
        return (
            spark.read.schema(schemas.RUN_STATE).option("ignoreCorruptFiles", True).parquet(path)
        )
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return empty
        raise


def state_inputs(documents: DataFrame, *keys: str, text: str = "value") -> DataFrame:
    """Completed inputs from JSON state texts (``{"completed": ["..", ..]}``).

    Anything but an object with an array of texts counts as an empty state.
    """
    items = F.try_variant_get(strict_json(F.col(text)), "$.completed", "array<variant>")
    well_formed = F.forall("_items", lambda x: F.schema_of_variant(x) == "STRING")
    inputs = F.transform("_items", lambda x: F.try_variant_get(x, "$", "string"))
    with last_of_repeated_keys(documents.sparkSession):
        states = documents.select(*keys, items.alias("_items"))
    return (
        states.filter(F.coalesce(well_formed, F.lit(False)))
        .select(*keys, F.explode(inputs).alias("input"))
    )


def read_state_file(spark: SparkSession, path: str, resume: bool = True) -> DataFrame:
    """Completed inputs from a JSON state file of an earlier tool run."""
    empty = spark.createDataFrame([], "input string")
    if not resume:
        return empty
    try:
        return state_inputs(spark.read.text(path, wholetext=True))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return empty
        raise
