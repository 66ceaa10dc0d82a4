"""Writers: JSON documents, CSV, one output per location, and run state."""

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placelens import fixed_values as V
from placelens.functions.export import NUMBERS, csv_line, flat_review
from placelens.session import CLEANUP, VECTORS, setting, staged

LINES_PER_CHUNK = 100


def document_json(documents: DataFrame) -> Column:
    """The document as JSON with every null spelled out."""
    return F.to_json(
        F.struct("business", "reviews", "metadata"), {"ignoreNullFields": "false"}
    )


def flatten_reviews(documents: DataFrame, *keys: str) -> DataFrame:
    """One row per review with the fixed export columns."""
    rows = documents.select(*keys, "business.name", F.explode("reviews").alias("review"))
    flat = flat_review(F.col("name"), F.col("review"))
    return rows.select(*keys, *[flat[c].alias(c) for c in V.CSV_COLUMNS])


def csv_lines(flat: DataFrame, *keys: str) -> DataFrame:
    """Each flat row as the exact line of the CSV export."""
    return flat.select(*keys, csv_line({c: F.col(c) for c in V.CSV_COLUMNS}).alias("line"))


def write_documents_json(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON Lines, one document per line."""
    documents.select(document_json(documents).alias("value")).write.mode(mode).text(path)


def write_reviews_csv(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The flat table as CSV files with a header, formula-safe."""
    flat = flatten_reviews(documents)
    guarded = flat.withColumns(
        {
            c: F.when(F.col(c).rlike(r"\A[=+\-@]"), F.concat(F.lit("\t"), F.col(c))).otherwise(
                F.col(c)
            )
            for c in V.CSV_COLUMNS
            if c not in NUMBERS
        }
    )
    (
        guarded.write.mode(mode)
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .option("nullValue", "")
        .csv(path)
    )


def write_output(documents: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> None:
    """Writes documents as tables of ``json`` or ``csv`` lines."""
    if fmt not in V.OUTPUT_FORMATS:
        raise ValueError(f"format must be one of {V.OUTPUT_FORMATS}")
    writer = write_documents_json if fmt == "json" else write_reviews_csv
    writer(documents, path, mode)


def write_files(
    lines: DataFrame, path: str, mode: str = "errorifexists", dynamic: bool = False
) -> None:
    """Writes the rows of ``document_lines`` with a ``file_stem``: one text file for each stem.

    A file stands alone in the folder ``file_stem=..``. Lines meet in chunks of
    ``LINES_PER_CHUNK`` ordinals, whose texts are joined in parallel and stored, packed;
    the shuffle files of all that led to them go then. Only chunks meet by stem and are
    sorted, with spilling. So no row holds more than a chunk, also for a location of any
    size, and beside the files the disks hold the packed chunks, a shuffle of them and
    its spills; a file has one writer, so the largest location bounds how fast a batch
    can be. The number of tasks is set, since the cost of many small files is not
    seen in their bytes, by which tasks would else be put together. Suited to many
    thousands of locations, not to hundreds of millions.
    With ``dynamic``, overwriting replaces only the folders of the stems given.
    """
    spark = lines.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Stems that can't be null keep the writer from sorting anew, which would not keep the order.
    stem = F.coalesce("file_stem", F.lit("")).alias("file_stem")
    chunk = F.floor(F.col("ordinal") / LINES_PER_CHUNK).alias("_chunk")
    line = F.struct("ordinal", F.coalesce("value", F.lit("")).alias("value")).alias("_line")
    chunks = (
        lines.select(stem, "section", chunk, line)
        .groupBy("file_stem", "section", "_chunk")
        .agg(F.array_sort(F.collect_list("_line")).alias("_lines"))
        .withColumn("value", F.array_join("_lines.value", "\n"))
    )
    with setting(spark, CLEANUP, "true"):
        stored = staged(chunks.select("file_stem", "section", "_chunk", "value"), "file-chunks", "zstd")
    # A batch of a columnar read holds 4,096 rows, whatever their size: chunks are read row by row.
    with setting(spark, CLEANUP, "true"), setting(spark, VECTORS, "false"):
        (
            stored.repartition(tasks, "file_stem")
            .sortWithinPartitions("file_stem", "section", "_chunk")
            .select("file_stem", "value")
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic" if dynamic else "static")
            .partitionBy("file_stem")
            .text(path)
        )


def claim_batch(spark: SparkSession, path: str, first: int) -> int:
    """The next batch id from ``first`` on that no other run has claimed: its mark is created only if it is absent.

    So runs that start together get ids, and so folders, of their own. As safe as the
    store's create without overwriting.
    """
    jvm, batch_id = spark._jvm, first
    while True:
        mark = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_claims/{batch_id}")
        store = mark.getFileSystem(spark._jsc.hadoopConfiguration())
        try:
            if store.createNewFile(mark):
                return batch_id
        except Py4JJavaError as e:  # another run created it between the look and the write
            if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                raise
        batch_id += 1


def commit_run_state(
    completed: DataFrame, path: str, batch_id: int = 0, mode: str = "overwrite"
) -> None:
    """Records completed inputs. Call it after their output is written.

    A batch overwrites only its own folder, so replaying a batch changes nothing;
    with ``append`` it adds to what the folder holds.
    """
    kinds = {"file_stem": "string", "format": "string", "run_no": "bigint"}
    facts = [
        (F.col(c) if c in completed.columns else F.lit(None)).cast(kind).alias(c)
        for c, kind in kinds.items()
    ]
    (
        completed.select("input", *facts, F.current_timestamp().alias("completed_at"))
        .write.mode(mode)
        .parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    )
