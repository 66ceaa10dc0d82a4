"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by pseudo-rotations (random signs and a Hadamard transform, three
times) and falls to the nearest of the 2d signed axes; a second, shorter polytope
refines the bucket when there are many vectors. Several tables are kept, and each
query probes the buckets it is nearest to. Candidates are ranked by exact cosine.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placelens.llm.storage import staged

CHUNK_VECTORS = 4096
QUERY_BLOCK = 1024
FOUND = "query_id long, vec_id long, score double"


def _turned(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of ``x`` (a power of two wide) after sign changes and a Hadamard transform for each row of ``signs``."""
    n, d = x.shape
    for s in signs:
        x, h = x * s, 1
        while h < d:
            x = x.reshape(n, -1, 2, h)
            x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], 2)
            h *= 2
        x = x.reshape(n, d) / np.sqrt(d)
    return x


def _axes(x: np.ndarray, table: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """Closeness of each row to the signed axes of the first and of the shorter second polytope."""
    d = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, d - x.shape[1])))
    rng = np.random.default_rng([table, d])
    first = _turned(x, rng.choice([-1.0, 1.0], (3, d)))
    other = _turned(x, rng.choice([-1.0, 1.0], (3, d)))[:, : max(1, min(second // 2, d))]
    both = [np.concatenate([y, -y], axis=1) for y in (first, other)]
    return both[0], both[1] if second > 1 else np.zeros((len(x), 1))


def _by_length(vectors: pa.Array):
    """(rows, matrix) of the vectors of each length."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.values.to_numpy(zero_copy_only=False)
    starts = lists.offsets.to_numpy()[:-1]
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, flat[starts[rows][:, None] + np.arange(n)].astype(np.float64)


def _hashed(tables: int, second: int, probes: int):
    """(id, vector, table, bucket): one bucket per table, or the ``probes`` nearest ones."""

    def run(batches):
        for batch in batches:
            for rows, x in _by_length(batch.column("vec")):
                length = x.shape[1]
                for t in range(tables):
                    a, b = _axes(x, t, second)
                    if probes == 1:
                        buckets = (a.argmax(1) * b.shape[1] + b.argmax(1))[:, None]
                    else:
                        loss_a, loss_b = a.max(1, keepdims=True) - a, b.max(1, keepdims=True) - b
                        near_a = np.argsort(loss_a, axis=1, kind="stable")[:, :probes]
                        near_b = np.argsort(loss_b, axis=1, kind="stable")[:, :probes]
                        cost = np.take_along_axis(loss_a, near_a, 1)[:, :, None] ** 2 + np.take_along_axis(loss_b, near_b, 1)[:, None, :] ** 2
                        best = np.argsort(cost.reshape(len(x), -1), axis=1, kind="stable")[:, :probes]
                        buckets = np.take_along_axis(near_a, best // near_b.shape[1], 1) * b.shape[1] + np.take_along_axis(near_b, best % near_b.shape[1], 1)
                    take = np.repeat(rows, buckets.shape[1])
                    # Vectors of different lengths never share a bucket.
                    full = buckets.ravel().astype(np.int64) + (np.int64(length) << 32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(take)), batch.column("vec").take(pa.array(take)), pa.array(np.full(len(take), t, np.int32)), pa.array(full)],
                        ["id", "vec", "table", "bucket"],
                    )

    return run


def _nearest(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """(query ids, ids, scores) of the k candidates of each query with the largest cosine, ties to smaller ids."""
    qn, xn = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1))
    order = np.argsort(ids, kind="stable")
    ids, x, xn = ids[order], x[order], xn[order]
    out = []
    for at in range(0, len(q), 256):
        rough = (q[at : at + 256] / qn[at : at + 256, None]) @ (x / xn[:, None]).T
        for i, row in enumerate(rough):
            row[ids == query_ids[at + i]] = -np.inf
            if len(row) > k:
                near = np.flatnonzero(row >= np.partition(row, -k)[-k] - 1e-9)
            else:
                near = np.arange(len(row))
            near = near[row[near] > -np.inf]
            # The same sum for equal vectors, wherever they stand, so that ties are ties.
            exact = (x[near] * q[at + i]).sum(1) / (xn[near] * qn[at + i])
            best = np.lexsort((ids[near], -exact))[:k]
            out.append((np.full(len(best), query_ids[at + i]), ids[near][best], exact[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def _table(found) -> pa.Table:
    return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})


def _ranked_bucket(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return _table((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
        (_, q), (_, x) = next(_by_length(queries.column("vec"))), next(_by_length(vectors.column("vec")))
        return _table(_nearest(queries.column("id").to_numpy(), q, vectors.column("id").to_numpy(), x, k))

    return run


def _scanned(block: list[tuple[int, list[float]]], k: int):
    lists = pa.array([v for _, v in block], pa.list_(pa.float64()))
    ids = np.array([i for i, _ in block], np.int64)

    def run(batches):
        queries = [(ids[rows], q) for rows, q in _by_length(lists)]
        for batch in batches:
            for rows, x in _by_length(batch.column("vec")):
                for query_ids, q in queries:
                    if q.shape[1] == x.shape[1]:
                        yield from _table(_nearest(query_ids, q, batch.column("id").to_numpy()[rows], x, k)).to_batches()

    return run


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows with an id and a vector that is not null or zero and holds finite numbers only."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    return rows.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False)))


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = 16, probes: int | None = None, second: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` vectors of largest cosine found for each query, itself excluded.

    Every vector is in ``tables`` tables. ``second`` is the size of the second
    polytope, by default so that a bucket has about 100 vectors; ``probes`` buckets
    are searched per table, by default 12, more with a larger ``second``. A bucket of
    very many vectors is cut into chunks that are searched apart. Queries for which
    fewer than ``k`` candidates turned up are compared with all vectors, in blocks.

    Ties go to the smaller id. Vectors that are null, zero or hold null, NaN or
    infinite components take no part, nor do rows without an id; rows that repeat an
    id count once. Only vectors of equal length meet. Empty tables give an empty
    result.
    """
    base = staged(usable_vectors(vectors, id_col, vec_col).dropDuplicates(["id"]), "vectors")
    asked = staged(usable_vectors(queries, id_col, vec_col).dropDuplicates(["id"]), "queries")
    count = base.count()
    if second is None:
        second = 1
        while second < 64 and second * 128 * 100 < count:
            second *= 2
    probes = probes or 12 * max(1, round((second / 4) ** 0.5))
    schema = "id long, vec array<double>, table int, bucket long"
    index = base.mapInArrow(_hashed(tables, second, 1), schema)
    sizes = base.select("id", "vec").mapInArrow(_hashed(tables, second, 1), schema).groupBy("table", "bucket").agg(F.ceil(F.count("*") / CHUNK_VECTORS).alias("chunks"))
    sizes = staged(sizes, "buckets")
    index = index.join(sizes, ["table", "bucket"]).withColumn("chunk", F.pmod(F.xxhash64("id"), "chunks")).drop("chunks")
    probed = asked.mapInArrow(_hashed(tables, second, probes), schema).join(sizes, ["table", "bucket"])
    probed = probed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    keys = ["table", "bucket", "chunk"]
    met = probed.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(_ranked_bucket(k), FOUND)
    found = staged(met.distinct(), "near")

    have = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n"))
    short = asked.join(have, asked["id"] == have["query_id"], "left").where(F.coalesce("n", F.lit(0)) < k).select("id", "vec")
    block = []

    def scan(found, block):
        return found.unionByName(base.mapInArrow(_scanned(block, k), FOUND))

    for row in staged(short, "short").toLocalIterator():
        block.append((row["id"], list(row["vec"])))
        if len(block) == QUERY_BLOCK:
            found, block = scan(found, block), []
    if block:
        found = scan(found, block)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
