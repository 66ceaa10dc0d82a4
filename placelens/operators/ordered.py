"""Order-dependent results inside a key, without one task per key.

A plain window over a key sorts the whole key in one task, which fails to scale
when a single location holds a large share of the rows. Here every key is cut
into blocks that follow the order; work happens per (key, block), and only one
row per block meets in a per-key window that carries the running values over.
"""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65536


class Peak(NamedTuple):
    """A running maximum of ``offset + factor * the running sum named of``.

    Rows where ``offset`` is null don't count. Blocks add up like the sum itself: a
    block's peak rises by ``factor`` times the sum before it.
    """

    of: str
    offset: Column
    factor: int = 1


def block_of(position: Column, width: int = BLOCK_ROWS) -> Column:
    return F.floor(position / width)


def _zero(column: str) -> Column:
    return F.coalesce(column, F.lit(0))


def _before(
    totals: DataFrame,
    keys: list[str],
    names: list[str],
    sums: Sequence[str],
    maxima: Sequence[str],
    peaks: dict[str, tuple[str, int]],
    coarse: Sequence[Column] | None,
    of_key: dict[str, str],
) -> DataFrame:
    """For each block the values of all blocks before it, as ``_before_..`` columns.

    ``peaks`` names the sum and factor of each peak; ``of_key`` the sums whose total over
    the whole key is wanted, and its name. With ``coarse`` blocks of blocks, only one row
    per coarse block meets per key.
    """
    wide = [f"_coarse{i}" for i in range(len(coarse or ()))]
    rows = totals.withColumns(dict(zip(wide, coarse))) if coarse else totals
    group = Window.partitionBy(*keys, *wide)
    earlier = group.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    near = rows.withColumns(
        {
            **{f"_before_{n}": F.sum(n).over(earlier) for n in sums},
            **{f"_before_{n}": F.max(n).over(earlier) for n in maxima},
        }
    )
    near = near.withColumns({n: F.col(n) + k * _zero(f"_before_{s}") for n, (s, k) in peaks.items()})
    if not coarse:
        return near.select(
            *keys, *names,
            *[f"_before_{n}" for n in (*sums, *maxima)],
            *[F.max(n).over(earlier).alias(f"_before_{n}") for n in peaks],
            *[F.sum(n).over(group).alias(total) for n, total in of_key.items()],
        )
    far_totals = near.groupBy(*keys, *wide).agg(
        *[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in (*maxima, *peaks)]
    )
    far = _before(far_totals, keys, wide, sums, maxima, peaks, None, of_key).withColumnsRenamed(
        {f"_before_{n}": f"_far_{n}" for n in (*sums, *maxima, *peaks)}
    )
    near = near.withColumns({f"_before_{n}": F.max(n).over(earlier) for n in peaks})
    both = {
        **{f"_before_{n}": _zero(f"_before_{n}") + _zero(f"_far_{n}") for n in sums},
        **{f"_before_{n}": F.greatest(f"_before_{n}", f"_far_{n}") for n in maxima},
        **{
            f"_before_{n}": F.greatest(F.col(f"_before_{n}") + k * _zero(f"_far_{s}"), f"_far_{n}")
            for n, (s, k) in peaks.items()
        },
    }
    return near.drop(*sums, *maxima, *peaks).join(far, [*keys, *wide]).select(
        *keys, *names, *[c.alias(n) for n, c in both.items()], *of_key.values()
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    blocks: Sequence[Column],
    order: Sequence[Column],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    coarse: Sequence[Column] | None = None,
    peaks: dict[str, Peak] | None = None,
    of_key: dict[str, str] | None = None,
) -> DataFrame:
    """Adds running sums, maxima and peaks (current row included) per key.

    ``of_key`` adds totals over the whole key: a name for each sum wanted so. ``blocks``
    must not decrease along ``order`` within a key; ``order`` must be total within (key,
    block) for a deterministic result. Keys must not be null. ``coarse``, for keys of very
    many blocks, groups blocks once more; it is written over the block columns
    ``_block0``, ``_block1``, .. and must not decrease along them. ``df`` is read twice,
    once for the few columns of the block totals, whatever is asked for: hand in a stored
    table where its plan is expensive.
    """
    keys, sums, maxima, peaks = list(keys), sums or {}, maxima or {}, peaks or {}
    names = [f"_block{i}" for i in range(len(blocks))]
    values = {f"_value_{n}": c for n, c in {**sums, **maxima}.items()}
    offsets = {f"_value_{n}": p.offset for n, p in peaks.items()}
    parts = df.withColumns({**dict(zip(names, blocks)), **values, **offsets})
    summed, largest = [[f"_value_{n}" for n in x] for x in (sums, maxima)]
    inside = (
        Window.partitionBy(*keys, *names)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    so_far = parts.withColumns({f"_sum_{n}": F.sum(n).over(inside) for n in summed})
    so_far = so_far.withColumns(
        {f"_value_{n}": F.col(f"_value_{n}") + p.factor * F.col(f"_sum__value_{p.of}") for n, p in peaks.items()}
    )
    totals = (so_far if peaks else parts).groupBy(*keys, *names).agg(
        *[F.sum(n).alias(n) for n in summed], *[F.max(n).alias(n) for n in (*largest, *offsets)]
    )
    shifts = {f"_value_{n}": (f"_value_{p.of}", p.factor) for n, p in peaks.items()}
    wanted = {f"_value_{n}": total for n, total in (of_key or {}).items()}
    before = _before(totals, keys, names, summed, largest, shifts, coarse, wanted)
    local = so_far.withColumns({n: F.max(n).over(inside) for n in (*largest, *offsets)})
    results = {
        **{n: F.col(f"_sum__value_{n}") + _zero(f"_before__value_{n}") for n in sums},
        **{n: F.greatest(f"_value_{n}", f"_before__value_{n}") for n in maxima},
        **{
            n: F.greatest(
                F.col(f"_value_{n}") + p.factor * _zero(f"_before__value_{p.of}"), f"_before__value_{n}"
            )
            for n, p in peaks.items()
        },
    }
    made = [*values, *offsets]
    dropped = [*names, *made, *[f"_sum_{n}" for n in summed], *[f"_before_{n}" for n in made]]
    return local.join(before, [*keys, *names]).withColumns(results).drop(*dropped)


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    blocks: Sequence[Column],
    order: Sequence[Column],
    name: str,
    coarse: Sequence[Column] | None = None,
    total: str | None = None,
) -> DataFrame:
    """Adds the 1-based row number of each row within its key, and the key's row count as ``total``."""
    one = {name: F.lit(1).cast("bigint")}
    return running(df, keys, blocks, order, sums=one, coarse=coarse, of_key={name: total} if total else None)


def first_n(
    df: DataFrame,
    keys: Sequence[str],
    blocks: Sequence[Column],
    order: Sequence[Column],
    n: int,
    name: str,
    coarse: Sequence[Column] | None = None,
) -> DataFrame:
    """First ``n`` rows of every key with their row number, by one plan for every ``n``.

    Each block keeps its first ``n`` rows, which Spark does before and after the shuffle
    by (key, block). What a block keeps is enough to tell how many come before the next
    one, up to ``n``; so only those counts meet per key. ``df`` is read twice, once for
    the columns of keys and order: hand in a stored table where its plan is expensive.
    """
    names = [f"_block{i}" for i in range(len(blocks))]
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    kept = df.withColumns(dict(zip(names, blocks))).withColumn("_nth", F.row_number().over(inside))
    kept = kept.filter(F.col("_nth") <= n)
    counts = kept.groupBy(*keys, *names).agg(F.max("_nth").cast("bigint").alias("_n"))
    before = _before(counts, list(keys), names, ["_n"], [], {}, coarse, {}).filter(_zero("_before__n") < n)
    return (
        kept.join(before, [*keys, *names])
        .withColumn(name, F.col("_nth") + _zero("_before__n"))
        .filter(F.col(name) <= n)
        .drop("_nth", "_before__n", *names)
    )
