"""Output file names: slugs, counters for equal slugs, names already in use."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.functions.text import file_slug
from placelens.operators.ordered import block_of, ranked, running
from placelens.session import staged

_COUNTED = r"(?s)\A(.*)-([2-9]|[1-9][0-9]{1,17})\z"


def name_counters(names: DataFrame, order: str = "arrival") -> DataFrame:
    """Adds ``slug`` and the 1-based ``n`` of each name among equal slugs."""
    slugs = names.withColumn("slug", file_slug(F.col("name")))
    return ranked(slugs, ["slug"], [block_of(F.col(order))], [F.col(order)], "n")


def taken_numbers(stems: DataFrame) -> DataFrame:
    """Which numbers of which slug existing file stems occupy.

    ``a-2`` is both the bare name of slug ``a-2`` and number 2 of slug ``a``.
    """
    stem = F.col("stem")
    bare = F.struct(stem.alias("slug"), F.lit(1).cast("bigint").alias("t"))
    counted = F.when(
        stem.rlike(_COUNTED),
        F.struct(
            F.regexp_extract(stem, _COUNTED, 1).alias("slug"),
            F.regexp_extract(stem, _COUNTED, 2).try_cast("bigint").alias("t"),
        ),
    )
    return (
        stems.select(F.explode(F.array_compact(F.array(bare, counted))).alias("x"))
        .select("x.*")
        .distinct()
    )


def free_filenames(numbered: DataFrame, stems: DataFrame, order: str = "arrival") -> DataFrame:
    """Adds ``stem``: the n-th new file of a slug takes its n-th free number.

    With the taken numbers t1 < t2 < .. of a slug, t_i - i numbers are free
    below t_i. So the n-th free number is n plus how many taken ones have
    t_i - i < n, which is one running count over both lists merged.
    """
    wanted = numbered.select("slug").distinct()
    taken = taken_numbers(stems).join(wanted, "slug", "left_semi")
    below = ranked(taken, ["slug"], [block_of(F.col("t"))], [F.col("t")], "i").select(
        "slug",
        (2 * (F.col("t") - F.col("i")) + 1).alias("at"),
        F.lit(1).cast("bigint").alias("used"),
        F.lit(None).cast("bigint").alias(order),
    )
    asked = numbered.select(
        "slug", (2 * F.col("n")).alias("at"), F.lit(0).cast("bigint").alias("used"),
        F.col(order).cast("bigint").alias(order),
    )
    counts = running(
        asked.unionByName(below),
        ["slug"],
        [block_of(F.col("at"))],
        [F.col("at"), F.col(order)],
        sums={"skipped": F.col("used")},
    ).filter(F.col(order).isNotNull())
    number = F.col("n") + F.col("skipped")
    return (
        numbered.join(counts.select("slug", order, "skipped"), ["slug", order])
        .withColumn(
            "stem",
            F.when(number == 1, F.col("slug")).otherwise(
                F.concat(F.col("slug"), F.lit("-"), number.cast("string"))
            ),
        )
        .drop("skipped")
    )


def file_plan(
    names: DataFrame, existing: DataFrame, ext: str, order: str = "arrival"
) -> DataFrame:
    """Adds a ``filename`` that is new in the directory and unique in the plan.

    ``names`` holds ``name`` and a unique ``order`` column; ``existing`` holds
    ``filename``. Different slugs can still meet ("A 2" and the second "A"):
    the earliest keeps the name, the others take a free one in a second pass.
    That pass cannot collide again, since every name given so far counts as
    taken and two different slugs only meet in a bare name.
    """
    suffix = F.col("filename").endswith(ext)
    stems = existing.filter(suffix).select(
        F.substring("filename", F.lit(1), F.length("filename") - len(ext)).alias("stem")
    )
    numbered = staged(name_counters(names, order), "numbered-names")
    first = staged(free_filenames(numbered, stems, order), "first-names")
    owners = first.groupBy("stem").agg(F.min(order).alias("_owner"))
    owned = first.join(owners, "stem").withColumn("_kept", F.col(order) == F.col("_owner"))
    kept = owned.filter("_kept").drop("_owner", "_kept")
    moved = owned.filter(~F.col("_kept")).drop("_owner", "_kept", "stem", "n", "slug")
    used = stems.unionByName(first.select("stem").distinct())
    renumbered = staged(name_counters(moved, order), "moved-names")
    second = free_filenames(renumbered, used, order)
    return (
        kept.unionByName(second)
        .withColumn("filename", F.concat(F.col("stem"), F.lit(ext)))
        .drop("stem", "n")
    )
