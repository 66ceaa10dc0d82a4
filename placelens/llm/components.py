"""Connected components of links, as joins and minimums."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelens.llm.storage import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, group) of every node in ``edges`` (left, right); the group is its least node.

    Each round takes the least label among a node and its neighbours, then the label
    of that label, so paths shorten fast. Labels are kept in tables, never on the
    driver; a node with very many neighbours is combined before its shuffle.
    """
    both = staged(edges.select(F.col("left").alias("u"), F.col("right").alias("v")).unionByName(edges.select(F.col("right").alias("u"), F.col("left").alias("v"))).distinct(), "edges")
    labels = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("group")).withColumnRenamed("u", "node"), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("group").alias("near"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.col("group").alias("old"), F.least("group", "near").alias("group"))
        step = staged(step, "labels")
        roots = step.select(F.col("node").alias("root"), F.col("group").alias("above"))
        step = step.join(roots, step["group"] == roots["root"]).select("node", "old", F.least("group", "above").alias("group"))
        step = staged(step, "labels")
        labels = step.select("node", "group")
        if step.where(F.col("old") != F.col("group")).limit(1).count() == 0:
            return labels
