"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gistra.llm.common import remove, written


def _flat(parents: DataFrame) -> tuple[DataFrame, str]:
    """(node, label) with every chain of labels followed to its end, written."""
    labels, folder = written(parents)
    while True:
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after, new = written(labels.join(jump, "label", "left").select("node", F.coalesce("further", "label").alias("label"), F.col("further").isNotNull().alias("moved")))
        remove(labels.sparkSession, folder)
        labels, folder = after.select("node", "label"), new
        if after.filter("moved").isEmpty():
            return labels, folder


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of ``links``; label is the least node of its component.

    Each round hangs every node on its least neighbour below it and follows these
    chains to their ends. Then links are drawn between the ends, and those within
    one end go, so a link costs rows only as long as its ends are apart. Two
    rounds leave at most half of a component's nodes, and a node hangs itself
    up once: all rounds together read rows in proportion to the links. A round's
    tables are written to the shared checkpoint folder. Parents are reduced with
    partial aggregation, and names are looked up by equality joins that Spark may
    split where one node has many links.
    """
    spark = links.sparkSession
    first, folder = written(links.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    lone = links.filter(F.col(a) == F.col(b)).select(F.col(a).alias("node"), F.col(a).alias("label")).distinct()
    edges, folders, rounds = first, [folder], []
    while not edges.isEmpty():
        hung, at = _flat(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label")))
        rounds.append(hung)
        x, y = hung.select(F.col("node").alias("a"), F.col("label").alias("p")), hung.select(F.col("node").alias("b"), F.col("label").alias("q"))
        named = edges.join(x, "a", "left").join(y, "b").select(F.coalesce("p", "a").alias("p"), "q")  # every b hangs on something
        edges, folder = written(named.filter("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
        folders += [at, folder]
    # a label of an early round is a node of a later one, or the least of its component
    found = spark.createDataFrame([], first.select(F.col("a").alias("node"), F.col("a").alias("label")).schema)
    for hung in reversed(rounds):
        after = found.select(F.col("node").alias("label"), F.col("label").alias("further"))
        ends = hung.join(after, "label", "left").select("node", F.coalesce("further", "label").alias("label"))
        found, folder = written(ends.union(found))
        folders.append(folder)
    roots = found.select(F.col("label").alias("node"), "label").distinct()
    out, _ = written(found.union(roots).union(lone.join(found.union(roots), "node", "left_anti")))
    for folder in folders:
        remove(spark, folder)
    return out
