"""Connected components of a table of links, by tables that Spark joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gravure.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (node, root): root is one value per component, the smallest node.

    Null ends and loops are ignored; repeated and reversed links count once; no links give no rows.
    Each round takes the smallest label among neighbours, then the label's own label. Joins read
    written tables, so that a node with very many links can be split by adaptive skew joins, and
    minima are taken before the shuffle. Ends when a round changes nothing.
    """
    ends = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    edges = stored(ends.union(ends.select("b", "a")).distinct())
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("root")))
    while True:
        near = (
            edges.join(labels, edges["b"] == labels["node"])
            .select(F.col("a").alias("node"), "root")
            .union(labels.select("node", "root"))
            .groupBy("node")
            .agg(F.min("root").alias("best"))
        )
        best = stored(near)
        above = best.select(F.col("node").alias("up"), F.col("best").alias("over"))
        jumped = best.join(above, F.col("best") == F.col("up")).select("node", F.col("over").alias("root"))
        new = stored(jumped)
        moved = new.agg(F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()[0]
        old = labels.agg(F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()[0]
        if moved == old:
            return new
        labels = new
