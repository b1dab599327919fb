"""Connected components of a link table, as Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import stored


def thinned(links: DataFrame, label: str = "thinned") -> DataFrame:
    """Links ``(a, b)``, a < b, that join the same nodes as ``links(a, b)``: about one for each node, however many there were.

    A node keeps the link to the smallest of the smaller nodes it is linked to; these are linked to that one instead. Nodes
    that share them then share those links. This goes on while a tenth of the links goes. Links to NULL are ignored.
    """
    now = stored(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{label}-links")
    n = now.count()
    while True:
        first = now.groupBy("b").agg(F.min("a").alias("first"))
        moved = now.join(first, "b").where("a <> first").select(F.col("first").alias("a"), F.col("a").alias("b"))
        fewer = stored(first.select(F.col("first").alias("a"), "b").unionByName(moved).distinct(), f"{label}-fewer")
        left = fewer.count()
        if left >= n:
            return now
        if left > 0.9 * n:
            return fewer
        now, n = fewer, left


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``: root is the smallest node that can be reached.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, so a chain
    of n links needs about log n rounds. Every round is stored, so that a lost executor costs one round. Links are
    thinned first, as every round reads them all. Links to NULL are ignored; an empty table gives an empty result.
    """
    both = stored(
        thinned(links, f"{label}-thinned")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
        .select("x.a", "x.b").distinct(), f"{label}-links",
    )
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                    .select("node", F.least("node", "m").alias("root")), f"{label}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels, both.b == labels.node).groupBy(both.a.alias("node")).agg(F.min("root").alias("near"))
        hooked = stored(labels.join(near, "node").select(
            "node", F.least("root", "near").alias("root"), F.col("root").alias("old")), f"{label}-hook-{step}")
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("further"))
        labels = stored(hooked.join(jump, "root").select(
            "node", F.least("root", "further").alias("root"), "old"), f"{label}-{step}")
        if labels.where("root <> old").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
