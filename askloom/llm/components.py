"""Connected components of a link table by label spreading and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node can reach. ``links`` has (a, b).

    Each round takes the smallest label among a node's neighbours and then the label of its label,
    so paths shorten by at least half a round. Only three numbers per round reach the driver.
    Every round is a written table; the superseded one is deleted. Joins stand between written
    tables, so a node with a large share of the links is split by the adaptive skew join.
    """
    both = written(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        "links",
    )
    labels = written(
        both.groupBy("a").agg(F.min("b").alias("b")).select(
            F.col("a").alias("node"), F.least("a", "b").alias("label")
        ),
        "labels",
    )
    total = lambda df: df.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
    now = total(labels)
    while now is not None:
        spread = written(
            both.join(labels, F.col("b") == F.col("node"))
            .select(F.col("a").alias("node"), "label")
            .union(labels)
            .groupBy("node")
            .agg(F.min("label").alias("label")),
            "spread",
        )
        up = spread.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = written(
            spread.join(up, "label").select("node", F.least("label", "further").alias("label")), "labels"
        )
        discard(spread, labels)
        labels, before, now = jumped, now, total(jumped)
        if now == before:
            break
    discard(both)
    return labels
