"""Connected components of links between long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webfrontier.llm.common import written


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.

    Every round hooks each component to its smallest neighbour, follows the hooks to their end, and contracts the
    links to the new components. A component that isn't its neighbourhood's smallest is gone after
    a round, so their number falls at least by half and there are as many rounds as its logarithm. The only thing a round
    groups is its links, by component; the first round's hooks are its labels. ``links`` is read twice, so it should be a written table.
    """
    pairs = links.select("a", "b").filter("a != b")
    pairs, labels = pairs.union(pairs.select("b", "a")), None
    while labels is None or not pairs.isEmpty():
        hooks = pairs.groupBy(F.col("a").alias("old")).agg(F.min("b").alias("_low"))
        hooks = written(hooks.select("old", F.least("old", "_low").alias("new")), "hooks")
        moved = 1
        while moved:
            above = hooks.select(F.col("old").alias("new"), F.col("new").alias("_up"))
            jumped = hooks.join(above, "new", "left").select("old", "new", F.coalesce("_up", "new").alias("_to"))
            jumped = written(jumped, "hooks")
            moved = jumped.filter("_to != new").count()
            hooks = jumped.select("old", F.col("_to").alias("new"))
        if labels is None:
            labels = hooks.select(F.col("old").alias("node"), F.col("new").alias("component"))
        else:
            labels = labels.join(hooks.withColumnRenamed("old", "component"), "component", "left")
            labels = written(labels.select("node", F.coalesce("new", "component").alias("component")), "labels")
        left = hooks.select(F.col("old").alias("a"), F.col("new").alias("_a"))
        right = hooks.select(F.col("old").alias("b"), F.col("new").alias("_b"))
        pairs = pairs.join(left, "a").join(right, "b").filter("_a != _b")
        pairs = written(pairs.select(F.col("_a").alias("a"), F.col("_b").alias("b")), "links")
    return labels
