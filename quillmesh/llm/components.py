"""Connected components of a table of links, by hooking to the smallest neighbour and pointer doubling, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long); root is the smallest node of the component.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends by doubling, and contracts the
    links, so the number of rounds grows with the logarithm of a component's size. Tables are written between rounds.
    """
    edges = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    whole = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "cc-hooks")
        while True:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
            further = written(hook.join(up, "root").select("node", F.col("top").alias("root"), (F.col("top") < F.col("root")).alias("moved")), "cc-hooks")
            hook = further.select("node", "root")
            if further.filter("moved").isEmpty():
                break
        if whole is None:
            whole = hook
        else:
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("top"))
            whole = written(whole.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "cc-roots")
        edges = edges.join(hook.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(hook.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = written(edges.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
    return whole if whole is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
