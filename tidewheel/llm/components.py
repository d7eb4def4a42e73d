"""Connected components by contraction, in DataFrame operations.

Each round gives every node the smallest of itself and its neighbours as its parent, follows parents twice, and
replaces the ends of each link by their parents. Links within a component vanish, so a star or a clique is gone
after a round. Rounds are written to the shared folder, so a lost executor costs the running round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """links: a, b long. Returns node, root for every node of a link; root is the smallest node of its component."""
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "links")
    found = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("parent")), "parents")
        for _ in range(2):
            up = parent.select(F.col("node").alias("__n"), F.col("parent").alias("__p"))
            parent = parent.join(up, F.col("parent") == F.col("__n")).select("node", F.col("__p").alias("parent"))
        parent = written(parent, "parents")
        if found is None:
            found = parent.select("node", F.col("parent").alias("root"))
        else:
            up = parent.select(F.col("node").alias("root"), "parent")
            found = written(found.join(up, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "roots")
        ends = links
        for c in ("a", "b"):
            ends = ends.join(parent.select(F.col("node").alias(c), F.col("parent").alias(f"__{c}")), c)
        ends = ends.select(F.col("__a").alias("a"), F.col("__b").alias("b")).where("a != b")
        links = written(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found
