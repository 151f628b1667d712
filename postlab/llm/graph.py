"""Connected components of a link table, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlab.llm.common import written

MAX_ROUNDS = 60


def _roots(parent: DataFrame) -> DataFrame:
    """Replace parents (never above their node) by the end of their chain; chains halve every round."""
    for _ in range(MAX_ROUNDS):
        up = parent.select(F.col("node").alias("mid"), F.col("root").alias("above"))
        jumped = parent.join(up, parent.root == up.mid, "left").select(
            "node", F.coalesce("above", "root").alias("root"), (F.col("above") < F.col("root")).alias("moved"))
        jumped = written(jumped, "roots")
        parent = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return parent
    raise RuntimeError("parent chains did not end")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the undirected links.

    Each round every node points at its smallest neighbour if that is smaller, chains are followed to their end, and
    the links are rewritten between the ends; at least half of the nodes that still have links vanish, so
    rounds grow with the logarithm. Neighbours are reduced by map-side minima; the joins read written tables on
    both sides, so Spark splits a node that holds many links."""
    links = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b"), "links")
    whole = None
    for _ in range(MAX_ROUNDS):
        if links.isEmpty():
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        parent = _roots(written(nearest.select("node", F.least("node", "near").alias("root")), "parents"))
        if whole is None:
            whole = parent
        else:
            up = parent.select(F.col("node").alias("mid"), F.col("root").alias("above"))
            whole = written(whole.join(up, whole.root == up.mid, "left").select("node", F.coalesce("above", "root").alias("root")), "components")
        pa, pb = parent.toDF("na", "ra"), parent.toDF("nb", "rb")
        moved = written(links.join(pa, F.col("a") == F.col("na")).select("ra", "b"), "links-a")
        moved = moved.join(pb, F.col("b") == F.col("nb")).select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        links = written(moved.filter("a <> b").distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    if whole is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return whole
