"""Connected components of a graph given as a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.session import cut_lineage


def _hang(links: DataFrame, only_below: bool) -> DataFrame:
    """One round: hang every node's neighbours (or those below it) on the least of them."""
    if only_below:
        sides = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    else:
        sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # one row per node, written, so that the join below may split a node with many links
    least = cut_lineage(sides.groupBy("a").agg(F.least("a", F.min("b")).alias("least")))
    near = sides.join(least, "a")
    if only_below:
        moved = near.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    else:
        moved = near.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """The least node of each linked node's component: columns node, root.

    ``links`` has columns a, b of one orderable type. Rounds alternate between hanging all
    larger neighbours and all smaller ones on the least neighbour until the links are a
    forest of stars, which takes a number of rounds logarithmic in the nodes. Each round is
    written to the shared folder; only the count of changed links reaches the driver. No
    links give no rows; links of a node to itself and repeated links change nothing.
    """
    links = cut_lineage(links.where("a <> b").select("a", "b").distinct())
    while True:
        after = cut_lineage(_hang(cut_lineage(_hang(links, False)), True))
        same = links.count() == after.count() and after.join(
            links, ["a", "b"], "left_anti").isEmpty()
        links = after
        if same:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
