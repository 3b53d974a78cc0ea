"""Classes of linked rows by contraction: each round, every node moves to its smallest neighbour's smallest neighbour.

The nodes that are left are linked anew. A component's smallest node never moves, and each round at least halves the nodes that have links, so
their number of rounds grows with the logarithm of the component. Each round is a written table, which cuts lineage durably; nothing is gathered
per component.
"""

from pyspark.sql import functions as F

from quillspark.session import written


def classes(links):
    """(node, root) of every node that the links (a, b) name; root is the smallest node of its component."""
    links = written(links.select("a", "b").where("a != b").distinct(), "links")
    members = None
    while True:
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        up = written(up.select("node", F.least("node", "up").alias("up")), "up")
        # every parent has links itself, so it has a parent too
        twice = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", F.col("top").alias("root"))
        twice = written(twice, "roots")
        if members is None:
            members = twice
        else:
            moved = twice.select(F.col("node").alias("root"), F.col("root").alias("__to"))
            members = members.join(moved, "root", "left").select("node", F.coalesce("__to", "root").alias("root"))
            members = written(members, "members")
        a, b = (twice.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        rest = links.join(a, "a").join(b, "b").where("ra != rb")
        rest = rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        links = written(rest, "links")
        if links.isEmpty():
            return members
