"""Connected components of a table of links by alternating star contraction, each round written to the shared folder."""

from pyspark.sql import functions as F

from quillspark.session import written


def _large_star(links):
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links):
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b")))


def components(links):
    """(node, root) for every node of the links (a, b) that is not the least of its component: root is the least."""
    links, seen = written(links.select("a", "b").where("a != b").distinct(), "links"), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if state == seen or not state[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        links = written(_small_star(_large_star(links)).distinct(), "links")
