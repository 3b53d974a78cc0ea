"""Verified near duplicates: classes of texts whose shingle sets have a Jaccard likeness of a threshold or more, inside each split.

MinHash bands only propose; each link is decided on the sets themselves. No group lists its pairs:
* equal sets are one node, so a text that a third of all rows repeat is compared once;
* in a group of one band key, each node is first held against one leader, and what links becomes one class;
* afterwards only nodes of different classes that share a key are compared. A pair of one class is never listed.
Sizes rule out pairs before any set moves. The cut into bands is chosen so that a pair right at the threshold is missed
with a probability of at most `most_missed`; a class is whole unless such a pair was its only bridge.

A null or empty text is one empty shingle, as for `dedup.shingle_rows`: all such rows of a split are one class. Rows that repeat
a key are members as often as they are there. An empty table gives an empty result.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark import fixed
from quillspark.functions.text import bind
from quillspark.operators.dedup import signature_minima
from quillspark.operators.links import classes
from quillspark.operators.registry import KEY
from quillspark.session import written

PERCENT = 90
MOST_MISSED = 1e-6
SLOTS = 1 << 20


def shingle_sets(text, width=3):
    """Sorted distinct 64-bit hashes of a text's runs of `width` words; a shorter text is one run."""

    def of(words):
        count = F.size(words) - (width - 1)
        runs = F.arrays_zip(*[F.slice(words, i + 1, F.greatest(count, F.lit(0))).alias(f"w{i}") for i in range(width)])
        hashed = F.transform(runs, lambda r: F.xxhash64(F.concat_ws(" ", *[r.getField(f"w{i}") for i in range(width)])))
        return F.when(count < 1, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(hashed)

    return F.sort_array(F.array_distinct(bind(F.split(F.coalesce(text, F.lit("")), " "), of)))


def surest_cut(percent, most_missed=MOST_MISSED, count=fixed.NUM_PERM):
    """(bands, rows): the longest rows, so the fewest proposals, that miss a pair at the threshold with at most this probability."""
    sure = [(count // r, r) for r in range(1, count + 1) if (1 - (percent / 100) ** r) ** (count // r) <= most_missed]
    return max(sure, key=lambda cut: cut[1], default=(count, 1))


def band_areas(thresholds, count=fixed.NUM_PERM, steps=1000):
    """For each row (threshold, false_weight, miss_weight) and each cut of a signature: the areas of error under 1 - (1 - s^rows)^bands.

    false_area is the chance to propose, summed over likenesses s below the threshold, miss_area the chance not to, over those above, both by the
    midpoint rule; cost weighs them, and `chosen` marks the cheapest cut of its row, longer rows on a tie.
    """
    cuts = thresholds.withColumn("rows", F.explode(F.sequence(F.lit(1), F.lit(count))))
    cuts = cuts.withColumn("bands", F.floor(F.lit(count) / F.col("rows")).cast("int"))

    def area(inside, chance):
        def add(total, i):
            s = (i + 0.5) / steps
            proposed = 1 - F.pow(1 - F.pow(s, F.col("rows")), F.col("bands"))
            return total + F.when(inside(s), chance(proposed)).otherwise(0.0)

        return F.round(F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0.0), add) / steps, 6)

    cuts = cuts.withColumn("false_area", area(lambda s: s < F.col("threshold"), lambda p: p))
    cuts = cuts.withColumn("miss_area", area(lambda s: s >= F.col("threshold"), lambda p: 1 - p))
    cuts = cuts.withColumn("cost", F.round(F.col("false_weight") * F.col("false_area") + F.col("miss_weight") * F.col("miss_area"), 6))
    place = Window.partitionBy(*thresholds.columns).orderBy("cost", F.desc("rows"))  # `count` rows each
    return cuts.withColumn("chosen", F.row_number().over(place) == 1)


def _linked(pairs, nodes, percent):
    """The pairs (a, b) whose sets are alike. At most SLOTS numbers are sent to all tasks; where all are, more sets move, and no link is lost."""
    pairs = written(pairs, "near-pairs")
    slot = F.pmod(F.xxhash64("node"), F.lit(SLOTS))
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).select(slot.alias("slot")).distinct()
    asked = F.broadcast(written(asked, "asked"))
    nodes = nodes.select("node", "grams", slot.alias("slot")).join(asked, "slot", "left_semi")  # sets without a pair stay where they are
    a, b = (nodes.select(F.col("node").alias(c), F.col("grams").alias(f"of_{c}")) for c in "ab")
    common = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - common
    return written(pairs.join(a, "a").join(b, "b").where(common * 100 >= either * percent).select("a", "b"), "near-links")


def similar_nodes(nodes, percent=PERCENT, cut=None):
    """(node, root) of the nodes (node, split, n, grams) that link with another; sets must differ."""
    bands, rows = cut or surest_cut(percent)
    hashed = nodes.select("node", "split", "n", F.explode("grams").alias("g"))
    hashed = hashed.select("node", "split", "n", F.col("g").bitwiseAND(F.lit(0xFFFFFFFF)).alias("__x"))
    signed = signature_minima(hashed, ["node", "split", "n"], bands * rows)
    band = F.array(*[F.xxhash64(F.lit(b), F.slice("minhash", b * rows + 1, rows)) for b in range(bands)])
    keys = written(signed.select("node", "split", "n", F.explode(band).alias("key")), "band-keys")
    shared = keys.groupBy("split", "key").agg(F.min("node").alias("leader"), F.max("node").alias("__last"))
    shared = shared.where("leader != __last").drop("__last")
    keys = written(keys.join(shared, ["split", "key"]), "shared-keys")

    def fits(n, m):
        return F.least(n, m) * 100 >= F.greatest(n, m) * percent

    leaders = nodes.select(F.col("node").alias("leader"), F.col("n").alias("m"))
    first = keys.where("node != leader").select("leader", "node", "n").distinct().join(leaders, "leader")
    first = _linked(first.where(fits(F.col("n"), F.col("m"))).select(F.col("leader").alias("a"), F.col("node").alias("b")), nodes, percent)

    rooted = keys.join(classes(first), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted.select("split", "key", "node", "n", "root"), "rooted-keys")
    several = rooted.groupBy("split", "key").agg(F.min("root").alias("__low"), F.max("root").alias("__high"))
    rooted = rooted.join(several.where("__low != __high").select("split", "key"), ["split", "key"], "left_semi")
    x, y = rooted.alias("x"), rooted.alias("y")
    apart = (F.col("x.root") != F.col("y.root")) & (F.col("x.node") < F.col("y.node")) & fits(F.col("x.n"), F.col("y.n"))
    pairs = x.join(y, (F.col("x.split") == F.col("y.split")) & (F.col("x.key") == F.col("y.key")) & apart)
    rest = _linked(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), nodes, percent)
    return classes(first.unionByName(rest))


def near_classes(df, text, percent=PERCENT, width=3, cut=None):
    """img_path, split, n_shingles, class_path (the smallest path of its class) and class_size of every row."""
    grams = shingle_sets(text, width)
    rows = df.select(*KEY, F.monotonically_increasing_id().alias("id"), grams.alias("grams"))
    name = F.md5(F.array_join(F.col("grams").cast("array<string>"), ","))
    split = F.coalesce(F.col("split"), F.lit("\x00"))  # rows without a split are a split of their own
    rows = written(rows.withColumns({"n": F.size("grams"), "set": name, "part": split}), "shingle-sets")  # ids hold from here on
    first = written(rows.groupBy("part", "set").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies")), "sets")
    copied = written(first.where("copies > 1").select("part", "set", "node"), "copied")  # few groups: the sets need not move
    nodes = rows.join(copied, ["part", "set"], "left").where(F.col("node").isNull() | (F.col("node") == F.col("id")))
    nodes = written(nodes.select(F.col("id").alias("node"), F.col("part").alias("split"), "n", "grams"), "nodes")
    roots = first.join(similar_nodes(nodes, percent, cut), "node", "left").select("part", "set", F.coalesce("root", "node").alias("root"))
    placed = written(rows.select(*KEY, "n", "part", "set").join(roots, ["part", "set"]).select(*KEY, "n", "root"), "placed")
    about = placed.groupBy("root").agg(F.min("img_path").alias("class_path"), F.count(F.lit(1)).alias("class_size"))
    return placed.join(about, "root").select(*KEY, F.col("n").alias("n_shingles"), "class_path", "class_size")


def drop_near(df, text, percent=PERCENT, width=3):
    """The rows that stand for their class: of near duplicates in a split the one with the smallest path stays."""
    rows = near_classes(df, text, percent, width)
    gone = rows.where(~F.col("img_path").eqNullSafe(F.col("class_path"))).select(F.col("img_path").alias("__p"), F.col("split").alias("__s"))
    same = df["img_path"].eqNullSafe(gone["__p"]) & df["split"].eqNullSafe(gone["__s"])
    return df.join(gone.distinct(), same, "left_anti")

