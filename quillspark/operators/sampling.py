"""Hash-seeded samples: repeatable, and independent of partitioning."""

from pyspark.sql import functions as F

from quillspark import fixed
from quillspark.functions import permute
from quillspark.functions.hashing import hash32, path_set_key
from quillspark.operators.ordered import first_n_per_group, hash_bucket, number_rows
from quillspark.operators.registry import KEY, class_quotas


def sample_per_split(df, sizes, seed):
    """`sizes[split]` rows of each split, without replacement, in hash order.

    The choice is made on keys alone, for any size of sample; Spark measures it and then chooses the join.
    """
    hashed = df.select(*KEY, hash32(seed, F.col("img_path")).alias("__h"))
    wanted = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("split")]
    order = [F.col("__h"), F.col("img_path")]
    chosen = first_n_per_group(hashed, ["split"], order, hash_bucket(F.col("__h")), wanted).select(*KEY)
    return df.join(chosen, KEY, "left_semi").select(*df.columns)


def sample(df, n, seed, id_column):
    """`n` rows in hash order."""
    hashed = df.withColumn("__h", hash32(seed, F.col(id_column)))
    return hashed.orderBy("__h", id_column).limit(n).drop("__h")


def numbered_pool(registry, seed, buckets=4096):
    """Scored rows numbered from 0 inside (split, class), in hash order; only keys travel."""
    scored = registry.where(F.col("score").isNotNull())
    pool = scored.select("split", "score", "img_path", hash32("pool", seed, F.col("img_path")).alias("__h"))
    order = [F.col("__h"), F.col("img_path")]
    numbered = number_rows(pool, ["split", "score"], order, hash_bucket(F.col("__h"), buckets), "position")
    return numbered.withColumn("position", F.col("position") - 1).drop("__h")


def draw_plan(registry, draws_per_split, seed, max_size=fixed.MAX_DRAW_SIZE):
    """One row per draw: how many members, and the keys of its own shuffled order of the pool."""
    quotas = class_quotas(registry, draws_per_split).where(F.col("quota") > 0)
    draws = quotas.select(
        "split",
        "score",
        F.col("n_class").alias("pool"),
        F.explode(F.sequence(F.lit(0), F.col("quota") - 1)).alias("draw"),
    )
    one = [F.lit(str(seed)), F.col("split"), F.col("score"), F.col("draw")]
    members = F.least(1 + hash32("size", *one) % max_size, F.col("pool")).alias("members")
    keys = permute.keys(lambda tag: hash32(tag, *one))
    draws = draws.select("split", "score", "draw", "pool", members, *[k.alias(name) for name, k in keys.items()])
    # few rows come out of few tasks here, and each grows into as many as it has members. Keys are made before: behind
    # the exchange they would be made again for each member
    return draws.repartition(registry.sparkSession.sparkContext.defaultParallelism, "split", "score", "draw")


def draw_members(registry, draws_per_split, seed, max_size=fixed.MAX_DRAW_SIZE):
    """The members of each draw with their ordinal: the first places of its own permutation of the pool, by one equi-join.

    Every set of a draw's size may come out, in any order; nothing is kept between members, so tasks need not know of each other.
    Spark cannot foresee how far a plan row grows, and would broadcast all members. Their number is
    bounded by draws times `max_size`, so each task hashes its part of them and streams the pool.
    """
    plan = draw_plan(registry, draws_per_split, seed, max_size)
    steps = plan.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("members") - 1)).alias("ordinal"))
    wanted = permute.permuted(steps, "ordinal", "pool", "position").select("split", "score", "draw", "ordinal", "position")
    on = ["split", "score", "position"]
    return wanted.hint("shuffle_hash").join(numbered_pool(registry, seed), on).drop("position")


def combined_samples(registry, draws_per_split, seed, max_size=fixed.MAX_DRAW_SIZE):
    """One sample per draw: labels joined in draw order, named by the set of its members.

    A group holds at most `max_size` members. Two draws of the same set share a name.
    """
    members = draw_members(registry, draws_per_split, seed, max_size)
    # labels grow far beyond the join's input here: keep all tasks, where AQE would merge them
    spark = registry.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spread = members.repartition(tasks, *KEY).hint("shuffle_hash")
    labelled = spread.join(registry.select(*KEY, "label"), KEY)
    return concatenated(labelled, ["split", "score", "draw"], "ordinal")


def concatenated(members, keys, ordinal):
    """Labels of each group in ordinal order. Groups are bounded by the draw size.

    Members are moved to their group first: collecting before the shuffle would not shrink them.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), "img_path", "label")))
    return (
        members.repartition(*keys)
        .groupBy(*keys)
        .agg(parts.alias("__m"))
        .select(
            *keys,
            F.size("__m").alias("n_members"),
            # the file lies in the folder of the first member
            F.concat(
                F.regexp_extract(F.element_at("__m", 1)["img_path"], "^(.*/)", 1),
                path_set_key(F.col("__m.img_path")),
                F.lit(".png"),
            ).alias("img_path"),
            F.array_join(F.transform("__m", lambda m: F.coalesce(m["label"], F.lit(""))), "").alias("label"),
        )
    )
