"""Duplicate removal inside each split, by equal fingerprints or by MinHash bands.

Nothing here builds pairs. A row is kept when its group has one member, and the group's size comes
from a partial aggregate: a fingerprint shared by a third of all rows costs one counter per task.
"""

from pyspark.sql import functions as F

from quillspark import fixed
from quillspark.functions.hashing import hash32, permutation_seeds
from quillspark.operators.registry import KEY
from quillspark.session import written

PRIME = 2147483647


def group_sizes(df, fingerprint):
    return df.groupBy("split", fingerprint).agg(F.count(F.lit(1)).alias("n_members"))


def drop_equal(df, fingerprint, policy="drop_all"):
    """Drop rows that share a fingerprint inside their split.

    "drop_all" removes every member of such a group, "keep_first" all but the smallest path. A row
    without a fingerprint is like no other and stays.
    """
    own = F.concat(F.lit("none:"), F.col("img_path"))
    rows = df.withColumn("__fp", F.coalesce(F.col(fingerprint).cast("string"), own, F.lit("none")))
    # groups with copies are few: that side is small, and the rows need not move
    copied = rows.groupBy(F.col("split").alias("__split"), F.col("__fp").alias("__of")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("img_path").alias("__first")
    ).where(F.col("__n") > 1)
    same = rows["split"].eqNullSafe(copied["__split"]) & (rows["__fp"] == copied["__of"])
    if policy == "keep_first":
        same &= ~rows["img_path"].eqNullSafe(copied["__first"])
    elif policy != "drop_all":
        raise ValueError(f"unknown policy {policy!r}")
    return rows.join(copied, same, "left_anti").select(*df.columns)


def shingle_rows(df, keys, text, width=3):
    """One row per run of `width` words, repeats included; a shorter text is one shingle.

    Texts are cut by array slices and exploded, so hashing runs in generated code.
    """
    words = df.select(*keys, F.split(F.coalesce(text, F.lit("")), " ").alias("__w"))
    count = F.size("__w") - (width - 1)
    names = [f"w{i}" for i in range(width)]
    runs = F.arrays_zip(*[F.slice("__w", i + 1, count).alias(n) for i, n in enumerate(names)])
    nothing = F.lit(None).cast("string")
    whole = F.struct(F.array_join("__w", " ").alias("w0"), *[nothing.alias(n) for n in names[1:]])
    each = words.select(*keys, F.explode(F.when(count < 1, F.array(whole)).otherwise(runs)).alias("__r"))
    return each.select(*keys, F.concat_ws(" ", *[F.col("__r").getField(n) for n in names]).alias("shingle"))


def minhash_signatures(df, text, keys=KEY, count=fixed.NUM_PERM, hasher=hash32):
    """The smallest value of each of `count` linear hashes over the text's shingles.

    The minima are plain aggregates: each task sends one row per text, not one per shingle.
    `hasher` maps a string column to a bigint below 2**32.
    """
    hashed = shingle_rows(df, keys, text).select(*keys, hasher(F.col("shingle")).alias("__x"))
    return signature_minima(hashed, keys, count)


def signature_minima(hashed, keys, count=fixed.NUM_PERM):
    """`minhash` per key from rows of 32-bit hashes `__x`."""
    seeds = permutation_seeds(count, PRIME)
    minima = hashed.groupBy(*keys).agg(
        *[F.min((F.col("__x") * a + b) % PRIME).alias(f"__m{i}") for i, (a, b) in enumerate(seeds)]
    )
    return minima.select(*keys, F.array(*[f"__m{i}" for i in range(count)]).alias("minhash"))


def quick_hash(text):
    """A cheaper `hasher` than the MD5 one, for when no other engine must agree."""
    return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))


def band_rows(signatures, bands=fixed.LSH_BANDS, rows=fixed.LSH_ROWS):
    """One key per band of each signature: rows with equal keys are candidates for each other."""

    def key(b):
        return F.md5(F.concat_ws(",", F.slice("minhash", b * rows + 1, rows).cast("array<string>")))

    return signatures.select(*KEY, F.posexplode(F.array(*[key(b) for b in range(bands)])).alias("band", "band_key"))


def bands_for(threshold, count=fixed.NUM_PERM):
    """(bands, rows per band) of `count` values: the cut at which a pair of this likeness shares a band about half the time.

    Among cuts whose rows divide the signature's use, the one whose (1 / bands) ** (1 / rows) is next to the threshold.
    """
    cuts = [(count // rows, rows) for rows in range(1, count + 1)]
    return min(cuts, key=lambda c: (abs((1 / c[0]) ** (1 / c[1]) - threshold), -c[1]))


def _shared_bands(signatures, bands, rows):
    """Keys of rows that share a band with another row, with the number of such bands.

    Both sides of the join need the bands: they are written, or signatures, the costly part, would be made twice.
    """
    keys = written(band_rows(signatures, bands, rows), "band-keys")
    on = ["split", "band", "band_key"]
    copied = keys.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).drop("__n")
    return keys.join(copied, on, "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).cast("int").alias("__shared"))


def near_duplicate_flags(df, signatures, bands=fixed.LSH_BANDS, rows=fixed.LSH_ROWS):
    """Per row: in how many bands another row of its split has the same key."""
    shared = _shared_bands(signatures, bands, rows)
    return df.join(shared, KEY, "left").withColumn("bands_shared", F.coalesce("__shared", F.lit(0))).drop("__shared")


def drop_near(df, signatures, bands=fixed.LSH_BANDS, rows=fixed.LSH_ROWS, threshold=None):
    """Drop every row that shares a band key with another row of its split.

    `threshold` chooses bands and rows for that likeness instead.
    """
    if threshold is not None:
        bands, rows = bands_for(threshold)
    return df.join(_shared_bands(signatures, bands, rows), KEY, "left_anti").select(*df.columns)
