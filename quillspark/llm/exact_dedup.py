"""Exact copies by progressive refinement: length, then a hash of a prefix, then a hash of the whole text.

Two texts are equal when they are the same after deleting white space (space and U+0009 to U+000D). A row whose
(length, prefix hash) no other row has is settled without reading on; only the others are hashed in full. The two cheap
levels are one aggregate, as a group of one by length is a group of one by (length, prefix) as well. Surviving keys
reach the second scan as a bitmap of fixed size, never as a list that grows: a chance hit costs one more hash, and no
copy is missed. Texts do not enter a shuffle in `copy_groups`.

Defined results: a null text counts as empty, and all empty texts are one group. Of equal texts the row with the most
code points in the original stays, then the smallest doc_id, null last. Rows that agree in all of these are repeats of
one row: exactly one of them stays. An empty table gives an empty result. Other columns are not read.
"""

from pyspark.sql import functions as F

from quillspark.llm.columns import SPACES, packed, unpacked, whole_text
from quillspark.session import written

PREFIX_CHARS = 64
SIEVE_BITS = 1 << 24
_SLOT = 32768  # bits in one of Spark's bitmaps


def _normal():
    return F.regexp_replace(whole_text(), SPACES, "")


def _cheap_key(normal):
    return F.xxhash64(F.length(normal), F.xxhash64(F.substring(normal, 1, PREFIX_CHARS)))


def _slot(key, bits):
    return F.pmod(key, F.lit(bits)).cast("long") + 1


def shared_keys(keys, bits=SIEVE_BITS):
    """Bitmap rows (slot, bits) of the values of column `key` that two or more rows have: at most `bits` / 8 bytes."""
    shared = keys.groupBy("key").count().where("count > 1").select(_slot(F.col("key"), bits).alias("at"))
    return shared.groupBy(F.bitmap_bucket_number("at").alias("slot")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")
    )


def _marked(rows, sieve, bits):
    """Rows with `hit`: the bitmap holds their key. The bitmap has a fixed size, so it is broadcast."""
    rows = rows.withColumn("at", _slot(F.col("key"), bits)).withColumn("slot", F.bitmap_bucket_number("at"))
    byte = F.expr("cast(conv(hex(substring(bits, cast(bitmap_bit_position(at) div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.when(F.col("bits").isNull(), False).otherwise(
        F.expr("byte & shiftleft(1, cast(bitmap_bit_position(at) % 8 as int))") != 0
    )
    return (
        rows.join(F.broadcast(sieve), "slot", "left").withColumn("byte", byte).withColumn("hit", hit).drop("bits", "byte", "slot", "at")
    )


def _sized(docs, sieve, bits, digest_all):
    normal = F.col("normal")
    rows = docs.select("*", _normal().alias("normal"), F.length(whole_text()).cast("long").alias("n"))
    rows = _marked(rows.withColumn("key", _cheap_key(normal)), sieve, bits)
    full = F.sha2(normal, 256)
    return rows.withColumn("text_sha256", full if digest_all else F.when(F.col("hit"), full)).drop("normal", "key")


def _survivors(docs, bits):
    return shared_keys(docs.select(_cheap_key(_normal()).alias("key")), bits)


def _best():
    return F.struct((-F.col("n")).alias("longest"), F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"))


def copy_groups(docs, digest_all=False, bits=SIEVE_BITS):
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    The digest is null where a text was settled before its full hash, unless `digest_all`.
    """
    docs = docs.select("doc_id", "text")
    rows = written(_sized(docs, _survivors(docs, bits), bits, digest_all).drop("text"), "exact-rows")
    alone = rows.where(~F.col("hit")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    same = rows.where("hit").groupBy("text_sha256", "n", "doc_id").agg(F.count("*").alias("repeats"))
    groups = same.groupBy("text_sha256").agg(F.min(_best()).alias("best"), F.sum("repeats").alias("group_size"))
    stays = (_best() == F.col("best")) & (F.col("repeat") == 1)
    found = same.join(groups, "text_sha256").withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")))
    return alone.unionByName(
        found.select("doc_id", F.col("best.id").alias("keep_id"), "group_size", stays.alias("kept"), "text_sha256")
    )


def drop_copies(docs, bits=SIEVE_BITS):
    """The rows of `docs` that stay, with all their columns.

    Only keys that lose, or that several rows share, are joined to the texts.
    """
    names = docs.columns
    slim = docs.select("doc_id", "text")
    sieve = _survivors(slim, bits)
    rows = written(_sized(slim, sieve, bits, False).drop("text").where("hit"), "exact-survivors")
    same = rows.groupBy("text_sha256", "n", "doc_id").agg(F.count("*").alias("repeats"))
    groups = same.groupBy("text_sha256").agg(F.min(_best()).alias("best"))
    marks = same.join(groups, "text_sha256").select(
        F.col("text_sha256").alias("m_sha"), F.col("n").alias("m_n"), F.col("doc_id").alias("m_id"),
        (_best() == F.col("best")).alias("wins"), "repeats",
    )
    marks = written(marks.where("not wins or repeats > 1"), "exact-marks")
    whole = packed(docs).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    whole = _sized(whole, sieve, bits, False).drop("text")
    same_key = (
        (F.col("text_sha256") == F.col("m_sha")) & (F.col("n") == F.col("m_n")) & F.col("doc_id").eqNullSafe(F.col("m_id"))
    )
    once = whole.join(marks, same_key, "left_anti")
    repeated = whole.join(marks.where("wins"), same_key, "left_semi").groupBy("text_sha256", "n", "doc_id")
    repeated = repeated.agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    return unpacked(once.select("row").unionByName(repeated.select("row")), names)
