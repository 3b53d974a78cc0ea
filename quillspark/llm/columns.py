"""Column helpers the operators share."""

from pyspark.sql import functions as F

# The white space and the words of the contracts, as Java patterns.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(name="text"):
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def packed(docs):
    """All columns of `docs` in one struct `row`, so that names of its columns cannot clash with ours."""
    return docs.select(row_of(docs.columns))


def row_of(names):
    return F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")


def unpacked(rows, names):
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in names))


def without(docs, losers, repeats):
    """`docs` without the rows that `losers` name, and with one row for each key in `repeats`.

    Both tables have (id, mark): a doc_id, null included, and the xxhash64 of a text.
    """
    rows = docs.select(row_of(docs.columns), F.col("doc_id").alias("doc_id"), F.xxhash64(whole_text()).alias("mark"))
    keys = losers.select("id", F.col("mark").alias("m")).unionByName(repeats.select("id", F.col("mark").alias("m")))

    def same(other):
        return rows["doc_id"].eqNullSafe(other["id"]) & (rows["mark"] == other["m"])

    once = rows.join(keys, same(keys), "left_anti").select("row")
    again = repeats.select("id", F.col("mark").alias("m"))
    again = rows.join(again, same(again), "left_semi").groupBy("doc_id", "mark").agg(F.first("row").alias("row"))
    return unpacked(once.unionByName(again.select("row")), docs.columns)
