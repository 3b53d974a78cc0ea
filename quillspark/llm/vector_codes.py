"""Vector code compression by product codebooks with equal-average search.

A vector is cut into parts; each part position has a codebook, and a part is coded by the index of its nearest entry. Entries are sorted by
the sum of their components. The search for a part starts at its own sum and goes outward, always to the side with the smaller gap: by
Cauchy's inequality (sum gap)^2 / dimension is at most the squared distance, so it ends when that bound strictly exceeds the best distance
found; an equal bound goes on, for an entry of lower index may tie. All rows of a batch take a step together, and rows that are done
leave. Distances are whole numbers of 64 bits.

Spark scans the vectors once a round; a task sends one row per entry that it used (count and component sums), the driver
gets one row per entry. Only the codebooks travel: entries x dimension numbers, whatever the number of vectors.

Defined results: a null vector, or one with a null or non-finite component, is dropped; so is one whose length is not the common length (the most
frequent among lengths that the number of parts divides, the longer on a tie). Rows with equal ids, or repeated ones, are coded each; without an id a row
is ordered last. Equal parts have equal codes; equal entries lose to the lower index. With fewer vectors than entries the codebooks are that
much shorter. An empty table, or one without a vector that can be kept, gives an empty result. Columns other than the id, the vector and the label are not read.
A component too large for exact distances raises an error.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import vectors
from quillspark.session import written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
_NONE = 1 << 31  # a gap beyond all others


class Codebooks:
    """Entries of all part positions: a matrix of part x entry x place."""

    def __init__(self, entries):
        self.entries = np.ascontiguousarray(entries, np.int64)

    def digest(self):
        """SHA-256 of all components by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def nearest(self, part, rows):
        return nearest(rows, self.entries[part])

    def decoded(self, codes):
        """The vectors that codes (rows x parts) stand for."""
        return np.concatenate([self.entries[p][codes[:, p]] for p in range(len(self.entries))], axis=1)


def nearest(rows, entries):
    """Index of and squared distance to the nearest entry of each row, ties to the lower index: equal-average search."""
    order = np.argsort(entries.sum(axis=1), kind="stable")
    book, sums = entries[order], entries.sum(axis=1)[order]
    n, width, last = len(rows), entries.shape[1], len(entries)
    best, at = np.full(n, np.iinfo(np.int64).max // max(width, 1)), np.full(n, last)
    open_, own = np.arange(n), rows.sum(axis=1)
    right = np.searchsorted(sums, own)
    left = right - 1
    while len(open_):
        below = np.where(left >= 0, own - sums[np.maximum(left, 0)], _NONE)
        above = np.where(right < last, sums[np.minimum(right, last - 1)] - own, _NONE)
        gap, down = np.minimum(below, above), below <= above
        going = (gap < _NONE) & (gap * gap <= best[open_] * width)
        if not going.all():
            open_, own, left, right, down = (x[going] for x in (open_, own, left, right, down))
            if not len(open_):
                break
        tried = np.where(down, left, right)
        apart = rows[open_] - book[tried]
        distance, index = np.einsum("ij,ij->i", apart, apart), order[tried]
        better = (distance < best[open_]) | ((distance == best[open_]) & (index < at[open_]))
        best[open_[better]], at[open_[better]] = distance[better], index[better]
        left, right = left - down, right + ~down
    return at, best


def whole_vectors(table, parts=PARTS, scale=SCALE, vector="embedding"):
    """vec_id, label, v of the rows that are kept; v holds floor(scale * component)."""
    x = F.col(vector).cast("array<double>")
    rows = table.select(F.col("vec_id"), F.col("label"), x.alias("x")).where(vectors.finite(F.col("x")))
    lengths = rows.where((F.size("x") > 0) & (F.size("x") % parts == 0)).groupBy(F.size("x").alias("length")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    if common is None:
        return written(rows.where("false").select("vec_id", "label", F.lit(None).cast("array<bigint>").alias("v")), "vectors"), 0
    width = common.length // parts
    kept = rows.where(F.size("x") == common.length).select("vec_id", "label", vectors.floors(F.col("x"), scale, (1 << 30) // width).alias("v"))
    return written(kept, "vectors"), width


def _usage(shared):
    """Per task: count and component sums of every entry that it used."""

    def run(batches):
        books = shared.value
        parts, size, width = books.entries.shape
        counts, sums = np.zeros((parts, size), np.int64), np.zeros((parts, size, width), np.int64)
        for batch in batches:
            whole = vectors.matrix(batch.column(0))
            for p in range(parts if len(whole) else 0):
                rows = np.ascontiguousarray(whole[:, p * width : (p + 1) * width])
                at, _ = books.nearest(p, rows)
                order = np.argsort(at, kind="stable")
                used, first = np.unique(at[order], return_index=True)
                counts[p] += np.bincount(at, minlength=size)
                sums[p, used] += np.add.reduceat(rows[order], first)
        used = np.flatnonzero(counts)
        flat = pa.array(sums.reshape(-1, width)[used].ravel())
        total = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * np.int32(width)), flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts.ravel()[used]), total], names=["at", "n", "sums"])

    return run


def codebooks(kept, width, parts=PARTS, entries=ENTRIES, rounds=ROUNDS):
    """The codebooks after all rounds. They start as the parts of the vectors with the smallest ids."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()  # `entries` rows at most
    start = np.array([r.v for r in first], np.int64).reshape(len(first), parts, width)
    books = Codebooks(start.transpose(1, 0, 2))
    for _ in range(rounds):
        shared = kept.sparkSession.sparkContext.broadcast(books)
        used = kept.select("v").mapInArrow(_usage(shared), "at bigint, n bigint, sums array<bigint>")
        total = used.groupBy("at").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums"))
        flat = vectors.floor_means(total.collect(), "sums", books.entries.reshape(-1, width))  # a row per entry at most
        books = Codebooks(flat.reshape(books.entries.shape))
        shared.unpersist()
    return books


def _coded(shared):
    def run(batches):
        books = shared.value
        parts, _, width = books.entries.shape
        for batch in batches:
            whole = vectors.matrix(batch.column(2))
            codes, error = np.zeros((len(whole), parts), np.uint8), np.zeros(len(whole), np.int64)
            for p in range(parts if len(whole) else 0):
                codes[:, p], apart = books.nearest(p, np.ascontiguousarray(whole[:, p * width : (p + 1) * width]))
                error += apart
            text = codes.tobytes().hex()
            text = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def encoded(kept, books):
    """vec_id, label, code (two hexadecimal digits a part) and error (squared distance to what the code stands for)."""
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema}
    shared = kept.sparkSession.sparkContext.broadcast(books)
    return kept.select("vec_id", "label", "v").mapInArrow(_coded(shared), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint")


def compressed(table, parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE, vector="embedding"):
    """vec_id, code, error, label_error (over all rows with the same label, null being one) and codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part")
    kept, width = whole_vectors(table, parts, scale, vector)
    if not width:
        return kept.select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("bigint").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256"))
    books = codebooks(kept, width, parts, entries, rounds)
    rows = written(encoded(kept, books), "codes")
    # a task sends one row per label; a hot label is one row there, and its side of the join is split by AQE
    sums = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    rows = rows.join(sums, rows["label"].eqNullSafe(sums["of"]))
    return rows.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
