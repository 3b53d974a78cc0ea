"""Centroid clustering over subvector dictionaries.

Vectors are cut into blocks of `BLOCK` dimensions. A chunk of at most `CHUNK` vectors keeps, for each block, a dictionary of its distinct subvectors and one code
per vector: nothing is lost, and the chunk is written once. In a round a task computes the exact distances of a chunk's subvectors to
that block of every centroid once, and a vector's distance is the sum of what its codes look up. Sums for the new centroids come from counts of
codes per cluster in the same way. Dictionaries belong to chunks because one over all vectors would grow with them, and
would have to be joined to every vector in every round; a chunk's has a bound and needs no shuffle.

A task sends one row per centroid and round; centroids are all that reaches the driver and that is broadcast (`k` x dimension numbers).

Defined results: a null vector, one of another length or with a null or non-finite component is dropped. Rows with equal ids, or repeated ones, are
clustered each; rows without an id start no centroid as long as others can. Ties go to the smaller number; an empty cluster keeps its centroid. With fewer vectors than `k` there are
that many centroids. An empty table gives an empty result. Columns other than the id and the vector are not read. A component too large for exact distances
raises an error.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import vectors
from quillspark.session import written

K = 40
ROUNDS = 5
SCALE = 256
DIMENSIONS = 64
BLOCK = 2
CHUNK = 8192
_CHUNKS = "ids array<bigint>, sizes array<int>, entries array<int>, codes array<int>"


def encode(rows, block=BLOCK):
    """Per block of dimensions: its distinct subvectors and the code of each row."""
    out = []
    for at in range(0, rows.shape[1], block):
        part = rows[:, at : at + block]
        order = np.lexsort(part.T[::-1])
        new = np.ones(len(part), bool)
        new[1:] = (part[order[1:]] != part[order[:-1]]).any(axis=1)
        codes = np.empty(len(part), np.int64)
        codes[order] = np.cumsum(new) - 1
        out.append((part[order[new]], codes))
    return out


def decode(blocks):
    """The rows again."""
    return np.concatenate([entries[codes] for entries, codes in blocks], axis=1)


def nearest(blocks, centroids):
    """Number of and squared distance to the nearest centroid of each row, ties to the smaller number."""
    total, at = np.zeros((len(blocks[0][1]), len(centroids)), np.int64), 0
    for entries, codes in blocks:
        width = entries.shape[1]
        apart = entries[:, None, :] - centroids[None, :, at : at + width]
        total += np.einsum("ijk,ijk->ij", apart, apart)[codes]
        at += width
    best = total.argmin(axis=1)
    return best, total[np.arange(len(total)), best]


def cluster_sums(blocks, cluster, k):
    """Component sums of each cluster, by counting codes."""
    out = []
    for entries, codes in blocks:
        counts = np.bincount(cluster * len(entries) + codes, minlength=k * len(entries)).reshape(k, len(entries))
        out.append(counts @ entries)
    return np.concatenate(out, axis=1)


def _lists(values, bounds):
    return pa.ListArray.from_arrays(pa.array(np.asarray(bounds, np.int32)), values)


def _chunks(block, most):
    def one(parts):
        table = pa.Table.from_batches(parts)
        blocks = encode(vectors.matrix(table.column("v").combine_chunks()), block)
        entries = np.concatenate([e.ravel() for e, _ in blocks]).astype(np.int32)
        codes = np.concatenate([c for _, c in blocks]).astype(np.int32)
        sizes = np.array([len(e) for e, _ in blocks], np.int32)
        ids = table.column("vec_id").combine_chunks().cast(pa.int64())
        columns = [ids, pa.array(sizes), pa.array(entries), pa.array(codes)]
        return pa.RecordBatch.from_arrays([_lists(c, [0, len(c)]) for c in columns], names=["ids", "sizes", "entries", "codes"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for at in range(0, len(batch), most):
                some = batch.slice(at, most)
                if n and n + len(some) > most:
                    yield one(held)
                    held, n = [], 0
                held.append(some)
                n += len(some)
        if n:
            yield one(held)

    return run


def _read(batch, dimensions, block):
    """(ids, blocks) of each chunk of a batch."""
    widths = [min(block, dimensions - at) for at in range(0, dimensions, block)]
    for i in range(len(batch)):
        ids, sizes, entries, codes = (batch.column(c)[i].values for c in range(4))
        entries, codes, at, blocks = entries.to_numpy().astype(np.int64), codes.to_numpy().reshape(len(widths), -1), 0, []
        for width, size, code in zip(widths, sizes.to_numpy().tolist(), codes):
            blocks.append((entries[at : at + width * size].reshape(size, width), code.astype(np.int64)))
            at += width * size
        yield ids, blocks


def _usage(shared, block):
    """Per task: count and component sums of every cluster."""

    def run(batches):
        centroids = shared.value
        k, dimensions = centroids.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dimensions), np.int64)
        for batch in batches:
            for _, blocks in _read(batch, dimensions, block):
                cluster, _ = nearest(blocks, centroids)
                counts += np.bincount(cluster, minlength=k)
                sums += cluster_sums(blocks, cluster, k)
        used = np.flatnonzero(counts)
        total = _lists(pa.array(sums[used].ravel()), np.arange(len(used) + 1) * dimensions)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), total], names=["at", "n", "sums"])

    return run


def _assigned(shared, block):
    def run(batches):
        centroids = shared.value
        for batch in batches:
            for ids, blocks in _read(batch, centroids.shape[1], block):
                cluster, distance = nearest(blocks, centroids)
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def whole_vectors(table, dimensions=DIMENSIONS, scale=SCALE, vector="embedding"):
    """vec_id, v of the rows that are kept; v holds floor(scale * component)."""
    x = F.col(vector).cast("array<double>")
    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x")).where(vectors.finite(F.col("x")) & (F.size("x") == dimensions))
    return rows.select("vec_id", vectors.floors(F.col("x"), scale, (1 << 30) // dimensions).alias("v"))


def first_centroids(kept, k, tag="2"):
    """The vectors with the smallest SHA-256 of tag:id, in that order."""
    order = F.sha2(F.concat(F.lit(f"{tag}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select("v", order.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()  # k rows at most
    return np.array([r.v for r in first], np.int64).reshape(len(first), -1 if first else 0)


def digest(centroid):
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def trained(chunks, centroids, rounds=ROUNDS, block=BLOCK):
    """The centroids after all rounds over a table of chunks."""
    context = chunks.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(centroids)
        used = chunks.mapInArrow(_usage(shared, block), "at bigint, n bigint, sums array<bigint>")
        total = used.groupBy("at").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(centroids.shape[1])]).alias("sums"))
        centroids = vectors.floor_means(total.collect(), "sums", centroids)  # a row per centroid at most
        shared.unpersist()
    return centroids


def clustered(table, k=K, rounds=ROUNDS, dimensions=DIMENSIONS, scale=SCALE, vector="embedding", block=BLOCK, chunk=CHUNK):
    """vec_id, cluster, distance (squared), cluster_inertia, inertia (distance summed over the cluster and over all) and centroid_sha256."""
    spark = table.sparkSession
    kept = whole_vectors(table, dimensions, scale, vector)
    chunks = written(kept.mapInArrow(_chunks(block, chunk), _CHUNKS), "chunks")
    centroids = first_centroids(kept, k)
    if len(centroids):
        centroids = trained(chunks, centroids, rounds, block)
    rows = written(chunks.mapInArrow(_assigned(spark.sparkContext.broadcast(centroids), block), "vec_id bigint, cluster int, distance bigint"), "assigned")
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row per centroid at most
    about = [(i, sums.get(i, 0), digest(c)) for i, c in enumerate(centroids)]
    about = F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia bigint, centroid_sha256 string"))
    rows = rows.join(about, "cluster")
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(sums.values())).cast("bigint").alias("inertia"), "centroid_sha256")
