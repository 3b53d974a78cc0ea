"""Packing token ids into sequences by best-fit decreasing.

A document is first cut into full windows; each is a sequence of its own. What is left of each document (less than a
window) is packed: pieces by falling length, each into the open window with the least remaining capacity that holds it, found by a
segment tree over the remaining capacities. Rows are small here (no texts): pieces are dealt by a hash into groups of about
`GROUP` pieces, and each task packs one group on its own, so memory has a bound and a group leaves a few open windows.

Defined results: a null or empty text is its end id alone. Rows with equal ids, or repeated ones, are separate documents. A text of any
length is cut as above. An empty table gives no pieces. Other columns are not read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import functions as F

from quillspark.llm import arrays, tokens
from quillspark.llm.columns import whole_text
from quillspark.session import written

WINDOW = 1024
GROUP = 50_000
MOST_PIECES = 500_000  # of text, remembered by a worker
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, place bigint"
PACKED = PIECES + ", sequence_id bigint, offset bigint"


class OpenWindows:
    """Open windows by remaining capacity: a segment tree tells which capacities have any."""

    def __init__(self, window):
        self.size = 1 << window.bit_length()
        self.any = [0] * (2 * self.size)
        self.at = [[] for _ in range(self.size)]

    def put(self, capacity, name):
        self.at[capacity].append(name)
        self._count(capacity, 1)

    def _count(self, capacity, by):
        i = capacity + self.size
        while i:
            self.any[i] += by
            i >>= 1

    def tightest(self, length):
        """Take the window with the least capacity of at least `length`: (capacity, name), or None."""
        i = length + self.size
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        capacity = i - self.size
        self._count(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit(lengths, window=WINDOW):
    """Window number and offset of each piece; lengths must fall."""
    tree, windows, used = OpenWindows(window), [], 0
    offsets = []
    for length in lengths:
        found = tree.tightest(length)
        if found is None:
            found, used = (window, used), used + 1
        capacity, name = found
        windows.append(name)
        offsets.append(window - capacity)
        if capacity > length:
            tree.put(capacity - length, name)
    return windows, offsets


def _cut(path, end_id, window, most_pieces):
    def run(batches):
        encoder, place = tokens.encoder(path, True, most_pieces), TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in arrays.slices(batch):
                ids, bounds = encoder.encode(some.column(1).to_pylist(), end_id)
                raw, sizes = ids.astype("<u4").tobytes(), np.diff(bounds)
                counts = -(-sizes // window)
                doc = np.repeat(np.arange(len(sizes)), counts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)) * window
                length = np.minimum(sizes[doc] - start, window)
                first = bounds[:-1][doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(doc)), *map(pa.array, (start, length, np.array(crc, np.int64), sizes[doc], place + np.arange(len(doc))))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"],
                )
                place += len(doc)

    return run


def _packed(window):
    def run(batches):
        table = pa.Table.from_batches(list(batches))  # one group: about GROUP small rows
        if table.num_rows:
            windows, offsets = best_fit(table.column("length").to_pylist(), window)
            base = TaskContext.get().partitionId() << 32
            table = table.append_column("sequence_id", pa.array(2 * (base + np.array(windows, np.int64)) + 1))
            table = table.append_column("offset", pa.array(np.array(offsets, np.int64)))
            yield from table.to_batches()

    return run


def pieces(docs, path, end_id, window=WINDOW, most_pieces=MOST_PIECES):
    """Full windows and the rest of each document: doc_id, start, length, ids_crc32, doc_tokens, place (a number of its own)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(_cut(path, end_id, window, most_pieces), PIECES)


def pack(docs, path, end_id, window=WINDOW, group=GROUP, most_pieces=MOST_PIECES):
    """All pieces with sequence_id and offset. `most_pieces` bounds what a worker remembers of the tokenizer's answers. Sequence ids are even for full windows, odd for packed ones."""
    cut = written(pieces(docs, path, end_id, window, most_pieces), "pieces")
    short = cut.where(F.col("length") < window)
    groups = short.count() // group + 1
    short = short.repartition(groups, "place").sortWithinPartitions(F.desc("length"), "place")
    full = cut.where(F.col("length") == window).select("*", (F.col("place") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(short.mapInArrow(_packed(window), PACKED)).drop("place")
