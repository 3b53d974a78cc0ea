"""One-permutation MinHash fingerprints of whole texts.

The shingles of a text (runs of five words; fewer words are one run) are hashed once. The first bits of a hash choose one of 128
bins, the rest compete for the bin's minimum. An empty bin takes the minimum of a bin that is not empty, found by its own
sequence of probes (optimal densification), the same sequence for every text. Four low-order bits of each minimum
are kept: 64 bytes a text. Two fingerprints that agree in a share m of the bins have the likeness (m - c) / (1 - c) with c = 1/16, the chance
agreement of four bits, held between 0 and 1.

For pairs of neighbours in doc_id order, texts are sorted by range and streamed: a task holds one slice and one text before it. The
last text of a range meets the first of the next in a small second step, with one row per range.

Defined results: a null or empty text, or one of white space alone, has the fingerprint "" and the likeness 1 to another such and 0 to any other.
Null ids come last; rows with equal ids are ordered by a hash of the text. A single row is its own next document. An empty table gives an
empty result. Other columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.llm import arrays
from quillspark.llm.columns import whole_text
from quillspark.session import written

BINS = 128
BITS = 4
WORDS = 5
_EMPTY = np.uint64(2**64 - 1)


def _probes(attempt, bins):
    """The bin that each empty bin asks at an attempt."""
    with np.errstate(over="ignore"):
        return (arrays.mixed(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt + 1)) % np.uint64(bins)).astype(int)


def densified(minima):
    """Rows of bin minima with empty bins filled; a row without any filled bin stays empty."""
    out, bins = minima.copy(), minima.shape[1]
    rows = np.flatnonzero((minima == _EMPTY).any(axis=1) & (minima != _EMPTY).any(axis=1))
    attempt = 0
    while len(rows):
        probes = _probes(attempt, bins) if attempt < 16 * bins else (np.arange(bins) + attempt) % bins  # at the last, in turn
        out[rows] = np.where(out[rows] == _EMPTY, minima[rows][:, probes], out[rows])
        rows = rows[(out[rows] == _EMPTY).any(axis=1)]
        attempt += 1
    return out


def sketches(column, words=WORDS, bins=BINS):
    """Densified bin minima of each text: the bin from the first bits of a hash, the minimum over the others."""
    data, offsets = arrays.text_buffer(column)
    starts, ends, bounds = arrays.words(data, offsets)
    hashes, bounds = arrays.shingles(arrays.span_hashes(arrays.prefix_sums(data), starts, ends), bounds, words)
    shift = np.uint64(bins.bit_length() - 1)
    cell = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * bins + (hashes >> (np.uint64(64) - shift)).astype(np.int64)
    minima = np.full((len(bounds) - 1) * bins, _EMPTY)
    np.minimum.at(minima, cell, (hashes << shift) >> shift)
    return densified(minima.reshape(-1, bins))


def codes(column, words=WORDS, bins=BINS, bits=BITS):
    """Low-order bits of each bin, and which texts have any."""
    minima = sketches(column, words, bins)
    return (arrays.mixed(minima) & np.uint64((1 << bits) - 1)).astype(np.uint8), minima[:, 0] != _EMPTY


def packed_bits(code, full, bits=BITS):
    """One bytes value per text; empty for a text without shingles."""
    spread = (code[:, :, None] >> np.arange(bits, dtype=np.uint8)) & 1
    rows = np.packbits(spread.reshape(len(code), code.shape[1] * bits), axis=1)
    return [r.tobytes() if f else b"" for r, f in zip(rows, full)]


def likeness(a, b, bits=BITS):
    """Corrected share of equal bins of (codes, full) pairs, row by row."""
    chance = 0.5**bits
    same = (a[0] == b[0]).mean(axis=1) if len(a[0]) else np.zeros(0)
    value = np.clip((same - chance) / (1 - chance), 0, 1)
    return np.where(a[1] & b[1], value, (a[1] == b[1]).astype(float))


def fingerprints(docs, words=WORDS, bins=BINS, bits=BITS):
    """doc_id, fingerprint (hexadecimal) of each row, without a shuffle."""

    def run(batches):
        for batch in batches:
            for some in arrays.slices(batch):
                packed = packed_bits(*codes(some.column(1), words, bins, bits), bits)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([p.hex() for p in packed], pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fingerprint string")


def edited(text, following):
    """The last half of the text (rounded down) replaced by as many code points from the start of the next."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_PAIRED = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_STREAMED = f"place int, part string, doc_id bigint, text string, {_PAIRED}"


def _pairs(texts, following, code, next_code):
    """The columns of _PAIRED for texts and the texts that follow them; codes are (codes, full)."""
    changed = [edited(a, b) for a, b in zip(texts, following)]
    changed_code = codes(pa.array(changed, pa.large_string()))
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        pa.array(packed_bits(*code), pa.binary()),
        pa.array(packed_bits(*changed_code), pa.binary()),
        pa.array(likeness(code, changed_code)),
        pa.array(likeness(code, next_code)),
    ]


_PAIR_NAMES = [c.split()[0] for c in _PAIRED.split(", ")]


def _streamed(batches):
    place, before, first = TaskContext.get().partitionId(), None, None

    def edge(part, row):
        return pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int32()), "part": [part], "doc_id": pa.array([row[0]], pa.int64()), "text": [row[1]],
                                           **{n: pa.nulls(1, t) for n, t in zip(_PAIR_NAMES, _KINDS)}})

    for batch in batches:
        for some in arrays.slices(batch):
            ids, texts, code = some.column(0).to_pylist(), some.column(1).to_pylist(), codes(some.column(1))
            if before is None:
                first = (ids[0], texts[0])
            else:
                ids, texts = [before[0], *ids], [before[1], *texts]
                code = tuple(np.concatenate([a, b]) for a, b in zip(before[2], code))
            n = len(ids) - 1
            if n:
                columns = _pairs(texts[:n], texts[1:], tuple(c[:n] for c in code), tuple(c[1:] for c in code))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place] * n, pa.int32()), pa.array(["pair"] * n), pa.array(ids[:n], pa.int64()), pa.nulls(n, pa.string()), *columns],
                    names=["place", "part", "doc_id", "text", *_PAIR_NAMES],
                )
            before = (ids[n], texts[n], tuple(c[n:] for c in code))
    if first is not None:
        yield edge("first", first)
        yield edge("last", before)


_KINDS = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]


def _edges(batches):
    for batch in batches:
        texts, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        columns = _pairs(texts, following, codes(batch.column(1)), codes(batch.column(2)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_PAIR_NAMES])


def neighbour_fingerprints(docs):
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: see `edited`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    streamed = written(rows.select("doc_id", "text").mapInArrow(_streamed, _STREAMED), "fingerprints")
    # from here one row per range
    places = streamed.where("part = 'first'").select("place", F.row_number().over(Window.orderBy("place")).alias("rank"))
    places = places.withColumn("after", F.col("rank") % F.count("*").over(Window.partitionBy()) + 1)
    last = streamed.where("part = 'last'").join(places, "place").select("doc_id", "text", F.col("after").alias("rank"))
    heads = streamed.where("part = 'first'").join(places, "place").select("rank", F.col("text").alias("following"))
    ends = last.join(heads, "rank").select("doc_id", "text", "following").mapInArrow(_edges, f"doc_id bigint, {_PAIRED}")
    out = streamed.where("part = 'pair'").select("doc_id", *_PAIR_NAMES).unionByName(ends)
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
