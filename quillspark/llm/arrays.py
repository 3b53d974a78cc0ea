"""Whole Arrow batches of texts as numpy arrays: bytes, words, word hashes and shingles, without a loop over words."""

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PRIME = (1 << 31) - 1
_BASES = (0x2545F491 % _PRIME, 0x5851F42D % _PRIME)
_BLOCK = 1 << 24  # so many products of 39 bits add up in 64
_tables = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False


def slices(batch, name="text", most=SLICE_BYTES):
    """The batch in runs of rows of about `most` bytes of text; a longer text is a run of its own."""
    column = batch.column(batch.schema.get_field_index(name))
    ends = text_buffer(column)[1][1:]
    first = 0
    while first < len(ends):
        base = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, base + most, side="right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


def text_buffer(column):
    """Bytes of all texts and the n + 1 offsets between them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(data, offsets, is_word=NOT_SPACE):
    """Starts and ends of all words, and for n texts the n + 1 bounds between their words."""
    inside = is_word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def _reduced(x):
    """64-bit numbers modulo the prime 2^31 - 1."""
    for _ in range(2):
        x = (x & np.uint64(_PRIME)) + (x >> np.uint64(31))
    return x - np.uint64(_PRIME) * (x >= np.uint64(_PRIME))


def _powers(base, n):
    """base ** 0 .. base ** n, modulo the prime."""
    table = _tables.get(base)
    if table is None or len(table) <= n:
        table, size = np.ones(1, np.uint32), max(n, SLICE_BYTES) + 1
        while len(table) < size:
            more = _reduced(table[: size - len(table)].astype(np.uint64) * np.uint64(pow(base, len(table), _PRIME)))
            table = np.concatenate([table, more.astype(np.uint32)])
        if n <= 4 * SLICE_BYTES:
            _tables[base] = table
    return table[: n + 1]


def prefix_sums(data):
    """For two bases, sums of (byte + 1) * base ** place before each place: a span's hash comes from differences of two of them.

    Arithmetic is modulo a prime. Modulo a power of two, a long word and its image under an exchange of two letters can have one hash for every base.
    """
    codes = data.astype(np.uint64) + np.uint64(1)
    sums = np.zeros((len(_BASES), len(data) + 1), np.uint64)
    for row, base in zip(sums, _BASES):
        powers = _powers(base, len(data))
        for at in range(0, len(data), _BLOCK):
            part = row[at + 1 : at + _BLOCK + 1]
            np.cumsum(codes[at : at + _BLOCK] * powers[at : at + len(part)], out=part)
            part += _reduced(row[at : at + 1])
    return sums


def span_hashes(sums, starts, ends):
    """64-bit hashes of spans: equal bytes have equal hashes wherever they stand. Two numbers of 31 bits and the length tell others apart."""
    out = np.zeros(len(starts), np.uint64)
    for row, base in zip(sums, _BASES):
        apart = _reduced(row[ends]) + np.uint64(_PRIME) - _reduced(row[starts])
        back = _powers(pow(base, -1, _PRIME), sums.shape[1] - 1)[starts]
        out = (out << np.uint64(31)) | _reduced(_reduced(apart) * back)
    return mixed(mixed(out) + (ends - starts).astype(np.uint64))


def mixed(h):
    """A permutation of 64-bit numbers that spreads them evenly."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(hashes, bounds, k):
    """Hashes of all runs of `k` words; a text with 1 to k - 1 words is one run. With their bounds."""
    n = len(hashes)
    counts = np.diff(bounds)
    last, first = np.repeat(bounds[1:], counts), np.repeat(bounds[:-1], counts)
    at = np.arange(n)
    out, weight = np.zeros(n, np.uint64), 1
    for j in range(k):
        stop = max(n - j, 0)
        out[:stop] += np.where(at[:stop] + j < last[:stop], hashes[j:] * np.uint64(weight), np.uint64(0))
        weight = weight * int(_STEP) % (1 << 64)
    valid = (at + k <= last) | ((at == first) & (at + k > last))
    n_runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    return mixed(out[valid]), np.concatenate([[0], np.cumsum(n_runs)])


def distinct(hashes, bounds):
    """The distinct values of each text, ascending, and their bounds."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[new], text[new]
    return hashes, np.searchsorted(text, np.arange(len(bounds)))


def shingle_sets(column, k, lower=True):
    """Distinct k-word shingle hashes of each text, ascending, and their bounds."""
    data, offsets = text_buffer(column)
    starts, ends, bounds = words(data, offsets)
    hashes = span_hashes(prefix_sums(LOWER[data] if lower else data), starts, ends)
    return distinct(*shingles(hashes, bounds, k))
