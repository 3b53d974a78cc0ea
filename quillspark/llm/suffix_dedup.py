"""Removal of every byte that lies in a 200-byte string which starts anywhere else as well.

Suffixes stand for their first 200 bytes, hashed: no suffix order is built (README: Notes on methods). A difference cover thins them out. The cover D modulo v holds two places at every distance, so for any two suffixes
there is a shift below v that brings both to places of the cover. Which strings of 200 - v + 1 bytes at cover places repeat therefore
settles most suffixes: one that has no repeated sample within reach can tie with no other, and never enters a bucket.
The others are dealt into buckets by a 64-bit hash of their 200 bytes, and one bucket at a time is sorted: equal
neighbours are ties. The number of buckets follows the input, so a bucket has a bounded size, and a task sends a suffix that repeats in its texts only once.
Sorting by a hash in place of the bytes finds the same ties; it needs no order between different strings.

Of equal texts one is handled (all bytes of a repeated text of 200 bytes or more go). Repeated samples reach the scans as a bitmap of fixed size: a chance
hit makes a suffix enter a bucket in vain, and nothing is missed.

Defined results: a null text is empty: nothing to remove. Texts below 200 bytes keep all. Rows with equal or null ids are rows of their own. An empty
table gives an empty result. Other columns are not read.
"""

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import arrays
from quillspark.llm.columns import whole_text
from quillspark.session import written

WINDOW = 200
COVER_PRIME = 7  # a cover of q + 1 places modulo q * q + q + 1
BUCKET_BYTES = 1 << 22  # bytes of text per bucket
SIEVE_BITS = 1 << 27
CHUNK_BYTES = 1 << 21
_FLUSH = 1 << 20


def difference_cover(q):
    """Perfect difference set modulo v = q*q + q + 1 for a prime q: places of a plane's line (Singer).

    The powers of x modulo a cubic over GF(q) whose last coefficient is 0, for the first cubic that gives each distance once.
    """
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                power, places = (1, 0, 0), []
                for i in range(v):
                    if power[2] == 0:
                        places.append(i)
                    top = power[2]  # times x, with x^3 = a x^2 + b x + c
                    power = (top * c % q, (power[0] + top * b) % q, (power[1] + top * a) % q)
                if len(places) == q + 1 and len({(x - y) % v for x in places for y in places if x != y}) == v - 1:
                    return v, np.array(places)
    raise ValueError(f"{q} is not a prime")


class Suffixes:
    """Sample places, hashes and candidate suffixes of a run of texts."""

    def __init__(self, buckets, window=WINDOW, prime=COVER_PRIME):
        self.window, self.buckets = window, np.uint64(buckets)
        self.modulus, places = difference_cover(prime)
        self.sample = window - self.modulus + 1
        self.places = places

    def sampled(self, offsets):
        """Cover places of all texts (in the run), and the text of each."""
        sizes = np.diff(offsets)
        most = int(sizes.max(initial=0))
        pattern = (np.arange(0, most + self.modulus, self.modulus)[:, None] + self.places[None, :]).ravel()
        counts = np.where(sizes >= self.window, np.searchsorted(pattern, sizes - self.sample, side="right"), 0)
        text = np.repeat(np.arange(len(sizes)), counts)
        rank = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
        return offsets[:-1][text] + pattern[rank], text

    def key(self, hashes):
        """Bucket in the upper half, 32 bits of the hash in the lower."""
        return (((hashes >> np.uint64(32)) % self.buckets) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))

    def sample_keys(self, sums, at):
        return self.key(arrays.span_hashes(sums, at, at + self.sample))

    def candidates(self, offsets, at, text):
        """First and last + 1 suffix of each run of suffixes within reach of the sample places `at`."""
        low = np.maximum(at - (self.modulus - 1), offsets[:-1][text])
        high = np.minimum(at, offsets[1:][text] - self.window)
        good = low <= high
        inside = np.zeros(int(offsets[-1]) + 2, np.int32)
        np.add.at(inside, low[good], 1)
        np.add.at(inside, high[good] + 1, -1)
        return runs(np.cumsum(inside) > 0, offsets)

    def hashes(self, sums, starts, ends):
        """Distinct hashes of the suffixes in these runs by bucket, with bounds of buckets, and each suffix's place among them."""
        at = spread(starts, ends)
        values, which, counts = np.unique(arrays.span_hashes(sums, at, at + self.window), return_inverse=True, return_counts=True)
        bucket = ((values >> np.uint64(32)) % self.buckets).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        names, first = np.unique(bucket[order], return_index=True)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return values[order], names, np.append(first, len(order)), at, place[which.ravel()], counts[order] > 1


def spread(starts, ends):
    counts = ends - starts
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def runs(inside, offsets):
    """Starts and ends of runs of True that no text boundary crosses."""
    inside = inside[: int(offsets[-1])]
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) if len(inside) else inside
    after = np.concatenate([inside[1:], [False]]) if len(inside) else inside
    return np.flatnonzero(inside & (~before | edge[:-1])), np.flatnonzero(inside & (~after | edge[1:])) + 1


def _probes(keys, bits):
    return np.stack([arrays.mixed(keys + np.uint64(1)), arrays.mixed(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5))]) & np.uint64(bits - 1)


def _in_sieve(sieve, keys):
    at = _probes(keys, 8 * len(sieve))
    return ((sieve[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _sieve(keys, bits):
    """Bytes of a two-probe bitmap of fixed size over column `at`: at most bits / 8 bytes reach the driver."""
    rows = keys.groupBy((F.col("at") / 32768).cast("long").alias("slot")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for row in rows:
        out[row.slot * 4096 : (row.slot + 1) * 4096] = np.frombuffer(row.bits, np.uint8)
    return out


_TEXT_KEY = np.uint64(0x1234567)


def _text_keys(digests):
    return np.array([int.from_bytes(d[:8], "little") for d in digests], np.uint64) ^ _TEXT_KEY


def _single_texts(batches, copied):
    """Runs (texts, digests) of texts in a scan that have no copies, as far as the bitmap tells."""
    for batch in batches:
        for some in arrays.slices(batch):
            column = some.column(some.schema.get_field_index("text"))
            data, offsets = arrays.text_buffer(column)
            raw = data.tobytes()
            digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            if copied is not None and len(digests):
                alone = np.flatnonzero(~_in_sieve(copied, _text_keys(digests)))
                data = data[spread(offsets[:-1][alone], offsets[1:][alone])]
                offsets = np.concatenate([[0], np.cumsum(np.diff(offsets)[alone])])
                digests = [digests[i] for i in alone]
            yield data, offsets, digests


def _copied_texts(batches, copied):
    """Rows of the texts that the bitmap names as repeated, with their digest."""
    for batch in batches:
        for some in arrays.slices(batch):
            texts = some.column(0).to_pylist()
            digests = [hashlib.sha256(t.encode()).digest() for t in texts]
            hit = np.flatnonzero(_in_sieve(copied.value, _text_keys(digests))).tolist() if texts else []
            yield pa.RecordBatch.from_pydict({"digest": pa.array([digests[i] for i in hit], pa.binary()), "text": pa.array([texts[i] for i in hit], pa.string())})


def _low_bytes(values, n):
    """The low n bytes of each 64-bit value, in a row."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _from_low(raw, n):
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel().astype(np.uint64)


def _samples(suffixes, copied):
    """Messages (bucket, keys): sample keys by bucket, a key that repeats in a flush twice."""

    def flush(parts):
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        keys = np.sort(np.concatenate([keys, keys[counts > 1]]))
        bucket = keys >> np.uint64(32)
        names, first = np.unique(bucket, return_index=True)
        low = (keys & np.uint64(0xFFFFFFFF)).astype("<u4")
        parts = [low[a:b].tobytes() for a, b in zip(first, np.append(first[1:], len(keys)))]
        return pa.RecordBatch.from_pydict({"bucket": pa.array(names.astype(np.int64)), "keys": pa.array(parts, pa.binary())})

    def run(batches):
        held, n = [], 0
        for data, offsets, _ in _single_texts(batches, copied.value if copied else None):
            at, _ = suffixes.sampled(offsets)
            held.append(suffixes.sample_keys(arrays.prefix_sums(data), at))
            n += len(at)
            if n >= _FLUSH:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return run


def _by_bucket(batches):
    """The rows of one bucket after the other (rows come sorted by bucket)."""
    rows = []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and rows[0]["bucket"] != row["bucket"]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _repeated(bits):
    """Sieve places of the sample keys that repeat."""

    def run(batches):
        for rows in _by_bucket(batches):
            low = np.sort(np.concatenate([np.frombuffer(r["keys"], "<u4") for r in rows]))
            twice = np.unique(low[1:][low[1:] == low[:-1]]).astype(np.uint64)
            at = _probes((np.uint64(rows[0]["bucket"]) << np.uint64(32)) | twice, bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], names=["at"])

    return run


_CHUNK = "chunk string, digests array<binary>, data binary, offsets array<bigint>, starts array<bigint>, ends array<bigint>"


def _chunks(suffixes, sieve, copied):
    """Texts with candidate suffixes, some megabytes a row, and the runs of their candidates."""

    def row(texts):
        data = np.concatenate([t[0] for t in texts])
        offsets = np.concatenate([[0], np.cumsum([len(t[0]) for t in texts])])
        starts = np.concatenate([t[2] + o for t, o in zip(texts, offsets)])
        ends = np.concatenate([t[3] + o for t, o in zip(texts, offsets)])
        return pa.RecordBatch.from_pydict({
            "chunk": [uuid.uuid4().hex], "digests": pa.array([[t[1] for t in texts]], pa.list_(pa.binary())), "data": pa.array([zlib.compress(data.tobytes(), 1)], pa.binary()),
            "offsets": pa.array([offsets], pa.list_(pa.int64())), "starts": pa.array([starts], pa.list_(pa.int64())), "ends": pa.array([ends], pa.list_(pa.int64())),
        })

    def run(batches):
        held, size = [], 0
        for data, offsets, digests in _single_texts(batches, copied.value if copied else None):
            at, text = suffixes.sampled(offsets)
            hit = _in_sieve(sieve.value, suffixes.sample_keys(arrays.prefix_sums(data), at)) if len(at) else np.zeros(0, bool)
            starts, ends = suffixes.candidates(offsets, at[hit], text[hit])
            cut = np.searchsorted(starts, offsets)
            for t in np.flatnonzero(np.diff(cut)):
                a, b = offsets[t], offsets[t + 1]
                held.append((data[a:b].copy(), digests[t], starts[cut[t] : cut[t + 1]] - a, ends[cut[t] : cut[t + 1]] - a))
                size += b - a
                if size >= CHUNK_BYTES:
                    yield row(held)
                    held, size = [], 0
        if held:
            yield row(held)

    return run


def _opened(suffixes, row):
    data, starts, ends = np.frombuffer(zlib.decompress(row["data"]), np.uint8), np.array(row["starts"], np.int64), np.array(row["ends"], np.int64)
    return data, suffixes.hashes(arrays.prefix_sums(data), starts, ends)


_HASH_BYTES = 7


def _messages(suffixes):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _, (values, names, bounds, *_) = _opened(suffixes, row)
                parts = [_low_bytes(values[a:b], _HASH_BYTES) for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(names), "chunk": [row["chunk"]] * len(names), "keys": pa.array(parts, pa.binary())})

    return run


def _replies(batches):
    """For each message, which of its suffixes another message holds as well (bits in the message's order)."""
    for rows in _by_bucket(batches):
        parts = [_from_low(r["keys"], _HASH_BYTES) for r in rows]
        values = np.concatenate(parts)
        order = np.argsort(values)
        same = values[order][1:] == values[order][:-1]
        tied = np.zeros(len(values), bool)
        tied[order[1:][same]] = True
        tied[order[:-1][same]] = True
        masks = [np.packbits(m).tobytes() for m in np.split(tied, np.cumsum([len(p) for p in parts])[:-1])]
        yield pa.RecordBatch.from_pydict({
            "chunk": [r["chunk"] for r in rows], "bucket": pa.array([r["bucket"] for r in rows], pa.int64()), "mask": pa.array(masks, pa.binary())})


_RESULT = "digest binary, n_removed bigint, n_spans bigint, kept_sha256 string, starts array<bigint>, ends array<bigint>"


def _removed(suffixes):
    """Removed runs of each text of a chunk, from the replies of all buckets."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data, (_, names, bounds, at, place, repeated) = _opened(suffixes, row)
                masks = {r["bucket"]: r["mask"] for r in row["replies"]}
                tied = [np.unpackbits(np.frombuffer(masks[n], np.uint8), count=b - a) for n, a, b in zip(names.tolist(), bounds, bounds[1:])]
                tied = np.concatenate([np.zeros(0, np.uint8), *tied]).astype(bool) | repeated
                hit = at[tied[place]]
                cover = np.zeros(len(data) + 1, np.int32)
                np.add.at(cover, hit, 1)
                np.add.at(cover, hit + suffixes.window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                offsets = np.array(row["offsets"], np.int64)
                starts, ends = runs(gone, offsets)
                cut = np.searchsorted(starts, offsets)
                out = []
                for t, digest in enumerate(row["digests"]):
                    a, b = offsets[t], offsets[t + 1]
                    s, e = starts[cut[t] : cut[t + 1]] - a, ends[cut[t] : cut[t + 1]] - a
                    kept = hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest()
                    out.append({"digest": digest, "n_removed": int((e - s).sum()), "n_spans": len(s), "kept_sha256": kept, "starts": s.tolist(), "ends": e.tolist()})
                kind = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema(list(zip([c.split()[0] for c in _RESULT.split(", ")], kind))))

    return run


def repeated_spans(docs, window=WINDOW, prime=COVER_PRIME, bucket_bytes=BUCKET_BYTES):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts, ends (byte runs that go) of each row."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    texts = docs.select(whole_text().alias("text"))
    digest = F.unhex(F.sha2(whole_text(), 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(whole_text()).cast("long").alias("n_bytes"), digest.alias("digest"))
    rows = written(rows, "digests")
    classes = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.first("n_bytes").alias("size"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    suffixes = Suffixes(total // bucket_bytes + 1, window, prime)

    # one text of each class: those that the bitmap of repeated digests does not name, and one row for each that it names
    names = classes.where((F.col("copies") > 1) & (F.col("size") >= window)).select("digest")
    copied = share(_sieve(names.mapInArrow(_digest_places, "at bigint"), SIEVE_BITS // 8))
    repeated = texts.mapInArrow(lambda b: _copied_texts(b, copied), "digest binary, text string")
    repeated = written(repeated.groupBy("digest").agg(F.first("text").alias("text")).select("text"), "repeated-texts")

    def over_texts(make, schema):
        return texts.mapInArrow(make(copied), schema).unionByName(repeated.mapInArrow(make(None), schema))

    def dealt(messages):
        return messages.repartition("bucket").sortWithinPartitions("bucket")

    samples = over_texts(lambda c: _samples(suffixes, c), "bucket bigint, keys binary")
    sieve = share(_sieve(dealt(samples).mapInArrow(_repeated(SIEVE_BITS), "at bigint"), SIEVE_BITS))
    chunks = written(over_texts(lambda c: _chunks(suffixes, sieve, c), _CHUNK), "chunks")
    messages = chunks.mapInArrow(_messages(suffixes), "bucket bigint, chunk string, keys binary")
    replies = dealt(messages).mapInArrow(_replies, "chunk string, bucket bigint, mask binary")
    replies = written(replies, "replies").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "mask")).alias("replies"))  # bounded by the chunk
    found = written(chunks.join(replies, "chunk").mapInArrow(_removed(suffixes), _RESULT).where("n_spans > 0"), "removed")

    all_gone = (F.col("copies") > 1) & (F.col("size") >= window)
    partly = classes.join(found, "digest", "left").select(
        F.col("digest").alias("of"),
        F.when(all_gone, F.col("size")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(all_gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.when(all_gone, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("starts", F.array().cast("array<bigint>"))).alias("starts"),
        F.when(all_gone, F.array("size")).otherwise(F.coalesce("ends", F.array().cast("array<bigint>"))).alias("ends"),
    )
    return rows.join(partly, F.col("digest") == F.col("of")).drop("digest", "of")


def _digest_places(batches):
    for batch in batches:
        at = _probes(_text_keys(batch.column(0).to_pylist()), SIEVE_BITS // 8).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], names=["at"])
