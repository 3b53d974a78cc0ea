"""Token ids as files of Simple-8b words.

A word has 64 bits: 4 for a selector, 60 for ids of one width. The encoder takes the selector that packs most of the next ids,
padding the last word of a block. Blocks hold 512 ids and start at a word of their own; the count of words
per block is stored, so blocks decode side by side. Ids of more than 20 bits are escapes: 0 in their place, place and value
aside. A file row (segment) holds whole documents: their ids, number of ids and place in the file's own run of ids.

Files are Parquet, written by Spark in ascending doc_id order: texts are sorted by range, one file (shard) per range,
so a lost task writes its shard again as it was. Only one sum per shard is carried across shards.

Defined results: null and empty texts have their end id alone. Null ids come first, rows with equal ids are ordered by a hash of their
text; repeated rows are repeated. A text of any length is one document of a segment. Empty tables give empty files. Other columns are not read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.llm import arrays, tokens
from quillspark.llm.columns import whole_text
from quillspark.session import scratch_folder

# Ids per word and their width, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE_BITS = 20
BLOCK = 512
SEGMENT_BYTES = 1 << 21
_BITS = np.frexp(np.arange(1 << ESCAPE_BITS, dtype=np.float64))[1].astype(np.uint8)  # of every id that is no escape
FILE_SCHEMA = (
    "shard int, segment int, first bigint, n_ids bigint, words binary, block_words binary, "
    "escape_at binary, escape_ids binary, doc_ids array<bigint>, doc_lengths array<bigint>"
)
DIGEST_SCHEMA = "doc_id bigint, shard int, first bigint, n_tokens bigint, ids_crc32 bigint"
IDS_SCHEMA = DIGEST_SCHEMA + ", ids array<bigint>"


def _selectors(widths):
    """The selector that packs most of the ids from each place on. `widths`: a row per block, filled up with zeros."""
    rows, n = widths.shape
    widest = int(np.flatnonzero(WIDTHS >= ESCAPE_BITS)[0])  # fits everywhere, as escapes are 0 here
    best = np.full((rows, n), widest, np.uint8)
    # from wide to narrow: where the ids of a selector do not fit, those of a narrower one, being more, do not fit either
    for k in range(widest - 1, -1, -1):
        wide, reach = widths > WIDTHS[k], 1  # whether one of the next `reach` ids is too wide
        while reach < COUNTS[k]:
            step = min(reach, int(COUNTS[k]) - reach)
            wide[:, :-step] |= wide[:, step:].copy()
            reach += step
        if wide.all():
            break
        best[~wide] = k
    return best


def pack(ids):
    """words, words per block, places and values of escapes."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    escape_at = np.flatnonzero(ids >> np.uint64(ESCAPE_BITS))
    escapes, ids = ids[escape_at], ids.copy()
    ids[escape_at] = 0
    starts = np.arange(0, n, BLOCK)
    block_ends = np.minimum(starts + BLOCK, n)
    widths = np.zeros((len(starts), BLOCK), np.uint8)
    widths.ravel()[:n] = _BITS[ids]
    best = _selectors(widths).ravel()
    taken, places, blocks = COUNTS[best], [], []
    block, at = np.arange(len(starts)), starts
    while len(at):  # one word of every block at a time
        places.append(at)
        blocks.append(block)
        at = at + taken[at]
        more = at < block_ends[block]
        at, block = at[more], block[more]
    places = np.concatenate([np.zeros(0, np.int64), *places])
    blocks = np.concatenate([np.zeros(0, np.int64), *blocks])
    order = np.argsort(places)
    places, blocks = places[order], blocks[order]
    kinds = best[places]
    out = kinds.astype(np.uint64) << np.uint64(60)
    padded = np.append(ids, np.uint64(0))
    for k in np.flatnonzero(np.bincount(kinds)):
        rows = np.flatnonzero(kinds == k)
        at, stop = places[rows], block_ends[blocks[rows]]
        if not WIDTHS[k]:
            continue
        for j in range(COUNTS[k]):
            there = np.where(at + j < stop, at + j, n)
            out[rows] |= padded[there] << np.uint64(WIDTHS[k] * j)
    return out, np.bincount(blocks, minlength=len(starts)), escape_at, escapes


def unpack(words, block_words, n_ids, escape_at, escapes):
    words = np.asarray(words, np.uint64)
    block_words = np.asarray(block_words, np.int64)
    kinds = (words >> np.uint64(60)).astype(np.int64)
    taken = COUNTS[kinds]
    ends = np.cumsum(taken)
    block = np.repeat(np.arange(len(block_words)), block_words)
    first_word = np.cumsum(block_words) - block_words
    base = (ends - taken)[first_word] if len(words) else ends
    start = block * BLOCK + (ends - taken) - base[block] if len(words) else ends
    stop = np.minimum((block + 1) * BLOCK, n_ids)
    out = np.zeros(n_ids + 1, np.uint64)
    for k in np.flatnonzero(np.bincount(kinds)):
        rows = np.flatnonzero(kinds == k)
        mask = np.uint64((1 << int(WIDTHS[k])) - 1)
        if not WIDTHS[k]:
            continue
        for j in range(COUNTS[k]):
            there = np.where(start[rows] + j < stop[rows], start[rows] + j, n_ids)
            out[there] = (words[rows] >> np.uint64(WIDTHS[k] * j)) & mask
    out[escape_at] = escapes
    return out[:n_ids]


def _arrow(schema):
    """The Arrow schema, made on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _segments(path, end_id):
    kind = _arrow(FILE_SCHEMA)

    def run(batches):
        encoder, shard, segment, first = tokens.encoder(path, False), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for some in arrays.slices(batch, most=SEGMENT_BYTES):
                ids, bounds = encoder.encode(some.column(1), end_id)
                words, block_words, at, escapes = pack(ids)
                row = {
                    "shard": shard, "segment": segment, "first": first, "n_ids": len(ids), "words": words.tobytes(),
                    "block_words": block_words.astype(np.uint32).tobytes(), "escape_at": at.astype(np.uint32).tobytes(),
                    "escape_ids": escapes.tobytes(), "doc_ids": some.column(0).to_pylist(), "doc_lengths": np.diff(bounds).tolist(),
                }
                segment, first = segment + 1, first + len(ids)
                yield pa.RecordBatch.from_pylist([row], schema=kind)

    return run


def write_files(docs, folder, path, end_id):
    """Write the ids of all texts (tokenizer file `path`, each text ended by `end_id`) in doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows.select("doc_id", "text").mapInArrow(_segments(path, end_id), FILE_SCHEMA).write.parquet(folder)


def _read(schema, with_ids):
    kind = _arrow(schema)

    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                ids = unpack(
                    np.frombuffer(row["words"], np.uint64), np.frombuffer(row["block_words"], np.uint32), row["n_ids"],
                    np.frombuffer(row["escape_at"], np.uint32), np.frombuffer(row["escape_ids"], np.uint64),
                )
                ends = np.cumsum(row["doc_lengths"], dtype=np.int64)
                starts = ends - np.array(row["doc_lengths"], np.int64)
                raw = ids.astype("<u4").tobytes()
                out = {
                    "doc_id": row["doc_ids"], "shard": [row["shard"]] * len(ends), "first": (row["first"] + starts).tolist(),
                    "n_tokens": row["doc_lengths"],
                    "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())],
                }
                if with_ids:
                    out["ids"] = [ids[a:b].tolist() for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_pydict(out, schema=kind)

    return run


def read_files(spark, folder, with_ids=False):
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, decoded from the files."""
    files = spark.read.schema(FILE_SCHEMA).parquet(folder)
    shards = files.groupBy("shard").agg(F.max(F.col("first") + F.col("n_ids")).alias("n_ids"))  # a row per file
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0).cast("long")).alias("base"))
    schema = IDS_SCHEMA if with_ids else DIGEST_SCHEMA
    docs = files.mapInArrow(_read(schema, with_ids), schema).join(shards, "shard")
    return docs.withColumn("start", F.col("base") + F.col("first")).drop("base", "first", "shard")


def token_table(docs, path, end_id, with_ids=False):
    """Write the files to a folder of the shared scratch space and read the documents back from them."""
    spark = docs.sparkSession
    folder = scratch_folder(spark, "token-files")
    write_files(docs, folder, path, end_id)
    return read_files(spark, folder, with_ids).select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
