"""Jaccard self-join of documents on word n-grams with adaptive multi-match prefixes.

A document is the set of its distinct shingles. Shingles are put in the order of an estimated document frequency, rare first
(counts over all documents in 2^18 buckets; any order is right, a good one is fast). Two sets of the likeness asked for share at
least ceil(t * size) shingles of either, so among the first size - ceil(t * size) + l shingles of each they share at least l. Each document
takes the l with the least estimated cost: entries to list, rows to join, and candidates to verify, which fall as l grows. A pair is a
candidate only if its prefixes share at least the smaller of both l.

No list of all pairs of a group is made:
* equal sets are one node;
* in each list, members are first verified against its most typical member only, which joins families of near copies;
* afterwards only pairs of different components are listed, one side being outside the largest component of the list, and
  of lists with the same members one stands for all, with their number.
Pairs are held against bounds that lose nothing before shingles move: sizes, a 1024-bit parity sketch, whose differing
bits are at most the symmetric difference, and then a parity sketch of about a bit per shingle. Links are verified on whole sets of 64-bit hashes.

Defined results: a text without words, or null, has size 0 and links with nothing; fewer words than n are one shingle. A component is
named by its smallest doc_id that is not null. Rows with equal ids are separate documents, repeated rows are copies. An empty table
gives an empty result. Other columns are not read, but kept by `drop_near`.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import arrays
from quillspark.llm.columns import whole_text, without
from quillspark.llm.components import components
from quillspark.llm.exact_dedup import SIEVE_BITS
from quillspark.session import written

BUCKETS = 1 << 18
LADDER = (1, 2, 3, 5, 8, 13)
VERIFY_COST = 10.0
SKETCH = 1024
_PARTS = [f"s{i}" for i in range(SKETCH // 64)]
_BLOCK = 256  # sets that are sketched at a time
_SEEN = 100_000  # sets a task remembers, so that copies in one task are listed once

_PROFILE = "kind int, doc_id bigint, mark bigint, n bigint, node bigint, " + ", ".join(f"{s} bigint" for s in _PARTS) + ", sketch binary, bucket int, found bigint"
_ENTRIES = "token bigint, node bigint, matches int, typical float"


def _lower(hashes):
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def _sums(values, bounds):
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def node_ids(sets, bounds):
    """A 64-bit name of each set."""
    sums = _sums(arrays.mixed(sets ^ np.uint64(0x5851F42D4C957F2D)), bounds)
    return arrays.mixed(sums + np.diff(bounds).astype(np.uint64)).view(np.int64)


def parity_sketches(sets, bounds):
    """SKETCH bits per set, as 64-bit words: bit i tells whether an odd number of its hashes fall on i."""
    out = np.zeros((len(bounds) - 1, SKETCH // 64), np.int64)
    for i in range(0, len(out), _BLOCK):
        ends = bounds[i : i + _BLOCK + 1]
        doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        bit = ((sets[ends[0] : ends[-1]] >> np.uint64(40)) & np.uint64(SKETCH - 1)).astype(np.int64)
        odd = (np.bincount(doc * SKETCH + bit, minlength=(len(ends) - 1) * SKETCH) & 1).astype(np.uint8)
        out[i : i + _BLOCK] = np.packbits(odd.reshape(-1, SKETCH), axis=1).view(np.int64)
    return out


def sized_sketches(sets, bounds):
    """A parity sketch of at least a bit per shingle for each set, a power of two of bits: the longer folds onto the shorter."""
    counts = np.diff(bounds)
    bits = 1 << np.maximum(np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64), 8)
    ends = np.cumsum(bits)
    first = np.repeat(ends - bits, counts)
    at = first + ((sets >> np.uint64(20)) & np.repeat(bits - 1, counts).astype(np.uint64)).astype(np.int64)
    odd = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(np.uint8)).tobytes()
    return [odd[(e - b) // 8 : e // 8] for e, b in zip(ends.tolist(), bits.tolist())]


def differing_bits(a, b):
    """At most the symmetric difference of the sets of two sized sketches."""
    a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _close(percent):
    def run(batches):
        for batch in batches:
            a, b, n, m, x, y = (batch.column(i).to_pylist() for i in range(6))
            keep = [differing_bits(p, q) * (100 + percent) <= (i + j) * (100 - percent) for i, j, p, q in zip(n, m, x, y)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Seen(set):
    def fresh(self, nodes):
        """Which of the nodes are met for the first time (or forgotten since)."""
        if len(self) > _SEEN:
            self.clear()
        out = np.zeros(len(nodes), bool)
        for i, node in enumerate(nodes.tolist()):
            if node not in self:
                self.add(node)
                out[i] = True
        return out


def _taken(sets, bounds, rows):
    """Sets and bounds of some rows."""
    counts = np.diff(bounds)
    return sets[np.repeat(rows, counts)], np.concatenate([[0], np.cumsum(counts[rows])])


def _profiles(words):
    def run(batches):
        found, seen = np.zeros(BUCKETS, np.int64), _Seen()
        for batch in batches:
            for some in arrays.slices(batch):
                sets, bounds = arrays.shingle_sets(some.column(1), words)
                nodes, sketch, n = node_ids(sets, bounds), parity_sketches(sets, bounds), len(some)
                found += np.bincount(_lower(_taken(sets, bounds, seen.fresh(nodes))[0]), minlength=BUCKETS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int32)), some.column(0), some.column(2), pa.array(np.diff(bounds)), pa.array(nodes),
                     *(pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(len(_PARTS))), pa.array(sized_sketches(sets, bounds), pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())],
                    names=_names(_PROFILE))
        bucket = np.flatnonzero(found)
        for i in range(0, len(bucket), 1 << 16):
            some = bucket[i : i + (1 << 16)]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(len(some), np.int32)), *[none] * (4 + len(_PARTS)), pa.nulls(len(some), pa.binary()), pa.array(some.astype(np.int32)), pa.array(found[some])], names=_names(_PROFILE))

    return run


def _names(schema):
    return [c.split()[0] for c in schema.split(", ")]


def prefixes(sets, bounds, frequency, percent):
    """Tokens of each set's prefix, their counts per set, the chosen number of matches, and how frequent its tokens are."""
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(counts)), counts)
    often = frequency[_lower(sets)]
    order = np.lexsort((sets, often, doc))
    sets, often = sets[order], often[order].astype(np.float64)
    noise = frequency.mean()
    lists = np.concatenate([[0.0], np.cumsum(np.maximum(often - noise, 0))])
    needed = -(-percent * counts // 100)
    best, chosen, length = np.full(len(counts), np.inf), np.ones(len(counts), np.int64), np.zeros(len(counts), np.int64)
    for matches in LADDER:
        size = np.minimum(counts - needed + matches, counts)
        joined = lists[bounds[:-1] + size] - lists[bounds[:-1]]
        cost = np.where(matches <= np.maximum(needed, 1), size + joined + VERIFY_COST * joined / matches, np.inf)
        better = cost < best
        best[better], chosen[better], length[better] = cost[better], matches, size[better]
    rank = np.arange(len(sets)) - np.repeat(bounds[:-1], counts)
    typical = _sums(np.log(np.maximum(often, 1)), bounds) / np.maximum(counts, 1)
    return sets[rank < np.repeat(length, counts)], length, chosen, typical


def _entries(words, percent, frequency):
    def run(batches):
        seen, often = _Seen(), frequency.value
        for batch in batches:
            for some in arrays.slices(batch):
                sets, bounds = arrays.shingle_sets(some.column(1), words)
                nodes = node_ids(sets, bounds)
                fresh = seen.fresh(nodes)
                sets, bounds = _taken(sets, bounds, fresh)
                tokens, length, matches, typical = prefixes(sets, bounds, often, percent)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens.view(np.int64)), pa.array(np.repeat(nodes[fresh], length)), pa.array(np.repeat(matches, length).astype(np.int32)),
                     pa.array(np.repeat(typical, length).astype(np.float32))], names=_names(_ENTRIES))

    return run


def _chosen_sets(words, wanted):
    def run(batches):
        seen, bits = _Seen(), np.unpackbits(np.frombuffer(wanted.value, np.uint8), bitorder="little")
        for batch in batches:
            for some in arrays.slices(batch):
                sets, bounds = arrays.shingle_sets(some.column(1), words)
                nodes = node_ids(sets, bounds)
                keep = (bits[nodes & (len(bits) - 1)] == 1) & (np.diff(bounds) > 0)
                keep[keep] = seen.fresh(nodes[keep])
                sets, bounds = _taken(sets, bounds, keep)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[keep]), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))], names=["node", "hashes"])

    return run


def _bitmap(nodes, bits=SIEVE_BITS):
    """Bytes of a bitmap of fixed size that holds column `node`: at most bits / 8 bytes reach the driver."""
    at = nodes.select(F.pmod("node", F.lit(bits)).cast("long").alias("at"))
    rows = at.groupBy((F.col("at") / 32768).cast("long").alias("slot")).agg(F.bitmap_construct_agg(F.col("at") % 32768).alias("bits")).collect()
    out = bytearray(bits // 8)
    for row in rows:
        out[row.slot * 4096 : (row.slot + 1) * 4096] = row.bits
    return bytes(out)


def _near(percent, a, b):
    """The two bounds on a pair: sizes, and differing bits of the sketches."""
    differing = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _PARTS), F.lit(0))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (differing * (100 + percent) <= (n + m) * (100 - percent))


class _Join:
    def __init__(self, docs, words, percent):
        self.words, self.percent, self.spark = words, percent, docs.sparkSession
        self.rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.xxhash64(whole_text()).alias("mark"))
        seen = written(self.rows.mapInArrow(_profiles(words), _PROFILE), "profiles")
        self.docs = seen.where("kind = 0").select("doc_id", "mark", "n", "node")
        one = seen.where("kind = 0 and n > 0").groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", *_PARTS, "sketch")))
        one = written(one, "nodes")  # every consumer reads its own columns
        self.nodes, self.sketches = one.drop("sketch"), one.select("node", "n", "sketch")
        counts = seen.where("kind = 1").groupBy("bucket").agg(F.sum("found").alias("found")).toPandas()  # at most BUCKETS rows
        frequency = np.zeros(BUCKETS, np.int64)
        frequency[counts["bucket"]] = counts["found"]
        self.frequency = self.spark.sparkContext.broadcast(frequency)

    def verified(self, pairs):
        """Links (a, b) among candidate pairs, by exact sets."""
        x, y = (self.sketches.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"of_{c}")) for c in "ab")
        pairs = pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "of_a", "of_b")
        pairs = written(pairs.mapInArrow(_close(self.percent), "a bigint, b bigint"), "candidates")
        wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
        wanted = self.spark.sparkContext.broadcast(_bitmap(wanted))
        sets = self.rows.select("doc_id", "text").mapInArrow(_chosen_sets(self.words, wanted), "node bigint, hashes array<bigint>")
        sets = written(sets.groupBy("node").agg(F.first("hashes").alias("hashes")), "sets")
        left, right = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"of_{c}")) for c in "ab")
        both = pairs.join(left, "a").join(right, "b")
        common = F.size(F.array_intersect("of_a", "of_b"))
        either = F.size("of_a") + F.size("of_b") - common
        return written(both.where(common * 100 >= either * self.percent).select("a", "b"), "verified")

    def entries(self):
        """Entries of tokens that several nodes list, with the most typical of these nodes."""
        entries = written(self.rows.select("doc_id", "text").mapInArrow(_entries(self.words, self.percent, self.frequency), _ENTRIES), "entries")
        shared = entries.groupBy("token").agg(
            F.min("node").alias("low"), F.max("node").alias("high"), F.max_by("node", "typical").alias("leader"))  # numbers alone: no sort
        shared = shared.where("low != high").select("token", "leader")
        return written(entries.join(shared, "token").dropDuplicates(["token", "node"]), "shared")

    def to_leaders(self, entries):
        pairs = entries.where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
        pairs = pairs.join(self.nodes.alias("x"), F.col("a") == F.col("x.node")).join(self.nodes.alias("y"), F.col("b") == F.col("y.node"))
        return pairs.where(_near(self.percent, "x", "y")).select("a", "b")

    def across(self, entries, roots):
        entries = entries.select("token", "node", "matches").join(roots, "node", "left")
        entries = written(entries.withColumn("root", F.coalesce("root", "node")), "rooted")
        name = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in range(2)]
        sizes = entries.groupBy("token", "root").agg(F.count("*").alias("members"), *name)
        largest = sizes.groupBy("token").agg(
            F.max(F.struct("members", "root")).alias("top"), F.count("*").alias("roots"), F.sum("members").alias("listed"), *(F.bit_xor(h).alias(h) for h in ("h0", "h1")))
        # members of a family share many tokens: of lists with the same members one is joined, and counts for all
        alike = largest.where("roots > 1").groupBy("listed", "h0", "h1", F.col("top.root").alias("main")).agg(F.min("token").alias("token"), F.count("*").alias("lists"))
        mixed = written(entries.join(alike.select("token", "main", "lists"), "token").join(self.nodes, "node"), "mixed")
        x, y = mixed.where("root != main").alias("x"), mixed.alias("y")
        once = (F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
        pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.root") != F.col("y.root")) & once & _near(self.percent, "x", "y"))
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), F.least("x.matches", "y.matches").alias("asked"), "x.lists")
        pairs = pairs.groupBy("a", "b").agg(F.sum("lists").alias("shared"), F.first("asked").alias("asked"))
        return pairs.where("shared >= asked").select("a", "b")

    def roots(self):
        entries = self.entries()
        first = self.verified(self.to_leaders(entries))
        rest = self.verified(self.across(entries, components(first)))
        return components(first.unionByName(rest))


def near_components(docs, words, percent):
    """doc_id, mark, n_shingles, component_id of each row; links have 100 * intersection >= percent * union.

    mark is the xxhash64 of the text.
    """
    join = _Join(docs, words, percent)
    rows = join.docs.where("n > 0").join(join.roots(), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = written(rows, "components")
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    alone = join.docs.where("n = 0").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return rows.join(least, "root").select("doc_id", "mark", F.col("n").alias("n_shingles"), "component_id", "root").unionByName(alone)


def drop_near(docs, words=5, percent=80):
    """The rows of `docs` without near duplicates: of each component the row with the smallest doc_id stays (null last).

    Texts without words stay.
    """
    rows = near_components(docs, words, percent).where("root is not null")
    same = rows.groupBy("root", F.col("doc_id").alias("id"), "mark").agg(F.count("*").alias("copies"))
    same = written(same, "near-keys")
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("mark").alias("mark"))
    best = same.groupBy("root").agg(F.min(order).alias("best"))
    same = same.join(best, "root").withColumn("stays", order == F.col("best"))
    marked = written(same.where("not stays or copies > 1").select("id", "mark", "stays"), "near-marks")
    return without(docs, marked.where("not stays"), marked.where("stays"))
