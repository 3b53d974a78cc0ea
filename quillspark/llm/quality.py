"""Quality classifier: naive Bayes support vectors.

Each n-gram indicator is scaled by its class log-count ratio  r = log((p + 1) / sum(p + 1)) - log((q + 1) / sum(q + 1)),  p and q being the good and the bad texts that hold
it. A linear hinge-loss model on the scaled indicators is fitted by dual coordinate descent; its weights are then drawn towards their mean size (by `MIX`), which keeps
naive Bayes in play where the support vectors say little. A margin becomes a score by a logistic curve fitted on labelled texts that the descent has not seen.

N-grams: single words and pairs of words, as written; and runs of one to three word shapes (kinds of the first two and the last byte, length class, whether the word
repeats the one before it). They are hashed into `PLACES` places, present or not; a place counts when `LEAST_TEXTS` sampled texts hold it.

The model is fitted on a bounded sample of the labelled rows, by rank of a hash of the id: at most `MOST_TEXTS` texts, of which the driver gets at most `MOST_ENTRIES` indicators
(whole texts, as many as fit; an id whose texts have more than a hundredth of that is passed over). Spark counts n-grams and scores every row.

Defined results: null and empty texts have no n-gram and are scored by the bias alone. A row without an id is scored, never learned from and not held out. Ids
labelled both ways teach nothing, nor do labels other than 0 and 1, or without a document. A label that is repeated counts once; rows with equal ids each. Without
labels of both kinds every score is the share of good ones (0.5 without any). Equal texts have equal scores. Texts of any length are read whole. An empty table
gives an empty result. Other columns of the documents are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import arrays
from quillspark.llm.columns import row_of, unpacked, whole_text
from quillspark.session import written

PLACES = 1 << 18
MOST_TEXTS = 16_000
MOST_ENTRIES = 8_000_000
LEAST_TEXTS = 3
MIX = 0.25
COST = 1.0
PASSES = 12
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
_STEP = np.uint64(0x9E3779B97F4A7C15)

# kinds of bytes: small, capital, digit, part of a longer code point, stop, other
_KIND = np.full(256, 5, np.uint64)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 4


def remainder(doc_id):
    """crc32 of the id as text, modulo 4: rows with 2 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _runs(values, rank, longest, tag):
    """Hashes of all runs of 1 to `longest` values that end at each value, and which of them lie within one text; `rank` is a value's place in it."""
    single = arrays.mixed(values + np.uint64(tag * int(_STEP) % (1 << 64)))
    run, out = single, [(single, np.ones(len(values), bool))]
    for length in range(2, longest + 1):
        longer = np.zeros_like(run)
        longer[1:] = arrays.mixed(run[:-1] * _STEP + single[1:])
        run = longer
        out.append((run, rank >= length - 1))
    return out


def n_grams(column):
    """Text number and place of every n-gram of all texts, repeats included."""
    data, offsets = arrays.text_buffer(column)
    starts, ends, bounds = arrays.words(data, offsets)
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), counts)
    rank = np.arange(len(starts)) - np.repeat(bounds[:-1], counts)
    word = arrays.span_hashes(arrays.prefix_sums(data), starts, ends)
    again = np.zeros(len(starts), bool)
    again[1:] = (rank[1:] > 0) & (word[1:] == word[:-1])
    length = np.minimum(np.log2(ends - starts), 5).astype(np.uint64)
    shape = np.zeros(len(starts), np.uint64)
    for part in (_KIND[data[starts]], _KIND[data[np.minimum(starts + 1, ends - 1)]], _KIND[data[ends - 1]], length, again.astype(np.uint64)):
        shape = shape * np.uint64(8) + part
    found = _runs(word, rank, 2, 1) + _runs(shape, rank, 3, 2)
    text = np.concatenate([text[valid] for _, valid in found])
    places = np.concatenate([h[valid] for h, valid in found]) & np.uint64(PLACES - 1)
    return text, places.astype(np.int64)


def indicators(column):
    """Places of the distinct n-grams of each text, ascending, and their bounds."""
    text, places = n_grams(column)
    keys = np.unique(text * PLACES + places)
    return keys % PLACES, np.searchsorted(keys, np.arange(len(column) + 1) * PLACES)


class Model:
    """Weights of the places (0 where no n-gram counts), a bias, and slope and shift of the logistic curve."""

    def __init__(self, weights, bias, slope=1.0, shift=0.0):
        self.weights, self.bias, self.slope, self.shift = weights.astype(np.float32), bias, slope, shift

    def margins(self, places, bounds):
        sums = np.concatenate([[0.0], np.cumsum(self.weights[places], dtype=np.float64)])
        return sums[bounds[1:]] - sums[bounds[:-1]] + self.bias

    def scores(self, column):
        """Scores of texts. Places without a weight go before the rest is made distinct."""
        text, places = n_grams(column)
        weighed = self.weights[places] != 0
        keys = np.unique(text[weighed] * PLACES + places[weighed])
        margins = self.margins(keys % PLACES, np.searchsorted(keys, np.arange(len(column) + 1) * PLACES))
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -40, 40)))


def log_count_ratios(good, bad):
    """r of each n-gram from the numbers of good and of bad texts that hold it."""
    good, bad = good + 1.0, bad + 1.0
    return np.log(good / good.sum()) - np.log(bad / bad.sum())


def descend(values, columns, bounds, good, width, cost=COST, passes=PASSES, seed=0):
    """Weights and bias of the hinge-loss model: dual coordinate descent, a text a step, in a random order that is the same on every run.

    Row i has `values` at `columns` between its bounds, and a constant 1 for the bias.
    """
    sign = np.where(good, 1.0, -1.0)
    w, bias, dual = np.zeros(width), 0.0, np.zeros(len(good))
    cuts = bounds.tolist()
    curve = np.add.reduceat(np.append(values**2, 0.0), bounds[:-1]) * (np.diff(bounds) > 0) + 1.0
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(good)).tolist():
            at, x = columns[cuts[i] : cuts[i + 1]], values[cuts[i] : cuts[i + 1]]
            slope = sign[i] * (w[at] @ x + bias) - 1.0
            new = min(max(dual[i] - slope / curve[i], 0.0), cost)
            if new != dual[i]:
                move = (new - dual[i]) * sign[i]
                w[at] += move * x
                bias += move
                most, dual[i] = max(most, abs(new - dual[i])), new
        if most < 1e-6 * cost:
            break
    return w, bias


def logistic_curve(margins, good, steps=100):
    """Slope and shift that fit the labels best, their targets drawn in from 0 and 1 by Laplace's rule."""
    n, m = good.sum(), (~good).sum()
    if not n or not m:
        return 1.0, 0.0
    target = np.where(good, (n + 1) / (n + 2), 1 / (m + 2))
    size = max(np.abs(margins).max(), 1e-9)
    x = np.column_stack([margins / size, np.ones(len(margins))])
    line = np.array([1.0, np.log(n / m)])
    for _ in range(steps):  # Newton's method, damped
        p = 1 / (1 + np.exp(-np.clip(x @ line, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target))
        line -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
    return float(max(line[0], 1e-3) / size), float(line[1])


def fit(good, calibrating, places, bounds, kept, ratios, cost=COST, passes=PASSES):
    """A model from texts: whether good, whether only for the curve, their places; `ratios` of the places that are `kept`."""
    column = np.full(PLACES, -1, np.int64)
    column[kept] = np.arange(len(kept))
    inside = column[places] >= 0
    columns, bounds = column[places[inside]], np.concatenate([[0], np.cumsum(inside)])[bounds]
    teaching = ~calibrating
    if not (good[teaching].any() and not good[teaching].all()):
        teaching = np.ones(len(good), bool)
    counts = np.diff(bounds)
    rows = columns[np.repeat(teaching, counts)]
    w, bias = descend(ratios[rows], rows, np.concatenate([[0], np.cumsum(counts[teaching])]), good[teaching], len(kept), cost, passes)
    weights = np.zeros(PLACES)
    weights[kept] = ratios * (MIX * np.abs(w).sum() / max(len(kept), 1) + (1 - MIX) * w)
    model = Model(weights, bias)
    margins = model.margins(kept[columns], bounds)
    tested = calibrating if good[calibrating].any() and not good[calibrating].all() else np.ones(len(good), bool)
    model.slope, model.shift = logistic_curve(margins[tested], good[tested])
    return model


def _found(batches):
    for batch in batches:
        for some in arrays.slices(batch, "text"):
            places, bounds = indicators(some.column(3))
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(places.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), lists], names=["id", "good", "rank", "places"])


def usable(labels):
    """id, good of the labels that may be learned from: one row for each id with one label of 0 or 1 outside the held-out part."""
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("good"))
    rows = rows.where(F.col("good").isin(0, 1) & (remainder(F.col("id")) != HELD_OUT))
    return rows.groupBy("id").agg(F.min("good").alias("good"), F.max("good").alias("other")).where("good = other").drop("other")


def training_texts(docs, labels):
    """id, good, rank, places of the sampled texts. The sample is ids of fixed number, so it is broadcast."""
    known = usable(labels).withColumn("rank", F.xxhash64(F.lit("quality"), "id"))
    sample = F.broadcast(known.orderBy("rank", "id").limit(MOST_TEXTS))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), whole_text().alias("text"))
    texts = texts.join(sample, "id").select("id", "good", "rank", "text")
    return texts.mapInArrow(_found, "id bigint, good int, rank bigint, places array<int>")


def _narrowed(kept):
    """The sampled texts with the kept places alone."""

    def run(batches):
        held = np.zeros(PLACES, bool)
        held[kept] = True
        for batch in batches:
            lists = batch.column(2)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            places = lists.values.to_numpy()[bounds[0] : bounds[-1]]
            inside = np.flatnonzero(held[places])
            cut = np.searchsorted(inside, bounds - bounds[0]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(places[inside]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(cut)), lists], names=["good", "rank", "n", "places"])

    return run


def trained(docs, labels):
    """A model from the bounded sample."""
    sample = written(training_texts(docs, labels), "training")
    n, share = sample.agg(F.count("*"), F.avg("good")).first()
    if not n or share in (0.0, 1.0):
        share = 0.5 if share is None else share
        return Model(np.zeros(PLACES), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    counts = sample.select("good", F.explode("places").alias("place")).groupBy("place").agg(F.sum("good").alias("p"), F.count("*").alias("n"))
    counts = counts.where(F.col("n") >= LEAST_TEXTS).orderBy("place").toArrow()  # PLACES rows at most
    kept, p, all_ = (counts.column(c).to_numpy().astype(np.int64) for c in ("place", "p", "n"))
    rows = written(sample.select("good", "rank", "places").mapInArrow(_narrowed(kept), "good int, rank bigint, n int, places array<int>"), "narrowed")
    sizes = rows.groupBy("rank").agg(F.sum(F.col("n") + 1).alias("n")).orderBy("rank").toArrow()  # a row per id, so MOST_TEXTS at most
    ranks, size = sizes.column("rank").to_numpy(), sizes.column("n").to_numpy()
    size = np.where(size <= MOST_ENTRIES // 100, size, 0)
    chosen = ranks[(size > 0) & (np.cumsum(size) <= MOST_ENTRIES)]
    chosen = sample.sparkSession.createDataFrame(pa.table({"rank": pa.array(chosen, pa.int64())}))
    rows = rows.join(F.broadcast(chosen), "rank", "left_semi").orderBy("rank", "n").toArrow()
    lists = rows.column("places").combine_chunks()
    bounds = lists.offsets.to_numpy().astype(np.int64)
    places = lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
    calibrating = rows.column("rank").to_numpy() % 5 == 0
    return fit(rows.column("good").to_numpy() == 1, calibrating, places, bounds - bounds[0], kept, log_count_ratios(p, all_ - p))


def scored(rows, model, text):
    """The column `score` for texts, by the workers."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # PLACES weights

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], names=["text"])
        parts = [shared.value.scores(some.column(0)) for some in arrays.slices(batch)]
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    return rows.withColumn("score", score(text))


def quality(docs, labels, threshold=THRESHOLD):
    """doc_id, held_out, score, predicted of each row."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = scored(rows, trained(docs, labels), F.col("text"))
    held_out = F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs, labels, threshold=THRESHOLD):
    """The rows of `docs` whose score reaches the threshold."""
    rows = scored(docs.select(row_of(docs.columns), whole_text().alias("text")), trained(docs, labels), F.col("text"))
    return unpacked(rows.where(F.col("score") >= threshold), docs.columns)
