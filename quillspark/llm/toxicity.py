"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives; all other text is unlabelled, not clean. A linear classifier is trained with numpy on the
class-prior-corrected risk  prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]): when the second part goes below zero, the
step goes back on it, so that the classifier cannot overfit the positives hidden in the unlabelled text.

Features are hashes of lower-case words and of their first four to six bytes, present or not, in 2^20 places. The features kept are those that tell positives from
unlabelled texts beyond chance on the training texts. Training takes bounded samples, chosen by a hash of the id: at most `MOST_POSITIVE`
and about `MOST_UNLABELLED` texts, of which the driver gets the kept features; scores are computed for every row by the workers.

Defined results: null and empty texts are scored by the bias alone. A row without an id is scored, but never trained on. Without positives (an empty
table of labels) every score is the prior 0. Equal texts have equal scores. An empty table gives an empty result. Ids that are labelled both
ways count as toxic.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import arrays
from quillspark.llm.columns import row_of, unpacked, whole_text
from quillspark.session import written

PLACES = 1 << 20
MOST_POSITIVE = 4_000
MOST_UNLABELLED = 12_000
MOST_FEATURES = 4_096
SIGNIFICANT = 6.0
STEPS = 800
HELD_OUT = 5
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PREFIXES = (4, 5, 6)


def remainder(doc_id):
    """crc32 of the id as text, modulo 5: rows with 0 are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT


def _all_features(column):
    """Places of all features of each text, in the order of its words, and their bounds."""
    data, offsets = arrays.text_buffer(column)
    starts, ends, bounds = arrays.words(data, offsets, _LETTERS)
    sums = arrays.prefix_sums(arrays.LOWER[data])
    places = np.empty((len(starts), 1 + len(_PREFIXES)), np.uint32)
    places[:, 0] = arrays.span_hashes(sums, starts, ends) & np.uint64(PLACES - 1)
    for i, n in enumerate(_PREFIXES, 1):
        prefix = arrays.span_hashes(sums, starts, np.minimum(starts + n, ends))
        places[:, i] = arrays.mixed(prefix + np.uint64(n)) & np.uint64(PLACES - 1)
    return places.ravel(), bounds * places.shape[1]


def features(column):
    """Places of the distinct features of each text, ascending, and their bounds."""
    return arrays.distinct(*_all_features(column))


def _found(batches):
    for batch in batches:
        for some in arrays.slices(batch):
            places, bounds = features(some.column(1))
            places = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(places.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([some.column(0), places], names=["positive", "places"])


def _sampled(rows, most):
    """About `most` of the rows, by a hash of their id: the same ones on every run."""
    share = min(1.0, most / max(rows.count(), 1))
    return rows.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(most + most // 4)


def training_texts(docs, labels):
    """positive, places of the sampled training texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).where(remainder(F.col("doc_id")) != 0)
    toxic = labels.where((F.col("toxic") == 1) & (remainder(F.col("doc_id")) != 0)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    toxic = _sampled(toxic, MOST_POSITIVE)  # bounded, so it is broadcast
    positive = docs.join(F.broadcast(toxic), "doc_id", "left_semi").select(F.lit(1).alias("positive"), "text")
    share = min(1.0, MOST_UNLABELLED / max(docs.count(), 1))
    chosen = F.pmod(F.xxhash64(F.lit("unlabelled"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    unlabelled = docs.where(chosen).select(F.lit(0).alias("positive"), "text")
    # copies teach nothing new, and would make chance words look significant
    return positive.unionByName(unlabelled).mapInArrow(_found, "positive int, places array<int>").distinct()


class Model:
    """Weights of the kept features (0 elsewhere) and a bias."""

    def __init__(self, weights, bias):
        self.weights, self.bias = weights, bias

    def scores(self, column):
        places, bounds = _all_features(column)
        weighed = np.flatnonzero(self.weights[places])
        places, bounds = arrays.distinct(places[weighed], np.searchsorted(weighed, bounds))
        sums = np.concatenate([[0.0], np.cumsum(self.weights[places], dtype=np.float64)])
        return 1 / (1 + np.exp(-np.clip(sums[bounds[1:]] - sums[bounds[:-1]] + self.bias, -40, 40)))


def kept_features(sample):
    """Places that positives hold more or less often than unlabelled texts, beyond chance; at most MOST_FEATURES reach the driver."""
    sizes = sample.agg(F.sum("positive"), F.count("*")).first()
    n = sizes[0] or 0
    m = sizes[1] - n
    if not n or not m:
        return np.zeros(0, np.int64)
    counts = sample.select("positive", F.explode("places").alias("place")).groupBy("place")
    counts = counts.agg(F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))
    mean = (F.col("p") + F.col("u") + 1) / (n + m + 2)
    apart = (F.col("p") + 0.5) / (n + 1) - (F.col("u") + 0.5) / (m + 1)
    z = F.abs(apart) / F.sqrt(mean * (1 - mean) * (1 / n + 1 / m))
    best = counts.select("place", z.alias("z")).where(F.col("z") > SIGNIFICANT).orderBy(F.desc("z"), "place").limit(MOST_FEATURES)
    return np.array([r.place for r in best.collect()], np.int64)


def _narrowed(kept):
    """The sampled texts with the kept places alone."""

    def run(batches):
        held = np.zeros(PLACES, bool)
        held[kept] = True
        for batch in batches:
            lists = batch.column(1)
            bounds = lists.offsets.to_numpy().astype(np.int64)
            places = lists.values.to_numpy()[bounds[0] : bounds[-1]]
            inside = np.flatnonzero(held[places])
            cut = np.searchsorted(inside, bounds - bounds[0]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cut), pa.array(places[inside]))], names=["positive", "places"])

    return run


def fit(positive, places, bounds, kept, prior, steps=STEPS, rate=0.05, decay=5e-4):
    """A model by gradient steps (Adam) on the non-negative risk, over all sampled texts at once."""
    positive = np.asarray(positive, bool)
    weights = np.zeros(PLACES, np.float32)
    if not positive.any() or positive.all():
        return Model(weights, -40.0)
    column = np.full(PLACES, -1, np.int32)
    column[kept] = np.arange(len(kept))
    doc = np.repeat(np.arange(len(positive), dtype=np.int32), np.diff(bounds))
    inside = column[places] >= 0
    doc, column = doc[inside], column[places[inside]]
    share_p, share_u = positive / positive.sum(), ~positive / (~positive).sum()
    w, b = np.zeros(len(kept)), float(np.log(prior / (1 - prior)))
    moments = [np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)]
    for t in range(1, steps + 1):
        g = np.clip(np.bincount(doc, weights=w[column], minlength=len(positive)) + b, -40, 40)
        down, up = 1 / (1 + np.exp(g)), 1 / (1 + np.exp(-g))
        negative_risk = share_u @ np.log1p(np.exp(g)) - prior * (share_p @ np.log1p(np.exp(g)))
        slope_n = (share_u - prior * share_p) * up
        slope = -prior * share_p * down + slope_n if negative_risk >= 0 else -slope_n
        step = np.append(np.bincount(column, weights=slope[doc], minlength=len(kept)) + decay * w, slope.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * step
        moments[1] = 0.999 * moments[1] + 0.001 * step**2
        move = rate * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights[kept] = w
    return Model(weights, float(b))


def class_prior(labels):
    """Share of toxic rows among the labels that may be used."""
    usable = labels.where(remainder(F.col("doc_id")) != 0).agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    return min(max(usable or 0.0, 1e-4), 0.9)


def trained(docs, labels):
    """A model from the bounded samples. Features are counted and chosen by Spark; the driver gets the chosen ones of each text."""
    sample = written(training_texts(docs, labels), "training")
    kept = kept_features(sample)
    rows = sample.mapInArrow(_narrowed(kept), "positive int, places array<int>").orderBy("positive", "places").toArrow()
    lists = rows.column("places").combine_chunks()
    bounds = lists.offsets.to_numpy().astype(np.int64) if len(lists) else np.zeros(1, np.int64)
    places = lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]] if len(lists) else np.zeros(0, np.int32)
    return fit(rows.column("positive").to_numpy().astype(bool), places, bounds - bounds[0], kept, class_prior(labels))


def scored(rows, model, text):
    """The column `score` for texts, by the workers."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # PLACES weights

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], names=["text"])
        parts = [shared.value.scores(some.column(0)) for some in arrays.slices(batch)]
        return pa.array(np.concatenate([np.zeros(0), *parts]))

    return rows.withColumn("score", score(text))


def toxicity(docs, labels):
    """doc_id, held_out, score, predicted of each row."""
    rows = docs.select("doc_id", whole_text().alias("text"))
    rows = scored(rows, trained(docs, labels), F.col("text"))
    held_out = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs, labels, threshold=0.5):
    """The rows of `docs` whose score is below the threshold."""
    rows = scored(docs.select(row_of(docs.columns), whole_text().alias("text")), trained(docs, labels), F.col("text"))
    return unpacked(rows.where(F.col("score") < threshold), docs.columns)
