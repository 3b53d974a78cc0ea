"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight schedule over training progress 0 to 1, piecewise linear between knots. Its integral is the
source's weight; the weights share all words, and a target stops at `max_passes` times its source, the excess going to the
others by weight. A source is a stream of its documents in the order of a hash, pass after pass. The point at which
that stream's cumulative demand (the integral of the schedule, scaled to the target) reaches a document's words is the document's
training position: the inverse of a quadratic on one segment. Documents are then sorted by range of position.

The running sum inside a source is taken in buckets of the hash, with one small sum per (source, bucket) carried across, so a
source with a third of all rows is many tasks. The words taken from a source are its target rounded down: the
last pass cuts the one document at which the demand ends.

Defined results: a null text has size 0, a null source is a source of its own and comes last, rows with equal ids are
ordered by size and text, and rows equal in all of that are interchangeable. No words at all: all targets are 0. Empty
tables give empty results. Rerunning gives the same rows.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.llm.columns import WORD, row_of, unpacked, whole_text

# Fixed values of the query: weights by rank of the source, and how far a schedule starts above its mean.
WEIGHTS = (1, 2, 3)
TILTS = (0.5, 0.0, -0.5)
MAX_PASSES = 3
SEED = "mix"


def schedules(weights=WEIGHTS, tilts=TILTS):
    """Knots (progress, weight) per class of source; each integrates to its weight."""
    return [[(0.0, w * (1 + t)), (1.0, w * (1 - t))] for w, t in zip(weights, tilts)]


def integral(knots):
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))


def _inverse(share, knots):
    """Column: the progress at which this share of the schedule's integral is reached."""
    total, before, out = integral(knots), 0.0, None
    for (u0, w0), (u1, w1) in zip(knots, knots[1:]):
        area = (u1 - u0) * (w0 + w1) / 2
        need = share * F.lit(total) - F.lit(before)
        slope = (w1 - w0) / (u1 - u0)
        # from w0*x + slope*x^2/2 = need, in the form that stays exact when the slope is small
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0)))
        here = F.lit(u0) + F.when(need <= 0, 0.0).otherwise(F.lit(2.0) * need / (F.lit(w0) + root))
        here = F.least(here, F.lit(u1))
        out = here if out is None else F.when(share * F.lit(total) <= F.lit(before), out).otherwise(here)
        before += area
    return out


def _keyed(docs, keep):
    """row (the columns `keep`), source, size, bucket and order of every document."""
    rows = docs.select(
        row_of(keep),
        F.col("source").alias("source"),
        # the source as a key without nulls: the join and the window below share one shuffle
        F.when(F.col("source").isNull(), "none").otherwise(F.concat(F.lit("of "), F.col("source"))).alias("stream"),
        F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat_ws("|", F.lit(SEED), F.col("doc_id"))).alias("order"),
        F.xxhash64(whole_text()).alias("tie"),
    )
    return rows.withColumn("bucket", F.substring("order", 1, 3))


def targets(sizes, weights=None, max_passes=MAX_PASSES):
    """source, class, weight, source_size, target from rows (source, source_size): one row per source, also in the window.

    Sources are filled in the order in which they reach their limit, which is where repeated resharing ends.
    """
    weights = weights or [integral(k) for k in schedules()]
    ranked = sizes.withColumn("class", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("class") + 1))
    ranked = ranked.withColumn("most", F.col("source_size") * max_passes)
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = ranked.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))).alias("words_left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
    )
    full = F.col("most") * F.col("weight_left") <= F.col("words_left") * F.col("weight")
    # the first source that is not filled has the largest weight left
    ranked = ranked.withColumn("full", full).withColumn(
        "open", F.max(F.when(~full, F.struct("weight_left", "words_left"))).over(everything)
    )
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(
        F.col("open.words_left").cast("double") * F.col("weight") / F.col("open.weight_left")
    )
    return ranked.select("source", "class", "weight", "source_size", target.alias("target"))


def mix_plan(docs, knots=None, max_passes=MAX_PASSES, keep=("doc_id",)):
    """row (a struct of the columns `keep`), size, source_size, target, taken, and `visits`: (pass, words, position) of each time a document is read."""
    knots = knots or schedules()
    rows = _keyed(docs, keep)
    sums = rows.groupBy("source", "stream", "bucket").agg(F.sum("size").alias("words"))
    sources = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), [integral(k) for k in knots], max_passes)
    earlier = Window.partitionBy("stream").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    sums = sums.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select(
        "stream", "bucket", "base", "class", "source_size", "target"
    )
    rows = rows.join(sums, ["stream", "bucket"])
    inside = Window.partitionBy("stream", "bucket").orderBy("order", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumn("passes", passes)
    rest = F.floor("target").cast("long") - F.col("passes") * F.col("source_size")
    rows = rows.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start"))))
    rows = rows.withColumn("taken", F.col("passes") * F.col("size") + F.col("extra"))
    turns = F.transform(F.sequence(F.lit(0).cast("long"), "passes"), lambda p: F.struct(
        p.alias("turn"), F.when(p < F.col("passes"), F.col("size")).otherwise(F.col("extra")).alias("words")))

    def placed(turn):
        at = turn["turn"] * F.col("source_size") + F.col("start") + turn["words"] / 2
        share = F.when(F.col("target") > 0, F.least(at / F.col("target"), F.lit(1.0))).otherwise(0.0)
        position = F.lit(None).cast("double")
        for c, k in enumerate(knots):
            position = F.when(F.col("class") == c, _inverse(share, k)).otherwise(position)
        return F.struct(turn["turn"].alias("turn"), turn["words"].alias("words"), position.alias("position"))

    visits = F.transform(F.filter(turns, lambda t: t["words"] > 0), placed)
    return rows.select("row", "size", "source_size", "target", "taken", visits.alias("visits"), "order")


def mixed(docs, knots=None, max_passes=MAX_PASSES):
    """The documents in training order, with their columns: a row for each time a document is read.

    The document at which a source's demand ends is cut after its last word there. Documents without words carry no demand and go.
    """
    rows = mix_plan(docs, knots, max_passes, docs.columns).select("row", "size", "order", F.explode("visits").alias("visit"))
    cut = F.expr(r"regexp_extract(row.text, concat('^(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++){', visit.words, '}+'), 0)")
    text = F.when(F.col("visit.words") < F.col("size"), cut).otherwise(F.col("row.text"))
    rows = rows.withColumn("row", F.col("row").withField("text", text))
    rows = rows.repartitionByRange(F.col("visit.position"), F.col("order"))
    return unpacked(rows.sortWithinPartitions("visit.position", "order", "visit.turn"), docs.columns)
