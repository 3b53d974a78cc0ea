"""Toxicity: held-out accuracy, and that held-out labels teach nothing."""

import zlib

import numpy as np
from odd import ODD
from pyspark.sql import functions as F

from quillspark.llm import queries, toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out & got.toxic.notna()]
    assert held.predicted[held.toxic == 1].mean() > 0.85 and held.predicted[held.toxic == 0].mean() < 0.02


def test_only_usable_labels_count(spark, table):
    rng = np.random.default_rng(0)
    word = lambda: " ".join(rng.choice([f"w{i}" for i in range(300)], 30))
    rows = [(i, word() + (" scum moron" if i % 4 == 0 else "")) for i in range(400)] + [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = table([(i, t, "s") for i, t in rows], "doc_id bigint, text string, score string")
    labels = [(i, int(i % 4 == 0)) for i in range(200)]
    changed = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    first, second = ({(r.doc_id, r.score) for r in toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id bigint, toxic int")).collect()} for x in (labels, changed))
    assert first == second
    found = {i for i, s in first if s >= 0.5}
    assert found >= {i for i in range(0, 400, 4)} and not found & {i for i in range(400) if i % 4}
    none = toxicity.toxicity(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert none.where("predicted = 1").count() == 0 and none.count() == len(rows)
    kept = toxicity.drop_toxic(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - found


def test_empty_and_null_ids(spark, table):
    labels = spark.createDataFrame([(1, 1), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.toxicity(table([]), labels).count() == 0
    rows = toxicity.toxicity(table([(None, "a"), (None, None), (1, "b"), (1, "b"), (2, "")]), labels).where(~F.col("score").between(0, 1)).count()
    assert rows == 0


def test_risk_does_not_fall_below_zero():
    rng = np.random.default_rng(1)
    positive = np.r_[np.ones(200, bool), np.zeros(2000, bool)]
    rows = [rng.integers(0, 5000, 40) for _ in positive]
    for i in range(len(rows)):
        if positive[i] or i % 10 == 0:
            rows[i] = np.r_[rows[i], 7777]
    places = np.concatenate([np.unique(r) for r in rows])
    bounds = np.r_[0, np.cumsum([len(np.unique(r)) for r in rows])]
    model = toxicity.fit(positive, places, bounds, np.array([7777, 1, 2, 3]), 0.1)
    marked = model.weights[7777] + model.bias
    assert marked > 0 > model.bias


def plain_fit(positive, rows, kept, prior, steps, rate=0.05, decay=5e-4):
    """The same steps by loops over texts: each term of the risk on its own."""
    import math

    column = {place: j for j, place in enumerate(kept)}
    docs = [[column[p] for p in r if p in column] for r in rows]
    n_p, n_u = sum(positive), len(positive) - sum(positive)
    w, b = [0.0] * len(kept), math.log(prior / (1 - prior))
    first, second = [0.0] * (len(kept) + 1), [0.0] * (len(kept) + 1)
    risks = []
    for t in range(1, steps + 1):
        loss_p, loss_p_negative, loss_u = 0.0, 0.0, 0.0  # means of log(1 + e^-g) over positives, and of log(1 + e^g) over both kinds
        slopes_p, slopes_n = [0.0] * len(docs), [0.0] * len(docs)
        for i, d in enumerate(docs):
            g = sum(w[j] for j in d) + b
            if positive[i]:
                loss_p += math.log1p(math.exp(-g)) / n_p
                loss_p_negative += math.log1p(math.exp(g)) / n_p
                slopes_p[i] = -prior / n_p / (1 + math.exp(g))
                slopes_n[i] = -prior / n_p / (1 + math.exp(-g))
            else:
                loss_u += math.log1p(math.exp(g)) / n_u
                slopes_n[i] = 1 / n_u / (1 + math.exp(-g))
        negative = loss_u - prior * loss_p_negative
        risks.append(prior * loss_p + max(negative, 0.0))
        slopes = [p + n if negative >= 0 else -n for p, n in zip(slopes_p, slopes_n)]
        step = [decay * x for x in w] + [sum(slopes)]
        for i, d in enumerate(docs):
            for j in d:
                step[j] += slopes[i]
        for j, x in enumerate(step):
            first[j] = 0.9 * first[j] + 0.1 * x
            second[j] = 0.999 * second[j] + 0.001 * x * x
            move = rate * (first[j] / (1 - 0.9**t)) / (math.sqrt(second[j] / (1 - 0.999**t)) + 1e-8)
            if j < len(w):
                w[j] -= move
            else:
                b -= move
    return w, b, risks


def test_fit_takes_the_steps_of_the_plain_risk():
    rng = np.random.default_rng(5)
    positive = np.r_[np.ones(12, bool), np.zeros(40, bool)]
    rows = [sorted({*rng.choice(30, 6).tolist(), *([31] if p or i % 7 == 0 else [])}) for i, p in enumerate(positive)]
    kept = np.array([31, 2, 5, 9, 11])
    model = toxicity.fit(positive, np.concatenate(rows), np.r_[0, np.cumsum([len(r) for r in rows])], kept, 0.2, steps=150)
    w, b, risks = plain_fit(positive.tolist(), rows, kept.tolist(), 0.2, 150)
    assert np.allclose(model.weights[kept], w, atol=1e-4) and abs(model.bias - b) < 1e-4
    assert min(risks) >= 0 and risks[-1] < risks[0]


def test_features_are_those_of_plain_words():
    """Texts share as many feature places as they share words and beginnings of words."""
    import re

    import pyarrow as pa

    texts = [t or "" for t in ODD if t is None or len(t) < 2000] + ["Scum scumbag, moronic MORON x1", "moronic scum"]
    places, bounds = toxicity.features(pa.array(texts))
    names = []
    for text in texts:
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())
        words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
        names.append({("", w) for w in words} | {(n, w[:n]) for w in words for n in (4, 5, 6)})
    found = [set(places[a:b].tolist()) for a, b in zip(bounds, bounds[1:])]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(found[i] & found[j]) == len(names[i] & names[j])
