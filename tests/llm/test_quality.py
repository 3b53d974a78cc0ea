"""Quality: held-out accuracy, the parts of the method against plain versions, and that held-out labels teach nothing."""

import math
import zlib

import numpy as np
import pyarrow as pa
from odd import ODD
from pyspark.sql import functions as F

from quillspark.llm import quality, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op11_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    held = got[got.held_out & got.quality.notna()]
    assert held.predicted[held.quality == 1].mean() > 0.99 and held.predicted[held.quality == 0].mean() < 0.05


def plain_shape(word, before):
    kind = lambda b: 0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if b >= 128 else 4 if chr(b) in ".,;:!?'\"()-" else 5
    return (kind(word[0]), kind(word[min(1, len(word) - 1)]), kind(word[-1]), min(int(math.log2(len(word))), 5), word == before)


def test_indicators_are_those_of_plain_n_grams():
    texts = [t or "" for t in ODD if t is None or len(t) < 2000] + ["aB, aB, 12 x!! é|", "a b a b", "b a b a"]
    places, bounds = quality.indicators(pa.array(texts))
    names, of = {}, {}
    for i, text in enumerate(texts):
        words = [w for w in text.encode().translate(bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))).split(b" ") if w]
        shapes = [plain_shape(w, words[j - 1] if j else None) for j, w in enumerate(words)]
        grams = {("w", n, tuple(words[j : j + n])) for n in (1, 2) for j in range(len(words) - n + 1)}
        grams |= {("s", n, tuple(shapes[j : j + n])) for n in (1, 2, 3) for j in range(len(shapes) - n + 1)}
        mine = places[bounds[i] : bounds[i + 1]].tolist()
        assert len(mine) == len(grams)  # no two of these few fall together
        names[i], of[i] = grams, set(mine)
    for i in names:
        for j in names:
            assert len(names[i] & names[j]) == len(of[i] & of[j])


def test_log_count_ratios():
    p, q = np.array([3, 0, 7]), np.array([1, 5, 0])
    r = quality.log_count_ratios(p, q)
    for i in range(3):
        assert math.isclose(r[i], math.log((p[i] + 1) / 13) - math.log((q[i] + 1) / 9))


def test_descent_minimises_the_hinge_risk():
    rng = np.random.default_rng(4)
    n, d = 60, 6
    x = rng.normal(0, 1, (n, d)) * (rng.random((n, d)) < 0.6)
    good = (x @ rng.normal(0, 1, d) + rng.normal(0, 0.8, n)) > 0
    rows = [np.flatnonzero(r) for r in x]
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    w, b = quality.descend(np.concatenate([x[i, r] for i, r in enumerate(rows)]), np.concatenate(rows), bounds, good, d, passes=400)
    sign = np.where(good, 1, -1)
    risk = lambda v: 0.5 * v @ v + np.maximum(0, 1 - sign * (x @ v[:-1] + v[-1])).sum()
    # plain subgradient steps come no lower
    v, best = np.zeros(d + 1), np.inf
    full = np.column_stack([x, np.ones(n)])
    for t in range(1, 20_000):
        open_ = sign * (full @ v) < 1
        v = v - (v - (full * sign[:, None])[open_].sum(axis=0)) / (t + 50)
        best = min(best, risk(v))
    assert risk(np.append(w, b)) <= best * 1.001 and best <= risk(np.append(w, b)) * 1.05


def test_only_usable_labels_count(spark, table):
    rng = np.random.default_rng(0)
    word = lambda: " ".join(rng.choice([f"w{i}" for i in range(200)], 30))
    rows = [(i, word() + (" ###" if i % 4 == 0 else " fine")) for i in range(400)] + [(1000 + i, t) for i, t in enumerate(ODD)]
    docs = table([(i, t, "s", 5) for i, t in rows], "doc_id bigint, text string, score string, id int")
    labels = [(i, int(i % 4 != 0)) for i in range(250)]
    changed = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in labels]
    changed += changed[:5] + [(7000, 1), (None, 0), (1003, None), (1004, 5)]  # repeated, unknown and useless ones
    shape = "doc_id bigint, quality int"
    first, second = ({(r.doc_id, r.score) for r in quality.quality(docs, spark.createDataFrame(x, shape)).collect()} for x in (labels, changed))
    assert first == second
    found = {i for i, s in first if s >= 0.7}
    assert found >= {i for i in range(400) if i % 4} and not found & {i for i in range(400) if i % 4 == 0}
    kept = quality.keep_good(docs, spark.createDataFrame(labels, shape))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == found
    by_text = {}
    for i, s in first:
        by_text.setdefault(dict(rows)[i] or "", set()).add(s)
    assert all(len(x) == 1 for x in by_text.values())


def test_one_kind_of_labels_and_odd_ids(spark, table):
    shape = "doc_id bigint, quality int"
    docs = table([(None, "a"), (None, None), (1, "b"), (1, "b"), (2, "")])
    for labels, score in (([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0), ([(1, 0), (1, 1)], 0.5)):
        rows = quality.quality(docs, spark.createDataFrame(labels, shape)).collect()
        assert len(rows) == 5 and all(abs(r.score - score) < 1e-6 for r in rows)
        assert not any(r.held_out for r in rows if r.doc_id is None)
    mixed = quality.quality(docs, spark.createDataFrame([(1, 1), (3, 0), (5, 0)], shape))
    assert mixed.where(~F.col("score").between(0, 1)).count() == 0 and mixed.count() == 5
    assert quality.quality(table([]), spark.createDataFrame([(1, 1), (2, 0)], shape)).count() == 0


def test_the_driver_gets_a_bounded_number_of_indicators(spark, table, monkeypatch):
    """An id that many rows repeat is passed over, and no more entries than the bound come to the driver."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(["a", "b", "c", "d", "fine" if i % 2 else "###"], 8))) for i in range(300)] + [(5, "a b c d fine")] * 400
    monkeypatch.setattr(quality, "MOST_ENTRIES", 3000)
    got, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda good, calibrating, places, *rest: got.append(len(places)) or fit(good, calibrating, places, *rest))
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, quality int")
    out = quality.quality(table(rows), labels)
    assert out.count() == 700 and 1000 < got[0] <= 3000
