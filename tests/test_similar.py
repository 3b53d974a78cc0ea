"""Near-duplicate classes against all pairs, the cut into bands, and contraction of links."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import similar
from quillspark.operators.links import classes


def plain_sets(text):
    words = (text or "").split(" ")
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) >= 3 else {tuple(words)}


def plain_classes(rows, percent):
    sets = [plain_sets(t) for _, _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if rows[i][1] == rows[j][1] and common * 100 >= (len(x) + len(sets[j]) - common) * percent:
                root[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(i)
    out = []
    for group in members.values():
        paths = [rows[i][0] for i in group if rows[i][0] is not None]
        out += [(rows[i][0], rows[i][1], len(sets[i]), min(paths, default=None), len(group)) for i in group]
    return out


def family(rng, size, edits, words=60):
    base = [f"w{rng.randrange(300)}" for _ in range(words)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"e{rng.randrange(40)}"
        yield " ".join(copy[rng.randrange(3) :])


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("percent", [90, 70])
def test_classes_are_those_of_all_pairs(spark, percent):
    rng = random.Random(percent)
    texts = [t for size, edits in ((40, 1), (60, 3), (40, 12)) for t in family(rng, size, edits)]
    texts += ["", None, "a", "a", "a b", "a  b", "a b c", "x " * 5000, "x " * 5000, *["same text that many rows hold"] * 30]
    rows = [(f"p{i:04d}", "train" if i % 3 else "valid", t) for i, t in enumerate(texts)]
    rows += [("p0001", "train", texts[5]), (None, "train", "a b c"), ("q", None, "a b c"), ("r", None, "a b c")]
    rng.shuffle(rows)
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows], "img_path string, split string, label string, n int, root string").repartition(5)
    got = similar.near_classes(wide, F.col("label"), percent).collect()
    assert by_text(got) == by_text(plain_classes(rows, percent))
    kept = similar.drop_near(wide, F.col("label"), percent)
    assert kept.columns == wide.columns
    assert {(r.img_path, r.split) for r in kept.collect()} == {(r[0], r[1]) for r in plain_classes(rows, percent) if r[0] == r[3]}


def test_empty_table(spark):
    none = spark.createDataFrame([], "img_path string, split string, label string")
    assert similar.near_classes(none, F.col("label")).count() == 0


def test_bands_find_what_they_promise(spark):
    bands, rows = similar.surest_cut(90)
    assert (1 - 0.9**rows) ** bands <= 1e-6 < (1 - 0.9 ** (rows + 1)) ** (64 // (rows + 1))
    # pairs of sets with a likeness of just 0.9: 18 of 20 shared
    rng = np.random.default_rng(1)
    pairs = [rng.integers(0, 2**62, 20) for _ in range(1500)]
    sets = [(2 * i + k, "s", 19, [int(x) for x in (p[:19] if k else p[1:])]) for i, p in enumerate(pairs) for k in (0, 1)]
    nodes = spark.createDataFrame(sets, "node long, split string, n int, grams array<bigint>")
    for cut, least in (((bands, rows), 1.0), ((16, 4), 0.999)):
        found = similar.similar_nodes(nodes, 90, cut).where("root = 2 * floor(node / 2)").count()
        assert found >= 2 * least * len(pairs)


def test_band_areas(spark):
    wanted = spark.createDataFrame([(0.9, 0.5, 0.5), (0.9, 0.01, 0.99)], "threshold double, false_weight double, miss_weight double")
    rows = similar.band_areas(wanted, steps=400).collect()
    assert len(rows) == 128 and sum(r.chosen for r in rows) == 2
    for r in rows:
        s = (np.arange(400) + 0.5) / 400
        p = 1 - (1 - s**r["rows"]) ** r.bands
        assert abs(r.false_area - p[s < 0.9].sum() / 400) < 2e-6 and abs(r.miss_area - (1 - p)[s >= 0.9].sum() / 400) < 2e-6
    # who minds misses more takes shorter rows
    chosen = {r.miss_weight: r["rows"] for r in rows if r.chosen}
    assert chosen[0.99] < chosen[0.5]


def test_classes_of_links(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 200)] + [(500, x) for x in range(501, 560)] + [(700, 900), (800, 900), (800, 600), (5, 5)]
    rng.shuffle(links)
    links = [x if rng.random() < 0.5 else x[::-1] for x in links]
    got = {(r.node, r.root) for r in classes(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(201)} | {(x, 500) for x in range(500, 560)} | {(x, 600) for x in (600, 700, 800, 900)}
    assert classes(spark.createDataFrame([], "a long, b long")).count() == 0


def test_only_sets_with_a_pair_move(spark, monkeypatch):
    """Sets are chosen by a bounded number of slots before they move; when slots are few, all sets move and the links are the same."""
    rows = [(f"p{i}", "train", " ".join(f"w{i // 2}x{j}" for j in range(60)) + (" end" if i % 2 else "")) for i in range(40)]
    rows += [(f"q{i}", "train", " ".join(f"v{i}x{j}" for j in range(60))) for i in range(40)] + [("c0", "train", "a b c d"), ("c1", "train", "a b c d")]
    df = spark.createDataFrame(rows, "img_path string, split string, label string")
    got = []
    for slots in (similar.SLOTS, 2):
        monkeypatch.setattr(similar, "SLOTS", slots)
        got.append(sorted(map(tuple, similar.near_classes(df, F.col("label")).collect())))
    assert got[0] == got[1]
    assert sum(r[4] == 2 for r in got[0]) == 42 and len(got[0]) == 82
