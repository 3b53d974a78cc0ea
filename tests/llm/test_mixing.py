"""Mixing against plain resharing, and positions against numeric integration."""

import re
from collections import defaultdict

import numpy as np
import pytest
from odd import ODD
from pyspark.sql import functions as F

from quillspark.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_targets(sizes):
    """The rule step by step: share by weight, stop at three times the size, share the excess among the others, again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    full = {}
    while True:
        left, rest = sum(sizes.values()) - sum(full.values()), [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        above = [s for s in rest if share[s] > 3 * sizes[s]]
        if not above:
            return {**full, **share}
        full.update({s: 3 * sizes[s] for s in above})


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5, "d": 100, None: 3}, {"a": 0, "b": 7}, {"a": 5}, {"z": 1, "y": 1, "x": 1}, {f"s{i}": (i * 37) % 101 for i in range(40)},
])
def test_targets_are_those_of_repeated_resharing(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


ROWS = [*((i, t, f"s{i % 4}") for i, t in enumerate(ODD) if not t or len(t) < 60_000), (20, "a b c", None), (20, "a b c", None), (None, "x y", None), (21, "q", ""), (22, None, "e")]
ROWS += [(30 + i, "w " * (i % 50), "big") for i in range(200)]


def test_taken_words_of_odd_rows(table):
    docs = table([(*r, "t", 2) for r in ROWS], "doc_id bigint, text string, source string, target string, bucket int")
    plan = mixing.mix_plan(docs, keep=("doc_id", "source")).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += len(WORD.findall(t or ""))
    want = plain_targets(sizes)
    for r in plan:
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        taken[r.source] += r.taken
    assert len(plan) == len(ROWS) and all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix_plan(docs.repartition(5), keep=("doc_id", "source")).select("row.doc_id", "row.source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))


def test_mixed_rows(table):
    docs = table([(*r, "t", 2) for r in ROWS], "doc_id bigint, text string, source string, visit string, order int")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    texts = {(i, s): t for i, t, s in ROWS}
    words, cut = defaultdict(int), defaultdict(int)
    for r in out.collect():
        assert texts[r.doc_id, r.source].startswith(r.text)
        cut[r.source] += r.text != texts[r.doc_id, r.source]
        words[r.source] += len(WORD.findall(r.text))
    plan = {r.source: r.target for r in mixing.mix_plan(docs, keep=("source",)).select("row.source", "target").distinct().collect()}
    assert max(cut.values()) <= 1 and all(abs(words[s] - t) <= 1 for s, t in plan.items())


def test_empty_tables(table):
    empty = table([], "doc_id bigint, text string, source string")
    assert mixing.mix_plan(empty).count() == 0 and mixing.mixed(empty).count() == 0
    nothing = table([(1, None, "a"), (2, " ", None)], "doc_id bigint, text string, source string")
    assert [r.taken for r in mixing.mix_plan(nothing).collect()] == [0, 0] and mixing.mixed(nothing).count() == 0


def test_positions_invert_the_demand(spark):
    knots = [(0.0, 2.0), (0.3, 0.5), (0.6, 0.5), (1.0, 4.0)]
    shares = [0.0, 0.01, 0.2, 0.37, 0.5, 0.75, 0.9, 1.0]
    rows = spark.createDataFrame([(s,) for s in shares], "share double")
    got = [r.p for r in rows.select("share", mixing._inverse(F.col("share"), knots).alias("p")).orderBy("share").collect()]
    grid = np.linspace(0, 1, 200_001)
    demand = np.concatenate([[0], np.cumsum(np.interp((grid[1:] + grid[:-1]) / 2, *zip(*knots))) / 200_000])
    assert np.allclose(got, np.interp(np.array(shares) * demand[-1], demand, grid), atol=1e-4)


def test_heavier_sources_come_later(table):
    rows = [(i, "w " * 20, s) for i, s in enumerate("abc" * 400)]
    plan = mixing.mix_plan(table(rows, "doc_id bigint, text string, source string"), keep=("source",))
    mean = {r.source: r.m for r in plan.select("row.source", F.explode("visits").alias("v")).groupBy("source").agg(F.avg("v.position").alias("m")).collect()}
    assert mean["a"] < 0.45 < mean["b"] < 0.55 < mean["c"]
