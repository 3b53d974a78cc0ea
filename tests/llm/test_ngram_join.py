"""The similarity join against all pairs of plain sets."""

import numpy as np
from odd import ODD
from pyspark.sql import functions as F

from quillspark.llm import ngram_join, queries
from quillspark.llm.components import components


def plain_sets(texts, k):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def plain_components(rows, k, percent):
    sets = plain_sets([t for _, t in rows], k)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = {}
    for i, s in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    tried = set()
    for i, s in enumerate(sets):
        for j in {j for x in s for j in lists[x] if j < i}:
            common = len(s & sets[j])
            if 100 * common >= percent * (len(s) + len(sets[j]) - common) and (i, j) not in tried:
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    least = {r: min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for r, g in groups.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def check(rows, out, k, percent):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()), key=key)
    assert got == sorted(plain_components(rows, k, percent), key=key)


def test_the_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, queries.op4_ngram_join(spark, sf), 3, 90)


def family(rng, size, edits):
    base = [f"w{x}" for x in rng.integers(0, 400, 90)]
    out = []
    for _ in range(size):
        words = list(base)
        for _ in range(rng.integers(0, edits + 1)):
            words[rng.integers(len(words))] = f"e{rng.integers(0, 30)}"
        out.append(" ".join(words[rng.integers(0, 4) : len(words) - rng.integers(0, 12)]))
    return out


def test_families_of_near_copies(table):
    rng = np.random.default_rng(5)
    texts = [t for size, edits in ((60, 3), (60, 9), (30, 1), (40, 20)) for t in family(rng, size, edits)]
    texts += ["a b c d", "a b c d e", "A  b c\td", "a b", "a b", "b a"] + [" ".join(f"u{i}x{j}" for j in range(50)) for i in range(40)]
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[j]) for i, j in enumerate(order)]
    for k, percent in ((3, 90), (5, 80)):
        out = ngram_join.near_components(table([(i, t, 1, "z") for i, t in rows], "doc_id bigint, text string, node int, root string"), k, percent)
        check(rows, out, k, percent)


def test_odd_rows(spark, table):
    rows = list(enumerate(ODD)) + [(None, "one"), (None, "q r s t"), (None, "q r s t"), (3, ""), (7, "a b c d e f g")]
    check(rows, ngram_join.near_components(table(rows), 3, 90), 3, 90)
    assert ngram_join.near_components(table([]), 3, 90).count() == 0
    wide = table([(i, t, "s", 2) for i, t in rows], "doc_id bigint, text string, mark string, id int")
    kept = ngram_join.drop_near(wide)
    assert kept.columns == wide.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sum(t is None or not t.strip(" \t\n\x0b\x0c\r") for _, t in got) == sum(t is None or not t.strip(" \t\n\x0b\x0c\r") for _, t in rows)
    words = [(i, t) for i, t in got if t and t.strip(" \t\n\x0b\x0c\r")]
    assert [i for i, t in words if t == "one"] == [4] and [i for i, t in words if t == "q r s t"] == [None]
    assert [i for i, t in words if t == "a b c d e f g"] == [7]
    assert ngram_join.drop_near(table([])).count() == 0


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (3, 1), (20, 21), (21, 22), (22, 20)] + [(100 + i, 101 + i) for i in range(40)]
    got = {(r.node, r.root) for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {(5, 1), (4, 1), (3, 1), (9, 8), (21, 20), (22, 20)} | {(101 + i, 100) for i in range(40)}


def test_bounds_lose_nothing():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64)
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, rng.integers(0, 20)).astype(np.uint64)]))
        a = np.unique(a)
        both = np.concatenate([a, b])
        sketch = ngram_join.parity_sketches(both, np.array([0, len(a), len(both)])).view(np.uint64)
        differing = sum(bin(int(x)).count("1") for x in sketch[0] ^ sketch[1])
        assert differing <= len(np.setxor1d(a, b))
        x, y = ngram_join.sized_sketches(both, np.array([0, len(a), len(both)]))
        assert ngram_join.differing_bits(x, y) <= len(np.setxor1d(a, b)) and ngram_join.differing_bits(x, x) == 0


def test_lists_of_the_same_members_are_joined_once(spark, table):
    """Texts that are alike below the threshold share many tokens. The parts of a pair are two rows, not one per token."""
    rng = np.random.default_rng(8)
    shared = [f"p{x}" for x in range(300)]
    rows = [(i, " ".join(shared + [f"u{i}x{j}" for j in rng.integers(0, 10**6, 40)])) for i in range(6)]
    join = ngram_join._Join(table(rows), 5, 80)
    entries = join.entries()
    seen = []
    join.nodes = join.nodes.withColumns({s: F.lit(0).cast("long") for s in ngram_join._PARTS})  # no pair is ruled out
    kept, ngram_join.written = ngram_join.written, lambda df, name: seen.append((name, kept(df, name))) or seen[-1][1]
    try:
        pairs = join.across(entries, components(entries.select("node", "leader").toDF("a", "b").where("a < a")))
    finally:
        ngram_join.written = kept
    mixed = dict(seen)["mixed"]
    assert mixed.select("token").distinct().count() < entries.select("token").distinct().count() == mixed.select("token", "lists").distinct().agg(F.sum("lists")).first()[0]
    plain = entries.select("token", F.col("node").alias("a")).join(entries.select("token", F.col("node").alias("b")), "token").where("a < b")
    asked = entries.groupBy("node").agg(F.first("matches").alias("m"))
    plain = plain.groupBy("a", "b").count().join(asked.toDF("a", "m"), "a").join(asked.toDF("b", "k"), "b").where("count >= least(m, k)")
    assert sorted(map(tuple, pairs.collect())) == sorted((r.a, r.b) for r in plain.collect()) != []


def test_sketches_tell_long_sets_apart():
    """Sets of 900 shingles whose likeness is 0.63 are ruled out at 0.8 by the sketch alone."""
    rng = np.random.default_rng(3)
    a, more = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64)), rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.unique(np.concatenate([a[: len(a) * 773 // 1000], more[: len(a) * 227 // 1000]]))
    x, y = ngram_join.parity_sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    assert int(np.bitwise_count(x ^ y).sum()) * 180 > (len(a) + len(b)) * 20
