"""Vector codes and clustering against plain loops and, in test_queries, against SQL on the given vectors."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import centroids, vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def nearest(row, entries):
    return min((apart(row, e), i) for i, e in enumerate(entries))


def means(rows, at, entries):
    out = []
    for i, old in enumerate(entries):
        mine = [r for r, a in zip(rows, at) if a == i]
        out.append([sum(c) // len(mine) for c in zip(*mine)] if mine else old)
    return out


def whole(rows, scale):
    return [(r[0], [math.floor(scale * float(np.float32(x))) for x in r[1]], r[2]) for r in rows
            if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def plain_codes(rows, parts, entries, rounds):
    kept = sorted((r for r in whole(rows, 1024) if r[1]), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[r[1][p * width : (p + 1) * width] for r in kept] for p in range(parts)]
    books = [c[:entries] for c in cut]
    for _ in range(rounds):
        books = [means(c, [nearest(r, b)[1] for r in c], b) for c, b in zip(cut, books)]
    found = [[nearest(r, b) for r in c] for c, b in zip(cut, books)]
    errors = [sum(f[i][0] for f in found) for i in range(len(kept))]
    labels = {}
    for (_, _, label), e in zip(kept, errors):
        labels[label] = labels.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(kept[i][0], "".join(f"{f[i][1]:02x}" for f in found), errors[i], labels[kept[i][2]], sha) for i in range(len(kept))]


def plain_clusters(rows, k, rounds, dimensions):
    kept = [r for r in whole(rows, 256) if len(r[1]) == dimensions]
    sha = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    points = [r[1] for r in kept]
    middle = [r[1] for r in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]
    for _ in range(rounds):
        middle = means(points, [nearest(p, middle)[1] for p in points], middle)
    found = [nearest(p, middle) for p in points]
    total = {}
    for d, c in found:
        total[c] = total.get(c, 0) + d
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    return [(r[0], c, d, total[c], sum(total.values()), names[c]) for r, (d, c) in zip(kept, found)]


def rows_of(rng, n, dimensions):
    """Vectors of which many share parts, some are repeated, and some cannot be kept."""
    values = np.round(rng.normal(0, 0.1, (n, dimensions)), 2)
    values[:: 3, : dimensions // 2] = values[0, : dimensions // 2]
    rows = [(int(i), [float(x) for x in v], int(i) % 3 if i % 5 else None) for i, v in enumerate(values)]
    rows += rows[:7] + [(3, rows[20][1], 1), (None, rows[21][1], None), (None, rows[22][1], 9)]
    bad = [None, [], [None] * dimensions, [NAN] + [0.0] * (dimensions - 1), [0.0] * (dimensions - 1) + [INF], [-INF] * dimensions]
    return rows + [(-1 - i, b, 1) for i, b in enumerate(bad)]


def same(got, expected):
    key = lambda r: tuple((x is None, x) if x is not None else (True, 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_codes_of_odd_rows(table):
    rows = rows_of(np.random.default_rng(1), 150, 16)
    wide = table([(*r, "x", 1) for r in rows], SCHEMA + ", code string, of int")
    same(vector_codes.compressed(wide, entries=20, rounds=3).collect(), plain_codes(rows, 4, 20, 3))
    # a length that parts do not divide, or a rare one, goes; more entries than vectors
    few = rows[:9] + [(500, [0.5] * 6, 1), (501, [0.5] * 8, 1)]
    same(vector_codes.compressed(table(few, SCHEMA)).collect(), plain_codes(rows[:9], 4, 256, 4))


@pytest.mark.parametrize("rows", [[], [(1, None, 1), (2, [], 1), (3, [NAN] * 4, None)]])
def test_nothing_to_keep(table, rows):
    for out in (vector_codes.compressed(table(rows, SCHEMA)), centroids.clustered(table(rows, SCHEMA))):
        assert out.count() == 0 and len(out.columns) > 4


def test_too_large_components_are_an_error(table):
    big = table([(1, [1e30] * 64, 1)], SCHEMA)
    for run in (vector_codes.compressed, centroids.clustered):
        with pytest.raises(Exception, match="beyond"):
            run(big).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-6, 6), min_size=3, max_size=3), min_size=1, max_size=40), st.integers(1, 30))
def test_equal_average_search_finds_the_first_nearest(rows, size):
    rows = np.array(rows, np.int64)
    entries = rows[np.arange(size) % len(rows)] // 2
    at, distance = vector_codes.nearest(rows, entries)
    assert [(d, i) for i, d in zip(at.tolist(), distance.tolist())] == [nearest(r, entries.tolist()) for r in rows.tolist()]


def test_decoding_gives_the_error_back(spark, table):
    rows = rows_of(np.random.default_rng(3), 60, 8)
    kept, width = vector_codes.whole_vectors(table(rows, SCHEMA))
    books = vector_codes.codebooks(kept, width, entries=10)
    for r in vector_codes.encoded(kept, books).join(kept, "vec_id").where("vec_id > 10").collect():
        codes = np.frombuffer(bytes.fromhex(r.code), np.uint8).reshape(1, -1)
        assert apart(books.decoded(codes)[0].tolist(), r.v) == r.error


def test_clusters_of_odd_rows(table):
    rows = rows_of(np.random.default_rng(2), 150, 64) + [(900, [0.1] * 63, 1), (901, [0.1] * 65, 1)]
    wide = table([(*r, "x", 1) for r in rows], SCHEMA + ", ids string, cluster int")
    same(centroids.clustered(wide, k=12, chunk=17, block=3).collect(), plain_clusters(rows, 12, 5, 64))
    same(centroids.clustered(table(rows[:5], SCHEMA)).collect(), plain_clusters(rows[:5], 40, 5, 64))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=5, max_size=5), min_size=1, max_size=30), st.integers(1, 6))
def test_dictionaries_lose_nothing(rows, block):
    rows = np.array(rows, np.int64)
    blocks = centroids.encode(rows, block)
    assert (centroids.decode(blocks) == rows).all()
    assert all(len(np.unique(e, axis=0)) == len(e) for e, _ in blocks)
    middle = rows[:: 3]
    cluster, distance = centroids.nearest(blocks, middle)
    assert [(d, i) for i, d in zip(cluster.tolist(), distance.tolist())] == [nearest(r, middle.tolist()) for r in rows.tolist()]
    sums = centroids.cluster_sums(blocks, cluster, len(middle))
    assert all((sums[c] == rows[cluster == c].sum(axis=0)).all() for c in range(len(middle)))
