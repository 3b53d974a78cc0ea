"""Repeated strings against a plain count of all windows."""

import hashlib

import numpy as np
import pytest
from odd import ODD

from quillspark.llm import queries, suffix_dedup


def plain(texts, window):
    raw, seen = [(t or "").encode() for t in texts], {}
    for b in raw:
        for i in range(len(b) - window + 1):
            seen[b[i : i + window]] = seen.get(b[i : i + window], 0) + 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), edges[::2].tolist(), edges[1::2].tolist()))
    return out


def check(rows, out, window=200):
    got = sorted(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in out.collect())
    assert got == sorted((i, *p[:4]) for (i, _), p in zip(rows, plain([t for _, t in rows], window)))


def test_the_documents(spark, documents):
    check([(r.doc_id, r.text) for r in documents], queries.op9_suffix_dedup(spark, "/root/testdata/sf0.001"))


def test_odd_rows(table):
    rows = list(enumerate(t for t in ODD if not t or len(t) < 60_000)) + [(3, "one"), (900, "p" * 199), (901, "q" * 200), (902, "r" * 201)]
    docs = table([(i, t, "d", 1) for i, t in rows], "doc_id bigint, text string, digest string, chunk int")
    check(rows, suffix_dedup.repeated_spans(docs))
    assert suffix_dedup.repeated_spans(table([])).count() == 0
    nulls = suffix_dedup.repeated_spans(table([(None, "z" * 300), (None, "y" * 20), (None, None)])).collect()
    assert sorted(r.n_removed for r in nulls) == [0, 0, 300]


@pytest.mark.parametrize("window,prime,bucket_bytes", [(64, 5, 1 << 22), (64, 7, 500), (40, 5, 2_000)])
def test_passages_at_random_places(table, window, prime, bucket_bytes):
    rng = np.random.default_rng(window)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    passages = [word(n) for n in (window // 2, window - 1, window, window + 1, 90, 150, 300)]
    texts = []
    for _ in range(120):
        parts = [word(int(rng.integers(0, 60)))]
        for _ in range(rng.integers(0, 4)):
            p = passages[rng.integers(len(passages))]
            parts += [p[int(rng.integers(0, 20)) :], word(int(rng.integers(0, 40)))]
        texts.append("".join(parts))
    texts += texts[:5] + ["x" * (window + 3), "ab" * window]
    rows = list(enumerate(texts))
    out = suffix_dedup.repeated_spans(table(rows), window, prime, bucket_bytes)
    check(rows, out, window)
    spans = {r.doc_id: (r.starts, r.ends) for r in out.collect()}
    assert [spans[i] for i, _ in rows] == [tuple(p[4:]) for p in plain(texts, window)]


@pytest.mark.parametrize("q", [2, 3, 5, 7, 11])
def test_covers_hold_every_distance(q):
    v, places = suffix_dedup.difference_cover(q)
    assert {(int(x) - int(y)) % v for x in places for y in places} == set(range(v)) and len(places) == q + 1
