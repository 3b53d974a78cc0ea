"""Fingerprints against plain sets of shingles."""

import hashlib

import numpy as np
import pyarrow as pa
from odd import ODD

from quillspark.llm import fingerprints as fp
from quillspark.llm import queries


def check_neighbours(rows, out):
    got = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    texts = [t or "" for _, t in rows]
    by_text = {}
    for i, (r, text) in enumerate(zip(got, texts)):
        following = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(changed, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == following:
            assert r.near_next == 1
        assert (r.fingerprint == "") == (not text.split())
    return got


def test_the_documents(spark, documents):
    got = check_neighbours([(r.doc_id, r.text) for r in documents], queries.op3_fingerprints(spark, "/root/testdata/sf0.001"))
    long = [r for r in got if r.n_chars > 1000]
    assert np.mean([r.near_edited for r in long]) > 0.25 and np.mean([r.near_next for r in long]) < 0.1


def test_odd_rows(table):
    rows = list(enumerate(ODD))
    check_neighbours(rows, fp.neighbour_fingerprints(table([(i, t, "x") for i, t in rows], "doc_id bigint, text string, place string")))
    check_neighbours([(4, "a b")], fp.neighbour_fingerprints(table([(4, "a b")])))
    assert fp.neighbour_fingerprints(table([])).count() == 0
    repeated = fp.neighbour_fingerprints(table([(None, "b c"), (1, "a"), (1, "a"), (None, None)])).collect()
    assert len(repeated) == 4
    plain = fp.fingerprints(table(rows)).collect()
    assert len(plain) == len(rows) and len({r.fingerprint for r in plain if r.doc_id in (7, 8)}) == 1


def test_estimates_follow_jaccard():
    rng, vocabulary = np.random.default_rng(3), [f"w{i}" for i in range(5000)]
    errors = []
    for share in (0.2, 0.5, 0.8, 0.9, 0.97):
        for _ in range(40):
            a = list(rng.choice(vocabulary, 600))
            b = a[: int(600 * share)] + list(rng.choice(vocabulary, 600 - int(600 * share)))
            sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b)]
            true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            code, full = fp.codes(pa.array([" ".join(a), " ".join(b)]))
            errors.append(fp.likeness((code[:1], full[:1]), (code[1:], full[1:]))[0] - true)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_densified_bins_copy_full_ones():
    empty = np.uint64(2**64 - 1)
    minima = np.full((3, 16), empty)
    minima[0, 3], minima[1, [2, 9]] = 7, (5, 6)
    out = fp.densified(minima)
    assert set(out[0]) == {7} and set(out[1]) == {5, 6} and (out[2] == empty).all()
    assert (out[1, [2, 9]] == (5, 6)).all()


def plain_codes(text, bins=128, bits=4):
    """One-permutation MinHash by loops: bins, minima, probes for empty bins, low-order bits."""
    words = [w for w in text.replace("\n", " ").split(" ") if w]
    if not words:
        return None
    runs = {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {" ".join(words)}
    hashes = {int(fp.arrays.shingles(*word_hashes(r), 5)[0][0]) for r in runs}
    minima = {}
    for h in hashes:
        b, rest = h >> 57, h & (1 << 57) - 1
        minima[b] = min(minima.get(b, rest), rest)
    out = []
    for b in range(bins):
        attempt, at = 0, b
        while at not in minima:
            at = int(fp._probes(attempt, bins)[b]) if attempt < 16 * bins else (b + attempt) % bins
            attempt += 1
        out.append(int(fp.arrays.mixed(np.uint64(minima[at]))) & (1 << bits) - 1)
    return out


def word_hashes(run):
    data, offsets = fp.arrays.text_buffer(pa.array([run]))
    starts, ends, bounds = fp.arrays.words(data, offsets)
    return fp.arrays.span_hashes(fp.arrays.prefix_sums(data), starts, ends), bounds


def test_fingerprints_and_likeness_are_those_of_loops(table):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice([f"v{i}" for i in range(50)], n)) for n in (1, 3, 5, 9, 40, 300, 300)] + ["", None, "\n a\n", "v1 v2", "v1 v2"]
    got = sorted(fp.neighbour_fingerprints(table(list(enumerate(texts)))).collect(), key=lambda r: r.doc_id)
    for i, r in enumerate(got):
        text, following = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        half = len(text) // 2
        own, changed, other = (plain_codes(t) for t in (text, text[: len(text) - half] + following[:half], following))
        assert r.fingerprint == ("" if own is None else "".join(f"{sum((c >> j & 1) << (3 - j) for j in range(4)):x}" for c in own))
        for value, second in ((r.near_edited, changed), (r.near_next, other)):
            if own is None or second is None:
                assert value == float((own is None) == (second is None))
            else:
                same = sum(a == b for a, b in zip(own, second)) / 128
                assert abs(value - min(max((same - 1 / 16) / (15 / 16), 0), 1)) < 1e-12
