"""Span hashes: equal for equal bytes alone, also where arithmetic modulo 2^64 fails."""

import numpy as np
import pyarrow as pa

from quillspark.llm import arrays, fingerprints, ngram_join


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


WORD = thue_morse(2048)
OTHER = WORD.translate(str.maketrans("ab", "ba"))


def hashes(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    starts = np.concatenate([[0], ends[:-1]])
    return arrays.span_hashes(arrays.prefix_sums(data), starts, ends)


def test_equal_spans_have_equal_hashes_and_others_do_not(monkeypatch):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abé\x00"), rng.integers(0, 9))) for _ in range(3000)]
    for block in (1 << 24, 100):  # sums in blocks, as for very long texts
        monkeypatch.setattr(arrays, "_BLOCK", block)
        found = {}
        for w, h in zip(words, hashes(words).tolist()):
            assert found.setdefault(w, h) == h
        assert len(set(found.values())) == len(found)


def test_a_word_and_its_image_differ():
    assert len(set(hashes([WORD, OTHER, WORD[:1024], OTHER[:1024], WORD[1024:]]).tolist())) == 4  # the second half is the image of the first
    sets, _ = arrays.shingle_sets(pa.array([WORD, OTHER]), 3)
    assert sets[0] != sets[1]


def test_texts_without_a_common_word_are_neither_linked_nor_alike(table):
    rows = table([(1, WORD), (2, OTHER), (3, WORD.upper())])
    got = {r.doc_id: r.component_id for r in ngram_join.near_components(rows, 3, 90).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    likeness = {r.doc_id: r.near_next for r in fingerprints.neighbour_fingerprints(table([(1, WORD), (2, OTHER)])).collect()}
    assert all(x < 0.2 for x in likeness.values())
