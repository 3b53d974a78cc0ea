"""Exact copies against plain grouping."""

import hashlib
import re

import pytest
from odd import ODD

from quillspark.llm import exact_dedup

SPACE = re.compile("[\x20\x09-\x0d]")


def plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for text, members in groups.items():
        members.sort(key=lambda m: m[:3])
        for k, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), k == 0, hashlib.sha256(text.encode()).hexdigest()))
    return out


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


ROWS = [*enumerate(ODD), (100, "a b"), (101, "ab"), (102, "a  b"), (103, "a\nb "), (103, "a\nb "), (104, "ba"), (None, "one"), (None, "zz"), (None, "zz"), (7, "zz "),
        (105, "p" * 64 + "q"), (106, "p" * 64 + "r"), (107, "p" * 64 + " q"), (50, "same"), (50, "sa me"), (50, "s ame")]


@pytest.mark.parametrize("bits", [1 << 15, exact_dedup.SIEVE_BITS])
def test_groups_of_odd_rows(table, bits):
    docs = table([(i, t, "n", 1) for i, t in ROWS], "doc_id bigint, text string, n string, hit int")
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.copy_groups(docs, True, bits).collect()]
    assert sorted(got, key=key) == sorted(plain(ROWS), key=key)


def test_settled_rows_are_not_read_in_full(table):
    rows = [(1, "alone in its length and prefix"), (2, "twice"), (3, "tw ice"), (4, "p" * 64 + "q"), (5, "p" * 64 + "r")]
    got = {r.doc_id: r.text_sha256 is not None for r in exact_dedup.copy_groups(table(rows)).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: True}


def test_kept_rows_keep_their_columns(table):
    docs = table([(i, t, "n", 1.5) for i, t in ROWS], "doc_id bigint, text string, key string, kept double")
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    got = sorted((r.doc_id for r in out.collect()), key=lambda i: (i is None, i or 0))
    assert got == sorted((i for i, _, _, kept, _ in plain(ROWS) if kept), key=lambda i: (i is None, i or 0))


def test_empty_table(table):
    assert exact_dedup.copy_groups(table([])).count() == 0 and exact_dedup.drop_copies(table([])).count() == 0
