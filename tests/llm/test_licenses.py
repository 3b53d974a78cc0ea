"""The licence scan against plain search."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import ODD

from quillspark.llm import licenses, queries

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        places += [(label, i) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


def check(rows, out):
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == {i for i, _ in rows}
    for i, text in rows:
        r, (n, places) = got[i], plain(text)
        starts = [at for _, at in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(starts, default=None), max(starts, default=None))
        base = sorted({label for label, _ in places})
        assert r.base_labels == ",".join(base) and set(base) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score == 1 or not places)
    return got


def test_the_documents(spark, documents):
    check([(r.doc_id, r.text) for r in documents], queries.op5_licenses(spark, "/root/testdata/sf0.001"))


def test_odd_rows(table):
    notice = licenses.NOTICES["gpl-3"][1]
    rows = list(enumerate(ODD)) + [
        (100, "under the MIT license " * 3), (101, "CC BY-NC BY NC cc by nc"), (102, "under the mit-license, version 2; apache license version 2.0"),
        (103, "x " * 40 + notice + " y"), (104, notice.replace("redistribute", "spread")), (105, " ".join(notice.split()[:8])), (106, "under the under the mit license"),
    ]
    got = check(rows, licenses.summary(table([(i, t, "s") for i, t in rows], "doc_id bigint, text string, spans string")))
    assert got[103].labels == "gpl-3" and got[103].score == 1 and got[104].labels == "gpl-3" and 0.8 < got[104].score < 1
    assert got[105].labels == "" and got[0].labels == "" and got[0].score == 0
    assert licenses.summary(table([])).count() == 0
    assert licenses.summary(table([(None, "a"), (1, "b"), (1, "b")])).count() == 3


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=7), min_size=1, max_size=4), st.lists(st.integers(0, 4), max_size=25))
def test_matching_statistics(templates, text):
    automaton, state, length = licenses.Automaton(templates), 0, 0
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for i, word in enumerate(text):
        state, length = automaton.step(state, length, word)
        assert length == max((n for n in range(i + 2) if not n or tuple(text[i + 1 - n : i + 1]) in runs))
        if length:
            run = text[i + 1 - length : i + 1]
            assert automaton.places[state] == [(t, j) for t, w in enumerate(templates) for j in range(len(w)) if w[max(0, j + 1 - length) : j + 1] == run]


def test_phrases_anywhere():
    scanner, rng = licenses.Scanner(), np.random.default_rng(0)
    vocabulary = "under the mit license apache version 2 cc by nc x".split()
    import pyarrow as pa

    texts = [" ".join(rng.choice(vocabulary[:4] if k % 2 else vocabulary, 60)) for k in range(200)]
    for text, (n, places, _) in zip(texts, scanner.rows(pa.array(texts))):
        assert (n, sorted(places)) == plain(text)


def labels(text):
    import pyarrow as pa

    return [(s[0], s[3]) for s in next(licenses.Scanner().rows(pa.array([text])))[2]]


def test_every_notice_has_its_own_label():
    for label, notices in licenses.NOTICES.items():
        for notice in notices:
            assert labels(notice) == [(label, 1)] and labels(f"x the license. {notice} the y") == [(label, 1)]


def test_neighbouring_licences():
    gnu = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software " \
        "Foundation{} either version {} of the License, or (at your option) any later version."
    for kind, version, label in [("", "3", "gpl-3"), ("", "2", "gpl-2"), ("Lesser ", "2.1", "lgpl-2.1"), ("Lesser ", "3", "lgpl-3"), ("Library ", "2", "lgpl-2"), ("Affero ", "3", "agpl-3")]:
        for thing in ("program", "library", "file"):
            assert [x[0] for x in labels(gnu.format(thing, ";", kind, ";", version))] == [label], (kind, version, thing)
    assert labels(gnu.format("program", ":", "", ",", "1")) == [] == labels(gnu.format("program", ":", "Affero ", ",", "1"))
    cc = "This work is licensed under a Creative Commons Attribution{} International License."
    for kind, label in [("", "cc-by"), ("-ShareAlike", "cc-by-sa"), ("-NonCommercial", "cc-by-nc"), ("-NonCommercial-NoDerivatives", "cc-by-nc-nd")]:
        assert labels(cc.format(kind + " 4.0")) == [(label, 1)]
    assert labels("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 United States License")[0][0] == "cc-by-sa"
    assert labels("Licensed under the Apache License, Version 1.1.") == [] and labels("This work is licensed under the GNU General Public License, version 1.") == []
    apache = licenses.NOTICES["apache-2"][0]
    assert labels(apache.replace("Apache", "Educational Community")) == [("ecl-2", 1)] and labels(apache.replace("Apache", "Some Other")) == []


def test_words_in_gaps_count():
    notice = licenses.NOTICES["isc"][0]
    words = notice.replace("and/or", "and or").split()
    assert labels(notice.replace(" for any", " so for any")) == [("isc", len(words) / (len(words) + 1))]
    assert labels(" ".join(w + " so so so so so" * (i % 4 == 3) for i, w in enumerate(words))) == []


def test_openings_clauses_and_spdx_lines():
    for text, label in [
        ("Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", "apache-2"),
        ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n Copyright (C) 2007", "gpl-3"),
        ("The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.", "gpl-3"),
        ("* Neither the name of the copyright holder nor the names of its\n  contributors may be used to endorse or promote products derived from\n  this software without specific prior written permission.", "bsd"),
        ("// SPDX-License-Identifier: MIT\n", "mit"), ("# SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2"), ("/* SPDX-License-Identifier: LGPL-2.1-only */", "lgpl-2.1"),
        ("SPDX-License-Identifier: BSD-3-Clause", "bsd"), ("SPDX-License-Identifier: CC-BY-SA-4.0", "cc-by-sa"),
    ]:
        assert {x[0] for x in labels(text)} == {label}, text
    assert labels("SPDX-License-Identifier: Zlib") == [] == labels("see the SPDX-License-Identifier of each file")


def test_other_templates(table):
    rows = [(1, "This is the house licence of 2020, no more."), (2, "under the mit license"), (3, None)]
    got = {r.doc_id: r for r in licenses.summary(table(rows), {"house licence": "house"}, {"own": ["this is the house licence of 2020"]}).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].base_labels, got[1].labels) == (1, 3, "house", "house,own") and got[2].labels == "" == got[3].labels
