"""Licence scan with a generalised suffix automaton.

The templates (phrases and notices) become one suffix automaton over their words. A file's words stream through it: at each word it
knows the longest run of words, ending there, that occurs in any template (matching statistics). Runs that cannot be extended are long
matches; those of one template that follow each other, in the file and in the template, are chained into a span. Its share is the words it covers by
the words of the template and the words of the file that stand in its gaps. A span counts when its share is `COVERED` or more and the `DECIDING` words in it
are those of the template, in order: none missing, none added. Of spans that overlap, the one with the best share, then with the most words, stays; its label is found.
Phrases and whole notices are found at every place: a run contains one as its end when its state is on the path of suffix links and the run is long
enough.

Words are mapped to template words in bulk; only runs of template words pass through the automaton, word by word. No shuffle.

Defined results: a null or empty text has no words, no places (null) and no labels (""). Rows with equal ids and repeated rows are scanned on
their own. Texts of any length stream. An empty table gives an empty result. Other columns are not read.
"""

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import arrays
from quillspark.llm.columns import whole_text

# Phrases that count wherever they stand, notices of well-known licences (label: texts), and words that tell neighbouring licences apart.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
        "Licensed under the MIT license.",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    ],
    "gpl-3": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as "
        "published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "mpl-2": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at"
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "gpl-2": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as "
        "published by the Free Software Foundation",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ],
    "lgpl-2": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ],
    "lgpl-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    ],
    "lgpl-3": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "agpl-3": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "mpl-1.1": [
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ],
    "ecl-2": [
        "Licensed under the Educational Community License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at",
    ],
    "epl-2": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "bsl-1": ["Distributed under the Boost Software License, Version 1.0."],
    "0bsd": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "This work is licensed under the Creative Commons CC0 1.0 Universal Public Domain Dedication",
    ],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0."],
}
_CC = {
    "cc-by": ["Attribution"],
    "cc-by-sa": ["Attribution-ShareAlike", "Attribution-Share Alike"],
    "cc-by-nd": ["Attribution-NoDerivatives", "Attribution-NoDerivs"],
    "cc-by-nc": ["Attribution-NonCommercial", "Attribution-Non-Commercial"],
    "cc-by-nc-sa": ["Attribution-NonCommercial-ShareAlike", "Attribution-Non-Commercial-Share Alike"],
    "cc-by-nc-nd": ["Attribution-NonCommercial-NoDerivatives", "Attribution-NonCommercial-NoDerivs"],
}
for _label, _names in _CC.items():
    for _name in _names:
        for _version in ("4.0 International", "3.0 Unported", "2.5 Generic", "2.0 Generic"):
            NOTICES.setdefault(_label, []).append(f"This work is licensed under a Creative Commons {_name} {_version} License")
    NOTICES[_label].append(f"Licensed under {_label.upper().replace('-', ' ', 1)} 4.0.")
# Titles, openings and clauses of the licence texts themselves, and names in SPDX lines.
for _label, _texts in {
    "apache-2": [
        "Apache License Version 2.0, January 2004",
        "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, "
        "and distribution as defined by Sections 1 through 9 of this document.",
    ],
    "gpl-3": [
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "gpl-2": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "lgpl-2": ["GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "lgpl-2.1": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl-3": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "agpl-3": [
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation "
        "with the community in the case of network server software.",
    ],
    "mpl-2": ["Mozilla Public License Version 2.0"],
    "bsd": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "epl-2": ["Eclipse Public License - v 2.0"],
    "bsl-1": ["Boost Software License - Version 1.0 - August 17th, 2003"],
}.items():
    NOTICES[_label] += _texts
SPDX = {
    "mit": ["MIT"], "apache-2": ["Apache-2.0"], "bsd": ["BSD-2-Clause", "BSD-3-Clause"], "isc": ["ISC"], "unlicense": ["Unlicense"], "0bsd": ["0BSD"],
    "gpl-2": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], "gpl-3": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"],
    "lgpl-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"], "lgpl-3": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "agpl-3": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"], "mpl-2": ["MPL-2.0"], "epl-2": ["EPL-2.0"], "bsl-1": ["BSL-1.0"], "cc0": ["CC0-1.0"],
    "cc-by": ["CC-BY-4.0"], "cc-by-sa": ["CC-BY-SA-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"],
}
for _label, _names in SPDX.items():
    NOTICES[_label] += [f"SPDX-License-Identifier: {_name}" for _name in _names]
# "library" decides before "general" only: GNU notices speak of "this library" under any licence
DECIDING = (
    "isc unlicense 0bsd gpl lgpl agpl mpl epl bsl mit bsd apache educational boost eclipse mozilla lesser affero library sharealike share alike noncommercial commercial noderivatives noderivs "
    "derivative derivatives nc sa nd cc0 1 2 3 4 5 6 7 8 9"
).split()
COVERED = 0.75
MATCH_WORDS = 3
GAP_WORDS = 6

_WORD = np.ones(256, bool)
_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _spans(column):
    """Lower-case bytes, and the words' starts, ends and bounds."""
    data, offsets = arrays.text_buffer(column)
    data = arrays.LOWER[data]
    return data, *arrays.words(data, offsets, _WORD)


def split_words(text):
    data, starts, ends, _ = _spans(pa.array([text]))
    return [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]


class Automaton:
    """Suffix automaton of word numbers; templates are parted by numbers that no text has."""

    def __init__(self, templates):
        self.next, self.link, self.length, ends, last = [{}], [-1], [0], [set()], 0
        for t, words in enumerate(templates):
            for place, word in enumerate([*words, -1 - t]):
                last = self._add(last, word)
                while len(ends) < len(self.next):
                    ends.append(set())
                if word >= 0:
                    ends[last].add((t, place))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            ends[self.link[state]] |= ends[state]
        self.places = [sorted(e) for e in ends]  # (template, place of the last word) of each state
        self.places[0] = []

    def _new(self, length, link, following):
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _add(self, last, word):
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            if self.length[q] == self.length[p] + 1:
                self.link[state] = q
            else:
                copy = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
                while p >= 0 and self.next[p].get(word) == q:
                    self.next[p][word] = copy
                    p = self.link[p]
                self.link[q] = self.link[state] = copy
        return state

    def step(self, state, length, word):
        """State and length of the longest run after one more word."""
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        state = self.next[state].get(word, 0)
        return state, length + 1 if state else 0


class Scanner:
    """Phrases (text: label) that count wherever they stand, and notices (label: texts) whose spans are chained."""

    def __init__(self, phrases=PHRASES, notices=NOTICES):
        texts = [(p, label, True) for p, label in phrases.items()] + [(n, label, False) for label, ns in notices.items() for n in ns]
        templates = [split_words(t) for t, _, _ in texts]
        vocabulary = sorted({w for t in templates for w in t}.union(DECIDING, ["general"]))
        self.labels, self.sizes = [label for _, label, _ in texts], [len(t) for t in templates]
        data, starts, ends, _ = _spans(pa.array([" ".join(vocabulary)]))
        hashes = arrays.span_hashes(arrays.prefix_sums(data), starts, ends)
        self.numbers = np.argsort(hashes)
        self.hashes = hashes[self.numbers]
        number = {w: i for i, w in enumerate(vocabulary)}
        coded = [[number[w] for w in t] for t in templates]
        self.automaton = Automaton(coded)
        self.decides = np.zeros(len(vocabulary), bool)
        self.decides[[number[w] for w in DECIDING]] = True
        self.library, self.general = number["library"], number["general"]
        self.deciding = [self.deciding_words(t) for t in coded]
        self.n_phrases, template_state = len(phrases), {}
        for t, words in enumerate(coded):
            state, length = 0, 0
            for w in words:
                state, length = self.automaton.step(state, length, w)
            template_state[state] = template_state.get(state, ()) + (t,)
        self.whole_at = []  # phrases and notices that end any long enough run in a state
        for state in range(len(self.automaton.next)):
            found, s = [], state
            while s > 0:
                found += template_state.get(s, ())
                s = self.automaton.link[s]
            self.whole_at.append(tuple(found))
        self.shortest = min([*(self.sizes[p] for p in range(len(phrases))), MATCH_WORDS])

    def deciding_words(self, numbers):
        """The deciding words among word numbers (-1: none), in order."""
        numbers = np.asarray(numbers, np.int64)
        following = np.append(numbers[1:], -1)
        decides = (numbers >= 0) & self.decides[numbers] & ((numbers != self.library) | (following == self.general))
        return numbers[decides].tolist()

    def numbered(self, column):
        """Template word numbers of all words (-1: none) and the bounds of texts."""
        data, starts, ends, bounds = _spans(column)
        hashes = arrays.span_hashes(arrays.prefix_sums(data), starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], -1), bounds

    def scan(self, words, base):
        """Phrase places (phrase, start) and chained spans of one text's runs [(first word, numbers)]."""
        found, chains, spans = [], {}, []
        for first, run in words:
            state, length = 0, 0
            for i, word in enumerate([*run, None]):
                before, before_length = state, length
                state, length = self.automaton.step(state, length, word) if word is not None else (0, 0)
                if before_length >= MATCH_WORDS and length != before_length + 1:
                    self._chain(chains, spans, first + i - before_length - base, before, before_length)
                for t in self.whole_at[state]:
                    start, end = first + i - self.sizes[t] + 1 - base, first + i + 1 - base
                    if length >= self.sizes[t] and t < self.n_phrases:
                        found.append((t, start))
                    elif length >= self.sizes[t]:
                        spans.append({"template": t, "start": start, "end": end, "words": self.sizes[t], "inserted": 0})
        spans.extend(chains.values())
        return found, spans

    def _chain(self, chains, spans, start, state, length):
        """Add a long match to the open chain of each template that holds it, or open a new one."""
        for template, place in self.automaton.places[state]:
            at, chain = place - length + 1, chains.get(template)
            if chain and chain["at"] < at and chain["end"] <= start <= chain["end"] + GAP_WORDS:
                chain.update(end=start + length, at=place, words=chain["words"] + length, inserted=chain["inserted"] + start - chain["end"])
                continue
            if chain and chain["start"] == start and chain["words"] >= length:
                continue  # the same words of the file at another place of the template
            if chain:
                spans.append(chain)
            chains[template] = {"template": template, "start": start, "end": start + length, "at": place, "words": length, "inserted": 0}

    def best(self, spans, numbers):
        """Of a text's spans those that count (label, start, end, share), none overlapping another."""
        kept, starts = [], []
        for s in spans:
            s["share"] = s["words"] / (self.sizes[s["template"]] + s["inserted"])
        good = [s for s in spans if s["share"] >= COVERED and self.deciding_words(numbers[s["start"] : s["end"]]) == self.deciding[s["template"]]]
        for s in sorted(good, key=lambda s: (-s["share"], -s["words"], s["start"], s["template"])):
            i = bisect.bisect_left(starts, s["start"])
            if (i == 0 or kept[i - 1]["end"] <= s["start"]) and (i == len(kept) or s["end"] <= kept[i]["start"]):
                starts.insert(i, s["start"])
                kept.insert(i, s)
        return [(self.labels[s["template"]], s["start"], s["end"], s["share"]) for s in kept]

    def rows(self, column):
        """For each text: words, phrase places and covered spans (label, start, end, share)."""
        numbers, bounds = self.numbered(column)
        inside = numbers >= 0
        edge = np.zeros(len(inside) + 1, bool)
        edge[bounds] = True
        before, after = np.zeros(len(inside), bool), np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        cut = np.searchsorted(starts, bounds)
        for doc in range(len(bounds) - 1):
            runs = [(int(a), numbers[a:b].tolist()) for a, b in zip(starts[cut[doc] : cut[doc + 1]], ends[cut[doc] : cut[doc + 1]])]
            found, spans = self.scan(runs, int(bounds[doc])) if runs else ([], [])
            spans = self.best(spans, numbers[bounds[doc] : bounds[doc + 1]])
            yield int(bounds[doc + 1] - bounds[doc]), [(self.labels[p], at) for p, at in found], spans


SPANS = "doc_id bigint, n_words bigint, places array<struct<label:string,start:bigint>>, spans array<struct<label:string,start:bigint,end:bigint,share:double>>"


def scan(docs, phrases=PHRASES, notices=NOTICES):
    """doc_id, n_words, places of phrases, and covered template spans of each row. Any templates can be given: `phrases` by text, `notices` by label.

    The words in `DECIDING` tell templates apart whatever these are. The automaton of the templates is built once per task, in memory: templates are a bounded input.
    """
    names = [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]

    def run(batches):
        scanner = Scanner(phrases, notices)
        for batch in batches:
            for some in arrays.slices(batch):
                rows = list(scanner.rows(some.column(1)))
                places = [[dict(zip(("label", "start"), p)) for p in r[1]] for r in rows]
                spans = [[dict(zip(("label", "start", "end", "share"), s)) for s in r[2]] for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array(places, pa.list_(pa.struct(names[:2]))),
                     pa.array(spans, pa.list_(pa.struct(names)))], names=["doc_id", "n_words", "places", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(run, SPANS)


def summary(docs, phrases=PHRASES, notices=NOTICES):
    """n_words, n_base, first_word, last_word, base_labels, labels, score of each row."""
    rows, label = scan(docs, phrases, notices), lambda x: x["label"]
    base = F.transform("places", label)

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    share = F.greatest(F.array_max(F.transform("spans", lambda s: F.least(s["share"], F.lit(1.0)))), F.when(F.size("places") > 0, 1.0), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("spans", label))).alias("labels"), share.alias("score"),
    )
