"""Licence scans with a generalised suffix automaton over the tokens of licence templates.

A text streams through the automaton, which after each word knows the longest run of words, ending there, that some template
holds (matching statistics). Where such runs are, each template is matched by itself, since a run of one may be part of a
longer one of another. Its runs that cannot be made longer are chained where they follow one another in text and template; a chain that covers enough of its template is a span with the template's label.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}

#: Phrases whose places all count, with their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Licence texts, as public notices word them, with their labels.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("mit", "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
]


def words_of(text: str | None) -> list[str]:
    text = text or ""
    return WORD.findall(text.lower() if text.isascii() else text.translate(ASCII_LOWER))


class Automaton:
    """Suffix automaton of several token lists. ends[state]: template -> where the state's runs end in it (from 1), in order.

    accepts[state]: (phrase, length) of the whole phrases among the suffixes of the state's longest run.
    """

    def __init__(self, lists: list[list[str]], phrases: int):
        self.vocab: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]
        self.lists = [[self.vocab.setdefault(w, len(self.vocab)) for w in x] for x in lists]
        for x in self.lists:
            last = 0
            for token in x:
                last = self._extend(last, token)
        for t, x in enumerate(self.lists):
            at = 0
            for i, token in enumerate(x, 1):
                at = up = self.next[at][token]
                while up > 0:
                    self.ends[up].setdefault(t, []).append(i)
                    up = self.link[up]
        whole: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for p, x in enumerate(self.lists[:phrases]):
            at = 0
            for token in x:
                at = self.next[at][token]
            whole[at].append((p, len(x)))
        self.accepts: list[list[tuple[int, int]]] = [[] for _ in self.next]
        for state in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.accepts[state] = whole[state] + (self.accepts[self.link[state]] if state else [])

    def _new(self, length: int, nexts: dict[int, int], link: int) -> int:
        self.next.append(nexts), self.length.append(length), self.link.append(link), self.ends.append({})
        return len(self.next) - 1

    def _split(self, source: int, target: int, token: int) -> int:
        """The state for runs of at most source's length and token, out of target, which has longer ones too."""
        if self.length[target] == self.length[source] + 1:
            return target
        twin = self._new(self.length[source] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = twin
        while source >= 0 and self.next[source].get(token) == target:
            self.next[source][token] = twin
            source = self.link[source]
        return twin

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, self.next[last][token], token)
        new = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and token not in self.next[last]:
            self.next[last][token] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, self.next[last][token], token)
        return new

    def scan(self, words: list[str], least: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Places (start, phrase), and (start, end, state) of the runs of `least` words or more that can't be made longer."""
        places, runs = [], []
        nexts, link, length, accepts = self.next, self.link, self.length, self.accepts
        state, n, before = 0, 0, -2
        for i, token in [(i, t) for i, t in enumerate(map(self.vocab.get, words)) if t is not None]:
            if i != before + 1:
                if n >= least:
                    runs.append((before + 1 - n, before + 1, state))
                state = n = 0
            to = nexts[state].get(token)
            if to is None and n >= least:
                runs.append((i - n, i, state))
            while to is None and state:
                state = link[state]
                n = length[state]
                to = nexts[state].get(token)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
                for p, size in accepts[state]:
                    if size <= n:
                        places.append((i + 1 - size, p))
            before = i
        if n >= least:
            runs.append((before + 1 - n, before + 1, state))
        return places, runs

    def chains(self, runs, gap: int) -> list[tuple[int, int, int, int]]:
        """(template, start, end, words matched) of runs that follow one another in text and template, gaps of `gap` words at most."""
        open_: dict[int, tuple[int, int, int, int]] = {}
        done = []
        for start, end, state in runs:
            for t, ends in self.ends[state].items():
                have, size = open_.get(t), end - start
                upto = next((e for e in ends if have and e > have[3]), None)
                if have and start - have[1] <= gap and upto is not None:
                    fresh = min(size, upto - have[3], end - have[1])
                    open_[t] = (have[0], end, have[2] + max(fresh, 0), upto)
                    continue
                if have:
                    done.append((t, *have[:3]))
                open_[t] = (start, end, size, ends[0])
        return done + [(t, *x[:3]) for t, x in open_.items()]


def regions(runs) -> list[tuple[int, int]]:
    """(start, end) of what the runs cover, those that overlap in one."""
    out: list[tuple[int, int]] = []
    for start, end, _ in sorted(runs):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def finder(phrases, templates, least: int, gap: int, cover: float):
    def run(batches):
        sam = Automaton([p.split() for p, _ in phrases] + [t.split() for _, t in templates], len(phrases))
        alone = [(label, Automaton([t.split()], 0)) for label, t in templates]
        labels = [x for _, x in phrases]
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                places, runs = sam.scan(words, least)
                spans = []
                for label, one in alone if runs else []:  # a run of all may hide a shorter one of one template
                    size = len(one.lists[0])
                    own = [(a + s, a + e, state) for a, b in regions(runs) for s, e, state in one.scan(words[a:b], least)[1]]
                    spans += [(label, s, e, min(1.0, m / size)) for _, s, e, m in one.chains(own, gap) if m >= cover * size]
                inside = sorted([(s, e) for _, s, e, _ in spans] + [(s, s + len(sam.lists[p])) for s, p in places])
                covered = upto = 0
                for s, e in inside:
                    covered += max(0, e - max(s, upto))
                    upto = max(upto, e)
                base = sorted({labels[p] for _, p in places})
                starts = [s for s, _ in places]
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), base, sorted({*base, *(x[0] for x in spans)}), spans, covered / len(words) if words else 0.0))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])), pa.float64()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score"]
            cols = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            cols[6] = [[{"label": a, "start": b, "end": c, "covered": d} for a, b, c, d in x] for x in cols[6]]
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], ["id", *names])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES, least: int = 4, gap: int = 12, cover: float = 0.6) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, spans, score.

    Base: every place where a phrase's words stand consecutively. spans: (label, start, end, covered) of chains of runs of
    `least` words or more, with at most `gap` words between them, that cover `cover` of their template. score: the part of
    the text's words inside places and spans. Null text is empty, with score 0 and null first and last word; an empty table
    gives no rows. Rows are handled one by one, so repeated rows stay repeated, and other columns are not looked at. In
    memory are a few megabytes of texts, or a single longer one, and an automaton of the templates.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(finder(list(phrases), list(templates), least, gap, cover), f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, spans array<struct<label:string,start:long,end:long,covered:double>>, score double")
    found = written(found, "licenses")
    return found.withColumnRenamed("id", id_col)
