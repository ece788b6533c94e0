"""License scan by a positional index of rare words.

The index holds the licence templates: each word's postings (template, positions) and its inverse document frequency over
the templates; words of more than a quarter of the templates (and more than one) aren't indexed. A file's licence words are ranked by that frequency, rarest
first, and for each template the first few of them are looked up. A posting at template position q met at text position p votes
for the alignment p - q; the votes are intersected: a candidate is an alignment that two different words or more agree on,
within a small drift. It counts if all mandatory phrases of the template stand, word by word, inside the aligned
stretch and enough of the template's word weight is found there. Short base phrases are templates whose whole text is
mandatory, so every place of theirs is found through their rarest word.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns

# Base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of public licence notices, as (label, notice, mandatory phrases).
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("mit", "released under the mit license", ["under the mit license"]),
    ("mit", "the mit license", ["the mit license"]),
    ("apache-2", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license", ["apache license version 2 0", "except in compliance with the license"]),
    ("apache-2", "licensed under the apache license version 2.0", ["apache license version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["under the terms of the gnu general public license"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-3", "this work is licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2.0", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4.0", ["cc by nc"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", ["creative commons attribution noncommercial"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license", ["creative commons attribution sharealike"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license", ["creative commons attribution 4 0"]),
    ("cc0", "dedicated to the public domain under the creative commons cc0 1.0 universal", ["cc0 1 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("epl-2", "made available under the terms of the eclipse public license 2.0", ["eclipse public license"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["copyright notice and this permission notice"]),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ["software distributed under the license is distributed on an as is basis"]),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ["in no event will the authors be held liable"]),
    ("bsl-1", "distributed under the boost software license version 1.0", ["boost software license"]),
    ("artistic-2", "this program is distributed under the terms of the artistic license 2.0", ["artistic license 2 0"]),
    ("wtfpl", "do what the fuck you want to public license", ["what the fuck you want to public license"]),
    ("ofl-1", "this font software is licensed under the sil open font license version 1.1", ["sil open font license"]),
    ("eupl", "licensed under the european union public licence", ["european union public licence"]),
    ("odbl", "this database is made available under the open database license", ["open database license"]),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ["gnu free documentation license"]),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4.0 international license", ["creative commons attribution noderivatives"]),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4.0 international license", ["creative commons attribution noncommercial sharealike"]),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", ["common development and distribution license"]),
    ("ms-pl", "this source is subject to the microsoft public license", ["microsoft public license"]),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ["without fee and without a written agreement is hereby granted"]),
    ("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited", ["unauthorized copying of this file"]),
]

# A-Z to lower case; what is no letter, digit or byte above 127 to a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case: runs of letters, digits and characters beyond ASCII."""
    return text.encode("utf-8", "replace").translate(_FOLD).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    mandatory: list[list[bytes]]
    base: bool


class Index:
    """Postings and weights of the templates. ``rare_words``: how many of a file's rarest words are looked up for a template."""

    def __init__(self, notices=tuple(NOTICES), base=tuple(BASE.items()), rare_words: int = 6, agree: int = 2, min_share: float = 0.6, drift: int = 3):
        self.rare_words, self.min_share, self.drift = rare_words, min_share, drift
        self.templates = [Template(label, words(text), [words(m) for m in must], False) for label, text, must in notices]
        self.templates += [Template(label, words(phrase), [words(phrase)], True) for phrase, label in base]
        n = len(self.templates)
        seen = Counter(w for t in self.templates for w in set(t.words))
        self.idf = {w: math.log(1 + n / k) for w, k in seen.items()}
        self.postings: dict[bytes, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.agree: list[int] = []
        for number, t in enumerate(self.templates):
            rarest = min(t.words, key=lambda w: (-self.idf[w], w))
            indexed = {rarest} if t.base else {w for w in t.words if seen[w] <= max(1, n // 4)}
            self.agree.append(min(agree, len(indexed)))
            for q, w in enumerate(t.words):
                if w in indexed:
                    self.postings[w][number].append(q)
        self.postings = {w: dict(p) for w, p in self.postings.items()}

    def scan(self, text: str) -> tuple[int, list[int], list[str], list[tuple[str, int, int, float]]]:
        """(number of words, starts of base phrases, their labels, matches as (label, first word, end word, share))."""
        found = words(text)
        places: dict[bytes, list[int]] = defaultdict(list)
        for p, w in enumerate(found):
            if w in self.postings:
                places[w].append(p)
        votes: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        looked_up: Counter = Counter()
        for w in sorted(places, key=lambda w: (-self.idf[w], w)):
            for number, at in self.postings[w].items():
                if looked_up[number] < self.rare_words:
                    looked_up[number] += 1
                    votes[number] += [(p - q, w) for q in at for p in places[w]]
        matches, starts = set(), set()
        for number, ballots in votes.items():
            t = self.templates[number]
            if t.base:
                starts |= {(a, t.label) for a, _ in ballots if a >= 0 and found[a : a + len(t.words)] == t.words}
            elif looked_up[number] >= self.agree[number]:
                matches |= {m for a, b in self._agreed(sorted(ballots), self.agree[number]) if (m := self._verify(t, found, max(0, a), b + len(t.words)))}
        return len(found), sorted({a for a, _ in starts}), sorted({label for _, label in starts}), sorted(matches)

    def _agreed(self, ballots: list[tuple[int, bytes]], agree: int) -> Iterator[tuple[int, int]]:
        """(first, last) alignment of each run of votes within the drift that ``agree`` different words or more cast."""
        group: list[tuple[int, bytes]] = []
        for vote in [*ballots, None]:
            if group and (vote is None or vote[0] - group[0][0] > self.drift):
                if len({w for _, w in group}) >= agree:
                    yield group[0][0], group[-1][0]
                group = []
            if vote:
                group.append(vote)

    def _verify(self, t: Template, found: list[bytes], begin: int, end: int) -> tuple[str, int, int, float] | None:
        span = found[begin : end + self.drift]
        for phrase in t.mandatory:
            if not any(span[i : i + len(phrase)] == phrase for i in range(len(span) - len(phrase) + 1)):
                return None
        have, want = Counter(span), Counter(t.words)
        share = sum(self.idf[w] * min(k, have[w]) for w, k in want.items()) / sum(self.idf[w] * k for w, k in want.items())
        return (t.label, begin, min(end, len(found)), share) if share >= self.min_share else None


_index: list[Index] = []


def scan_licenses(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Append ``n_words``, ``base_starts`` (array), ``base_labels`` (array), ``matches`` (array of label, first_word, end_word, share).

    A row's values depend on its own text only: no shuffle, ties and repeated rows change nothing, an empty table gives an
    empty one, columns of the same names are replaced. Null and empty texts have no words and no matches.
    """
    match = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("share", T.DoubleType())])
    fields = [T.StructField("n_words", T.LongType()), T.StructField("base_starts", T.ArrayType(T.LongType())), T.StructField("base_labels", T.ArrayType(T.StringType())), T.StructField("matches", T.ArrayType(match))]
    inner = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("share", pa.float64())])

    def compute(texts: pa.Array) -> list[pa.Array]:
        if not _index:
            _index.append(Index())
        n, starts, labels, matches = zip(*(_index[0].scan(t.as_py() or "") for t in texts), strict=True)
        rows = [[dict(zip(("label", "first_word", "end_word", "share"), m, strict=True)) for m in x] for x in matches]
        return [pa.array(n, pa.int64()), pa.array(starts, pa.list_(pa.int64())), pa.array(labels, pa.list_(pa.string())), pa.array(rows, pa.list_(inner))]

    return append_columns(df, fields, compute, [text_col])
