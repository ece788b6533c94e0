import random
import re

from lectern.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    return len(w), sorted({i for i, _ in at}), sorted({x for _, x in at})


TEXTS = [
    "Released under the MIT License.", "the mit the mit license THE-MIT_LICENSE mit license", "Licensed under the Apache License, Version 2.0.", "apache license version 20", "Licensed under CC BY-NC 4.0. cc by nc cc by nc",
    "This work is licensed under the GNU General Public License, version 3.", "the éMIT license the mit license", "mit license the", "", None, "the mit\x00license",
]


def test_base_phrases():
    index = licenses.Index()
    for t in TEXTS:
        n, starts, labels, _ = index.scan(t or "")
        assert (n, starts, labels) == brute(t), t


def test_base_phrases_are_the_contracts():
    index = licenses.Index()
    for text, starts, labels in (
        ("Released under the MIT License, under THE-MIT license.", [1, 5], ["mit"]),
        ("The MIT License: with the mit license", [], []),
        ("under the mit x license apache license version 2.0 under cc by-nc", [5, 11], ["apache-2", "cc-by-nc"]),
    ):
        assert index.scan(text)[1:3] == (starts, labels), text
    # The name alone is no base phrase; the method labels it.
    assert {m[0] for m in index.scan("The MIT License: with the mit license")[3]} == {"mit"}


def test_method_labels():
    index = licenses.Index()
    labels = lambda t: {m[0] for m in index.scan(t)[3]}
    assert labels(TEXTS[5]) == {"gpl-3"}
    for label, notice, _ in licenses.NOTICES:
        assert label in labels("Before that. " + notice.upper() + " And after.")
    changed = "Permission is hereby granted, free of charge, to any other person obtaining copies of this software and associated documentation files (the Software), to deal in the Software without restriction"
    assert "mit" in labels(changed)
    # A file without the rarest words of a template is found by the rarest that it has.
    partly = "this work is licenced under gnu general public license version 3"
    assert "gpl-3" in labels(partly)
    # Rare words without the mandatory phrase, or apart from each other, are no licence.
    assert not labels("permission granted hereby free charge person obtaining copy software associated documentation files deal restriction")
    assert not labels("gnu " + "x " * 50 + "general " + "y " * 50 + "public license version 3")


def test_words_are_ranked_by_file_and_votes_intersected():
    notices = [("a", "one two three four five six", ["three four"]), ("b", "seven eight nine ten", ["nine ten"])]
    index = licenses.Index(notices, (), rare_words=2, agree=2, min_share=0.4)
    assert [m[0] for m in index.scan("x five six three four")[3]] == []  # five and six agree; the phrase isn't where they say
    assert [m[0] for m in index.scan("three four five six")[3]] == ["a"]
    assert index.scan("four " + "x " * 20 + "three four")[3] == [] and index.scan("nine x x x x x ten")[3] == []
    rng = random.Random(3)
    vocabulary = "one two three four five six seven eight nine ten x y z".split()
    for _ in range(300):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))
        w = [x.encode() for x in text.split()]
        want = set()
        for label, words, _ in notices:
            t = words.encode().split()
            have = sorted(set(w) & set(t), key=lambda x: (-index.idf[x], x))[:2]
            ballots = sorted((p - t.index(x), x) for p, x in enumerate(w) if x in have)
            while ballots:
                group = [v for v in ballots if v[0] - ballots[0][0] <= index.drift]
                ballots = ballots[len(group) :]
                span = w[max(0, group[0][0]) : group[-1][0] + len(t) + index.drift]
                must = [x for k, n, m in notices if k == label for x in [m[0].encode().split()]][0]
                whole = any(span[i : i + len(must)] == must for i in range(len(span)))
                share = len(set(span) & set(t)) / len(t)
                if len({x for _, x in group}) >= 2 and whole and share >= 0.4:
                    want.add(label)
        assert {m[0] for m in index.scan(text)[3]} == want, text


def test_documents(spark, messy, texts):
    rows = licenses.scan_licenses(messy).select("doc_id", "text", "n_words", "base_starts", "base_labels", "matches").collect()
    assert [(r.doc_id, r.text) for r in rows] == [t[:2] for t in texts]
    assert all((r.n_words, r.base_starts, r.base_labels) == brute(r.text) for r in rows)
    assert licenses.scan_licenses(messy.limit(0)).count() == 0
