import itertools
import random

import pytest

from lectern.llm import decontam
from .conftest import python_free

w = lambda a, b: [f"w{i}" for i in range(a, b)]


def cases(spark):
    changed = w(0, 30)
    changed[7], changed[15], changed[24] = "x", "y", "z"
    items = [(1, " ".join(w(0, 30))), (2, "alpha beta gamma"), (3, None), (4, ""), (5, " ".join(w(100, 116))), (6, " ".join(f"s{i}" for i in range(7)))]
    docs = [
        (1, "foo " + " ".join(w(0, 30)) + " bar"), (2, " ".join(changed)), (3, "the alpha, Beta gamma!"), (4, None), (5, ""), (6, "alpha beta"), (7, " ".join(w(40, 90))), (None, " ".join(w(100, 116))),
        (8, " ".join(w(0, 14))), (9, " ".join(w(5, 40)).upper()), (10, "s0-s1 s2, s3 s4 s5 s6"), (1, "foo " + " ".join(w(0, 30)) + " bar"),
    ]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [500_000, -1])
def test_cases(spark, monkeypatch, limit):
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", limit)
    monkeypatch.setattr(decontam, "BLOOM_SLOTS", 64)
    docs, items = cases(spark)
    out = decontam.find_overlaps(docs, items.union(items))
    got = {(r.doc_id, r.item_id): (r.n_windows, r.overlap_words, r.doc_word) for r in out.collect()}
    assert got == {(1, 1): (7, 24, 1), (2, 1): (7, 22, 0), (3, 2): (1, 3, 1), (None, 5): (1, 16, 0), (9, 1): (6, 24, 0), (10, 6): (1, 7, 0)}
    assert python_free(out)
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs, items).collect()) == [4, 5, 6, 7, 8]


def test_families_are_complete():
    """Against all ways to change as many words as the share allows."""
    for size in range(1, decontam.WINDOW + 1):
        changed = size - decontam.need_words(size, 0.8)
        masks = decontam.FAMILIES[decontam.family_for(size, 0.8)]
        sees = [sum(1 << (at + i) for i, bit in enumerate(m) if bit == "1") for m in masks for at in range(size - len(m) + 1)]
        assert all(any(not hidden & m for m in sees) for hidden in (sum(1 << k for k in ks) for ks in itertools.combinations(range(size), changed)))
    assert decontam.family_for(24, 0.8) == 0 and not decontam.complete(("11011",), 10, 2) and not decontam.complete(("111111",), 24, 4)


def test_substitutions_up_to_a_fifth_are_found(spark):
    rng = random.Random(5)
    item = [f"i{k}" for k in range(36)]
    docs, hard = [], 0
    for n in range(200):
        text = list(item)
        for k in rng.sample(range(36), 3):
            text[k] = "sub"
        docs.append((n, " ".join(["pre"] * rng.randint(0, 5) + text + ["post"])))
    clean = [(1000 + n, " ".join(rng.sample(item, 36))) for n in range(50)]
    df = spark.createDataFrame(docs + clean, "doc_id long, text string")
    found = {r.doc_id for r in decontam.find_overlaps(df, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert len(found & set(range(200))) >= 195 and not any(k >= 1000 for k in found)


def test_messy(spark, messy):
    items = messy.select(messy.doc_id.alias("item_id"), "text", "seed", "at")
    found = {(r.doc_id, r.item_id) for r in decontam.find_overlaps(messy, items).collect()}
    assert {(1, 4), (1, 1), (4, 1), (5, 5), (None, None), (8, 8)} <= found and not any(2 in p or 3 in p or 6 in p for p in found)
    assert decontam.find_overlaps(messy.limit(0), items).count() == 0 and decontam.find_overlaps(messy, items.limit(0)).count() == 0
    assert decontam.drop_contaminated(messy, items.limit(0)).count() == messy.count()


def brute_force(docs, items, window=24, min_share=0.8):
    """(doc, item) -> (number of windows with enough equal words at any place, the most equal words of one)."""
    out = {}
    for d, text in docs:
        for k, item in items:
            h, ws = text.split(), item.split()
            size = min(window, len(ws))
            for shift in range(-len(ws), len(h)):
                same = [0 <= i + shift < len(h) and h[i + shift] == w for i, w in enumerate(ws)]
                for b in range(len(ws) - size + 1):
                    if (words := sum(same[b : b + size])) / size >= min_share:
                        n, best = out.get((d, k), (0, 0))
                        out[d, k] = n + 1, max(best, words)
    return out


def found_words(spark, docs, items):
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.n_windows, r.overlap_words) for r in decontam.find_overlaps(df, bench).collect()}


def changed_at(words, places):
    return " ".join("sub" if i in places else x for i, x in enumerate(words))


def test_every_sixth_word_replaced(spark):
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (24, 36, 48, 100)]
    docs = [(10 * n + o, "pre " * o + changed_at(t.split(), range(o, n, 6))) for n, t in items for o in range(6)]
    got = found_words(spark, docs, items)
    assert got == brute_force(docs, items) and len(got) == 24


def test_a_full_fifth_replaced_at_random(spark):
    rng = random.Random(7)
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in (15, 18, 20, 24, 36)]
    docs = [(1000 * n + i, "pre " * (i % 3) + changed_at(t.split(), rng.sample(range(n), n // 5)) + " post") for n, t in items for i in range(60)]
    got = found_words(spark, docs, items)
    assert got == brute_force(docs, items) and len(got) >= 4 * 60


def test_passages_of_longer_items(spark):
    rng = random.Random(11)
    item = [f"i{k}" for k in range(48)]
    docs = []
    for n in range(120):
        b = rng.randint(0, 24)
        docs.append((n, "pre " * (n % 4) + changed_at(item[b : b + 24], rng.sample(range(24), n % 5)) + " post" * (n % 7)))
    items = [(1, " ".join(item))]
    got = found_words(spark, docs, items)
    assert got == brute_force(docs, items) and len(got) == 120


def test_one_word_replaced_in_short_items(spark):
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(4, 13)]
    docs = [(100 * n + k, "pre " + changed_at(t.split(), [k]) + " post") for n, t in items for k in range(n)]
    got = found_words(spark, docs, items)
    assert got == brute_force(docs, items) and {k for _, k in got} == set(range(5, 13))
