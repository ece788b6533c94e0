import random
from collections import Counter

import numpy as np
import pytest

from lectern.llm import suffix_dedup as S


def brute(texts, n):
    raws = [(t or "").encode() if not isinstance(t, bytes) else t for t in texts]
    seen = Counter(r[a : a + n] for r in raws for a in range(len(r) - n + 1))
    out = []
    for r in raws:
        runs = []
        for a in range(len(r) - n + 1):
            if seen[r[a : a + n]] > 1:
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = a + n
                else:
                    runs.append([a, a + n])
        out.append([tuple(x) for x in runs])
    return out


def by_merge(texts, n, gram, shard):
    """What the operator does with different texts, without Spark."""
    occurrences, spans = [], [[] for _ in texts]
    for t, raw in enumerate(texts):
        hashes, places, own = S.anchors(np.frombuffer(raw, np.uint8), n, gram)
        spans[t] += S.cover(own, n)
        occurrences += [(h, t, p) for h, p in zip(hashes.tolist(), places.tolist(), strict=True)]
    occurrences.sort()
    count = Counter(h for h, _, _ in occurrences)
    occurrences = [o for o in occurrences if count[o[0]] > 1]
    if occurrences:
        before = n - gram
        groups = np.cumsum([0] + [int(a[0] != b[0]) for a, b in zip(occurrences, occurrences[1:])])
        left, around = np.array([min(p, before) for _, _, p in occurrences]), [texts[t][max(0, p - before) : p + n] for _, t, p in occurrences]
        shards = [S.transform(groups[a : a + shard], left[a : a + shard], around[a : a + shard], n, gram) for a in range(0, len(groups), shard)]
        first, last = S.merge(groups, shards, n, gram)
        for (_, t, p), a, b in zip(occurrences, first.tolist(), last.tolist(), strict=True):
            if a <= b:
                spans[t].append((p + a, p + b + n))
    out = []
    for found in spans:
        runs = []
        for a, b in sorted(found):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        out.append([tuple(r) for r in runs])
    return out


@pytest.mark.parametrize("step", [1 << 20, 7])
@pytest.mark.parametrize("dense", [64, 4, 10**9])
def test_merge_equals_brute_force(monkeypatch, step, dense):
    monkeypatch.setattr(S, "STEP", step)
    monkeypatch.setattr(S, "DENSE", dense)
    rng = random.Random(dense + step)
    for n, gram, letters in ((12, 4, b"ab"), (9, 3, b"abcd"), (16, 8, b"a\x00"), (20, 5, bytes(range(97, 123)))):
        for _ in range(25):
            pool = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(4)]
            texts = list({b"".join(rng.choice(pool) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 7))})
            assert by_merge(texts, n, gram, rng.choice([1, 2, 5, 100])) == brute(texts, n)


def documents():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    passage, other = text(90), text(120)
    docs = [text(150) + passage + text(70), passage + text(60), text(40) + " " + passage[3:], text(80) + other[:399] + text(9), other[:399] + text(80), text(50) + other[100:] + text(10), other, text(30)]
    docs += [docs[0], "short", "short", None, "", None, "ab" * 500, "x" * 400, "x" * 399, text(20) + passage + other + passage, "é" * 300 + text(40), "é" * 300 + text(40)]
    return [(i if i != 5 else None, t) for i, t in enumerate(docs)] + [(0, docs[0])]


@pytest.mark.parametrize(("cap", "rows"), [(None, 200_000), (1, -1), (3, 200_000)])
def test_documents(spark, monkeypatch, cap, rows):
    monkeypatch.setattr(S, "BROADCAST_ROWS", rows)
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = []
    for r in S.remove_repeats(df, cap=cap).collect():
        got.append((str(r.doc_id), r.n_bytes, [(s["start"], s["end"]) for s in r.removed], bytes(r.kept)))
        assert r.kept_text == bytes(r.kept).decode(errors="ignore")
    want = []
    for (k, t), spans in zip(docs, brute([t for _, t in docs], 400), strict=True):
        raw, at, kept = (t or "").encode(), 0, b""
        for a, b in spans:
            kept, at = kept + raw[at:a], b
        want.append((str(k), len(raw), spans, kept + raw[at:]))
    assert sorted(got) == sorted(want)


def test_messy(spark, messy, texts):
    want = brute([t for _, t, _ in texts], 400)
    got = sorted(str((r.doc_id, r.n_bytes, [(s["start"], s["end"]) for s in r.removed])) for r in S.remove_repeats(messy).collect())
    assert got == sorted(str((k, len((t or "").encode()), w)) for (k, t, _), w in zip(texts, want, strict=True))
    assert S.remove_repeats(messy.limit(0)).count() == 0
