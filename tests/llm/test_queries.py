"""The rows of the registered queries without SQL, against their contracts by brute force."""

import base64
import hashlib
import re
import zlib

import public_tokenizers as P
import pytest
import tiktoken

from lectern.llm import licenses, media
from lectern.llm.queries import QUERIES

from .test_licenses import brute as base_phrases
from .test_secrets import brute as base_spans

sha = lambda raw: hashlib.sha256(raw).hexdigest()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def codec():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows(spark, sf, name, docs):
    found = QUERIES[name](spark, sf).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    return found


def test_op1(spark, sf, docs, codec):
    for r in rows(spark, sf, "op1_bpe", docs):
        ids = codec.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(docs[r.doc_id].encode()))


def test_op2(spark, sf, docs):
    stored = {}
    for r in rows(spark, sf, "op2_media", docs):
        raw = docs[r.doc_id].encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-16:]))
        png = media.to_png(payload)
        assert (r.media_bytes, r.media_sha256) == (len(png), sha(png))
        assert stored.setdefault(raw, r.feature) == r.feature


def test_op3(spark, sf, docs):
    index = licenses.Index()
    for r in rows(spark, sf, "op3_licenses", docs):
        n, starts, labels = base_phrases(docs[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(starts), starts[0] if starts else None, starts[-1] if starts else None, ",".join(labels))
        more = {m[0] for m in index.scan(docs[r.doc_id])[3]}
        assert r.labels == ",".join(sorted(more | set(labels))) and 0 <= r.score <= 1 and (r.score == 1.0 or not starts)


def test_op6(spark, sf, docs):
    for r in rows(spark, sf, "op6_secrets", docs):
        spans = base_spans(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in spans) for kind in ("assign", "access", "hex")]
        listed = [f"{k}:{a}:{e}" for k, a, e in spans]
        assert r.base_sha256 == sha(",".join(listed).encode())
        every = r.spans.split(",") if r.spans else []
        assert set(listed) <= set(every) and all(re.fullmatch(r"(assign|access|hex|random):\d+:\d+", s) for s in every)
        assert [int(s.split(":")[1]) for s in every] == sorted(int(s.split(":")[1]) for s in every)


def test_op7(spark, sf, docs, codec):
    for r in rows(spark, sf, "op7_token_counts", docs):
        assert r.n_tokens == len(codec.encode_ordinary(docs[r.doc_id]))


def test_op9(spark, sf, docs):
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    right = total = 0
    for r in rows(spark, sf, "op9_quality", docs):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id in marks:
            right, total = right + (r.predicted == marks[r.doc_id]), total + 1
    assert total and right / total >= 0.8  # of some 20 rows; test_quality has larger ones
