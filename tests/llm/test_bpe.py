import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lectern.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_strings(reference):
    codec = bpe.ByteBpe(PATH, P.PATTERN)
    random.seed(1)
    letters = " \n\t\r\x1c\x1f\x85 　ab1é你😊'sS.<|́​½\x00zZ"
    for _ in range(5000):
        s = "".join(random.choice(letters) for _ in range(random.randint(0, 14)))
        ids = np.frombuffer(codec.encode(s), "<i4").tolist()
        assert ids == reference.encode_ordinary(s), repr(s)
        assert codec.decode(ids) == s.encode()


def test_other_vocabulary():
    codec = bpe.ByteBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    s = "Der schnelle Fuchs, qué tal? 你好"
    assert codec.decode(np.frombuffer(codec.encode(s), "<i4").tolist()) == s.encode()


def test_ranks_must_be_whole(tmp_path):
    (tmp_path / "r").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "r"))


def test_documents(spark, messy, texts, reference):
    once = bpe.round_trip(messy, PATH, P.PATTERN)
    twice = bpe.decode_documents(bpe.encode_documents(messy, PATH, P.PATTERN), PATH, P.PATTERN)
    for df in (once, twice):
        assert "score" in df.columns and len(df.columns) == len(messy.columns)
        rows = df.select("doc_id", "text", "ids", "decoded").collect()
        assert [(r.doc_id, r.text) for r in rows] == [t[:2] for t in texts]
        for r in rows:
            assert r.ids == reference.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.round_trip(messy.limit(0), PATH, P.PATTERN).count() == 0


def test_long_words_are_not_kept(reference):
    codec = bpe.ByteBpe(PATH, P.PATTERN)
    codec.encode("a " + "b" * 65 + " c")
    assert list(codec.memo) == ["c"]
