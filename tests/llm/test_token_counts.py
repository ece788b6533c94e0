import numpy as np
import public_tokenizers as P
import pytest

from lectern.llm import bpe, token_counts

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("block", [3, 1000, 1 << 20])
@pytest.mark.parametrize("eod", [9, 70_000])
def test_scan_of_flat_files(spark, tmp_path, block, eod):
    kind = "<u2" if eod < 1 << 16 else "<u4"
    rng = np.random.default_rng(block)
    want, names = [], []
    for n, closed in enumerate((True, False, True, True)):
        lengths = [int(x) for x in rng.integers(0, 12, 15)] if n < 2 else [] if n == 2 else [0, 0, 40]
        ids = [t for x in lengths for t in [*rng.integers(0, 8, x).tolist(), eod]]
        if not closed:
            ids = [*ids, 1, 2]
            lengths = [*lengths, 2]
        name = str(tmp_path / f"{n}.tokens")
        np.array(ids, kind).tofile(name)
        names.append((name,))
        at = 0
        for i, x in enumerate(lengths):
            want.append((name, i, at, x))
            at += x + 1
    files = spark.createDataFrame(names + names[:1], "file string")
    got = [(r.file, r.ordinal, r.start, r.n_tokens) for r in token_counts.scan(files, f"file://{tmp_path}", eod, block).collect()]
    assert sorted(got) == sorted(want)


def test_documents(spark, messy, texts):
    codec = bpe.ByteBpe(PATH, P.PATTERN)
    for block in (50, 1 << 20):
        got = sorted(str((r.key, r.n_tokens)) for r in token_counts.count_tokens(messy.repartition(3), PATH, P.PATTERN, 50256, block_tokens=block).collect())
        assert got == sorted(str((k, len(codec.encode(t or "")) // 4)) for k, t, _ in texts)
    assert token_counts.count_tokens(messy.limit(0), PATH, P.PATTERN, 50256).count() == 0


def test_ids_fit_and_the_separator_is_no_token():
    n = len(bpe.read_ranks(PATH))
    assert token_counts.width_for(PATH, n) == 2 and token_counts.width_for(PATH, 70_000) == 4
    for eod in (0, n - 1, 1 << 32):
        with pytest.raises(ValueError):
            token_counts.width_for(PATH, eod)
