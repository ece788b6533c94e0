"""The whole chunking pipeline against a sequential model in plain Python."""

import re

import numpy as np
import pytest

from lectern.config import Settings
from lectern.functions.embedding import hash_vector
from lectern.functions.text import SENTENCE_END
from lectern.operators.chunking import chunk_documents
from lectern.plans.text_queries import markdown

from .test_boundary import flush, model
from .test_chunking import merge
from .test_structure import parse
from .test_text import windows


def tokens(text):
    return re.findall(r"\s*\S+|\s+", text)


def chunks(text, s):
    """(node type, text, heading path) of each chunk."""
    out = []
    for kind, _, body, _, _, path in parse(text):
        def show(label, piece, path=path):
            return f"Context: {' > '.join(path)}{label}{piece}" if path else piece

        if kind == "TABLE":
            out.append((kind, show("\nTable Data:\n", body)))
        elif kind == "LIST":
            out += [(kind, show("\nContent:\n", w)) for w in windows(tokens(body), s.max_tokens, s.overlap_tokens)]
        elif kind == "PARAGRAPH":
            found = [x.strip() for x in re.split(SENTENCE_END, body.strip()) if x.strip()]
            vectors = np.array([hash_vector(x, s.dim) for x in found])
            flags = [f for _, f in model(vectors, s.window_size, s.threshold_factor)] if len(found) else []
            cuts = [(f, len(x.split())) for f, x in zip(flags, found, strict=True)]
            for group in flush(cuts, s.min_sentences, s.min_words, s.keep_remainder):
                piece = " ".join(found[i] for i in group)
                out += [(kind, show("\nContent: ", w)) for w in windows(tokens(piece), s.max_tokens, s.overlap_tokens)]
    return [(k, t) for k, t, _ in merge(out, s.min_words)]


@pytest.mark.parametrize("s", [Settings(), Settings(max_tokens=40, overlap_tokens=15, min_words=12, keep_remainder=False)])
def test_equals_the_sequential_model(spark, sf, s):
    docs = markdown(spark, sf)
    got: dict = {}
    for r in chunk_documents(docs, s, key="doc_id").orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.node_type, r.text_data))
    rows = docs.collect()
    same = sum(got.get(r.doc_id, []) == chunks(r.text, s) for r in rows)
    # Distances within rounding of the threshold may fall on either side.
    assert same >= len(rows) - 1
