from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.llm import lines
from .conftest import python_free


def brute(rows, ratio, pages):
    total = Counter(s for _, _, s in rows)
    seen = Counter((s, x) for _, t, s in rows for x in set((t or "").split("\n")) if x and t is not None)
    bad = {k for k, n in seen.items() if n >= pages and n > ratio * total[k[0]]}
    out = []
    for k, t, s in rows:
        if t is None:
            out.append((k, None, 0, 0))
        else:
            all_lines = t.split("\n")
            kept = [x for x in all_lines if (s, x) not in bad]
            out.append((k, "\n".join(kept), len(all_lines), len(all_lines) - len(kept)))
    return out


@pytest.mark.parametrize("limit", [200_000, -1])
def test_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(lines, "BROADCAST_LINES", limit)
    rows = [(i, "\n".join(["Header", f"line {i}", "", "shared" if i % 3 else "rare", "Header"]), f"s{i % 2}") for i in range(40)]
    rows += [(100 + i, "Header\nall\nof it", None) for i in range(4)] + [(200, None, "s0"), (201, "", "s1"), (202, "Header", "alone"), (200, None, "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = lines.drop_boilerplate(df, max_ratio=0.4)
    got = sorted(str(tuple(r)) for r in out.select("doc_id", "text", "n_lines", "n_dropped").collect())
    assert got == sorted(str(r) for r in brute(rows, 0.4, 3))
    assert python_free(out) and python_free(lines.boilerplate(df))


def test_messy(spark, messy, texts):
    out = lines.drop_boilerplate(messy)
    got = sorted(str(tuple(r)) for r in out.select("doc_id", "text", "n_lines", "n_dropped").collect())
    assert got == sorted(str(r) for r in brute(texts, 0.05, 3)) and sorted(out.columns) == sorted(messy.columns)
    assert lines.drop_boilerplate(messy.limit(0)).count() == 0


def test_hosts_of_urls(spark):
    urls = [("http://a.example.com/x?y=z://q", "a.example.com"), ("HTTPS://user:pw@WWW.B.org:8080#top", "b.org"), ("ftp://[::1]:21/f", "[::1]"), ("no url", None), ("http:///path", None), ("", None), (None, None)]
    df = spark.createDataFrame(urls, "url string, want string")
    assert [(r.h, r.want) for r in df.select(lines.host_of(F.col("url")).alias("h"), "want").collect()] == [(w, w) for _, w in urls]
    pages = spark.createDataFrame([(i, f"http://{h}/{i}", f"page {i} of {h}\nMenu {h}") for h in ("a.org", "b.org") for i in range(30)], "page_id long, url string, html string")
    out = lines.drop_boilerplate(pages.withColumn("host", lines.host_of(F.col("url"))), "host", "html")
    assert {r.html for r in out.collect()} == {f"page {i} of {h}" for h in ("a.org", "b.org") for i in range(30)}
