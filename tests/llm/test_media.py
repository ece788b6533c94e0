import hashlib
import zipfile
import zlib

import pytest

from lectern.llm import media


def test_png_round_trip():
    for raw in (b"", b"a", b"x" * 192, bytes(range(256)) * 7):
        payload = media.pad(raw)
        assert len(payload) % 192 == 0 and payload and payload.startswith(raw)
        assert media.from_png(media.to_png(payload)) == payload
    assert len(media.pad(b"x" * 192)) == 192
    broken = bytearray(media.to_png(media.pad(b"abc")))
    broken[60] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.from_png(bytes(broken))


@pytest.mark.parametrize("range_bytes", [700, 1 << 24])
def test_texts_come_back(spark, messy, texts, tmp_path, range_bytes):
    folder = f"file://{tmp_path}/a"
    manifest = media.write_archives(messy.repartition(3), folder, "doc_id", "text")
    assert sum(r.members for r in manifest.collect()) == len(texts)
    rows = media.features(media.archives(spark, folder, range_bytes)).collect()
    assert media.archives(spark, folder, range_bytes, manifest).count() == len(rows)
    got = sorted((str(r.key), r.n_bytes, bytes(r.payload)) for r in rows)
    want = sorted((str(k), len((t or "").encode()), media.pad((t or "").encode())) for k, t, _ in texts)
    assert got == want
    assert all(r.tail_crc32 == zlib.crc32(bytes(r.payload)[-16:]) and media.from_png(bytes(r.media)) == bytes(r.payload) for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(hashlib.sha256(bytes(r.payload)).hexdigest(), set()).add((bytes(r.media), r.feature))
    assert all(len(v) == 1 for v in by_text.values())


def test_empty(spark, messy, tmp_path):
    assert media.media_columns(messy.limit(0)).count() == 0
    assert media.archives(spark, f"file://{tmp_path}/nothing").count() == 0


def test_a_used_folder_gives_only_the_rows_written(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    assert media.media_columns(df, folder=folder).count() == 50
    got = media.media_columns(df.where("doc_id >= 48").unionByName(df.where("doc_id = 3")), folder=folder).collect()
    assert sorted(r.key for r in got) == [3, 48, 49] and media.archives(spark, folder).count() == 53


def test_features_of_null_payloads_and_keys_that_are_no_integers(spark, messy):
    df = spark.createDataFrame([(1, None, "x"), (2, bytearray(b""), "y"), (3, bytearray(b" " * 192), "z")], "key long, payload binary, Feature string")
    rows = {r.key: (r.feature, r.tail_crc32) for r in media.features(df).collect()}
    assert rows[1] == rows[2] == (None, None) and rows[3][1] == zlib.crc32(b" " * 16) and rows[3][0].startswith("lines=1;")
    with pytest.raises(ValueError):
        media.write_archives(messy, "file:///nowhere", "source", "text")


def test_ranges_cover_every_byte_once(tmp_path):
    for n in range(3):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as z:
            z.writestr("a", b"x" * 1000 * n)
    (tmp_path / "_partial-1").write_bytes(b"junk")
    for most in (1000, 2, 1):
        parts = media.ArchiveReader({"path": f"file://{tmp_path}", "rangebytes": 300, "maxpartitions": most}).partitions()
        assert len(parts) <= most and (most < 1000 or all(sum(e - a for _, a, e in p.ranges) <= 300 for p in parts))
        ranges = [r for p in parts for r in p.ranges]
        assert {r[0].rsplit("/", 1)[1] for r in ranges} == {"0.zip", "1.zip", "2.zip"}
        for n in range(3):
            own = sorted((a, e) for p, a, e in ranges if p.endswith(f"{n}.zip"))
            assert own[0][0] == 0 and own[-1][1] == (tmp_path / f"{n}.zip").stat().st_size and all(a[1] == b[0] for a, b in zip(own, own[1:]))


def test_members_are_tried_again_by_themselves(tmp_path, monkeypatch):
    from pyarrow import fs

    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("0.1.3.png", media.to_png(media.pad(b"abc")))
    member = zipfile.ZipFile(path).infolist()[0]

    class Broken:
        def seek(self, n):
            raise OSError("gone")

    local = fs.LocalFileSystem()
    assert media.read_member(local, path, Broken(), member)[1] == media.pad(b"abc")
    with open(path, "r+b") as f:
        f.seek(member.header_offset + 60)
        f.write(b"\xff\xff")
    with pytest.raises(ValueError):
        media.read_member(local, path, open(path, "rb"), member)
