"""The archive source: exact round trips, ranges, retries."""

import hashlib
import zipfile
import zlib

import pytest

from cadenza.llm import media_archive as M


def test_round_trip(spark, docs, nothing, texts, tmp_path):
    path = M.write(docs, f"file://{tmp_path}/a")
    assert not M.read(spark, path).where("error is not null").count()
    got = {r.doc_id: r for r in M.digests(M.with_features(M.read(spark, path))).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        png = M.to_png(p, len(raw))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(png), hashlib.sha256(png).hexdigest(), M.features(p))
    assert None in got and M.read(spark, path).count() == docs.count()
    empty = M.write(nothing, f"file://{tmp_path}/none")
    assert M.read(spark, empty).count() == 0


def test_every_member_is_read_once_whatever_the_ranges(spark, tmp_path):
    df = spark.range(500).selectExpr("id as doc_id", "repeat(cast(id as string), cast(id as int)) as text").repartition(2)
    path = M.write(df, f"file://{tmp_path}/a", archiveBytes=20_000)
    assert len(list((tmp_path / "a").glob("*.zip"))) > 3
    for split in (700, 9_999, 1 << 24):
        got = M.read(spark, path, splitBytes=split, batchBytes=5_000)
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == list(range(500))
    with zipfile.ZipFile(next((tmp_path / "a").glob("*.zip"))) as z:  # an ordinary archive
        assert z.testzip() is None and z.namelist()


def test_a_damaged_member_does_not_affect_others(spark, tmp_path):
    df = spark.range(20).selectExpr("id as doc_id", "repeat('text ', 100) as text").coalesce(1)
    path = M.write(df, f"file://{tmp_path}/a")
    f = next((tmp_path / "a").glob("*.zip"))
    with zipfile.ZipFile(f) as z:
        at = z.infolist()[7].header_offset
    data = bytearray(f.read_bytes())
    data[at + 90] ^= 255
    f.write_bytes(bytes(data))
    got = M.read(spark, path, retries=1).collect()
    assert len(got) == 20 and [r.doc_id for r in got if r.error] == [7]


def test_a_member_is_retried_alone(tmp_path):
    import pyarrow.fs as fs

    local = fs.LocalFileSystem()
    a = M._Archive(local, f"{tmp_path}/x.zip")
    for i in range(3):
        a.add(f"{i}/{i}.png", M.to_png(bytes([i]) * 64))
    meta = a.close()
    opened, fails = [], [2]

    class Flaky:
        def __init__(self):
            self.f = local.open_input_file(f"{tmp_path}/x.zip")

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            if fails[0]:
                fails[0] -= 1
                raise OSError("connection lost")
            return self.f.read(n)

    def open_file(fresh):
        opened.append(fresh)
        return Flaky()

    entries = list(M.directory(local.open_input_file(meta["path"]), meta))
    data, problem = M.member(open_file, meta, entries[1], retries=3, wait=0)
    assert problem is None and M.from_png(data) == (b"\x01" * 64, 64) and opened == [False, True, True]
    fails[0] = 99
    assert M.member(open_file, meta, entries[1], retries=1, wait=0)[1] == "OSError: connection lost"


def test_png_is_checked():
    png = M.to_png(b"a" * 128, 100)
    assert M.from_png(png) == (b"a" * 128, 100)
    with pytest.raises(ValueError):
        M.from_png(png[:60] + b"\xff" + png[61:])
    import io

    import numpy as np

    assert io.BytesIO(png).read(8) == b"\x89PNG\r\n\x1a\n" and np.frombuffer(png, np.uint8).size == len(png)


def test_directory_is_read_from_the_mark_on(tmp_path, monkeypatch):
    """Ranges anywhere give the members that begin in them, with directories read in pieces of a few entries."""
    monkeypatch.setattr(M, "MARK_BYTES", 700)
    monkeypatch.setattr(M, "DIRECTORY_BYTES", 200)
    files, _ = M.filesystem(str(tmp_path))
    archive = M._Archive(files, f"{tmp_path}/x.zip")
    for i in range(60):
        archive.add(f"{i}/{i}.png", M.to_png(M.payload(b"x" * (i * 37 % 500))))
    meta = archive.close()
    file = files.open_input_file(meta["path"])
    every = list(M.directory(file, meta))
    assert len(every) == 60 and len(meta["marks"]) > 5
    for first in range(0, meta["directory"], 411):
        last = first + 1500
        assert list(M.directory(file, meta, first, last)) == [e for e in every if first <= e[3] < last]
    assert list(M.directory(file, meta | {"marks": []}, 3000, 9000)) == [e for e in every if 3000 <= e[3] < 9000]
