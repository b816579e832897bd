"""Media members come back as they were stored, range by range, and a damaged one is found."""

import hashlib
import zlib

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from vintagelake.llm import media
from vintagelake.llm.common import shared_dir


def test_png_round_trip():
    for n in (0, 1, 191, 192, 193, 5000):
        payload = bytes(i * 7 % 256 for i in range(n))
        samples = media.padded(payload)
        assert len(samples) % 192 == 0 and samples.startswith(payload) and samples and set(samples[n:]) <= {32}
        stored = media.to_png(samples)
        assert media.from_png(stored) == samples
        broken = bytearray(stored)
        broken[-20] ^= 1
        with pytest.raises((ValueError, zlib.error)):
            media.from_png(bytes(broken))


def test_features_of_all_rows(spark):
    rows = [(1, "héllo"), (1, "héllo"), (None, "x" * 100_000), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1))
    out = media.media_features(media.media_column(spark, docs)).collect()
    assert len(out) == 5
    for r in out:
        text = {1: "héllo", None: "x" * 100_000}.get(r.doc_id, "")
        samples = media.padded(text.encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]))
        stored = media.to_png(samples)
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature_of(samples))
    assert media.media_column(spark, docs.limit(0)).count() == 0


def test_small_ranges_give_each_member_once(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.col("id").cast("string"), 50)).alias("text"))
    folder = f"{shared_dir(spark)}/media-test-ranges"
    media.write_archives(docs.coalesce(2), folder)
    spark.dataSource.register(media.MediaArchives)
    got = spark.read.format("media_archives").option("folder", folder).option("rangebytes", "700").load()
    assert got.rdd.getNumPartitions() > 10
    assert sorted(r.doc_id for r in got.collect()) == list(range(200))


def test_a_member_is_tried_again(tmp_path, monkeypatch):
    """The first reads fail; the member alone is read again. A damaged one is reported after the last try."""
    import zipfile

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("0.png", b"first" * 30)
        z.writestr("1.png", b"second" * 30)
    info = zipfile.ZipFile(path).infolist()
    local, opened = pafs.LocalFileSystem(), []

    class Flaky:
        def open_input_file(self, p):
            opened.append(p)
            if len(opened) < 3:
                raise OSError("lost")
            return local.open_input_file(p)

    monkeypatch.setattr(media.time, "sleep", lambda s: None)
    media._OPEN.clear()
    m = info[1]
    assert media.read_member(Flaky(), str(path), m.header_offset, m.compress_size, m.CRC) == b"second" * 30 and len(opened) == 3
    with pytest.raises(OSError):
        media.read_member(Flaky(), str(path), m.header_offset, m.compress_size, m.CRC + 1)
    media._OPEN.clear()


def plain_png(stored):
    """Samples of a grey PNG by the format's definition."""
    assert stored[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, parts = 8, {}
    while at < len(stored):
        n = int.from_bytes(stored[at : at + 4])
        parts.setdefault(stored[at + 4 : at + 8], []).append(stored[at + 8 : at + 8 + n])
        at += 12 + n
    width, height = int.from_bytes(parts[b"IHDR"][0][:4]), int.from_bytes(parts[b"IHDR"][0][4:8])
    assert parts[b"IHDR"][0][8:] == bytes([8, 0, 0, 0, 0])
    raw = zlib.decompress(b"".join(parts[b"IDAT"]))
    lines = [raw[i * (width + 1) : (i + 1) * (width + 1)] for i in range(height)]
    assert all(x[0] == 0 for x in lines)
    return b"".join(x[1:] for x in lines)


def test_archives_against_plain_readers(spark, tmp_path):
    """Members by the standard library's archive reader, samples by a plain reading of the image, features by plain sums."""
    import math
    import zipfile
    from collections import Counter

    texts = {1: "héllo wörld", 2: "", 3: "abc " * 200}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    media.write_archives(docs, f"file://{tmp_path}/m")
    (path,) = (tmp_path / "m").glob("*.zip")
    with zipfile.ZipFile(path) as z:
        members = {int(m.comment.split()[0]): z.read(m) for m in z.infolist()}
    spark.dataSource.register(media.MediaArchives)
    rows = spark.read.format("media_archives").option("folder", f"file://{tmp_path}/m").load()
    assert {r.doc_id: bytes(r.media) for r in rows.collect()} == members
    features = {r.doc_id: r for r in media.media_features(rows).collect()}
    for i, t in texts.items():
        samples = plain_png(members[i])
        assert samples == t.encode() + b" " * (len(samples) - len(t.encode())) and len(samples) % 192 == 0 and len(samples) - len(t.encode()) < 192 + (not t)
        counts, n = Counter(samples), len(samples)
        mean = sum(samples) / n
        deviation = math.sqrt(sum((x - mean) ** 2 for x in samples) / n)
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
        shares = [sum(x // 32 == k for x in samples) / n for k in range(8)]
        got = features[i].feature.split(";")
        assert [float(x) for x in got[:3]] == pytest.approx([mean, deviation, entropy], abs=1e-3)
        assert [float(x) for x in got[3].split(",")] == pytest.approx(shares, abs=1e-4)


def test_null_media(spark):
    out = media.media_features(spark.createDataFrame([(1, None, None, "x")], "doc_id long, n_bytes long, media binary, feature string")).first()
    assert out.doc_id == 1 and out.payload_sha256 is None and out.feature is None
