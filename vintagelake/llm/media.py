"""Media columns: payloads as PNG members of ZIP archives, and a Spark data source that reads them back by byte ranges.

Archives lie in a folder that driver and executors share. An index table names those that committed tasks wrote, so
what a lost or repeated task left behind is never read. The source plans one partition for each byte range of an
archive; its task takes the members that begin in the range from the archive's own directory, reads each at its
offset, checks it, and tries that member again where a read fails. Rows leave in Arrow batches of bounded size.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vintagelake.llm.common import shared_dir, steps

WIDTH = 192
SHARD_BYTES = 32 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
TRIES = 4
PNG_START = b"\x89PNG\r\n\x1a\n"
COLUMNS = "doc_id bigint, n_bytes bigint, archive string, offset bigint, media binary"


def padded(payload: bytes) -> bytes:
    """The payload with blanks up to a positive multiple of WIDTH."""
    return payload + b" " * (WIDTH - len(payload) % WIDTH if len(payload) % WIDTH or not payload else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    """Samples as an 8-bit grey PNG, WIDTH wide, rows unfiltered."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return PNG_START + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of a PNG that to_png made; raises ValueError where a checksum or the form is wrong."""
    if not media.startswith(PNG_START):
        raise ValueError("not a PNG")
    at, width, height, data = len(PNG_START), 0, 0, b""
    while at < len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + size)[0]:
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a filtered row")
    return lines[:, 1:].tobytes()


def write_archives(docs: DataFrame, folder: str, text: str = "text") -> str:
    """Writes every text (null: empty) as a PNG member of an archive under folder; returns the path of the index table.

    A member's comment holds its doc_id (empty if null) and unpadded length. Each task names its archives anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        stem, done = uuid.uuid4().hex, 0
        buffer, members = io.BytesIO(), 0
        archive = zipfile.ZipFile(buffer, "w")

        def closed() -> pa.RecordBatch:
            archive.close()
            name = f"{stem}-{done}.zip"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(buffer.getbuffer())
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([members]), pa.array([buffer.tell()])], names=["archive", "members", "bytes"])

        for part, texts in steps(batches, "text"):
            for doc_id, t in zip(part.column("doc_id").to_pylist(), texts, strict=True):
                payload = t.encode()
                info = zipfile.ZipInfo(f"{members}.png")
                info.comment = b"%s %d" % (b"" if doc_id is None else b"%d" % doc_id, len(payload))
                archive.writestr(info, to_png(padded(payload)))
                members += 1
                if buffer.tell() >= SHARD_BYTES or members == 60_000:  # a plain directory holds 65,535 members
                    yield closed()
                    done, members, buffer = done + 1, 0, io.BytesIO()
                    archive = zipfile.ZipFile(buffer, "w")
        if members:
            yield closed()

    index = f"{folder}/index"
    docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "archive string, members bigint, bytes bigint").write.parquet(index)
    return index


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class MediaArchives(DataSource):
    """format("media_archives").option("folder", URI): the members that the folder's index names."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["folder"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        """Byte ranges of the archives: only names and lengths reach the driver, as in a listing of files."""
        fs, base = pafs.FileSystem.from_uri(self.folder)
        found = pads.dataset(f"{base}/index", filesystem=fs, format="parquet", exclude_invalid_files=True)
        rows = found.to_table(columns=["archive", "bytes"]).to_pylist() if found.schema.names else []
        ranges = [Range(r["archive"], at, at + self.range_bytes) for r in sorted(rows, key=lambda r: r["archive"]) for at in range(0, r["bytes"], self.range_bytes)]
        return ranges or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, base = pafs.FileSystem.from_uri(self.folder)
        path = f"{base}/{partition.archive}"
        held, size = [], 0
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            members = [(m.header_offset, m.compress_size, m.CRC, m.comment.decode()) for m in archive.infolist() if partition.start <= m.header_offset < partition.end]
        for offset, length, crc, comment in sorted(members):
            doc_id, n_bytes = comment.split(" ")
            held.append((int(doc_id) if doc_id else None, int(n_bytes), partition.archive, offset, read_member(fs, path, offset, length, crc)))
            size += length
            if size >= BATCH_BYTES:
                yield batch_of(held)
                held, size = [], 0
        if held:
            yield batch_of(held)


_OPEN: dict[str, object] = {}


def read_member(fs: pafs.FileSystem, path: str, offset: int, length: int, crc: int) -> bytes:
    """A member's stored bytes, read at its offset; a failed or damaged read is tried again for this member alone, on a fresh handle."""
    for attempt in range(TRIES):
        try:
            if path not in _OPEN:
                _OPEN.clear()
                _OPEN[path] = fs.open_input_file(path)
            f = _OPEN[path]
            f.seek(offset)
            head = f.read(30)
            name, extra = struct.unpack_from("<HH", head, 26)
            f.seek(offset + 30 + name + extra)
            data = f.read(length)
            if head[:4] != b"PK\x03\x04" or len(data) != length or zlib.crc32(data) != crc:
                raise OSError(f"member at {offset} of {path} is damaged")
            return data
        except (OSError, struct.error):
            _OPEN.pop(path, None)
            if attempt == TRIES - 1:
                raise
            time.sleep(0.1 * 2**attempt)
    raise AssertionError


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=pa.schema(kinds))


def media_column(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, archive, offset and media (the stored bytes) of every row, stored in archives and read back.

    Rows with equal or null ids stay apart; an empty table gives no rows; other columns are not read.
    """
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    write_archives(docs, folder, text)
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").option("folder", folder).load()


def feature_of(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and their shares in 8 equal ranges."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    share = counts / counts.sum()
    values = np.arange(256)
    mean = float(share @ values)
    used = share[share > 0]
    return f"{mean:.3f};{float(share @ (values - mean) ** 2) ** 0.5:.3f};{float(-(used * np.log2(used)).sum()):.3f};" + ",".join(f"{x:.4f}" for x in share.reshape(8, 32).sum(1))


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features of the samples that the stored bytes hold; the media bytes stay in the task.

    A row whose media is null has null digests and features. Equal rows stay, an empty table gives an empty one, and
    other columns are not read.
    """
    media = media.select("doc_id", "n_bytes", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for m in batch.column("media"):
                stored = m.as_py()
                if stored is None:
                    made.append((None,) * 6)
                    continue
                samples = from_png(stored)
                made.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(samples)))
            columns = list(zip(*made, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
