"""Media columns: texts as lossless 8-bit grey images in archives, written and read by a Spark data source.

An archive is a ZIP file of stored (not compressed again) PNG members, one a row, each 64 samples wide. Its end is the
archive's directory: the offset of every member. Archives are closed at ARCHIVE_BYTES or MEMBERS members, so a directory
stays small.

Reading plans byte ranges: the driver lists the archives of the committed manifest and their sizes only and cuts them
into ranges of SPLIT_BYTES; a task owns the members that begin in its range, so each is read once. It streams its
archive's directory from the last mark before the range (the manifest holds one every MARK_BYTES of members) and stops
behind the range, so neither time nor memory depends on the rest of the archive. Payloads leave in Arrow batches of bounded bytes. A member is read by its offset and checked against its
CRC; if that fails, it alone is read again, RETRIES times with a fresh handle, and then reported in `error`, while the
others are not affected. Writing is committed by a manifest, so files of failed or repeated tasks are never read.

Null texts are empty; every payload has at least 64 bytes. Null ids and repeated rows are kept. Without rows there is
an empty manifest and no rows. Only doc_id and the text are stored, so other columns cannot clash.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from cadenza.llm.common import bound_batches, shared_dir

WIDTH, LEVEL = 64, 1
ARCHIVE_BYTES, SPLIT_BYTES, BATCH_BYTES, RETRIES = 256 << 20, 16 << 20, 4 << 20, 3
MEMBERS, MARK_BYTES, DIRECTORY_BYTES = 200_000, 4 << 20, 256 << 10
SCHEMA = "doc_id long, media binary, error string"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed value: the one table of dates that a ZIP entry needs, 1980-01-01.
_DATE = (0, 33)


# --- the format ---------------------------------------------------------------------------------------------------
def payload(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes, length: int | None = None) -> bytes:
    """8-bit grey samples, 64 a row, as PNG; equal samples give equal bytes. The private chunk caLn holds how many of
    the samples are not filler."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter type 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    note = _chunk(b"caLn", struct.pack(">Q", len(samples) if length is None else length))
    return _SIGNATURE + _chunk(b"IHDR", head) + note + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int]:
    """The samples of a PNG that to_png() made, and how many are not filler; checks every chunk."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG signature")
    at, body, shape, length = 8, [], None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + part):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">II", part[:8])
        elif kind == b"caLn":
            (length,) = struct.unpack(">Q", part)
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("unknown row filter")
    samples = lines[:, 1:].tobytes()
    return samples, len(samples) if length is None else length


def filesystem(path: str):
    """pyarrow's file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


# --- writing ------------------------------------------------------------------------------------------------------
class _Archive:
    """One ZIP file being written: members, then the directory (ZIP64 throughout, so no size limit holds)."""

    def __init__(self, files, path: str):
        self.out, self.at, self.entries, self.path = files.open_output_stream(path), 0, [], path

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        crc, raw, start = zlib.crc32(data), name.encode(), self.at
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, *_DATE, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra)) + raw + extra + data)
        self.entries.append((raw, crc, len(data), start))

    def close(self) -> dict:
        start, marks = self.at, []
        for raw, crc, n, offset in self.entries:
            if not marks or offset - marks[-1][0] >= MARK_BYTES:
                marks.append((offset, self.at - start))
            extra = struct.pack("<HHQQQ", 1, 24, n, n, offset)
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, *_DATE, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + raw + extra)
        size, end, n = self.at - start, self.at, len(self.entries)
        self._put(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1) + struct.pack("<4sHHHHIIH", b"PK\5\6", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
        self.out.close()
        return {"path": self.path, "bytes": self.at, "directory": start, "directory_bytes": size, "members": n, "marks": marks}


@dataclass
class Written(WriterCommitMessage):
    archives: list


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.uri, self.most = options["path"], int(options.get("archiveBytes", ARCHIVE_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = filesystem(self.uri)
        files.create_dir(root, recursive=True)
        done, archive, k = [], None, 0
        for batch in iterator:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode("utf-8", "replace")
                archive = archive or _Archive(files, f"{root}/{uuid.uuid4().hex}.zip")
                archive.add(f"{k}/{'' if doc_id is None else doc_id}.png", to_png(payload(raw), len(raw)))
                k += 1
                if archive.at >= self.most or len(archive.entries) >= MEMBERS:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        return Written(done)

    def commit(self, messages: list) -> None:
        files, root = filesystem(self.uri)
        files.create_dir(root, recursive=True)
        with files.open_output_stream(f"{root}/manifest.json") as f:
            f.write(json.dumps([a for m in messages if m for a in m.archives]).encode())

    def abort(self, messages: list) -> None:
        files, _ = filesystem(self.uri)
        for a in (a for m in messages if m for a in m.archives):
            files.delete_file(a["path"])


# --- reading ------------------------------------------------------------------------------------------------------
@dataclass
class Range(InputPartition):
    archive: dict
    first: int
    last: int


def directory(file, archive: dict, first: int = 0, last: int | None = None) -> Iterator[tuple[str, int, int, int]]:
    """(name, crc, size, offset) of each member that begins in the range, in order of offset; read piece by piece."""
    marks = archive.get("marks") or [(0, 0)]
    read = max((at for offset, at in marks if offset <= first), default=0)
    raw, at = b"", 0
    while True:
        n, e = struct.unpack_from("<28xHH", raw, at) if len(raw) - at >= 46 else (0, 0)
        if len(raw) - at < 46 + n + e:
            more = min(DIRECTORY_BYTES, archive["directory_bytes"] - read)
            if more <= 0:
                return
            file.seek(archive["directory"] + read)
            raw, at, read = raw[at:] + file.read(more), 0, read + more
            continue
        (crc,) = struct.unpack_from("<I", raw, at + 16)
        name = raw[at + 46 : at + 46 + n].decode()
        size, _, offset = struct.unpack_from("<4xQQQ", raw, at + 46 + n)
        if last is not None and offset >= last:
            return
        if offset >= first:
            yield name, crc, size, offset
        at += 46 + n + e


def member(open_file, archive: dict, entry: tuple, retries: int = RETRIES, wait: float = 0.05) -> tuple[bytes | None, str | None]:
    """A member's bytes by its offset, with retries of its own; or what went wrong last."""
    name, crc, size, offset = entry
    problem = None
    for attempt in range(retries + 1):
        try:
            file = open_file(attempt > 0)  # a fresh handle after a failure
            file.seek(offset)
            head = file.read(30)
            n, e = struct.unpack("<26xHH", head)
            data = file.read(n + e + size)
            if head[:4] != b"PK\3\4" or data[:n] != name.encode() or zlib.crc32(data := data[n + e :]) != crc:
                raise ValueError("damaged member")
            return data, None
        except (OSError, ValueError, struct.error, pa.ArrowException) as x:
            problem = f"{type(x).__name__}: {x}"
            time.sleep(wait * attempt)
    return None, problem


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.split, self.batch, self.retries = int(options.get("splitBytes", SPLIT_BYTES)), int(options.get("batchBytes", BATCH_BYTES)), int(options.get("retries", RETRIES))

    def partitions(self) -> list[InputPartition]:
        files, root = filesystem(self.uri)
        with files.open_input_stream(f"{root}/manifest.json") as f:
            archives = json.loads(f.read())
        out = [Range(a, at, at + self.split) for a in archives for at in range(0, a["directory"], self.split)]
        return out or [Range({}, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        files, _ = filesystem(self.uri)
        archive, handle = partition.archive, []

        def open_file(fresh: bool = False):
            if fresh and handle:
                handle.pop().close()
            if not handle:
                handle.append(files.open_input_file(archive["path"]))
            return handle[0]

        ids, media, errors, size = [], [], [], 0
        listed = files.open_input_file(archive["path"])  # a handle of its own: members are read in between
        for entry in directory(listed, archive, partition.first, partition.last):
            data, problem = member(open_file, archive, entry, self.retries)
            key = entry[0].split("/", 1)[1].removesuffix(".png")
            ids.append(int(key) if key else None)
            media.append(data)
            errors.append(problem)
            size += len(data or b"")
            if size >= self.batch:
                yield self._pack(ids, media, errors)
                ids, media, errors, size = [], [], [], 0
        listed.close()
        if ids:
            yield self._pack(ids, media, errors)

    @staticmethod
    def _pack(ids, media, errors) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(media, pa.binary()), pa.array(errors, pa.string())], names=["doc_id", "media", "error"])


class MediaArchive(DataSource):
    """format("media_archive"): rows (doc_id, text) are written, rows (doc_id, media, error) are read."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options)


def write(df: DataFrame, path: str | None = None, text: str = "text", **options) -> str:
    """Store each text's payload as a PNG member below path, by default a fresh shared folder."""
    spark = df.sparkSession
    bound_batches(spark)
    spark.dataSource.register(MediaArchive)
    path = path or shared_dir(spark, "media")
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows.write.format("media_archive").options(**options).mode("append").save(path)
    return path


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(path)


# --- features -----------------------------------------------------------------------------------------------------
def features(samples: bytes) -> str:
    """Statistics of an image's samples: rows, mean, deviation, entropy in bits, mean step, zero share."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    n = len(x)
    share = counts[counts > 0] / n
    mean = float(counts @ np.arange(256)) / n
    deviation = max(0.0, float(counts @ np.arange(256) ** 2) / n - mean * mean) ** 0.5
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    step = float(np.abs(np.diff(x.astype(np.int16))).mean())
    return f"rows={n // WIDTH};mean={mean:.4f};std={deviation:.4f};entropy={entropy:.4f};step={step:.4f};zeros={counts[0] / n:.4f}"


def with_features(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and payload (both decoded from the stored bytes), feature, media and error."""

    @F.arrow_udf("struct<n:long,payload:binary,feature:string,error:string>")
    def decoded(media: pa.Array) -> pa.Array:
        rows = []
        for m in media.to_pylist():
            try:
                samples, n = (None, None) if m is None else from_png(m)
                rows.append((n, samples, None if m is None else features(samples), None))
            except (ValueError, struct.error, zlib.error) as x:
                rows.append((None, None, None, str(x)))
        columns = list(zip(*rows)) if rows else [()] * 4
        kinds = (pa.int64(), pa.binary(), pa.string(), pa.string())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["n", "payload", "feature", "error"])

    out = df.withColumn("_d", decoded.asNondeterministic()("media"))
    return out.select("doc_id", F.col("_d.n").alias("n_bytes"), F.col("_d.payload").alias("payload"), F.col("_d.feature").alias("feature"), "media", F.coalesce("error", "_d.error").alias("error"))


def digests(df: DataFrame) -> DataFrame:
    """Sizes and digests of what with_features() read back."""
    return df.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -WIDTH, WIDTH)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", "error",
    )
