"""Media columns: payloads in ZIP archives, read by a Spark data source in byte ranges.

``write_archives`` stores payloads as 8-bit grey PNG images of 64 samples a row, members of
uncompressed ZIP archives of bounded size. A task names its archives afresh and returns them
as rows of a manifest; the manifest, written once, lists what finished tasks wrote, so that
archives of lost or repeated tasks are never read.

``MediaArchive`` is the source: it plans byte ranges over the archives of each file of the manifest,
laid end to end. The driver sees the manifest's files and their footers, not its rows. A range reads
the archives that start in it, each archive's own directory once; of an archive longer than a
range, every range reads the members whose header starts in it. A member is checked against the directory's CRC and, on failure, read again by its offset, alone,
with the file opened anew. Batches leave through Arrow, bounded by bytes.

Null texts count as empty; an empty payload is one row of zeros. Ids may be null or repeat:
every row is a member of its own. The stored form depends on the payload alone.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lattice.llm.common import prepare, scratch, table

WIDTH = 64
SHARD_BYTES, SPLIT_BYTES, BATCH_BYTES = 8 << 20, 8 << 20, 2 << 20
_MAGIC = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    """With zeros up to a positive multiple of the row width."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grey image, WIDTH samples a row, unfiltered."""
    rows = len(payload) // WIDTH
    if rows * WIDTH != len(payload) or not rows:
        raise ValueError("a payload is a positive multiple of the row width")
    image = np.zeros((rows, WIDTH + 1), np.uint8)
    image[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(image.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples, [rows, width]; only what encode_png writes."""
    if media[:8] != _MAGIC:
        raise ValueError("not a PNG image")
    at, width, rows, body = 8, 0, 0, []
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a damaged PNG chunk")
        if kind == b"IHDR":
            width, rows = struct.unpack_from(">II", data)
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    image = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, width + 1)
    if image[:, 0].any():
        raise ValueError("a filtered row")
    return image[:, 1:]


def feature_text(samples: np.ndarray) -> str:
    """Size, sum, an 8-bin histogram and the means of 8 bands of rows, all in whole numbers."""
    flat = samples.ravel()
    bins = np.bincount(flat >> 5, minlength=8)
    bands = [int(b.sum(dtype=np.int64) // max(b.size, 1)) for b in np.array_split(samples, 8)]
    return f"{samples.shape[1]}x{samples.shape[0]};sum={int(flat.sum(dtype=np.int64))};hist={','.join(map(str, bins))};bands={','.join(map(str, bands))}"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Any store that pyarrow knows by its URI; a bare path is local."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def write_archives(docs: DataFrame, root: str, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Stores each row's text below ``root``; ends with the manifest ``root/manifest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = filesystem(root)
        where.create_dir(f"{base}/data", recursive=True)
        held: list[tuple[int | None, int, bytes]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal size
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                for k, (doc, n, media) in enumerate(held):
                    info = zipfile.ZipInfo(f"{k:08d}.png")
                    info.comment = json.dumps({"id": doc, "n": n}).encode()
                    z.writestr(info, media)
            name = f"data/{uuid.uuid4().hex}.zip"
            with where.open_output_stream(f"{base}/{name}") as f:
                f.write(out.getbuffer())
            row = pa.RecordBatch.from_pylist([{"archive": name, "bytes": out.tell(), "members": len(held)}])
            held.clear()
            size = 0
            return row

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                media = encode_png(padded(raw))
                held.append((doc, len(raw), media))
                size += len(media) + 256
                if size >= shard_bytes:
                    yield close()
        if held:
            yield close()

    docs.select(id_col, text_col).mapInArrow(run, "archive string, bytes long, members long").write.mode("overwrite").parquet(f"{root}/manifest")


@dataclass
class ByteRange(InputPartition):
    manifest: str
    start: int
    end: int

    def __init__(self, manifest: str, start: int, end: int) -> None:
        super().__init__((manifest, start, end))
        self.manifest, self.start, self.end = manifest, start, end


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.batch = int(options.get("batchbytes", BATCH_BYTES))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        where, base = filesystem(self.root)
        files = [f.path for f in where.get_file_info(fs.FileSelector(f"{base}/manifest")) if f.path.endswith(".parquet")]
        out = []
        for path in sorted(files):
            with where.open_input_file(path) as f:
                footer = pq.ParquetFile(f).metadata
            column = footer.schema.to_arrow_schema().get_field_index("bytes")
            # rows times the largest archive: no less than the archives' bytes together
            groups = [footer.row_group(k) for k in range(footer.num_row_groups)]
            most = sum(g.num_rows * g.column(column).statistics.max for g in groups if g.num_rows)
            out += [ByteRange(path, at, at + self.split) for at in range(0, most, self.split)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.manifest:
            return
        where, base = filesystem(self.root)
        with where.open_input_file(partition.manifest) as f:
            archives = pq.read_table(f, columns=["archive", "bytes"]).to_pylist()
        rows: list[dict] = []
        held = at = 0
        for a in archives:
            start, at = at, at + a["bytes"]
            whole = a["bytes"] <= self.split
            if not (partition.start <= start < partition.end if whole else start < partition.end and at > partition.start):
                continue
            path = f"{base}/{a['archive']}"
            with where.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                members = sorted((m for m in z.infolist() if whole or partition.start <= start + m.header_offset < partition.end), key=lambda m: m.header_offset)
                for m in members:
                    media = self._member(where, path, f, m)
                    note = json.loads(m.comment)
                    rows.append({"doc_id": note["id"], "n_bytes": note["n"], "media": media})
                    held += len(media)
                    if held >= self.batch:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    def _member(self, where: fs.FileSystem, path: str, f: pa.NativeFile, m: zipfile.ZipInfo) -> bytes:
        """The member's bytes, checked; each further attempt opens the file anew at its offset."""
        for attempt in range(self.retries + 1):
            try:
                if not attempt:
                    return _read_at(f, m)
                with where.open_input_file(path) as again:
                    return _read_at(again, m)
            except (OSError, ValueError) as e:
                failed = e
        raise OSError(f"{path} at {m.header_offset}: {failed}")


def _read_at(f: pa.NativeFile, m: zipfile.ZipInfo) -> bytes:
    f.seek(m.header_offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member starts here")
    name, extra = struct.unpack_from("<HH", head, 26)
    f.seek(m.header_offset + 30 + name + extra)
    data = f.read(m.compress_size)
    if len(data) != m.compress_size or zlib.crc32(data) != m.CRC:
        raise ValueError("a damaged member")
    return data


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").load(root)``; options splitBytes, batchBytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema: object) -> MediaReader:
        return MediaReader({k.lower(): v for k, v in self.options.items()})


def read_media(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """doc_id, n_bytes and the stored bytes of every member."""
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(root)


def describe(media: DataFrame) -> DataFrame:
    """Digests and features of each stored member, from its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                stored = m.as_py()
                samples = decode_png(stored)
                payload = samples.tobytes()
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_text(samples)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _DESCRIBED, strict=True)], schema=_DESCRIBED)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


_DESCRIBED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark, "4m")
    root = scratch(spark, "media")
    write_archives(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), root)
    return describe(read_media(spark, root))
