"""Media columns: payloads stored as images in archives, read back by a data source over byte ranges.

Archives are stored (uncompressed) zip files of 8-bit grey PNG images. The data source lists a directory, cuts each archive
into byte ranges, and gives a partition the members whose local headers start in its range, as the archive's own directory
at its end says. Members are read by offset, checked, and tried again one by one; batches of bounded size go out as Arrow.
"""

from __future__ import annotations

import hashlib
import io
import struct
import sys
import uuid
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import shared_dir, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNIT, WIDTH = 576, 24
#: What begins a PNG file.
PNG = b"\x89PNG\r\n\x1a\n"


def opened(uri: str):
    """(file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def to_png(payload: bytes, level: int = 3) -> bytes:
    """payload as the samples of an image of WIDTH grey pixels a row."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # a filter byte of 0 before each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return PNG + part(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), level)) + part(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png made; raises ValueError where it is damaged."""
    if media[:8] != PNG:
        raise ValueError("not a PNG file")
    at, data, width, height = 8, [], 0, 0
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != media[at + 8 + n : at + 12 + n]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", body)
            if form != [8, 0, 0, 0, 0]:
                raise ValueError("not an 8-bit grey image")
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """64 bits as hex: of the means of 65 equal strips of the samples, which are larger than the one before."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64)
    total = np.concatenate(([0.0], np.cumsum(x)))
    edges = np.arange(66) * len(x) // 65
    means = np.diff(total[edges]) / np.diff(edges)
    return np.packbits(means[1:] > means[:-1]).tobytes().hex()


def archiver(folder: str, most: int):
    """Arrow batches (id, text) to (archive, members): writes archives of about `most` bytes into folder.

    Names are random, so a second attempt never overwrites a first; only the archives of the attempt that succeeds are
    named in the result. The member's name is its running number and its extra data the id.
    """
    def run(batches):
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        made = {"file": None}

        def close():
            if made["file"]:
                made["zip"].close()
                with system.open_output_stream(f"{root}/{made['name']}") as out:
                    out.write(made["file"].getbuffer())
                made["file"] = None
                return pa.record_batch([pa.array([made["name"]]), pa.array([made["n"]], pa.int64())], ["archive", "members"])
            return None

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not made["file"]:
                    made = {"file": (f := io.BytesIO()), "zip": zipfile.ZipFile(f, "w", zipfile.ZIP_STORED), "name": f"{uuid.uuid4().hex}.zip", "n": 0}
                raw = (text or "").encode("utf-8", "surrogatepass")
                info = zipfile.ZipInfo(f"{made['n']}.png")
                info.comment = struct.pack(">Q?", len(raw), key is not None) + (b"" if key is None else str(key).encode())
                made["zip"].writestr(info, to_png(padded(raw)))
                made["n"] += 1
                if made["file"].tell() >= most and (row := close()):
                    yield row
        if row := close():
            yield row

    return run


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    """Members (id, n_bytes, media, payload) of the archives in a directory; payload is null and error set where a member can't be read."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.step = int(options.get("rangeBytes", 4 << 20))
        self.tries = int(options.get("tries", 3))
        self.batch = int(options.get("batchBytes", 8 << 20))

    def partitions(self):
        from pyarrow import fs

        system, root = opened(self.path)
        files = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.path.endswith(".zip")]
        return [Range(f.path, at, at + self.step) for f in sorted(files, key=lambda f: f.path) for at in range(0, max(f.size, 1), self.step)] or [Range("", 0, 0)]

    def member(self, system, path: str, info) -> tuple:
        """Opens the archive anew for each try, at the member's own offset; (media, payload, error)."""
        error = ""
        for _ in range(self.tries):
            try:
                with system.open_input_file(path) as f:
                    head = f.read_at(30, info.header_offset)
                    if head[:4] != b"PK\x03\x04":
                        raise ValueError("no member here")
                    name, extra = struct.unpack_from("<HH", head, 26)
                    media = f.read_at(info.file_size, info.header_offset + 30 + name + extra)
                if zlib.crc32(media) != info.CRC:
                    raise ValueError("damaged member")
                return media, from_png(media), None
            except Exception as e:  # noqa: BLE001  the error is in the row
                error = f"{type(e).__name__}: {e}"
        return None, None, error

    def read(self, partition):
        if not partition.path:
            return
        system, _ = opened(self.path)
        with system.open_input_file(partition.path) as f, zipfile.ZipFile(f) as z:
            infos = [i for i in z.infolist() if partition.start <= i.header_offset < partition.end]
        rows, size = [], 0
        for info in infos:
            media, payload, error = self.member(system, partition.path, info)
            n, known = struct.unpack_from(">Q?", info.comment)
            rows.append((info.comment[9:].decode() if known else None, n, media, payload, error))
            size += len(media or b"") + len(payload or b"")
            if size >= self.batch:
                yield self.arrow(rows)
                rows, size = [], 0
        if rows:
            yield self.arrow(rows)

    @staticmethod
    def arrow(rows):
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "n_bytes", "media", "payload", "error"])


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").load(directory)"""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return "id string, n_bytes bigint, media binary, payload binary, error string"

    def reader(self, schema):
        return ArchiveReader(self.options)


def digests():
    """Arrow batches of the source to the columns of media_columns; a member that couldn't be read ends the job."""
    def run(batches):
        for batch in batches:
            rows = []
            for key, n, media, payload, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if error:
                    raise ValueError(f"document {key}: {error}")
                rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = 16 << 20) -> str:
    """Writes the texts as images into archives in the shared folder and returns their directory.

    An archive of an attempt that was lost stays out of it: the directory is sifted by the names that the job returned.
    """
    folder = f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    made = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(archiver(folder, archive_bytes), "archive string, members long"), "archives")
    system, root = opened(folder)
    system.create_dir(root, recursive=True)
    names = {r["archive"] for r in made.select("archive").toLocalIterator()}  # one name per archive, not per document
    from pyarrow import fs

    for f in system.get_file_info(fs.FileSelector(root)):
        if f.base_name not in names:
            system.delete_file(f.path)
    return folder


def load(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(**{k: str(v) for k, v in options.items()}).load(folder)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The payload is the text in UTF-8 with bytes 255 up to a positive multiple of 576; null counts as empty. All values but
    n_bytes come from what was read back, and equal texts have equal values. Repeated rows stay repeated, a null id stays
    null, other columns are not looked at. One archive in memory per task, of about 16 MB and its last text.
    """
    kind = docs.schema[id_col].dataType
    back = load(docs.sparkSession, store(docs, id_col, text_col)).mapInArrow(digests(), "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return back.select(F.col("id").cast(kind).alias(id_col), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
