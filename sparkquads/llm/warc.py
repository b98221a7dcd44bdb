"""Dictionary-compressed WARC files.

A file starts with a skippable frame that holds a Zstandard dictionary, built from the records of that file; behind it
come a warcinfo record and one record for each page, each a frame of its own, so any of them can be read by its offset.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, fresh, from_ids, ids

MAGIC = 0x184D2A5D
DICTIONARY_BYTES, LEVEL = 64 << 10, 3
#: Bytes of pages from which a file is closed; the page that reaches them, of whatever size, is its last.
FILE_BYTES = 32 << 20
#: Length and stride, in bytes, of the pieces of which a dictionary is built.
SEGMENT, DMER = 256, 8
#: Files lie in so many folders, so that no folder and no listing of one grows too long.
FOLDERS = 256
INDEX = "page long, url string, file string, offset long, length long, digest string"


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page: int | None, url: str | None, html: str, date: str, name: uuid.UUID) -> tuple[bytes, str]:
    """A resource record of that id and the digest of its block. Without a url the page has a URN."""
    block = html.encode()
    digest = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    target = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page}"
    head = [
        "WARC/1.1",
        "WARC-Type: resource",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Block-Digest: {digest}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def info(date: str, name: uuid.UUID) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Trained on all the records. Zstandard can't train on a few short ones; then their last bytes, as they are, are a
    dictionary of raw content, which readers take in the same way."""
    try:
        return zstandard.train_dictionary(size, records, k=SEGMENT, d=DMER).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:]


def packed(first: bytes, records: list[bytes], level: int = LEVEL) -> tuple[bytes, list[tuple[int, int]]]:
    """A file of a warcinfo record and records, and offset and length of each record's frame in it."""
    d = dictionary(records)
    inner = zstandard.ZstdCompressor(level=19).compress(d)
    out = [struct.pack("<II", MAGIC, len(inner)), inner]
    z = zstandard.ZstdCompressionDict(d)
    z.precompute_compress(level=level)
    squeeze = zstandard.ZstdCompressor(level=level, dict_data=z, write_checksum=True)
    out.append(squeeze.compress(first))
    at, places = sum(map(len, out)), []
    for r in records:
        frame = squeeze.compress(r)
        places.append((at, len(frame)))
        out.append(frame)
        at += len(frame)
    return b"".join(out), places


def reader(data: bytes) -> tuple[zstandard.ZstdDecompressor, int]:
    """A decompressor with the dictionary of a file, of which data holds the beginning, and where its records begin."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("no dictionary at the start of the file")
    d = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d)), 8 + size


def unpacked(data: bytes) -> Iterator[bytes]:
    """The records of a file in turn, the warcinfo record first."""
    squeeze, at = reader(data)
    while at < len(data):
        frame = squeeze.decompressobj()
        yield frame.decompress(data[at:])
        at = len(data) - len(frame.unused_data)


def archived(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES, date: str | None = None) -> DataFrame:
    """Writes the pages to WARC files in the folder and returns their index, (page_id, url, file, offset, length,
    digest), which is stored there too. Without a folder the archive lies in the shared folder and is removed when the
    driver ends. WARC-Date is the date given or the time of the call.

    Files are written by the tasks that read the pages, without a shuffle. An attempt of a task has file names of its
    own and only those in the index count, so lost executors and repeated attempts do no harm; the other files are
    removed at the end, by tasks. Every row has its record, also if it repeats, and every record of all files an id of
    its own. The dictionary of a file with too few records to train on is their raw content (see dictionary()). A null
    html has no record: file, offset, length and digest are null. An empty html has a record of an empty block. A null
    or empty url is recorded as urn:page:<id>. Other columns are not read. An empty table gives an empty index and no
    files.
    """
    spark = pages.sparkSession
    folder, date = (folder or fresh(spark, "warc")).rstrip("/"), date or now()

    def write(batches):
        held: list[tuple[int, str | None, bytes | None, str | None]] = []
        size, file = 0, uuid.uuid4()

        def flush():
            records = [h[2] for h in held if h[2] is not None]
            places, name = iter(()), None
            if records:
                name = f"{file.int % FOLDERS:02x}/{file.hex}.warc.zst"
                fs, path = file_system(f"{folder}/files/{name}")
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                data, places = packed(info(date, file), records)
                with fs.open_output_stream(path, compression=None) as f:
                    f.write(data)
                places = iter(places)
            out = [(p, u, name, *next(places), g) if r is not None else (p, u, None, None, None, None) for p, u, r, g in held]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["page", "url", "file", "offset", "length", "digest"])

        for batch in batches:
            for page, url, html in zip(*(batch.column(i) for i in range(3))):
                page, url = page.as_py(), url.as_py()
                r, digest = record(page, url, html.as_py(), date, uuid.uuid5(file, str(len(held)))) if html.is_valid else (None, None)
                held.append((page, url, r, digest))
                size += len(r or b"") + 64
                if size >= file_bytes:
                    yield flush()
                    held.clear()
                    size, file = 0, uuid.uuid4()
        if held:
            yield flush()

    slim = pages.select(F.col("page_id").cast("long").alias("page"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    slim.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    _without_others(index, f"{folder}/files")
    return index.select(F.col("page").alias("page_id"), "url", F.concat(F.lit(f"{folder}/files/"), "file").alias("file"), "offset", "length", "digest")


def _without_others(index: DataFrame, folder: str) -> None:
    """Removes files that the index doesn't name: a task for some of the folders, each with the names that count."""

    def clean(batches):
        for batch in batches:
            for sub, names in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = file_system(f"{folder}/{sub}")
                for f in fs.get_file_info(pa.fs.FileSelector(path, allow_not_found=True)):
                    if f"{sub}/{f.base_name}" not in names:
                        fs.delete_file(f.path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    folders = index.sparkSession.range(FOLDERS).select(F.lpad(F.lower(F.hex("id")), 2, "0").alias("sub"))
    files = index.where("file is not null").select("file").distinct().groupBy(F.substring_index("file", "/", 1).alias("sub")).agg(F.collect_list("file").alias("names"))
    folders.join(files, "sub", "left").select("sub", F.coalesce("names", F.array().cast("array<string>")).alias("names")).mapInArrow(clean, "n long").count()


def restored(index: DataFrame) -> DataFrame:
    """(page_id, url, html, digest) of the index's rows, read at their offsets. The digest is recomputed; rows without a
    record have a null html and digest."""

    def read(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            open_ = {}
            for page, url, file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(5))):
                html = digest = None
                if file is not None:
                    if file not in open_:
                        open_.clear()
                        fs, path = file_system(file)
                        f = fs.open_input_file(path)
                        head = f.read(8)
                        open_[file] = f, reader(head + f.read(struct.unpack_from("<II", head)[1]))[0]
                    f, squeeze = open_[file]
                    block = squeeze.decompress(f.read_at(length, offset)).partition(b"\r\n\r\n")[2][:-4]
                    html, digest = block.decode(), "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
                for c, x in zip(cols, (page, url, html, digest)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string()))], ["page_id", "url", "html", "digest"])

    places = index.select(ids("page_id").alias("page"), "url", "file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    found = places.mapInArrow(read, "page_id long, url string, html string, digest string")
    return found.select(from_ids("page_id").alias("page_id"), "url", "html", "digest")
