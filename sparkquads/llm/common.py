"""What the corpus operators share: the shared folder, tables written there, batches of texts."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null id takes part as this value; it is turned back into null in results.
NULL_ID = -(2**63)
#: Bytes of text that are tokenised at once; a longer text is taken whole, by itself.
SLICE_BYTES = 1 << 20

_ours: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Where that is unset, as in tests, a
    temporary folder is made and set, which is right on one machine only: elsewhere this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if _ours:
            return _ours[0]
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkquads-")
        _ours.append(found)
    return found.rstrip("/")


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def fresh(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/sparkquads/{what}-{uuid.uuid4().hex}"
    atexit.register(_drop, path)
    return path


def _drop(uri: str) -> None:
    try:
        fs, path = file_system(uri)
        fs.delete_dir(path)
    except OSError:
        pass  # never written, or already gone with the folder


def written(df: DataFrame, what: str) -> DataFrame:
    """Writes a table to the shared folder and reads it: it survives lost executors and has no lineage."""
    path = fresh(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Removes what written() stored, once nothing that is still to run reads it."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _drop(path)


def ids(column: str | Column = "doc_id") -> Column:
    """An id as a long that is never null, for keys of joins and groups."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column).cast("long"), F.lit(NULL_ID))


def from_ids(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != F.lit(NULL_ID), c)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string array and the len+1 offsets of its texts; null counts as empty."""
    if texts.type not in (pa.large_string(), pa.large_binary()):
        texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    off = off - off[0]
    if texts.null_count:  # null slots may hold bytes
        lengths = np.diff(off)
        if lengths[np.asarray(texts.is_null())].any():
            return text_buffer(texts.fill_null("" if texts.type == pa.large_string() else b""))
    return buf, off


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part has about `most` bytes of text or a single row."""
    n = batch.num_rows
    if not n:
        return
    _, off = text_buffer(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def pieces_of(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about `most` bytes, or of one row that is larger."""
    a = total = 0
    for i, n in enumerate(sizes):
        if total + n > most and i > a:
            yield a, i
            a, total = i, 0
        total += n
    if len(sizes) > a:
        yield a, len(sizes)


def parts_of(rows: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / each))
