"""Media columns: payloads kept as baseline JPEG, read back with dimensions and thumbnail hashes (see jpeg.py).

All steps are map-only and work through a batch in slices of bounded bytes, so memory doesn't depend on the table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm import jpeg
from sojourn.llm.common import bound_batches, byte_view, slices, text_or_empty

UNIT = jpeg.ROW
STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
READ = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with spaces to a positive multiple of UNIT."""
    size = np.diff(starts)
    to = np.r_[0, np.cumsum(np.maximum(-(-size // UNIT), 1) * UNIT)]
    out = np.full(to[-1], 32, np.uint8)
    out[np.arange(starts[-1] - starts[0]) + np.repeat(to[:-1] - starts[:-1] + starts[0], size)] = data[starts[0] : starts[-1]]
    return out, to


def store_texts(ids: pa.Array, texts: pa.Array, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    data, starts = byte_view(texts)
    for i, j in slices(starts, most):
        payload, to = pad(data, starts[i : j + 1])
        yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(np.diff(starts[i : j + 1])), pa.array(jpeg.encode(payload, to), pa.binary())], schema=STORED)


def read_media(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Features of stored media: all null but doc_id, n_bytes and the media's own size and digest if it isn't baseline JPEG."""
    media = batch.column("media").to_pylist()
    rows = []
    for m, thumbs in zip(media, jpeg.thumbnails(media)):
        own = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
        if thumbs is None:
            rows.append((None, None, None, *own, None))
            continue
        payload = b"".join(t.tobytes() for t in thumbs)
        feature = "+".join(f"{t.shape[1] * 8}x{t.shape[0] * 8}:{jpeg.thumbnail_hashes(t)}" for t in thumbs)
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *own, feature))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(x, k) for x, k in zip(zip(*rows), READ.types[2:]))], schema=READ)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from store_texts(b.column(0), b.column(1))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (read_media(b.slice(i, 500)) for b in batches for i in range(0, b.num_rows, 500))


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return map(read_media, _store(batches))


def _texts(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text (null: empty) as UTF-8, padded with spaces to a positive multiple of 192 bytes and
    kept as JPEG. One row per row; null ids stay null; further columns are ignored; equal texts have equal media."""
    return _texts(docs).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def read(stored: DataFrame) -> DataFrame:
    """Decode a table (doc_id, n_bytes, media): payload digest, crc32 of its last 16 bytes, dimensions and thumbnail hashes."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_read, _READ)


def store_and_read(docs: DataFrame) -> DataFrame:
    """read(store(docs)) in one pass, for when the media themselves needn't be kept."""
    return _texts(docs).mapInArrow(_both, _READ)
