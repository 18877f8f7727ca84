"""Helpers shared by the operators: shared folders, text slices, words as Arrow arrays, packed arrays.

Texts reach Python as Arrow columns. They are cut into slices of at most ``SLICE_BYTES`` (one text
at least, so the memory of a task is bounded by the longest text) and split into words with numpy
over the bytes of the whole slice, not text by text.
"""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.session import new_folder
from orderloom.sinks.batches import cleaned_up

SLICE_BYTES = 8 << 20
KEY_BITS = 1 << 26


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """Fresh path in the folder of ``spark.checkpoint.dir``, which all executors share."""
    return new_folder(spark, purpose)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends there, and what they were shuffled by goes."""
    return stored_at(df, shared_folder(df.sparkSession, purpose))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    """The same in a folder that the caller may delete."""
    spark = df.sparkSession
    with cleaned_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def probably_among(rows: DataFrame, column: str, keys: DataFrame, among: bool = True) -> DataFrame:
    """The rows whose value is among the one column of ``keys``, and a few others; those left over if not ``among``.

    So a join with many keys need not shuffle what it will not find. Each key sets a bit of ``KEY_BITS``, whatever
    the number of keys; the bits are broadcast (8 MB at most). Null is among no keys.
    """
    name, bucket, held = keys.columns[0], *(f"{part}-{uuid.uuid4().hex}" for part in ("bucket", "bits"))
    place = F.pmod(F.xxhash64(F.col(name)), F.lit(KEY_BITS)).alias("place")
    bits = keys.filter(F.col(name).isNotNull()).select(place).groupBy(F.bitmap_bucket_number("place").alias(bucket))
    bits = stored(bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias(held)), "bits")
    mine = F.pmod(F.xxhash64(F.col(column)), F.lit(KEY_BITS))
    bit = F.bitmap_bit_position(mine)
    byte = F.conv(F.hex(F.substring(F.col(held), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # Null where no key has the bucket, or the value is null.
    found = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False)) & F.col(column).isNotNull()
    joined = rows.join(F.broadcast(bits), F.bitmap_bucket_number(mine) == F.col(bucket), "left")
    return joined.filter(found if among else ~found).select(rows.columns)


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: the fixed split of the documents (null id: of empty text)."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5).cast("int")


def worker_cache(name: str) -> dict:
    """Dictionary that lives as long as the Python worker, across tasks."""
    holder = sys.modules.setdefault("_orderloom_worker", types.ModuleType("_orderloom_worker"))
    return holder.__dict__.setdefault(name, {})


def pack(values: np.ndarray) -> bytes:
    """Array as compressed bytes; see ``unpack``. The dtype is not kept."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def unpack(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted unsigned integers as compressed differences, byte planes apart."""
    steps = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(len(steps), -1).T.tobytes())


def unpack_sorted(data: bytes, dtype=np.uint64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    steps = np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel()
    return np.cumsum(steps, dtype=dtype)


def short_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Lowers the rows of an Arrow batch, so that batches of long texts stay some megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)


def short_plans(spark: SparkSession, characters: int = 1 << 16) -> None:
    """Cuts the text of plans in ``explain()`` and in the driver's events; the plans are the same."""
    name = "spark.sql.maxPlanStringLength"
    now = spark.conf.get(name).rstrip("b")  # the default is in bytes
    if now.isdigit() and int(now) > characters:
        spark.conf.set(name, characters)


def release() -> None:
    """Gives freed memory back to the system, as a Python worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


class Slice(NamedTuple):
    """Rows ``first`` to ``last`` of a batch; their texts are ``data[offsets[i]:offsets[i + 1]]``."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The UTF-8 texts of a column in slices of about ``size`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64, n + 1 + texts.offset)[texts.offset :]
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield Slice(first, last, everything[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def byte_strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow binaries from adjoining bytes; offsets must fit 31 bits."""
    return pa.Array.from_buffers(
        pa.binary(),
        len(offsets) - 1,
        [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())],
    )


class Words(NamedTuple):
    """Words of a slice: word i is ``vocabulary[ids[i]]``; text t has words starts[t] to starts[t + 1]."""

    vocabulary: pa.Array
    ids: np.ndarray
    starts: np.ndarray


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def words(part: Slice) -> Words:
    """Maximal runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``, A-Z in lower case."""
    n_texts = len(part.offsets) - 1
    inside = ~SPACE[part.data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    borders = part.offsets[:-1][part.offsets[:-1] < part.offsets[1:]]
    opens[borders] = inside[borders]
    starts = np.searchsorted(np.flatnonzero(opens), part.offsets)
    data = LOWER[part.data[inside]]
    first = np.flatnonzero(opens[inside])
    array = byte_strings(data, np.concatenate([first, [len(data)]]) if len(first) else np.zeros(1, np.int64))
    encoded = array.dictionary_encode()
    ids = np.asarray(encoded.indices.to_numpy(zero_copy_only=False), np.int32) if len(first) else np.zeros(0, np.int32)
    assert len(starts) == n_texts + 1
    return Words(encoded.dictionary, ids, starts.astype(np.int64))


def hashes(values: pa.Array) -> np.ndarray:
    """64-bit xxhash of each binary value."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v.as_buffer()) for v in values), np.uint64, len(values))


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pack_planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers as compressed byte planes; small values take little room."""
    planes = values.astype(np.uint32).view(np.uint8).reshape(len(values), 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).ravel()


def pack_skewed(values: np.ndarray) -> bytes:
    """Unsigned integers of which most are under 255: one byte each, and the others apart."""
    large = values >= 255
    small = zstandard.ZstdCompressor(level=3).compress(np.minimum(values, 255).astype(np.uint8).tobytes())
    return len(small).to_bytes(4, "little") + small + pack_planes(values[large] - 255)


def unpack_skewed(data: bytes) -> np.ndarray:
    cut = 4 + int.from_bytes(data[:4], "little")
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:cut]), np.uint8).astype(np.uint32)
    values[values == 255] = unpack_planes(data[cut:]) + 255
    return values


def by_frequency(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """New ids, the most frequent first, and the old id of each new one."""
    old = np.argsort(-np.bincount(ids, minlength=size), kind="stable")
    new = np.empty(size, np.int64)
    new[old] = np.arange(size)
    return new[ids], old
