"""Shared pieces of the corpus operators: shared storage, chunks of documents, packed exchanges, rolling hashes.

A *chunk* is a set of whole documents picked by a hash of their id, some megabytes of text each, so that the number
of chunks follows the input while the size of one does not. Operators that must compare every position of every
text send one compact sorted array per (chunk, key range) instead of one row per position; Spark shuffles and groups
those arrays, numpy works inside a task.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4_000_000
LEAST_CHUNKS = 24
_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder for shared files; a temporary one only where none is configured, as in tests."""
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None):
        return spark.conf.get("spark.checkpoint.dir")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def chunk_count(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_CHUNKS, -(-int(total) // chunk_bytes))


def with_chunks(docs: DataFrame, n: int) -> DataFrame:
    # by the text too, so that rows of one id or of none are spread
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """A bit for each ``slot`` below 2**bits; of one size whatever the rows, so it goes with tasks where a list would grow."""
    words = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits"))
    out = np.zeros(1 << bits - 6, np.int64)
    for r in words.groupBy(F.shiftright("at", 8)).agg(F.collect_list(F.struct("at", "bits")).alias("w")).select(F.col("w.at").alias("at"), F.col("w.bits").alias("bits")).toLocalIterator():
        out[r["at"]] = r["bits"]
    return out.view(np.uint8)


def is_set(bitmap: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


AMONG_BITS = 22


def among(rows: DataFrame, *columns: str) -> Column:
    """Whether a row may have the values that some row of ``rows`` has in these columns, by a bitmap of their hashes: false is certain, true
    is not. So wide rows that no join can concern need not be sent to one."""
    slot = F.pmod(F.xxhash64(*columns), F.lit(1 << AMONG_BITS))
    wanted = bitmap(rows.select(slot.alias("slot")), AMONG_BITS)

    @F.arrow_udf("boolean")
    def may(slot: pa.Array) -> pa.Array:
        return pa.array(is_set(wanted, slot.to_numpy(zero_copy_only=False)))

    return may(slot)


# -- inside tasks ---------------------------------------------------------------------------------------------------


def text_bytes(table: pa.Table, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The texts of a group as one byte array and the offsets of its documents, without copying them into Python."""
    col = table.column(name)
    arr = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if arr.type not in (pa.string(), pa.binary()):
        arr = arr.cast(pa.binary() if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else pa.string())
    offsets = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices_of_bytes(texts: pa.Array, most: int):
    """Slices of a string array of about so many bytes; a longer text is one by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, to - at)
        at = to


def int_column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).fill_null(-(2**63)).to_numpy().astype(np.int64)


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word: runs of bytes other than space and 09-0D, cut at the documents' ends."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_WHITE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[full] = word[full]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] = word[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P, _Q = int(_RNG.integers(2**62, 2**63)) * 2 + 1, int(_RNG.integers(2**62, 2**63)) * 2 + 1
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; kept for the next call in this worker."""
    if base not in _powers or len(_powers[base]) < n:
        a = np.full(max(n, 1), base & (2**64 - 1), np.uint64)
        a[0] = 1
        _powers[base] = np.multiply.accumulate(a)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a rolling hash depends on all of it."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Rolling:
    """Hashes of any slice of a sequence in constant time, from prefix sums of value * base**position."""

    def __init__(self, values: np.ndarray, base: int = _P):
        self.back = powers(pow(base, -1, 2**64), len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Of every slice of length k."""
        if len(self.sums) <= k:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.back[: len(self.sums) - k] + _U(k))


def byte_rolling(data: np.ndarray) -> Rolling:
    return Rolling(_BYTE[data], _P)


LONG_WORD = 48  # bytes; sums of powers have equal values for some strings of a thousand bytes, so longer words are hashed whole


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = byte_rolling(data)(starts, ends)
    for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return out


def word_rolling(hashes: np.ndarray, second: bool = False) -> Rolling:
    """For slices of few words; ``second`` gives other hashes of the same slices."""
    return Rolling(mix(hashes ^ _U(_P)), _P) if second else Rolling(hashes, _Q)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of that many values, in about log2(width) passes."""
    if len(a) < width:
        return a[:0]
    size, out = 1, a
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(a) - width + 1], out[width - size :]) if size < width else out


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Ranges of the hash, so that a sorted array is cut into contiguous parts."""
    return (((h >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)


def parts(buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each run of a sorted array of buckets."""
    if not len(buckets):
        return []
    cut = np.flatnonzero(np.diff(buckets)) + 1
    return list(zip(buckets[np.r_[0, cut]].tolist(), np.r_[0, cut].tolist(), np.r_[cut, len(buckets)].tolist(), strict=True))


def pack(a: np.ndarray) -> bytes:
    """The array's bytes by significance, which shuffle compression handles far better than the values in turn."""
    a = np.ascontiguousarray(a)
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unpack(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def distinct(a: np.ndarray) -> np.ndarray:
    """Of a sorted array."""
    return a[np.r_[True, a[1:] != a[:-1]]] if len(a) else a


def unique(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values; a plain sort is several times faster than numpy's own for millions of 64-bit integers."""
    return distinct(np.sort(a))


def unique_counts(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(a)
    lead = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return s[lead], np.diff(np.r_[lead, len(s)])


class Ranked:
    """Distinct values of an array, and any property of theirs spread over its places again."""

    def __init__(self, a: np.ndarray):
        self.order = np.argsort(a)
        s = a[self.order]
        new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
        self.values, self.rank = s[new], (np.cumsum(new) - 1).astype(np.int32)

    def spread(self, of_values: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.order), of_values.dtype)
        out[self.order] = of_values[self.rank]
        return out


def sums_by_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64))
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
