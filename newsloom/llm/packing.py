"""Packing of tokenised documents into sequences of a bounded length: best-two-fit over the lengths of pieces.

A document's ids, its end id among them, are one piece; only a document longer than a sequence is cut, into whole sequences
and one shorter first piece. Which documents share a sequence depends on nothing but the lengths of the pieces, and those
are at most as many as a sequence has tokens. So the packing is worked out over counts by length: a bin is filled with the
longest piece that still fits, again and again; if a gap stays, the bin's shortest piece gives way to the two unpacked
pieces that fill the widened gap best. A bin's make-up holds for as many sequences as the counts allow, hence a plan is a
bounded list of make-ups whatever the corpus. Each piece finds its own place from its length and its number among the
pieces of that length, which tasks count for themselves; no task and no driver ever holds the pieces of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .token_output import BATCH_BYTES, END_ID, NO_ID, encoder

LENGTH, TASK_BYTES = 1024, 8_000_000
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part long, nth long"
_PIECE_T = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("part", pa.int64()), ("nth", pa.int64())])


def cut(sizes: np.ndarray, most: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, number, start and length of each piece of documents of those sizes; the first piece takes what whole ones leave."""
    pieces = -(-sizes // most)
    of = np.repeat(np.arange(len(sizes)), pieces)
    number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = (sizes - (pieces - 1) * most)[of]
    return of, number, np.where(number > 0, first + (number - 1) * most, 0), np.where(number > 0, most, first)


def write_pieces(docs: DataFrame, tokenizer_path: str, path: str, most: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write its pieces under ``path``: doc_id, piece, start, length, ids_crc32, ids (32-bit, little-endian),
    and the piece's number ``nth`` among those of its length in the task ``part`` that wrote it.

    Null and empty texts are the end id alone; repeated rows are each written; an empty table gives no pieces.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = C.id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(shared.value).encode, TaskContext.get().partitionId(), np.zeros(most + 1, np.int64)
        for batch in batches:
            doc_ids, at = C.int_column(pa.Table.from_batches([batch]), "doc_id"), 0
            for texts in C.slices_of_bytes(batch.column("text"), BATCH_BYTES):
                flat, sizes = encode(texts, end_id)
                of, number, start, length = cut(sizes, most)
                ends = np.cumsum(length)
                raw = flat.astype("<u4").tobytes()
                ids = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                lead = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0])
                nth = np.empty(len(order), np.int64)
                nth[order] = np.arange(len(order)) - np.repeat(lead, np.diff(np.r_[lead, len(order)]))
                nth += seen[length]
                seen += np.bincount(length, minlength=most + 1)
                key = doc_ids[at + of]
                yield pa.RecordBatch.from_arrays([pa.array(key, mask=key == NO_ID), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(list(map(zlib.crc32, ids)), pa.int64()), pa.array(ids, pa.binary()), pa.array(np.full(len(of), part, np.int64)), pa.array(nth)], schema=_PIECE_T)
                at += len(texts)

    # dealt in turn, so that repeated rows and long texts are spread as well
    docs.repartition(C.chunk_count(docs, TASK_BYTES)).mapInArrow(run, _PIECE).write.option("compression", "zstd").parquet(path)


def _filled(left: np.ndarray, most: int) -> list[int]:
    """One bin of lengths, by best-two-fit over the counts ``left`` by length, which stay as they are."""
    left, gap, bin_ = left.copy(), most, []
    while (fits := np.flatnonzero(left[: gap + 1])).size:
        size = int(fits[-1])
        n = min(int(left[size]), gap // size)
        bin_ += [size] * n
        left[size] -= n
        gap -= size * n
    if gap and len(bin_) > 1:
        wide = gap + bin_[-1]
        here = np.flatnonzero(left[:wide])
        # the longest unpacked length up to each value, as partner of each shorter one
        under = np.maximum.accumulate(np.where(left[: wide + 1] > 0, np.arange(wide + 1), 0))
        partner = under[wide - here]
        alone = (partner == here) & (left[here] < 2)
        partner = np.where(alone, under[here - 1], partner)
        both = np.where(partner > 0, here + partner, 0)
        if len(here) and both.max() > bin_[-1]:
            k = int(both.argmax())
            bin_[-1:] = sorted((int(here[k]), int(partner[k])), reverse=True)
    return bin_


def best_two_fit(counts: np.ndarray, most: int = LENGTH) -> list[tuple[int, list[int]]]:
    """(sequences, lengths in each): the bins in turn for pieces of which ``counts[k]`` have length k. A make-up repeats while all that it uses lasts."""
    left, out = counts.astype(np.int64).copy(), []
    while left.any():
        bin_ = _filled(left, most)
        sizes, uses = np.unique(bin_, return_counts=True)
        n = int((left[sizes] // uses).min())
        left[sizes] -= n * uses
        out.append((n, bin_))
    return out


class Places:
    """Where the k-th piece of a length goes: for each make-up, a range of the pieces of each of its lengths."""

    def __init__(self, plan: list[tuple[int, list[int]]]):
        taken: dict[int, int] = {}
        rows, sequence = [], 0
        for n, bin_ in plan:
            offset = 0
            for size in dict.fromkeys(bin_):
                uses = bin_.count(size)
                rows.append((size, taken.get(size, 0), uses, sequence, offset))
                taken[size] = taken.get(size, 0) + n * uses
                offset += uses * size
            sequence += n
        self.sequences = sequence
        self.size, self.first, self.uses, self.sequence, self.offset = (np.array(x, np.int64) for x in (zip(*sorted(rows), strict=True) if rows else [[]] * 5))
        self.key = (self.size << 48) + self.first

    def __call__(self, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = np.searchsorted(self.key, (size << 48) + number, "right") - 1
        turn = number - self.first[r]
        return self.sequence[r] + turn // self.uses[r], self.offset[r] + turn % self.uses[r] * size


def placed(spark: SparkSession, path: str, most: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Each piece under ``path`` with sequence_id and offset: sequences of at most ``most`` tokens, without gaps from offset 0."""
    pieces = spark.read.parquet(path)
    if not with_ids:
        pieces = pieces.drop("ids")
    by_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(most + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``most`` lengths
        counts[r["length"]] = r["n"]
    shared = spark.sparkContext.broadcast(Places(best_two_fit(counts, most)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(base, ["part", "length"]).withColumn("nth", F.col("base") + F.col("nth")).drop("base", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value(batch.column("length").to_numpy(), batch.column("nth").to_numpy())
            keep = [k for k, name in enumerate(batch.schema.names) if name != "nth"]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(sequence), pa.array(offset)], [batch.schema.names[k] for k in keep] + ["sequence_id", "offset"])

    kept = [f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema if f.name != "nth"]
    return numbered.mapInArrow(run, ", ".join([*kept, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, tokenizer_path: str, most: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (if asked for), sequence_id, offset for each piece of every document.

    Null and empty texts are the end id alone, so that they take one token of a sequence; repeated rows and rows of one id are
    packed each, null ids as well; an empty table gives no rows; other columns are not read.
    """
    path = C.new_path(docs.sparkSession, "pieces")
    write_pieces(docs, tokenizer_path, path, most, end_id, id_col, text_col)
    return placed(docs.sparkSession, path, most, with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, and the doc_id, piece and length of its pieces in order. A sequence is a group of bounded size."""
    at = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(at.alias("p"))
    parts = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["length"].alias("length")))
    return rows.select("sequence_id", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"), parts.alias("pieces"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pack(C.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def brute_force(lengths: list[int], most: int = LENGTH) -> list[list[int]]:
    """Best-two-fit piece by piece, for tests: the bins in turn."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        bin_, gap = [], most
        for x in list(left):
            if x <= gap:
                bin_.append(x)
                left.remove(x)
                gap -= x
        wide = gap + bin_[-1]
        pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if bin_[-1] < a + b <= wide] if gap and len(bin_) > 1 else []
        if pairs:
            _, a, b = max(pairs)
            left.append(bin_.pop())
            left.remove(a)
            left.remove(b)
            left.sort(reverse=True)
            bin_ += [a, b]
        bins.append(bin_)
    return bins
