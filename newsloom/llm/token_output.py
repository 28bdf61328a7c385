"""Token ids in binary files: one wavelet matrix for each shard.

Documents are dealt into shards by ranges of their id, in order; a task encodes its shard's texts, ends each with the
end id, and stores the whole shard as a wavelet matrix: bit-planes with rank and select, beside the documents' ids and
lengths. A shard is one zstd-compressed Parquet file of one row, which Spark writes to and reads from any store it
knows; a reader gets token access, counts and places of any token from that one file without decoding it.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .wavelet import WaveletMatrix

SHARD_BYTES, END_ID, BATCH_BYTES = 8_000_000, 2, 8_000_000
KEPT_CHARACTERS = 6_000_000  # of the words that are remembered
ROW, ROWS = 128, 16  # pieces in a row, rows asked for at once
# the cut of a byte-level tokenizer; a fixed part of that tokenizer's definition
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

# how a word begins that is white space beside a space, or none; ``str.isspace`` of each character
_BLANK = pa.array(["", *(c for c in map(chr, range(0x110000)) if c.isspace())])


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it can be seen, else one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(other)}


def _gathered(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that have those sizes, in the order ``which``, one after the other."""
    begin, picked = np.cumsum(sizes) - sizes, sizes[which]
    ends = np.cumsum(picked)
    return flat[np.repeat(begin[which] - ends + picked, picked) + np.arange(int(ends[-1]) if len(ends) else 0)]


class _Table:
    """Ids of the strings seen so far: a number for each, and the ids of all in that order."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.held, self.flat, self.sizes = 0, [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]

    def numbers(self, names: list[str]) -> np.ndarray:
        """Of each name; -1 where it is new."""
        return np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))

    def add(self, names: list[str], flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Their numbers."""
        first = len(self.number)
        self.number.update(zip(names, range(first, first + len(names)), strict=True))
        self.flat.append(flat)
        self.sizes.append(sizes)
        self.held += sum(map(len, names))
        return np.arange(first, first + len(names))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        self.flat, self.sizes = [np.concatenate(self.flat)], [np.concatenate(self.sizes)]
        return self.flat[0], self.sizes[0]


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class ByteLevelEncoder:
    """Whole texts through the tokenizers library, which is asked once for each distinct piece of a word.

    A byte-level tokenizer without normaliser cuts a text before every single space that precedes a word, whatever stands
    around; a text in which all words are parted by single spaces is hence the sum of its words' ids, and a word that of the
    pieces into which the tokenizer's own rule cuts it. Pieces are asked for in rows, in the vocabulary's letters, which spares
    the library the cut. Other texts, and all texts of a tokenizer of another kind, go to the library whole.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.rows = Tokenizer.from_str(tokenizer_json), Tokenizer.from_str(tokenizer_json)
        self.rows.pre_tokenizer = pre_tokenizers.Split("Ġ", "merged_with_next")
        spec = json.loads(tokenizer_json)
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known_kind = not spec.get("normalizer") and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback")) and not any(" " in s for s in self.special)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[k for token, k in vocab.items() if token[:1] == "Ġ"]] = True
        self.letters = _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.words, self.pieces = _Table(), _Table()  # words stand behind a space

    def _ask(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.array([len(x) for x in ids], np.int64)

    def _piece_numbers(self, pieces: list[str]) -> np.ndarray:
        """Of distinct pieces of words. New ones are asked for, in rows where they begin with a space, as each token that does so begins one."""
        numbers = self.pieces.numbers(pieces)
        new = np.flatnonzero(numbers < 0)
        spaced = np.array([pieces[k][0] == " " for k in new.tolist()], bool)
        ahead, rest = new[spaced], [new[~spaced]]
        for i in range(0, len(ahead), ROW * ROWS):
            rows = [ahead[k : k + ROW] for k in range(i, min(i + ROW * ROWS, len(ahead)), ROW)]
            names = [[pieces[k] for k in r.tolist()] for r in rows]
            got = self.rows.encode_batch_fast(["".join(r).encode().decode("latin-1").translate(self.letters) for r in names], add_special_tokens=False)
            for at, row, ids in zip(rows, names, (np.array(e.ids, np.uint32) for e in got), strict=True):
                starts = np.flatnonzero(self.opens[ids])
                if len(starts) == len(row):
                    numbers[at] = self.pieces.add(row, ids, np.diff(np.r_[starts, len(ids)]))
                else:
                    rest.append(at)
        at = np.concatenate(rest)
        names = [pieces[k] for k in at.tolist()]
        numbers[at] = self.pieces.add(names, *self._ask(names))
        return numbers

    def _word_numbers(self, words: list[str]) -> np.ndarray:
        """Of distinct words, each behind a space."""
        numbers = self.words.numbers(words)
        at = np.flatnonzero(numbers < 0)
        new = [words[k] for k in at.tolist()]
        pieces = _PIECES.findall(" " + " ".join(new)) if new else []
        starts = [i for i, p in enumerate(pieces) if p[0] == " "]
        if len(starts) != len(new):
            numbers[at] = self.words.add(new, *self._ask([" " + w for w in new]))
        elif new:
            of = pa.array(pieces, pa.string()).dictionary_encode()
            which = self._piece_numbers(_strings(of.dictionary))[of.indices.to_numpy()]
            flat, sizes = self.pieces.arrays()
            numbers[at] = self.words.add(new, _gathered(flat, sizes, which), np.add.reduceat(sizes[which], starts))
        return numbers

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and how many each has. Texts may not be null."""
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.words.held > KEPT_CHARACTERS:
            self._forget()
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets, words = offsets - offsets[0], split.flatten().dictionary_encode()
        first = offsets[:-1]
        names, code = _strings(words.dictionary), words.indices.to_numpy()
        # white space at a word's start, or none of a word, is white space beside a space, or an empty text
        odd = pc.is_in(pc.utf8_slice_codeunits(words.dictionary, 0, 1), value_set=_BLANK).to_numpy(zero_copy_only=False) | (not self.known_kind)
        for s in self.special:
            odd |= pc.match_substring(words.dictionary, s).to_numpy(zero_copy_only=False)
        whole = np.logical_or.reduceat(odd[code], first)
        later = np.repeat(~whole, np.diff(offsets))
        later[first] = False
        used = np.flatnonzero(np.bincount(code[later], minlength=len(names)))
        place = np.zeros(len(names), np.int64)
        place[used] = self._word_numbers([names[k] for k in used.tolist()])
        flat, sizes = self.words.arrays()
        place = place[code]
        # a text's first word stands behind nothing; other texts are asked for as they are; the end follows each
        heads, at = np.unique(code[first][~whole]), np.flatnonzero(whole)
        other, theirs = self._ask([names[k] for k in heads.tolist()] + _strings(texts.take(pa.array(at))))
        place[first] = len(sizes) + np.searchsorted(heads, code[first])
        place[first[at]] = len(sizes) + len(heads) + np.arange(len(at))
        flat, sizes = np.concatenate([flat, other, np.array([end], np.uint32)]), np.r_[sizes, theirs, 1]
        later[first] = True
        ends = np.cumsum(np.bincount(np.repeat(np.arange(n), np.diff(offsets))[later], minlength=n))
        order = np.insert(place[later], ends, len(sizes) - 1)
        return _gathered(flat, sizes, order), np.add.reduceat(sizes[order], np.r_[0, ends[:-1] + np.arange(1, n)])


_encoders: dict[str, ByteLevelEncoder] = {}


def encoder(tokenizer_json: str) -> ByteLevelEncoder:
    """One for each worker process, so that its words stay known from task to task."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = ByteLevelEncoder(tokenizer_json)
    return _encoders[key]


_SHARD = "shard long, n long, doc_ids binary, lengths binary, planes array<binary>, zeros array<long>, ranks array<binary>"
_SHARD_T = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("planes", pa.list_(pa.binary())), ("zeros", pa.list_(pa.int64())), ("ranks", pa.list_(pa.binary()))])
NO_ID = -(2**63)


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text in ascending order of id (null ids first, rows of one id by text) and write the shards under ``path``.

    Null and empty texts are the end id alone; repeated rows are each written; an empty table gives no shards. Ids are those of the
    library for the whole text, whatever its length.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = C.id_text(docs, id_col, text_col)
    n = C.chunk_count(docs, SHARD_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        ids, lengths, tokens = [], [], []
        for batch in batches:
            ids.append(C.int_column(pa.Table.from_batches([batch]), "doc_id"))
            for some in C.slices_of_bytes(batch.column("text"), BATCH_BYTES):
                flat, sizes = encode(some, end_id)
                tokens.append(flat)
                lengths.append(sizes)
        if not ids or not sum(map(len, ids)):
            return
        matrix = WaveletMatrix.build(np.concatenate(tokens))
        r = matrix.to_record() | {"shard": TaskContext.get().partitionId(), "doc_ids": np.concatenate(ids).tobytes(), "lengths": np.concatenate(lengths).tobytes()}
        yield pa.RecordBatch.from_pylist([r], _SHARD_T)

    shards = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, _SHARD)
    shards.write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc_id, at, ids_crc32, n_tokens) for each document, from the files; ``at`` is its first place in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                raw = WaveletMatrix.from_record(r).decode().astype("<u4").tobytes()
                lengths = np.frombuffer(r["lengths"], np.int64)
                ends = np.cumsum(lengths)
                ids = np.frombuffer(r["doc_ids"], np.int64)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["shard"])), pa.array(ids, mask=ids == NO_ID), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    return spark.read.parquet(path).mapInArrow(run, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long")


def document_places(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32. One small row for each shard is summed in order."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spark.read.parquet(path).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return read_tokens(spark, path).join(offsets, "shard").select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def _of_each_shard(spark: SparkSession, path: str, tokens: list[int], find, schema: str) -> DataFrame:
    """``find(matrix, token)`` for each shard and token: shard, token and the columns that it gives as arrays of one length."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                matrix = WaveletMatrix.from_record(r)
                for token in tokens:
                    got = np.asarray(find(matrix, token), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), r["shard"])), pa.array(np.full(len(got), token)), pa.array(got)], names)

    return spark.read.parquet(path).mapInArrow(run, schema)


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each given token occurs in the files, by rank queries alone; nothing is decoded."""
    counts = _of_each_shard(spark, path, tokens, lambda m, t: [m.count(t)], "shard long, token long, n long")
    return counts.groupBy("token").agg(F.sum("n").alias("n"))


def token_occurrences(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """(token, doc_id, place): every occurrence of each given token and its place in the document, by select queries."""
    at = _of_each_shard(spark, path, tokens, lambda m, t: m.occurrences(t), "shard long, token long, place long")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                lengths, ids = np.frombuffer(r["lengths"], np.int64), np.frombuffer(r["doc_ids"], np.int64)
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["shard"])), pa.array(ids, mask=ids == NO_ID), pa.array(ends - lengths), pa.array(ends)], ["shard", "doc_id", "from", "to"])

    of = spark.read.parquet(path).select("shard", "doc_ids", "lengths").mapInArrow(documents, "shard long, doc_id long, from long, to long")
    # by 4,096 places, so that a shard's documents and occurrences meet by equal keys
    cells = of.withColumn("cell", F.explode(F.sequence(F.shiftright("from", 12), F.shiftright(F.col("to") - 1, 12))))
    found = at.withColumn("cell", F.shiftright("place", 12)).join(cells, ["shard", "cell"]).where((F.col("place") >= F.col("from")) & (F.col("place") < F.col("to")))
    return found.select("token", "doc_id", (F.col("place") - F.col("from")).alias("place"))


def op10_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = C.new_path(spark, "tokens")
    write_tokens(C.read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return document_places(spark, path)


def brute_force(rows: list[tuple[int, str | None]], tokenizer_path: str, end_id: int = END_ID) -> list[tuple[int, int, int, int]]:
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(tokenizer_path), 0, []
    for i, text in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out
