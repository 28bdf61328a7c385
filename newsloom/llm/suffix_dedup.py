"""Exact substring dedup over bytes: sharded suffix arrays built by induced sorting.

A window is 200 bytes. Every window picks one anchor, the 32-byte gram of smallest hash inside it; the neighbouring
windows of one anchor form a *context* of at most 368 bytes. Equal windows have equal anchors, so it is enough to
sort the contexts of one anchor together: contexts whose anchor occurs once in the corpus need no shard, equal
contexts go once with a mark that there are several. Each shard's suffix array then gives, through the permuted
common prefixes of neighbouring suffixes, every window that starts anywhere else; the bits go back to all chunks that
have the context. What is shuffled beside the texts is a hash pair per context (one for about 85 bytes of text) and
the repeated contexts' bytes once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .suffix_array import permuted_common_prefix, suffix_array

WINDOW, GRAM = 200, 32
_POSITION = np.uint64((1 << 24) - 1)
SORTED_BYTES = 1_500_000  # of contexts in one suffix array
PIECE = 1_000_000  # bytes hashed at once; bounds a task's arrays whatever the documents' lengths


class _Contexts:
    """Anchors and contexts of one chunk."""

    def __init__(self, table: pa.Table, window: int, gram: int, piece: int):
        self.data, self.offsets = C.text_bytes(table)
        found = [self._piece(a, b, window, gram) for a, b in self._pieces(window, piece)]
        self.anchor, self.hash, self.start, self.n = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate((np.uint64, np.uint64, np.int64, np.int64)))
        order = np.lexsort((self.hash, self.anchor))
        a, h = self.anchor[order], self.hash[order]
        lead = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (h[1:] != h[:-1])]) if len(a) else np.zeros(0, np.int64)
        self.keys = a[lead], h[lead]
        self.several = np.diff(np.r_[lead, len(a)]) > 1
        self.of = np.zeros(len(a), np.int64)  # the distinct context of each
        self.of[order] = np.repeat(np.arange(len(lead)), np.diff(np.r_[lead, len(a)]))
        self.first = order[lead]

    def _pieces(self, window: int, piece: int) -> list[tuple[int, int]]:
        """Runs of documents of up to ``piece`` bytes; longer documents in overlapping slices."""
        out, begin = [], 0
        for i, j in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            if j - begin <= piece:
                continue
            if i > begin:
                out.append((begin, i))
            begin = i
            while j - begin > piece:
                out.append((begin, min(begin + piece + window - 1, j)))
                begin += piece
        if self.offsets[-1] > begin:
            out.append((begin, int(self.offsets[-1])))
        return out

    def _piece(self, low: int, high: int, window: int, gram: int):
        data, width = self.data[low:high], window - gram + 1
        n = max(len(data) - window + 1, 0)
        roll = C.byte_rolling(data)
        g = roll.grams(gram)
        where = C.sliding_min((g & ~_POSITION) | np.arange(len(g), dtype=np.uint64), width)[:n] & _POSITION
        edge = np.zeros(n + 1, np.int32)
        o = np.clip(self.offsets - low, 0, len(data))
        fits = (o[1:] - o[:-1]) >= window
        np.add.at(edge, o[:-1][fits], 1)
        np.add.at(edge, o[1:][fits] - window + 1, -1)
        valid = np.cumsum(edge)[:-1] > 0
        if not n:
            return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        change = np.r_[True, where[1:] != where[:-1]]
        start = np.flatnonzero(valid & (change | np.r_[True, ~valid[:-1]]))
        last = np.flatnonzero(valid & (np.r_[change[1:], True] | np.r_[~valid[1:], True]))
        # the smallest hashes crowd at the low end of their range: mixed once more, they spread over all buckets
        return C.mix(g[where[start].astype(np.int64)]), roll(start, last + window), start + low, last - start + 1


_SENT = "bucket int, chunk int, anchors binary, hashes binary, flags binary"
_SENT_T = {"bucket": pa.int32(), "chunk": pa.int32(), "anchors": pa.binary(), "hashes": pa.binary(), "flags": pa.binary()}
_FULL = _SENT + ", sizes binary, bytes binary"
_FULL_T = _SENT_T | {"sizes": pa.binary(), "bytes": pa.binary()}
_BACK = "chunk int, bucket int, kind int, payload binary"
_BACK_T = {"chunk": pa.int32(), "bucket": pa.int32(), "kind": pa.int32(), "payload": pa.binary()}
REPEATED, SENDER, SEVERAL = 1, 2, 4


def _table(kinds: dict, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), cols, strict=True)})


def _answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {b: p for b, k, p in zip(table.column("bucket").to_pylist(), table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True) if k == kind}


def _codes(c: _Contexts, cuts: list, answers: pa.Table) -> np.ndarray:
    got = _answers(answers, 0)
    return np.concatenate([np.frombuffer(got[b], np.uint8) for b, _, _ in cuts]) if cuts else np.zeros(0, np.uint8)


def _together(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray, np.ndarray]:
    """Of a group: chunks by position, their sizes, and which distinct (anchor, hash) each entry is."""
    anchors = [C.unpack(x, np.uint64) for x in table.column("anchors").to_pylist()]
    sizes = [len(x) for x in anchors]
    a, h = np.concatenate(anchors), np.concatenate([C.unpack(x, np.uint64) for x in table.column("hashes").to_pylist()])
    order = np.lexsort((h, a))
    new = np.r_[True, (a[order][1:] != a[order][:-1]) | (h[order][1:] != h[order][:-1])]
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(new) - 1
    return a, which, sizes, order, new


def _again(contexts: list[np.ndarray], n_windows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each place of the joined contexts starts a window that starts at another place too; the windows' places."""
    length = n_windows + window - 1
    # bytes of UTF-8 are below F8, so two codes stay free: 1 ends a context, 0 ends the string
    t = np.ones(int(length.sum()) + len(length) + 1, np.uint8)
    begin = np.cumsum(length + 1) - length - 1
    for b, c in zip(begin.tolist(), contexts, strict=True):
        t[b : b + len(c)] = c + np.uint8(2)
    t[-1] = 0
    edge = np.zeros(len(t), np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + n_windows, -1)
    at = np.cumsum(edge) > 0
    sa = suffix_array(t, 2 * window)
    shared = permuted_common_prefix(t, sa, at, window) >= window
    again = shared.copy()
    again[sa[:-1][shared[sa[1:]]]] = True
    return again, np.flatnonzero(at)


def byte_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a ``window``-byte string (a multiple of 8) that also starts anywhere else.

    Returns per input row: doc_id, n_bytes, n_removed, spans (array of start and end of each maximal removed run, in
    bytes), kept (binary: the remaining bytes, which may end inside a character). Null texts count as empty; rows of
    equal id are separate texts that repeat each other.
    """
    docs = C.id_text(docs, id_col, text_col)
    n = C.chunk_count(docs)
    buckets = max(C.LEAST_CHUNKS, n // 2)
    chunks = C.with_chunks(docs, n)
    width = window - gram + 1
    row_bytes = -(-width // 8)

    def keys(table: pa.Table) -> pa.Table:
        chunk, c = table.column("chunk")[0].as_py(), _Contexts(table, window, gram, piece)
        return _table(_SENT_T, [(b, chunk, C.pack(c.keys[0][i:j]), C.pack(c.keys[1][i:j]), np.packbits(c.several[i:j]).tobytes()) for b, i, j in C.parts(C.bucket_of(c.keys[0], buckets))])

    def repeated(table: pa.Table) -> pa.Table:
        """For each entry: does its anchor repeat, does its chunk send the bytes, is the context there several times."""
        table = table.sort_by("chunk")
        a, which, sizes, order, new = _together(table)
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(table.column("flags").to_pylist(), sizes, strict=True)])
        times = np.bincount(which, several + 1.0)
        lead = np.full(len(times), len(a))
        np.minimum.at(lead, which, np.arange(len(a)))
        of_anchor = a[order][new]
        groups = np.cumsum(np.r_[True, of_anchor[1:] != of_anchor[:-1]]) - 1
        again = np.bincount(groups, times)[groups] > 1
        code = (again * REPEATED + (times > 1) * SEVERAL).astype(np.uint8)[which]
        sender = np.zeros(len(a), bool)
        sender[lead] = True
        code[sender & (code > 0)] |= SENDER
        ends = np.cumsum(sizes)
        return _table(_BACK_T, [(c, b, 0, x.tobytes()) for c, b, x in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), np.split(code, ends[:-1]), strict=True)])

    def contexts(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table(_FULL_T, [])
        c = _Contexts(table, window, gram, piece)
        cuts = C.parts(C.bucket_of(c.keys[0], buckets))
        code, text, rows = _codes(c, cuts, answers), c.data.tobytes(), []
        for b, i, j in cuts:
            pick = np.flatnonzero(code[i:j] & REPEATED) + i
            if len(pick):
                send = c.first[pick[(code[pick] & SENDER) > 0]]
                blob = b"".join([text[s : s + k + window - 1] for s, k in zip(c.start[send].tolist(), c.n[send].tolist(), strict=True)])
                rows.append((b, key[0].as_py(), C.pack(c.keys[0][pick]), C.pack(c.keys[1][pick]), code[pick].tobytes(), c.n[send].astype(np.uint16).tobytes(), blob))
        return _table(_FULL_T, rows)

    def shard(table: pa.Table) -> pa.Table:
        """Bits for each context: which of its windows start anywhere else."""
        anchors, which, sizes, _, _ = _together(table)
        code = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("flags").to_pylist()])
        owner = which[(code & SENDER) > 0]  # in the order of the bytes
        n_windows = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("sizes").to_pylist()]).astype(np.int64)
        raw = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
        length = n_windows + window - 1
        begin = np.cumsum(length) - length
        bits = np.zeros((int(which.max()) + 1, row_bytes * 8), bool)
        order = np.argsort(anchors[(code & SENDER) > 0], kind="stable")
        # only contexts of one anchor need to meet, so a shard is sorted in pieces of whole anchors
        by_anchor = anchors[(code & SENDER) > 0][order]
        new = np.r_[True, by_anchor[1:] != by_anchor[:-1]]
        piece_of = (np.maximum.accumulate(np.where(new, np.cumsum(length[order]) - length[order], 0)) // SORTED_BYTES)
        for _, i, j in C.parts(piece_of):
            some = order[i:j]
            again, at = _again([raw[x : x + k] for x, k in zip(begin[some].tolist(), length[some].tolist(), strict=True)], n_windows[some], window)
            row = np.repeat(owner[some], n_windows[some])
            first = np.cumsum(n_windows[some]) - n_windows[some]
            bits[row, np.arange(len(row)) - np.repeat(first, n_windows[some])] = again[at]
        bits[which[(code & SEVERAL) > 0]] = True
        packed = np.packbits(bits, axis=1)[which]
        ends = np.cumsum(sizes)
        return _table(_BACK_T, [(c, b, 1, x.tobytes()) for c, b, x in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), np.split(packed, ends[:-1]), strict=True)])

    def cut(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary())])
        if not table.num_rows:
            return schema.empty_table()
        c = _Contexts(table, window, gram, piece)
        cuts = C.parts(C.bucket_of(c.keys[0], buckets))
        code, got = _codes(c, cuts, answers), _answers(answers, 1)
        edge = np.zeros(len(c.data) + 1, np.int32)
        if (code & REPEATED).any():
            row = np.full(len(code), -1)
            row[(code & REPEATED) > 0] = np.arange(int(((code & REPEATED) > 0).sum()))
            bits = np.unpackbits(np.frombuffer(b"".join(got[b] for b, _, _ in cuts if b in got), np.uint8).reshape(-1, row_bytes), axis=1)
            hit = np.flatnonzero(row[c.of] >= 0)
            for part in np.array_split(hit, -(-len(hit) // 20_000)):
                i, k = np.nonzero(bits[row[c.of[part]]])
                inside = k < c.n[part][i]
                x = c.start[part][i[inside]] + k[inside]
                np.add.at(edge, x, 1)
                np.add.at(edge, x + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        spans, kept = [], []
        for i, j in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist(), strict=True):
            step = np.flatnonzero(np.diff(np.r_[False, gone[i:j], False]))
            spans.append(step.reshape(-1, 2).tolist())
            kept.append(c.data[i:j][~gone[i:j]].tobytes() if len(step) else c.data[i:j].tobytes())
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(c.offsets)), "n_removed": pa.array(C.sums_by_document(gone, c.offsets)), "spans": pa.array(spans, schema.field("spans").type), "kept": pa.array(kept, pa.binary())}, schema=schema)

    groups = chunks.groupBy("chunk")
    marks = groups.applyInArrow(keys, _SENT).groupBy("bucket").applyInArrow(repeated, _BACK)
    bits = groups.cogroup(marks.groupBy("chunk")).applyInArrow(contexts, _FULL).groupBy("bucket").applyInArrow(shard, _BACK)
    return groups.cogroup(marks.unionByName(bits).groupBy("chunk")).applyInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_repeats(C.read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, int, str]]:
    """The contract word for word, for tests on small fixtures."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen: dict[bytes, int] = {}
    for _, b in texts:
        for k in range(len(b) - window + 1):
            seen[b[k : k + window]] = seen.get(b[k : k + window], 0) + 1
    out = {}
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if seen[b[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out
