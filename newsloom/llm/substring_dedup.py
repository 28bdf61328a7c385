"""Substring dedup over words: seed and extend.

Seeds are winnowed anchors: of the 9 five-word grams inside each window of 13 words, the one of the smallest hash.
Equal windows have equal anchors, so a join of documents on anchors loses no match. Anchors that occur in one
document only are dropped. The others are extended: the stretch of words around an anchor, whose windows all have it,
meets all stretches of the same seed, and those are split word by word to both sides into classes that agree so far. Windows
that agree in all 13 words are one class at the end, whose smallest document id decides; adjoining matches merge into maximal repeats.

Documents are cut into chunks. The join on anchors sends sorted hashes per (chunk, hash range) and gets back one bit for
each; the extension sends each distinct stretch of a chunk once, so a passage shared by a third of all documents is one entry per
chunk, not one per document. A stretch travels under a longer seed than its anchor (nine or ten of its words), so a frequent
anchor in many surroundings is many small groups.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

WINDOW, GRAM = 13, 5


class _Windows:
    """Words, windows and anchors of one chunk; the same arrays for any order of its rows."""

    def __init__(self, table: pa.Table, window: int, gram: int):
        self.data, self.offsets = C.text_bytes(table)
        self.ids = C.int_column(table, "doc_id")
        self.starts, self.ends, self.doc = C.word_bounds(self.data, self.offsets)
        n = max(len(self.starts) - window + 1, 0)
        self.words = C.word_hashes(self.data, self.starts, self.ends)
        self.roll = C.word_rolling(self.words)
        inside = self.doc[:n] == self.doc[window - 1 :] if n else np.zeros(0, bool)
        self.at = np.flatnonzero(inside)
        grams = self.roll.grams(gram)
        least = C.sliding_min(grams, window - gram + 1)[:n][self.at]
        self.place = np.full(len(self.at), -1)  # of the anchor, the first of its value
        for k in range(window - gram, -1, -1):
            hit = grams[self.at + k] == least
            self.place[hit] = self.at[hit] + k
        # the smallest hashes crowd at the low end of their range: mixed once more, they spread over all buckets
        self.anchor = C.mix(least)


class _Stretches:
    """Stretches of windows with one anchor, on one side of its middle, and the distinct ones among them."""

    def __init__(self, w: _Windows, mask: np.ndarray, window: int, gram: int):
        self.at = w.at[mask]
        before = w.place[mask] - self.at  # words of the window before its anchor
        self.half = (window - gram + 1) // 2
        late = before > self.half
        new = np.r_[True, (np.diff(w.place[mask]) != 0) | (np.diff(self.at) != 1) | (late[1:] != late[:-1])] if len(self.at) else np.zeros(0, bool)
        lead = np.flatnonzero(new)
        self.n = np.diff(np.r_[lead, len(self.at)])
        start, left = self.at[lead], before[lead]
        right = window - gram - before[lead + self.n - 1] if len(lead) else left
        end = start + self.n + window - 1
        ids = w.ids[w.doc[start]]
        second = C.word_rolling(w.words, True)
        h, g = w.roll(start, end), second(start, end)
        order = np.lexsort((ids, left, g, h))
        same = [x[order] for x in (h, g, left)]
        first = np.flatnonzero(np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in same])]) if len(lead) else np.zeros(0, np.int64)
        of = np.zeros(len(lead), np.int64)
        of[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(lead)]))
        pick = order[first]  # of each distinct stretch, the row of smallest id
        place = start[pick] + left[pick]
        low, high = np.where(late[lead][pick], place - self.half - 1, place), np.where(late[lead][pick], place + gram, place + gram + self.half)
        seed, other = C.mix(w.roll(low, high) + late[lead][pick]), second(low, high)
        order = np.argsort(seed, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.of = rank[of]
        pick = pick[order]
        self.other, self.low, self.high = other[order], low[order], high[order]
        self.seed, self.ids, self.left, self.right, self.start, self.end, self.windows, self.late = seed[order], ids[pick], left[pick], right[pick], start[pick], end[pick], self.n[pick], late[lead][pick]


def _split(classes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Classes that agree in one more word."""
    order = np.lexsort((words, classes))
    c, w = classes[order], words[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(np.r_[True, (c[1:] != c[:-1]) | (w[1:] != w[:-1])]) - 1 if len(order) else 0
    return out


def _earlier(seed: np.ndarray, other: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, late: np.ndarray, words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window of each stretch, in order: whether a stretch of smaller id has it, by extending the seeds. ``words`` are
    those outside the seeds, which are equal where both their hashes are."""
    reach, half = window - gram, (window - gram + 1) // 2
    within = gram + half + late  # words of the seed
    size = left + gram + right - within
    table = np.zeros((len(seed), 2 * reach + gram), np.uint64)  # column ``reach`` is the anchor's first word
    row = np.repeat(np.arange(len(seed)), size)
    column = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + (reach - left)[row]
    begin = np.where(late, reach - half - 1, reach)
    table[row, column + np.where(column >= begin[row], within[row], 0)] = words
    found = np.zeros((len(seed), reach + 1), bool)  # by the number of words before the anchor
    for side in (False, True):
        at = np.flatnonzero(late == side)
        low, high = (reach - half - 1, reach + gram - 1) if side else (reach, reach + gram + half - 1)
        base = _split(np.unique(seed[at], return_inverse=True)[1], other[at])
        to_left, to_right = {low: base}, {high: base}
        for k in range(low - 1, -1, -1):
            to_left[k] = _split(to_left[k + 1], table[at, k])
        for k in range(high + 1, table.shape[1]):
            to_right[k] = _split(to_right[k - 1], table[at, k])
        for before in range(half + 1, reach + 1) if side else range(half + 1):
            has = np.flatnonzero((left[at] >= before) & (right[at] >= reach - before))
            a, b = to_left[min(low, reach - before)][has], to_right[max(high, reach - before + window - 1)][has]
            which = np.unique(a * (len(at) + 1) + b, return_inverse=True)[1]
            least = np.full(len(has) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, which, ids[at[has]])
            found[at[has], before] = least[which] < ids[at[has]]
    before = np.arange(reach, -1, -1)
    valid = (left[:, None] >= before) & (right[:, None] >= reach - before) & ((before > half) == late[:, None])
    return found[:, ::-1][valid]


def _bits(answers: pa.Table, counts: dict[int, int]) -> dict[int, np.ndarray]:
    return {b: np.unpackbits(np.frombuffer(p, np.uint8), count=counts[b]).astype(bool) for b, p in zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True)}


def _spread(values: np.ndarray, of: np.ndarray, buckets: int, answers: pa.Table) -> np.ndarray:
    """The answer bit of each element of ``of``, given by the sorted distinct ``values`` sent before."""
    flags = np.zeros(len(values), bool)
    cuts = C.parts(C.bucket_of(values, buckets))
    found = _bits(answers, {b: j - i for b, i, j in cuts})
    for b, i, j in cuts:
        flags[i:j] = found[b]
    return flags[np.searchsorted(values, of)] if len(of) else np.zeros(0, bool)


_SENT = "bucket int, chunk int, payload binary, extra binary"
_WORDS = "bucket int, chunk int, seeds binary, ids binary, shape binary, words binary"
_WORDS_T = {"bucket": pa.int32(), "chunk": pa.int32(), "seeds": pa.binary(), "ids": pa.binary(), "shape": pa.binary(), "words": pa.binary()}
_BACK = "chunk int, bucket int, payload binary"


def _rows(schema: dict, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(schema.items(), cols, strict=True)})


_SENT_T = {"bucket": pa.int32(), "chunk": pa.int32(), "payload": pa.binary(), "extra": pa.binary()}
_BACK_T = {"chunk": pa.int32(), "bucket": pa.int32(), "payload": pa.binary()}


def _anchor_values(w: _Windows) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors of the chunk, and whether more than one of its documents has them."""
    if not len(w.at):
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    step = np.r_[True, (w.anchor[1:] != w.anchor[:-1]) | (w.doc[w.at][1:] != w.doc[w.at][:-1])]
    a, ids = w.anchor[step], w.ids[w.doc[w.at[step]]]
    order = np.lexsort((ids, a))
    a, ids = a[order], ids[order]
    first = np.r_[True, a[1:] != a[:-1]]
    lead = np.flatnonzero(first)
    several = np.zeros(len(lead), bool)
    last = np.r_[lead[1:], len(a)] - 1
    several |= ids[lead] != ids[last]
    return a[lead], several


def substring_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats of at least ``window`` words that also occur in a document of smaller id, and what is left.

    Returns per input row: doc_id, n_words, n_removed, spans (array of first and end word of each maximal repeat),
    kept (the remaining words joined by single spaces). A null text has no words. Rows of equal id are one document for the rule
    "smaller id" (they do not remove each other) but keep a row each; a null id counts as the smallest. Seeds are compared
    by two hashes of 64 bits, the words around them by one each, at their places.
    """
    docs = C.id_text(docs, id_col, text_col)
    n = C.chunk_count(docs)
    buckets = max(C.LEAST_CHUNKS, n // 8)
    chunks = C.with_chunks(docs, n)

    def seeds(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        a, several = _anchor_values(_Windows(table, window, gram))
        return _rows(_SENT_T, [(b, chunk, C.pack(a[i:j]), np.packbits(several[i:j]).tobytes()) for b, i, j in C.parts(C.bucket_of(a, buckets))])

    def repeated(table: pa.Table) -> pa.Table:
        got = [C.unpack(x, np.uint64) for x in table.column("payload").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(g)) for x, g in zip(table.column("extra").to_pylist(), got, strict=True)]
        values, inverse = np.unique(np.concatenate(got), return_inverse=True)
        flags = (np.bincount(inverse, np.concatenate(several) + 1.0, len(values)) > 1)[inverse]
        ends = np.cumsum([len(g) for g in got])
        return _rows(_BACK_T, [(c, b, np.packbits(f).tobytes()) for c, b, f in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), np.split(flags, ends[:-1]), strict=True)])

    def around(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        """The stretches around repeated anchors, by seed."""
        if not table.num_rows:
            return _rows(_WORDS_T, [])
        w = _Windows(table, window, gram)
        x, out = _Stretches(w, _spread(_anchor_values(w)[0], w.anchor, buckets, answers), window, gram), []
        for b, i, j in C.parts(C.bucket_of(x.seed, buckets)):
            size = x.end[i:j] - x.start[i:j]
            at = np.repeat(x.start[i:j] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            at = at[(at < np.repeat(x.low[i:j], size)) | (at >= np.repeat(x.high[i:j], size))]
            shape = np.stack([x.left[i:j], x.right[i:j], x.late[i:j]]).astype(np.uint8)
            out.append((b, key[0].as_py(), C.pack(np.r_[x.seed[i:j], x.other[i:j]]), C.pack(x.ids[i:j]), shape.tobytes(), C.pack(w.words[at])))
        return _rows(_WORDS_T, out)

    def earlier(table: pa.Table) -> pa.Table:
        """Whether a smaller id has the window, for each window of each stretch."""
        seeds = [C.unpack(x, np.uint64).reshape(2, -1) for x in table.column("seeds").to_pylist()]
        shape = np.concatenate([np.frombuffer(x, np.uint8).reshape(3, -1) for x in table.column("shape").to_pylist()], axis=1).astype(np.int64)
        ids, words = (np.concatenate([C.unpack(x, t) for x in table.column(c).to_pylist()]) for c, t in (("ids", np.int64), ("words", np.uint64)))
        flags = _earlier(*np.concatenate(seeds, axis=1), ids, shape[0], shape[1], shape[2] > 0, words, window, gram)
        n_windows = shape[0] + shape[1] - (window - gram) + 1
        ends = np.cumsum(n_windows)[np.cumsum([x.shape[1] for x in seeds]) - 1]
        return _rows(_BACK_T, [(c, b, np.packbits(f).tobytes()) for c, b, f in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), np.split(flags, ends[:-1]), strict=True)])

    def cut(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.string())])
        if not table.num_rows:
            return schema.empty_table()
        w = _Windows(table, window, gram)
        kind = np.array(answers.column("kind").to_pylist(), bool)
        mask = _spread(_anchor_values(w)[0], w.anchor, buckets, answers.filter(pa.array(~kind)))
        x = _Stretches(w, mask, window, gram)
        cuts = C.parts(C.bucket_of(x.seed, buckets))
        got = _bits(answers.filter(pa.array(kind)), {b: int(x.windows[i:j].sum()) for b, i, j in cuts})
        flags = np.concatenate([np.zeros(0, bool), *(got[b] for b, _, _ in cuts)])
        begin = np.cumsum(x.windows) - x.windows
        within = np.arange(len(x.at)) - np.repeat(np.cumsum(x.n) - x.n, x.n)
        of = np.repeat(x.of, x.n)
        at, dup = x.at, flags[begin[of] + within] if len(x.at) else np.zeros(0, bool)
        if len(at):
            dup = dup | (x.ids[of] < w.ids[w.doc[at]])
        edge = np.zeros(len(w.starts) + 1, np.int64)
        np.add.at(edge, at[dup], 1)
        np.add.at(edge, at[dup] + window, -1)
        gone = np.cumsum(edge)[:-1] > 0
        words = np.searchsorted(w.starts, w.offsets)  # the first word of each document
        text = w.data.tobytes()
        spans, kept = [], []
        for i, j in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
            g = gone[i:j]
            step = np.flatnonzero(np.diff(np.r_[False, g, False]))
            spans.append(step.reshape(-1, 2).tolist())
            stay = np.flatnonzero(~g) + i
            kept.append(b" ".join([text[a:b] for a, b in zip(w.starts[stay].tolist(), w.ends[stay].tolist(), strict=True)]).decode())
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(np.diff(words)), "n_removed": pa.array(C.sums_by_document(gone, words)), "spans": pa.array(spans, schema.field("spans").type), "kept": pa.array(kept, pa.string())}, schema=schema)

    from pyspark.sql import functions as F

    groups = chunks.groupBy("chunk")
    marks = groups.applyInArrow(seeds, _SENT).groupBy("bucket").applyInArrow(repeated, _BACK)
    windows = groups.cogroup(marks.groupBy("chunk")).applyInArrow(around, _WORDS).groupBy("bucket").applyInArrow(earlier, _BACK)
    answers = marks.withColumn("kind", F.lit(0)).unionByName(windows.withColumn("kind", F.lit(1)))
    return groups.cogroup(answers.groupBy("chunk")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<array<long>>, kept string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    out = substring_repeats(C.read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (k) WHERE first < doc_id),
l AS (SELECT doc_id, list(p) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(coalesce(gone, [])) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256,
  CAST(len(list_filter(coalesce(gone, []), lambda p: NOT list_contains(gone, p - 1))) AS BIGINT) AS n_spans
FROM w LEFT JOIN l USING (doc_id)
"""


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The contract word for word, for tests on small fixtures."""
    import re

    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, ws in words:
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            least[key] = min(least.get(key, i), i)
    out = {}
    for i, ws in words:
        gone = set()
        for k in range(len(ws) - window + 1):
            if least[tuple(ws[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(ws), len(gone), hashlib.sha256(" ".join(w for k, w in enumerate(ws) if k not in gone).encode()).hexdigest())
    return out
