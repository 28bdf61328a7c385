"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each of the 255 decision nodes has its own context tree over the preceding bytes, up
to five of them. A tree node estimates its bit by Krichevsky-Trofimov counts over all training texts, and its weighted
probability is half its own estimate and half the product of its children's, so every depth takes part with a
weight learnt from the corpus. A text's code length is the sum over its bytes of -log2 of the mixed estimates.

Spark does the gathering: training texts become counts of six-byte grams (and of words, for the base score), merged by
a shuffle on the two most recent context bytes, so that a group holds whole subtrees; depths 0 and 1 (at most 256 *
255 nodes, whatever the input) are finished on the driver. To score, each chunk of documents asks for its distinct grams
and words, by ranges of their hashes. Grams are made distinct there, so a common context meets each gram once and not once for
each chunk; their log-probabilities come back by the same hashes, and the chunks' answers from them. No model is broadcast.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

DEPTH = 5
END = 0xFF  # never a byte of UTF-8
HELD_OUT_OF, HELD_OUT = 5, 1
_U = np.uint64
_PIECE = 4_000_000


# -- the model, numpy ---------------------------------------------------------------------------------------------


def gram_codes(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For every byte and the end of each text: context bytes from the most recent one, then the byte, in one integer.

    Text i takes the places offsets[i] + i .. offsets[i + 1] + i + 1. Before its first byte stand END bytes.
    """
    n_docs = len(offsets) - 1
    size = len(data) + n_docs * (depth + 1)
    padded = np.full(size, END, np.uint8)
    lengths = np.diff(offsets)
    doc = np.repeat(np.arange(n_docs), lengths)
    padded[np.arange(len(data)) + doc * (depth + 1) + depth] = data
    place = np.arange(len(data) + n_docs) + np.repeat(np.arange(n_docs), lengths + 1) * depth + depth
    out = padded[place].astype(np.uint64)
    for d in range(1, depth + 1):
        out |= padded[place - d].astype(np.uint64) << _U(8 * (depth + 1 - d))
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift, y = np.ones_like(x), x.copy()
    for _ in range(6):
        shift *= y
        y += 1
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9) - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    n = zeros + ones
    out = np.zeros(len(n))
    some = n > 0
    out[some] = _log_gamma(zeros[some] + 0.5) + _log_gamma(ones[some] + 0.5) - math.log(math.pi) - _log_gamma(n[some] + 1.0)
    return out


def weighted(own: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability, and the weight that stays with the node's own estimate."""
    log = np.logaddexp(own, children) - math.log(2)
    return log, np.exp(own - math.log(2) - log)


class Trees:
    """All context trees below depth 2 over sorted distinct grams that hold whole two-byte contexts."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int = DEPTH, least: int = 2):
        self.depth, self.least = depth, least
        self.rows, self.counts, self.up = {depth: codes}, {depth: counts.astype(np.float64)}, {}
        for d in range(depth - 1, least - 1, -1):
            below = self.rows[d + 1]
            key = (below >> _U(16) << _U(8)) | (below & _U(255))
            self.rows[d], self.up[d + 1] = np.unique(key, return_inverse=True)
            self.counts[d] = np.bincount(self.up[d + 1], self.counts[d + 1], len(self.rows[d]))

    def bit(self, j: int):
        """Per depth, from the deepest: node of each row, zeros, ones, log weighted probability, weight of the node."""
        out, above = {}, None
        for d in range(self.depth, self.least - 1, -1):
            row = self.rows[d]
            new = np.r_[True, (row[1:] >> _U(8 - j)) != (row[:-1] >> _U(8 - j))]
            node, first = np.cumsum(new) - 1, np.flatnonzero(new)
            one = ((row >> _U(7 - j)) & _U(1)).astype(bool)
            total = np.add.reduceat(self.counts[d], first)
            ones = np.bincount(node[one], self.counts[d][one], len(first))
            own = log_kt(total - ones, ones)
            if above is None:
                log, weight = own, np.ones(len(first))
            else:
                b_first, b_log = above
                log, weight = weighted(own, np.bincount(node[self.up[d + 1][b_first]], b_log, len(first)))
            out[d] = (node, first, one, total, ones, log, weight)
            above = (first, log)
        return out

    def top(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the nodes above need: (recent byte, decision node), summed log weighted probability, zeros, ones."""
        found = []
        row = self.rows[self.least]
        for j in range(8):
            _, first, _, total, ones, log, _ = self.bit(j)[self.least]
            lead = row[first]
            recent = (lead >> _U(8 * self.least)) & _U(255)
            node = (lead & _U(255)) >> _U(8 - j) | _U(1 << j)
            found.append((recent << _U(8) | node, log, total - ones, ones))
        key = np.concatenate([f[0] for f in found])
        values, inverse = np.unique(key, return_inverse=True)
        return values.astype(np.int32), *(np.bincount(inverse, np.concatenate([f[k] for f in found]), len(values)) for k in (1, 2, 3))

    def log10(self, upper: Upper) -> np.ndarray:
        """Of each deepest row's byte in its context."""
        total_log = np.zeros(len(self.rows[self.depth]))
        recent = ((self.rows[self.depth] >> _U(8 * self.depth)) & _U(255)).astype(np.int64)
        byte = (self.rows[self.depth] & _U(255)).astype(np.int64)
        for j in range(8):
            levels = self.bit(j)
            p = None
            place = np.arange(len(total_log))
            for d in range(self.depth, self.least - 1, -1):
                node, _, one, total, ones, _, weight = levels[d]
                hit = np.where(one, ones[node], total[node] - ones[node])
                q = ((hit + 0.5) / (total[node] + 1))[place]
                p = q if p is None else weight[node][place] * q + (1 - weight[node][place]) * p
                if d > self.least:
                    place = self.up[d][place]
            node = byte >> (8 - j) | 1 << j
            total_log += np.log10(upper.mixed(recent, node, (byte >> (7 - j)) & 1, p))
        return total_log


class Upper:
    """Depths 0 and 1, from the sums over all subtrees."""

    def __init__(self, key: np.ndarray, log: np.ndarray, zeros: np.ndarray, ones: np.ndarray):
        size = 256 * 256
        children, z1, o1 = (np.bincount(key, v, size) if len(key) else np.zeros(size) for v in (log, zeros, ones))
        log1, self.w1 = weighted(log_kt(z1, o1), children)
        self.q1 = (o1 + 0.5) / (z1 + o1 + 1)
        z0, o0, below = (v.reshape(256, 256).sum(0) for v in (z1, o1, np.where(z1 + o1 > 0, log1, 0.0)))
        _, self.w0 = weighted(log_kt(z0, o0), below)
        self.q0 = (o0 + 0.5) / (z0 + o0 + 1)

    def mixed(self, recent: np.ndarray, node: np.ndarray, bit: np.ndarray, p: np.ndarray) -> np.ndarray:
        i = recent * 256 + node
        q1, q0 = np.where(bit, self.q1[i], 1 - self.q1[i]), np.where(bit, self.q0[node], 1 - self.q0[node])
        p = self.w1[i] * q1 + (1 - self.w1[i]) * p
        return self.w0[node] * q0 + (1 - self.w0[node]) * p


# -- gathering, Spark -----------------------------------------------------------------------------------------------

WORDS, GRAMS = 0, 1
_COUNTED = "kind int, bucket int, keys binary, counts binary"
_COUNTED_T = {"kind": pa.int32(), "bucket": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
_ASKED = "kind int, bucket int, chunk int, keys binary"
_ASKED_T = {"kind": pa.int32(), "bucket": pa.int32(), "chunk": pa.int32(), "keys": pa.binary()}
_TOLD = "chunk int, kind int, bucket int, payload binary"
_TOLD_T = {"chunk": pa.int32(), "kind": pa.int32(), "bucket": pa.int32(), "payload": pa.binary()}
_OPEN = "context int, bucket int, keys binary"
_OPEN_T = {"context": pa.int32(), "bucket": pa.int32(), "keys": pa.binary()}
_KNOWN = "kind int, bucket int, keys binary, counts binary"
_KNOWN_T = {"kind": pa.int32(), "bucket": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}


def _table(kinds: dict, rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), cols, strict=True)})


def _in_order(bucket: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    return order, C.parts(bucket[order])


def _by_bucket(kind: int, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of sorted keys by bucket of their hash, and the parts."""
    return _in_order(C.bucket_of(keys if kind == WORDS else C.mix(keys), buckets))


def _by_context(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of sorted grams by their two recent bytes."""
    return _in_order((C.mix(keys >> _U(8 * (DEPTH - 1))) % _U(buckets)).astype(np.int64))


def _pieces(offsets: np.ndarray) -> list[tuple[int, int]]:
    """Runs of documents of about _PIECE bytes."""
    cut = np.searchsorted(offsets, np.arange(_PIECE, int(offsets[-1]) + _PIECE, _PIECE))
    cut = np.unique(np.clip(np.r_[0, cut, len(offsets) - 1], 0, len(offsets) - 1))
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
    counts = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    lead = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[lead], np.add.reduceat(counts[order], lead).astype(np.int64) if len(lead) else np.zeros(0, np.int64)


def _words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, doc = C.word_bounds(data, offsets)
    return C.word_hashes(data, starts, ends), doc


def train(docs: DataFrame, buckets: int) -> tuple[DataFrame, Upper, int, int]:
    """Counts of words and grams over the rows with ``train``: a table by (kind, bucket), the upper depths, N and V."""

    def count(batches):
        found: dict[int, list] = {WORDS: [], GRAMS: []}
        held = 0
        for batch in batches:
            data, offsets = C.text_bytes(pa.Table.from_batches([batch]))
            data = C.lower_ascii(data)
            for i, j in _pieces(offsets):
                part, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                for kind, keys in ((WORDS, _words_of(part, o)[0]), (GRAMS, gram_codes(part, o))):
                    found[kind].append(C.unique_counts(keys))
                    held += len(found[kind][-1][0])
                if held > 8_000_000:
                    found, held = {k: [_merged(v)] for k, v in found.items()}, 0
        for kind, parts in found.items():
            keys, counts = _merged(parts)
            order, cuts = _by_context(keys, buckets) if kind == GRAMS else _by_bucket(kind, keys, buckets)
            keys, counts = keys[order], counts[order]
            for b, i, j in cuts:
                yield from _table(_COUNTED_T, [(kind, b, C.pack(keys[i:j]), C.pack(counts[i:j]))]).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        keys, counts = _merged([(C.unpack(k, np.uint64), C.unpack(c, np.int64)) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True)])
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        top = Trees(keys, counts).top() if kind == GRAMS else (np.zeros(0, np.int32), *(np.zeros(0),) * 3)
        return pa.table({"kind": pa.array([kind], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "keys": [C.pack(keys)], "counts": [C.pack(counts)], "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64()), "node": pa.array([top[0].tolist()], pa.list_(pa.int32())), **{k: pa.array([v.tolist()], pa.list_(pa.float64())) for k, v in zip(("log", "zeros", "ones"), top[1:], strict=True)}})

    counted = docs.where("train").select("text").mapInArrow(count, _COUNTED)
    table = C.checkpoint(counted.groupBy("kind", "bucket").applyInArrow(merge, "kind int, bucket int, keys binary, counts binary, n long, total long, node array<int>, log array<double>, zeros array<double>, ones array<double>"))
    words = table.where(F.col("kind") == WORDS).agg(F.sum("total"), F.sum("n")).first()
    n_docs = docs.where("train").count()
    tops = table.where(F.col("kind") == GRAMS).select(F.inline(F.arrays_zip("node", "log", "zeros", "ones"))).groupBy("node").agg(F.sum("log").alias("log"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toPandas()
    upper = Upper(tops["node"].to_numpy().astype(np.int64), *(tops[k].to_numpy(dtype=np.float64) for k in ("log", "zeros", "ones")))
    return table.select("kind", "bucket", "keys", "counts"), upper, int(words[0] or 0), int(words[1] or 0), n_docs


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_of: int = HELD_OUT_OF, held_out: int = HELD_OUT) -> DataFrame:
    """Score every text under the model learnt from the rows whose crc32(id as text) mod ``held_out_of`` is not ``held_out``.

    Returns per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (word unigrams), score (log10
    probability of the lower-cased text and its end), n_bytes, bits_per_byte. Null texts count as empty, a null id as an empty
    one (so it trains). Without any training row all estimates are uniform.
    """
    docs = C.id_text(docs, id_col, text_col).withColumn("train", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(held_out_of)) != held_out)
    n = C.chunk_count(docs, 2 * C.CHUNK_BYTES)
    buckets = max(C.LEAST_CHUNKS, n // 2)
    table, upper, n_words, v_words, n_end = train(docs, buckets)
    train_tokens, vocabulary = n_words + n_end, v_words + (n_end > 0)
    floor = train_tokens + 0.5 * (vocabulary + 1)
    chunks = C.with_chunks(docs, n)

    def parts_of(table: pa.Table):
        data, offsets = C.text_bytes(table)
        data = C.lower_ascii(data)
        for i, j in _pieces(offsets):
            yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]

    def distinct_keys(table: pa.Table) -> dict[int, np.ndarray]:
        found: dict[int, list] = {WORDS: [], GRAMS: []}
        for part, o in parts_of(table):
            found[WORDS].append(C.unique(_words_of(part, o)[0]))
            found[GRAMS].append(C.unique(gram_codes(part, o)))
        return {k: C.unique(np.concatenate(v)) if v else np.zeros(0, np.uint64) for k, v in found.items()}

    def ask(table: pa.Table) -> pa.Table:
        chunk, rows = table.column("chunk")[0].as_py(), []
        for kind, keys in distinct_keys(table).items():
            order, cuts = _by_bucket(kind, keys, buckets)
            keys = keys[order]
            rows += [(kind, b, chunk, C.pack(keys[i:j])) for b, i, j in cuts]
        return _table(_ASKED_T, rows)

    def distinct(table: pa.Table) -> pa.Table:
        """The grams that any chunk asks for, once each, by their context."""
        if table.column("kind")[0].as_py() == WORDS:
            return _table(_OPEN_T, [])
        keys = C.unique(np.concatenate([C.unpack(k, np.uint64) for k in table.column("keys").to_pylist()]))
        order, cuts = _by_context(keys, buckets)
        keys, bucket = keys[order], table.column("bucket")[0].as_py()
        return _table(_OPEN_T, [(c, bucket, C.pack(keys[i:j])) for c, i, j in cuts])

    def tell(key, asked: pa.Table, counted: pa.Table) -> pa.Table:
        """Log-probabilities of one context's grams, back to the buckets that asked."""
        if not asked.num_rows:
            return _table(_KNOWN_T, [])
        wanted = [C.unpack(k, np.uint64) for k in asked.column("keys").to_pylist()]
        have = [(C.unpack(k, np.uint64), C.unpack(c, np.int64)) for k, c in zip(counted.column("keys").to_pylist(), counted.column("counts").to_pylist(), strict=True)]
        keys, counts = _merged([*have, *((w, np.zeros(len(w), np.int64)) for w in wanted)])
        logs = Trees(keys, counts).log10(upper)
        return _table(_KNOWN_T, [(GRAMS, b, C.pack(w), C.pack(logs[np.searchsorted(keys, w)])) for b, w in zip(asked.column("bucket").to_pylist(), wanted, strict=True)])

    def answer(key, asked: pa.Table, known: pa.Table) -> pa.Table:
        """To each chunk the counts of its words, or the log-probabilities of its grams, in the order in which it asked."""
        kind, bucket, rows = key[0].as_py(), key[1].as_py(), []
        dtype = np.int64 if kind == WORDS else np.float64
        keys = np.concatenate([np.zeros(0, np.uint64), *(C.unpack(k, np.uint64) for k in known.column("keys").to_pylist())])
        values = np.concatenate([np.zeros(0, dtype), *(C.unpack(v, dtype) for v in known.column("counts").to_pylist())])
        order = np.argsort(keys, kind="stable")
        keys, values = np.r_[keys[order], _U(0)], np.r_[values[order], np.zeros(1, dtype)]  # one more for words beyond all
        for chunk, packed in zip(asked.column("chunk").to_pylist(), asked.column("keys").to_pylist(), strict=True):
            w = C.unpack(packed, np.uint64)
            at = np.searchsorted(keys[:-1], w)
            rows.append((chunk, kind, bucket, C.pack(np.where(keys[at] == w, values[at], 0).astype(dtype))))
        return _table(_TOLD_T, rows)

    def finish(key, table: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])
        if not table.num_rows:
            return schema.empty_table()
        got = {(k, b): p for k, b, p in zip(told.column("kind").to_pylist(), told.column("bucket").to_pylist(), told.column("payload").to_pylist(), strict=True)}
        coded = []
        for part, o in parts_of(table):
            h, doc = _words_of(part, o)
            coded.append((o, doc, {WORDS: C.Ranked(h), GRAMS: C.Ranked(gram_codes(part, o))}))
        keys, value = {k: C.unique(np.concatenate([np.zeros(0, np.uint64), *(r[k].values for _, _, r in coded)])) for k in (WORDS, GRAMS)}, {}
        for kind, dtype in ((WORDS, np.int64), (GRAMS, np.float64)):
            order, cuts = _by_bucket(kind, keys[kind], buckets)
            value[kind] = np.zeros(len(order), dtype)
            value[kind][order] = np.concatenate([C.unpack(got[kind, b], dtype) for b, _, _ in cuts]) if cuts else np.zeros(0, dtype)
        base = np.log10((value[WORDS] + 0.5) / floor)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score", "score", "n_bytes")}
        for o, doc, ranked in coded:
            words, k = np.searchsorted(keys[WORDS], ranked[WORDS].values), len(o) - 1
            n_words = np.bincount(doc, minlength=k)
            first = np.cumsum(n_words) - n_words
            some = n_words > 0
            sums = np.zeros(k)
            if some.any():
                sums[some] = np.add.reduceat(ranked[WORDS].spread(base[words]), first[some])
            known = np.bincount(doc, ranked[WORDS].spread(value[WORDS][words] > 0), k).astype(np.int64)
            logs = ranked[GRAMS].spread(value[GRAMS][np.searchsorted(keys[GRAMS], ranked[GRAMS].values)])
            out["n_tokens"].append(n_words + 1)
            out["n_known"].append(known + (n_end > 0))
            out["base_score"].append(sums + math.log10((n_end + 0.5) / floor))
            out["score"].append(np.add.reduceat(logs, o[:-1] + np.arange(k)))
            out["n_bytes"].append(np.diff(o))
        return pa.table({"doc_id": table.column("doc_id"), "train": table.column("train"), **{k: np.concatenate(v) for k, v in out.items()}}, schema=schema)

    asked = chunks.groupBy("chunk").applyInArrow(ask, _ASKED)
    by_hash = asked.groupBy("kind", "bucket")
    grams = table.where(F.col("kind") == GRAMS).select(F.col("bucket").alias("context"), "keys", "counts")
    logs = by_hash.applyInArrow(distinct, _OPEN).groupBy("context").cogroup(grams.groupBy("context")).applyInArrow(tell, _KNOWN)
    known = logs.unionByName(table.where(F.col("kind") == WORDS))
    told = by_hash.cogroup(known.groupBy("kind", "bucket")).applyInArrow(answer, _TOLD)
    out = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(finish, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (-F.col("score") * F.lit(math.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def op8_context_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.read_table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple[int, str | None]], depth: int = DEPTH) -> dict[int, tuple]:
    """Counts and both scores from plain dictionaries, for tests on small fixtures."""
    lower = lambda t: (t or "").encode().lower()
    trains = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % HELD_OUT_OF != HELD_OUT]
    tokens = Counter(w for _, t in trains for w in [*lower(t).split(), None])
    n, v = sum(tokens.values()), len(tokens)
    counts: dict[tuple, list[int]] = {}

    def bits(b: bytes):
        past = (END,) * depth
        for x in [*b, END]:
            node = 1
            for j in range(7, -1, -1):
                yield past, node, x >> j & 1
                node = node * 2 + (x >> j & 1)
            past = (x, *past[:-1])

    for _, t in trains:
        for past, node, bit in bits(lower(t)):
            for d in range(depth + 1):
                counts.setdefault((node, past[:d]), [0, 0])[bit] += 1
    children: dict[tuple, list[tuple]] = {}
    for node, past in counts:
        if past:
            children.setdefault((node, past[:-1]), []).append((node, past))
    stay: dict[tuple, float] = {}
    log_w: dict[tuple, float] = {}
    for key in sorted(counts, key=lambda k: -len(k[1])):
        a, b = counts[key]
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        if len(key[1]) == depth:
            log_w[key], stay[key] = own, 1.0
        else:
            below = sum(log_w[c] for c in children[key])
            log_w[key] = math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))
            stay[key] = math.exp(own + math.log(0.5) - log_w[key])
    out = {}
    for i, t in rows:
        total = 0.0
        for past, node, bit in bits(lower(t)):
            p = None
            for d in range(depth, -1, -1):
                c = counts.get((node, past[:d]), [0, 0])
                q = (c[bit] + 0.5) / (sum(c) + 1)
                w = stay.get((node, past[:d]), 0.5)
                p = q if p is None else w * q + (1 - w) * p
            total += math.log10(p)
        ws = [*lower(t).split(), None]
        base = sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        out[i] = (zlib.crc32(str(i).encode()) % HELD_OUT_OF == HELD_OUT, len(ws), sum(tokens[w] > 0 for w in ws), n, base, total)
    return out
