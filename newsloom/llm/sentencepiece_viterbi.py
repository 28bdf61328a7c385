"""SentencePiece encoding and decoding by streaming Viterbi search.

Text runs through a lattice of vocabulary pieces one character at a time. Back-pointers are kept for the boundaries that the
longest piece can still reach and the paths behind them; as soon as all surviving paths pass one boundary, the ids up
to it are committed and forgotten, so memory follows the longest ambiguity and not the text.

Which path survives at a boundary is the model's rule. A unigram model keeps the highest sum of scores. A BPE model keeps the one
path whose every two neighbouring pieces come out of the merges unchanged: by induction over merges exactly one such
path ends at each boundary, and it is the model's own segmentation. Both hence give the ids that the library gives.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SPACE = "▁"
CACHED, KEPT = 8_000_000, 64  # characters of the stretches that are remembered, and of the longest of them


class Model:
    """Pieces, scores and normalisation of a model file, read through the sentencepiece library."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(proto)
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or not m.normalizer_spec.escape_whitespaces:
            raise ValueError("only models with identity normalisation and kept white space are supported")
        self.dummy_prefix = m.normalizer_spec.add_dummy_prefix
        self.bpe = m.trainer_spec.model_type == 2
        kinds = [p.type for p in m.pieces]  # 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte
        if 4 in kinds:
            raise ValueError("models with user-defined symbols are not supported")
        self.pieces = {p.piece: k for k, p in enumerate(m.pieces) if p.type == 1}
        self.score = [p.score for p in m.pieces]
        self.unknown = kinds.index(2)
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(m.pieces) if p.type == 6}
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown_score = min((self.score[k] for k in self.pieces.values()), default=0.0) - 10
        self.trie: dict = {}  # character -> [piece that ends with it or -1, what may follow]
        for piece, k in self.pieces.items():
            node = self.trie
            for ch in piece:
                entry = node.setdefault(ch, [-1, {}])
                node = entry[1]
            entry[0] = k
        self.joins = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        self.inner_space = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.pieces)
        self.raw = [b""] * len(kinds)
        for p, k in self.pieces.items():
            self.raw[k] = p.replace(SPACE, " ").encode()
        for b, k in self.bytes.items():
            self.raw[k] = bytes([b])
        self.raw[self.unknown] = " ⁇ ".encode()
        self.text = [p.piece for p in m.pieces]
        self.stable: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """BPE by definition, for two pieces' worth of text."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.pieces.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def pair(self, left: int, right: int) -> bool:
        """Whether the merges leave two neighbouring pieces (or, with left below 0, one after nothing that merges) as they are."""
        key = (left << 24 if left > 0 else 0) | right
        if key not in self.stable:
            want = [self.text[left], self.text[right]] if left > 0 else [self.text[right]]
            self.stable[key] = self.merge("".join(want)) == want
        return self.stable[key]


class StreamingViterbi:
    """Feed characters, get committed ids; ``finish`` gives the rest.

    For each boundary from ``base``, the committed one, on: the piece that the surviving path ends with (below 0: a
    character outside the vocabulary, or nothing), where it starts (-1: no path ends here), and the path's score.
    """

    CHECK = 64

    def __init__(self, model: Model):
        self.m = model
        self.base = self.at = 0
        self.piece, self.start, self.score = [-1], [0], [0.0]
        self.open: list[tuple[int, dict]] = []  # pieces under way: where they start, their trie node
        self.peak = 1

    def feed(self, text: str) -> list[int]:
        m, out, base, at, arcs = self.m, [], self.base, self.at, self.open
        piece, start, score, bpe, stable, scores, trie = self.piece, self.start, self.score, m.bpe, m.stable, m.score, m.trie
        for ch in text:
            arcs.append((at, trie))
            at += 1
            best, origin, total, still = -1, -1, 0.0, []
            for begin, node in arcs:
                entry = node.get(ch)
                if entry is None:
                    continue
                k, node = entry
                if node:
                    still.append((begin, node))
                if k < 0 or start[begin - base] < 0:
                    continue
                if bpe:
                    left = piece[begin - base]
                    fits = stable.get((left << 24 if left > 0 else 0) | k)
                    if origin < 0 and (m.pair(left, k) if fits is None else fits):
                        best, origin = k, begin
                elif origin < 0 or score[begin - base] + scores[k] > total:
                    best, origin, total = k, begin, score[begin - base] + scores[k]
            if ch not in m.pieces and start[at - 1 - base] >= 0:
                other = score[at - 1 - base] + m.unknown_score
                if origin < 0 or not bpe and other > total:
                    best, origin, total = -2 - ord(ch), at - 1, other
            piece.append(best)
            start.append(origin)
            score.append(total)
            arcs = still
            if not len(piece) % self.CHECK:
                self.at, self.open = at, arcs
                self.peak = max(self.peak, len(piece))
                out += self._commit(self._meeting())
                base, piece, start, score = self.base, self.piece, self.start, self.score
        self.at, self.open = at, arcs
        return out

    def _meeting(self) -> int:
        """The last boundary on every surviving path: those that end here, and those that a piece under way may go on from."""
        ends = {e for e in (self.at, *(begin for begin, _ in self.open)) if self.start[e - self.base] >= 0}
        while len(ends) > 1:
            top = max(ends)
            ends.remove(top)
            ends.add(self.start[top - self.base])
        return ends.pop() if ends else self.base

    def _commit(self, to: int) -> list[int]:
        path, at = [], to
        while at > self.base:
            path.append(self.piece[at - self.base])
            at = self.start[at - self.base]
        out: list[int] = []
        for k in reversed(path):
            if k >= 0:
                out.append(k)
            else:
                out += [self.m.bytes[b] for b in chr(-2 - k).encode()] if self.m.bytes else [self.m.unknown]
        cut = to - self.base
        self.piece, self.start, self.score, self.base = self.piece[cut:], self.start[cut:], self.score[cut:], to
        self.start[0] = to
        return out

    def finish(self) -> list[int]:
        return self._commit(self.at)


class Codec:
    """Encodes and decodes whole texts; remembers the ids of the stretches between certain boundaries."""

    def __init__(self, proto: bytes):
        self.m = Model(proto)
        self.known: dict[str, bytes] = {}
        self.held = 0
        self._cut = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+") if not self.m.inner_space and "\n" not in "".join(self.m.pieces) else None

    def _keep(self, part: str, ids: bytes) -> None:
        if len(part) <= KEPT:
            self.known[part] = ids
            self.held += len(part)

    def _search(self, text: str) -> bytes:
        v = StreamingViterbi(self.m)
        return array("i", v.feed(text) + v.finish()).tobytes()

    def _stretch(self, text: str) -> bytes:
        """Two characters that stand together in no piece have a boundary between them on every path: search the parts."""
        joins, out, begin = self.m.joins, [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in joins:
                out.append(text[begin:i])
                begin = i
        if not begin:
            return self._search(text)
        out.append(text[begin:])
        for k, p in enumerate(out):
            ids = self.known.get(p)
            if ids is None:
                ids = self._search(p)
                self._keep(p, ids)
            out[k] = ids
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if not text:
            return b""
        text = (SPACE if self.m.dummy_prefix else "") + text.replace(" ", SPACE)
        if self._cut is None:
            return self._stretch(text)
        if self.held > CACHED:
            self.known, self.held = {}, 0
        if len(self.m.stable) > CACHED // 8:
            self.m.stable.clear()
        known, parts = self.known, self._cut.findall(text)
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            own = {p: self._stretch(p) for p in set(parts) if p not in known}
            out = b"".join([known[p] if p in known else own[p] for p in parts])
            for p, ids in own.items():
                self._keep(p, ids)
            return out

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.m.raw.__getitem__, ids.tolist()))
        if self.m.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(proto: bytes) -> Codec:
    key = hashlib.sha256(proto).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(proto)
    return _codecs[key]


def _broadcast(spark: SparkSession, model_path: str):
    """A vocabulary file of known size (half a megabyte), read on the driver."""
    with open(model_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, round_trip) for every row: the ids and whether decoding them gives the text again.

    Null and empty texts have no ids. A text that holds the space mark itself (U+2581) decodes to a space there, which
    is the only loss; ``round_trip`` tells.
    """
    model = _broadcast(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids = [np.frombuffer(c.encode(t), np.int32) for t in texts]
            same = [c.decode(x) == t for x, t in zip(ids, texts, strict=True)]
            ends = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))), pa.array(same, pa.bool_())], ["doc_id", "ids", "round_trip"])

    return C.id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, round_trip boolean")


def decode(tokens: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids decode to an empty text."""
    model = _broadcast(tokens.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for batch in batches:
            texts = [c.decode(np.array(x or [], np.int32)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """Per row of ``documents``: doc_id, n_tokens, ids_crc32 (of little-endian 32-bit ids), round_trip; the ids stay in their task."""
    model = _broadcast(docs.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for batch in batches:
            n, crc, same = [], [], []
            for t in batch.column("text").to_pylist():
                raw = c.encode(t)
                n.append(len(raw) // 4)
                crc.append(zlib.crc32(raw))
                same.append(c.decode(np.frombuffer(raw, np.int32)) == t)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return C.id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(C.read_table(spark, sf_dir, "documents"), model_file())
