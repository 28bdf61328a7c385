"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Of at most two differing bits, either a pair of
neighbouring segments (in a ring of three) holds none in the one and at most one in the other, whatever the split:
(2,0,0), (1,1,0) and their turns all leave a segment untouched whose follower has one error at most. So three keys families,
each an exact segment plus the Golay indices near the next one, find every link. Segments are decoded to nearby codeword
indices, which gives one or six keys for each family; fingerprints that share a key are compared by their true
distance. Equal fingerprints are one class from the start, so copies never meet pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .golay import nearby_indices
from .graph import connected_components

SHINGLE, DISTANCE, SEED = 3, 2, 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def shingle_hashes(text: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``size`` words (of all words where there are fewer) of the lower-cased text."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]]
    k = max(len(words) - size, 0)
    return np.array([digest(joined[i:j], seed) for i, j in zip(starts[: k + 1].tolist(), (ends[min(size, len(words)) - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = C.text_bytes(pa.Table.from_batches([batch]))
            text = data.tobytes()
            fps = np.array([fingerprint(shingle_hashes(text[i:j], shingle)) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def golay_keys(fps: np.ndarray) -> np.ndarray:
    """Up to 18 keys of each fingerprint; -1 fills the rest."""
    segment = [((fps >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    keys = []
    for k in range(3):
        index = nearby_indices(segment[(k + 1) % 3]).astype(np.int64)
        keys.append(np.where(index >= 0, (k << 40) | (segment[k][:, None] << 12) | index, -1))
    return np.concatenate(keys, axis=1)


def _with_keys(classes: DataFrame, keys_of=golay_keys, columns: tuple[str, ...] = ("fp",)) -> DataFrame:
    """One row for each key of the first column's fingerprint, with the other columns and the class's representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*columns, "rep")]
            keys = keys_of(values[0].view(np.uint64))
            row, col = np.nonzero(keys >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(keys[row, col]), *(pa.array(v[row]) for v in values)], ["key", *columns, "rep"])

    return classes.select(*columns, "rep").mapInArrow(run, ", ".join(f"{c} long" for c in ("key", *columns, "rep")))


def _links(sorted_keys: DataFrame, distances: dict[str, int]) -> DataFrame:
    """Verified links among rows of equal key, which stand together; a run that a batch cuts is carried on.

    Only links that join two so far unconnected rows of a run are given, and rows already connected are not compared any
    more, so a group of near copies yields as many links as members and the components stay the same.
    """
    columns = ("key", *distances, "rep")

    def spanning(key: np.ndarray, fps: list[np.ndarray], rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        parent, live, step = np.arange(len(key)), np.arange(len(key) - 1), 1
        while True:
            live = live[live + step < len(key)]
            live = live[key[live] == key[live + step]]
            if not len(live):
                return
            hit = live[parent[live] != parent[live + step]]
            for fp, most in zip(fps, distances.values(), strict=True):
                hit = hit[np.bitwise_count(fp[hit] ^ fp[hit + step]) <= most]
            kept = []
            for i in hit.tolist():
                a, b = i, i + step
                while parent[a] != a:
                    a = parent[a]
                while parent[b] != b:
                    b = parent[b]
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    kept.append(i)
            if kept:
                while (up := parent[parent]).tobytes() != parent.tobytes():
                    parent = up
                at = np.array(kept)
                yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[at + step])], ["a", "b"])
            step += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = tuple(np.zeros(0, np.int64) for _ in columns)
        for batch in batches:
            if not batch.num_rows:
                continue
            key, *fps, rep = (np.concatenate([r, batch.column(c).to_numpy(zero_copy_only=False)]) for r, c in zip(rest, columns, strict=True))
            cut = int(np.searchsorted(key, key[-1]))
            yield from spanning(key[:cut], [f[:cut].view(np.uint64) for f in fps], rep[:cut])
            rest = key[cut:], *(f[cut:] for f in fps), rep[cut:]
        yield from spanning(rest[0], [f.view(np.uint64) for f in rest[1:-1]], rest[-1])

    return sorted_keys.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every row; fingerprints link at two or fewer differing bits.

    Returns doc_id, fp (long), component_id (the smallest id reachable). Null and blank texts have fingerprint zero and are
    linked like any other. Rows of one id are one document: they keep a row each and lie in one component. A row without
    an id gets the component of its fingerprint, or null where no row of that component has one.
    """
    fps = C.checkpoint(with_fingerprints(C.id_text(docs, id_col, text_col), shingle))
    classes = C.checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    known = classes.where("rep is not null")
    keyed = _with_keys(known)
    links = _links(keyed.repartition("key").sortWithinPartitions("key"), {"fp": DISTANCE})
    same_id = fps.where("doc_id is not null").join(known, "fp").where("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("n"))
    ids = same_id.where("n > 1").select(F.col("most").alias("a"), F.col("least").alias("b"))
    own = known.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    crossing = fps.join(own, fps["doc_id"] == own["rep"], "left_semi").join(known, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    components = connected_components(links.unionByName(ids).unionByName(crossing))
    labels = C.checkpoint(known.join(components, known["rep"] == components["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id")))
    return fps.join(labels, "fp", "left").select("doc_id", "fp", "component_id")


def op5_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(C.read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    """All pairs of fingerprints, for tests on small fixtures."""
    fps = {}
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        sh = [b" ".join(ws[k : k + SHINGLE]) for k in range(max(len(ws) - SHINGLE, 0) + 1)] if ws else []
        hs = [xxhash.xxh64_intdigest(s, SEED) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    parent = {i: i for i in fps}

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    items = sorted(fps.items())
    for k, (i, f) in enumerate(items):
        for j, g in items[:k]:
            if (f ^ g).bit_count() <= DISTANCE:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (f"{f:016x}", root(i)) for i, f in items}
