"""Near copies by similarity: SimHash with Golay keys first, exact keys for what fingerprints miss, sets verified.

Two documents are near copies where their sets of distinct five-word shingles have a similarity (common of all) of 0.8 or
more. Equal sets are one class. Candidates come from two sources. Golay keys of the distinct words' fingerprints join most of
a group of copies at once. Fingerprints alone would miss pairs, as 0.8 means about ten of 64 bits, give or take
three; so each set also gives the first fifth of its shingles in one order for all, frequent ones last, and two sets of 0.8 share
one of those for certain (a prefix filter). Candidates are verified by the sets themselves, and the links become components.

A key that many sets share is first joined to a few centres only. The members that are then still apart are compared by
sketches, in bounded blocks; those that a sketch cannot tell apart bring their texts to the key, once each, and are linked there by
their sets. So rows and links grow with the members of a group and not with its pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .graph import connected_components, few
from .simhash import SEED, _links, _with_keys, fingerprint, golay_keys, shingle_hashes

SHINGLE, WORD_BITS, BITS = 5, 7, 14  # the bits at which fingerprints of words and of shingles make a candidate
SAMPLED, OFTEN, MASK_BITS, MASK_MOST = 4, 3, 22, 200_000  # of 4 documents one; a shingle of 3 of those is frequent
RUN_ROWS, CENTRES = 8, 3  # longest run of a key compared in full by verified pairs; centres of longer ones
SKETCH, BLOCK, COLUMNS = 256, 256, 16384  # values of a sketch; rows and values compared at once
LANE_ROWS, LANE_SHINGLES, EARLY = 8192, 4_000_000, 64  # rows or shingles of a run in one task; keys that tell whether two rows met before
_SLOT = np.uint64((1 << MASK_BITS) - 1)


def _similar(common: int, a: int, b: int) -> bool:
    """A similarity (common of all distinct shingles) of 0.8 or more."""
    return 5 * common >= 4 * (a + b - common)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, offsets = C.text_bytes(pa.Table.from_batches([batch]))
    text = data.tobytes()
    return (text[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))


def _set_hash(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), SEED)


def _often(rows: DataFrame, shingle: int) -> np.ndarray:
    """A bitmap over hash slots, set where a shingle is frequent in a sample. It only orders shingles, so a slot set or missed
    costs time and never a link; its size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in _texts(batch):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text, shingle)).view(np.int64))], ["h"])

    seen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).mapInArrow(run, "h long")
    low = F.col("h").bitwiseAND(F.lit((1 << MASK_BITS) - 1))
    return C.bitmap(seen.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(MASK_MOST).select(low.alias("slot")), MASK_BITS)


def _prints(rows: DataFrame, often: np.ndarray, shingle: int, most: int | None) -> DataFrame:
    """(doc_id, cls, n, fw, fs, keys, sketch) of each row: hash and size of its shingle set, fingerprints of its distinct words
    and of its shingles, its first shingles in the common order, and its ``SKETCH`` smallest hashes, in 32 bits (equal ones once, so counts by them err
    on the side of a comparison).

    Sets of n and m shingles with a similarity of 0.8 share at least 0.8 n and 0.8 m, so one of the first n - ceil(0.8 n) + 1.
    All are taken, unless ``most`` is given: where most shingles are not frequent, 24 are enough but for chance, as at 0.8 these have a similarity of 0.64 at least, and the first
    24 of both sets' hashes hold none in common once in 10**10 times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, keys, sketches = [], [], []
            for text in _texts(batch):
                runs = shingle_hashes(text, shingle)
                own = np.unique(runs)
                n = len(own)
                late = C.is_set(often, (own & _SLOT).astype(np.int64))
                order = np.sort((own >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63)))
                first = n - (4 * n + 4) // 5 + 1 if n else 0
                keys.append(order[: first if most is None or 2 * late.sum() > n else min(first, most)].view(np.int64))
                sketches.append(np.unique((own[:SKETCH] >> np.uint64(32)).astype("<u4")).tobytes())
                words = b" ".join(set(text.lower().split()))
                found.append((_set_hash(own), n, fingerprint(np.unique(shingle_hashes(words, 1))), fingerprint(runs)))
            v = np.array(found, np.uint64).reshape(-1, 4).view(np.int64)
            ends = np.r_[0, np.cumsum([len(k) for k in keys])].astype(np.int32)
            first = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(v[:, 0].copy()), pa.array(v[:, 1].astype(np.int32)), pa.array(v[:, 2].copy()), pa.array(v[:, 3].copy()), first, pa.array(sketches, pa.binary())], ["doc_id", "cls", "n", "fw", "fs", "keys", "sketch"])

    return rows.mapInArrow(run, "doc_id long, cls long, n int, fw long, fs long, keys array<long>, sketch binary")


def _by_key(keyed: DataFrame, columns: tuple[str, ...], run, out: str) -> DataFrame:
    """``run`` over whole runs of the first column, which stand together; a run that a batch cuts is carried on."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if batch.num_rows:
                now = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                key = now.column(0).to_numpy()
                new = np.flatnonzero(key[1:] != key[:-1])
                cut = int(new[-1]) + 1 if len(new) else 0
                if cut:
                    yield from run(now.slice(0, cut))
                rest = now.slice(cut)
        if rest is not None:
            yield from run(rest)

    return keyed.select(*columns).repartition(columns[0]).sortWithinPartitions(*columns[:2]).mapInArrow(whole, out)


def _keys(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, n, pos, key): the keys of one row of each class. Only rows that may not be their class's first go through a join."""
    own = classes.select("cls", F.col("rep").alias("doc_id"))
    wide = prints.select("doc_id", "cls", "n", "keys")
    other = C.among(prints.select("doc_id", "cls").join(classes.select("cls", "rep"), "cls").where("doc_id <> rep"), "doc_id", "cls")
    leading = wide.where(~other).unionByName(wide.where(other).join(own, ["cls", "doc_id"], "left_semi"))
    return leading.select("cls", "n", F.posexplode("keys").alias("pos", "key"))


def _pairs_of(cls: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(cls[i], cls[j])), pa.array(np.maximum(cls[i], cls[j]))], ["a", "b"])


def _prefix_pairs(keyed: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes in the runs of one key. Runs of over ``RUN_ROWS`` classes are compared with their first rows only, and
    their rows are given as well (key, the class as a, n; b null), so that the keys are sent once."""

    def given(a: pa.Array, b: pa.Array, key: pa.Array, n: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([a, b, key, n], ["a", "b", "key", "n"])

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, cls, n, pos = (table.column(c).to_numpy() for c in ("key", "cls", "n", "pos"))
        new = np.r_[True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]  # equal sets are one class
        key, cls, n, pos = key[new], cls[new], n[new].astype(np.int64), pos[new]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        rows = lambda runs: np.flatnonzero(np.repeat(runs, size))

        def kept(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            # by length, and by what can follow where this is the first shingle in common
            ok = (cls[i] != cls[j]) & (9 * np.minimum(n[i] - pos[i], n[j] - pos[j]) >= 4 * (n[i] + n[j]))
            if m := int(ok.sum()):
                yield given(*_pairs_of(cls, i[ok], j[ok]).columns, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()))

        if (big := size > RUN_ROWS).any():
            j, first = rows(big), np.repeat(start[big], size[big])
            yield given(pa.array(cls[j]), pa.nulls(len(j), pa.int64()), pa.array(key[j]), pa.array(n[j].astype(np.int32)))
            for c in range(CENTRES):
                yield from kept(first + c, j)
        live = rows((size > 1) & (size <= RUN_ROWS))
        for step in range(1, RUN_ROWS):
            live = live[live + step < len(key)]
            live = live[key[live] == key[live + step]]
            yield from kept(live, live + step)

    return _by_key(keyed, ("key", "cls", "n", "pos"), pairs, "a long, b long, key long, n int").distinct()


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of the sets on the left has in common with each on the right."""
    out = np.zeros((len(left), len(right)), np.int64)
    sides = [(np.repeat(np.arange(len(side)), [len(v) for v in side]), np.concatenate(side)) for side in (left, right)]
    both = np.intersect1d(sides[0][1], sides[1][1])
    if not len(both):
        return out
    found = []
    for row, value in sides:
        at = np.minimum(np.searchsorted(both, value), len(both) - 1)
        hit = both[at] == value
        row, at = row[hit], at[hit]
        order = np.argsort(at, kind="stable")
        found.append((row[order], at[order]))
    for low in range(0, len(both), COLUMNS):
        ones = []
        for (row, at), side in zip(found, (left, right), strict=True):
            i, j = np.searchsorted(at, [low, low + COLUMNS])
            m = np.zeros((len(side), min(COLUMNS, len(both) - low)), np.float32)
            m[row[i:j], at[i:j] - low] = 1
            ones.append(m)
        out += (ones[0] @ ones[1].T).astype(np.int64)
    return out


def _blocks(comp: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of rows on both sides, each pair of rows once, without rows whose partners all lie in their own component."""
    for i in range(0, len(left), BLOCK):
        for j in range(i if left is right else 0, len(right), BLOCK):
            x, y = left[i : i + BLOCK], right[j : j + BLOCK]
            x = x[(comp[x] != comp[y[0]]) | (comp[y] != comp[y[0]]).any()]
            if len(x):
                yield x, y


def _runs(table: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each run the rows, a class once, their components, and the rows of either side by length."""
    key = table.column("key").to_numpy()
    for i, j in zip(s := np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist(), [*s[1:], len(key)], strict=True):
        part = table.slice(i, j - i)
        part = part.take(np.unique(part.column("cls").to_numpy(), return_index=True)[1])
        side, order = part.column("lane").to_numpy(), np.argsort(part.column("n").to_numpy(), kind="stable")
        left = order[side[order] >= 0]
        yield part, np.unique(part.column("comp").to_numpy(), return_inverse=True)[1], left, order[side[order] < 0] if side.any() else left


def _candidates(keyed: DataFrame, sigmas: float | None) -> DataFrame:
    """(key, cls) of the rows of long runs that a sketch cannot tell apart from some row of another component; ``keyed`` has key,
    lane, at (the key before lanes), cls, comp, n, sketch and early (the first keys of the class). Rows meet at their first key in
    common, where that is among the early ones of both. Rows are given and not pairs, so a group yields as many as it has members.
    """

    def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for part, comp, left, right in _runs(table):
            at, cls, n = part.column("at")[0].as_py(), part.column("cls").to_numpy(), part.column("n").to_numpy().astype(np.int64)
            values = [np.frombuffer(s, "<u4") for s in part.column("sketch").to_pylist()]
            early = [v[v < at] for v in (np.array(e, np.int64) for e in part.column("early").to_pylist())]
            most = np.array([v[-1] if m > SKETCH else 2**32 for v, m in zip(values, n.tolist(), strict=True)], np.int64)
            marked = np.zeros(len(cls), bool)
            for x, y in _blocks(comp, left, right):
                may = (comp[x][:, None] != comp[y][None, :]) & (_common([early[r] for r in x], [early[r] for r in y]) == 0)
                if not may.any():
                    continue
                common = _common([values[r] for r in x], [values[r] for r in y])
                # both sketches are whole up to the lesser of their greatest values
                a = np.stack([np.searchsorted(values[r], most[y], "right") for r in x])
                b = np.stack([np.searchsorted(values[r], most[x], "right") for r in y], axis=1)
                p, q = n[x][:, None], n[y][None, :]
                may &= 9 * (common + np.minimum(p - a, q - b)) >= 4 * (p + q)
                if sigmas is not None:
                    seen = np.maximum(a + b - common, 1)
                    part_seen = (most[x][:, None] < 2**32) | (most[y][None, :] < 2**32)
                    may &= ~part_seen | (common >= 0.8 * seen - sigmas * np.sqrt(0.16 * seen))
                marked[x[may.any(1)]] = True
                marked[y[may.any(0)]] = True
            if marked.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(marked.sum()), at)), pa.array(cls[marked])], ["key", "cls"])

    return _by_key(keyed, ("key", "cls", "lane", "at", "comp", "n", "sketch", "early"), rows, "key long, cls long").distinct()


def _linked(keyed: DataFrame, shingle: int) -> DataFrame:
    """Links (a, b) across the components of each run, by the sets themselves, as few as join them; ``keyed`` has key, lane, cls, comp,
    n and own (the packed text)."""

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for part, comp, left, right in _runs(table):
            cls, n = part.column("cls").to_numpy(), part.column("n").to_numpy().astype(np.int64)
            sets = [np.unique(shingle_hashes(zlib.decompress(z.as_buffer()), shingle)) for z in part.column("own")]
            p, q = [], []
            for x, y in _blocks(comp, left, right):
                common = _common([sets[r] for r in x], [sets[r] for r in y])
                close = 9 * common >= 4 * (n[x][:, None] + n[y][None, :])
                close &= comp[x][:, None] != comp[y][None, :]
                for r in np.flatnonzero(close.any(1)).tolist():
                    to = y[close[r]]
                    others, first = np.unique(comp[to], return_index=True)
                    new = others != comp[x[r]]
                    p += [x[r]] * int(new.sum())
                    q += to[first[new]].tolist()
                    comp[np.isin(comp, others)] = comp[x[r]]
            if p:
                yield _pairs_of(cls, np.array(p), np.array(q))

    return _by_key(keyed, ("key", "cls", "lane", "comp", "n", "own"), pairs, "a long, b long").distinct()


def _in_lanes(keyed: DataFrame, weight: Column, most: int) -> DataFrame:
    """Runs that weigh more than ``most`` in lanes: a task takes one lane (all rows lane 0) or two (-1 and 1), under a key of its own;
    ``at`` is the key before. Runs within one component are left out."""
    size = keyed.groupBy("key").agg(F.sum(weight).alias("weight"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    lanes = F.ceil(F.col("weight") / F.lit(most)).cast("int")
    dealt = keyed.join(size.select("key", lanes.alias("lanes")), "key").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("lanes")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1)
    one = F.col("lanes") == 1
    return dealt.withColumn("lane", side).withColumn("at", F.col("key")).withColumn("key", F.when(one, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))).drop("own", "other", "lanes")


def _packed(needed: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """(cls, own) of the classes in ``needed`` (cls, rep): the packed text of one of their documents."""
    wanted = C.bitmap(needed.select(F.pmod(F.xxhash64("rep"), F.lit(1 << MASK_BITS)).alias("slot")), MASK_BITS)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(C.is_set(wanted, batch.column("slot").to_numpy())))
            own = [(_set_hash(np.unique(shingle_hashes(t, shingle))), zlib.compress(t, 6)) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([h for h, _ in own], np.uint64).view(np.int64)), pa.array([z for _, z in own], pa.binary())], ["cls", "own"])

    own = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << MASK_BITS)).alias("slot"), "text").mapInArrow(packed, "cls long, own binary")
    return own.join(needed.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """The pairs of classes whose shingle sets have a similarity of 0.8 or more, by the sets themselves."""

    needed = C.checkpoint(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", "rep"), "cls"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            ok, kept = [], {}
            for a, x, b, y in zip(batch.column("a").to_pylist(), batch.column("own_a"), batch.column("b").to_pylist(), batch.column("own_b"), strict=True):
                sets = []
                for k, z in ((a, x), (b, y)):
                    if k not in held:
                        held[k] = np.unique(shingle_hashes(zlib.decompress(z.as_buffer()), shingle))
                    kept[k] = held[k]
                    sets.append(held[k])
                p, q = sets
                ok.append(_similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)))
            held = kept if sum(map(len, kept.values())) < 2_000_000 else {}
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    own = _packed(needed, rows, shingle)
    side = lambda c: own.select(F.col("cls").alias(c), F.col("own").alias(f"own_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "own_a", "own_b").mapInArrow(run, "a long, b long")


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """Classes with ``comp``, the smallest id of those connected by links."""
    found = classes.select("cls", "rep").join(connected_components(links), F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("component", "cls").alias("c_"))
    n = classes.count()
    found = C.checkpoint(few(found, n))
    return C.checkpoint(few(found.join(found.groupBy("c_").agg(F.min("rep").alias("comp")), "c_").drop("c_"), n))


def _unordered() -> list[Column]:
    return [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]


def near_copies(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, word_bits: int = WORD_BITS, id_col: str = "doc_id", text_col: str = "text", keys: int | None = None, sigmas: float | None = None) -> DataFrame:
    """(doc_id, component_id) of every row with an id: components of documents with 0.8 or more of their distinct shingles in
    common (of both documents' together).

    Null and blank texts count as copies of each other. Rows of one id and text are one document; rows of one id with different texts
    keep a row each and are joined only by their texts. Every link is verified by the sets. No pair is lost: all keys of the prefix are
    taken, and a sketch excludes only what its counts rule out. ``keys`` (such as 24) and ``sigmas`` (such as 7) bound both by
    chance instead (see ``_prints`` and ``_candidates``), for callers that ask for it.
    """
    rows = C.id_text(docs, id_col, text_col).where(F.col("doc_id").isNotNull())
    prints = C.checkpoint(_prints(rows, _often(rows, shingle), shingle, keys))
    classes = C.checkpoint(prints.groupBy("cls").agg(F.min("fw").alias("fw"), F.min_by("fs", "fw").alias("fs"), F.min("doc_id").alias("rep")))
    keyed = _with_keys(classes.select("fw", "fs", F.col("cls").alias("rep")), golay_keys, ("fw", "fs"))
    golay = C.checkpoint(_links(keyed.repartition("key").sortWithinPartitions("key"), {"fw": word_bits, "fs": bits}).select(*_unordered()).distinct())
    found = C.checkpoint(_prefix_pairs(_keys(prints, classes)))
    pairs = C.checkpoint(golay.unionByName(found.where("b is not null").select("a", "b")).distinct())
    links = C.checkpoint(_verified(pairs, rows, classes, shingle))
    joined = _joined(classes, links)
    hot = found.where("b is null").select("key", F.col("a").alias("cls"), "n")
    if not hot.isEmpty():
        cross = hot.join(joined.select("cls", "comp"), "cls")
        mixed = cross.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
        apart = C.checkpoint(cross.join(mixed, "key", "left_semi").select("key", "cls", "comp", "n"))
        early = apart.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list("key")), 1, EARLY).alias("early"))
        early = C.checkpoint(early.join(classes.select("cls", F.col("rep").alias("doc_id")), "cls"))
        sketches = prints.select("doc_id", "cls", "sketch").where(C.among(early, "doc_id", "cls")).join(early, ["cls", "doc_id"]).dropDuplicates(["cls", "doc_id"]).drop("doc_id")
        met = C.checkpoint(_candidates(_in_lanes(apart, F.lit(1), LANE_ROWS).join(sketches, "cls"), sigmas))
        needed = C.checkpoint(met.select("cls").distinct().join(classes.select("cls", "rep"), "cls"))
        dealt = _in_lanes(apart.join(met, ["key", "cls"], "left_semi"), F.col("n"), LANE_SHINGLES)
        more = C.checkpoint(_linked(dealt.join(_packed(needed, rows, shingle), "cls"), shingle))
        if not more.isEmpty():
            links = C.checkpoint(links.unionByName(more))
            joined = _joined(classes, links)
    return prints.select("doc_id", "cls").join(joined.select("cls", F.col("comp").alias("component_id")), "cls").select("doc_id", "component_id")
