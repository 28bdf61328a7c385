"""Benchmark decontamination: a prefix-filtered set join.

Each benchmark item is cut into windows of ten words (a shorter item is one window), each a set of three-word shingles. The
shingles are ordered by their rarity in the corpus, which a first pass over the documents counts. Exact containment
needs every shingle of a window, so its prefix is one token: the rarest. A second pass emits, for each document, the
places of prefix tokens with the words around them; these join the windows on the token, keep those where the
window fits between the text's ends (length and position), and are verified word for word.

Benchmark-sized tables are broadcast only under a checked number of rows; beyond it the same joins shuffle, and tasks get a
bitmap of fixed size in the place of the list of prefix tokens, which the join on the token then makes exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW, SHINGLE = 10, 3
BROADCAST_ROWS, MASK_BITS = 200_000, 26
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of digits, letters and everything beyond ASCII."""
    return _WORD.findall(text.lower())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    for batch in batches:
        data, offsets = C.text_bytes(pa.Table.from_batches([batch]))
        text = data.tobytes()
        yield batch, [words_of(text[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def item_windows(items: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, words, tokens): distinct windows of each item; tokens are its shingles in order. Null texts and texts without words
    have none; repeated items give the same windows again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            out: dict[str, list] = {"item_id": [], "words": [], "tokens": []}
            for item, ws in zip(batch.column("item_id").to_pylist(), texts, strict=True):
                n = min(window, len(ws))
                for w in dict.fromkeys(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1 if n else 0)):
                    s = min(SHINGLE, n)
                    out["item_id"].append(item)
                    out["words"].append([x.decode() for x in w])
                    out["tokens"].append([b" ".join(w[k : k + s]).decode() for k in range(n - s + 1)])
            yield pa.RecordBatch.from_pydict(out, pa.schema([("item_id", pa.string()), ("words", pa.list_(pa.string())), ("tokens", pa.list_(pa.string()))]))

    return items.select(F.col(item_col).cast("string").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "item_id string, words array<string>, tokens array<string>")


class Vocabulary:
    """Finds given shingles (of one to three words) in a list of words, by number."""

    def __init__(self, tokens: list[str]):
        split = [t.encode().split(b" ") for t in tokens]
        self.word = {w: i for i, w in enumerate(sorted({w for s in split for w in s}), 1)}
        self.base = len(self.word) + 1
        self.sizes = sorted({len(s) for s in split})
        self.codes, self.number = {}, {}
        for size in self.sizes:
            found = sorted((self._code([self.word[w] for w in s]), k) for k, s in enumerate(split) if len(s) == size)
            self.codes[size] = np.array([c for c, _ in found], np.int64)
            self.number[size] = np.array([k for _, k in found], np.int64)

    def _code(self, ids: list[int]) -> int:
        code = 0
        for i in ids:
            code = code * self.base + i
        return code

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Places of known shingles, and their numbers."""
        ids = np.fromiter(map(self.word.get, words, [0] * len(words)), np.int64, len(words))
        places, numbers = [], []
        for size in self.sizes:
            n = len(ids) - size + 1
            if n <= 0:
                continue
            at = np.flatnonzero(np.logical_and.reduce([ids[k : k + n] > 0 for k in range(size)]))
            code = np.zeros(len(at), np.int64)
            for k in range(size):
                code = code * self.base + ids[at + k]
            i = np.minimum(np.searchsorted(self.codes[size], code), len(self.codes[size]) - 1)
            hit = self.codes[size][i] == code
            places.append(at[hit])
            numbers.append(self.number[size][i[hit]])
        return (np.concatenate(places), np.concatenate(numbers)) if places else (np.zeros(0, np.int64),) * 2


def _all_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Counts of every shingle, for benchmarks too large to hand to each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches):
            for ws in texts:
                yield pa.RecordBatch.from_arrays([pa.array([b" ".join(ws[k : k + s]).decode() for s in sizes for k in range(len(ws) - s + 1)], pa.string())], ["token"])

    return docs.select("text").mapInArrow(run, "token string").groupBy("token").agg(F.count("*").alias("n"))


def token_counts(docs: DataFrame, tokens: list[str]) -> DataFrame:
    """How often each given shingle occurs in the documents; each task counts by itself, Spark adds up."""
    vocabulary = Vocabulary(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tokens), np.int64)
        for _, texts in _texts(batches):
            for ws in texts:
                total += np.bincount(vocabulary.find(ws)[1], minlength=len(tokens))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([tokens[k] for k in seen.tolist()], pa.string()), pa.array(total[seen])], ["token", "n"])

    return docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


_PLACES = "row long, doc_id long, n_words long, places array<struct<token:string,at:long,before:array<string>,after:array<string>>>"


class Mask:
    """Finds shingles whose hash is in a bitmap; some of them are others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def find(self, words: list[bytes]) -> tuple[list[int], list[str]]:
        found = [(k, t) for n in range(1, SHINGLE + 1) for k, t in enumerate(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))]
        slots = np.array([xxhash.xxh64_intdigest(t, 42) & ((1 << MASK_BITS) - 1) for _, t in found], np.int64)
        hit = np.flatnonzero(C.is_set(self.bits, slots)).tolist()
        return [found[k][0] for k in hit], [found[k][1].decode() for k in hit]


class Listed:
    """Finds the listed shingles."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.vocabulary = tokens, Vocabulary(tokens)

    def find(self, words: list[bytes]) -> tuple[list[int], list[str]]:
        at, number = self.vocabulary.find(words)
        return at.tolist(), [self.tokens[k] for k in number.tolist()]


def _places(docs: DataFrame, prefixes: Listed | Mask, window: int) -> DataFrame:
    """Each document's words and where prefix tokens stand, with up to ``window`` words on both sides."""
    kind = pa.list_(pa.struct([("token", pa.string()), ("at", pa.int64()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            found = []
            for ws in texts:
                found.append([{"token": t, "at": p, "before": [x.decode() for x in ws[max(0, p - window) : p]], "after": [x.decode() for x in ws[p : p + window]]} for p, t in zip(*prefixes.find(ws), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array([len(ws) for ws in texts], pa.int64()), pa.array(found, kind)], ["row", "doc_id", "n_words", "places"])

    return docs.mapInArrow(run, _PLACES)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per input row: doc_id, n_words, n_hit (words inside any occurrence of an item window), items (ids, as strings, sorted).

    Null texts have no words; items without words match nothing. Repeated rows keep a row each; repeated items with one id
    count once.
    """
    # a row's key: whatever its id, rows stay apart
    docs = C.id_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    windows = C.checkpoint(item_windows(items, window, item_col, item_text_col).distinct().withColumn("window", F.concat_ws(" ", "words")))
    tokens = windows.select(F.explode("tokens").alias("token")).distinct()
    n_tokens = tokens.count()
    small = n_tokens <= BROADCAST_ROWS
    held = F.broadcast if small else (lambda df: df)
    if small:
        counts = token_counts(docs, sorted(r[0] for r in tokens.collect()))
    else:
        counts = _all_shingles(docs, [1, 2, 3]).join(tokens, "token", "left_semi")
    each = windows.select("item_id", "window", "words", F.posexplode("tokens").alias("offset", "token"))
    ranked = each.join(held(counts), "token", "left").groupBy("item_id", "window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")).alias("rarest"), F.first("words").alias("words"))
    # a window whose rarest shingle never occurs cannot occur
    prefix = C.checkpoint(ranked.where("rarest.n > 0").select("item_id", "words", F.size("words").alias("length"), F.col("rarest.token").alias("token"), F.col("rarest.offset").alias("offset")))
    wanted = prefix.select("token").distinct()
    # at most one prefix token for each window, so the list is bounded where all tokens are
    slot = F.xxhash64("token").bitwiseAND(F.lit((1 << MASK_BITS) - 1)).alias("slot")
    finder = Listed(sorted(r[0] for r in wanted.collect())) if small else Mask(C.bitmap(wanted.select(slot), MASK_BITS))
    places = _places(docs.select("row", "doc_id", "text"), finder, window)
    found = C.checkpoint(places)
    spots = found.where(F.size("places") > 0).select("row", "n_words", F.inline("places"))
    fits = (F.col("at") >= F.col("offset")) & (F.col("at") - F.col("offset") + F.col("length") <= F.col("n_words"))
    equal = F.concat(F.slice("before", F.size("before") - F.col("offset") + 1, F.col("offset")), F.slice("after", F.lit(1), F.col("length") - F.col("offset"))) == F.col("words")
    hits = spots.join(held(prefix), "token").where(fits).where(equal).select("row", (F.col("at") - F.col("offset")).alias("start"), F.col("length").alias("size"), "item_id")
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    covered = F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["to"]), F.lit(0).cast("long"))).alias("n"), F.greatest(acc["to"], s["end"]).alias("to")), lambda acc: acc["n"])
    per = hits.groupBy("row").agg(covered.alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items"))
    return found.select("row", "doc_id", "n_words").join(per, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(C.read_table(spark, sf_dir, "documents"), C.read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, low),
t AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, low),
iw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS k FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM t WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
m AS (SELECT doc_id, item_id, i, n FROM dw JOIN iw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def brute_force(rows: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple]:
    """Every window at every place, for tests on small fixtures."""
    wins: dict[tuple, set[str]] = {}
    for item, t in items:
        ws = words_of((t or "").encode())
        n = min(window, len(ws))
        for k in range(len(ws) - n + 1 if n else 0):
            wins.setdefault(tuple(ws[k : k + n]), set()).add(str(item))
    sizes, out = {len(w) for w in wins}, {}
    for i, t in rows:
        ws, hit, got = words_of((t or "").encode()), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if (w := tuple(ws[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    got |= wins[w]
        out[i] = (len(ws), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit))
    return out
