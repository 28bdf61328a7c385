"""Exact top-k search by inner product: norm-bucketed retrieval.

Vectors are grouped by length: a bucket spans an eighth of a doubling of the squared length, and a bucket of many rows is cut
into blocks of a bounded number. Queries are cut into blocks as well; a task takes one query block and a lane of candidate
blocks, longest first, and keeps each query's k best so far. The k-th best score over (query length * greatest
length of the block) is the query's local cosine threshold there. Above 1 the block is skipped. Where it is high, few
directions qualify, and each query is pruned by its strongest coordinates, whose feasible ranges follow from the threshold;
elsewhere by length alone, as a prefix of the block. What remains is verified by integer products. The first lane holds the
longest vectors; its results give the later lanes their thresholds to start with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

SCALE, TOP, QUERY_EVERY = 64, 20, 20
BLOCK_ROWS, LANE_BLOCKS, BLOCK_BYTES = 8192, 8, 8_000_000  # of a block, in components of eight bytes
QUERY_ROWS, LEAST_QUERY_ROWS, QUERY_TASKS = 16_384, 512, 12
COORDINATE_COSINE, COORDINATES = 0.9, 3
_SLACK = 1e-9
_EXACT = 2.0**52

_BLOCK = "block int, longest double, n int, dims int, rows binary, ids binary, vectors binary"
_BLOCK_T = pa.schema([("block", pa.int32()), ("longest", pa.float64()), ("n", pa.int32()), ("dims", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("vectors", pa.binary())])
_HIT = "row long, query_id long, vec_id long, score long"
_HIT_T = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(row, vec_id, v, length): floor(scale * x) of each component, for rows with an id and finite components only."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == F.lit(float("inf"))))
    v = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long"))
    squares = F.aggregate("v", F.lit(0.0), lambda acc, e: acc + e.cast("double") * e.cast("double"))
    return vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).withColumn("length", F.sqrt(squares))


def _matrix(col: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """Lists as rows of one matrix; missing components count as zero."""
    arr = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    offsets, values = arr.offsets.to_numpy().astype(np.int64), arr.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), within] = values[offsets[0] : offsets[-1]]
    return out, out.shape[1]


def _packed(blocks: DataFrame) -> DataFrame:
    """One row for each block, its vectors longest first."""

    def run(table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        order = np.lexsort((table.column("row").to_numpy(), -length))
        m, dims = _matrix(table.column("v"))
        return pa.Table.from_pylist([{"block": table.column("block")[0].as_py(), "longest": float(length.max()), "n": len(order), "dims": dims, "rows": table.column("row").to_numpy()[order].tobytes(), "ids": table.column("vec_id").to_numpy()[order].tobytes(), "vectors": m[order].astype(np.int32 if np.abs(m).max(initial=0) < 2**31 else np.int64).tobytes()}], _BLOCK_T)

    return blocks.groupBy("block").applyInArrow(run, _BLOCK)


def _unpacked(record: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows, ids = np.frombuffer(record["rows"], np.int64), np.frombuffer(record["ids"], np.int64)
    narrow = len(record["vectors"]) < 8 * record["n"] * record["dims"]
    v = np.frombuffer(record["vectors"], np.int32 if narrow else np.int64).reshape(record["n"], record["dims"]).astype(np.int64)
    return rows, ids, v, np.sqrt((v.astype(np.float64) ** 2).sum(1))


def _fit(a: np.ndarray, dims: int) -> np.ndarray:
    return a if a.shape[1] == dims else np.pad(a, ((0, 0), (0, dims - a.shape[1])))


class Searcher:
    """A block of queries and their k best candidates so far."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, length: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.rows, self.ids, self.v, self.length, self.k = rows, ids, v, length, k
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(rows)
        self.floor = np.full(len(rows), -np.inf) if floor is None else floor.astype(np.float64).copy()

    def _keep(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.best[q][0], ids]), np.concatenate([self.best[q][1], scores])
        if len(ids) > self.k:
            order = np.lexsort((ids, -scores))[: self.k]
            ids, scores = ids[order], scores[order]
        self.best[q] = ids, scores
        if len(ids) == self.k:
            self.floor[q] = max(self.floor[q], float(scores.min()))

    def _products(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        if np.abs(q).max(initial=0) * float(np.abs(p).max(initial=0)) * max(q.shape[1], 1) < _EXACT:
            return (q.astype(np.float64) @ p.T.astype(np.float64)).astype(np.int64)
        return q @ p.T

    def meet(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray, length: np.ndarray) -> None:
        """One candidate block, longest first."""
        dims = max(v.shape[1], self.v.shape[1])
        self.v, v = _fit(self.v, dims), _fit(v, dims)
        bound = self.length * (length[0] if len(length) else 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(bound > 0, self.floor / bound, np.where(self.floor > 0, np.inf, -np.inf))
        live = np.flatnonzero(cosine <= 1 + _SLACK)
        narrow = live[(cosine[live] >= COORDINATE_COSINE) & (length[0] > 0)] if len(length) else live[:0]
        if len(narrow):
            unit = v / np.maximum(length, 1e-300)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            columns = np.take_along_axis(unit, order, axis=0)
            for q in narrow.tolist():
                self._keep(q, *self._by_coordinates(q, float(cosine[q]), v, rows, ids, unit, order, columns))
        wide = np.setdiff1d(live, narrow)
        for some in np.array_split(wide, -(-len(wide) // 256)) if len(wide) else []:
            # by length: |p| >= floor / |q|, a prefix of the block
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(self.length[some] > 0, self.floor[some] / self.length[some], -np.inf)
            prefix = int(np.searchsorted(-length, -(least.min() * (1 - _SLACK) if least.min() > 0 else -np.inf), "right"))
            scores = self._products(self.v[some], v[:prefix])
            for q, s in zip(some.tolist(), scores, strict=True):
                at = np.flatnonzero((s >= self.floor[q]) & (rows[:prefix] != self.rows[q]))
                if len(at) > 4 * self.k:
                    cut = np.partition(s[at], len(at) - self.k)[len(at) - self.k]
                    at = at[s[at] >= cut]
                self._keep(q, ids[at], s[at])

    def _by_coordinates(self, q: int, cosine: float, v, rows, ids, unit, order, columns):
        x = self.v[q] / self.length[q]
        strong = np.argsort(-np.abs(x), kind="stable")[:COORDINATES]
        ranges = []
        for f in strong.tolist():
            # a unit vector within the threshold of x has its component f here; the axis itself is within it where x is close to the axis
            middle, wide = x[f] * cosine, float(np.sqrt(max(0.0, (1 - x[f] ** 2) * (1 - cosine**2))))
            least, most = -1.0 if x[f] <= -cosine else middle - wide, 1.0 if x[f] >= cosine else middle + wide
            least, most = least - 1e-7, most + 1e-7
            ranges.append((np.searchsorted(columns[:, f], least), np.searchsorted(columns[:, f], most, "right"), f, least, most))
        low, high, f, _, _ = min(ranges, key=lambda r: r[1] - r[0])
        at = order[low:high, f]
        for _, _, g, least, most in ranges:
            if g != f:
                at = at[(unit[at, g] >= least) & (unit[at, g] <= most)]
        at = at[rows[at] != self.rows[q]]
        s = self._products(self.v[q : q + 1], v[at])[0]
        keep = s >= self.floor[q]
        return ids[at[keep]], s[keep]

    def hits(self) -> pa.Table:
        n = [len(b[0]) for b in self.best]
        ids, scores = (np.concatenate([b[i] for b in self.best]) if self.best else np.zeros(0, np.int64) for i in (0, 1))
        return pa.table({"row": np.repeat(self.rows, n), "query_id": np.repeat(self.ids, n), "vec_id": ids, "score": scores}, schema=_HIT_T)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Each query row's k highest scores among all other rows: row, query_id, rank, vec_id, score; ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``. Rows without an id or with null, missing or non-finite components take no part.
    Vectors of fewer components count as ending in zeros. Rows of equal id are separate candidates and separate queries.
    """
    base = C.checkpoint(quantised(vectors, id_col, vector_col, scale))
    bucket = F.when(F.col("length") > 0, F.floor(F.log2("length") * 8).cast("int")).otherwise(F.lit(-1))
    base = base.withColumn("bucket", bucket)
    # at most some thousand lengths exist, as a bucket spans a fixed ratio of a double
    counted = base.groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).collect()
    sizes = {r["bucket"]: r["n"] for r in counted}
    in_bytes = max(1, BLOCK_BYTES // (8 * max([1, *(r["dims"] for r in counted)])))
    block_rows, query_rows = min(BLOCK_ROWS, in_bytes), min(QUERY_ROWS, 2 * in_bytes)
    n_queries = base.where(is_query).count()
    if not n_queries:
        return vectors.sparkSession.createDataFrame([], _HIT + ", rank int")
    first, parts, n_blocks = {}, {}, 0
    for b in sorted(sizes, reverse=True):
        first[b], parts[b] = n_blocks, -(-sizes[b] // block_rows)
        n_blocks += parts[b]
    places = base.sparkSession.createDataFrame([(b, first[b], parts[b]) for b in sizes], "bucket int, first int, parts int")
    salted = base.join(F.broadcast(places), "bucket").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int"))
    blocks = C.checkpoint(_packed(salted.select("block", "row", "vec_id", "v", "length")))
    n_query_blocks = -(-n_queries // min(query_rows, max(LEAST_QUERY_ROWS, n_queries // QUERY_TASKS)))
    queries = base.where(is_query).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_query_blocks)).cast("int"))
    asked = C.checkpoint(_packed(queries.select("block", "row", "vec_id", "v", "length")))
    lane = F.floor(F.col("block") / LANE_BLOCKS).cast("int")

    def search(key, asked: pa.Table, blocks: pa.Table) -> pa.Table:
        if not asked.num_rows or not blocks.num_rows:
            return _HIT_T.empty_table()
        rows, ids, v, length = _unpacked(asked.to_pylist()[0])
        s = Searcher(rows, ids, v, length, k)
        if "floors" in asked.column_names and (packed := asked.column("floors")[0].as_py()):
            known = {r["row"]: r["floor"] for r in packed}
            s.floor = np.array([known.get(r, -np.inf) for r in rows.tolist()], np.float64)
        for record in sorted(blocks.to_pylist(), key=lambda r: -r["longest"]):
            s.meet(*_unpacked(record))
        return s.hits()

    def lanes(some: DataFrame, asked: DataFrame, least: DataFrame | None = None) -> DataFrame:
        """Every candidate block to the query blocks that it may have something for, by length alone."""
        pairs = some.select("block", "longest", lane.alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))).alias("asker"))
        if least is not None:
            pairs = pairs.join(least, "asker").where(F.col("longest") * (1 + _SLACK) >= F.col("least"))
        pairs = C.checkpoint(pairs.select("block", "lane", "asker"))
        dealt = some.join(pairs, "block")
        asked = asked.withColumnRenamed("block", "asker").join(pairs.select("asker", "lane").distinct(), "asker")
        return asked.groupBy("asker", "lane").cogroup(dealt.groupBy("asker", "lane")).applyInArrow(search, _HIT)

    hits = C.checkpoint(_best(lanes(blocks.where(lane == 0), asked), k))
    if n_blocks > LANE_BLOCKS:
        floors = hits.where(F.col("rank") == k).select("row", F.col("score").alias("floor"))
        of = queries.select(F.col("block").alias("of"), "row").join(floors, "row").groupBy("of").agg(F.collect_list(F.struct("row", "floor")).alias("floors"))
        primed = asked.join(of, asked["block"] == of["of"], "left").drop("of")
        # a candidate must be as long as the least floor of a block's queries asks for; without a floor anything may serve
        needs = F.when((F.col("length") > 0) & F.col("floor").isNotNull(), F.col("floor") / F.col("length")).otherwise(F.lit(float("-inf")))
        least = queries.join(floors, "row", "left").groupBy(F.col("block").alias("asker")).agg(F.min(needs).alias("least"))
        hits = _best(lanes(blocks.where(lane > 0), primed, least).unionByName(hits.drop("rank")), k)
    return hits.select("row", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(C.read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
    return found.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_inner_product(q.e, p.e) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def brute_force(rows: list[tuple], k: int = TOP) -> list[tuple[int, int, int, int]]:
    """All products, for tests on small fixtures."""
    import math

    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(ok):
        if i % QUERY_EVERY == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, p, strict=False)), j) for b, (j, p) in enumerate(ok) if a != b)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)
