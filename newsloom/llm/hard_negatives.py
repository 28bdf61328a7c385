"""Hard-negative mining: vantage-point trees over norm-augmented vectors.

One more component, sqrt(M^2 - |p|^2) with M the greatest length, gives all rows the length M; an anchor q gets a zero there.
Then |q - p|^2 = M^2 + |q|^2 - 2 q.p, so the nearest rows are those of the highest inner product, and a window of scores is an
annulus of distances around the anchor.

A tree over a bounded sample of rows splits the space into cells; every row goes to its cell, a cell of many rows is dealt to
blocks by a hash, so that equal rows in any number are split, and each block is a vantage-point tree of its own. Anchors are sent
to the blocks of those cells that may meet their annulus (the bounds of a cell hold over all its rows, whatever the sample was), and
walk a block's leaves nearest first from the inner edge of the annulus outwards until k rows are found that no later leaf can
better. Positives are the nearest rows of the anchor's label, in the anchor's own cell first and then wherever a better one may
be; their scores give the windows in which rows of other labels are sought. All scores are integer products.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .topk_search import _EXACT, _fit, _matrix

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100  # of a positive's score, per cent
SAMPLE_ROWS, CELLS = 4096, 256  # the sample only places rows; answers do not depend on it
BLOCK_ROWS, LEAST_BLOCK_ROWS, BLOCK_BYTES, TASKS = 16_384, 512, 16_000_000, 24
LEAF_ROWS, ANCHOR_ROWS = 256, 8192
_FAR = float(2**63)
_MOST = 2**63 - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int) -> DataFrame:
    """vec_id, label, v, length of the rows that take part: those with an id, a label and finite components only."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == F.lit(float("inf"))))
    v = F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long"))
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & ~bad)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))
    return rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, e: acc + e.cast("double") * e.cast("double"))))


def augmented(v: np.ndarray, most: float) -> np.ndarray:
    v = v.astype(np.float64)
    return np.c_[v, np.sqrt(np.maximum(most * most - (v * v).sum(1), 0))]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


class Router:
    """The tree of cells: a vantage point and a radius at each node."""

    def __init__(self, sample: np.ndarray, most: float, cells: int):
        self.most, self.dims = most, sample.shape[1]
        points = augmented(sample, most)
        self.points, self.radius, self.child, self.path = [], [], [], []
        heap = [(-len(points), 0, np.arange(len(points)), [], None)]
        done: list[tuple] = []
        while heap and len(heap) + len(done) < cells:
            n, _, at, path, slot = heapq.heappop(heap)
            vantage = self._vantage(points[at])
            d = distances(points[at], points[at[vantage]][None])[:, 0] if -n > 1 else np.zeros(1)
            radius = float(np.median(d))
            near = d <= radius
            if near.all():
                done.append((path, slot))  # equal points: no further cut
                continue
            node = len(self.points)
            self.points.append(points[at[vantage]])
            self.radius.append(radius)
            self.child.append([0, 0])
            if slot:
                self.child[slot[0]][slot[1]] = node
            for side, some in enumerate((at[near], at[~near])):
                heapq.heappush(heap, (-len(some), 2 * node + side + 1, some, [*path, node], (node, side)))
        for path, slot in [*done, *((h[3], h[4]) for h in heap)]:
            if slot:
                self.child[slot[0]][slot[1]] = -1 - len(self.path)
            self.path.append(path)
        self.points = np.array(self.points).reshape(len(self.points), self.dims + 1)

    @staticmethod
    def _vantage(points: np.ndarray) -> int:
        """A point at the rim: the farthest from the first."""
        return int(distances(points, points[:1])[:, 0].argmax())

    def cells(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell, and its distances to all vantage points."""
        d = distances(augmented(_fit(v, self.dims), self.most), self.points)
        at = np.zeros(len(v), np.int64) if len(self.points) else np.full(len(v), -1)
        child, radius = np.array(self.child, np.int64).reshape(-1, 2), np.array(self.radius)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            at[inner] = child[node, (d[inner, node] > radius[node]).astype(np.int64)]
        return -1 - at, d

    def bounds(self, v: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score that a row of each cell may have with each vector; ``least`` and ``greatest`` hold cell by node."""
        q = np.c_[_fit(v, self.dims).astype(np.float64), np.zeros(len(v))]
        d = distances(q, self.points)
        near, far = np.zeros((len(v), len(self.path))), np.full((len(v), len(self.path)), np.inf)
        for c, path in enumerate(self.path):
            for node in path:
                near[:, c] = np.maximum(near[:, c], np.maximum(least[c, node] - d[:, node], d[:, node] - greatest[c, node]))
                far[:, c] = np.minimum(far[:, c], d[:, node] + greatest[c, node])
        return _scores(q, self.most, near, far)


def _scores(q: np.ndarray, most: float, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of scores from bounds of distances, widened by what floats may have lost."""
    total = (most * most + (q * q).sum(1))[:, None]
    slack = 1e-6 * np.sqrt(total)
    near, far = np.maximum(near - slack, 0), np.minimum(far, 2 * np.sqrt(total)) + slack
    return np.clip((total - far * far) / 2 - 1, -_FAR, _FAR), np.clip((total - near * near) / 2 + 1, -_FAR, _FAR)


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products; those beyond 64 bits become the greatest or the least 64-bit integer."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(q.shape[1], 1)
    if most < _EXACT:
        return (q.astype(np.float64) @ p.T.astype(np.float64)).astype(np.int64)
    if most < _MOST / 2:
        return q @ p.T
    return np.clip(q.astype(object) @ p.T.astype(object), -_MOST, _MOST).astype(np.int64)


class VantageTree:
    """Rows of a block in the order of the leaves of their tree, each leaf a stretch of a few hundred rows."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.most = float(np.sqrt((v.astype(np.float64) ** 2).sum(1).max(initial=0)))
        points = augmented(v, self.most)
        order, self.leaves, self.nodes = np.arange(len(v)), [], []
        todo = [(0, len(v), [])]  # from, to, and (node, least, greatest distance) of each node above
        while todo:
            a, b, path = todo.pop()
            if b - a <= leaf_rows:
                self.leaves.append((a, b, path))
                continue
            some = points[order[a:b]]
            vantage = some[Router._vantage(some)]
            d = distances(some, vantage[None])[:, 0]
            by = np.argsort(d, kind="stable")
            order[a:b], d, middle = order[a:b][by], d[by], (b - a) // 2
            node = len(self.nodes)
            self.nodes.append(vantage)
            todo.append((a + middle, b, [*path, (node, d[middle], d[-1])]))
            todo.append((a, a + middle, [*path, (node, d[0], d[middle - 1])]))
        self.rows, self.ids, self.labels, self.v = rows[order], ids[order], labels[order], v[order]

    def bounds(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each vector with the rows of each leaf."""
        q = np.c_[v.astype(np.float64), np.zeros(len(v))]
        d = distances(q, np.array(self.nodes).reshape(len(self.nodes), q.shape[1]))
        near, far = np.zeros((len(v), len(self.leaves))), np.full((len(v), len(self.leaves)), np.inf)
        for k, (_, _, path) in enumerate(self.leaves):
            for node, least, greatest in path:
                near[:, k] = np.maximum(near[:, k], np.maximum(least - d[:, node], d[:, node] - greatest))
                far[:, k] = np.minimum(far[:, k], d[:, node] + greatest)
        return _scores(q, self.most, near, far)

    def search(self, rows: np.ndarray, labels: np.ndarray, v: np.ndarray, same: bool, k: int, low: list[list[int]], high: list[list[int]], floor: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(anchor, window, ids, scores): the k best rows of the anchor's label, or of other ones, within each window of scores.

        ``floor`` is a score below which rows are of no use to an anchor. All anchors take their nearest unvisited leaf in turn, so
        that a leaf meets those who come to it at once.
        """
        dims = max(v.shape[1], self.v.shape[1])
        v, here = _fit(v, dims), _fit(self.v, dims)
        if dims != self.v.shape[1]:  # the augmented component stays last
            self.v, self.nodes = here, [np.r_[n[:-1], np.zeros(dims - len(n) + 1), n[-1]] for n in self.nodes]
        least, most = self.bounds(v)
        top = np.array([max(h, default=-_MOST) for h in high], np.int64)
        need = np.maximum(np.array([min(x, default=_MOST) for x in low], np.int64), floor)
        only = [int(self.labels[a]) if (self.labels[a:b] == self.labels[a]).all() else None for a, b, _ in self.leaves]
        useful = np.array([[o is None or (o == x) == same for o in only] for x in labels.tolist()], bool).reshape(len(v), len(only))
        useful &= least <= top[:, None]
        key = np.where(useful, np.minimum(most, top[:, None].astype(np.float64)), -np.inf)
        order = np.argsort(-key, axis=1, kind="stable")
        pools = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(v)
        live = np.arange(len(v))
        for turn in range(len(self.leaves)):
            leaf = order[live, turn]
            going = key[live, leaf] >= need[live].astype(np.float64)
            going &= key[live, leaf] > -np.inf
            live, leaf = live[going], leaf[going]
            if not len(live):
                break
            by = np.argsort(leaf, kind="stable")
            for j, a, b in C.parts(leaf[by]):
                some, (start, end, _) = live[by[a:b]], self.leaves[j]
                s = products(v[some], here[start:end])
                fit = (s >= need[some][:, None]) & (s <= top[some][:, None]) & ((self.labels[start:end] == labels[some][:, None]) == same) & (self.rows[start:end] != rows[some][:, None])
                at, of = np.nonzero(fit)
                for x, i, j2 in C.parts(at):
                    anchor, found = int(some[x]), start + of[i:j2]
                    pools[anchor], need[anchor] = self._kept(pools[anchor], self.ids[found], s[x, of[i:j2]], k, low[anchor], high[anchor], int(floor[anchor]))
        for anchor, (ids, scores) in enumerate(pools):
            for w, (a, b) in enumerate(zip(low[anchor], high[anchor], strict=True)):
                at = np.flatnonzero((scores >= a) & (scores <= b))[:k]
                if len(at):
                    yield anchor, w, ids[at], scores[at]

    @staticmethod
    def _kept(pool: tuple, ids: np.ndarray, scores: np.ndarray, k: int, low: list[int], high: list[int], floor: int) -> tuple[tuple, int]:
        """The pool with new rows, best first, of which each window's k best stay; and the score that a row needs from now on."""
        ids, scores = np.concatenate([pool[0], ids]), np.concatenate([pool[1], scores])
        order = np.lexsort((ids, -scores))
        ids, scores = ids[order], scores[order]
        keep, need = np.zeros(len(ids), bool), _MOST
        for a, b in zip(low, high, strict=True):
            first = int(np.searchsorted(-scores, -b))
            last = min(first + k, int(np.searchsorted(-scores, -a, "right")))
            keep[first:last] = True
            need = min(need, int(scores[first + k - 1]) if last - first == k else a)
        return (ids[keep], scores[keep]), max(need, floor)


_BLOCK = "block long, dims int, rows binary, ids binary, labels binary, vectors binary"
_BLOCK_T = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("rows", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary())])
_HIT = "row long, anchor_id long, anchor_label long, window int, vec_id long, score long"
_HIT_T = pa.schema([("row", pa.int64()), ("anchor_id", pa.int64()), ("anchor_label", pa.int64()), ("window", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Index:
    """All rows in cells and blocks, and the search of anchors in them."""

    def __init__(self, rows: DataFrame):
        self.spark = rows.sparkSession
        size = rows.agg(F.count("*").alias("n"), F.max("length").alias("most"), F.max(F.size("v")).alias("dims")).first()
        self.n, dims = size["n"], size["dims"] or 0
        block_rows = min(BLOCK_ROWS, max(1, BLOCK_BYTES // (8 * max(dims, 1))), max(LEAST_BLOCK_ROWS, -(-self.n // TASKS)))
        numbered = rows.withColumn("row", F.monotonically_increasing_id())
        sample = [r["v"] for r in rows.select("v").orderBy(F.xxhash64("vec_id", "v")).limit(min(SAMPLE_ROWS, max(1, BLOCK_BYTES // (8 * max(dims, 1))))).collect()]
        matrix = np.array([v + [0] * (dims - len(v)) for v in sample], np.int64).reshape(len(sample), dims)
        self.router = router = Router(matrix, size["most"] or 0.0, min(CELLS, -(-self.n // block_rows))) if self.n else None
        if not self.n:
            return
        shared = self.spark.sparkContext.broadcast(router)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    cell, d = shared.value.cells(_matrix(pa.chunked_array([batch.column("v")]))[0])
                    along = [d[k, shared.value.path[c]].tolist() for k, c in enumerate(cell.tolist())]
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(along, pa.list_(pa.float64()))], [*batch.schema.names, "cell", "along"])

        self.rows = C.checkpoint(numbered.mapInArrow(placed, "vec_id long, label long, v array<long>, length double, row long, cell long, along array<double>"))
        counts = {r["cell"]: r["n"] for r in self.rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        self.parts = {c: -(-n // block_rows) for c, n in counts.items()}
        self.least, self.greatest = (np.zeros((len(router.path), len(router.points))) for _ in range(2))
        spans = self.rows.select("cell", F.posexplode("along").alias("level", "d")).groupBy("cell", "level").agg(F.min("d").alias("a"), F.max("d").alias("b"))
        for r in spans.collect():  # cells times their depth
            node = router.path[r["cell"]][r["level"]]
            self.least[r["cell"], node], self.greatest[r["cell"], node] = r["a"], r["b"]
        dealt = self.rows.join(F.broadcast(self._parts()), "cell").withColumn("block", F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("row"), F.col("parts")))

        def packed(table: pa.Table) -> pa.Table:
            m, dims = _matrix(table.column("v"))
            return pa.Table.from_pylist([{"block": table.column("block")[0].as_py(), "dims": dims, **{k: C.int_column(table, c).tobytes() for k, c in (("rows", "row"), ("ids", "vec_id"), ("labels", "label"))}, "vectors": C.pack(m.ravel())}], _BLOCK_T)

        self.blocks = C.checkpoint(dealt.select("block", "row", "vec_id", "label", "v").groupBy("block").applyInArrow(packed, _BLOCK))

    def _parts(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.parts.items()), "cell long, parts long")

    def search(self, anchors: DataFrame, same: bool, k: int, low: int = LOW, high: int = HIGH, where: str = "") -> DataFrame:
        """The k best rows for each window of each anchor: row, anchor_id, anchor_label, window, vec_id, score, rank.

        ``anchors``: row, vec_id, label, v, cell, floor, and scores, whose percentages give the windows (null: one window of all scores).
        ``where`` bounds the cells: "home", "away" from it, or all.
        """
        shared = self.spark.sparkContext.broadcast((self.router, self.least, self.greatest))

        def windows(scores: list[int] | None) -> tuple[list[int], list[int]]:
            if scores is None:
                return [-_MOST], [_MOST]
            return [max(-(-low * s // 100), -_MOST) for s in scores], [min(high * s // 100, _MOST) for s in scores]

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    router, least, greatest = shared.value
                    bottom, top = router.bounds(_matrix(pa.chunked_array([batch.column("v")]))[0], least, greatest)
                    spans = [windows(s) for s in batch.column("scores").to_pylist()]
                    a = np.array([max(min(x[0], default=_MOST), f) for x, f in zip(spans, batch.column("floor").to_pylist(), strict=True)], np.float64)
                    b = np.array([max(x[1], default=-_MOST) for x in spans], np.float64)
                    meet = (top >= a[:, None]) & (bottom <= b[:, None])
                    at, cells = np.nonzero(meet)
                    offsets = np.searchsorted(at, np.arange(batch.num_rows + 1))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(cells))], [*batch.schema.names, "cells"])

        kept = "row long, vec_id long, label long, v array<long>, cell long, floor long, scores array<long>"
        anchors = anchors.select(*(c.split()[0] for c in kept.split(", ")))
        n_groups = -(-max(self.n_anchors, 1) // ANCHOR_ROWS)
        if where == "home":
            dealt = anchors.withColumn("to", F.col("cell"))
        else:
            dealt = anchors.mapInArrow(sent, kept + ", cells array<long>").withColumn("to", F.explode("cells")).drop("cells")
            dealt = dealt.where(F.col("to") != F.col("cell")) if where == "away" else dealt
        parts = F.broadcast(self._parts().withColumnRenamed("cell", "to"))
        dealt = dealt.join(parts, "to").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asked = dealt.select((F.col("to") * (1 << 32) + F.col("part")).alias("block"), F.pmod(F.xxhash64("row"), F.lit(n_groups)).alias("group"), "row", "vec_id", "label", "v", "floor", "scores")
        blocks = self.blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)).cast("array<long>")))

        def met(asked: pa.Table, blocks: pa.Table) -> pa.Table:
            if not asked.num_rows or not blocks.num_rows:
                return _HIT_T.empty_table()
            r = blocks.to_pylist()[0]
            rows, ids, labels = (np.frombuffer(r[c], np.int64) for c in ("rows", "ids", "labels"))
            tree = VantageTree(rows, ids, labels, C.unpack(r["vectors"], np.int64).reshape(len(rows), r["dims"]))
            row, anchor, label = (C.int_column(asked, c) for c in ("row", "vec_id", "label"))
            spans = [windows(s) for s in asked.column("scores").to_pylist()]
            found = list(tree.search(row, label, _matrix(asked.column("v"))[0], same, k, [s[0] for s in spans], [s[1] for s in spans], C.int_column(asked, "floor")))
            n = [len(f[2]) for f in found]
            at = np.repeat(np.array([f[0] for f in found], np.int64), n)
            flat = lambda i: np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)])
            return pa.table([row[at], anchor[at], label[at], np.repeat(np.array([f[1] for f in found], np.int32), n), flat(2), flat(3)], schema=_HIT_T)

        return best(asked.groupBy("block", "group").cogroup(blocks.groupBy("block", "group")).applyInArrow(met, _HIT), k)


def best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "window").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank for each anchor and each of its positives.

    ``is_anchor`` is a condition on ``vec_id``. Rows without an id or a label, or with null, missing or non-finite components, take no
    part. Vectors of fewer components count as ending in zeros; scores beyond 64 bits count as the greatest. Rows of equal id are
    rows apart, as candidates and as anchors. An anchor alone in its label has no positives and no rows in the result; so has an
    empty table. Other columns are not read.
    """
    index = Index(quantised(vectors, id_col, vector_col, F.col("label") if label is None else label, scale))
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, positive_rank int"
    if not index.n:
        return vectors.sparkSession.createDataFrame([], out)
    anchors = index.rows.where(is_anchor).withColumn("floor", F.lit(-_MOST)).withColumn("scores", F.lit(None).cast("array<long>"))
    index.n_anchors = anchors.count()
    at_home = C.checkpoint(index.search(anchors, True, positives, where="home"))
    floors = at_home.where(F.col("rank") == positives).select("row", F.col("score").alias("known"))
    floored = anchors.join(floors, "row", "left").withColumn("floor", F.coalesce("known", "floor"))
    away = index.search(floored, True, positives, where="away")
    found = C.checkpoint(best(at_home.drop("rank").unionByName(away.drop("rank")), positives).withColumnRenamed("rank", "positive_rank"))
    by_anchor = found.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("positive_rank", "score"))), lambda x: x["score"]).alias("scores"))
    hits = index.search(anchors.drop("scores").join(by_anchor, "row"), False, negatives, low, high)
    told = found.select("row", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "positive_rank")
    rows = hits.withColumn("positive_rank", F.col("window") + 1).join(told, ["row", "positive_rank"])
    return rows.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"), F.col("positive_rank").cast("int").alias("positive_rank"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives(C.read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)
    return found.drop("positive_rank")


SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.r, a.vec_id AS anchor_id, a.label = p.label AS same, p.vec_id, CAST(list_inner_product(a.e, p.e) AS BIGINT) AS score
  FROM v a JOIN v p ON a.vec_id % 100 = 0 AND a.r <> p.r
), pos AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5
), neg AS (
  SELECT pos.anchor_id, pos.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY pos.r, pos.k ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
    s.vec_id AS negative_id, pos.score AS positive_score, s.score AS negative_score
  FROM pos JOIN s ON s.r = pos.r AND NOT s.same AND 80 * pos.score <= 100 * s.score AND s.score <= pos.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 5
"""


def brute_force(rows: list[tuple], scale: int = SCALE) -> list[tuple]:
    """All products of rows (vec_id, vector, label), for tests on small fixtures."""
    import math
    from itertools import zip_longest

    ok = [(i, [math.floor(scale * x) for x in v], (n + 1) % 10 if i % 7 == 0 else n) for i, v, n in rows if None not in (i, v, n) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q, n) in enumerate(ok):
        if i % 100 == 0:
            scored = sorted((-max(-_MOST, min(_MOST, sum(x * y for x, y in zip_longest(q, p, fillvalue=0)))), j, m) for b, (j, p, m) in enumerate(ok) if a != b)
            for s, j, _ in [x for x in scored if x[2] == n][:POSITIVES]:
                fit = [(-t, h) for t, h, m in scored if m != n and LOW * -s <= 100 * -t <= HIGH * -s]
                out += [(i, j, rank, h, -s, t) for rank, (t, h) in enumerate(fit[:NEGATIVES], 1)]
    return sorted(out)
