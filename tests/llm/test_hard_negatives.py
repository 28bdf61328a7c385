"""Hard negatives against all products, over hard rows, equal rows and lengths of every kind."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import hard_negatives as H

CLASHING = ("row", "v", "length", "cell", "along", "parts", "block", "group", "floor", "scores", "to", "part", "window", "rank", "score", "cells", "n")


def made(rng, n, dims, kind):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, 0.2) for x in c] if kind == "near" else [rng.gauss(0, 1) for _ in range(dims)]
        if kind == "equal" and i % 3:
            v = centres[0]
        if kind == "lengths":
            v = [x * 4 ** rng.randint(-3, 3) for x in v]
        rows.append((i, v, rng.randint(0, 3)))
    return rows


@pytest.mark.parametrize("kind", ["near", "random", "equal", "lengths"])
def test_tree_search(kind):
    rng = random.Random(kind)
    rows = made(rng, 700, 5, kind)
    v, labels, ids = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64), np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    tree = H.VantageTree(ids, ids, labels, v, leaf_rows=8)
    assert sum(b - a for a, b, _ in tree.leaves) == 700 and max(b - a for a, b, _ in tree.leaves) <= 8
    at, scores = np.arange(0, 700, 9), v @ v.T
    low, high = tree.bounds(v[at])
    for k, (a, b, _) in enumerate(tree.leaves):
        s = v[at] @ tree.v[a:b].T
        assert (s >= low[:, k][:, None]).all() and (s <= high[:, k][:, None]).all()
    for same in (True, False):
        spans = [sorted(rng.sample(sorted(scores[a].tolist()), 4)) for a in at.tolist()]
        lows, highs = [[s[0], s[1]] for s in spans], [[s[2], s[3]] for s in spans]
        got = {(a, w): list(zip((-s).tolist(), i.tolist(), strict=True)) for a, w, i, s in tree.search(at, labels[at], v[at], same, 4, lows, highs, np.full(len(at), -H._MOST))}
        for k, a in enumerate(at.tolist()):
            for w in (0, 1):
                fit = sorted((-int(scores[a, j]), j) for j in range(700) if j != a and (labels[j] == labels[a]) == same and lows[k][w] <= scores[a, j] <= highs[k][w])[:4]
                assert got.get((k, w), []) == fit


def test_cells_bound_their_rows():
    rng = random.Random(2)
    v = np.floor(256 * np.array([r[1] for r in made(rng, 900, 4, "lengths")])).astype(np.int64)
    most = float(np.sqrt((v.astype(float) ** 2).sum(1).max()))
    router = H.Router(v[::7], most, 16)
    cell, d = router.cells(v)
    assert len(router.path) == 16 and len(set(cell.tolist())) > 8
    least, greatest = np.zeros((16, len(router.points))), np.zeros((16, len(router.points)))
    for c in set(cell.tolist()):
        least[c], greatest[c] = d[cell == c].min(0), d[cell == c].max(0)
    low, high = router.bounds(v[:50], least, greatest)
    s = v[:50] @ v.T
    assert all((s[:, cell == c] >= low[:, c][:, None]).all() and (s[:, cell == c] <= high[:, c][:, None]).all() for c in set(cell.tolist()))
    assert len(H.Router(np.ones((50, 3), np.int64), 2.0, 8).path) == 1  # equal points are not cut


def answers(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in df.collect())


@pytest.mark.parametrize("kind", ["near", "equal", "lengths"])
def test_hard_negatives(spark, tmp_path, kind):
    rng = random.Random(kind)
    rows = made(rng, 2600, 6, kind)
    rows += [(300, [0.5] * 6, 1), (300, [0.5] * 6, 1), (None, [1.0] * 6, 1), (2800, None, 1), (2900, [1.0] * 6, None), (3000, [float("nan")] * 6, 2), (3100, [float("inf"), 1.0], 2), (3200, [None, 1.0], 2), (3300, [1.0], 0), (3400, [], 1), (3500, [1e30, -1e30, 2.0], 3), (3501, [1e30, 1.0], 2), (3502, [1e30], 3), (3600, [0.0] * 6, 0), (3700, [1.0] * 6, 77), (-100, [0.3] * 6, -1), (-7, [0.3] * 6, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *(F.lit("x").alias(c) for c in CLASHING))
    table.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    wanted = H.brute_force(rows)
    assert answers(H.op11_hard_negatives(spark, str(tmp_path))) == wanted and len(wanted) > 100


def test_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    none.write.parquet(f"{tmp_path}/a/embeddings.parquet")
    assert H.op11_hard_negatives(spark, f"{tmp_path}/a").collect() == []
    spark.createDataFrame([(1, [1.0], 0), (2, [1.0], 1)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert H.op11_hard_negatives(spark, f"{tmp_path}/b").collect() == []  # no anchors
    spark.createDataFrame([(100, [1.0], 0), (1, [1.0], 1)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/c/embeddings.parquet")
    assert H.op11_hard_negatives(spark, f"{tmp_path}/c").collect() == []  # no positives
