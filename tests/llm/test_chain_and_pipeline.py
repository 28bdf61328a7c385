"""The classifier chain against a plain one, and the whole pipeline over planted documents."""

import math
import random
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import decontaminate, sentencepiece_viterbi, toxicity


def plain_terms(text):
    words = {w for w in regex.split(r"[^\p{L}\p{M}]+", (text or "").lower()) if len(w) > 1}
    return words | {w[:n] + "-" for w in words for n in (4, 5) if len(w) > n}


def plain_fit(x, y, reg=2e-4, mix=0.5, steps=6000):
    """Logistic regression with an elastic net, by accelerated proximal steps; the intercept is free."""
    if not 0 < y.sum() < len(y):
        return None, float(y.mean()) if len(y) else 0.0
    a = np.c_[x, np.ones(len(x))]
    rate = 1 / (np.linalg.norm(a, 2) ** 2 / (4 * len(y)) + reg)
    w = z = np.zeros(a.shape[1])
    t = 1.0
    l1, l2 = np.r_[np.full(x.shape[1], reg * mix), 0], np.r_[np.full(x.shape[1], reg * (1 - mix)), 0]
    for _ in range(steps):
        g = a.T @ (1 / (1 + np.exp(-a @ z)) - y) / len(y) + l2 * z
        new = z - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / after * (new - w), new, after
    return w, None


def plain_probability(model, x):
    w, share = model
    return np.full(len(x), share) if w is None else 1 / (1 + np.exp(-(np.c_[x, np.ones(len(x))] @ w)))


def test_chain_equals_a_plain_one(spark):
    rng = random.Random(2)
    good, bad, vile = ["alpha", "bravo", "charlie", "delta", "échos"], ["spam", "junkmail", "clickbait"], ["scumbag", "moronic"]
    rows, labels = [], []
    for i in range(240):
        low, toxic = int(rng.random() < 0.4), 0
        words = rng.choices(good, k=rng.randint(2, 9)) + (rng.choices(bad, k=2) if low and rng.random() < 0.9 else [])
        if rng.random() < (0.5 if low else 0.1):
            toxic = 1
            words += [rng.choice(vile)] if rng.random() < 0.9 else []
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        if i % 4:
            labels.append((i, 1 - low, toxic))
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, table, toxicity.label_categories())
    got = {r["doc_id"]: (r["p_low_quality"], r["p_toxic"]) for r in toxicity.judged(docs, chain, "toxic").collect()}

    fold = {r["doc_id"]: r["f"] for r in table.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    held = {i: plain_terms(t) for i, t in rows}
    ids = [i for i, _, _ in labels]
    vocabulary = sorted(t for t in set().union(*(held[i] for i in ids)) if toxicity.LEAST_ROWS <= sum(t in held[i] for i in ids) < len(ids))
    assert chain.vocabulary == vocabulary
    matrix = lambda which: np.array([[t in held[i] for t in vocabulary] for i in which], float)
    x, folds = matrix(ids), np.array([fold[i] for i in ids])
    low, toxic = np.array([1 - q for _, q, _ in labels], float), np.array([t for _, _, t in labels], float)
    unseen = np.zeros(len(ids))
    for k in range(toxicity.FOLDS):
        unseen[folds == k] = plain_probability(plain_fit(x[folds != k], low[folds != k]), x[folds == k])
    first, second = plain_fit(x, low), plain_fit(np.c_[x, unseen], toxic)
    every = matrix([i for i, _ in rows])
    p_low = plain_probability(first, every)
    p_toxic = plain_probability(second, np.c_[every, p_low])
    worst = max(max(abs(got[i][0] - p_low[k]), abs(got[i][1] - p_toxic[k])) for k, (i, _) in enumerate(rows))
    assert worst < 0.05  # the library's fits stop after 60 iterations
    assert sum((got[i][1] >= 0.5) != (p_toxic[k] >= 0.5) for k, (i, _) in enumerate(rows)) <= 2
    assert abs(second[0][-2]) > 0  # the earlier category tells something


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(14), prose(120)
    near = base.split()
    near[60] = "changed"
    rows = [(i, prose(rng.randint(20, 60)) + (" scumbag moronic" if i % 5 == 0 else "")) for i in range(150)]
    rows += [(1000, base), (1001, " ".join(near)), (1002, base), (1003, prose(20) + " " + passage + " " + prose(20)), (1004, prose(20) + " " + " ".join(passage.split()[:9]) + " " + prose(20)), (1005, "write to jo@mail.example now " + prose(30)), (1006, None), (1007, ""), (1008, "scumbag moronic scumbag")]
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(0, 150)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, [(1, passage), (2, None)]


def test_stages_drop_what_they_must(spark, folder):
    at, rows, items = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, at)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, t in rows if "scumbag" not in (t or "")}
    clean = corpus_pipeline.drop_contaminated(spark, docs, at)
    hit = {i for i, r in decontaminate.brute_force(rows, items).items() if r[1]}
    assert hit == {1003} and clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - hit
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_contaminated, corpus_pipeline.drop_near_copies, corpus_pipeline.sanitise_personal_data, corpus_pipeline.encode_tokens):
        assert stage(spark, docs.limit(0), at).count() == 0


def test_the_whole_pipeline(spark, folder):
    import sentencepiece

    at, rows, _ = folder
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, at).collect()}
    # of texts without a word one stays, the first of them
    assert set(got) == {i for i, t in rows if "scumbag" not in (t or "")} - {1001, 1002, 1003, 1007}
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_viterbi.model_file())
    texts = dict(rows)
    plain = [i for i in got if i not in (1005, 1006)]
    assert all(list(got[i]["ids"]) == sp.encode(texts[i]) for i in plain) and got[1006]["n_tokens"] == 0
    said = sp.decode(list(got[1005]["ids"]))
    assert "[EMAIL]" in said and "jo@mail" not in said and re.match(r"\S+ \S+ \[EMAIL\]", said)


def test_pipeline_takes_all_keys_of_near_copies(spark, monkeypatch):
    from newsloom.llm import near_copies

    found, prints, candidates = [], near_copies._prints, near_copies._candidates
    monkeypatch.setattr(near_copies, "_prints", lambda rows, often, shingle, most: found.append(most) or prints(rows, often, shingle, most))
    monkeypatch.setattr(near_copies, "_candidates", lambda keyed, sigmas: found.append(sigmas) or candidates(keyed, sigmas))
    words = [f"w{n}" for n in range(1200)]
    # twelve near copies, so that keys are held by more than are compared in full
    rows = [(n, " ".join([*words[: 90 * n], f"new{n}", *words[90 * n :]])) for n in range(12)]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert [r["doc_id"] for r in kept.collect()] == [0]
    assert found and set(found) == {None}


def test_rounds_of_components_write_few_files(spark, monkeypatch):
    """A round's tables are small beside the partitions of a shuffle, each of which would be files of their own."""
    from newsloom.llm import graph

    parts, checkpoint = [], graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: parts.append((out := checkpoint(df)).rdd.getNumPartitions()) or out)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)], "a long, b long")
        found = {r["node"]: r["component"] for r in graph.connected_components(links).collect()}
        monkeypatch.setattr(graph, "TASK_LINKS", 40)
        again = {r["node"]: r["component"] for r in graph.connected_components(links).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == again == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}
    at = parts.index(23, 1)  # the second run's first
    assert set(parts[1:at]) == {1} and 1 < max(parts[at + 1 :]) < 23


def test_keys_and_texts_of_near_dedup_are_sent_once_or_not_at_all(spark, monkeypatch):
    from newsloom.llm import common, near_copies

    columns, exploded, runs = [], [], []
    among, keys, prefix_pairs = common.among, near_copies._keys, near_copies._prefix_pairs
    monkeypatch.setattr(common, "among", lambda rows, *names: columns.append(out := among(rows, *names)) or out)
    monkeypatch.setattr(near_copies, "_keys", lambda *a: exploded.append(1) or keys(*a))
    monkeypatch.setattr(near_copies, "_prefix_pairs", lambda keyed: runs.append((keyed, out := prefix_pairs(keyed))) or out)
    monkeypatch.setattr(near_copies, "OFTEN", 1000)  # so that shingles of the opening do not come last
    # a shared opening makes long runs of texts that are no copies; ids of rows that go, repeated, and none
    opening = [f"open{k}" for k in range(12)]
    rows = [(n, " ".join(opening + [f"w{n}x{k}" for k in range(12)])) for n in range(30)]
    whole = [f"c{k}" for k in range(200)]
    rows += [(100 + n, " ".join([*whole[: 20 * n], f"new{n}", *whole[20 * n :]])) for n in range(3)]
    kept = sorted([*rows[:31], (7, "another text of seven"), (None, "no id")], key=str)
    docs = spark.createDataFrame([*rows, rows[3], rows[3], (7, "another text of seven"), (None, "no id"), (None, "no id"), (110, rows[3][1])], "doc_id long, text string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(map(tuple, got.collect()), key=str) == kept
    # of texts only those that may go or stand twice: ids 3, 7, 101, 102, 110 and none
    assert {r["doc_id"] for r in docs.where(columns[-1]).collect()} == {3, 7, 101, 102, 110, None}
    # the keys are made once, and long runs give their rows with the pairs
    assert len(exploded) == 1 and len(runs) == 1
    by_key = {}
    for r in runs[0][0].collect():
        by_key.setdefault(r["key"], set()).add((r["cls"], r["n"]))
    want = {(k, *m) for k, members in by_key.items() if len(members) > near_copies.RUN_ROWS for m in members}
    assert want and {(r["key"], r["a"], r["n"]) for r in runs[0][1].where("b is null").collect()} == want
    # a row that is surely its class's first goes through no join for its keys
    n = 1 << 18
    ids = spark.range(n)
    assert ids.where(common.among(ids.where("id % 2 = 0"), "id") & F.expr("id % 2 = 0")).count() == n // 2
    assert ids.where(common.among(ids.where("id < 10"), "id")).count() < 20
