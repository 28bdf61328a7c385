"""Each operator against brute force over a small fixture of hard cases, and over empty tables."""

import math
import random
import tempfile
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import decontaminate, lm_scoring, near_copies, pii, sentencepiece_viterbi, simhash, substring_dedup, suffix_array, suffix_dedup, token_output, topk_search, toxicity
from newsloom.llm.wavelet import WaveletMatrix

CLASHING = ("row", "key", "fp", "chunk", "rep", "spans", "spans_", "id_", "hash_", "rest", "hash", "id", "text_hash", "words_", "terms_", "features_", "item_id", "cls", "n", "block", "train", "label_id", "n_chars")


def texts() -> list[str | None]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ñ'.") for _ in range(rng.randint(1, 7))).strip() or "x"
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(80)
    base = prose(120)
    near = base.split()
    near[60] = "other"
    return [None, "", "   \n\t", "one", "one", "two words", "Two  WORDS", passage, prose(30) + " " + passage + " " + prose(10), passage + " " + passage, base, base, " ".join(near), "<|endoftext|> a  b\n\nc ▁ d", "x" * 3000, prose(6000), "😀 mail a.b@c.example, +49 (30) 123456789, 10.0.0.256 10.0.0.1 4111 1111 1111 1111!", "1.2.3.4.5.6.7.8 a@b@c.de +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "4111-1111-1111-1111 00411111 1111111119", prose(200) + " mail z@y.example"]


@pytest.fixture(scope="module")
def rows():
    return [(i * 3 + 1, t) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in CLASHING)).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_sentencepiece(spark, docs, rows, empty):
    import sentencepiece

    path = sentencepiece_viterbi.model_file()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepiece_viterbi.encode(docs, path)
    assert {k: v[0] for k, v in by_id(got, "ids").items()} == {i: sp.encode(t or "") for i, t in rows}
    assert {k: v[0] for k, v in by_id(sentencepiece_viterbi.decode(got, path), "text").items()} == {i: (t or "").replace("▁", " ") for i, t in rows}
    assert sentencepiece_viterbi.encode(empty, path).count() == 0
    codec = sentencepiece_viterbi.codec(open(path, "rb").read())
    assert codec.encode("x" * 5000 + "一二三四" * 3000) and all(len(p) <= sentencepiece_viterbi.KEPT for p in codec.known)
    search = sentencepiece_viterbi.StreamingViterbi(codec.m)
    for part in ["▁the▁quick▁brown▁fox▁jumps"] * 400:
        search.feed(part)
    assert search.peak < 2000  # the window does not grow with the text


def test_pii(spark, docs, rows, empty):
    path = tempfile.mkdtemp(prefix="spark-")
    docs.write.parquet(f"{path}/documents.parquet")
    found = by_id(pii.op2_pii(spark, path), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for i, t in rows:
        assert found[i][:5] == pii.brute_force(t), t
        places = [s.split(":") for s in found[i][5].split(",") if s]
        assert all(0 <= int(a) < int(b) <= len(t) for _, a, b in places) and places == sorted(places, key=lambda s: (int(s[1]), pii.KINDS.index(s[0])))
        base = ",".join(":".join(s) for s in places if s[0] != "term")
        assert __import__("hashlib").sha256(base.encode()).hexdigest() == found[i][4]
        for kind, a, b in places:
            assert {"email": "@", "ip": ".", "phone": "+"}.get(kind, "") in t[int(a) : int(b)]
    assert pii.find_personal_data(empty).count() == 0
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    shown = by_id(clean, "text")
    assert shown[1][0] is None and "c.example" not in shown[rows[16][0]][0] and "[EMAIL]" in shown[rows[16][0]][0]


def test_pii_is_linear_in_matches(spark):
    rng = random.Random(1)
    many = " ".join(f"10.{rng.randint(0, 255)}.0.{k % 256}" if k % 3 else f"é u{k}@mail.example" for k in range(40_000))
    began = time.time()
    table = spark.createDataFrame([(1, many), (2, "x@y.example " + "word " * 50_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_personal_data(table).select("doc_id", F.size("base").alias("n"), F.get("base", F.lit(39_999)).alias("last")).collect()}
    assert got[1]["n"] == 40_000 and many[got[1]["last"]["start"] : got[1]["last"]["end"]] == got[1]["last"]["value"]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table).collect()}
    assert clean[1].count("[IP]") + clean[1].count("[EMAIL]") == 40_000 and "@" not in clean[1] and clean[2].count("[TERM]") == 50_000
    assert time.time() - began < 120


def test_pii_levels_equal_all_pairs(spark):
    """Each term of a document against each entity of it, one by one."""
    import math

    rng = random.Random(6)
    terms, people = [f"term{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)], [f"p{k}@x.example" for k in range(12)]
    rows = []
    for k in range(70):
        who = rng.sample(people, rng.choice([0, 0, 1, 1, 2, 5])) + [f"only{k}@x.example"] * rng.choice([0, 0, 0, 1])
        signed = [f"sig{chr(97 + people.index(w)) * 3}" for w in who if w in people and rng.random() < 0.95]
        rows.append((k, " ".join(rng.sample(terms, rng.randint(0, 12)) + signed + who)))
    rows += rows[:3] + [(100, rows[5][1])]
    n, docs_of_term, docs_of_entity, both = len(rows), {}, {}, {}
    parsed = [(i, set(t for t in text.split() if "@" not in t), set(t for t in text.split() if "@" in t), text) for i, text in rows]
    for _, ts, es, _ in parsed:
        for t in ts:
            docs_of_term[t] = docs_of_term.get(t, 0) + 1
        for e in es:
            docs_of_entity[e] = docs_of_entity.get(e, 0) + 1
            for t in ts:
                both[e, t] = both.get((e, t), 0) + 1
    share = lambda e, t: math.log2(both[e, t] * n / (docs_of_entity[e] * docs_of_term[t])) / math.log2(n / docs_of_entity[e])
    level = lambda ts, es: {t: max(2 if share(e, t) >= pii.REMOVE else 1 if share(e, t) >= pii.GENERALISE else 0 for e in es) for t in ts if es}
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(found) == n
    texts, wanted = {i: x for i, _, _, x in parsed}, {i: {t: v for t, v in level(ts, es).items() if v} for i, ts, es, _ in parsed}
    for r in found:
        text = texts[r["doc_id"]]
        assert {text[s["start"] : s["end"]]: s["level"] for s in r["terms"]} == wanted[r["doc_id"]]
    assert len({v for w in wanted.values() for v in w.values()}) == 2


def test_pii_is_linear_in_entities_and_terms(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: "".join(letters[k // 26**j % 26] for j in range(4))
    many = " ".join(f"u{k}@mail.example {word(k)}" for k in range(40_000))
    table = spark.createDataFrame([(0, many), *[(k, f"plain {word(k)} text") for k in range(1, 31)]], "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["n"] for r in pii.find_personal_data(table).select("doc_id", F.size("terms").alias("n")).collect()}
    assert time.time() - began < 90  # 1.6 thousand million pairs would take hours
    assert got[0] >= 39_900 and got[1] == 0


def test_pii_disclosing_terms(spark):
    people = ["zara", "quin", "bork", "vend", "holm"]
    rows = [(k * 10 + j, f"Write to agent{name} at {name}@firm.example for the common offer {j}") for k, name in enumerate(people) for j in range(4)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    for r in found.collect():
        text = dict(rows)[r["doc_id"]]
        assert {text[s["start"] : s["end"]] for s in r["terms"]} == {f"agent{people[r['doc_id'] // 10]}"}
        assert all(s["level"] == 2 for s in r["terms"])
    assert "[TERM]" in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).first()["text"]


def test_pii_terms_of_rare_entities_everywhere(spark):
    far = " ".join(["common words of every text"] * 20)
    rows = [(k, f"{far} and more of it, number {k}") for k in range(40)]
    rows += [(100, f"Zarkov wrote from z@firm.example. {far} Then ZARKOV left, zarkov said."), (101, f"mail two@firm.example {far} about Quillon"), (101, f"mail two@firm.example {far} about Quillon"), (102, f"{far} two@firm.example: quillon, Quillon")]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))
    texts_ = dict(rows)
    got = {r["doc_id"]: [(texts_[r["doc_id"]][s["start"] : s["end"]], s["level"]) for s in r["terms"]] for r in found.collect()}
    n = len(rows)
    want = {}
    words = {i: [w for w in __import__("re").findall(r"[A-Za-z]{3,}", __import__("re").sub(r"\S+@[a-z.]+[a-z]", " ", t))] for i, t in rows}
    count = lambda w: sum(w in {x.lower() for x in words[i]} for i, _ in rows)
    for i, c in ((100, {100: 1}), (101, {101: 2, 102: 1}), (102, {101: 2, 102: 1})):
        n_c, want[i] = sum(c.values()), []
        for w in words[i]:
            n_ct = sum(k for d, k in c.items() if w.lower() in {x.lower() for x in words[d]})
            share = math.log2(n_ct * n / (n_c * count(w.lower()))) / math.log2(n / n_c)
            if share >= 0.8:
                want[i].append((w, 2 if share >= 0.95 else 1))
    assert {i: v for i, v in got.items() if v} == want
    assert [w for w, _ in want[100]] == ["Zarkov", "wrote", "from", "Then", "ZARKOV", "left", "zarkov", "said"] and want[102].count(("quillon", 2)) == 1
    clean = by_id(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")), "text")
    assert "arkov" not in clean[100][0].lower() and "uillon" not in (clean[101][0] + clean[102][0]).lower()


def test_pii_overlapping_spans_leave_nothing(spark):
    rows = [(1, "4111 1111 1111 1111.jo@x.fr"), (2, "see +49 30 1234567-jo@x.fr now"), (3, "é +49 30 1234567, 4111 1111 1111 1111, a@b.de")]
    clean = by_id(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")), "text")
    assert clean[1][0] == "[CARD]" and "[PHONE]" in clean[2][0]
    for text, in clean.values():
        assert "@" not in text and not any(ch.isdigit() for ch in text)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_decontamination(spark, docs, rows, empty, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    passage = rows[7][1].split()
    items = [(1, " ".join(passage[5:30])), (2, "One"), (3, None), (4, "!!"), (5, "two words"), (5, "two words"), (6, "words not there at all in any text of this little fixture")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    sha = lambda x: __import__("hashlib").sha256(",".join(x).encode()).hexdigest()
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), sha(r["items"]), r["n_hit"] > 0) for r in decontaminate.contamination(docs, table).collect()}
    assert got == decontaminate.brute_force(rows, items)
    assert decontaminate.contamination(empty, table).count() == 0
    assert {r["n_hit"] for r in decontaminate.contamination(docs, table.limit(0)).collect()} == {0}


def vectors(n=600, d=12, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, d))
    v[: n // 3] = v[0]  # a third of all rows are one vector
    v[n // 3 : n // 2] = v[n // 3] + 0.02 * rng.normal(size=(n // 2 - n // 3, d))
    v[-40:] *= 50
    rows = [(i, [float(np.float32(x)) for x in v[i]]) for i in range(n)]
    return [*rows, (20 * n, None), (20 * n + 20, [1.0, None]), (20 * n + 40, [math.nan] * d), (20 * n + 60, [math.inf] * d), (None, [1.0] * d), (40 * n, [0.0] * d), (40 * n + 1, [])]


def test_topk(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *(F.lit(1).alias(c) for c in ("row", "block", "length", "v")))
    got = topk_search.top_k(df, F.col("vec_id") % 20 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == topk_search.brute_force(rows)
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk_search, "LANE_BLOCKS", 3)
    monkeypatch.setattr(topk_search, "LEAST_QUERY_ROWS", 8)
    rows = vectors(300, 6, 9)
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == topk_search.brute_force(rows)


def test_topk_searcher_bounds_are_sound():
    rng = np.random.default_rng(12)
    for trial in range(60):
        d, n = int(rng.integers(2, 13)), 240
        v = np.floor(64 * rng.normal(size=(n, d)) * rng.choice([0.3, 1, 4], size=(n, 1))).astype(np.int64)
        v[::3, 1:] = np.floor(rng.normal(size=v[::3, 1:].shape) * 3)  # close to an axis
        v[1::5] *= rng.random(v[1::5].shape) < 0.3  # sparse
        if trial == 0:
            axis = np.r_[np.full(30, 900), np.full(30, 970)]
            v = np.stack([axis * np.cos(np.r_[np.full(30, 0.35), np.zeros(30)]), axis * np.sin(np.r_[np.full(30, 0.35), np.zeros(30)]), np.zeros(60)], 1).astype(np.int64)
            v, n = np.r_[[[900, 0, 0]], v], 61
        length = np.sqrt((v.astype(float) ** 2).sum(1))
        s = topk_search.Searcher(np.arange(n), np.arange(n), v, length, 20)
        for block in np.array_split(np.argsort(-length, kind="stable"), 8):
            s.meet(block, block, v[block], length[block])
        score = v @ v.T
        got = {}
        for r in s.hits().to_pylist():
            got.setdefault(r["row"], []).append((-r["score"], r["vec_id"]))
        for q in range(n):
            assert sorted(got[q])[:20] == sorted((-int(score[q, j]), j) for j in range(n) if j != q)[:20], (trial, q)


def test_topk_wide_vectors_and_pruned_lanes(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_BYTES", 8 * 300 * 12)
    monkeypatch.setattr(topk_search, "LANE_BLOCKS", 2)
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=300) * rng.choice([0.01, 1, 30, 2.0**18])).tolist()) for i in range(120)]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == topk_search.brute_force(rows)


def test_simhash(spark, docs, rows, empty):
    got = {k: (f"{v[0] & (2**64 - 1):016x}", v[1]) for k, v in by_id(simhash.simhash_components(docs), "fp", "component_id").items()}
    assert got == simhash.brute_force(rows)
    assert simhash.simhash_components(empty).count() == 0


def test_golay_keys_lose_no_link():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for keys, bits in ((simhash.golay_keys, 2),):
        b = a.copy()
        for _ in range(bits):
            b ^= np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64)
        x, y = keys(a), keys(b)
        assert all(set(p[p >= 0].tolist()) & set(q[q >= 0].tolist()) for p, q in zip(x, y, strict=True))


def test_simhash_groups_and_chains(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(300)]
    rows = []
    for k in range(120):
        t = list(base)
        t[rng.randrange(300)] = word()
        rows.append((k, " ".join(t)))
    rows += [(1000 + k, " ".join(word() for _ in range(50))) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {k: (f"{v[0] & (2**64 - 1):016x}", v[1]) for k, v in by_id(simhash.simhash_components(df), "fp", "component_id").items()}
    assert got == simhash.brute_force(rows)
    near = {k: v[0] for k, v in by_id(near_copies.near_copies(df), "component_id").items()}
    assert sum(near[k] == 0 for k in range(120)) >= 118 and all(near[1000 + k] == 1000 + k for k in range(30))


def test_near_copies_are_those_of_similarity(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    texts_ = []
    for _ in range(12):
        base = [word() for _ in range(100)]
        texts_ += [base, base + [word() for _ in range(23)], base + [word() for _ in range(27)], base[:81], base[:75], [word() for _ in range(4)] + base]
        texts_ += [[*base[:50], *(word() for _ in range(k)), *base[50 + k :]] for k in (1, 3, 6, 8, 12)]
    rows = list(enumerate([*(" ".join(t) for t in texts_), "", None, "a b", "A  b", "a b c"]))
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(len(w) - 5, 0) + 1)} if (w := (t or "").lower().split()) else set() for i, t in rows}
    want = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((want[i], want[j]))
                want = {k: a if v == b else v for k, v in want.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {k: v[0] for k, v in by_id(near_copies.near_copies(df), "component_id").items()} == want
    monkeypatch.setattr(near_copies, "RUN_ROWS", 4)
    gone = {i for i, c in want.items() if i != c}
    table = df.select("*", F.lit("en").alias("lang"))
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, table, "").collect()} == set(sets) - gone


def test_near_copies_exact_way_and_lanes(spark, monkeypatch):
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    common, rows = [word() for _ in range(330)], []
    for i in range(110):  # one long passage, changed here and there: similarities on both sides of 0.8
        w = list(common)
        for at in rng.sample(range(330), rng.randint(0, 13)):
            w[at] = word()
        rows.append((i, " ".join(w + [word() for _ in range(rng.choice((0, 0, 30, 90)))])))
    rows += [(200 + i, " ".join(common[:40] + [word() for _ in range(40)])) for i in range(20)] + [(300, ""), (301, None), (302, "a")]
    sets = {i: frozenset(" ".join(w[k : k + 5]) for k in range(max(len(w) - 5, 0) + 1)) if (w := (t or "").split()) else frozenset() for i, t in rows}
    want = {i: i for i in sets}
    for i in sets:
        for j in (j for j in sets if j < i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((want[i], want[j]))
                want = {k: a if v == b else v for k, v in want.items()}
    assert 20 < sum(want[i] == i for i in range(110)) < 100  # some join, many stay apart
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    both = ({}, {"keys": None, "sigmas": None})
    for options in both:
        assert {k: v[0] for k, v in by_id(near_copies.near_copies(df, **options), "component_id").items()} == want
    given, linked = [], near_copies._linked
    monkeypatch.setattr(near_copies, "_linked", lambda keyed, shingle: given.append(linked(keyed, shingle).count()) or linked(keyed, shingle))
    for name, value in (("RUN_ROWS", 2), ("LANE_ROWS", 16), ("LANE_SHINGLES", 9000), ("EARLY", 3), ("SKETCH", 64)):
        monkeypatch.setattr(near_copies, name, value)
    for options in both:
        assert {k: v[0] for k, v in by_id(near_copies.near_copies(df, **options), "component_id").items()} == want
    assert len(given) == 2 and all(n < 20 * len(rows) for n in given)  # not the pairs of a group


def test_suffix_dedup(spark, docs, rows, empty):
    for window in (200, 64):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), __import__("hashlib").sha256(r["kept"]).hexdigest()) for r in suffix_dedup.byte_repeats(docs, window).collect()}
        assert got == suffix_dedup.brute_force(rows, window)
    assert suffix_dedup.byte_repeats(empty).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n, k in ((1, 2), (50, 2), (400, 3), (300, 250)):
        t = np.r_[rng.integers(1, k + 1, n), 0].astype(np.uint8)
        raw = t.tobytes()
        assert suffix_array.suffix_array(t).tolist() == sorted(range(n + 1), key=lambda i: raw[i:])


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["scum", "loweixxx", "moron"]
    rows, labels = [], []
    for i in range(600):
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    rows += [(9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in CLASHING))
    table = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(spark, docs, docs, table)
    got = {r["doc_id"]: r["is_toxic"] for r in out.collect()}
    assert len(got) == len(rows) and not got[9000] and not got[9001]
    held = [i for i in range(600) if i % 2]
    assert sum(got[i] == (i % 6 == 0) for i in held) >= 0.97 * len(held)
    assert not any(r["is_toxic"] for r in toxicity.toxicity(spark, docs, docs, table.limit(0)).limit(20).collect())


def test_lm_scoring(spark, docs, rows, empty):
    small = [(i, (t or "")[:400] if t is not None else None) for i, t in rows]
    got = by_id(lm_scoring.score(spark.createDataFrame(small, "doc_id long, text string")), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for i, want in lm_scoring.brute_force(small).items():
        assert got[i][:4] == want[:4]
        assert got[i][4] == pytest.approx(want[4], rel=1e-9) and got[i][5] == pytest.approx(want[5], rel=1e-9)
    assert lm_scoring.score(empty).count() == 0
    assert lm_scoring.score(docs).count() == len(rows)


def test_substring_dedup(spark, docs, rows, empty):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], __import__("hashlib").sha256(r["kept"].encode()).hexdigest()) for r in substring_dedup.substring_repeats(docs).collect()}
    assert got == substring_dedup.brute_force(rows)
    assert substring_dedup.substring_repeats(empty).count() == 0


def test_substring_dedup_of_hard_cases(spark):
    thue = "a"
    for _ in range(11):
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))  # equal to the first in any sum of powers of an odd base modulo 2**64
    rng = random.Random(6)
    tail = " ".join(f"w{rng.random()}" for _ in range(12))
    rows = [(1, f"{thue} {tail}"), (2, f"{other} {tail}"), (3, f"{thue} {tail}")]
    few = ["a", "b", "c"]  # few words: many anchors, many surroundings
    rows += [(10 + k, " ".join(rng.choice(few) for _ in range(rng.randint(1, 400)))) for k in range(40)]
    big = [f"x{rng.randint(0, 200_000)}" for _ in range(200_000)]  # over a megabyte
    rows += [(100, " ".join(big)), (99, " ".join(big[1000:1030] + ["."] + big[-14:])), (101, " ".join(big[77_000:77_012])), (None, " ".join(big[5:20])), (102, " ".join(big[:40])), (102, " ".join(big[:40]))]
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"], __import__("hashlib").sha256(r["kept"].encode()).hexdigest()) for r in substring_dedup.substring_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    want = substring_dedup.brute_force([(i if i is not None else -1, t) for i, t in rows])
    assert got == sorted([*((i, *v) for i, v in want.items()), (102, *want[102])])
    assert want[2][1] == 0 and want[3][1] == 13


def test_token_output(spark, docs, rows, empty):
    import public_tokenizers

    from newsloom.llm import common as C

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = C.new_path(spark, "tokens")
    token_output.write_tokens(docs, tokenizer, path)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_output.document_places(spark, path).collect())
    assert got == token_output.brute_force(rows, tokenizer)
    ids = {i: [*token_output.encoder(open(tokenizer, encoding="utf-8").read()).tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    asked = [2, 11, 220, 60_000]
    assert {r["token"]: r["n"] for r in token_output.count_tokens(spark, path, asked).collect()} == {k: sum(x.count(k) for x in ids.values()) for k in asked}
    places = sorted((r["token"], r["doc_id"], r["place"]) for r in token_output.token_occurrences(spark, path, asked).collect())
    assert places == sorted((k, i, n) for k in asked for i, x in ids.items() for n, y in enumerate(x) if y == k)
    path = C.new_path(spark, "tokens")
    token_output.write_tokens(empty, tokenizer, path)
    assert token_output.document_places(spark, path).count() == 0


def test_byte_level_encoder_equals_the_library(monkeypatch):
    import json

    import public_tokenizers

    spec = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
    rng = random.Random(3)
    bits = ["the", "don't", "I'LL", "é", "naïve", "中文字", "١٢", "²½", "Ⅷ", "e\u0301", "\x1c", "\x85", "\u00a0", "\u200b", "a_b", "x" * 90, "'s", "12ab", "--", "…", "\n", "\t", "\r\n", "\u2028", "Ġ", "👩‍👩‍👧", "<|endoftext|>", "ß", "\x00", "़", "a\u3000b", "\ufeff"]
    texts_ = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", " ", "  ", "\n", ","]) for _ in range(rng.randint(1, 30))) for _ in range(3000)] + [b + " " + c + " z" for b in bits for c in bits]
    e = token_output.ByteLevelEncoder(spec)
    texts_ += ["", " ", "a", " a", "a "]
    want = [[*x.ids, 2] for x in e.tokenizer.encode_batch(texts_, add_special_tokens=False)]

    def ids(encoder, some):
        flat, sizes = encoder.encode(pa.array(some, pa.string()), 2)
        return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]

    assert e.known_kind and ids(e, texts_) == want
    monkeypatch.setattr(token_output, "KEPT_CHARACTERS", 200)
    e = token_output.ByteLevelEncoder(spec)
    assert [x for k in range(0, len(texts_), 50) for x in ids(e, texts_[k : k + 50])] == want
    other = json.loads(spec)
    other["pre_tokenizer"]["add_prefix_space"] = True
    e = token_output.ByteLevelEncoder(json.dumps(other))
    assert not e.known_kind and ids(e, ["a b", " c"]) == [[*e.tokenizer.encode(t).ids, 2] for t in ("a b", " c")]


def test_wavelet_matrix():
    ids = np.random.default_rng(0).integers(0, 50_000, 3000).astype(np.uint32)
    ids[::7] = 2
    m = WaveletMatrix.from_record(WaveletMatrix.build(ids).to_record())
    assert (m.decode() == ids).all() and (m.access([0, 5, 2999]) == ids[[0, 5, 2999]]).all()
    assert m.count(2) == int((ids == 2).sum()) and m.count(2, 10, 500) == int((ids[10:500] == 2).sum()) and m.count(60_000) == 0
    assert (m.occurrences(2) == np.flatnonzero(ids == 2)).all()


def test_repeated_rows(spark, docs, rows):
    twice = docs.unionByName(docs)
    assert decontaminate.contamination(twice, spark.createDataFrame([(1, "two words")], "item_id long, text string")).count() == 2 * len(rows)
    for f in (suffix_dedup.byte_repeats, substring_dedup.substring_repeats, simhash.simhash_components, lm_scoring.score, pii.find_personal_data):
        assert f(twice).count() == 2 * len(rows), f


def test_pipeline_stages(spark, docs, rows):
    table = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    near = corpus_pipeline.drop_near_copies(spark, table, "")
    kept = {r["doc_id"] for r in near.collect()}
    assert near.columns == table.columns
    assert {rows[0][0], rows[3][0], rows[10][0]} <= kept and not {rows[1][0], rows[2][0], rows[4][0], rows[11][0], rows[12][0]} & kept
    clean = corpus_pipeline.sanitise_personal_data(spark, near, "")
    assert clean.columns == table.columns and all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in clean.collect())
    out = corpus_pipeline.encode_tokens(spark, clean, "").collect()
    assert {r["doc_id"] for r in out} == kept and all(r["n_tokens"] == len(r["ids"]) for r in out)
    assert zlib.crc32(b"") == 0
