"""Packing and conversation repair against brute force, over hard rows and over empty tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import conversations, packing

CLASHING = ("n", "text_", "part", "nth", "seg", "told", "of", "first", "later", "hash_", "conv_", "harm", "piece", "length", "start", "sequence_id")


def test_best_two_fit_by_counts():
    rng = random.Random(3)
    for _ in range(150):
        most = rng.choice([5, 17, 64, 1024])
        lengths = [rng.randint(1, rng.choice([most, max(1, most // 3)])) for _ in range(rng.randint(0, 120))]
        counts = np.bincount(np.array(lengths, np.int64), minlength=most + 1)
        plan = packing.best_two_fit(counts, most)
        bins = [sorted(b, reverse=True) for n, b in plan for _ in range(n)]
        assert bins == [sorted(b, reverse=True) for b in packing.brute_force(lengths, most)]
        places, found = packing.Places(plan), {}
        for size in set(lengths):
            sequence, offset = places(np.full(counts[size], size), np.arange(counts[size]))
            for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
                found.setdefault(s, []).append((o, size))
        assert len(found) == places.sequences == len(bins)
        for parts in found.values():
            ends = np.cumsum([0] + [size for _, size in sorted(parts)]).tolist()
            assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= most


def test_two_that_fit_better_replace_the_shortest():
    counts = np.zeros(11, int)
    counts[[6, 3, 2]] = 1, 1, 2  # 6 + 3 leaves one token; 2 + 2 in place of 3 leaves none
    assert packing.best_two_fit(counts, 10) == [(1, [6, 2, 2]), (1, [3])]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_packing(spark, tokenizer):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdeéñ'.😀") for _ in range(rng.randint(1, 7))) for _ in range(n))
    rows = [(None, "no id"), (1, None), (2, ""), (3, "  \n"), (3, "same id"), (4, "word " * 30000), *[(k, prose(rng.randint(1, 900))) for k in range(5, 60)], *[(99, "a copy of many")] * 700]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in CLASHING)).repartition(5)
    packed = packing.pack(docs, tokenizer)
    got = packed.collect()
    t, by_doc = Tokenizer.from_file(tokenizer), {}
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], bytes(r["ids"])))
    wanted = {}
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        wanted.setdefault(i, []).extend((k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in wanted.items()}
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        ends = np.cumsum([0] + [n for _, n in sorted(parts)]).tolist()
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
    assert len(bins) == len(packing.brute_force([r["length"] for r in got]))
    for r in packing.sequences(packed).limit(20).collect():
        assert len(r["ids"]) == 4 * sum(p["length"] for p in r["pieces"])
    assert packing.pack(docs.limit(0), tokenizer).count() == 0


def hard_turns():
    rng = random.Random(11)
    rows = [(None, 1, "user", "no conversation."), (None, None, "user", "x"), (7000, None, None, None), (7001, None, "user", "Same turn."), (7001, None, "user", "Same turn."), (7001, None, "user", "Other."), (7002, 1, "", "No role."), (7003, 5, "User", "Case."), (7004, 1, "user", "long " * 200_000 + ".")]
    texts = ["Yes.", "No!", "", " \t\n", "cut off", "Why?", "é", "Ends. \x0b", " nbsp.", "😀"]
    for c in range(400):
        for turn in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([None, turn, turn, turn, turn * 3]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "ai"]), rng.choice(texts) + rng.choice(["", str(turn)])))
    for turn in range(40):  # one long conversation
        rows.append((9000, turn, rng.choice(["user", "assistant", "system"]), rng.choice(texts) + str(turn)))
    return rows


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(hard_turns(), "conv_id long, turn long, role string, text string").select("*", *(F.lit("x").alias(c) for c in CLASHING)).repartition(3)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_conversation_repair(spark, turns, tmp_path):
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conversations.op12_conversation_repair(spark, str(tmp_path)).collect()}
    wanted = {r[0]: r for r in conversations.brute_force(hard_turns())}
    assert set(got) == set(wanted)
    assert [(got[k], wanted[k]) for k in wanted if got[k] != wanted[k]] == []
    assert len({r[6] for r in got.values()}) > 8  # many costs occur
    turns.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert conversations.op12_conversation_repair(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("most", [1, 3])
def test_repair_across_tasks_and_segments(spark, turns, most):
    whole = conversations.repair(conversations.damaged(turns))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = conversations.repair(conversations.damaged(turns), most)
        assert cut.made.where("tail > 0").count() and cut.made.groupBy("conv_id").count().where("count > 10").count()
        assert cut.conversations().exceptAll(whole.conversations()).count() == 0
        assert cut.repaired().exceptAll(whole.repaired()).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repaired_turns_are_lawful(turns):
    found = conversations.repair(conversations.turns_of(turns)).repaired()
    for r in found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "role"))).alias("p")).collect():
        initials = "".join(p["role"][:1] for p in r["p"])
        assert __import__("re").fullmatch("(s?(ua)+)?", initials) and [p["place"] for p in r["p"]] == list(range(len(r["p"])))


def test_blank_words_are_found_without_a_look_at_each():
    """A word that begins with any white space sends its text to the library whole; the words are not asked one by one in Python."""
    import ast
    import inspect
    import textwrap

    import public_tokenizers
    import pyarrow as pa

    from newsloom.llm.token_output import ByteLevelEncoder

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = ByteLevelEncoder(f.read())
    blanks = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    texts = ["", " ", *(f"one {b}two  three{b} {b}" for b in blanks), "a b", "\u200bone \u200btwo"]
    ids, sizes = encoder.encode(pa.array(texts), 2)
    assert ids.tolist() == [x for t in texts for x in [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 2]] and len(sizes) == len(texts)
    calls = ast.walk(ast.parse(textwrap.dedent(inspect.getsource(ByteLevelEncoder.encode))))
    assert not any(isinstance(c, ast.Attribute) and c.attr == "isspace" for c in calls)
