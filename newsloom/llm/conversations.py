"""Repair of conversation structure: which turns to keep, rerole, delete or insert at the least cost.

A repaired conversation is empty, or an optional system turn and then user and assistant in turn. Kept turns cost nothing,
reroled ones 3, deleted ones 4, inserted empty ones 3; a truncated turn that stays adds 3; blank turns and repeats must go.

The method is a dynamic programme over the retained turns. For each retained turn and role, the next retained one is either
as near or as far as pays: prefix sums of deletions and a running minimum for each role price all gaps at once, and the two
roles on either side of a gap settle what is inserted. Of equal costs the edits that read first in ASCII win (D, I, K, R):
the gap with most deletions, then more inserts, then a kept turn before a reroled one.

Turns are dealt by ranges of (conversation, turn), so that a conversation of any length spreads over tasks. A task packs the
turns that it sees into segments of two bytes a turn; of a conversation that crosses tasks each segment is first told as a
four-by-four table of costs (role before it by role after it), the tables are chained backwards and the roles forwards,
and then every segment settles its own edits. Texts are read in order once, at the end; only the hash of a repaired text
runs through one task, as such a hash must, without holding the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SEGMENT_TURNS = 32_768
START, SYSTEM, USER, ASSISTANT = range(4)
_INF = 1 << 60
# inserted turns between a role and the next retained one, and after the last
_BETWEEN = ((_INF, 0, 0, 1), (_INF, _INF, 0, 1), (_INF, _INF, 1, 0), (_INF, _INF, 0, 1))
_AFTER = (0, 2, 1, 0)
_FINAL = tuple(INSERT * n for n in _AFTER)
SOUND, SHORT, FAULTY = range(3)  # may stay, may stay at a price, must go
_DROPPED, _KEPT, _REROLED, _INSERT, _ASSISTANT = 0, 1, 2, 4, 8  # what happens to a turn, as a byte


class Segment(NamedTuple):
    """Turns in order: role, fault, and how many equal rows each stands for, of which the first alone may stay."""

    roles: list[int]
    faults: list[int]
    copies: list[int]


class Paths:
    """Least costs from each role before a segment, and the next retained turn of each retained one."""

    def __init__(self, segment: Segment, right: tuple[int, ...]):
        self.segment = segment
        roles, faults, copies = segment
        self.deleted = [0]
        for n in copies:
            self.deleted.append(self.deleted[-1] + DELETE * n)
        stop = [self.deleted[-1] + c for c in right]
        best, at = [_INF] * 4, [0] * 4  # for each role, over the turns seen so far from the right
        self.next: list[dict[int, tuple[int, int] | None]] = [{} for _ in range(len(roles) + 1)]
        for i in range(len(roles), -1, -1):
            cost = {}
            open_ = (START, SYSTEM, USER, ASSISTANT) if not i else () if faults[i - 1] == FAULTY else (SYSTEM, USER, ASSISTANT) if roles[i - 1] == SYSTEM else (USER, ASSISTANT)
            for p in open_:
                by_role = [best[r] + INSERT * _BETWEEN[p][r] for r in (SYSTEM, USER, ASSISTANT)]
                least = min(stop[p], *by_role)
                cost[p] = least - self.deleted[i]
                if stop[p] == least:
                    self.next[i][p] = None
                else:
                    self.next[i][p] = max((at[r], _BETWEEN[p][r], roles[at[r] - 1] == r, r) for r, c in enumerate(by_role, SYSTEM) if c == least)[::3]
            if i:
                own = self.deleted[i - 1] + DELETE * (copies[i - 1] - 1) + (TRUNCATED if faults[i - 1] == SHORT else 0)
                for r, c in cost.items():
                    c += own + (0 if roles[i - 1] == r else REROLE)
                    if c < best[r]:  # of equal costs the farther turn, with more deletions ahead of it
                        best[r], at[r] = c, i
        self.cost = [min(cost[p], _INF) for p in (START, SYSTEM, USER, ASSISTANT)]

    def leave(self, p: int) -> int:
        """The role after the segment."""
        i = 0
        while (to := self.next[i][p]) is not None:
            i, p = to
        return p

    def edits(self, p: int) -> tuple[bytes, str]:
        """What happens to each turn, and the edits' initials."""
        acts, said, i = bytearray(len(self.segment.roles)), [], 0
        while (to := self.next[i][p]) is not None:
            j, r = to
            keeps = self.segment.roles[j - 1] == r
            said.append("D" * ((self.deleted[j - 1] - self.deleted[i]) // DELETE) + "I" * _BETWEEN[p][r] + ("K" if keeps else "R") + "D" * (self.segment.copies[j - 1] - 1))
            acts[j - 1] = (_KEPT if keeps else _REROLED) | (_INSERT if _BETWEEN[p][r] else 0) | (_ASSISTANT if r == ASSISTANT else 0)
            i, p = j, r
        said.append("D" * ((self.deleted[-1] - self.deleted[i]) // DELETE))
        return bytes(acts), "".join(said)


def _null_first(turn: Column) -> Column:
    return F.struct(turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("turn"))


def turns_of(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, hash_ and n for each row; null roles and texts are one space."""
    text = F.coalesce(F.col(text_col), F.lit(" "))
    n = F.lit(1) if copies is None else copies
    return rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), text.alias("text"), n.cast("long").alias("n")).withColumn("hash_", F.unhex(F.sha2("text", 256)))


def with_faults(turns: DataFrame) -> DataFrame:
    """One row for each distinct (conv_id, turn, role, text): n, blank, later (an equal role and text stands at an earlier turn), short.

    Equal rows are counted ahead of every shuffle, and the first turn of an equal role and text is a minimum, so that repeats of
    any number are split.
    """
    told = turns.withColumn("last", F.substring(F.rtrim("text", F.lit(" \t\n\v\f\r")), -1, 1))  # the last that is no white space
    rows = told.groupBy("conv_id", "turn", "role", "hash_").agg(F.sum("n").alias("n"), F.max(F.col("last") == "").alias("blank"), F.max(~F.col("last").isin(".", "!", "?")).alias("short"))
    rows = C.checkpoint(rows)
    first = rows.groupBy(F.col("conv_id").alias("conv_"), F.col("role").alias("role_"), F.col("hash_").alias("of_")).agg(F.min(_null_first(F.col("turn"))).alias("first"))
    same = rows["conv_id"].eqNullSafe(first["conv_"]) & (rows["role"] == first["role_"]) & (rows["hash_"] == first["of_"])
    return rows.join(first, same).withColumn("later", F.col("first") < _null_first(F.col("turn"))).drop("conv_", "role_", "of_", "first")


_SEGMENT = "conv_id long, seg long, crosses boolean, turn long, role string, hash_ binary, roles binary, faults binary, copies binary"
_SEGMENT_T = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("crosses", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("hash_", pa.binary()), ("roles", pa.binary()), ("faults", pa.binary()), ("copies", pa.binary())])


def segments(rows: DataFrame, most: int = SEGMENT_TURNS) -> DataFrame:
    """Each conversation's turns in order, packed; ``seg`` numbers the pieces in order, ``crosses`` marks those that may not be a whole conversation."""
    code = F.when(F.substring("role", 1, 1) == "s", SYSTEM).when(F.substring("role", 1, 1) == "u", USER).when(F.substring("role", 1, 1) == "a", ASSISTANT).otherwise(0)
    fault = F.when(F.col("blank") | F.col("later"), FAULTY).when(F.col("short"), SHORT).otherwise(SOUND)
    key = ("conv_id", "turn", "role", "hash_")
    ordered = rows.select(*key, code.alias("code"), fault.alias("fault"), "n").repartitionByRange(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, out, held, conv, opened = TaskContext.get().partitionId() << 32, [], [], None, True

        def packed(crosses: bool) -> None:
            at = held[0]
            codes, faults, copies = zip(*(h[3:] for h in held), strict=True)
            out.append({"conv_id": conv, "seg": base + packed.n, "crosses": crosses, "turn": at[0], "role": at[1], "hash_": at[2], "roles": bytes(codes), "faults": bytes(faults), "copies": np.array(copies, np.int64).tobytes() if max(copies) > 1 else b""})
            packed.n += 1
            held.clear()

        packed.n = 0
        for batch in batches:
            for c, *turn in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                if held and c != conv:
                    packed(opened)
                    opened = False  # all but a task's first conversation begin here
                elif len(held) == most:
                    packed(True)
                    opened = True
                conv = c
                held.append(turn)
            yield pa.RecordBatch.from_pylist(out, _SEGMENT_T)
            out.clear()
        if held:
            packed(True)
            yield pa.RecordBatch.from_pylist(out, _SEGMENT_T)

    return ordered.mapInArrow(run, _SEGMENT)


def _segment(r: dict) -> Segment:
    return Segment(list(r["roles"]), list(r["faults"]), np.frombuffer(r["copies"], np.int64).tolist() if r["copies"] else [1] * len(r["roles"]))


def _each(df: DataFrame, tell: Callable[[dict], dict], schema: str) -> DataFrame:
    """``tell`` for each row, in batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([tell(r) for r in batch.to_pylist()], types)

    return df.mapInArrow(run, schema)


def _chained(df: DataFrame, order: Column, first: tuple[int, ...] | int, step: Callable, name: str) -> DataFrame:
    """(seg, name) for each row: what the rows of its conversation ahead of it in that order have made of ``first``."""

    types, kind = (pa.list_(pa.int64()), "array<long>") if isinstance(first, tuple) else (pa.int64(), "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = object(), first
        for batch in batches:
            segs, states = [], []
            for r in batch.to_pylist():
                if r["conv_id"] != conv:
                    conv, state = r["conv_id"], first
                segs.append(r["seg"])
                states.append(state)
                state = step(r["told"], state)
            yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int64()), pa.array(states, types)], ["seg", name])

    return df.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(run, f"seg long, {name} {kind}")


def _table(segment: Segment) -> list[int]:
    """Least cost from each role before the segment (four) to each role after it."""
    by_after = [Paths(segment, tuple(0 if q == r else _INF for q in range(4))).cost for r in range(4)]
    return [by_after[r][p] for p in range(4) for r in range(4)]


def decided(segs: DataFrame) -> DataFrame:
    """For each segment: acts (a byte a turn), its part of the audit, cost from the role before it, that role and the one after it, tail, illegal pairs inside."""
    crossing = segs.where("crosses")
    tables = C.checkpoint(_each(crossing, lambda r: {"conv_id": r["conv_id"], "seg": r["seg"], "told": _table(_segment(r))}, "conv_id long, seg long, told array<long>"))
    right = _chained(tables, F.col("seg").desc(), _FINAL, lambda t, after: tuple(min(min(t[4 * p + r] + after[r] for r in range(4)), _INF) for p in range(4)), "after")
    right = C.checkpoint(right.withColumnRenamed("seg", "of"))
    leaving = _each(crossing.join(right, F.col("seg") == F.col("of")), lambda r: {"conv_id": r["conv_id"], "seg": r["seg"], "told": [Paths(_segment(r), tuple(r["after"])).leave(p) for p in range(4)]}, "conv_id long, seg long, told array<long>")
    entry = _chained(leaving, F.col("seg"), START, lambda t, p: t[p], "before").withColumnRenamed("seg", "from")
    # a conversation's last segment is the one that no other of it follows
    last = tables.groupBy("conv_id").agg(F.max("seg").alias("last"))
    known = right.join(entry, F.col("of") == F.col("from")).join(last.select("last"), F.col("of") == F.col("last"), "left").select("of", "after", "before", F.col("last").isNotNull().alias("ends"))
    whole = segs.join(known, F.col("seg") == F.col("of"), "left").drop("of")

    def tell(r: dict) -> dict:
        segment, entry = _segment(r), r["before"] or START
        paths = Paths(segment, tuple(r["after"] or _FINAL))
        acts, said = paths.edits(entry)
        tail = _AFTER[paths.leave(entry)] if r["ends"] is not False else 0
        pairs = zip(segment.roles, segment.roles[1:], strict=False)
        illegal = sum(n - 1 for n in segment.copies) + sum(p not in ((SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)) for p in pairs)
        return {k: r[k] for k in ("conv_id", "seg", "turn", "role", "hash_")} | {"acts": acts, "said": said + "I" * tail, "tail": tail, "cost": paths.cost[entry] if entry == START else None, "opens": segment.roles[0], "closes": segment.roles[-1], "illegal": illegal}

    return C.checkpoint(_each(whole, tell, "conv_id long, seg long, turn long, role string, hash_ binary, acts binary, said string, tail int, cost long, opens int, closes int, illegal long"))


class Repair(NamedTuple):
    """What was found and decided; ``conversations`` and ``turns`` tell it."""

    turns: DataFrame
    rows: DataFrame
    made: DataFrame

    def conversations(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation that has rows."""
        fresh = ~F.col("blank") & ~F.col("later")
        by_turn = self.rows.groupBy("conv_id", "turn").agg(F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"), F.sum(F.when(F.col("blank"), 0).when(F.col("later"), F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"), F.sum(F.when(fresh & F.col("short"), 1).otherwise(0)).alias("truncated"))
        counts = by_turn.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")))
        parts = self.made.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "said", "opens", "closes"))).alias("p"), F.sum("illegal").alias("inside"), F.min_by("cost", "seg").alias("cost"))
        pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: a["closes"] * 4 + b["opens"])
        between = F.size(F.filter(pairs, lambda x: ~x.isin(SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER)))
        edits = parts.select("conv_id", (F.col("inside") + between).alias("illegal"), "cost", F.array_join(F.transform("p", lambda x: x["said"]), "").alias("audit"))
        frames = [counts, edits, self._replayed(_digests, "conv_id long, repaired_sha256 string")]
        # by union, so that the conversation without an id meets itself and each one is met once
        names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
        some = [f.select("conv_id", *(F.col(n) if n in f.columns else F.lit(None).alias(n) for n in names)) for f in frames]
        return some[0].unionByName(some[1]).unionByName(some[2]).groupBy("conv_id").agg(*(F.max(n).alias(n) for n in names))

    def repaired(self) -> DataFrame:
        """conv_id, place (from 0), role, text, edit (K, R or I) of each turn of the repaired conversations."""
        return self._replayed(_rows, "conv_id long, place long, role string, text string, edit string")

    def _replayed(self, tell: Callable, schema: str) -> DataFrame:
        key = ("conv_id", "turn", "role", "hash_")
        texts = self.turns.where("n > 0").select(*key, F.lit(1).alias("kind"), "text", F.lit(None).cast("binary").alias("acts"), F.lit(None).cast("int").alias("tail"))
        acts = self.made.select(*key, F.lit(0).alias("kind"), F.lit(None).cast("string").alias("text"), "acts", "tail")
        both = texts.unionByName(acts).repartition("conv_id").sortWithinPartitions(*key, "kind")
        return both.mapInArrow(lambda batches: tell(_replay(batches)), schema)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """(conv_id, place, role, text, edit) of the repaired turns, a batch at a time; place -1 tells that a conversation has ended."""
    conv, before, acts, at, tail, place = object(), None, b"", 0, 0, 0
    for batch in batches:
        out = []
        texts = batch.column("text")
        for k, (c, turn, role, h, kind, a, t) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "hash_", "kind", "acts", "tail")), strict=True)):
            if c != conv:
                if acts:
                    out += _tail(conv, place, tail)
                conv, before, place, tail = c, None, 0, 0
            if kind == 0:
                acts, at, tail = a, 0, t
                continue
            if (turn, role, h) == before:
                continue  # an equal row of the same turn
            before, act = (turn, role, h), acts[at]
            at += 1
            if act == _DROPPED:
                continue
            later = act & _ASSISTANT
            if act & _INSERT:
                out.append((c, place, "user" if later else "assistant", "", "I"))
                place += 1
            out.append((c, place, role if act & _KEPT else "assistant" if later else "user", texts[k].as_py(), "K" if act & _KEPT else "R"))
            place += 1
        yield out
    if acts:
        yield _tail(conv, place, tail)


def _tail(conv: int | None, place: int, n: int) -> list[tuple]:
    roles = ("user", "assistant")[2 - n :]
    return [(conv, place + k, r, "", "I") for k, r in enumerate(roles)] + [(conv, -1, "", "", "")]


def _rows(found: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
    types = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    for some in found:
        yield pa.RecordBatch.from_pylist([dict(zip(types.names, r, strict=True)) for r in some if r[1] >= 0], types)


def _digests(found: Iterator[list[tuple]]) -> Iterator[pa.RecordBatch]:
    sha = hashlib.sha256()
    for some in found:
        ids, told = [], []
        for conv, place, role, text, _ in some:
            if place < 0:
                ids.append(conv)
                told.append(sha.hexdigest())
                sha = hashlib.sha256()
            else:
                sha.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(told, pa.string())], ["conv_id", "repaired_sha256"])


def repair(turns: DataFrame, segment_turns: int = SEGMENT_TURNS) -> Repair:
    """Find the faults of conversations and the cheapest repair of each, ``turns`` being rows of ``turns_of``.

    Turns go by number, nulls first, and turns of one number by role and the SHA-256 of their text; rows equal in all of these
    are repeats. Null conversation ids are one conversation. Rows with n = 0 do not exist. An empty table gives empty results.
    """
    rows = C.checkpoint(with_faults(turns.where("n > 0")))
    return Repair(turns, rows, decided(C.checkpoint(segments(rows, segment_turns))))


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with one row in four harmed, by the checksum of its place: dropped (n = 0), emptied, unpunctuated, repeated (n = 2) or said by the user."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    harm = F.crc32(name.cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    harmed = rows.select("conv_id", "turn", F.when(harm == 4, "user").otherwise(role).alias("role"), F.when(harm == 1, "").when(harm == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), harm.alias("harm"))
    return turns_of(harmed, copies=F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = C.read_table(spark, sf_dir, "conversations")
    found = repair(damaged(original)).conversations()
    every = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    nothing = hashlib.sha256().hexdigest()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    all_ = every.select("conv_id", *(F.lit(None).alias(c) for c in (*counts, "audit", "repaired_sha256"))).unionByName(found)
    return all_.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256"))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The whole contract for rows (conv_id, turn, role, text), one edit at a time, for tests on short conversations."""
    import heapq
    import zlib

    harmed: dict = {}
    for conv, turn, role, text in rows:
        space = lambda x: " " if x is None else x
        harm = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = "user" if harm == 4 else space(role), space(text)
        text = "" if harm == 1 else "".join(ch for ch in text if ch not in ".!?") if harm == 2 else text
        harmed.setdefault(conv, []).extend([(turn, role, text)] * {0: 0, 3: 2}.get(harm, 1))
    out = []
    for conv, turns in harmed.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in turns:
            solid = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        # by cost, then by the edits' initials: the first goal that comes out is the answer
        heap, done = [(0, "", 0, "", ())], set()
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}
        while True:
            cost, audit, i, last, kept = heapq.heappop(heap)
            if (i, last) in done:
                continue
            done.add((i, last))
            if i == len(turns) and last in ("", "a"):
                break
            for r in follows[last].replace("s", ""):
                heapq.heappush(heap, (cost + INSERT, audit + "I", i, r, (*kept, ({"u": "user", "a": "assistant"}[r], ""))))
            if i < len(turns):
                _, role, text = turns[i]
                heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, last, kept))
                if faults[i] not in ("blank", "duplicate"):
                    extra = TRUNCATED if faults[i] == "truncated" else 0
                    if role[:1] and role[:1] in follows[last]:
                        heapq.heappush(heap, (cost + extra, audit + "K", i + 1, role[:1], (*kept, (role, text))))
                    for r in follows[last].replace("s", ""):
                        heapq.heappush(heap, (cost + extra + REROLE, audit + "R", i + 1, r, (*kept, ({"u": "user", "a": "assistant"}[r], text))))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out.append((conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out
