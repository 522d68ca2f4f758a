"""Conversation structure repair: the cheapest edits that give a conversation turns in legal order.

The turns that remain must have role initials ``(s?(ua)+)?``: states 0 (start), 1 (after s), 2 (after u),
3 (after a). Edits: Keep 0, Rerole 3, Delete 4 (required for blank and repeated turns), Insert an empty
turn 3; a truncated turn that is not deleted adds 3. Square-root checkpointed DP: the cost to go from each state is
computed backward, its vectors are kept at every sqrt(n)-th turn only, and each block between two
checkpoints is computed again while walking forward, where the ASCII-least tight edit is emitted.

Conversations of at most ROWS turns and BYTES of text are sorted and repaired as they pass through a task.
Longer ones are numbered over sorted ranges and cut into segments of SEGMENT turns, whose ends are the
checkpoints: each segment gives a 4 x 4 min-plus matrix, the matrices of a conversation give the
vectors at the checkpoints, each segment is walked from all four states, and the chain of states picks
the walks. Only the digest of a repaired conversation is sequential by nature: its rows pass through one task
one by one, and nothing is held.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ready, written

KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
ROWS, BYTES, SEGMENT = 20_000, 16 << 20, 40_000
BLANK, ENDS, LEGAL = " \t\n\r\x0b\x0c", ".!?", ("su", "ua", "au")
#: By state: the state after a kept turn of this initial, and after a turn that is inserted or gets a new role.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEW = (2, 2, 3, 2)
#: Cost to go after the last turn: a started exchange must be ended by insertions.
END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 50

Code = tuple[str, bool, bool]  # role initial (s, u, a or another), must be deleted, truncated


# ---- damage ----------------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by a checksum of their place; copies 0: dropped, 2: repeated.

    Nulls of role, text and of the parts of the checksum are one space.
    """
    space = F.lit(" ")
    conv, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    place = F.concat(conv, F.lit(":"), turn)
    kind = F.crc32(place.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind <= 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


# ---- one conversation ------------------------------------------------------------------------------


def code_of(role: str, text: str, seen: bool) -> tuple[Code, str | None]:
    """The code of a turn and its first fault."""
    bare = text.rstrip(BLANK)
    fault = "blank" if not bare else "duplicate" if seen else "truncated" if bare[-1] not in ENDS else None
    return (role[:1] if role[:1] in "sua" else "", fault in ("blank", "duplicate"), fault == "truncated"), fault


def moves(code: Code, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that use up a turn, ASCII order."""
    initial, must_go, cut = code
    out = [("D", DELETE, state)]
    if not must_go:
        extra = CUT_SHORT * cut
        if initial in NEXT[state]:
            out.append(("K", KEEP + extra, NEXT[state][initial]))
        out.append(("R", REROLE + extra, NEW[state]))
    return out


def before(after: tuple[int, ...], code: Code) -> tuple[int, ...]:
    """Cost to go before a turn, from that after it."""
    v = [min(cost + after[to] for _, cost, to in moves(code, s)) for s in range(4)]
    v[2], v[3] = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + v[2]), min(v[1], INSERT + v[2]), v[2], v[3]


@lru_cache(maxsize=1 << 16)
def _before(shape: tuple[int, ...], code: Code) -> tuple[int, tuple[int, ...]]:
    v = before(shape, code)
    return v[0], tuple(x - v[0] for x in v)


@lru_cache(maxsize=1 << 16)
def _tight(shape: tuple[int, ...], code: Code, state: int) -> tuple[str, int]:
    """The ASCII-least tight edits up to the end of a turn, and the state after it; ``shape``: cost to go after the turn."""
    now, letters = before(shape, code), ""
    while True:
        take = [(letter, to) for letter, cost, to in moves(code, state) if cost + shape[to] == now[state]]
        if INSERT + now[NEW[state]] == now[state]:
            take.append(("I", NEW[state]))
        letter, to = min(take)
        letters, state = letters + letter, to
        if letter != "I":
            return letters, state


def walk(codes: list[Code], state: int = 0, end: tuple[int, ...] = END) -> tuple[int, list[str], int]:
    """(cost, edits of each turn, last state); ``end``: cost to go after these turns.

    Vectors are kept as a base and a shape relative to it, one per checkpoint.
    """
    step = isqrt(len(codes)) + 1
    base, shape = end[0], tuple(x - end[0] for x in end)
    marks = {}
    for i in range(len(codes) - 1, -1, -1):
        if (i + 1) % step == 0 or i == len(codes) - 1:
            marks[i // step] = shape
        more, shape = _before(shape, codes[i])
        base += more
    cost, out = base + shape[state], []
    for block in range(-(-len(codes) // step)):
        part = codes[block * step : (block + 1) * step]
        shapes = [marks[block]]
        for code in reversed(part[1:]):
            shapes.append(_before(shapes[-1], code)[1])
        for code, after in zip(part, reversed(shapes), strict=True):
            letters, state = _tight(after, code, state)
            out.append(letters)
    return cost, out, state


def last_insertions(state: int) -> str:
    return "I" * (END[state] // INSERT)


class Repaired:
    """Applies edits to turns in order and takes the digest of what remains."""

    def __init__(self, state: int = 0):
        self.state, self.digest, self.empty = state, hashlib.sha256(), True

    def apply(self, letters: str, role: str = "", text: str = "") -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that remain."""
        for letter in letters:
            if letter == "D":
                continue
            if letter == "K":
                self.state = NEXT[self.state][role[0]]
                turn = role, text
            else:
                self.state = NEW[self.state]
                turn = "assistant" if self.state == 3 else "user", "" if letter == "I" else text
            self.digest.update(f"{'' if self.empty else chr(10)}{turn[0]}:{turn[1]}".encode("utf-8", "surrogatepass"))
            self.empty = False
            yield letter, *turn


def repair_one(turns: Iterable[tuple[int | None, str, str]]) -> tuple[dict, list[tuple[str, str, str]]]:
    """The summary of a conversation of (turn, role, text) in order, and its repaired turns."""
    turns = list(turns)
    seen, codes = set(), []
    faults = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in turns:
        code, fault = code_of(role, text, (role, text) in seen)
        seen.add((role, text))
        codes.append(code)
        if fault:
            faults[fault] += 1
    cost, edits, state = walk(codes)
    edits.append(last_insertions(state))
    made, kept = Repaired(), []
    for letters, (_, role, text) in zip(edits, [*turns, (None, "", "")], strict=True):
        kept += made.apply(letters, role, text)
    numbers = {t for t, _, _ in turns if t is not None}
    pairs = zip(turns, turns[1:])
    return {"gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, **faults,
            "illegal": sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in pairs), "cost": cost, "audit": "".join(edits),
            "repaired_sha256": made.digest.hexdigest()}, kept


# ---- Spark -----------------------------------------------------------------------------------------

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SUMMARY = f"{', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
TURNS = "at long, edit string, role string, text string"


def _kind(rows: DataFrame) -> str:
    return dict(rows.dtypes)["conv_id"]


def _short(rows: DataFrame, turns: bool) -> DataFrame:
    """Conversations of bounded size: sorted, and repaired one after the other."""
    fields = TURNS if turns else SUMMARY
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = rows.repartition(parts, "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")
    names = ["conv_id", *[f.split()[0] for f in fields.split(", ")]]

    def finished(conv, group) -> Iterator[list]:
        summary, kept = repair_one(group)
        if turns:
            for at, (edit, role, text) in enumerate(kept):
                yield [conv, at, edit, role, text]
        else:
            yield [conv, *summary.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, out, group, now = None, [], [], None

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema, strict=True)], names=names)

        for batch in batches:
            if schema is None:
                types = {"long": pa.int64(), "string": pa.string()}
                schema = [batch.schema.field("conv_id").type, *[types[f.split()[1]] for f in fields.split(", ")]]
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for conv, turn, role, text, copies in zip(*columns, strict=True):
                if now is None or conv != now[0]:
                    if now is not None:
                        out += finished(now[0], group)
                    group, now = [], (conv,)
                group += [(turn, role, text)] * copies
            yield made()
            out = []
        if now is not None:
            out += finished(now[0], group)
            yield made()

    return dealt.mapInArrow(run, f"conv_id {_kind(rows)}, {fields}")


def _same(column: str) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Turns of long conversations with their place ``i`` in them and what the DP needs, written; repeats are rows.

    Sorted ranges by prefixes of the texts, so that the sample that cuts them stays small.
    """
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = rows.withColumn("k", _same("conv_id"))
    dealt = keyed.repartitionByRange(parts, "k", F.asc_nulls_first("turn"), F.substring("role", 1, 32), F.substring("text", 1, 32))
    names = ["k", "turn", "role", "text", "range", "j", "initial", "fault", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, j = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for k, turn, role, text, copies in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                fault = code_of(role, text, False)[1]
                digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                for _ in range(copies):
                    out.append((k, turn, role, text, me, j, role[:1], fault, digest))
                    j += 1
            types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    sort = dealt.sortWithinPartitions("k", F.asc_nulls_first("turn"), "role", "text").select("k", "turn", "role", "text", "copies")
    made = written(sort.mapInArrow(run, "k string, turn long, role string, text string, range int, j long, initial string, fault string, digest binary"), "long-turns")
    sizes = made.groupBy("range").agg(F.count("*").alias("n"))  # one row per range
    earlier = sizes.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("skip"))
    placed = made.join(F.broadcast(earlier), "range").withColumn("g", F.col("j") + F.col("skip"))
    starts = placed.groupBy("k").agg(F.min("g").alias("start"))
    first = placed.groupBy("k", "digest").agg(F.min("g").alias("first"))
    placed = placed.join(starts, "k").join(first, ["k", "digest"])
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("g") > F.col("first"), "duplicate").otherwise(F.col("fault"))
    return written(placed.select("k", "turn", "role", "text", "initial", fault.alias("fault"), (F.col("g") - F.col("start")).alias("i")), "placed-turns")


def _codes(table: pa.Table) -> tuple[list[Code], list[str]]:
    table = table.sort_by("i")
    initials, faults = table.column("initial").to_pylist(), table.column("fault").to_pylist()
    return [(x if x in ("s", "u", "a") else "", f in ("blank", "duplicate"), f == "truncated") for x, f in zip(initials, faults, strict=True)], initials


def _long(rows: DataFrame, turns: bool, segment: int) -> DataFrame:
    """Conversations of any size, by segments."""
    placed = _numbered(rows)
    light = placed.select("k", "turn", "initial", "fault", "i", F.floor(F.col("i") / segment).alias("segment"))
    who = rows.select("conv_id", _same("conv_id").alias("k")).distinct()

    def matrix(table: pa.Table) -> pa.Table:
        codes, initials = _codes(table)
        columns = []
        for e in range(4):
            v = tuple(0 if s == e else NEVER for s in range(4))
            for code in reversed(codes):
                v = before(v, code)
            columns.append(v)
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        return pa.table({"k": table.column("k")[:1], "segment": table.column("segment")[:1], "m": pa.array([[c for v in columns for c in v]], pa.list_(pa.int64())),
                         "head": pa.array(initials[:1]), "tail": pa.array(initials[-1:]), "illegal": pa.array([illegal], pa.int64())})

    def vectors(table: pa.Table) -> pa.Table:  # a conversation's matrices: an audit is one string, so they are 2^31 / segment at most
        table = table.sort_by("segment")
        after, out = END, []
        for m in reversed(table.column("m").to_pylist()):
            out.append(after)
            after = tuple(min(m[4 * e + s] + after[e] for e in range(4)) for s in range(4))
        heads, tails = table.column("head").to_pylist(), table.column("tail").to_pylist()
        illegal = sum(table.column("illegal").to_pylist()) + sum(a + b not in LEGAL for a, b in zip(tails, heads[1:]))
        n = table.num_rows
        return pa.table({"k": table.column("k"), "segment": table.column("segment"), "after": pa.array([list(v) for v in reversed(out)], pa.list_(pa.int64())),
                         "cost": pa.array([after[0]] * n, pa.int64()), "illegal": pa.array([illegal] * n, pa.int64())})

    def walks(table: pa.Table) -> pa.Table:
        codes, _ = _codes(table)
        after = tuple(table.column("after")[0].as_py())
        got = [walk(codes, s, after) for s in range(4)]
        return pa.table({"k": table.column("k")[:1], "segment": table.column("segment")[:1], "edits": pa.array([[edits for _, edits, _ in got]], pa.list_(pa.list_(pa.string()))),
                         "ends": pa.array([[s for _, _, s in got]], pa.list_(pa.int32()))})

    def chain(table: pa.Table) -> pa.Table:
        table = table.sort_by("segment")
        state, states = 0, []
        for ends in table.column("ends").to_pylist():
            states.append(state)
            state = ends[state]
        last = [""] * (len(states) - 1) + [last_insertions(state)]
        return pa.table({"k": table.column("k"), "segment": table.column("segment"), "state": pa.array(states, pa.int32()), "last": pa.array(last)})

    matrices = written(light.groupBy("k", "segment").applyInArrow(matrix, "k string, segment long, m array<long>, head string, tail string, illegal long"), "segment-matrices")
    marks = written(matrices.groupBy("k").applyInArrow(vectors, "k string, segment long, after array<long>, cost long, illegal long"), "checkpoints")
    walked = written(light.join(marks.select("k", "segment", "after"), ["k", "segment"]).groupBy("k", "segment")
                     .applyInArrow(walks, "k string, segment long, edits array<array<string>>, ends array<int>"), "segment-walks")
    states = walked.select("k", "segment", "ends").groupBy("k").applyInArrow(chain, "k string, segment long, state int, last string")
    chosen = written(walked.join(states, ["k", "segment"]).select("k", "segment", "last", F.get("edits", F.col("state")).alias("edits")), "chosen-walks")

    edits = chosen.select("k", "segment", F.posexplode("edits").alias("p", "letters"))
    edits = edits.select("k", (F.col("segment") * segment + F.col("p")).alias("i"), "letters")
    final = chosen.filter("last <> ''").select("k", F.lit(None).cast("long").alias("i"), F.col("last").alias("letters"), F.lit("").alias("role"), F.lit("").alias("text"))
    applied = placed.select("k", "i", "role", "text").join(edits, ["k", "i"]).select("k", "i", "letters", "role", "text").unionByName(final)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = applied.repartition(parts, "k").sortWithinPartitions("k", F.asc_nulls_last("i"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made, at = None, Repaired(), 0
        for batch in batches:
            ks, out = [], []
            for k, _, letters, role, text in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if k != now:
                    if now is not None and not turns:
                        ks.append(now)
                        out.append((made.digest.hexdigest(),))
                    now, made, at = k, Repaired(), 0
                for edit, r, t in made.apply(letters, role, text):
                    if turns:
                        ks.append(k)
                        out.append((at, edit, r, t))
                    at += 1
            yield _batch(ks, out, turns)
        if now is not None and not turns:
            yield _batch([now], [(made.digest.hexdigest(),)], turns)

    if turns:
        return dealt.mapInArrow(digests, f"k string, {TURNS}").join(who, "k").select("conv_id", *[f.split()[0] for f in TURNS.split(", ")])
    hashed = dealt.mapInArrow(digests, "k string, repaired_sha256 string")
    count = lambda f: F.sum((F.col("fault") == f).cast("long")).alias(f)
    counts = placed.groupBy("k").agg(*[F.coalesce(count(f), F.lit(0)).alias(f) for f in ("blank", "duplicate", "truncated")],
                                     F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    pieces = chosen.select("k", F.struct("segment", F.concat(F.array_join("edits", ""), "last").alias("a")).alias("p"))
    audits = pieces.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["a"]), "").alias("audit"))
    per = marks.groupBy("k").agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal"))
    out = who
    for more in (counts, per, audits, hashed):
        out = out.join(more, "k", "left")
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def _batch(ks: list, out: list, turns: bool) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.string(), pa.string()] if turns else [pa.string()]
    columns = list(zip(*out, strict=True)) or [[] for _ in types]
    names = ["k", *([f.split()[0] for f in TURNS.split(", ")] if turns else ["repaired_sha256"])]
    return pa.RecordBatch.from_arrays([pa.array(ks, pa.string()), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=names)


def _all(rows: DataFrame, turns: bool, most_rows: int, most_bytes: int, segment: int) -> DataFrame:
    ready(rows.sparkSession)
    if "copies" not in rows.columns:
        rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).alias("copies"))
    rows = rows.select("conv_id", "turn", "role", "text", "copies")
    size = rows.groupBy("conv_id").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * (F.octet_length("role") + F.octet_length("text"))).alias("b"))
    long = written(size.filter((F.col("n") > most_rows) | (F.col("b") > most_bytes)).select(F.col("conv_id").alias("_long")), "long-conversations")
    if long.isEmpty():
        return _short(rows, turns)
    is_long = F.col("conv_id").eqNullSafe(F.col("_long"))
    return _short(rows.join(long, is_long, "left_anti"), turns).unionByName(_long(rows.join(long, is_long, "left_semi"), turns, segment))


def repair(rows: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES, segment: int = SEGMENT) -> DataFrame:
    """One row per conv_id (null is one): gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    ``rows``: conv_id, turn, role, text, and copies if some rows are to be dropped (0) or repeated (2), as ``damage`` gives them; other
    columns are not read. Turns are taken by turn (nulls first), then role, then text, so ties have one order. Null roles
    and texts are one space: such a text is blank. Repeated rows are repeated turns. A conversation without turns has
    zeros, an empty audit and the digest of nothing. An empty table gives no rows.
    """
    return _all(rows, False, most_rows, most_bytes, segment)


def repaired_turns(rows: DataFrame, most_rows: int = ROWS, most_bytes: int = BYTES, segment: int = SEGMENT) -> DataFrame:
    """The repaired conversations: conv_id, at (from 0), edit (K, R or I), role, text."""
    return _all(rows, True, most_rows, most_bytes, segment)
