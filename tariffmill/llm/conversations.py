"""Conversation structure repair by generalised LR parsing of role sequences.

A conversation's roles should spell ``(s?(ua)+)?``: perhaps one system turn, then user and assistant in turn. Each turn is
kept (cost 0), given the role user or assistant (1) or deleted (2), and an empty turn of either role may be inserted
anywhere (5); blank and repeated turns must be deleted, and a truncated turn that stays costs 5 more. The parser shifts
the role grammar over a graph-structured stack: all edits of a prefix live in one graph whose nodes share their histories,
and after each turn equal stack tops are merged into the one of least (cost, audit), the audit being the edits' initials.
Two histories of one prefix and equal cost are never prefixes of each other, so the merge keeps the least audit of all.

Turns are sorted over the whole cluster by (conversation, turn, role, text), so a conversation with a third of all rows is
spread over many tasks. The first and last conversation of a
partition may go on in another one: a task parses its first one from each of the stack's possible tops, and the segments
of a conversation, one a partition, are put together by least (cost, audit). The hash of a conversation must read its
repaired text in order, so a task streams it without holding it. Turns that agree in everything are one entry with a count.

Defined cases: null roles and texts are one space; null turns come first; null conversation ids are one conversation. Rows
of one turn come by role, then text. The copy of a repeated row is a duplicate of it. A conversation without turns has
no faults, an empty audit and the hash of the empty text. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffmill.llm.common import BLANKS, Workspace

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: LR states of  C -> () | P,  P -> T | s T | P T,  T -> u a : terminals shift, full right sides are reduced.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 4}
REDUCE = {4: (2, "T"), 5: (1, "P"), 6: (2, "P"), 7: (2, "P")}
GOTO = {(0, "T"): 5, (1, "T"): 6, (3, "T"): 7, (0, "P"): 3}
ACCEPTING = (0, 3)
TOPS = (0, 1, 2, 3)
ROLE_OF = {"u": "user", "a": "assistant"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
LEGAL_PAIRS = ("su", "ua", "au")


@dataclass(frozen=True, slots=True)
class Stack:
    """A stack's top; what is below is shared by all stacks that grew from it."""

    state: int
    below: Stack | None = None


@dataclass(frozen=True, slots=True)
class Edits:
    """A history of edits as a linked list, so that histories share their beginnings."""

    cost: int = 0
    letters: str = ""
    before: Edits | None = None
    length: int = 0

    def then(self, cost: int, letters: str) -> Edits:
        return Edits(self.cost + cost, letters, self, self.length + len(letters))

    def audit(self) -> str:
        parts, at = [], self
        while at is not None:
            parts.append(at.letters)
            at = at.before
        return "".join(reversed(parts))


def precedes(one: Edits, other: Edits) -> bool:
    """Whether ``one`` is less by (cost, audit); the audits are compared from where the histories part."""
    if one.cost != other.cost:
        return one.cost < other.cost
    left, right, a, b = [], [], one, other
    while a is not b:
        if b is None or (a is not None and a.length >= b.length):
            left.append(a.letters)
            a = a.before
        else:
            right.append(b.letters)
            b = b.before
    return "".join(reversed(left)) < "".join(reversed(right))


def shifted(stack: Stack, terminal: str) -> Stack | None:
    """``stack`` after the terminal and all reductions that follow, or None where the grammar has no such turn."""
    state = SHIFT.get((stack.state, terminal))
    if state is None:
        return None
    stack = Stack(state, stack)
    while stack.state in REDUCE:
        size, symbol = REDUCE[stack.state]
        for _ in range(size):
            stack = stack.below
        stack = Stack(GOTO[stack.state, symbol], stack)
    return stack


Front = dict[int, tuple[Stack, Edits]]


def merge(front: Front, stack: Stack | None, edits: Edits) -> bool:
    """Add a stack to the tops; of two equal tops that of least (cost, audit) stays."""
    if stack is None:
        return False
    held = front.get(stack.state)
    if held is not None and not precedes(edits, held[1]):
        return False
    front[stack.state] = stack, edits
    return True


def with_inserts(front: Front) -> Front:
    """All tops that inserted turns reach; the front itself stays as it is."""
    front, grown = dict(front), True
    while grown:
        grown = False
        for stack, edits in list(front.values()):
            for terminal in "ua":
                grown |= merge(front, shifted(stack, terminal), edits.then(INSERT, "I"))
    return front


def start_at(top: int) -> Front:
    bottom = Stack(0)
    return {top: (bottom if top == 0 else Stack(top, bottom), Edits())}


def advance(front: Front, role: str, fault: str, copies: int) -> Front:
    """The front after one entry: a turn and ``copies - 1`` repetitions of it, which can only be deleted."""
    after: Front = {}
    for stack, edits in with_inserts(front).values():
        merge(after, stack, edits.then(DELETE, "D"))
        if fault in ("blank", "duplicate"):
            continue
        extra = TRUNCATED if fault == "truncated" else 0
        merge(after, shifted(stack, role[:1]), edits.then(KEEP + extra, "K"))
        for terminal in "ua":
            merge(after, shifted(stack, terminal), edits.then(REROLE + extra, "R"))
    if copies > 1:
        after = {top: (stack, edits.then(DELETE * (copies - 1), "D" * (copies - 1))) for top, (stack, edits) in after.items()}
    return after


def best(front: Front) -> Edits:
    """The least complete repair."""
    final = with_inserts(front)
    found = [final[top][1] for top in ACCEPTING if top in final]
    least = found[0]
    for edits in found[1:]:
        if precedes(edits, least):
            least = edits
    return least


class Rewriter:
    """The repaired turns of one conversation, entry by entry, as its audit says."""

    def __init__(self, audit: str):
        self.letters, self.last = iter(audit), ""

    def _role(self, kept: str | None = None) -> str:
        role = kept if kept is not None else ROLE_OF["a" if self.last == "u" else "u"]
        self.last = role[:1]
        return role

    def turn(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str]]:
        for _ in range(copies):
            while (letter := next(self.letters)) == "I":
                yield self._role(), ""
            if letter != "D":
                yield self._role(role if letter == "K" else None), text

    def rest(self) -> Iterator[tuple[str, str]]:
        for _ in self.letters:
            yield self._role(), ""


@dataclass
class Segment:
    """What a stretch of one conversation's entries tells of itself; stretches add up."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None

    def add(self, turn: int | None, role: str, fault: str, copies: int) -> None:
        initial = role[:1]
        if self.first is None:
            self.first = initial
        elif self.last + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.illegal += copies - 1  # a role after itself is never legal
        self.last = initial
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        again = "blank" if fault == "blank" else "duplicate"
        setattr(self, again, getattr(self, again) + copies - 1)
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def join(self, later: Segment) -> None:
        if later.first is not None and self.last is not None and self.last + later.first not in LEGAL_PAIRS:
            self.illegal += 1
        self.turns += later.turns - (self.high is not None and self.high == later.low)
        for name in ("blank", "duplicate", "truncated", "illegal"):
            setattr(self, name, getattr(self, name) + getattr(later, name))
        self.low = later.low if self.low is None else self.low
        self.high = self.high if later.high is None else later.high
        self.first = later.first if self.first is None else self.first
        self.last = self.last if later.last is None else later.last

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def damaged(conversations: DataFrame) -> DataFrame:
    """The damage of the query's contract, a rule on crc32 of ``conv_id:turn``; nulls are one space."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    hurt = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    return hurt.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _entries(turns: DataFrame, work: Workspace) -> DataFrame:
    """Equal rows as one entry with their count and first fault, in the order of conversation, turn, role and text."""
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    counted = work.save(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "text_sha", F.unhex(F.sha2("text", 256))), "counted")
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = counted.groupBy("conv_id", "role", "text_sha").agg(F.min(at).alias("first_at"), F.count(F.lit(1)).alias("n")).where("n > 1")
    c, f = counted.alias("c"), firsts.alias("f")
    same = F.col("c.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("c.role") == F.col("f.role")) & (F.col("c.text_sha") == F.col("f.text_sha"))
    shown, first = F.rtrim("c.text", F.lit(BLANKS)), F.struct(F.col("c.turn").isNotNull().alias("known"), "c.turn")
    fault = F.when(shown == "", "blank").when(F.col("first_at").isNotNull() & ~F.col("first_at").eqNullSafe(first), "duplicate").when(
        ~F.substring(shown, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    marked = c.join(f, same, "left").select("c.conv_id", "c.turn", "c.role", "c.text", "c.copies", fault.alias("fault"))
    return work.save(marked, "entries")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation and partition: what its entries there tell, and the least edits from each top it may begin with.

    Only the first conversation of a partition can have begun in an earlier one.
    """
    part = TaskContext.get().partitionId()
    conv, fronts, segment, schema = None, None, None, None

    def row() -> dict:
        paths = [
            {"start": start, "top": top, "cost": edits.cost, "audit": edits.audit()}
            for start, front in fronts.items() for top, (_, edits) in front.items()
        ]
        return {"conv_id": conv, "part": part, "segment": vars(segment), "paths": paths}

    for batch in batches:
        schema, out = _segment_schema(batch.schema.field("conv_id").type), []
        names = ("conv_id", "turn", "role", "fault", "copies")
        for cid, turn, role, fault, copies in zip(*(batch.column(c).to_pylist() for c in names)):
            if fronts is None or cid != conv:
                tops = TOPS if fronts is None else (0,)
                if fronts is not None:
                    out.append(row())
                conv, segment, fronts = cid, Segment(), {top: start_at(top) for top in tops}
            fronts = {top: advance(front, role, fault, copies) for top, front in fronts.items()}
            segment.add(turn, role, fault, copies)
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if fronts is not None:
        yield pa.RecordBatch.from_pylist([row()], schema=schema)


def _segment_schema(kind: pa.DataType) -> pa.Schema:
    segment = pa.struct([(f.name, pa.string() if f.name in ("first", "last") else pa.int64()) for f in fields(Segment)])
    path = pa.struct([("start", pa.int64()), ("top", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
    return pa.schema([("conv_id", kind), ("part", pa.int64()), ("segment", segment), ("paths", pa.list_(path))])


def joined(front: dict[int, tuple[int, str]], paths: list[dict]) -> dict[int, tuple[int, str]]:
    """Tops with their least (cost, audit) after one more segment."""
    after: dict[int, tuple[int, str]] = {}
    for path in paths:
        if path["start"] in front:
            cost, audit = front[path["start"]]
            reached = cost + path["cost"], audit + path["audit"]
            if path["top"] not in after or reached < after[path["top"]]:
                after[path["top"]] = reached
    return after


def finished(front: dict[int, tuple[int, str]]) -> tuple[int, str]:
    ends = []
    for top, (cost, audit) in front.items():
        end = best(start_at(top))
        ends.append((cost + end.cost, audit + end.audit()))
    return min(ends)


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their segments, which come in the order of partitions."""
    conv, front, total, schema = None, None, None, None

    def whole() -> dict:
        cost, audit = finished(front)
        return {"conv_id": conv, **{name: getattr(total, name) for name in COUNTS}, "cost": cost, "audit": audit}

    for batch in batches:
        schema, out = pa.schema([batch.schema.field("conv_id"), *((n, pa.int64()) for n in (*COUNTS, "cost")), ("audit", pa.string())]), []
        for cid, segment, paths in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "paths"))):
            if front is None or cid != conv:
                if front is not None:
                    out.append(whole())
                conv, front, total = cid, {0: (0, "")}, Segment()
            front = joined(front, paths)
            total.join(Segment(**segment))
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if front is not None:
        yield pa.RecordBatch.from_pylist([whole()], schema=schema)


def _streamed(as_hash: bool):
    """Each conversation's audit and then its entries, as repaired turns or as their hash; no conversation is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, rewriter, out, kind, place, digest = None, None, [], None, 0, None

        def take(turns: Iterator[tuple[str, str]]) -> None:
            nonlocal place
            for role, text in turns:
                if as_hash:
                    digest.update(f"{chr(10) if place else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                else:
                    out.append({"conv_id": conv, "place": place, "role": role, "text": text})
                place += 1

        def end() -> None:
            take(rewriter.rest())
            if as_hash:
                out.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})

        def given() -> pa.RecordBatch:
            more = [("repaired_sha256", pa.string())] if as_hash else [("place", pa.int64()), ("role", pa.string()), ("text", pa.string())]
            return pa.RecordBatch.from_pylist(out, schema=pa.schema([kind, *more]))

        for batch in batches:
            kind = batch.schema.field("conv_id")
            for cid, audit, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "copies"))):
                if audit is None:
                    take(rewriter.turn(role, text, copies))
                    continue
                if rewriter is not None:
                    end()
                conv, rewriter, place, digest = cid, Rewriter(audit), 0, hashlib.sha256()
            yield given()
            out.clear()
        if rewriter is not None:
            end()
            yield given()

    return run


class Repair:
    """The least repair of each conversation of a table with conv_id, turn, role and text."""

    def __init__(self, conversations: DataFrame):
        self.work = Workspace(conversations.sparkSession, "conversations")
        self.kind = conversations.schema["conv_id"].dataType.simpleString()
        self.entries = _entries(conversations, self.work)
        order = ["conv_id", "turn", "role", "text"]
        segment = ", ".join(f"{f.name}:{'string' if f.name in ('first', 'last') else 'bigint'}" for f in fields(Segment))
        spread = self.entries.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "fault", "copies")
        segments = self.work.save(spread.mapInArrow(
            _parsed, f"conv_id {self.kind}, part long, segment struct<{segment}>, paths array<struct<start:bigint,top:bigint,cost:bigint,audit:string>>",
        ), "segments")
        counts = ", ".join(f"{c} long" for c in (*COUNTS, "cost"))
        self.found = self.work.save(
            segments.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(
                _put_together, f"conv_id {self.kind}, {counts}, audit string"), "found")

    def _stream(self, as_hash: bool, schema: str) -> DataFrame:
        audits = self.found.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                                   F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("copies"))
        turns = self.entries.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "copies")
        told = audits.union(turns).withColumn("follows", F.col("audit").isNull())
        order = ["conv_id", "follows", "turn", "role", "text"]
        return told.repartition("conv_id").sortWithinPartitions(*order).drop("follows", "turn").mapInArrow(_streamed(as_hash), schema)

    def turns(self) -> DataFrame:
        """The repaired turns: conv_id, place from 0, role, text."""
        return self._stream(False, f"conv_id {self.kind}, place long, role string, text string")

    def summary(self, conv_ids: DataFrame) -> DataFrame:
        """A row for each id of ``conv_ids``: faults, cost, audit and the hash of the repaired turns."""
        hashes = self._stream(True, f"conv_id {self.kind}, repaired_sha256 string")
        f, h, c = self.found.alias("f"), hashes.alias("h"), conv_ids.select("conv_id").distinct().alias("c")
        full = f.join(h, F.col("f.conv_id").eqNullSafe(F.col("h.conv_id"))).select("f.*", "h.repaired_sha256").alias("r")
        return c.join(full, F.col("c.conv_id").eqNullSafe(F.col("r.conv_id")), "left").select(
            "c.conv_id", *[F.coalesce(f"r.{n}", F.lit(0)).alias(n) for n in (*COUNTS, "cost")], F.coalesce("r.audit", F.lit("")).alias("audit"),
            F.coalesce("r.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
        )
