"""Cheapest repair of a conversation's roles, by depth-first branch and bound.

A conversation is sound if its role initials read ``(s?(ua)+)?``: nothing, or an
optional system turn and user and assistant in turn.  Turns are kept (cost 0),
given the role user or assistant (3) or deleted (4); empty user or assistant
turns are inserted (3).  Blank turns and turns that repeat an earlier role and
text must be deleted; a truncated turn that stays costs 3 more.  The cheapest
list of edits wins, and of equal ones the least by its letters D, I, K, R.

The search keeps an explicit stack of prefixes.  A node is (turns done, last
role).  Suffix lower bounds come from the relaxed problem that ignores letters:
the cost of the cheapest completion of every node, computed once from the end.
Children are tried by (cost plus bound, letter).  A prefix is dropped if it
cannot beat the incumbent (cost, letters), or if its node's dominance table
holds a prefix that costs less, or as much with lesser letters: at one node two
prefixes of equal cost have the same future, and neither is the beginning of the
other, as they would differ by insertions, which cost.  The search ends when the
stack is empty, which proves the incumbent optimal.  With these bounds one
descent finds it and its siblings are dropped at once, so the time grows with
the number of turns; the tests also search with bounds of zero.

Skew: rows are exchanged once, by conversation, and read as a sorted stream (the
sort spills).  Equal turns are found by a window over the same exchange.  A task
holds the turns' texts of one conversation up to ``hold`` bytes; of a longer one
only a few hundred bytes a turn stay for the search, and its repaired turns come
from a second reading that has the edits in front.  One conversation is read by
one task in order, because its digest and its turns are one sequence.

Defined cases: a null role or text is one space (such a role is none of the
three, such a text is blank); null turns come first; equal turns are ordered by
role and text; a null ``conv_id`` is a conversation of its own; a conversation
without turns has no edits; empty texts, long texts and repeated rows need no
special treatment; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import written

SPACES = " \t\n\x0b\f\r"
#: Nodes' second part: no turn yet, after a system, user or assistant turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The role that an insertion or a new role gives, and the node it leads to.
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: b"user", ASSISTANT: b"assistant"}
KEEP, TRUNCATED, DELETE = range(3)   # what a turn's faults ask for
COST = {"D": 4, "I": 3, "R": 3, "truncated": 3}
ENDLESS = 1 << 30


def symbol(initial: bytes, demand: int) -> int:
    """A turn as one byte: its role's initial and its demand."""
    return {b"s": SYSTEM, b"u": USER, b"a": ASSISTANT}.get(initial, EMPTY) + 4 * demand


def suffix_bounds(turns: bytes | bytearray) -> array:
    """For node ``4 * done + last``: the cost of the cheapest completion, letters ignored."""
    n = len(turns)
    out = array("i", [ENDLESS]) * (4 * n + 4)
    for i in range(n, -1, -1):
        low = [0, ENDLESS, ENDLESS, 0]
        if i < n:
            role, demand = turns[i] % 4, turns[i] // 4
            after = out[4 * i + 4:4 * i + 8]
            low = [x + COST["D"] for x in after]
            if demand != DELETE:
                extra = COST["truncated"] if demand == TRUNCATED else 0
                for last in range(4):
                    low[last] = min(low[last], after[NEXT[last]] + COST["R"] + extra)
                    if role == NEXT[last] or (last == EMPTY and role == SYSTEM):
                        low[last] = min(low[last], after[role] + extra)
        for last in (USER, ASSISTANT, USER, SYSTEM, EMPTY):  # insertions: user and assistant follow each other
            low[last] = min(low[last], low[NEXT[last]] + COST["I"])
        out[4 * i:4 * i + 4] = array("i", low)
    return out


class Prefix:
    """A letter after a shorter prefix."""

    __slots__ = ("before", "letter", "length")

    def __init__(self, before: Prefix | None, letter: str):
        self.before, self.letter, self.length = before, letter, before.length + 1 if before else 1


def letters(p: Prefix | None) -> str:
    out = []
    while p:
        out.append(p.letter)
        p = p.before
    return "".join(reversed(out))


def order(x: Prefix | None, y: Prefix | None) -> int:
    """-1, 0 or 1: which differs downwards first; 0 if one is the beginning of the other."""
    below_x = below_y = ""
    while x is not y:
        longer = (x.length if x else 0) - (y.length if y else 0)
        if longer >= 0:
            below_x, x = x.letter, x.before
        if longer <= 0:
            below_y, y = y.letter, y.before
    return (below_x > below_y) - (below_x < below_y) if below_x and below_y else 0


def search(turns: bytes | bytearray, bounds: array | None = None) -> tuple[int, str]:
    """Cost and letters of the cheapest edits."""
    n = len(turns)
    bounds = suffix_bounds(turns) if bounds is None else bounds
    best, path = None, []            # incumbent cost; its prefixes by length
    table: dict[int, tuple[int, Prefix | None]] = {}
    stack: list[tuple[int, int, int, Prefix | None]] = [(0, EMPTY, 0, None)]

    def after_incumbent(p: Prefix | None) -> bool:
        """The prefix differs upwards from the incumbent's letters."""
        x, below = p, ""
        while x is not None and not (x.length <= len(path) and path[x.length - 1] is x):
            x, below = x.before, x.letter
        at = x.length if x else 0
        return bool(below) and at < len(path) and below > path[at].letter

    while stack:
        i, last, cost, p = stack.pop()
        node = 4 * i + last
        bound = cost + bounds[node]
        if best is not None and (bound > best or bound == best and after_incumbent(p)):
            continue
        known = table.get(node)
        if known and (known[0] < cost or known[0] == cost and order(known[1], p) <= 0):
            continue
        table[node] = (cost, p)
        if i == n and last in (EMPTY, ASSISTANT):
            best, path = cost, []
            while p:
                path.append(p)
                p = p.before
            path.reverse()
            continue                 # further insertions only cost
        children = [(cost + COST["I"], "I", i, NEXT[last])]
        if i < n:
            role, demand = turns[i] % 4, turns[i] // 4
            children.append((cost + COST["D"], "D", i + 1, last))
            if demand != DELETE:
                extra = COST["truncated"] if demand == TRUNCATED else 0
                children.append((cost + COST["R"] + extra, "R", i + 1, NEXT[last]))
                if role == NEXT[last] or (last == EMPTY and role == SYSTEM):
                    children.append((cost + extra, "K", i + 1, role))
        ranked = sorted((c + bounds[4 * j + s], letter, j, s, c) for c, letter, j, s in children)
        for f, letter, j, s, c in reversed(ranked):
            if f < ENDLESS and (best is None or f <= best):
                stack.append((j, s, c, Prefix(p, letter)))
    return best, "".join(x.letter for x in path)


@dataclass
class Editor:
    """Applies the letters to turns that are read one by one."""

    audit: str
    at: int = 0
    last: int = EMPTY

    def inserted(self) -> Iterator[tuple[str, bytes, bytes]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.last = NEXT[self.last]
            self.at += 1
            yield "I", ROLES[self.last], b""

    def turn(self, role: bytes, text: bytes) -> Iterator[tuple[str, bytes, bytes]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self.last = NEXT[self.last]
            yield letter, ROLES[self.last], text
        elif letter == "K":
            self.last = symbol(role[:1], KEEP)
            yield letter, role, text


class Digest:
    """SHA-256 of ``role:text`` lines joined by line feeds."""

    def __init__(self):
        self.hash, self.some = hashlib.sha256(), False

    def add(self, role: bytes, text: bytes) -> None:
        self.hash.update((b"\n" if self.some else b"") + role + b":" + text)
        self.some = True


@dataclass
class Conversation:
    """What a task keeps of the conversation it reads."""

    conv_id: object
    hold: int
    turns: bytearray = field(default_factory=bytearray)
    held: list[tuple[bytes, bytes]] | None = field(default_factory=list)
    size: int = 0
    first: int | None = None
    latest: int | None = None
    distinct: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    before: bytes | None = None

    def add(self, turn: int | None, role: bytes, text: bytes, fault: str) -> None:
        if turn is not None and turn != self.latest:
            self.first, self.latest, self.distinct = turn if self.first is None else self.first, turn, self.distinct + 1
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        initial = role[:1]
        if self.before is not None and self.before + initial not in (b"su", b"ua", b"au"):
            self.illegal += 1
        self.before = initial
        self.turns.append(symbol(initial, DELETE if fault in ("blank", "duplicate") else TRUNCATED if fault else KEEP))
        self.size += len(role) + len(text)
        if self.size > self.hold:
            self.held = None         # its turns are read a second time
        elif self.held is not None:
            self.held.append((role, text))

    def gaps(self) -> int:
        return self.latest - self.first + 1 - self.distinct if self.distinct else 0

    def repaired(self, audit: str) -> Iterator[tuple[str, bytes, bytes]]:
        edit = Editor(audit)
        for role, text in self.held or ():
            yield from edit.turn(role, text)
        yield from edit.inserted()


REPORT = ("conv_id {0}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
          "repaired_sha256 string")
TURNS = "conv_id {0}, position bigint, edit string, role binary, text binary"


def judged(rows: DataFrame) -> DataFrame:
    """One partition for all turns of a conversation, in order, with each turn's first ``fault``.  ``role`` is null in
    rows that only keep their conversation's name."""
    c = F.col
    rows = rows.repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text").orderBy(c("turn").asc_nulls_first())
    end = F.rtrim(c("text"), F.lit(SPACES))
    fault = (F.when(end == "", "blank").when(F.row_number().over(same) > 1, "duplicate")
             .when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated").otherwise(""))
    marked = rows.withColumn("fault", fault)
    return marked.sortWithinPartitions("conv_id", c("turn").asc_nulls_first(), "role", "text").select(
        "conv_id", "turn", c("role").cast("binary").alias("role"), c("text").cast("binary").alias("text"), "fault")


def _read(batches: Iterable[pa.RecordBatch], hold: int) -> Iterator[Conversation]:
    current = None
    for b in batches:
        for conv, turn, role, text, fault in zip(*(b.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "fault")), strict=True):
            if current is None or conv != current.conv_id:
                if current is not None:
                    yield current
                current = Conversation(conv, hold)
            if role is not None:
                current.add(turn, role, text, fault)
    if current is not None:
        yield current


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], most: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of bounded size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, (bytes, str))) + 64
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _mapped(rows: DataFrame, schema: str, fn: Callable[[Iterable[pa.RecordBatch]], Iterator[tuple]]) -> DataFrame:
    arrow = to_arrow_schema(StructType.fromDDL(schema.format(dict(rows.dtypes)["conv_id"])))
    names, kinds = arrow.names, arrow.types
    return rows.mapInArrow(lambda batches: _batches(fn(batches), names, kinds), schema.format(dict(rows.dtypes)["conv_id"]))


def _again(rows: DataFrame, report: DataFrame, schema: str, fn: Callable[[object, Iterator[tuple[str, bytes, bytes]]], Iterator[tuple]]) -> DataFrame:
    """A second reading of the conversations in ``report``: their edits come first, then their turns, one by one."""
    c = F.col
    names = report.select(c("conv_id").alias("name"))
    wanted = rows.filter("role is not null").join(names, c("conv_id").eqNullSafe(c("name")), "left_semi")
    edits = report.select("conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), c("audit").alias("text"))
    both = wanted.select("conv_id", "turn", "role", "text", F.lit(1).alias("part")).unionByName(edits.withColumn("part", F.lit(0)))
    stream = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", c("turn").asc_nulls_first(), "role", "text").select(
        "conv_id", "part", c("role").cast("binary").alias("role"), c("text").cast("binary").alias("text"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        every = (x for b in batches for x in zip(*(b.column(n).to_pylist() for n in ("conv_id", "part", "role", "text")), strict=True))
        heads = [next(every, None)]

        def turns(edit: Editor) -> Iterator[tuple[str, bytes, bytes]]:
            for x in every:
                if x[1] == 0:        # the next conversation's edits
                    heads.append(x)
                    break
                yield from edit.turn(x[2], x[3])
            yield from edit.inserted()

        while heads and heads[0]:
            conv, _, _, audit = heads.pop()
            yield from fn(conv, turns(Editor(audit.decode())))

    return _mapped(stream, schema, read)


def repair_report(rows: DataFrame, hold: int = 1 << 26) -> DataFrame:
    """Per conversation: its faults, the edits' ``cost`` and letters (``audit``) and the digest of the repaired turns.

    ``rows``: conv_id, turn, role, text; rows with a null role only name their conversation.
    """
    rows = rows.select("conv_id", "turn", "role", "text")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for x in _read(batches, hold):
            cost, audit = search(x.turns)
            digest = None
            if x.held is not None:
                digest = Digest()
                for _, role, text in x.repaired(audit):
                    digest.add(role, text)
            yield (x.conv_id, x.gaps(), x.blank, x.duplicate, x.truncated, x.illegal, cost, audit, digest.hash.hexdigest() if digest else None)

    found = written(_mapped(judged(rows), REPORT, read), "repairs")
    open_ = found.filter("repaired_sha256 is null")
    if open_.isEmpty():
        return found

    def digests(conv: object, turns: Iterator[tuple[str, bytes, bytes]]) -> Iterator[tuple]:
        d = Digest()
        for _, role, text in turns:
            d.add(role, text)
        yield conv, d.hash.hexdigest()

    late = _again(rows, open_, "conv_id {0}, digest string", digests).withColumnRenamed("conv_id", "name")
    done = open_.join(late, F.col("conv_id").eqNullSafe(F.col("name"))).withColumn("repaired_sha256", F.col("digest")).select(*found.columns)
    return found.filter("repaired_sha256 is not null").unionByName(done)


def repaired_turns(rows: DataFrame, hold: int = 1 << 26) -> DataFrame:
    """The repaired conversations: ``conv_id, position`` (from 0)``, edit, role, text``; deleted turns are absent."""
    rows = rows.select("conv_id", "turn", "role", "text")

    def numbered(conv: object, turns: Iterator[tuple[str, bytes, bytes]]) -> Iterator[tuple]:
        for k, (edit, role, text) in enumerate(turns):
            yield conv, k, edit, role, text

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for x in _read(batches, hold):
            audit = search(x.turns)[1]
            if x.held is None:       # read again with its edits
                yield x.conv_id, None, None, None, audit.encode()
            else:
                yield from numbered(x.conv_id, x.repaired(audit))

    found = written(_mapped(judged(rows), TURNS, read), "repaired")
    late = found.filter("position is null").select("conv_id", F.col("text").cast("string").alias("audit"))
    done = found.filter("position is not null")
    if not late.isEmpty():
        done = done.unionByName(_again(rows, late, TURNS, numbered))
    return done.select("conv_id", "position", "edit", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by ``crc32(conv_id:turn) % 20``: 0 drops the row (its conversation's name stays, with null role),
    1 empties the text, 2 removes its sentence ends, 3 repeats the row, 4 makes it the user's."""
    c = F.col
    known: Callable[[str], Column] = lambda n: F.coalesce(c(n).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", c("turn").cast("long").alias("turn"), known("role").alias("role"), known("text").alias("text"), kind.alias("kind"))
    text = F.when(c("kind") == 1, F.lit("")).when(c("kind") == 2, F.translate("text", ".!?", "")).otherwise(c("text"))
    role = F.when(c("kind") == 4, F.lit("user")).otherwise(c("role"))
    times = F.when(c("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    there = c("kind") != 0
    return rows.select("conv_id", F.when(there, c("turn")).alias("turn"), F.when(there, role).alias("role"), F.when(there, text).alias("text"),
                       F.explode(times).alias("time")).drop("time")
