"""Repair of a conversation's structure by error-correcting Earley parsing.

A row is a symbol: the initial of its role, and whether it must go (blank, or a copy of an earlier row) or is cut short. A weighted
grammar (``GRAMMAR``) derives the role sequences ``(s?(ua)+)?``; its edit productions (``EDITS``) let a row be kept, given another role
or deleted, and a turn be inserted, each at a cost. An item of the chart, (production, dot, origin), retains the least (cost, audit),
audits being the edits' initials in order; the completed chart's best derivation of the start symbol is the repair. Productions are
left-linear, so a set of the chart has a fixed number of items and reads its predecessor alone: a conversation is parsed as it streams
by, in time linear in its length.

Of two audits with equal cost for the same rows and state none is the beginning of the other (what it lacks would be insertions, which
cost), so the order of audits is kept whatever follows, and the least of each item gives the least of all. Audits are linked edits,
compared where they part, which links of growing length find. Sets of the chart after the first ``SHARED`` rows are shared by all
conversations of a task with the same beginning.

Rows of a conversation are dealt to one task by its id and sorted there, which spills; a conversation longer than ``HELD`` rows is
parsed and digested row by row: a row's text leaves as soon as all surviving derivations agree on it, so no conversation is held whole.
(Its digest is one hash over all its text in order, so one conversation is one task's work by definition.) What is kept for each row is
a link of the audit and sixteen bytes, by which copies are known.

Edge cases: null roles and texts are one space; a null id is one conversation; turns in order, nulls first, ties by role and
text; repeated rows are copies; a conversation of no rows has an empty repair; texts of any length; an empty table gives no row. Only
the four named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import bounded, partitions, tidy

#: Left side, right side. G is the start; B: nothing yet; Y: after a system turn; M: after a user's; P: after an assistant's. s, u, a and d are edits.
GRAMMAR = (
    ("G", ("B",)), ("G", ("P",)),
    ("B", ()), ("B", ("B", "d")),
    ("Y", ("B", "s")), ("Y", ("Y", "d")),
    ("M", ("B", "u")), ("M", ("Y", "u")), ("M", ("P", "u")), ("M", ("M", "d")),
    ("P", ("M", "a")), ("P", ("P", "d")),
)
#: Edit productions: initial, the symbols it takes (None: no row), cost. Symbols: s, u, a and - (another role), in upper case or _ where cut short; x must go.
ANY = "sua-SUA_"
EDITS = {
    "s": (("K", "sS", 0),),
    "u": (("K", "uU", 0), ("R", "sa-SA_", 1), ("I", None, 5)),
    "a": (("K", "aA", 0), ("R", "su-SU_", 1), ("I", None, 5)),
    "d": (("D", ANY + "x", 2),),
}
#: What keeping a row that is cut short costs besides, in either role.
CUT_SHORT = 5
#: A derivation that ends after an assistant's turn can go on as any other, at this cost at most (an inserted user's turn; a deleted system row
#: costs less). What costs more than it by more than this can't become the least, and leaves the chart.
SLACK = 5
SHARED, HELD, CACHED = 24, 256, 1 << 15
LEGAL = ("su", "ua", "au")


class Edit(NamedTuple):
    """The last edit of an audit, the one before it, and one further back, for comparisons in logarithmic time."""

    initial: str
    role: str
    depth: int
    before: Edit | None
    jump: Edit | None


def _then(before: Edit | None, initial: str, role: str) -> Edit:
    if before is None:
        return Edit(initial, role, 1, None, None)
    j = before.jump
    far = j is not None and j.jump is not None and before.depth - j.depth == j.depth - j.jump.depth
    return Edit(initial, role, before.depth + 1, before, j.jump if far else before)


def _at(x: Edit, depth: int) -> Edit:
    while x.depth > depth:
        x = x.jump if x.jump is not None and x.jump.depth >= depth else x.before
    return x


def _shared(x: Edit | None, y: Edit | None) -> tuple[Edit | None, Edit | None, Edit | None]:
    """(the last edit common to both, the first of x and the first of y after it)."""
    if x is None or y is None:
        return None, x and _at(x, 1), y and _at(y, 1)
    a, b = _at(x, min(x.depth, y.depth)), _at(y, min(x.depth, y.depth))
    if a is b:
        return a, (_at(x, a.depth + 1) if x is not a else None), (_at(y, a.depth + 1) if y is not a else None)
    while a.before is not b.before:
        if a.jump is not b.jump:
            a, b = a.jump, b.jump
        else:
            a, b = a.before, b.before
    return a.before, a, b


Value = tuple[int, "Edit | None"]


def _less(x: Value, y: Value) -> bool:
    """Whether x is the cheaper, or as cheap with the lesser audit."""
    if x[0] != y[0] or x[1] is y[1]:
        return x[0] < y[0]
    _, a, b = _shared(x[1], y[1])
    return b is not None and (a is None or a.initial < b.initial)


Item = tuple[int, int, int]  # production, dot, origin


class Chart(NamedTuple):
    """One set of the chart: its place, what waits for each symbol, and the best completed derivation of each symbol from the beginning."""

    place: int
    waiting: dict[str, list[tuple[Item, Value]]]
    done: dict[str, Value]


RULES: dict[str, list[int]] = {}
for _k, (_left, _) in enumerate(GRAMMAR):
    RULES.setdefault(_left, []).append(_k)


def _advance(first: Chart | None, last: Chart | None, symbol: str | None) -> Chart:
    """The set after one more row; with no set before it, the first one."""
    place = 0 if last is None else last.place + 1
    best: dict[Item, Value] = {}
    waiting: dict[str, list[Item]] = {}
    done: dict[str, Value] = {}
    agenda: list[Item] = []

    def put(item: Item, value: Value) -> None:
        old = best.get(item)
        if old is None or _less(value, old):
            best[item] = value
            agenda.append(item)

    def edited(name: str, parent: Item, value: Value, row: str | None) -> None:
        """An edit production completed over ``row`` (None: over none) moves the item that waits for it."""
        for initial, takes, cost in EDITS[name]:
            if row is None if takes is None else row is not None and row in takes:
                cost += CUT_SHORT if row is not None and initial != "D" and row in "SUA_" else 0
                put((parent[0], parent[1] + 1, parent[2]), (value[0] + cost, _then(value[1], initial, name)))

    if last is None:
        for k in RULES["G"]:
            put((k, 0, 0), (0, None))
    else:
        for name in EDITS:  # scan: the row under each edit that the set before awaits
            for item, value in last.waiting.get(name, ()):
                edited(name, item, value, symbol)
    while agenda:
        item = agenda.pop()
        value, (k, dot, origin) = best[item], item
        left, right = GRAMMAR[k]
        if dot == len(right):  # complete: what awaited it at its origin goes on; no item there has a value of its own yet
            if left in done and not _less(value, done[left]):
                continue
            done[left] = value
            there = waiting if origin == place else None
            awaiting = there.get(left, ()) if there is not None else [i for i, _ in first.waiting.get(left, ())]
            for p, d, o in awaiting:
                put((p, d + 1, o), value)
            continue
        name = right[dot]
        if item not in waiting.setdefault(name, []):
            waiting[name].append(item)
        if name in EDITS:  # predict an edit over no row; those over a row are scanned by the next set
            edited(name, item, value, None)
        else:
            for r in RULES[name]:  # predict; left recursion keeps all of these at the first place
                put((r, 0, place), (0, None))
            if name in done:
                put((k, dot + 1, origin), done[name])
    limit = done["P"][0] + SLACK
    return Chart(place, {name: [(i, v) for i in items if (v := best[i])[0] <= limit] for name, items in waiting.items()}, done)


FIRST = _advance(None, None, None)


@functools.lru_cache(CACHED)
def _after(symbols: str) -> Chart:
    return _advance(FIRST, _after(symbols[:-1]), symbols[-1]) if symbols else FIRST


class Parse:
    """Rows' symbols one after the other; edits as soon as they are certain."""

    def __init__(self):
        self.chart, self.head, self.given = FIRST, "", 0

    def add(self, symbol: str) -> None:
        if self.head is not None and len(self.head) < SHARED:
            self.head += symbol
            self.chart = _after(self.head)
        else:
            self.head = None
            self.chart = _advance(FIRST, self.chart, symbol)

    def _line(self, end: Edit | None) -> list[Edit]:
        out = []
        while end is not None and end.depth > self.given:
            out.append(end)
            end = end.before
        self.given += len(out)
        return out[::-1]

    def settled(self) -> list[Edit]:
        """Edits that all derivations share and that weren't given yet."""
        live = [v[1] for name in EDITS for _, v in self.chart.waiting.get(name, ())] + [self.chart.done["G"][1]]
        return self._line(functools.reduce(lambda x, y: _shared(x, y)[0], live))

    def finish(self) -> tuple[int, list[Edit]]:
        """The cost of the repair, and its edits that weren't given yet."""
        cost, end = self.chart.done["G"]
        return cost, self._line(end)


def repair(symbols: str) -> tuple[int, str, str]:
    """(cost, audit, the repaired roles' initials) of a sequence of symbols."""
    parse = Parse()
    for s in symbols:
        parse.add(s)
    cost, edits = parse.finish()
    return cost, "".join(e.initial for e in edits), "".join(e.role for e in edits if e.initial != "D")


ROLES = {"u": "user", "a": "assistant"}


class Conversation:
    """One conversation as its rows come by: counts, and the repair's digest or rows."""

    def __init__(self, key, listed: bool):
        self.key, self.parse, self.seen, self.wait, self.listed, self.out = key, Parse(), set(), [], listed, []
        self.first = self.last = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.rows = self.step = 0
        self.audit, self.digest, self.empty = [], hashlib.sha256(), True

    def add(self, turn, role: str, text: str, blank: bool, short: bool) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
        if turn is not None:
            self.first, self.last = (turn if self.first is None else self.first), turn
        self.illegal += self.initial is not None and self.initial + role[:1] not in LEGAL
        self.initial = role[:1]
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        copy = not blank and mark in self.seen
        self.seen.add(mark)
        cut = not blank and not copy and short
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + copy, self.truncated + cut
        kind = role[:1] if role[:1] in ("s", "u", "a") else "-"
        self.parse.add("x" if blank or copy else {"-": "_"}.get(kind, kind.upper()) if cut else kind)
        self.wait.append((role, text))
        self.rows += 1
        if self.rows > HELD:
            self.take(self.parse.settled())

    def take(self, edits: list[Edit]) -> None:
        """Applies edits to the waiting rows."""
        at = 0
        for e in edits:
            role, text = ("", "") if e.initial == "I" else self.wait[at]
            at += e.initial != "I"
            self.audit.append(e.initial)
            self.step += 1
            if self.listed:
                self.out.append((self.key, self.step, e.initial, role if e.initial in "KD" else ROLES[e.role], text))
            if e.initial != "D":
                line = f"{'' if self.empty else chr(10)}{role if e.initial == 'K' else ROLES[e.role]}:{text}"
                self.digest.update(line.encode("utf-8", "surrogatepass"))
                self.empty = False
        del self.wait[:at]

    def finish(self) -> tuple:
        cost, edits = self.parse.finish()
        self.take(edits)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest()


def _conversations(listed: bool):
    """Rows sorted by conversation and turn to one row each, or, ``listed``, to their edited rows."""
    names = ["id", "step", "edit", "role", "text"] if listed else ["id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, kind if n == "id" else pa.string() if isinstance(c[0], str) else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, out, kind = None, [], None
        for batch in batches:
            kind = batch.column("id").type
            for key, there, *row in zip(*(batch.column(c).to_pylist() for c in ("id", "there", "turn", "role", "text", "blank", "short")), strict=True):
                if now is None or key != now.key:
                    if now is not None:
                        end = now.finish()
                        out += now.out if listed else [end]
                    now = Conversation(key, listed)
                if there:
                    now.add(*row)
                if listed and len(now.out) > HELD:
                    out += now.out
                    now.out = []
            if out:
                yield table(out, kind)
                out = []
        if now is not None:
            end = now.finish()
            if rows := now.out if listed else [end]:
                yield table(rows, kind)

    return run


def plain(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Rows (id, there, turn, role, text) with nulls as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return bounded(conversations).select(F.col(conv_col).alias("id"), F.lit(True).alias("there"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))


def damage(rows: DataFrame) -> DataFrame:
    """``plain`` rows damaged by a checksum of id and turn: 0 drops the row (it stays as a mark that its conversation exists), 1 empties
    its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    out = rows.select("id", (F.col("there") & (fault != 0)).alias("there"), "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(fault == 3, 2).otherwise(1).alias("_n"))
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1), "_n"))).drop("_n")


def _faults() -> tuple[Column, Column]:
    """Whether a text is blank, and whether its last visible character ends no sentence."""
    end = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("short")


def _sorted(rows: DataFrame) -> DataFrame:
    """Conversations dealt to tasks, their rows in order."""
    rows = rows.select("id", "there", "turn", "role", "text", *_faults())
    return rows.repartition(partitions(rows.sparkSession), "id").sortWithinPartitions("id", F.asc_nulls_first("turn"), "role", "text")


def repairs(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row a conversation of ``plain`` or damaged rows: id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    kind = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return _sorted(rows).mapInArrow(tidy(_conversations(False)), f"id {kind}, {counts}, audit string, repaired_sha256 string").withColumnRenamed("id", conv_col)


def edited(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(id, step, edit, role, text): every edit of every conversation in order. Rows other than D are the repaired conversation."""
    kind = rows.schema["id"].dataType.simpleString()
    return _sorted(rows).mapInArrow(tidy(_conversations(True)), f"id {kind}, step long, edit string, role string, text string").withColumnRenamed("id", conv_col)
