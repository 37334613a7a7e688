"""Repair of conversations against a search over all edits, and the query's rows against plain Python."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagegrain.llm import conversations as C

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(symbols):
    """(cost, audit) by uniform-cost search."""
    queue, done = [(0, "", 0, 0)], set()
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if i == len(symbols) and state in (0, 3):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        s = symbols[i] if i < len(symbols) else None
        short = 5 if s and s in "SUA_" else 0
        for role, to in NEXT[state].items():
            if role != "s":
                heapq.heappush(queue, (cost + 5, audit + "I", i, to))
            if s and s != "x":
                if s.lower() == role:
                    heapq.heappush(queue, (cost + short, audit + "K", i + 1, to))
                elif role != "s":
                    heapq.heappush(queue, (cost + 1 + short, audit + "R", i + 1, to))
        if s:
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, state))


def check(symbols):
    cost, audit, roles = C.repair(symbols)
    assert (cost, audit) == cheapest(symbols)
    assert re.fullmatch("(s?(ua)+)?", roles)


def test_all_short_sequences():
    for n in range(5):
        for s in itertools.product(C.ANY + "x", repeat=n):
            check("".join(s))


@settings(max_examples=300, deadline=None)
@given(st.text(C.ANY + "xuaua", max_size=40))
def test_longer_sequences(symbols):
    check(symbols)


def test_edits_settle_while_rows_stream():
    rnd = random.Random(2)
    symbols = "".join(rnd.choice(C.ANY + "xuauaua") for _ in range(3000))
    parse, out, most = C.Parse(), [], 0
    for k, s in enumerate(symbols):
        parse.add(s)
        out += parse.settled()
        most = max(most, k + 1 - sum(e.initial != "I" for e in out))
    cost, rest = parse.finish()
    assert (cost, "".join(e.initial for e in out + rest)) == cheapest(symbols)
    assert most < 300


def expected(rows):
    """The query's rows by conversation, from (conv_id, turn, role, text)."""
    kept = {}
    for c, t, role, text in rows:
        kept.setdefault(c, [])
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if role is None else role), (" " if text is None else text)
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        kept[c] += [(t, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = {}
    for c, got in kept.items():
        got.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, symbols, counts = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in got:
            bare = text.strip(" \t\n\x0b\x0c\r")
            kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if kind:
                counts[kind] += 1
            r = role[:1] if role[:1] in ("s", "u", "a") else "-"
            symbols += "x" if kind in ("blank", "duplicate") else (r.upper() if r != "-" else "_") if kind else r
        cost, audit = cheapest(symbols)
        lines, i = [], 0
        for e in audit:
            want = ("user", "assistant")[(len(lines) - (bool(lines) and lines[0][0].startswith("s"))) % 2]
            role, text = ("", "") if e == "I" else got[i][1:]
            i += e != "I"
            if e != "D":
                lines.append((role if e == "K" else want, text))
        turns = {t for t, _, _ in got if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(got))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[c] = (gaps, *counts.values(), illegal, cost, audit, sha)
    return out


@pytest.fixture(scope="module")
def talks():
    rnd = random.Random(4)
    text = lambda: rnd.choice(["Hello.", "Well", "So?", "", " \n", None, "é!", "end… ", "Hello."]) if rnd.random() < 0.5 else f"t{rnd.randrange(10**6)}."
    role = lambda: rnd.choice(["system", "user", "user", "assistant", "assistant", "tool", None, ""])
    rows = [(c, t if rnd.random() < 0.95 else None, role(), text()) for c in range(60) for t in range(rnd.randrange(1, 9))]
    rows += [(100, t, ("user", "assistant")[t % 2], f"{t}{text()}") for t in range(900)] + [(None, 0, "user", "x."), (None, 1, "assistant", "y."), (101, 5, "user", "z" * 100_000 + ".")]
    rows += [(102 + k, 0, "user", "gone.") for k in range(40)] + rows[:5]
    return rows


def test_query_rows(spark, talks):
    schema = "conv_id long, turn long, role string, text string, id int, there string, blank int, key string"
    df = spark.createDataFrame([(*r, 1, "", 2, "") for r in talks], schema).repartition(5)
    rows = C.repairs(C.damage(C.plain(df))).collect()
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    assert len(rows) == len({r.conv_id for r in rows})
    assert {r.conv_id: tuple(r[n] for n in names) for r in rows} == expected(talks)


def test_edited_rows_are_the_repair(spark, talks):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    rows = C.damage(C.plain(df))
    digests = {r.conv_id: (r.audit, r.repaired_sha256) for r in C.repairs(rows).collect()}
    steps = {}
    for r in sorted(C.edited(rows).collect(), key=lambda r: r.step):
        steps.setdefault(r.conv_id, []).append(r)
    for c, (audit, sha) in digests.items():
        mine = steps.get(c, [])
        assert "".join(r.edit for r in mine) == audit
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in mine if r.edit != "D").encode()).hexdigest() == sha


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert C.repairs(C.damage(C.plain(df))).count() == 0
    assert C.edited(C.plain(df)).count() == 0
