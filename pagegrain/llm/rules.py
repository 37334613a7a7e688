"""Quality rules: every rule is evaluated once into a bitmask ledger; policies and ablations read the ledger.

``ledger`` measures each text once and sets bit k of ``failures`` where rule k fails. ``apply_policy`` is one
bitwise AND against a policy's mask, and ``ablate`` counts, from failure masks alone, what each policy would drop and what
each rule drops by itself, with one grouping by mask (at most 2**rules groups) and no second look at the texts.

Edge cases: a null text measures as an empty one (0 words, so it fails ``short``); null ids and repeated rows are
measured row by row; very long texts are measured whole, in blocks; an empty table gives an empty ledger.
Of the input's columns only the id column and the text are read, so clashing names can't matter.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .session import bounded, tidy

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_symbol_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOW = np.zeros(256, bool)
_LOW[97:123] = True
_LOW[128:] = True

_m = F.col
#: Name and condition of failure, by bit. Integer arithmetic only, so every engine agrees.
RULES: tuple[tuple[str, Column], ...] = (
    ("short", lambda: _m("n_words") < 50),
    ("repetitive", lambda: 100 * _m("n_repeat_words") > 50 * _m("n_words")),
    ("symbols", lambda: 100 * _m("n_symbols") > 10 * _m("word_chars")),
    ("long_words", lambda: _m("word_chars") > 15 * _m("n_words")),
    ("short_words", lambda: _m("word_chars") < 2 * _m("n_words")),
    ("dup_lines", lambda: 100 * _m("n_dup_lines") > 50 * _m("n_lines")),
    ("shouting", lambda: 100 * _m("n_upper_words") > 60 * _m("n_words")),
)
BASE = ("short", "repetitive")
#: Versioned policies: the rules whose failure drops a document.
POLICIES = {"base": BASE, "v1": (*BASE, "symbols", "long_words", "short_words"), "v2": (*BASE, "symbols", "long_words", "short_words", "dup_lines", "shouting")}
CURRENT = "v2"


def mask(names: tuple[str, ...]) -> int:
    order = [n for n, _ in RULES]
    return sum(1 << order.index(n) for n in names)


def _repeats(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each row, the words that lie in a run of three words found at least twice in that row."""
    n = len(hashes)
    if n < 3:
        return np.zeros(len(off) - 1, np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    inside = row[2:] == row[:-2]
    at = np.flatnonzero(inside)
    key = K.mix(K.combine(hashes, 3)[at] + K.mix(row[at].astype(np.uint64) + np.uint64(7)))
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[at[again] + k] = True
    return K.sums(hit.astype(np.int64), off)


def _lines(b: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Rows' lines with a word, and those of them that equal an earlier one."""
    n_rows, data = b.hi - b.lo, b.data
    newline = data == 10
    breaks = np.flatnonzero(newline)
    starts = np.union1d(b.rows[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    ends = np.minimum(np.append(starts[1:], len(data)), len(data))
    closed = newline[ends - 1] if len(ends) else np.zeros(0, bool)
    ends = ends - closed  # without the \n
    worded = np.searchsorted(b.start, starts) < np.searchsorted(b.start, ends)
    starts, ends = starts[worded], ends[worded]
    row = np.searchsorted(b.rows, starts, "right") - 1
    key = K.mix(K.span_hashes(data, starts, ends) + K.mix(row.astype(np.uint64) + np.uint64(3)))
    _, first = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[first] = False
    return np.bincount(row, minlength=n_rows), np.bincount(row[later], minlength=n_rows)


def measure(texts: pa.Array) -> np.ndarray:
    """One row of ``MEASURES`` for each text."""
    out = np.zeros((len(texts), len(MEASURES)), np.int64)
    for b in K.words(texts):
        lead = (b.data & 0xC0) != 0x80  # bytes that begin a code point
        points = np.concatenate(([0], np.cumsum(lead)))
        upper = np.concatenate(([0], np.cumsum(_UPPER[b.data])))
        low = np.concatenate(([0], np.cumsum(_LOW[b.data])))
        symbol = np.concatenate(([0], np.cumsum(_SYMBOL[b.data])))
        shouted = (upper[b.end] > upper[b.start]) & (low[b.end] == low[b.start])
        marked = symbol[b.end] > symbol[b.start]
        lines, again = _lines(b)
        out[b.lo : b.hi] = np.stack(
            [b.counts, K.sums(points[b.end] - points[b.start], b.off), symbol[b.rows[1:]] - symbol[b.rows[:-1]], again, _repeats(b.hash, b.off), lines, K.sums(shouted.astype(np.int64), b.off), K.sums(marked.astype(np.int64), b.off)],
            axis=1,
        )
    return out


def _measured(fields: int):
    def run(batches):
        for batch in batches:
            got = measure(batch.column(fields))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(fields)), *(pa.array(got[:, k]) for k in range(got.shape[1]))], [*batch.schema.names[:fields], *MEASURES])

    return run


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """``keep`` columns, every measurement and the mask ``failures`` for each row of ``docs``."""
    rows = bounded(docs).select(*keep, *([F.col("text").alias("_kept")] if with_text else []), F.col("text").alias("_text"))
    held = rows.schema.fields[:-1]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held), *(f"{m} long" for m in MEASURES)])
    out = rows.mapInArrow(tidy(_measured(len(held))), schema)
    bits = [F.when(rule(), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)]
    return out.withColumn("failures", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def passes(policy: str = CURRENT, failures: Column | None = None) -> Column:
    return (F.col("failures") if failures is None else failures).bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def apply_policy(led: DataFrame, policy: str = CURRENT) -> DataFrame:
    return led.where(passes(policy))


def ablate(led: DataFrame) -> DataFrame:
    """For each policy and each of its rules: rows, rows dropped, rows that only this rule drops, rows dropped without it."""
    groups = led.groupBy("failures").agg(F.count("*").alias("n"))  # 2**len(RULES) groups at most
    cases = [(p, r, mask(rs), mask((r,))) for p, rs in POLICIES.items() for r in rs]
    cases = led.sparkSession.createDataFrame(cases, "policy string, rule string, policy_mask long, rule_mask long")
    hit = F.col("failures").bitwiseAND(F.col("policy_mask"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return (
        cases.join(F.broadcast(groups), F.lit(True), "left")
        .groupBy("policy", "rule")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), total(hit != 0).alias("n_dropped"), total(hit == F.col("rule_mask")).alias("n_only"), total(hit.bitwiseAND(F.bitwise_not(F.col("rule_mask"))) != 0).alias("n_without"))
    )
