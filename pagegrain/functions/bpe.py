"""Byte-pair encoding by a table of ranks: pieces of a text merged by our own algorithm, each distinct piece once a task."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import bounded

#: Fixed value: how such vocabularies cut a text into pieces, within which merges stay.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a task remembers, characters of such a piece at most, and tokens of a vocabulary, which every task has.
CACHED, LONGEST, MAX_TOKENS = 1 << 18, 64, 1 << 20
#: Characters of a text whose pieces are found at once; those of a longer one come one by one.
AT_ONCE = 1 << 20


def ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token to rank, from lines of a base64 token and a number, wherever Spark can read them. Every byte must be a token; there are MAX_TOKENS at most."""
    lines = [r.value.split() for r in spark.read.text(path).where(F.trim("value") != "").limit(MAX_TOKENS + 1).collect()]
    if len(lines) > MAX_TOKENS:
        raise ValueError(f"a vocabulary has {MAX_TOKENS} tokens at most")
    out = {base64.b64decode(a): int(b) for a, b in lines}
    if missing := [b for b in range(256) if bytes([b]) not in out]:
        raise ValueError(f"{len(missing)} bytes are no token")
    return out


def merge(piece: bytes, table: dict[bytes, int]) -> list[int]:
    """Ids of a piece: of all neighbours that make a token, the pair of least rank is joined, the first of equals, until none is left. Pairs wait
    in a heap, so that a long piece takes n log n."""
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    live, heap = [True] * n, []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n and (r := table.get(piece[i : end[after[i]]])) is not None:
            heapq.heappush(heap, (r, i, end[i], end[after[i]]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, middle, to = heapq.heappop(heap)
        if not live[i] or end[i] != middle or after[i] >= n or end[after[i]] != to:
            continue
        j = after[i]
        live[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [table[piece[i : end[i]]] for i in range(n) if live[i]]


def _pieces(table: dict[bytes, int], keep: Callable):
    """A function of a text to what ``keep`` makes of the ids of each of its pieces in turn; the short pieces are remembered."""
    pattern = regex.compile(PIECE)
    known: dict[str, object] = {}

    def pieces(text: str | None):
        text = text or ""
        for piece in pattern.findall(text) if len(text) <= AT_ONCE else (m.group() for m in pattern.finditer(text)):
            kept = known.get(piece)
            if kept is None:
                data = piece.encode("utf-8", "surrogatepass")
                kept = keep([table[data]] if data in table else merge(data, table))
                if len(piece) <= LONGEST:
                    if len(known) >= CACHED:
                        known.clear()
                    known[piece] = kept
            yield kept

    return pieces


def encoder(table: dict[bytes, int]):
    """A function of a text to its ids."""
    pieces = _pieces(table, list)
    return lambda text: list(chain.from_iterable(pieces(text)))


def counter(table: dict[bytes, int]):
    """A function of a text to the number of its ids, which aren't held."""
    pieces = _pieces(table, len)
    return lambda text: sum(pieces(text))


def tokens(rows: DataFrame, text: str, path: str, ids: bool = False) -> DataFrame:
    """The rows with ``n_tokens`` of a text column, and with ``token_ids`` if wanted; a null text has none."""
    kept = [c for c in rows.columns if c not in ("n_tokens", "token_ids")]
    sent = rows.sparkSession.sparkContext.broadcast(ranks(rows.sparkSession, path))

    def run(batches):
        read = (encoder if ids else counter)(sent.value)
        for batch in batches:
            got = [read(x.as_py()) for x in batch.column("_text")]
            columns = [*(batch.column(c) for c in kept), pa.array([len(x) for x in got] if ids else got, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(got, pa.list_(pa.int32()))] if ids else columns, [*kept, "n_tokens", "token_ids"][: len(kept) + 1 + ids])

    schema = T.StructType([rows.schema[c] for c in kept]).add("n_tokens", "long")
    schema = schema.add("token_ids", T.ArrayType(T.IntegerType())) if ids else schema
    return bounded(rows).select(*kept, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)
