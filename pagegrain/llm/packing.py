"""Packing by non-negative least squares.

A document's ids (with an end id) are cut into full windows and a rest. Which rests share a window is decided on their
length histogram alone, at most ``window`` numbers: combinations of two or three lengths that fill a window are
enumerated, repeat counts are solved by non-negative least squares against the histogram, rounded down, and what is left is
packed greedily, cutting a rest where nothing fits a gap. The plan is a bounded table of rank intervals; documents find
their places from their rank among the documents of one rest length, counted by salted groups, so one
common length never meets in one task.

Edge cases: a null or empty text is its end id alone; repeated rows are packed each; documents of equal length are ranked
by id, then by content; very long texts are cut like others; an empty table gives no piece. Other columns aren't read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import bounded, cut, partitions, tidy
from .tokens import coder, default_path, with_end

WINDOW = 1024
MAX_SALTS = 1024


def combinations(lengths: np.ndarray, window: int, triples: bool = True) -> list[tuple[int, ...]]:
    """Every pair, and triple, of the lengths (ascending within each) that sums to the window."""
    have = set(lengths.tolist())
    out = [(a, window - a) for a in sorted(have) if a <= window - a and window - a in have]
    if triples:
        ordered = sorted(have)
        out += [(a, b, window - a - b) for a in ordered if 3 * a <= window for b in ordered if a <= b <= window - a - b and window - a - b in have]
    return out


def nnls(combos: list[tuple[int, ...]], target: np.ndarray, sweeps: int = 6) -> np.ndarray:
    """x >= 0 near the least of |Ax - target|, where column k of A counts the lengths of combination k; by coordinate descent."""
    residual = target.astype(float).tolist()
    x = [0.0] * len(combos)
    norm = [float(sum(c.count(m) ** 2 for m in set(c))) for c in combos]
    for _ in range(sweeps):
        for k, c in enumerate(combos):
            move = sum(residual[m] for m in c) / norm[k]
            if move < -x[k]:
                move = -x[k]
            if move:
                x[k] += move
                for m in c:
                    residual[m] -= move
    return np.array(x)


class Plan:
    """Rank intervals of rests and their sequences: rank r of length l in [lo, lo + n) has its part at sequence + r - lo."""

    def __init__(self, histogram: np.ndarray, window: int = WINDOW):
        self.window, self.sequences = window, 0
        self.rows: list[tuple[int, int, int, int, int, int, int]] = []  # length, part start, part length, lo, n, sequence, offset
        self.stock: dict[int, list[list[int]]] = {l: [[l, 0, 0, int(histogram[l])]] for l in range(1, window) if histogram[l]}
        self.count = np.array(histogram[:window], np.int64)
        self.count[0] = 0
        self._solve()
        self._greedy()
        table = np.array(sorted(self.rows), np.int64).reshape(-1, 7)
        self.table = table
        self.span = np.searchsorted(table[:, 0], np.arange(window + 1))

    def _take(self, length: int, n: int, offset: int) -> None:
        """The next n rests of a length into the next n sequences."""
        self.count[length] -= n
        done, queue = 0, self.stock[length]
        while done < n:
            l, start, lo, have = queue[-1]
            k = min(have, n - done)
            self.rows.append((l, start, length, lo, k, self.sequences + done, offset))
            done += k
            if k == have:
                queue.pop()
            else:
                queue[-1] = [l, start, lo + k, have - k]

    def _place(self, members: list[int], n: int) -> None:
        offset = 0
        for m in members:
            self._take(m, n, offset)
            offset += m
        self.sequences += n

    def _solve(self) -> None:
        lengths = np.flatnonzero(self.count)
        combos = combinations(lengths, self.window)
        x = nnls(combos, self.count)
        for k in np.argsort(-x, kind="stable"):
            n = int(x[k])
            if n < 1:
                break
            members, times = np.unique(combos[k], return_counts=True)
            n = min(n, int((self.count[members] // times).min()))
            if n:
                self._place(list(combos[k]), n)

    def _greedy(self) -> None:
        while len(left := np.flatnonzero(self.count)):
            members, gap, used = [], self.window, np.zeros(self.window, np.int64)
            while gap:
                fits = left[: np.searchsorted(left, gap, "right")]
                fits = fits[self.count[fits] > used[fits]]
                if not len(fits):
                    break
                members.append(int(fits[-1]))
                used[fits[-1]] += 1
                gap -= int(fits[-1])
            distinct = np.flatnonzero(used)
            n = int((self.count[distinct] // used[distinct]).min())
            larger = left[(left > gap) & (self.count[left] > used[left])]
            if gap and len(larger):  # one is cut to close the gap
                cut = int(larger[0])
                n = min(n, int(self.count[cut] // (used[cut] + 1)))
                self._split(cut, gap, n)
                members.append(gap)
            self._place(members, n)

    def _split(self, length: int, first: int, n: int) -> None:
        """Cuts the next n rests of a length after ``first`` ids."""
        self.count[length] -= n
        queue = self.stock[length]
        while n:
            l, start, lo, have = queue.pop()
            k = min(have, n)
            if have > k:
                queue.append([l, start, lo + k, have - k])
            for part, at in ((first, start), (length - first, start + first)):
                self.stock.setdefault(part, []).append([l, at, lo, k])
                self.count[part] += k
            n -= k

    def parts(self, length: int, rank: int) -> np.ndarray:
        """Rows (part start, part length, sequence, offset) of one rest."""
        rows = self.table[self.span[length] : self.span[length + 1]]
        rows = rows[(rows[:, 3] <= rank) & (rank < rows[:, 3] + rows[:, 4])]
        return np.stack((rows[:, 1], rows[:, 2], rows[:, 5] + rank - rows[:, 3], rows[:, 6]), axis=1)


def _tokenised(path: str, end: int):
    """Ids of whole texts with the end id, as compressed 16-bit numbers."""

    def run(batches):
        for batch in batches:
            for lo, hi, ids, bounds in coder(path).encode(batch.column("text")):
                ids, bounds = with_end(ids, bounds, end)
                blobs = [pa.compress(ids[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), pa.array(blobs, pa.binary()), pa.array(np.diff(bounds)), batch.column("salt").slice(lo, hi - lo)], ["id", "ids", "n", "salt"])

    return run


def _placed(sent, window: int):
    def run(batches):
        plan, ranks, fulls = sent.value
        for batch in batches:
            ids, n, salt, rank, before = batch.column("ids"), *(batch.column(c).to_pylist() for c in ("n", "salt", "rank", "before"))
            take, out = [], [[] for _ in range(6)]
            for i in range(batch.num_rows):
                tokens = np.frombuffer(pa.decompress(ids[i].as_buffer(), 2 * n[i], "zstd"), np.uint16).astype("<u4")
                full, rest = divmod(len(tokens), window)
                group = rest * ranks.shape[1] + salt[i]
                first = plan.sequences + int(fulls.ravel()[group]) + before[i]
                pieces = [(k * window, window, first + k, 0) for k in range(full)]
                if rest:
                    pieces += [(full * window + a, k, s, o) for a, k, s, o in plan.parts(rest, int(ranks[rest, salt[i]]) + rank[i]).tolist()]
                for a, k, s, o in pieces:
                    take.append(i)
                    for column, value in zip(out, (a, k, zlib.crc32(tokens[a : a + k].tobytes()), len(tokens), s, o), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(take, pa.int64())), *(pa.array(c, pa.int64()) for c in out)], ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = 0, id_col: str = "doc_id") -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path, spark = path or default_path(), docs.sparkSession
    salts = min(MAX_SALTS, max(16, partitions(spark)))
    rows = bounded(docs).select(F.col(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # copies of a row are parted by the input's partition; the salt is written with the ids, so it's drawn once
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(salts)))
    held = cut(rows.mapInArrow(tidy(_tokenised(path, end)), f"id {kind}, ids binary, n long, salt long"))
    held = held.withColumns({"rest": F.col("n") % window, "full": F.floor(F.col("n") / window)})
    counts = held.groupBy("rest", "salt").agg(F.count("*").alias("docs"), F.sum("full").alias("full")).collect()  # window * salts rows at most
    docs_of, full_of = np.zeros((window, salts), np.int64), np.zeros((window, salts), np.int64)
    for r in counts:
        docs_of[r["rest"], r["salt"]], full_of[r["rest"], r["salt"]] = r["docs"], r["full"]
    plan = Plan(docs_of.sum(axis=1), window)
    plan.stock = None
    plan.rows = None
    ranks = np.cumsum(docs_of, axis=1) - docs_of
    fulls = (np.cumsum(full_of.ravel()) - full_of.ravel()).reshape(full_of.shape)
    sent = spark.sparkContext.broadcast((plan, ranks, fulls))
    group = Window.partitionBy("rest", "salt").orderBy("id", "n", F.crc32("ids"))
    before = F.sum("full").over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("full")
    held = held.withColumns({"rank": F.row_number().over(group) - 1, "before": before})
    out = held.select("id", "ids", "n", "salt", "rank", "before").mapInArrow(tidy(_placed(sent, window)), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)

