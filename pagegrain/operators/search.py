"""Late-interaction search: exact, filtered, two-stage and quantised, for any number of queries at once.

Patches are rows (page, .., vec); query tokens are rows (query_id, token, vec). All similarities come from one Arrow kernel,
a matrix product of a batch's vectors and the query tokens, in pieces of bounded size, and each use reduces the product at
once: to the best of a page and token, to a patch's score for a query, to the nearest patches of a token. Up to
``MAX_QUERY_TOKENS`` tokens travel in one broadcast. More are packed into blocks of that many, patches into blocks
too, and every block of one meets every block of the other: a stated query set against all rows, in blocks.

A vector that is null, zero or not of the queries' dimension has no similarity and gives no row. Ids of pages, queries
and tokens are integers.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.arrow import bounded, half_up

#: Query tokens that travel in one broadcast, patches or tokens of a packed block, and bytes of a product held at once.
MAX_QUERY_TOKENS, PACKED, PRODUCT_BYTES = 1 << 15, 4096, 8 << 20


def payload_filter(conditions: Mapping[str, object] | None) -> Column:
    """Equality on every key. Anything but a mapping of names is an error, not an absent filter."""
    if not conditions:
        return F.lit(True)
    if not isinstance(conditions, Mapping) or not all(isinstance(k, str) and k for k in conditions):
        raise ValueError("a filter maps column names to values")
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(v)) for k, v in conditions.items()))


def clamp_k(k: int | None, low: int = 1, high: int | None = None, default: int = 10) -> int:
    k = default if k is None else int(k)
    return max(low, k if high is None else min(high, k))


Emit = Callable[[pa.RecordBatch, np.ndarray, "Tokens"], pa.RecordBatch]


class Tokens:
    """Query tokens in order of their query, as unit rows of a matrix, or as sign codes."""

    def __init__(self, query: np.ndarray, token: np.ndarray, matrix: np.ndarray, codes: bool = False):
        order = np.lexsort((token, query))
        self.query, self.token, matrix = query[order], token[order], matrix[order]
        norm = None if codes else np.linalg.norm(matrix, axis=1)
        keep = slice(None) if codes else norm > 0
        self.query, self.token = self.query[keep], self.token[keep]
        self.matrix = matrix if codes else matrix[keep] / norm[keep, None]
        self.first = np.flatnonzero(np.concatenate(([True], self.query[1:] != self.query[:-1]))) if len(self.query) else np.zeros(0, np.int64)

    def product(self, rows: np.ndarray) -> np.ndarray:
        """Cosines, or for codes the negated numbers of bits that differ."""
        if self.matrix.dtype == np.uint64:
            return -sum(np.bitwise_count(rows[:, k, None] ^ self.matrix[None, :, k]).astype(np.int32) for k in range(rows.shape[1])).astype(np.float64)
        return rows @ self.matrix.T


def _matrix(column: pa.Array, dim: int, codes: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rows that count, and their vectors as unit rows (or their codes)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = pa.compute.list_value_length(column)
    if codes and pa.compute.any(pa.compute.not_equal(size, dim)).as_py():
        raise ValueError(f"stored codes and the queries' differ in width: {pa.compute.max(size).as_py()} and {dim} words")
    ok = np.flatnonzero(pa.compute.equal(size, dim).fill_null(False).to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(ok)).flatten()
    if codes:
        return ok, flat.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, dim)
    m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.linalg.norm(m, axis=1)
    good = np.isfinite(norm) & (norm > 0)  # a null part is not a number
    return ok[good], m[good] / norm[good, None]


def _over(batch: pa.RecordBatch, tokens: Tokens, emit: Emit, codes: bool):
    """What ``emit`` makes of each piece of a batch and its product with the tokens."""
    if not len(tokens.query):
        return
    rows, m = _matrix(batch.column("vec"), tokens.matrix.shape[1], codes)
    rest = batch.drop_columns(["vec"])
    step = max(1, PRODUCT_BYTES // (8 * len(tokens.query)))
    for a in range(0, len(rows), step):
        yield emit(rest.take(pa.array(rows[a : a + step])), tokens.product(m[a : a + step]), tokens)


def _pack(batches):
    """Rows of (blob): up to PACKED rows as one Arrow message."""
    for batch in batches:
        for a in range(0, batch.num_rows, PACKED):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch.slice(a, PACKED))
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["blob"])


def _unpack(blob: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks().to_batches()[0]


def _tokens(rows: pa.RecordBatch, codes: bool) -> Tokens:
    width = len(rows.column("vec")[0])
    flat = rows.column("vec").flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(np.int64).view(np.uint64) if codes else flat.astype(np.float64)
    return Tokens(rows.column("query_id").to_numpy(), rows.column("token").to_numpy(), flat.reshape(-1, width), codes)


def held(queries: DataFrame) -> DataFrame:
    """Query tokens as a local table, so that a plan that reads them more than once makes them once; more than MAX_QUERY_TOKENS stay as they are."""
    table = queries.limit(MAX_QUERY_TOKENS + 1).toArrow()
    return queries.sparkSession.createDataFrame(table, queries.schema) if 0 < table.num_rows <= MAX_QUERY_TOKENS else queries


def few(queries: DataFrame, codes: bool = False) -> Tokens | None:
    """Query tokens to be sent to every task; None where there are more than MAX_QUERY_TOKENS."""
    kind = "array<bigint>" if codes else "array<double>"
    asked = queries.select(F.col("query_id").cast("long"), F.col("token").cast("long"), F.col("vec").cast(kind).alias("vec")).where("vec is not null")
    held = asked.limit(MAX_QUERY_TOKENS + 1).toArrow().combine_chunks()
    if held.num_rows > MAX_QUERY_TOKENS:
        return None
    if not held.num_rows:
        return Tokens(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1)))
    return _tokens(held.to_batches()[0], codes)


def by_page(rows: DataFrame, column: str) -> DataFrame:
    """(page, column): a page's values of a column as one list, pages dealt to as many partitions as there is work for, however small they are: what the kernel makes of
    them is as large as pages times queries."""
    spark = rows.sparkSession
    n = 2 * spark.sparkContext.defaultParallelism
    return rows.select(F.col("page").cast("long").alias("page"), column).repartition(n, "page").groupBy("page").agg(F.collect_list(column).alias(column))


def page_rows(patches: DataFrame) -> DataFrame:
    """(page, patches): whole pages; a patch is (px, py, vec), its place null where the table has none."""
    place = [(F.col(c) if c in patches.columns else F.lit(None)).cast("int").alias(c) for c in ("px", "py")]
    return by_page(patches.select("page", F.struct(*place, "vec").alias("patches")), "patches")


def _vectors(batch: pa.RecordBatch, dim: int, codes: bool = False):
    """The patches of a batch of ``page_rows`` that have a similarity: the row of their page, their vectors, and places (-1: none)."""
    px, py, vec = batch.column("patches").flatten().flatten()
    rows, m = _matrix(vec, dim, codes)
    n = pa.compute.list_value_length(batch.column("patches")).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(batch.num_rows), n)[rows], m, *(c.fill_null(-1).to_numpy(zero_copy_only=False)[rows] for c in (px, py))


def pages_of(batch: pa.RecordBatch, dim: int):
    """(row, vectors, px, py) of each page in a batch of ``page_rows`` that has a vector."""
    row, m, px, py = _vectors(batch, dim)
    if len(row):
        for a, b in zip(*_bounds(row), strict=True):
            yield int(row[a]), m[a:b], px[a:b], py[a:b]


def ranked(patches: DataFrame, queries: DataFrame, k: int, combine: str = "sum", codes: bool = False) -> DataFrame:
    """(query_id, page, score, rank): the k best pages of each query by ``maxsim``. A task scores whole pages and keeps the k best of each query, so
    that no more than those are shuffled."""
    if combine not in ("sum", "mean"):
        raise ValueError(f"unknown combination: {combine}")
    k, tokens = clamp_k(k), few(queries, codes)
    if tokens is None:
        return top(best(patches, queries, codes).groupBy("query_id", "page").agg((F.sum if combine == "sum" else F.avg)("sim").alias("score")), k)

    def run(batches):
        q, dim = len(tokens.first), tokens.matrix.shape[1]
        query, n = tokens.query[tokens.first], np.diff(np.append(tokens.first, len(tokens.query)))
        held_scores, held_pages = np.zeros((q, 0)), np.zeros((q, 0), np.int64)
        for batch in batches if q else ():
            row, m, _, _ = _vectors(batch, dim, codes)
            if not len(row):
                continue
            pages, (first, last) = batch.column("page").to_numpy(), _bounds(row)
            for a, b in _blocks(first, last, max(1, PRODUCT_BYTES // (8 * q))):
                score = np.empty((b - a, q))
                for c, d in _blocks(first[a:b], last[a:b], max(1, PRODUCT_BYTES // (8 * len(tokens.query))), by_rows=True):
                    low, high = first[a + c], last[a + d - 1]
                    score[c:d] = np.add.reduceat(_tops(m[low:high], tokens, first[a + c : a + d] - low), tokens.first, axis=1)
                scores = np.hstack([held_scores, score.T / n[:, None] if combine == "mean" else score.T])
                names = np.hstack([held_pages, np.tile(pages[row[first[a:b]]], (q, 1))])
                order = np.lexsort((names, -scores), axis=-1)[:, :k]
                held_scores, held_pages = np.take_along_axis(scores, order, axis=1), np.take_along_axis(names, order, axis=1)
        width = held_scores.shape[1]
        for a in range(0, q if width else 0, step := max(1, (1 << 18) // max(1, width))):
            part = slice(a, a + step)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query[part], width)), pa.array(held_pages[part].ravel()), pa.array(held_scores[part].ravel())], ["query_id", "page", "score"])

    places = patches.select(F.col("page").cast("long").alias("page"), "vec").where("page is not null")
    return top(bounded(page_rows(places)).mapInArrow(run, "query_id long, page long, score double"), k)


def _tops(m: np.ndarray, tokens: Tokens, first: np.ndarray) -> np.ndarray:
    """Pages by tokens: the best similarity of the rows that begin at each of ``first``. The products of a page of many rows are held in pieces."""
    step = max(1, PRODUCT_BYTES // (8 * len(tokens.query)))
    if len(m) <= step or len(first) > 1:
        return np.maximum.reduceat(tokens.product(m), first, axis=0)
    return np.max([tokens.product(m[a : a + step]).max(axis=0) for a in range(0, len(m), step)], axis=0)[None, :]


def _blocks(first: np.ndarray, last: np.ndarray, most: int, by_rows: bool = False):
    """(from, to) of runs of pages: at most so many, or at most so many rows; one at least."""
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(last, first[a] + most, "right"))) if by_rows else min(a + most, len(first))
        yield a, b
        a = b


def _products(patches: DataFrame, queries: DataFrame, emit: Emit, schema: str, codes: bool = False) -> DataFrame:
    """``emit``'s rows for all patches and query tokens."""
    tokens = few(queries, codes)
    if tokens is not None:
        if not len(tokens.query):
            return patches.sparkSession.createDataFrame([], schema)

        def each(batches):
            for batch in batches:
                yield from _over(batch, tokens, emit, codes)

        return bounded(patches).mapInArrow(each, schema)
    kind = "array<bigint>" if codes else "array<double>"
    asked = queries.select(F.col("query_id").cast("long"), F.col("token").cast("long"), F.col("vec").cast(kind).alias("vec")).where("vec is not null")

    def many(batches):
        for batch in batches:
            for x, y in zip(batch.column("p"), batch.column("q"), strict=True):
                yield from _over(_unpack(x), _tokens(_unpack(y), codes), emit, codes)

    pairs = bounded(patches).mapInArrow(_pack, "blob binary").toDF("p").crossJoin(asked.mapInArrow(_pack, "blob binary").toDF("q"))
    return pairs.mapInArrow(many, schema)


def _ddl(df: DataFrame, leave: tuple[str, ...] = ("vec",)) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in leave)


def similarities(patches: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, token, all patch columns but vec, and sim = cosine: every query token against every patch."""

    def emit(rest: pa.RecordBatch, sims: np.ndarray, tokens: Tokens) -> pa.RecordBatch:
        n, t = sims.shape
        wide = rest.take(pa.array(np.repeat(np.arange(n), t)))
        return pa.RecordBatch.from_arrays([pa.array(np.tile(tokens.query, n)), pa.array(np.tile(tokens.token, n)), *wide.columns, pa.array(sims.ravel())], ["query_id", "token", *rest.schema.names, "sim"])

    return _products(patches, queries, emit, f"query_id long, token long, {_ddl(patches)}, sim double")


def guarded(patches: DataFrame, queries: DataFrame, eps: float = 1e-8, digits: int | None = None) -> DataFrame:
    """query_id, all patch columns but vec, and sim: every vector of the queries against every patch, ``eps`` added to both norms, so that a zero vector
    has 0. A vector that is null, has a null part or another dimension has null."""
    asked = queries.select(F.col("query_id").cast("long"), F.col("vec").cast("array<double>").alias("vec"))
    held = asked.limit(MAX_QUERY_TOKENS + 1).toArrow().combine_chunks()
    if held.num_rows > MAX_QUERY_TOKENS:
        sim = V.cosine(F.col("vec"), F.col("_q"), eps)
        return patches.crossJoin(asked.select("query_id", F.col("vec").alias("_q"))).select("query_id", *(c for c in patches.columns if c != "vec"), (sim if digits is None else F.round(sim, digits)).alias("sim"))
    query = held.column("query_id").combine_chunks() if held.num_rows else pa.array([], pa.int64())
    sizes = pa.compute.list_value_length(held.column("vec")).to_pylist() if held.num_rows else []
    by_size = {}
    for k, size in enumerate(sizes):
        if size is not None:
            by_size.setdefault(size, []).append(k)
    known = {size: (at, _guarded(held.column("vec").take(pa.array(at)), size, eps)) for size, at in by_size.items()}

    def run(batches):
        t = len(query)
        step = max(1, PRODUCT_BYTES // (8 * max(1, t)))
        for batch in batches:
            vec, rest = batch.column("vec"), batch.drop_columns(["vec"])
            of = pa.compute.list_value_length(vec).fill_null(-1).to_numpy(zero_copy_only=False)
            for a in range(0, batch.num_rows if t else 0, step):
                n = min(step, batch.num_rows - a)
                sims = np.full((t, n), np.nan)
                for size, (at, q) in known.items():
                    rows = np.flatnonzero(of[a : a + n] == size)
                    if len(rows):
                        sims[np.ix_(at, rows)] = q @ _guarded(vec.take(pa.array(a + rows)), size, eps).T
                sims = sims if digits is None else half_up(sims, digits)
                wide = rest.take(pa.array(np.tile(np.arange(a, a + n), t)))
                yield pa.RecordBatch.from_arrays([query.take(pa.array(np.repeat(np.arange(t), n))), *wide.columns, pa.array(sims.ravel(), from_pandas=True)], ["query_id", *rest.schema.names, "sim"])

    # a few rows make many: so small a table is dealt to all cores
    return bounded(patches).repartition(2 * patches.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, f"query_id long, {_ddl(patches)}, sim double")


def _guarded(vec: pa.Array, size: int, eps: float) -> np.ndarray:
    """Vectors of one size over their norms and ``eps``; those with a null part are not numbers."""
    flat = (vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec).flatten()
    m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return m / (np.linalg.norm(m, axis=1) + eps)[:, None]


def patch_scores(patches: DataFrame, queries: DataFrame, aggregate: str = "max") -> DataFrame:
    """(query_id, page, px, py, score): each patch's similarities to a query's tokens as one, without a shuffle; an unknown name counts as max."""

    def emit(rest: pa.RecordBatch, sims: np.ndarray, tokens: Tokens) -> pa.RecordBatch:
        n, q = len(sims), len(tokens.first)
        if aggregate in ("mean", "sum"):
            score = np.add.reduceat(sims, tokens.first, axis=1)
            if aggregate == "mean":
                score /= np.diff(np.append(tokens.first, len(tokens.query)))
        else:
            score = np.maximum.reduceat(sims, tokens.first, axis=1)
        wide = rest.take(pa.array(np.repeat(np.arange(n), q)))
        return pa.RecordBatch.from_arrays([pa.array(np.tile(tokens.query[tokens.first], n)), *wide.columns, pa.array(score.ravel())], ["query_id", *rest.schema.names, "score"])

    places = patches.select("page", "px", "py", "vec")
    if queries.limit(MAX_QUERY_TOKENS + 1).count() > MAX_QUERY_TOKENS:  # blocks may part a query's tokens
        fold = {"mean": F.avg, "sum": F.sum}.get(aggregate, F.max)
        return similarities(places, queries).groupBy("query_id", "page", "px", "py").agg(fold("sim").alias("score"))
    return _products(places, queries, emit, f"query_id long, {_ddl(places)}, score double")


def best(patches: DataFrame, queries: DataFrame, codes: bool = False) -> DataFrame:
    """(query_id, page, token, sim): the best similarity of a page's patches to each token.

    Batches are reduced before the shuffle, which carries one row for each page, token and batch at most.
    """

    def emit(rest: pa.RecordBatch, sims: np.ndarray, tokens: Tokens) -> pa.RecordBatch:
        pages, at = np.unique(rest.column("page").to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        top = np.maximum.reduceat(sims[order], np.searchsorted(at[order], np.arange(len(pages))), axis=0)
        t = len(tokens.query)
        return pa.RecordBatch.from_arrays([pa.array(np.tile(tokens.query, len(pages))), pa.array(np.repeat(pages, t)), pa.array(np.tile(tokens.token, len(pages))), pa.array(top.ravel())], ["query_id", "page", "token", "sim"])

    places = patches.select(F.col("page").cast("long").alias("page"), "vec").where("page is not null")
    return _products(places, queries, emit, "query_id long, page long, token long, sim double", codes).groupBy("query_id", "page", "token").agg(F.max("sim").alias("sim"))


def _asked(patches: DataFrame, queries: DataFrame, pairs: DataFrame, columns: tuple[str, ...], reduce_page, schema: str) -> DataFrame | None:
    """``reduce_page``'s rows for each page and the tokens of the queries that ask for it (``pairs``), and for no others; None where tokens are too many to hold."""
    tokens = few(queries)
    if tokens is None:
        return None
    if not len(tokens.query):
        return patches.sparkSession.createDataFrame([], schema)
    by_page = pairs.groupBy(F.col("page").cast("long").alias("page")).agg(F.collect_set(F.col("query_id").cast("long")).alias("_by"))  # of the held queries
    met = patches.select(F.col("page").cast("long").alias("page"), *columns, "vec").join(by_page, "page")

    def run(batches):
        dim = tokens.matrix.shape[1]
        for batch in batches:
            rows, m = _matrix(batch.column("vec"), dim, False)
            if not len(rows):
                continue
            page = batch.column("page").to_numpy()[rows]
            order = np.argsort(page, kind="stable")
            rows, m, page = rows[order], m[order], page[order]
            for a, b in zip(*_bounds(page), strict=True):
                want = np.isin(tokens.query, batch.column("_by")[int(rows[a])].values.to_numpy())
                step = max(1, PRODUCT_BYTES // (8 * max(1, int(want.sum()))))
                for at in range(a, b, step):
                    to = min(at + step, b)
                    sims = m[at:to] @ tokens.matrix[want].T
                    yield reduce_page(int(page[a]), batch.take(pa.array(rows[at:to])), sims, tokens.query[want], tokens.token[want])

    return bounded(met).mapInArrow(run, schema)


def _bounds(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs of equal values, and the places after their last."""
    first = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return first, np.append(first[1:], len(sorted_values))


def maxsim_of(patches: DataFrame, queries: DataFrame, pairs: DataFrame, combine: str = "sum") -> DataFrame:
    """(query_id, page, score) of the pairs (query_id, page) alone: a page meets the tokens of the queries that ask for it."""
    if combine not in ("sum", "mean"):
        raise ValueError(f"unknown combination: {combine}")

    def one(page: int, rest: pa.RecordBatch, sims: np.ndarray, query: np.ndarray, token: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.full(len(query), page)), pa.array(token), pa.array(sims.max(axis=0))], ["query_id", "page", "token", "sim"])

    best_of = _asked(patches, queries, pairs, (), one, "query_id long, page long, token long, sim double")
    if best_of is None:
        wanted = patches.join(pairs.select("page").distinct(), "page", "left_semi")
        return maxsim(wanted, queries, combine).join(pairs, ["query_id", "page"], "left_semi")
    tops = best_of.groupBy("query_id", "page", "token").agg(F.max("sim").alias("sim"))
    return tops.groupBy("query_id", "page").agg((F.sum if combine == "sum" else F.avg)("sim").alias("score"))


def patch_scores_of(patches: DataFrame, queries: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, page, px, py, score) of the pairs (query_id, page) alone: a patch's best similarity to a query's tokens."""

    def one(page: int, rest: pa.RecordBatch, sims: np.ndarray, query: np.ndarray, token: np.ndarray) -> pa.RecordBatch:
        first, _ = _bounds(query)
        n, score = len(sims), np.maximum.reduceat(sims, first, axis=1)
        wide = rest.select(["px", "py"]).take(pa.array(np.repeat(np.arange(n), len(first))))
        return pa.RecordBatch.from_arrays([pa.array(np.tile(query[first], n)), pa.array(np.full(score.size, page)), *wide.columns, pa.array(score.ravel())], ["query_id", "page", "px", "py", "score"])

    kinds = dict(patches.dtypes)
    found = _asked(patches, queries, pairs, ("px", "py"), one, f"query_id long, page long, px {kinds['px']}, py {kinds['py']}, score double")
    if found is not None:
        return found
    wanted = patches.join(pairs.select("page").distinct(), "page", "left_semi")
    return patch_scores(wanted, queries).join(pairs, ["query_id", "page"], "left_semi")


def maxsim(patches: DataFrame, queries: DataFrame, combine: str = "sum") -> DataFrame:
    """(query_id, page, score): for each query token the best cosine over a page's patches, summed or averaged over tokens."""
    if combine not in ("sum", "mean"):
        raise ValueError(f"unknown combination: {combine}")
    return best(patches, queries).groupBy("query_id", "page").agg((F.sum if combine == "sum" else F.avg)("sim").alias("score"))


def global_max(patches: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, page, score): the best cosine of any token and patch."""
    return best(patches, queries).groupBy("query_id", "page").agg(F.max("sim").alias("score"))


def nearest(patches: DataFrame, queries: DataFrame, k: int, order: tuple[str, ...] = ("page", "px", "py")) -> DataFrame:
    """The k patches nearest to each query token, with ``sim`` and ``rank``; ties by the ``order`` columns. Batches give their k best, and all equal to the last of them."""

    def emit(rest: pa.RecordBatch, sims: np.ndarray, tokens: Tokens) -> pa.RecordBatch:
        n, t = sims.shape
        least = np.partition(sims, n - k, axis=0)[n - k] if k < n else np.full(t, -np.inf)
        row, token = np.nonzero(sims >= least)
        kept = rest.take(pa.array(row))
        return pa.RecordBatch.from_arrays([pa.array(tokens.query[token]), pa.array(tokens.token[token]), *kept.columns, pa.array(sims[row, token])], ["query_id", "token", *rest.schema.names, "sim"])

    found = _products(patches, queries, emit, f"query_id long, token long, {_ddl(patches)}, sim double")
    w = Window.partitionBy("query_id", "token").orderBy(F.desc("sim"), *order)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top(scores: DataFrame, k: int, key: str = "query_id", item: str = "page") -> DataFrame:
    """The k best of each query with their rank; ties by item."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), item)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= clamp_k(k))


def top_one(scores: DataFrame, k: int, item: str = "page") -> DataFrame:
    """The k best rows of a single query, without a window."""
    return scores.orderBy(F.desc("score"), item).limit(clamp_k(k))


def search(patches: DataFrame, queries: DataFrame, k: int = 10, pages: DataFrame | None = None, conditions: Mapping[str, object] | None = None, combine: str = "sum") -> DataFrame:
    """Top k pages of each query. The filter on page metadata comes before scoring, so k pages come back where there are k."""
    if conditions:
        source = pages if pages is not None else patches
        kept = source.where(payload_filter(conditions)).select("page").distinct()
        patches = patches.join(kept, "page", "left_semi")
    return ranked(patches, queries, k, combine)


def two_stage(patches: DataFrame, rows: DataFrame, columns: DataFrame, queries: DataFrame, k: int = 10, prefetch: int = 200, combine: str = "sum") -> DataFrame:
    """Union of the best pages by row- and by column-pooled vectors, then exact scores of those alone."""
    queries = held(queries)
    picks = [ranked(pooled, queries, prefetch, combine).select("query_id", "page") for pooled in (rows, columns)]
    return top(maxsim_of(patches, queries, picks[0].union(picks[1]).distinct(), combine), k)


def codes(patches: DataFrame, dim: int, levels: bool = False) -> DataFrame:
    """(page, code): the sign codes of patches, or their levels, to be stored at index time."""
    return patches.select("page", (V.level_code if levels else V.sign_code)(F.col("vec"), dim).alias("code"))


def quantised(patches: DataFrame, queries: DataFrame, dim: int | None = None, k: int = 10, oversampling: float = 2.0, rescore: bool = True, combine: str = "sum", coded: DataFrame | None = None, levels: bool = False) -> DataFrame:
    """Pages by sign codes: for each token the least Hamming distance, the best ceil(k * oversampling) then scored exactly.

    ``levels``: codes of 4 bits a part, and their cosine with the query as it is; they find more. ``coded``: stored codes. ``dim``: parts
    of a vector, the queries' own where it isn't given; stored codes of another width are an error.
    """
    if dim is None:
        first = queries.where("vec is not null").select(F.size("vec")).first()
        dim = first[0] if first else 1
    coded, queries = codes(patches, dim, levels) if coded is None else coded, held(queries)
    asked = queries if levels else queries.select("query_id", "token", V.sign_code(F.col("vec"), dim).alias("vec"))
    stored = coded.select("page", F.col("code").cast("array<double>" if levels else "array<bigint>").alias("vec"))
    if not rescore:
        return ranked(stored, asked, k, codes=not levels)
    candidates = ranked(stored, asked, int(np.ceil(k * max(1.0, oversampling))), codes=not levels).select("query_id", "page")
    return top(maxsim_of(patches, queries, candidates, combine), k)


def without_special(tokens: DataFrame, special: tuple[int, ...], column: str = "token_id") -> DataFrame:
    """Query tokens without those of special ids; places stay as they were."""
    return tokens.where(~F.coalesce(F.col(column).isin(*special), F.lit(False))) if special else tokens


def with_metadata(results: DataFrame, pages: DataFrame, label: Column) -> DataFrame:
    """Results with page metadata and label; those without an image url are dropped after ranking."""
    return results.join(pages, "page").where(F.col("image_url").isNotNull() & (F.col("image_url") != "")).withColumn("label", label)


def attach_ocr(points: DataFrame, ocr: DataFrame, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    """Points with their OCR result where there is one."""
    return points.join(ocr, list(keys), "left")
