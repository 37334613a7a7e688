"""Whole pages against all queries: what a page and a query make together is reduced where they meet.

A page's patches are one row, and so are its regions; such rows, as large as the input, are all that is shuffled. The kernel makes
a page's patch scores for some queries at a time, and gives the rows of its regions, of those selected, or of its heat map.
A page's patches and regions are held in a task; pieces of products and results are bounded. Where query tokens are more than
``search.MAX_QUERY_TOKENS``, the same rows come from joins.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import bounded, half_up
from . import analysis as A
from . import regions as R
from . import search as S

AGGREGATES = ("iou_weighted", "max", "mean", "max_floor")
#: Numbers of a piece of results, and what sums in another order may differ by.
PIECE, NOISE = 1 << 18, 1e-12


def _pieces(m: np.ndarray, tokens: S.Tokens, weight: int):
    """(query ids, patches by queries: the best similarity to a query's tokens) for some queries at a time; ``weight``: numbers that a query needs beside its tokens."""
    first, q = tokens.first, len(tokens.first)
    longest = int(np.diff(np.append(first, len(tokens.query))).max(initial=1))
    step = max(1, PIECE // max(1, weight, len(m) * longest))
    for a in range(0, q, step):
        b = min(a + step, q)
        low, high = first[a], first[b] if b < q else len(tokens.query)
        yield tokens.query[first[a:b]], np.maximum.reduceat(m @ tokens.matrix[low:high].T, first[a:b] - low, axis=1)


class _Boxes:
    """A page's regions: an id each, and pairs of a region and a patch that its box touches, with their IoU."""

    def __init__(self, ids: np.ndarray, px: np.ndarray, py: np.ndarray, iou: np.ndarray, itself: np.ndarray, at: tuple[np.ndarray, np.ndarray]):
        self.ids, region = np.unique(ids, return_inverse=True)
        self.rows = np.sort(region[itself])  # an id that came twice is two rows
        code = lambda x, y: x.astype(np.int64) << 32 | y.astype(np.int64)
        places = code(*at)
        order = np.argsort(places, kind="stable")
        cells = np.flatnonzero(~itself)
        wanted = code(px[cells], py[cells])
        low, high = (np.searchsorted(places[order], wanted, side) for side in ("left", "right"))
        n = high - low
        cell = np.repeat(np.arange(len(cells)), n)
        patch = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        by = np.argsort(region[cells][cell], kind="stable")
        self.region, self.patch, self.iou = region[cells][cell][by], patch[by], iou[cells][cell][by]

    def scores(self, s: np.ndarray, aggregate: str, eps: float) -> np.ndarray:
        """Regions by queries, from patches by queries; a region that meets no patch has 0."""
        out = np.zeros((len(self.ids), s.shape[1]))
        if not len(self.region):
            return out
        if aggregate in ("max", "max_floor"):
            at, _ = S._bounds(self.region)
            out[self.region[at]] = np.maximum.reduceat(s[self.patch], at, axis=0)
            return np.maximum(out, 0.0) if aggregate == "max_floor" else out
        w = np.zeros((len(self.ids), len(s)))
        np.add.at(w, (self.region, self.patch), np.ones(len(self.region)) if aggregate == "mean" else self.iou)
        total = w.sum(axis=1)
        some = total > 0
        out[some] = (w[some] @ s) / (total[some] + eps)[:, None]
        return out


def _cutoff(scores: np.ndarray, method: str, percentile: float, threshold: float | None) -> np.ndarray:
    if method == "adaptive":
        return scores.mean(axis=0) + scores.std(axis=0)
    if method == "percentile":
        return np.percentile(scores, max(0.0, min(100.0, percentile)), axis=0)
    if method == "max":
        return scores.max(axis=0)
    if method == "none":
        return np.full(scores.shape[1], -np.inf if threshold is None else threshold)
    raise ValueError(f"unknown threshold method: {method}")


def region_scores(
    patches: DataFrame, regions: DataFrame, queries: DataFrame, nx: Column | int | None = None, ny: Column | int | None = None, width: Column | float | None = None, height: Column | float | None = None,
    aggregate: str = "iou_weighted", eps: float = 0.0, min_overlap: float | None = None, digits: int | None = None, select: dict | None = None, shown: int | None = None,
) -> DataFrame:
    """(query_id, page, region_id, score): ``regions.relevance`` of all pages' patches and queries; ``digits`` rounds the scores.

    ``select``: the arguments of ``regions.select``, whose rows with their ``rank`` come back; scores are compared as they are rounded, equal ones go by
    region_id. ``shown`` rounds what was selected.
    """
    if aggregate not in AGGREGATES:
        warnings.warn(f"unknown aggregation {aggregate}: iou_weighted is used", stacklevel=2)
        aggregate = "iou_weighted"
    chosen = {"method": "none", "percentile": 80.0, "top_k": None, "threshold": None} | (select or {})
    _cutoff(np.zeros((1, 1)), chosen["method"], chosen["percentile"], chosen["threshold"])
    tokens = S.few(queries)
    if tokens is None:
        got = R.relevance(regions, S.patch_scores(patches, queries), nx, ny, width, height, aggregate, eps, min_overlap)
        got = got if digits is None else got.withColumn("score", F.round("score", digits))
        got = got if select is None else R.select(got, **select)
        return got if shown is None else got.withColumn("score", F.round("score", shown))
    own = [c for c, v in zip(R.GRID, (nx, ny, width, height), strict=True) if v is None]
    boxes = regions.select("page", "region_id", "x1", "y1", "x2", "y2", *own).where("region_id is not null")
    met = R.cells(boxes, nx, ny, width, height).select("page", "region_id", F.col("px").cast("int").alias("px"), F.col("py").cast("int").alias("py"), "iou")
    if min_overlap is not None or aggregate == "max_floor":
        met = met.where(F.col("iou") > (min_overlap or 0.0))
    itself = boxes.select("page", "region_id", F.lit(None).cast("int").alias("px"), F.lit(None).cast("int").alias("py"), F.lit(0.0).alias("iou"))
    rows = S.page_rows(patches).join(S.by_page(itself.unionByName(met).select("page", F.struct("region_id", "px", "py", "iou").alias("r")), "r"), "page")
    kind = regions.schema["region_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            flat = batch.column("r").flatten()
            ids, px, py, iou = flat.flatten()
            bare = px.is_null().to_numpy(zero_copy_only=False)
            ids, px, py, iou = ids.to_numpy(zero_copy_only=False), *(c.fill_null(-1).to_numpy(zero_copy_only=False) for c in (px, py)), iou.to_numpy(zero_copy_only=False)
            ends = np.cumsum(pa.compute.list_value_length(batch.column("r")).to_numpy(zero_copy_only=False))
            for i, m, *at in S.pages_of(batch, tokens.matrix.shape[1]):
                part = slice(ends[i - 1] if i else 0, ends[i])
                page = _Boxes(ids[part], px[part], py[part], iou[part], bare[part], at)
                n, names = len(page.rows), page.ids[page.rows]
                for query, s in _pieces(m, tokens, max(n, len(page.region))):
                    score = page.scores(s, aggregate, eps)[page.rows]
                    score = score if digits is None else half_up(score, digits)
                    if select is None:
                        columns = [np.repeat(query, n), pa.array(np.tile(names, len(query)), batch.schema.field("r").type.value_type.field("region_id").type), score.T.ravel()]
                    else:
                        order = np.argsort(-score, axis=0, kind="stable")
                        score = np.take_along_axis(score, order, axis=0)
                        cut = _cutoff(score, chosen["method"], chosen["percentile"], chosen["threshold"])
                        kept = score >= cut - NOISE
                        if chosen["top_k"] and chosen["top_k"] > 0:
                            kept[chosen["top_k"] :] = False
                        of, rank = np.nonzero(kept.T)
                        score = score[rank, of]
                        columns = [query[of], pa.array(names[order[rank, of]], batch.schema.field("r").type.value_type.field("region_id").type), score if shown is None else half_up(score, shown), (rank + 1).astype(np.int32)]
                    columns.insert(1, pa.repeat(batch.column("page")[i], len(columns[0])))
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["query_id", "page", "region_id", "score", "rank"][: len(columns)])

    return bounded(rows).mapInArrow(run, f"query_id long, page long, region_id {kind}, score double" + ("" if select is None else ", rank int"))


def heat(patches: DataFrame, queries: DataFrame, digits: int | None = None) -> DataFrame:
    """(query_id, page, px, py, normal, heat): each page's patch scores for each query, min-max within the page, and above 0 over the page's greatest."""
    tokens = S.few(queries)
    if tokens is None:
        got = A.heat(A.normalise(S.patch_scores(patches, queries), "score", "query_id", "page"), "score", "query_id", "page").drop("score")
        return got if digits is None else got.withColumns({c: F.round(c, digits) for c in ("normal", "heat")})

    def run(batches):
        for batch in batches:
            for i, m, px, py in S.pages_of(batch, tokens.matrix.shape[1]):
                n = len(m)
                places = [pa.array(c, pa.int32(), mask=c < 0) for c in (px, py)]
                for query, s in _pieces(m, tokens, n):
                    low, high, up = s.min(axis=0), s.max(axis=0), np.maximum(s, 0.0)
                    wide = high > low
                    normal, hot = np.where(wide, (s - low) / np.where(wide, high - low, 1.0), 0.0), up / (up.max(axis=0) + 1e-8)
                    if digits is not None:
                        normal, hot = half_up(normal, digits), half_up(hot, digits)
                    again = pa.array(np.tile(np.arange(n), len(query)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query, n)), pa.repeat(batch.column("page")[i], n * len(query)), *(c.take(again) for c in places), pa.array(normal.T.ravel()), pa.array(hot.T.ravel())], ["query_id", "page", "px", "py", "normal", "heat"])

    return bounded(S.page_rows(patches)).mapInArrow(run, "query_id long, page long, px int, py int, normal double, heat double")
