"""Patch similarity carried onto regions, thresholds and selection.

Regions meet patches by grid cell: a region is exploded into the cells that its box touches and joined on (page, px, py),
never by a range condition, so the join hashes however many regions and patches there are.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G

PATCH_AGGREGATES = {"max": F.max, "mean": F.avg, "sum": F.sum}


def patch_scores(sims: DataFrame, aggregate: str = "max") -> DataFrame:
    """(query_id, page, px, py, score) over query tokens; an unknown name counts as max."""
    fold = PATCH_AGGREGATES.get(aggregate, F.max)
    return sims.groupBy("query_id", "page", "px", "py").agg(fold("sim").alias("score"))


def place_maps(maps: DataFrame, layout: str = "xy") -> DataFrame:
    """Nested similarity maps as rows (.., px, py, sim); ``layout`` says which index comes first."""
    if layout not in ("xy", "yx"):
        raise ValueError(f"unknown layout: {layout}")
    rest = [c for c in maps.columns if c != "similarity_map"]
    a, b = ("px", "py") if layout == "xy" else ("py", "px")
    return maps.select(*rest, F.posexplode("similarity_map").alias(a, "_line")).select(*rest, a, F.posexplode("_line").alias(b, "sim"))


#: A page's geometry: patches in x and y, and its size in pixels.
GRID = ("nx", "ny", "width", "height")


def page_grids(pages: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(page, nx, ny, width, height, error): the grid of each page of (page, width, height) and, where known, (nx, ny).

    A page without a known grid has one estimated from its aspect ratio and its number of patches, which ``counts`` (page, n) tells.
    A page whose size or number of patches is missing or not positive, or whose patches are more than its grid holds, has an error, and
    its regions meet no patch; other pages don't notice.
    """
    known = [c if c in pages.columns else F.lit(None).cast("int").alias(c) for c in ("nx", "ny")]
    rows = pages.select(F.col("page").cast("long").alias("page"), F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), *known)
    rows = rows.join(counts.select(F.col("page").cast("long").alias("page"), F.col("n").alias("_n")), "page", "left") if counts is not None else rows.withColumn("_n", F.lit(None).cast("long"))
    sized = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    given = F.coalesce((F.col("nx") > 0) & (F.col("ny") > 0), F.lit(False))
    x, y = G.estimate_grid(F.when(F.col("_n") > 0, F.col("_n")), F.when(sized, F.col("width")), F.when(sized, F.col("height")))
    able = sized & F.coalesce(F.col("_n") > 0, F.lit(False))
    rows = rows.withColumns({"_x": F.when(given, F.col("nx")).when(able, x.cast("int")), "_y": F.when(given, F.col("ny")).when(able, y.cast("int"))})
    error = F.when(~sized, "size is missing or not positive").when(F.col("_x").isNull() | F.col("_y").isNull(), "no patches to estimate a grid from")
    error = error.when(F.col("_n") > F.col("_x") * F.col("_y"), F.format_string("%d patches do not fit a grid of %d x %d", "_n", "_x", "_y"))
    return rows.select("page", F.col("_x").alias("nx"), F.col("_y").alias("ny"), "width", "height", error.alias("error"))


def cells(regions: DataFrame, nx: Column | int | None = None, ny: Column | int | None = None, width: Column | float | None = None, height: Column | float | None = None) -> DataFrame:
    """Regions by the grid cells their boxes touch, each with its IoU with the cell; no cell, no row. The geometry is the regions' own
    columns (GRID), unless it is given; a null or zero in it gives no cell."""
    nx, ny, width, height = (F.col(c) if v is None else v for c, v in zip(GRID, (nx, ny, width, height), strict=True))
    pw, ph = width / nx, height / ny
    x1, y1, x2, y2 = G.patch_range(G.box(), pw, ph, nx, ny)
    at = regions.withColumns({"_x1": x1, "_y1": y1, "_x2": x2, "_y2": y2}).where("_x1 < _x2 and _y1 < _y2")
    at = at.withColumn("px", F.explode(F.sequence(F.col("_x1"), F.col("_x2") - 1))).withColumn("py", F.explode(F.sequence(F.col("_y1"), F.col("_y2") - 1)))
    return at.drop("_x1", "_y1", "_x2", "_y2").withColumn("iou", G.iou(G.box(), G.patch_box(F.col("px"), F.col("py"), pw, ph)))


def relevance(regions: DataFrame, scores: DataFrame, nx: Column | int | None = None, ny: Column | int | None = None, width: Column | float | None = None, height: Column | float | None = None, aggregate: str = "iou_weighted", eps: float = 0.0, min_overlap: float | None = None, keep_invalid: bool = True) -> DataFrame:
    """(query_id, page, region_id, score). Without a geometry for all pages, each region carries its page's (GRID).

    ``iou_weighted``: sum(iou * s) / (sum(iou) + eps), 0 without weight. ``max`` and ``mean``: over the cells the box touches, 0
    without any. ``max_floor``: the greatest over cells of more than ``min_overlap``, not below 0. ``min_overlap`` keeps cells of
    more IoU for the others as well. An unknown aggregation is ``iou_weighted``, with a warning. ``keep_invalid``: regions that meet no cell score 0, else they are left out.
    """
    own = [c for c, v in zip(GRID, (nx, ny, width, height), strict=True) if v is None]
    met = cells(regions.select("page", "region_id", "x1", "y1", "x2", "y2", *own), nx, ny, width, height).drop(*own)
    met = met.join(scores, ["page", "px", "py"])
    if min_overlap is not None or aggregate == "max_floor":
        met = met.where(F.col("iou") > (min_overlap or 0.0))
    weight = F.sum("iou")
    by = {
        "iou_weighted": F.when(weight > 0, F.sum(F.col("iou") * F.col("score")) / (weight + eps)).otherwise(F.lit(0.0)),
        "max": F.max("score"),
        "mean": F.avg("score"),
        "max_floor": F.greatest(F.lit(0.0), F.max("score")),
    }
    if aggregate not in by:
        warnings.warn(f"unknown aggregation {aggregate}: iou_weighted is used", stacklevel=2)
    got = met.groupBy("query_id", "page", "region_id").agg(by.get(aggregate, by["iou_weighted"]).alias("score"))
    if not keep_invalid:
        return got
    queries = scores.select("query_id", "page").distinct()
    return regions.select("page", "region_id").join(queries, "page").join(got, ["query_id", "page", "region_id"], "left").select("query_id", "page", "region_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def select(scored: DataFrame, method: str = "none", percentile: float = 80.0, top_k: int | None = None, threshold: float | None = None, key: tuple[str, ...] = ("query_id", "page"), order: str = "region_id") -> DataFrame:
    """Regions at or above a cutoff of their page, best first, at most top_k; 0 or none: all.

    adaptive: mean + population deviation; percentile: linear, clamped to 0-100; max: the best; none: ``threshold`` if given.
    """
    w = Window.partitionBy(*key)
    if method == "adaptive":
        cutoff = F.avg("score").over(w) + F.stddev_pop("score").over(w)
    elif method == "percentile":
        cutoff = F.percentile("score", F.lit(max(0.0, min(100.0, percentile)) / 100)).over(w)
    elif method == "max":
        cutoff = F.max("score").over(w)
    elif method == "none":
        cutoff = F.lit(float("-inf") if threshold is None else threshold)
    else:
        raise ValueError(f"unknown threshold method: {method}")
    kept = scored.withColumn("_cutoff", cutoff).where(F.col("score") >= F.col("_cutoff")).drop("_cutoff")
    kept = kept.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), order)))
    return kept.where(F.col("rank") <= top_k) if top_k and top_k > 0 else kept
