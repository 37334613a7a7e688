"""The whole search plan: rank pages, carry similarity onto their regions, select regions, build contexts."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import regions as R
from ..operators import search as S


#: Digits of a region's score that count, in a cutoff and in the order.
DIGITS = 9


@dataclass(frozen=True)
class Options:
    """Fixed values by default: limits, thresholds and switches of a search."""

    k: int = 10
    prefetch: int = 200
    pooling: bool = False
    quantised: bool = False
    oversampling: float = 2.0
    regions: bool = True
    threshold: float = 0.3
    region_top_k: int = 0
    aggregate: str = "iou_weighted"
    combine: str = "sum"

    @classmethod
    def from_conf(cls, spark, prefix: str = "spark.pagegrain.") -> Options:
        """Options from the session's settings, by name."""
        found = {}
        for name, field in cls.__dataclass_fields__.items():
            value = spark.conf.get(prefix + name, None)
            if value is not None:
                kind = type(field.default)
                found[name] = value.strip().lower() in ("true", "1", "yes", "on") if kind is bool else kind(value)
        return cls(**found)


def search(patches: DataFrame, queries: DataFrame, options: Options = Options(), rows: DataFrame | None = None, columns: DataFrame | None = None, pages: DataFrame | None = None, conditions: Mapping[str, object] | None = None, dim: int | None = None, coded: DataFrame | None = None) -> DataFrame:
    """(query_id, page, score, rank). ``rows``, ``columns`` and ``coded`` are the pooled vectors and sign codes stored at index time.
    ``conditions`` on ``pages`` (or on the patches' own columns) come before any scoring, whatever the kind of search."""
    if conditions:
        kept = (pages if pages is not None else patches).where(S.payload_filter(conditions)).select("page").distinct()
        patches, rows, columns, coded = (d if d is None else d.join(kept, "page", "left_semi") for d in (patches, rows, columns, coded))
    if options.pooling:
        return S.two_stage(patches, rows, columns, queries, options.k, options.prefetch, options.combine)
    if options.quantised:
        return S.quantised(patches, queries, dim, options.k, options.oversampling, combine=options.combine, coded=coded)
    return S.search(patches, queries, options.k, combine=options.combine)


def search_regions(patches: DataFrame, regions: DataFrame, queries: DataFrame, nx: int | None = None, ny: int | None = None, width: float | None = None, height: float | None = None, options: Options = Options(), rows: DataFrame | None = None, columns: DataFrame | None = None, coded: DataFrame | None = None, pages: DataFrame | None = None, conditions: Mapping[str, object] | None = None, grids: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(query_id, page, page_rank, page_score, region_id, score, rank): the selected regions of each query's pages, as one plan.

    The geometry is that of all pages, or ``grids`` (page, nx, ny, width, height), each page's own. ``found``: pages that a search has found.
    """
    queries = S.held(queries)
    found = search(patches, queries, options, rows, columns, pages, conditions, coded=coded) if found is None else found
    found = found.select("query_id", "page", F.col("rank").alias("page_rank"), F.col("score").alias("page_score"))
    pairs = found.select("query_id", "page")
    # a page's patches meet the tokens of the queries that found it, and no others
    scores = S.patch_scores_of(patches, queries, pairs)
    wanted = regions.join(pairs.select("page").distinct(), "page", "left_semi")
    if grids is not None:
        wanted = wanted.join(grids.select("page", *R.GRID), "page", "left")
        nx = ny = width = height = None
    # sums in another order differ beyond these digits, and equal scores go by region
    scored = R.relevance(wanted, scores, nx, ny, width, height, options.aggregate).withColumn("score", F.round("score", DIGITS))
    kept = R.select(scored, "none", top_k=options.region_top_k, threshold=options.threshold if options.regions else None)
    return found.join(kept, ["query_id", "page"]).select("query_id", "page", "page_rank", F.col("page_score"), "region_id", "score", "rank")
