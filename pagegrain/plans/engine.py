"""One object with the service's operations, over tables of a folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grounding as O
from ..functions import text as T
from ..operators import catalog as C
from ..operators import context as X
from ..operators import pooling as P
from ..operators import maps as M
from ..operators import regions as R
from ..operators import search as S
from ..sources import models
from ..sources.tables import cut
from . import retrieval as Q
from .store import Store

#: The tables of an index. Grids, pooled vectors and sign codes are made when pages are indexed, for searches to read.
TABLES = {
    "points": "page_id bigint, document_id string, filename string, page_number int, total_pages int, image_url string",
    "patches": "page bigint, idx int, px int, py int, vec array<double>",
    "rows": "page bigint, idx int, vec array<double>",
    "columns": "page bigint, idx int, vec array<double>",
    "codes": "page bigint, code array<bigint>",
    "regions": "page bigint, region_id string, ord int, label string, x1 int, y1 int, x2 int, y2 int, content string, image_index int",
    "grids": "page bigint, nx int, ny int, width double, height double, error string",
}


class Engine:
    """Tables below ``root``, which change together (``store.Store``). Models are factories, made once a task.

    A page's grid and size are its own where the indexed pages have columns ``width`` and ``height`` (and ``nx`` and ``ny``, else a grid is
    estimated); the engine's are those of pages that say nothing.
    """

    def __init__(self, spark: SparkSession, root: str, embedder: Callable[[], models.Embedder] = models.HashEmbedder, nx: int = 5, ny: int = 4, width: int = 500, height: int = 400):
        self.spark, self.root, self.embedder, self.grid = spark, root.rstrip("/"), embedder, (nx, ny, width, height)
        self.store = Store(spark, self.root, TABLES, {"points": "page_id"})

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def initialise(self) -> None:
        """Nothing has to be there before the first batch; a folder that can't be read raises now."""
        self.store.state()

    def _sizes(self, pages: DataFrame) -> DataFrame:
        """(page, nx, ny, width, height) as the pages say, or as the engine does where they say nothing."""
        said = lambda c: F.col(c) if c in pages.columns else F.lit(None).cast("double")
        silent = said("width").isNull() & said("height").isNull() & said("nx").isNull() & said("ny").isNull()
        return pages.select(F.col("page_id").alias("page"), *(F.when(silent, F.lit(v)).otherwise(said(c)).cast("int" if c[0] == "n" else "double").alias(c) for c, v in zip(R.GRID, self.grid, strict=True)))

    def index(self, pages: DataFrame, ocr: Callable[[], Callable] | None = None) -> DataFrame:
        """Puts pages (point columns and ``image``) in the place of those of the same id, in all tables at once: points, grids, vectors, their pooled
        rows and columns and sign codes, and OCR regions (none without an engine). Returns the rows that failed: (page_id, stage, error)."""
        pages = cut(pages.withColumn("page_id", F.col("page_id").cast("long")))
        vectors = cut(models.embed(pages, "image", self.embedder, "page_id"))
        good = vectors.where("error is null").select(F.col("page_id").alias("page"), "idx", "vec")
        grids = cut(R.page_grids(self._sizes(pages), good.groupBy("page").agg(F.count("*").alias("n"))))
        usable = grids.select("page", "nx", "ny").where("nx is not null and ny is not null")
        placed = P.grid_places(good.join(usable, "page", "left"), F.col("nx"), F.col("ny"), check=False)
        placed = cut(placed.select("page", "idx", "px", "py", "vec"))
        dim = vectors.where("vec is not null").select(F.size("vec")).first()
        raw, regions = self._read(pages, grids, ocr)
        rows = {"points": pages.select("page_id", "document_id", "filename", "page_number", "total_pages", "image_url"), "patches": placed, "codes": S.codes(placed, dim[0] if dim else 1), "regions": regions, "grids": grids}
        self.store.put({**rows, "rows": P.pool(placed, "py", False), "columns": P.pool(placed, "px", False)}, pages.select(F.col("page_id").alias("page")))
        failed = vectors.where("error is not null").select("page_id", F.lit("embedding").alias("stage"), "error")
        failed = failed.union(grids.where("error is not null").join(good.select("page").distinct(), "page", "left_semi").select("page", F.lit("grid"), "error"))
        return failed if raw is None else failed.union(raw.where("error is not null").select("page_id", F.lit("ocr"), "error"))

    def _read(self, pages: DataFrame, grids: DataFrame, ocr: Callable[[], Callable] | None, task: str = "markdown", mode: str | None = None) -> tuple[DataFrame | None, DataFrame]:
        """(texts with errors, regions) of pages, with each page's own size."""
        if ocr is None:
            return None, self.spark.createDataFrame([], TABLES["regions"])
        raw = cut(models.ocr(pages, "image", ocr, "page_id", task, mode))
        sized = raw.where("error is null").select(F.col("page_id").alias("page"), "raw").join(grids.select("page", "width", "height"), "page")
        found = O.regions(sized, "raw", "width", "height", "page")
        return raw, found.select("page", "region_id", "ord", "label", "x1", "y1", "x2", "y2", "content", "image_index")

    def read_text(self, pages: DataFrame, ocr: Callable[[], Callable], task: str = "markdown", mode: str | None = None) -> DataFrame:
        """Puts the OCR regions of pages (page_id and ``image``) in the place of those that they have; nothing else of a page changes.
        Returns the rows that failed; they have no regions then."""
        pages = cut(pages.withColumn("page_id", F.col("page_id").cast("long")))
        raw, found = self._read(pages, self.table("grids"), ocr, task, mode)
        self.store.put({"regions": found}, pages.select(F.col("page_id").alias("page")))
        return raw.where("error is not null").select("page_id", F.lit("ocr").alias("stage"), "error")

    def compact(self, ranges: Iterable[int] | None = None) -> int:
        """Merges what batches added into ranges of pages; to be run beside indexing. Returns the ranges written."""
        return self.store.compact(ranges)

    def queries(self, texts: Mapping[int, str]) -> DataFrame:
        rows = self.spark.createDataFrame(list(texts.items()), "query_id long, text string")
        return cut(models.embed(rows, "text", self.embedder, "query_id").where("vec is not null").select("query_id", F.col("idx").alias("token"), "vec"))  # embedded once a search

    def search(self, texts: Mapping[int, str], options: Q.Options = Q.Options(), conditions: Mapping[str, object] | None = None, include_ocr: bool = False) -> DataFrame:
        """Ranked pages with metadata and label, and with their selected regions where asked for. Conditions hold for pages and regions, in every kind of search."""
        return self.search_tokens(self.queries(texts), options, conditions, include_ocr)

    def search_tokens(self, queries: DataFrame, options: Q.Options = Q.Options(), conditions: Mapping[str, object] | None = None, include_ocr: bool = False) -> DataFrame:
        """``search`` for query tokens (query_id, token, vec)."""
        meta, patches = self.table("points").withColumnRenamed("page_id", "page"), self.table("patches")
        stored = {"rows": self.table("rows"), "columns": self.table("columns"), "coded": self.table("codes")}
        ranked = Q.search(patches, queries, options, pages=meta, conditions=conditions, **stored)
        ranked = cut(ranked) if include_ocr else ranked
        found = S.with_metadata(ranked, meta, T.page_label(F.col("filename"), F.col("page_number"), F.col("total_pages")))
        if not include_ocr:
            return found
        regions = self.table("regions")
        scored = Q.search_regions(patches, regions, queries, options=options, grids=self.table("grids"), found=ranked)
        kept = scored.select("query_id", "page", "region_id", F.col("score").alias("relevance"), F.col("rank").alias("r")).join(regions, ["page", "region_id"])
        kept = kept.groupBy("query_id", "page").agg(F.array_sort(F.collect_list(F.struct("r", "region_id", "label", "content", "relevance"))).alias("regions"))
        return found.join(kept, ["query_id", "page"], "left")

    def similarity_maps(self, texts: Mapping[int, str], page: int | Iterable[int]) -> DataFrame:
        """(query_id, token, page, px, py, sim) of one page, or of several; patches beyond a page's grid have no place and no row."""
        wanted = [page] if isinstance(page, int) else list(page)
        return S.similarities(self.table("patches").where(F.col("page").isin(wanted) & F.col("px").isNotNull()).select("page", "px", "py", "vec"), self.queries(texts))

    def context(self, texts: Mapping[int, str], options: Q.Options = Q.Options(), conditions: Mapping[str, object] | None = None) -> DataFrame:
        """(query_id, context) of each query's pages, from their regions' contents."""
        found = self.search(texts, options, conditions)
        pages = self.table("regions").where(~F.lower("label").isin(*T.CONTEXT_IMAGE_LABELS) & (F.coalesce("content", F.lit("")) != ""))
        pages = pages.groupBy("page").agg(X.joined(F.col("content"), F.col("ord"), "\n\n").alias("text"))
        asked = self.spark.createDataFrame(list(texts.items()), "query_id long, _text string")
        return X.build(found.join(pages, "page", "left").join(asked, "query_id"), F.col("_text"))

    def status(self) -> DataFrame:
        return C.collection_status(self.table("points"), {"original": len(self.embedder()(["x"])[0][0])})

    def clear(self) -> dict[str, int]:
        """Empties all tables at once, then deletes their files: {deleted, failed}."""
        self.store.clear()
        done = [C.delete_prefix(self.spark, f"{self.root}/{n}") for n in ("runs", "base")]
        return {k: sum(d[k] for d in done) for k in ("deleted", "failed")}

    def register(self, texts: Mapping[int, str], name: str = "search_results") -> None:
        """The search as a view, for SQL."""
        self.search(texts).createOrReplaceTempView(name)

    def relevance(self, texts: Mapping[int, str], aggregate: str = "iou_weighted") -> DataFrame:
        """Scores of all regions of all pages."""
        regions = self.table("regions").join(self.table("grids").select("page", *R.GRID), "page", "left")
        return M.region_scores(self.table("patches").where("px is not null"), regions, self.queries(texts), aggregate=aggregate)
