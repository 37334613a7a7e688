"""Queries of an index: pages with a grid each, filtered searches of every kind, an index that changes by batches; each with its SQL."""

from __future__ import annotations

import base64
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bpe
from ..operators import ivf
from ..operators import maps as M
from ..operators import regions as R
from ..operators import search as S
from ..sources import models
from ..sources import tables as D
from . import retrieval as Q
from .engine import Engine
from .registry import BEST, OVERSAMPLING, PATCHES, QUERY, REGIONS, SCORED, SIMS, _HEAD, _r, query

#: Four geometries of twenty patches, by page.
GEOMETRIES = ((5, 4, 500, 400), (4, 5, 400, 500), (10, 2, 1000, 200), (2, 10, 200, 1000))


def _of(page, k: int):
    return F.element_at(F.array(*(F.lit(g[k]) for g in GEOMETRIES)), (page % len(GEOMETRIES)).cast("int") + 1)


def grids(spark, d) -> DataFrame:
    """(page, nx, ny, width, height, error) of the pages of patches."""
    pages = D.patches(spark, d).select("page").distinct()
    return R.page_grids(pages.select("page", *(_of(F.col("page"), k).alias(c) for k, c in enumerate(R.GRID))))


_GEOMETRY = "geometry AS (SELECT page, " + ", ".join(f"[{', '.join(str(g[k]) for g in GEOMETRIES)}][page % 4 + 1] AS {c}" for k, c in enumerate(R.GRID)) + " FROM (SELECT DISTINCT vec_id // 20 AS page FROM embeddings))"
_PLACED = f"patches AS (SELECT vec_id // 20 AS page, (vec_id % 20) % nx AS px, (vec_id % 20) // nx AS py, label, embedding::DOUBLE[] AS v FROM embeddings JOIN geometry ON page = vec_id // 20)"
_CELLS = """met AS (SELECT b.*, nx, k % nx AS px, k // nx AS py, width::DOUBLE / nx AS pw, height::DOUBLE / ny AS ph FROM boxes b JOIN geometry g USING (page), (SELECT unnest(range(0, 20)) AS k)),
ious AS (SELECT *, i / ((x2 - x1) * (y2 - y1) + pw * ph - i) AS iou FROM (SELECT *, greatest(0, least(x2, (px + 1) * pw) - greatest(x1, px * pw)) * greatest(0, least(y2, (py + 1) * ph) - greatest(y1, py * ph)) AS i FROM met))"""


@query("region_relevance_grids", f"""WITH {_GEOMETRY}, {_PLACED}, {QUERY}, {SIMS}, patch AS (SELECT query_id, page, px, py, max(sim) AS s FROM sims GROUP BY ALL), {REGIONS}, {_CELLS},
r AS (SELECT query_id, doc_id, sum(iou * s) / sum(iou) AS score FROM ious JOIN patch USING (page, px, py) WHERE iou > 0 GROUP BY query_id, doc_id)
SELECT p.query_id, b.page, b.doc_id AS region_id, round(coalesce(r.score, 0), 6) AS score FROM boxes b JOIN (SELECT DISTINCT query_id, page FROM patch) p USING (page) LEFT JOIN r ON r.doc_id = b.doc_id AND r.query_id = p.query_id""")
def region_relevance_grids(spark, d):
    known = grids(spark, d)
    at = D.patches(spark, d).select("page", "idx", "vec").join(known, "page")
    placed = at.select("page", (F.col("idx") % F.col("nx")).alias("px"), F.floor(F.col("idx") / F.col("nx")).cast("int").alias("py"), "vec")
    regions = D.regions(spark, d).join(known.select("page", *R.GRID), "page", "left")
    return M.region_scores(placed, regions, D.queries(spark, d), digits=6)


@query("page_grids", """WITH s AS (SELECT doc_id AS page, (n_chars % 7 * 100)::DOUBLE AS w, (doc_id % 5 * 80)::DOUBLE AS h, n_chars % 300 AS n FROM documents),
g AS (SELECT *, CASE WHEN w > 0 AND h > 0 AND n > 0 THEN w / h END AS a FROM s), y AS (SELECT *, greatest(1, trunc(sqrt(n / a)))::BIGINT AS y0 FROM g)
SELECT page, (CASE WHEN a > 1 THEN ceil(n / y0) WHEN a <= 1 THEN greatest(1, n // y0) END)::INT AS nx, (CASE WHEN a > 1 THEN y0 WHEN a <= 1 THEN ceil(n / greatest(1, n // y0)) END)::INT AS ny, CASE WHEN NOT (w > 0 AND h > 0) THEN 'size is missing or not positive' WHEN a IS NULL THEN 'no patches to estimate a grid from' END AS error FROM y""")
def page_grids(spark, d):
    docs = D.read(spark, d, "documents")
    sizes = docs.select(F.col("doc_id").alias("page"), (F.col("n_chars") % 7 * 100).alias("width"), (F.col("doc_id") % 5 * 80).alias("height"))
    return R.page_grids(sizes, docs.select(F.col("doc_id").alias("page"), (F.col("n_chars") % 300).alias("n"))).select("page", "nx", "ny", "error")


_KEPT = "kept AS (SELECT * FROM patches WHERE page IN (SELECT page FROM patches WHERE label = 3))"
_KEPT_SIMS = "sims AS (SELECT query_id, token, page, px, py, list_cosine_similarity(v, q) AS sim FROM kept, query)"
_RANKED = "SELECT query_id, page, round(score, 6) AS score, rank FROM (SELECT scored.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM scored JOIN near USING (query_id, page)) WHERE rank <= 5"


@query("quantized_filtered", f"""WITH {PATCHES}, {QUERY}, {_KEPT}, bits AS (SELECT query_id, page, token, list_sum(list_transform(range(1, 65), lambda i: ((v[i] > 0) <> (q[i] > 0))::INT)) AS b FROM kept, query),
near AS (SELECT query_id, page FROM (SELECT query_id, page, sum(b) AS b FROM (SELECT query_id, page, token, min(b) AS b FROM bits GROUP BY ALL) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY b, page) <= {5 * OVERSAMPLING}), {_KEPT_SIMS}, {BEST}, {SCORED} {_RANKED}""")
def quantized_filtered(spark, d):
    patches = D.patches(spark, d)
    o = Q.Options(k=5, quantised=True, oversampling=OVERSAMPLING)
    return Q.search(patches, D.queries(spark, d), o, conditions={"label": 3}, coded=S.codes(patches, D.DIM)).withColumns(_r("score"))


@query("filtered_regions", f"""{_HEAD}, r AS (SELECT query_id, doc_id, sum(iou * s) / sum(iou) AS score FROM ious JOIN patch USING (page, px, py) WHERE iou > 0 GROUP BY query_id, doc_id), {BEST}, {SCORED},
sc AS (SELECT p.query_id, b.page, b.doc_id, round(coalesce(r.score, 0), 9) AS score FROM boxes b JOIN (SELECT DISTINCT query_id, page FROM patch) p USING (page) LEFT JOIN r ON r.doc_id = b.doc_id AND r.query_id = p.query_id),
pages AS (SELECT query_id, page, score AS page_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS page_rank FROM scored WHERE page % 3 = 1 QUALIFY page_rank <= 4)
SELECT query_id, page, page_rank, round(page_score, 6) AS page_score, doc_id AS region_id, round(score, 6) AS score FROM sc JOIN pages USING (query_id, page) WHERE score >= 0.1""")
def filtered_regions(spark, d):
    patches = D.patches(spark, d)
    meta = patches.select("page").distinct().withColumn("filename", F.format_string("f%d", F.col("page") % 3))
    same = patches.select("page").distinct().select("page", *(F.lit(v).alias(c) for c, v in zip(R.GRID, (D.NX, D.NY, D.WIDTH, D.HEIGHT), strict=True)))
    got = Q.search_regions(patches, D.regions(spark, d), D.queries(spark, d), options=Q.Options(k=4, threshold=0.1), pages=meta, conditions={"filename": "f1"}, grids=same)
    return got.drop("rank").withColumns(_r("page_score", "score"))


def _pages(spark, d, turned: bool) -> DataFrame:
    """Pages as an engine indexes them, their image the vectors as JSON; ``turned``: the vectors' opposites, to be replaced."""
    vec = F.col("vec").cast("array<double>")
    vec = F.transform(vec, lambda x: -x) if turned else vec
    rows = D.patches(spark, d).select("page", "idx", vec.alias("vec")).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("idx", "vec"))).alias("v"))  # a page's patches
    page = F.col("page")
    return rows.select(page.alias("page_id"), F.lit("d").alias("document_id"), F.format_string("f%d", page % 3).alias("filename"), (page + 1).cast("int").alias("page_number"), F.lit(9).alias("total_pages"),
                       F.when(page % 5 > 0, F.format_string("http://h/%d.png", page)).alias("image_url"), F.to_json(F.transform("v", lambda x: x["vec"])).alias("image"))


def indexed(spark, d) -> Engine:
    """An engine in the shared folder whose index got all pages turned, was merged, got half of them right, and then the rest."""
    engine = Engine(spark, f"{D.shared_folder(spark)}/index-{uuid.uuid4().hex}", models.Written, D.NX, D.NY, D.WIDTH, D.HEIGHT)
    engine.index(_pages(spark, d, True))
    engine.compact()
    for half in (0, 1):
        engine.index(_pages(spark, d, False).where(F.col("page_id") % 2 == half))
    return engine


@query("engine_search", f"""WITH {PATCHES}, {QUERY}, {SIMS}, {BEST}, {SCORED} SELECT query_id, page, round(score, 6) AS score, rank, concat('f1 - Page ', page + 1, ' of 9') AS label, concat('http://h/', page, '.png') AS image_url
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM scored WHERE page % 3 = 1) WHERE rank <= 6 AND page % 5 > 0""")
def engine_search(spark, d):
    found = indexed(spark, d).search_tokens(D.queries(spark, d), Q.Options(k=6), {"filename": "f1"})
    return found.select("query_id", "page", F.round("score", 6).alias("score"), "rank", "label", "image_url")


#: A fixed model: so many vectors are centres; cells that a token probes.
CENTRES, PROBES = 16, 3


def centres(spark, d) -> np.ndarray:
    rows = D.read(spark, d, "embeddings").where(F.col("vec_id") < CENTRES).orderBy("vec_id").select("embedding").collect()
    return ivf._unit(np.array([r["embedding"] for r in rows], np.float64))


@query("ivf_search", f"""WITH {PATCHES}, {QUERY}, centre AS (SELECT vec_id AS cell, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < {CENTRES}),
cells AS (SELECT vec_id // 20 AS page, cell FROM embeddings, centre QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], c), 12) DESC, cell) = 1),
probed AS (SELECT query_id, cell FROM query, centre QUALIFY row_number() OVER (PARTITION BY query_id, token ORDER BY round(list_cosine_similarity(q, c), 12) DESC, cell) <= {PROBES}),
near AS (SELECT DISTINCT query_id, page FROM probed JOIN cells USING (cell)), {SIMS}, {BEST}, {SCORED} {_RANKED}""")
def ivf_search(spark, d):
    model, patches = centres(spark, d), D.patches(spark, d)
    path = f"{D.shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    ivf.write(patches.select("page", "vec"), model, path)
    return ivf.search(ivf.open_cells(spark, path), patches, D.queries(spark, d), model, PROBES, 5).withColumns(_r("score"))


#: A fixed vocabulary: all bytes, and these merges in order. No merge begins with a letter that an apostrophe can take with it.
MERGES = ("i n", "o n", "in g", "e n", "on e", "a n", "an d", "o u", "en t", "a t", "at i", "ati on", "in e", "c h", "ou r", "a u", "u n", "un d", "n d", "e e")


def _vocabulary(spark) -> str:
    """The fixed vocabulary as a file in the shared folder, a line a token."""
    table = [bytes([b]) for b in range(256)] + [m.replace(" ", "").encode() for m in MERGES]
    rows = spark.createDataFrame([(base64.b64encode(t).decode() + f" {k}",) for k, t in enumerate(table)], "value string").coalesce(1)
    path = f"{D.shared_folder(spark)}/ranks-{uuid.uuid4().hex}"
    rows.write.text(path)
    return path


def _token(t: str) -> str:
    return f"chr(1) || '{t}' || chr(2)"


def _merged(wrapped: str) -> str:
    for a, b in (m.split() for m in MERGES):
        wrapped = f"replace({wrapped}, {_token(a)} || {_token(b)}, {_token(a + b)})"
    return wrapped


_BROKEN = r"regexp_replace(coalesce(text, ''), '''(s|t|re|ve|m|ll|d)', chr(3) || '''\1' || chr(3), 'g')"


@query("bpe_token_counts", rf"""WITH w AS (SELECT doc_id, text, regexp_replace({_BROKEN}, '(?s)(.)', chr(1) || '\1' || chr(2), 'g') AS s FROM documents), m AS (SELECT doc_id, text, s, {_merged('s')} AS t FROM w)
SELECT doc_id, (length(t) - length(replace(t, chr(1), '')) - (length(s) - length(replace(s, chr(3), ''))) + coalesce(strlen(text) - length(text), 0))::BIGINT AS n_tokens FROM m""")
def bpe_token_counts(spark, d):
    return bpe.tokens(D.read(spark, d, "documents").select("doc_id", "text"), "text", _vocabulary(spark)).select("doc_id", "n_tokens")
