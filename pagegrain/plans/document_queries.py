"""Queries of texts, lookups, evaluation files, contexts and progress over the driver tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import grounding as O
from ..functions import text as T
from ..functions import vectors as V
from ..operators import catalog as C
from ..operators import context as X
from ..operators import evaluate as E
from ..operators import joins as J
from ..operators import pooling as P
from ..operators import regions as R
from ..operators import search as S
from ..sources import files
from ..sources import tables as D
from ..streaming import ingest as I
from .registry import BEST, IOU, PATCHES, QUERY, REGIONS, SCORED, SIMS, TRUTH, _detected, _grounded, _r, _region_scores, _scores, query

def _id():
    return F.col("doc_id")


def _docs(spark, d) -> DataFrame:
    return D.read(spark, d, "documents")


def _pick(i, *values: str):
    """The value at i modulo their number, null for None."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (i % len(values)).cast("int") + 1)


def _list(*values: str | None) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _file(spark, name: str) -> str:
    return f"{D.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# search


@query("maxsim_without_special", f"WITH {PATCHES}, query AS (SELECT vec_id // 100 AS query_id, vec_id % 100 AS token, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 < 3 AND label NOT IN (0, 3, 7)), {SIMS}, {BEST}, {SCORED} SELECT query_id, page, round(score, 6) AS score FROM scored")
def maxsim_without_special(spark, d):
    at = F.col("vec_id") % D.QUERY_STEP
    tokens = D.read(spark, d, "embeddings").where(at < 3).select(F.expr(f"vec_id div {D.QUERY_STEP}").alias("query_id"), at.alias("token"), F.col("label").alias("token_id"), F.col("embedding").alias("vec"))
    return S.maxsim(D.patches(spark, d), S.without_special(tokens, (0, 3, 7))).withColumns(_r("score"))


_STEP = "3.0 / 7 / 8"


@query("level_search", f"""WITH {PATCHES}, {QUERY}, coded AS (SELECT page, list_transform(v, lambda x: greatest(-7, least(7, round(x / (sqrt(list_sum(list_transform(v, lambda y: y * y))) * ({_STEP}))))))::DOUBLE[] AS c FROM patches), near AS (SELECT query_id, page FROM (SELECT query_id, page, sum(s) AS s FROM (SELECT query_id, page, token, max(list_cosine_similarity(c, q)) AS s FROM coded, query GROUP BY ALL) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, page) <= 10), {SIMS}, {BEST}, {SCORED} SELECT query_id, page, round(score, 6) AS score, rank FROM (SELECT scored.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM scored JOIN near USING (query_id, page)) WHERE rank <= 5""")
def level_search(spark, d):
    return S.quantised(D.patches(spark, d), D.queries(spark, d), D.DIM, k=5, levels=True).withColumns(_r("score"))


@query("top_one_page", f"WITH {PATCHES}, {QUERY}, {SIMS}, {BEST}, {SCORED} SELECT query_id, page, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM scored) WHERE rank <= 1")
def top_one_page(spark, d):
    return S.top(S.maxsim(D.patches(spark, d), D.queries(spark, d)), 0).withColumns(_r("score"))  # k is 1 at least


@query("results_with_metadata", f"WITH {PATCHES}, {QUERY}, {SIMS}, {BEST}, {SCORED}, ranked AS (SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM scored QUALIFY rank <= 8) SELECT query_id, rank, page, concat(source, ' - Page ', doc_id, ' of 25') AS label, concat('http://h/', doc_id, '.jpg') AS image_url FROM ranked JOIN documents ON doc_id = page WHERE doc_id % 3 > 0")
def results_with_metadata(spark, d):
    url = F.when(_id() % 3 == 1, F.format_string("http://h/%d.jpg", "doc_id")).when(_id() % 3 == 2, F.format_string("http://h/%d.jpg", "doc_id")).when(_id() % 2 == 0, "")
    meta = _docs(spark, d).select(_id().alias("page"), "source", url.alias("image_url"))
    found = S.search(D.patches(spark, d), D.queries(spark, d), 8)
    return S.with_metadata(found, meta, T.page_label(F.col("source"), F.col("page"), F.lit(25))).select("query_id", "rank", "page", "label", "image_url")


@query("guarded_cosine", f"WITH {PATCHES}, {QUERY} SELECT query_id, page, px, py, round(list_dot_product(v, q) / ((sqrt(list_dot_product(v, v)) + 1e-8) * (sqrt(list_dot_product(q, q)) + 1e-8)), 6) AS sim FROM patches, query WHERE token = 0")
def guarded_cosine(spark, d):
    return S.guarded(D.patches(spark, d).select("page", "px", "py", "vec"), D.queries(spark, d).where("token = 0"), 1e-8, digits=6)


@query("valid_vectors", "SELECT vec_id, label <> 4 AND vec_id % 6 <> 5 AS ok FROM embeddings")
def valid_vectors(spark, d):
    vec = F.when(F.col("label") == 4, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 6 == 5, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(None).cast("float")))).otherwise(F.col("embedding"))
    return D.read(spark, d, "embeddings").select("vec_id", V.valid(vec, D.DIM).alias("ok"))


@query("attached_ocr", "SELECT doc_id AS page, source, url FROM documents LEFT JOIN pages ON page_id = doc_id")
def attached_ocr(spark, d):
    return S.attach_ocr(_docs(spark, d).select(_id().alias("page"), "source"), D.read(spark, d, "pages").select(F.col("page_id").alias("page"), "url"))


# grids


@query("grid_with_global_tokens", "SELECT page, idx::INT AS idx, CASE WHEN idx < least(16, n - 4) THEN (idx % 4)::INT END AS px, CASE WHEN idx < least(16, n - 4) THEN (idx // 4)::INT END AS py FROM (SELECT vec_id // 20 AS page, vec_id % 20 AS idx, count(*) OVER (PARTITION BY vec_id // 20) AS n FROM embeddings)")
def grid_with_global_tokens(spark, d):
    rows = D.patches(spark, d).select("page", "idx", "vec")
    return P.grid_places(rows, 4, 4, global_tokens=4, check=False).select("page", "idx", "px", "py")  # a last page may be short


@query("reshaped_scores", "SELECT doc_id, (i % 3)::INT AS px, (i // 3)::INT AS py, CASE WHEN i < doc_id % 8 THEN (i + 1) * 0.5 ELSE 0 END::DOUBLE AS score FROM documents, (SELECT unnest(range(0, 6)) AS i)")
def reshaped_scores(spark, d):
    flat = F.transform(F.slice(F.sequence(F.lit(1), F.lit(8)), 1, (_id() % 8).cast("int")), lambda i: i * 0.5)
    return P.reshape(_docs(spark, d).select("doc_id", flat.alias("scores")), 3, 2)


for _layout, _px, _py in (("xy", "i", "j"), ("yx", "j", "i")):

    @query(f"placed_maps_{_layout}", f"SELECT doc_id, {_px}::INT AS px, {_py}::INT AS py, (doc_id + 10 * i + j)::DOUBLE AS sim FROM documents, (SELECT unnest(range(0, 3)) AS i), (SELECT unnest(range(0, 2)) AS j)")
    def _placed(spark, d, layout=_layout):
        line = lambda i: F.array(*((_id() + 10 * i + j).cast("double") for j in range(2)))
        return R.place_maps(_docs(spark, d).select("doc_id", F.array(*map(line, range(3))).alias("similarity_map")), layout)


@query("patch_places", f"WITH {REGIONS} SELECT doc_id AS region_id, x1 // 100 AS px, y1 // 100 AS py, y1 // 100 * 5 + x1 // 100 AS idx, x1 // 100 * 100.0 AS bx, y1 // 100 * 100.0 + 100 AS by2 FROM boxes")
def patch_places(spark, d):
    px, py = G.pixel_patch(F.col("x1"), F.col("y1"), 100, 100)
    rows = D.regions(spark, d).select("region_id", px.cast("long").alias("px"), py.cast("long").alias("py")).withColumn("idx", G.patch_index(F.col("px"), F.col("py"), D.NX))
    b = G.index_box(F.col("idx"), D.NX, 100.0, 100.0)
    return rows.select("region_id", "px", "py", "idx", b[0].cast("double").alias("bx"), b[3].cast("double").alias("by2"))


@query("clamped", "SELECT doc_id, greatest(100, least(5000, n_chars)) AS n FROM documents")
def clamped(spark, d):
    return _docs(spark, d).select("doc_id", G.clamp(F.col("n_chars"), 100, 5000).alias("n"))


# evaluation


@query("succeeded_summary", f"WITH {TRUTH}, {REGIONS}, {IOU} SELECT round(avg(mean_iou), 6) AS mean_iou, round(avg((mean_iou >= 0.5)::INT), 6) AS iou_at_0_5, count(*) AS n FROM metric WHERE item_id % 7 > 1")
def succeeded_summary(spark, d):
    failed = F.when(F.col("sample_id") % 7 == 0, True).when(F.col("sample_id") % 7 == 2, F.lit(None)).otherwise(F.col("sample_id") % 7 == 1)
    return E.summarise(E.succeeded(_detected(spark, d).withColumn("failed", failed))).withColumns(_r("mean_iou", "iou_at_0_5"))


@query("sample_features", f"""WITH {TRUTH}, {REGIONS}, p AS (SELECT page, count(*) AS n, sum((x2 - x1) * (y2 - y1)) AS a FROM boxes GROUP BY page),
s AS (SELECT item_id, x1, y1, x2 - CASE WHEN item_id % 3 = 0 THEN x2 - x1 ELSE 0 END AS x2, y2 FROM truth WHERE item_id % 7 > 0 AND item_id % 5 > 0),
f AS (SELECT *, ((x2 - x1) * (y2 - y1))::DOUBLE AS area FROM s WHERE x2 > x1)
SELECT item_id AS sample_id, area, round((x2 - x1)::DOUBLE / (y2 - y1), 6) AS aspect, round((x1 + x2) / 2 / 2480, 6) AS center_x, round((y1 + y2) / 2 / 3508, 6) AS center_y, coalesce(n, 0)::INT AS n_pred, coalesce(a, 0)::DOUBLE AS pred_area, round(log10(area + 1), 6) AS log_area, round(coalesce(a, 0) / area, 6) AS area_ratio, round(CASE WHEN item_id % 4 > 0 THEN (1 - item_id::DOUBLE / (item_id % 4 * 100)) * 100 ELSE 0 END, 6) AS token_savings_pct FROM f LEFT JOIN p ON page = item_id % 25""")
def sample_features(spark, d):
    i = F.col("sample_id")
    corners = F.array(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")))
    predicted = D.regions(spark, d).groupBy("page").agg(F.collect_list(corners).alias("pred_boxes"))  # a page's regions
    flat = F.array(F.col("x1").cast("double"), F.col("y1").cast("double"), F.col("x1").cast("double"), F.col("y2").cast("double"))
    gt = F.when(i % 5 == 0, F.array().cast("array<array<double>>")).when(i % 3 == 0, F.array(flat)).otherwise(F.array(corners, flat))
    rows = D.truth(spark, d).select("sample_id", gt.alias("gt_boxes"), (i % 7 == 0).alias("failed"), i.alias("tokens_selected"), (i % 4 * 100).alias("tokens_all_ocr"), (i % D.PAGES).alias("page"))
    rows = rows.join(predicted, "page", "left").drop("page")
    out = E.sample_features(rows).drop("tokens_selected", "tokens_all_ocr")
    return out.withColumns(_r("aspect", "center_x", "center_y", "log_area", "area_ratio", "token_savings_pct"))


def _by_iou() -> str:
    from .registry import ORACLES

    return ORACLES["region_relevance_iou"]


@query("region_relevance_unknown", _by_iou())
def region_relevance_unknown(spark, d):
    return _region_scores(spark, d, "median", digits=6)  # no such aggregation


def _sample_lines(spark, d) -> str:
    """The benchmark as a JSON-lines file, one a row by id; line n is item n."""
    i = F.col("item_id")
    box = F.when(i % 3 == 0, F.format_string('[[%d, 2, %d, 4], [5, 6, 7, 8]]', i, i + 9)).when(i % 3 == 1, F.format_string("[[[%d, 1, 9, 9.5]]]", i)).otherwise(F.lit('[[1, 2, 3], "x"]'))
    question = F.when(i % 4 == 0, F.concat(F.lit('"query":"q'), i, F.lit('"'))).when(i % 4 == 1, F.lit('"question":" "')).otherwise(F.concat(F.lit('"question":"q'), i, F.lit('"')))
    images = F.when(i % 5 == 0, F.lit('"images":[]')).when(i % 5 == 1, F.concat(F.lit('"image_paths":["'), i, F.lit('.png","x"]'))).otherwise(F.concat(F.lit('"images":["'), i, F.lit('.png"]')))
    line = F.concat(F.lit("{"), question, F.lit(","), images, F.lit(',"bbox":'), box, F.lit(',"category":"c'), (i % 4).cast("string"), F.lit('"}'))
    path = _file(spark, "samples")
    D.read(spark, d, "benchmark").orderBy("item_id").select(line.alias("value")).write.text(path)  # parts in order of their names
    return path


@query("evaluation_samples", "SELECT row_number() OVER (ORDER BY item_id)::INT - 1 AS sample_id, CASE WHEN item_id % 4 = 1 THEN ' ' ELSE concat('q', item_id) END AS question, CASE WHEN item_id % 5 > 0 THEN concat(item_id, '.png') END AS image_path, (CASE item_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END)::INT AS n_boxes, CASE WHEN item_id % 3 < 2 THEN item_id::DOUBLE END AS x1, concat('c', item_id % 4) AS category, CASE WHEN item_id % 5 = 0 THEN 'no image' WHEN item_id % 4 = 1 THEN 'blank question' END AS skip FROM benchmark")
def evaluation_samples(spark, d):
    s = files.samples(spark, _sample_lines(spark, d))
    return s.select("sample_id", "question", "image_path", F.size("boxes").alias("n_boxes"), F.get(F.get("boxes", F.lit(0)), F.lit(0)).alias("x1"), "category", "skip")


@query("category_index", "SELECT concat('c', item_id % 4) AS category, list(sample_id ORDER BY sample_id) AS sample_ids FROM (SELECT item_id, row_number() OVER (ORDER BY item_id)::INT - 1 AS sample_id FROM benchmark) GROUP BY 1")
def category_index(spark, d):
    return files.categories(spark, _sample_lines(spark, d))


@query("report_metrics", "SELECT lang AS category, count(*) AS n, round(avg((doc_id % 100) / 100), 6) AS mean_iou, count_if(doc_id % 100 >= 50) AS hits FROM documents GROUP BY lang")
def report_metrics(spark, d):
    path = _file(spark, "report")
    files.write_report(_docs(spark, d).select("doc_id", "lang", (_id() % 100 / 100).cast("double").alias("iou")), path, ["doc_id", "lang", "iou"], "doc_id")
    return files.report_metrics(files.report(spark, path), 1, 2).withColumns(_r("mean_iou"))


@query("run_results", "SELECT 'a' AS model, item_id::INT AS sample_id, item_id % 10 / 10 AS mean_iou, item_id % 7 = 0 AS failed FROM benchmark UNION ALL SELECT 'b', item_id::INT, item_id % 10 / 10, item_id % 7 = 0 FROM benchmark")
def run_results(spark, d):
    i = F.col("item_id")
    one = F.struct(i.cast("int").alias("sample_id"), (i % 10 / 10).alias("mean_iou"), (i % 7 == 0).alias("failed"))
    path = _file(spark, "run")
    parts = D.read(spark, d, "benchmark").groupBy(F.floor(i / 1000).alias("part"))  # a run's files, a thousand samples each at most
    parts.agg(F.to_json(F.struct(F.count_if(i % 7 == 0).alias("failed_count"), F.collect_list(one).alias("sample_results"))).alias("value")).select("part", "value").write.partitionBy("part").text(path)
    return files.runs(spark, {"a": path, "gone": path + "-none", "b": path}).select("model", "sample_id", "mean_iou", "failed")


# lookups


@query("zipped_arrays", "SELECT doc_id, i::INT AS ord, (i + 1) * doc_id AS n, CASE i WHEN 0 THEN lang ELSE source END AS s FROM documents, (SELECT unnest(range(0, 2)) AS i) WHERE i < doc_id % 4")
def zipped_arrays(spark, d):
    n = F.transform(F.slice(F.sequence(F.lit(1), F.lit(4)), 1, (_id() % 4).cast("int")), lambda i: i * _id())
    return J.zipped(_docs(spark, d).select("doc_id", n.alias("x"), F.array("lang", "source").alias("y")), {"x": "n", "y": "s"})


@query("region_crop_urls", f"WITH {REGIONS}, u AS (SELECT page_id % 25 AS page, list(url ORDER BY page_id) AS urls FROM pages GROUP BY 1) SELECT doc_id AS region_id, urls[doc_id % 7 + 1] AS image_url FROM boxes LEFT JOIN u USING (page)")
def region_crop_urls(spark, d):
    urls = D.read(spark, d, "pages").groupBy((F.col("page_id") % 25).alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: x["url"]).alias("urls"))
    regions = D.regions(spark, d).select("page", "region_id", (F.col("region_id") % 7).cast("int").alias("image_index"))
    return J.crop_urls(regions, urls, "page").select("region_id", "image_url")


@query("required_lookup", "SELECT l.doc_id, quality, n_chars FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def required_lookup(spark, d):
    return J.required(D.read(spark, d, "labels").select("doc_id", "quality"), _docs(spark, d), "doc_id", "n_chars")


@query("lookup_or_zero", "SELECT d.doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def lookup_or_zero(spark, d):
    return J.or_zero(_docs(spark, d).select("doc_id"), D.read(spark, d, "labels"), "doc_id", "quality", "toxic")


@query("numbered_pages", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS page_number FROM documents")
def numbered_pages(spark, d):
    return J.numbered_pages(_docs(spark, d).select("source", "doc_id"), "source", "doc_id")


@query("unique_indices", "SELECT doc_id, list_sort(list_distinct([doc_id % 3, doc_id % 2, 1])) AS indices FROM documents")
def unique_indices(spark, d):
    return _docs(spark, d).select("doc_id", J.unique_indices(F.array(_id() % 3, _id() % 2, F.lit(1).cast("long"))).alias("indices"))


@query("without_file", "SELECT doc_id, source FROM documents WHERE source IS DISTINCT FROM 'src3'")
def without_file(spark, d):
    return C.delete_by(_docs(spark, d).select("doc_id", "source"), "source", "src3")[0]


# texts


_RAW = "'title' || chr(10) || source || chr(10) || 'text' || chr(10) || ' ' || lang || ' ' || source || ' <|x|>'"


@query("clean_output", f"SELECT doc_id, {_RAW} AS plain, {_RAW} || chr(10) || chr(10) || chr(10) || '**[Figure 1]**' AS figures, source || chr(10) || chr(10) || ' ' || lang || ' ' || source || ' <|x|>' AS bare FROM documents")
def clean_output(spark, d):
    raw = F.col("raw")
    return _grounded(spark, d).select("doc_id", O.clean(raw).alias("plain"), O.clean(raw, include_images=True).alias("figures"), O.clean(raw, remove_labels=True).alias("bare"))


@query("embedded_images", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a **[Figure 1]** b **[Figure 2]**' WHEN doc_id % 3 = 1 THEN concat('a ', chr(10), chr(10), '![Figure 1](data:image/png;base64,', lang, ')', chr(10), chr(10), ' b **[Figure 2]**') ELSE concat('a ', chr(10), chr(10), '![Figure 1](data:image/png;base64,', lang, ')', chr(10), chr(10), ' b ', chr(10), chr(10), '![Figure 2](data:image/png;base64,', source, ')', chr(10), chr(10)) END AS markdown FROM documents")
def embedded_images(spark, d):
    crops = F.slice(F.array("lang", "source"), 1, (_id() % 3).cast("int"))
    return _docs(spark, d).select("doc_id", O.embed(F.lit("a **[Figure 1]** b **[Figure 2]**"), crops).alias("markdown"))


@query("linked_figures", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('See ![Figure 1](u', doc_id, ') and ![Figure 2](old)', chr(10), chr(10), '![Figure 3](v)') ELSE concat('![Figure 1](u', doc_id, ')', chr(10), '![Figure 3](v)') END AS content FROM documents")
def linked_figures(spark, d):
    content = F.when(_id() % 2 == 0, F.lit("See ![Figure 1] and ![Figure 2](old)"))
    figures = F.create_map(F.lit(1), F.concat(F.lit("u"), _id().cast("string")), F.lit(3), F.lit("v"))
    return _docs(spark, d).select("doc_id", T.ensure_figures(content, figures).alias("content"))


@query("missing_figures", "SELECT doc_id, list_filter([1, 2, 3], lambda x: x <> doc_id % 3 + 1) AS missing FROM documents")
def missing_figures(spark, d):
    figures = F.create_map(*(F.lit(x) for n in (1, 2, 3) for x in (n, "u")))
    return _docs(spark, d).select("doc_id", J.missing_figures(figures, F.concat(F.lit("a ![Figure "), (_id() % 3 + 1).cast("string"), F.lit("] b"))).alias("missing"))


@query("numbered_urls", "SELECT doc_id, concat('![Figure 1](http://h/', doc_id, '.png) t ![Figure 2](data:image/png;base64,BB) ![Figure 9](x)') AS content FROM documents")
def numbered_urls(spark, d):
    text = F.lit("![Figure 1](data:image/png;base64,AAA) t ![Figure 2](data:image/png;base64,BB) ![Figure 9](x)")
    return _docs(spark, d).select("doc_id", T.replace_numbered(text, F.array(F.format_string("http://h/%d.png", "doc_id"))).alias("content"))


@query("inlined_images", "SELECT doc_id, concat('![a](', CASE WHEN doc_id % 3 = 1 THEN 'data:1' ELSE concat('http://localhost/i/', doc_id % 3, '.png') END, ') and ![b](http://x/2.png)') AS markdown FROM documents")
def inlined_images(spark, d):
    markdown = F.concat(F.lit("![a](http://localhost/i/"), (_id() % 3).cast("string"), F.lit(".png) and ![b](http://x/2.png)"))
    data = F.create_map(F.lit("http://localhost/i/1.png"), F.lit("data:1"), F.lit("http://x/2.png"), F.lit("data:2"))
    return _docs(spark, d).select("doc_id", T.inline_images(markdown, data).alias("markdown"))


@query("ocr_content", "WITH s AS (SELECT doc_id, doc_id % 3 = 0 AS md, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat(' M', source) END AS m, CASE WHEN doc_id % 5 > 0 THEN concat(' T ', lang) END AS t, CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'R ' END AS r FROM documents), p AS (SELECT *, trim(coalesce(CASE WHEN md THEN m ELSE t END, '')) AS text FROM s) SELECT doc_id, text, CASE WHEN md THEN text ELSE trim(coalesce(nullif(m, ''), text)) END AS markdown, trim(coalesce(nullif(r, ''), text)) AS raw FROM p")
def ocr_content(spark, d):
    task = _pick(_id(), "markdown", "plain_ocr", "locate")
    found = X.ocr_content(task, F.when(_id() % 4 == 0, "").otherwise(F.concat(F.lit(" M"), "source")), F.when(_id() % 5 > 0, F.concat(F.lit(" T "), "lang")), F.when(_id() % 2 == 0, "").otherwise("R "))
    return _docs(spark, d).select("doc_id", found.alias("f")).select("doc_id", "f.*")


@query("page_texts", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'md' WHEN 1 THEN lang WHEN 2 THEN 'raw' WHEN 3 THEN concat(source, chr(10), chr(10), 'z') END AS text FROM documents")
def page_texts(spark, d):
    region = lambda label, content: F.struct(F.lit(label).alias("label"), content.alias("content"))
    regions = F.when(_id() % 5 == 3, F.array(region("Title", F.col("source")), region("Figure", F.lit("no")), region("text", F.lit(" ")), region("text", F.lit("z")))).otherwise(F.array(region("image", F.lit("no"))))
    text = X.page_text(F.when(_id() % 5 == 0, " md "), F.when(_id() % 5 == 1, F.col("lang")), F.when(_id() % 5 == 2, "raw").otherwise(""), regions)
    return _docs(spark, d).select("doc_id", text.alias("text"))


@query("search_items", "SELECT doc_id, CASE WHEN doc_id % 11 > 0 AND doc_id % 3 = 0 THEN concat('u', doc_id) END AS image_url, CASE WHEN doc_id % 11 > 0 THEN source END AS label, CASE WHEN doc_id % 11 > 0 AND doc_id % 4 > 0 THEN (doc_id % 4)::DOUBLE + 0.5 END AS score, CASE WHEN doc_id % 11 > 0 AND doc_id % 2 = 0 THEN lang END AS filename, CASE WHEN doc_id % 11 > 0 AND doc_id % 5 > 0 THEN (doc_id % 5)::INT END AS pdf_page_index FROM documents")
def search_items(spark, d):
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    url = F.when(_id() % 3 == 0, F.concat(F.lit('"u'), _id().cast("string"), F.lit('"'))).when(_id() % 3 == 1, "null").otherwise("5")
    score = F.when(_id() % 4 == 0, '"x"').otherwise(F.concat((_id() % 4).cast("string"), F.lit(".5")))
    body = F.concat(F.lit('{"image_url":'), url, F.lit(',"label":'), text(F.col("source")), F.lit(',"score":'), score, F.lit(',"payload":{"filename":'), F.when(_id() % 2 == 0, text(F.col("lang"))).otherwise("[1]"), F.lit(',"pdf_page_index":'), F.when(_id() % 5 > 0, (_id() % 5).cast("string")).otherwise('"no"'), F.lit("}}"))
    found = T.search_item(F.when(_id() % 11 == 0, "{not json").otherwise(body))
    return _docs(spark, d).select("doc_id", found.alias("f")).select("doc_id", "f.*")


@query("redacted_json", """SELECT event_id, concat('{"a":', event_id, ',"api_key":"***REDACTED***","list":[{"token":"***REDACTED***","b":"', event_type, '"},5],"n":{"Password":"***REDACTED***","ok":true}}') AS text FROM events""")
def redacted_json(spark, d):
    text = F.concat(F.lit('{"a": '), F.col("event_id").cast("string"), F.lit(', "api_key": {"x": [1]}, "list": [{"token": "t", "b": "'), "event_type", F.lit('"}, 5], "n": {"Password": [1, 2], "ok": true}}'))
    return D.read(spark, d, "events").select("event_id", T.redact_json(text).alias("text"))


_KEYS = ("API_token", "amount", "user", "Cookie", "sessionId", "note")


@query("redact_keys", f"SELECT event_id, {_list(*_KEYS)}[event_id % 6 + 1] AS name, CASE WHEN event_id % 6 IN (0, 3, 4) THEN '***REDACTED***' ELSE event_type END AS shown FROM events")
def redact_keys(spark, d):
    name = _pick(F.col("event_id"), *_KEYS)
    return D.read(spark, d, "events").select("event_id", name.alias("name"), F.element_at(T.redact(F.create_map(name, F.col("event_type"))), name).alias("shown"))


_NAMES = ("a.html", "b.PNG", "c.jpeg", "d.json", "e.webp", "f", "g.tar.gif", "h.svg", "i.pdf", "j.jpg", ".png", "k.doc")
_KINDS = ("application/octet-stream", "image/png", "image/jpeg", "application/json", "image/webp", "application/octet-stream", "image/gif", "image/svg+xml", "application/pdf", "image/jpeg", "image/png", "application/octet-stream")


@query("content_types", f"SELECT page_id, {_list(*_KINDS)}[page_id % 12 + 1] AS kind FROM pages")
def content_types(spark, d):
    return D.read(spark, d, "pages").select("page_id", T.content_type(_pick(F.col("page_id"), *_NAMES)).alias("kind"))


@query("allowed_files", "SELECT page_id, page_id % 12 IN (1, 8, 10) OR page_id % 5 = 2 AS allowed FROM pages")
def allowed_files(spark, d):
    mime = _pick(F.col("page_id"), "x/y", None, "Application/PDF", "", "text/html")
    return D.read(spark, d, "pages").select("page_id", T.allowed_file(_pick(F.col("page_id"), *_NAMES), mime, (".pdf", ".png"), ("application/pdf",)).alias("allowed"))


@query("token_display", "SELECT doc_id, concat(' ', lang, '  ', source) AS token FROM documents")
def token_display(spark, d):
    return _docs(spark, d).select("doc_id", T.token_display(F.concat(F.lit("Ġ"), "lang", F.lit("▁ "), "source")).alias("token"))


@query("previews", "SELECT doc_id, left(text, 200) AS preview FROM documents")
def previews(spark, d):
    return _docs(spark, d).select("doc_id", T.preview(F.col("text")).alias("preview"))


_VERSIONS = ("1.2.3", "1.2", "v1.0.0", "10.0.1-rc.1", "1.2.3+b.5", "1.2.3-", "01.2.3", "1.2.3-a+b")


@query("valid_versions", f"SELECT doc_id, regexp_full_match({_list(*_VERSIONS)}[doc_id % 8 + 1], '[0-9]+[.][0-9]+[.][0-9]+(-[0-9A-Za-z.-]+)?([+][0-9A-Za-z.-]+)?') AS ok FROM documents")
def valid_versions(spark, d):
    return _docs(spark, d).select("doc_id", T.valid_version(_pick(_id(), *_VERSIONS)).alias("ok"))


_FLAGS = ("true", " Yes ", "0", "ON", "off", "1", "", "a, b,,c ")


@query("parsed_settings", f"SELECT doc_id, doc_id % 8 IN (0, 1, 3, 5) AS flag, list_filter(list_transform(string_split({_list(*_FLAGS)}[doc_id % 8 + 1], ','), lambda x: trim(x)), lambda x: x <> '') AS items FROM documents")
def parsed_settings(spark, d):
    v = _pick(_id(), *_FLAGS)
    return _docs(spark, d).select("doc_id", T.parse_bool(v).alias("flag"), T.parse_list(v).alias("items"))


@query("progress_entries", "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN concat(event_type, ' ', event_id % 3, '/', event_id % 4) ELSE concat(event_type, ' ', event_id % 3) END AS entry FROM events")
def progress_entries(spark, d):
    return D.read(spark, d, "events").select("event_id", T.progress_entry(F.col("event_type"), F.col("event_id") % 3, F.col("event_id") % 4).alias("entry"))


@query("clean_logs", "SELECT doc_id, concat(lang, CASE WHEN doc_id % 2 = 0 THEN chr(10) || source ELSE '' END, chr(10), 'last') AS log FROM documents")
def clean_logs(spark, d):
    noisy = F.when(_id() % 2 == 0, F.concat(F.lit("\n"), "source")).otherwise(F.concat(F.lit("\nimage: "), "source"))
    return _docs(spark, d).select("doc_id", T.clean_log(F.concat(F.col("lang"), noisy, F.lit("\n=====\n10%| \nlast\ntorch.Size([1])\n"))).alias("log"))


@query("prompts", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '<image>' || chr(10) || '<|grounding|>Convert the document to markdown.' WHEN 1 THEN '<image>' || chr(10) || 'Free OCR.' WHEN 2 THEN '<image>' || chr(10) || 'Locate <|ref|>' || source || '<|/ref|> in the image.' WHEN 3 THEN '<image>' || chr(10) || 'Describe this image in detail.' ELSE '<image>' || chr(10) || source END AS prompt FROM documents")
def prompts(spark, d):
    return _docs(spark, d).select("doc_id", O.prompt(_pick(_id(), "markdown", "plain_ocr", "locate", "describe", "custom"), F.concat(F.lit(" "), "source")).alias("prompt"))


# contexts


def _with_regions(spark, d) -> DataFrame:
    """Groups of ten documents as results of a query, with regions."""
    region = lambda label, content, url: F.struct(label.alias("label"), content.alias("content"), url.alias("image_url"))
    none = F.lit(None).cast("string")
    regions = F.array(
        region(F.lit("Figure"), F.lit("no"), F.concat(F.lit(" http://h/"), _id().cast("string"))),
        region(F.lit("text"), F.col("lang"), F.lit("http://no")),
        region(F.lit("image"), F.concat(F.lit("https://c/"), "source"), F.lit("")),
        region(_pick(_id(), "chart", "title"), F.lit("ftp://x"), none),
    )
    return _docs(spark, d).select(F.expr("doc_id div 10").alias("query_id"), (_id() % 10 + 1).cast("int").alias("rank"), F.when(_id() % 3 > 0, F.col("source")).alias("label"), F.when(_id() % 4 > 0, F.format_string("http://h/%d", "doc_id")).alias("image_url"), F.when(_id() % 5 > 0, regions).alias("regions"), "doc_id")


@query("region_images", "SELECT doc_id // 10 AS query_id, (doc_id % 10 + 1)::INT AS rank, ord, CASE ord WHEN 0 THEN concat('http://h/', doc_id) ELSE concat('https://c/', source) END AS url FROM documents, (SELECT unnest([0, 2])::INT AS ord) WHERE doc_id % 5 > 0")
def region_images(spark, d):
    return X.region_images(_with_regions(spark, d))


@query("region_image_counts", "SELECT doc_id // 10 AS query_id, 2 * count_if(doc_id % 5 > 0) AS n FROM documents GROUP BY 1")
def region_image_counts(spark, d):
    return X.image_counts(_with_regions(spark, d))


@query("context_modes", "SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN 'page_images' WHEN doc_id % 3 > 0 AND doc_id % 5 > 0 THEN 'ocr_text_and_images' ELSE 'ocr_text' END AS mode FROM documents")
def context_modes(spark, d):
    return _with_regions(spark, d).select("doc_id", X.mode(_id() % 2 == 0, _id() % 3 > 0, F.col("regions")).alias("mode"))


@query("answer_stream", """WITH r AS (SELECT doc_id // 10 AS query_id, doc_id % 10 + 1 AS rank, CASE WHEN doc_id % 3 > 0 THEN source END AS label, CASE WHEN doc_id % 4 > 0 THEN concat('http://h/', doc_id) END AS url FROM documents),
f AS (SELECT query_id, string_agg(concat('{', concat_ws(',', '"label":"' || label || '"', '"image_url":"' || url || '"'), '}'), ',' ORDER BY rank) AS items, string_agg(concat(rank, '. [', coalesce(label, 'Unknown'), '](', coalesce(url, '#'), ')'), '\\n' ORDER BY rank) AS cited FROM r GROUP BY 1),
s AS (SELECT conv_id AS query_id, string_agg(concat('data: {"event":"response.output_text.delta","data":{"delta":"', role, turn, '"}}', chr(10), chr(10)), '' ORDER BY turn) AS said FROM (SELECT DISTINCT conv_id, turn, role FROM conversations) GROUP BY 1)
SELECT query_id, concat(': stream-start', chr(10), chr(10), CASE WHEN items IS NOT NULL THEN concat('data: {"event":"kb.images","data":{"items":[', items, ']}}', chr(10), chr(10)) ELSE '' END, coalesce(said, ''), CASE WHEN cited IS NOT NULL THEN concat('data: {"event":"response.output_text.delta","data":{"delta":"\\n\\n---\\n\\n**Sources:**\\n\\n', cited, '"}}', chr(10), chr(10)) ELSE '' END) AS stream FROM f FULL JOIN s USING (query_id)""")
def answer_stream(spark, d):
    turns = D.read(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("ord"), F.concat("role", F.col("turn").cast("string")).alias("delta")).distinct()
    return X.sse(_with_regions(spark, d), turns)


# progress


@query("running_pages", "SELECT event_id, sum(event_id % 5 + 1) OVER w AS done, CASE WHEN epoch(ts) > min(epoch(ts)) OVER w THEN round(sum(event_id % 5 + 1) OVER w / (epoch(ts) - min(epoch(ts)) OVER w), 6) END AS pages_per_second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def running_pages(spark, d):
    e = D.read(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 5 + 1).alias("pages"))
    return C.running(e, "user_id").select("event_id", "done", F.round("pages_per_second", 6).alias("pages_per_second"))


_STATE = "CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'running' END"


@query("progress_frames", f"""WITH s AS (SELECT user_id, event_id, {_STATE} AS status, event_id % 3 AS current FROM events), w AS (SELECT *, lag(status) OVER w AS s0, lag(current) OVER w AS c0, coalesce(max((status = 'completed')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, CASE WHEN s0 = status AND c0 = current THEN concat('event: heartbeat', chr(10), 'data: {{}}', chr(10), chr(10)) ELSE concat('event: progress', chr(10), 'data: {{"job_id":', user_id, ',"status":"', status, '","current":', current, ',"total":8,"percent":', CASE current WHEN 0 THEN 0 WHEN 1 THEN 12 ELSE 25 END, '}}', chr(10), chr(10)) END AS frame FROM w WHERE ended = 0""")
def progress_frames(spark, d):
    e = D.read(spark, d, "events").select("user_id", "event_id", F.expr(_STATE).alias("status"), (F.col("event_id") % 3).alias("current"), F.lit(8).alias("total"))
    return C.progress_frames(e, "user_id")


def _jobs(spark, d) -> DataFrame:
    return D.read(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", F.expr(_STATE).alias("status"), (F.col("event_id") % 100).alias("current"), F.lit(100).alias("total"))


def _now(spark, d):
    return F.lit(D.read(spark, d, "events").agg(F.max("ts")).first()[0])


@query("stalled_jobs", f"WITH l AS (SELECT user_id AS job_id, max(ts) AS last, arg_max({_STATE}, ts) AS status FROM events GROUP BY 1) SELECT job_id FROM l, (SELECT max(ts) AS t FROM events) WHERE status <> 'completed' AND floor(epoch(t)) - floor(epoch(last)) > 3600")
def stalled_jobs(spark, d):
    return I.stalled(_jobs(spark, d), _now(spark, d), 3600).select("job_id")


@query("expired_jobs", "WITH f AS (SELECT user_id AS job_id, min(ts) AS finished FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT job_id FROM f, (SELECT max(ts) AS t FROM events) WHERE floor(epoch(t)) - floor(epoch(finished)) > 86400")
def expired_jobs(spark, d):
    return I.expired(I.job_states(_jobs(spark, d)), _now(spark, d), 86400).select("job_id")


@query("exact_completions", "SELECT user_id, count(DISTINCT event_type)::INT AS n_stages FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 5")
def exact_completions(spark, d):
    return I.completions(D.read(spark, d, "events").withColumnRenamed("event_type", "stage"), ("user_id",), 5)


@query("service_health", "SELECT bool_and(event_type = 'view' OR value IS NOT NULL) AS healthy, count_if(event_type = 'view') AS failing FROM events")
def service_health(spark, d):
    name = F.when(F.col("event_type") == "view", "ocr").otherwise(F.col("event_type"))
    return C.health(D.read(spark, d, "events").select(name.alias("name"), (F.col("event_type") != "view").alias("ok")))


@query("status_rollup", "SELECT source, CASE WHEN bool_and(n_chars % 7 > 0) THEN 'success' WHEN bool_or(n_chars % 7 > 3) THEN 'partial' ELSE 'error' END AS status FROM documents GROUP BY source UNION ALL SELECT concat('doc', doc_id), CASE WHEN n_chars % 7 > 0 THEN 'success' ELSE 'error' END FROM documents")
def status_rollup(spark, d):
    """By source and by document; the rest of n_chars by 7 says failed (0), skipped (1 to 3) or success."""
    status = F.when(F.col("n_chars") % 7 == 0, "failed").when(F.col("n_chars") % 7 <= 3, "skipped").otherwise("success")
    rows = _docs(spark, d).withColumn("s", status)
    rows = rows.select("source", "s").union(rows.select(F.concat(F.lit("doc"), _id().cast("string")), "s"))
    return rows.groupBy("source").agg(C.rolled_up(F.col("s")).alias("status"))
