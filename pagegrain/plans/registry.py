"""Queries over the driver tables by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import grounding as O
from ..functions import text as T
from ..functions import vectors as V
from ..operators import analysis as A
from ..operators import catalog as C
from ..operators import context as X
from ..operators import evaluate as E
from ..operators import maps as M
from ..operators import pooling as P
from ..operators import regions as R
from ..operators import search as S
from ..sources import tables as D
from ..streaming import ingest as I
from . import retrieval as Q

#: Pages by sign codes that are scored exactly, for each that is asked for: so many that nine in ten answers are found.
OVERSAMPLING = 12

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PATCHES = "patches AS (SELECT vec_id // 20 AS page, (vec_id % 20) % 5 AS px, (vec_id % 20) // 5 AS py, label, embedding::DOUBLE[] AS v FROM embeddings)"
QUERY = "query AS (SELECT vec_id // 100 AS query_id, vec_id % 100 AS token, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 < 3)"
SIMS = "sims AS (SELECT query_id, token, page, px, py, label, list_cosine_similarity(v, q) AS sim FROM patches, query)"
BEST = "best AS (SELECT query_id, page, token, max(sim) AS sim FROM sims GROUP BY ALL)"
SCORED = "scored AS (SELECT query_id, page, sum(sim) AS score FROM best GROUP BY ALL)"
REGIONS = """boxes AS (SELECT doc_id, doc_id // 40 AS page, (doc_id * 37) % 400 AS x1, (doc_id * 53) % 300 AS y1, (doc_id * 37) % 400 + 20 + (doc_id * 11) % 120 AS x2, (doc_id * 53) % 300 + 20 + (doc_id * 7) % 90 AS y2,
 ['text', 'title', 'image', 'table', 'figure'][doc_id % 5 + 1] AS label, text AS content, lang AS category FROM documents)"""
CELLS = """cell AS (SELECT x AS px, y AS py, x * 100 AS a1, y * 100 AS b1, x * 100 + 100 AS a2, y * 100 + 100 AS b2 FROM (SELECT unnest(range(0, 5)) AS x), (SELECT unnest(range(0, 4)) AS y)),
met AS (SELECT *, greatest(0, least(x2, a2) - greatest(x1, a1)) * greatest(0, least(y2, b2) - greatest(y1, b1)) AS shared FROM boxes, cell WHERE x1 < a2 AND a1 < x2 AND y1 < b2 AND b1 < y2),
ious AS (SELECT *, shared::DOUBLE / ((x2 - x1) * (y2 - y1) + 10000 - shared) AS iou FROM met)"""
PATCH = "patch AS (SELECT query_id, page, px, py, max(sim) AS s FROM sims GROUP BY ALL)"
TRUTH = "truth AS (SELECT item_id, (item_id * 37) % 400 + 15 AS x1, (item_id * 53) % 300 + 15 AS y1, (item_id * 37) % 400 + 35 + (item_id * 11) % 120 AS x2, (item_id * 53) % 300 + 35 + (item_id * 7) % 90 AS y2 FROM benchmark)"
IOU = """shares AS (SELECT item_id, category, greatest(0, least(t.x2, b.x2) - greatest(t.x1, b.x1)) * greatest(0, least(t.y2, b.y2) - greatest(t.y1, b.y1)) AS i, (t.x2 - t.x1) * (t.y2 - t.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS u FROM truth t LEFT JOIN boxes b ON b.page = t.item_id % 25),
metric AS (SELECT item_id, coalesce(max(i::DOUBLE / (u - i)), 0) AS mean_iou FROM shares GROUP BY item_id)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _r(*cols: str, digits: int = 6):
    return {c: F.round(c, digits) for c in cols}


# search


@query("maxsim_rank", f"WITH {PATCHES}, {QUERY}, {SIMS}, {BEST}, {SCORED} SELECT query_id, page, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM scored) WHERE rank <= 10")
def maxsim_rank(spark, d):
    return S.top(S.maxsim(D.patches(spark, d), D.queries(spark, d)), 10).withColumns(_r("score"))


@query("cosine_topk", f"WITH {PATCHES}, {QUERY}, {SIMS} SELECT query_id, token, page, px, py, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, token ORDER BY sim DESC, page, px, py) AS rank FROM sims) WHERE rank <= 10")
def cosine_topk(spark, d):
    found = S.nearest(D.patches(spark, d).select("page", "px", "py", "vec"), D.queries(spark, d), 10)
    return found.select("query_id", "token", "page", "px", "py", F.round("sim", 6).alias("sim"), "rank")


@query("maxsim_batch_topk", f"WITH {PATCHES}, {QUERY}, {SIMS}, {BEST}, {SCORED} SELECT query_id, page, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM scored) WHERE rank <= 5")
def maxsim_batch_topk(spark, d):
    return S.search(D.patches(spark, d), D.queries(spark, d), 5).withColumns(_r("score"))


@query("maxsim_mean", f"WITH {PATCHES}, {QUERY}, {SIMS}, {BEST} SELECT query_id, page, round(avg(sim), 6) AS score FROM best GROUP BY ALL")
def maxsim_mean(spark, d):
    return S.maxsim(D.patches(spark, d), D.queries(spark, d), "mean").withColumns(_r("score"))


@query("global_max_score", f"WITH {PATCHES}, {QUERY}, {SIMS} SELECT query_id, page, round(max(sim), 6) AS score FROM sims GROUP BY ALL")
def global_max_score(spark, d):
    return S.global_max(D.patches(spark, d).select("page", "vec"), D.queries(spark, d)).withColumns(_r("score"))


@query("maxsim_filtered", f"WITH {PATCHES}, {QUERY}, kept AS (SELECT * FROM patches WHERE page IN (SELECT page FROM patches WHERE label = 3)), sims AS (SELECT query_id, token, page, list_cosine_similarity(v, q) AS sim FROM kept, query), {BEST}, {SCORED} SELECT query_id, page, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM scored) WHERE rank <= 5")
def maxsim_filtered(spark, d):
    return S.search(D.patches(spark, d), D.queries(spark, d), 5, conditions={"label": 3}).withColumns(_r("score"))


def _pool_sql(axis: str) -> str:
    return f"pool_{axis} AS (SELECT page, {axis} AS idx, list(x ORDER BY k) AS v FROM (SELECT page, {axis}, k, avg(v[k]) AS x FROM patches, (SELECT unnest(range(1, 65)) AS k) GROUP BY page, {axis}, k) GROUP BY page, {axis})"


for _name, _axis in (("pool_rows", "py"), ("pool_cols", "px")):

    @query(_name, f"WITH {PATCHES}, {_pool_sql(_axis)} SELECT page, idx, list_transform(v, lambda x: round(x, 6)) AS vec FROM pool_{_axis}")
    def _pooled(spark, d, axis=_axis):
        return P.pool(D.patches(spark, d), axis, keep_others=False).withColumn("vec", V.rounded(F.col("vec"), 6))


def _stage(axis: str, n: int) -> str:
    return f"s_{axis} AS (SELECT query_id, page FROM (SELECT query_id, page, sum(sim) AS score FROM (SELECT query_id, page, token, max(list_cosine_similarity(v, q)) AS sim FROM pool_{axis}, query GROUP BY ALL) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) <= {n})"


@query("two_stage_search", f"WITH {PATCHES}, {QUERY}, {_pool_sql('py')}, {_pool_sql('px')}, {_stage('py', 200)}, {_stage('px', 200)}, {SIMS}, {BEST}, {SCORED} SELECT query_id, page, round(score, 6) AS score, rank FROM (SELECT scored.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM scored JOIN (FROM s_py UNION FROM s_px) USING (query_id, page)) WHERE rank <= 5")
def two_stage_search(spark, d):
    p = D.patches(spark, d)
    return S.two_stage(p, P.pool(p, "py", False), P.pool(p, "px", False), D.queries(spark, d), k=5, prefetch=200).withColumns(_r("score"))


@query("quantized_search", f"""WITH {PATCHES}, {QUERY}, bits AS (SELECT query_id, page, token, list_sum(list_transform(range(1, 65), lambda i: ((v[i] > 0) <> (q[i] > 0))::INT)) AS b FROM patches, query), near AS (SELECT query_id, page FROM (SELECT query_id, page, sum(b) AS b FROM (SELECT query_id, page, token, min(b) AS b FROM bits GROUP BY ALL) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY b, page) <= {5 * OVERSAMPLING}), {SIMS}, {BEST}, {SCORED} SELECT query_id, page, round(score, 6) AS score, rank FROM (SELECT scored.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM scored JOIN near USING (query_id, page)) WHERE rank <= 5""")
def quantized_search(spark, d):
    return S.quantised(D.patches(spark, d), D.queries(spark, d), D.DIM, k=5, oversampling=OVERSAMPLING).withColumns(_r("score"))


@query("sign_codes", f"WITH {PATCHES} SELECT page, px, py, list_sum(list_transform(v, lambda x: (x > 0)::INT))::INT AS n_bits FROM patches")
def sign_codes(spark, d):
    code = V.sign_code(F.col("vec"), D.DIM)
    return D.patches(spark, d).select("page", "px", "py", F.bit_count(code[0]).cast("int").alias("n_bits"))


@query("l2_normalised", f"WITH {PATCHES} SELECT page, px, py, round(list_sum(list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))), 6) AS total FROM patches")
def l2_normalised(spark, d):
    return D.patches(spark, d).select("page", "px", "py", F.round(F.aggregate(V.normalise(F.col("vec")), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


# geometry


@query("iou_pairs", f"WITH {REGIONS} SELECT a.doc_id AS a, b.doc_id AS b, round(coalesce(s::DOUBLE / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - s), 0), 6) AS iou FROM (SELECT a, b, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS s FROM boxes a JOIN boxes b ON a.page = b.page AND a.doc_id < b.doc_id) t")
def iou_pairs(spark, d):
    r = D.regions(spark, d).select("page", "region_id", "x1", "y1", "x2", "y2")
    o = r.select("page", *(F.col(c).alias(f"b_{c}") for c in ("region_id", "x1", "y1", "x2", "y2")))
    pairs = r.join(o, "page").where("region_id < b_region_id")
    return pairs.select(F.col("region_id").alias("a"), F.col("b_region_id").alias("b"), F.round(G.iou(G.box(), G.box("b_")), 6).alias("iou"))


@query("patch_ranges", f"WITH {REGIONS} SELECT doc_id AS region_id, greatest(0, x1 // 100)::INT AS px1, greatest(0, y1 // 100)::INT AS py1, least(5, ceil(x2 / 100))::INT AS px2, least(4, ceil(y2 / 100))::INT AS py2 FROM boxes")
def patch_ranges(spark, d):
    found = G.patch_range(G.box(), 100.0, 100.0, D.NX, D.NY)
    return D.regions(spark, d).select("region_id", *(c.cast("int").alias(n) for c, n in zip(found, ("px1", "py1", "px2", "py2"), strict=True)))


@query("coordinates_to_pixels", f"WITH {REGIONS} SELECT doc_id AS region_id, trunc(x1 / 999 * 1240)::INT AS px, trunc(y1 / 999 * 1754)::INT AS py FROM boxes")
def coordinates_to_pixels(spark, d):
    return D.regions(spark, d).select("region_id", G.to_pixels(F.col("x1"), 1240).alias("px"), G.to_pixels(F.col("y1"), 1754).alias("py"))


@query("image_tokens", f"WITH {REGIONS}, s AS (SELECT doc_id, x2 * 7 AS w, y2 * 5 AS h FROM boxes), f AS (SELECT *, least(1568.0::DOUBLE / w, 1568.0::DOUBLE / h) AS k FROM s) SELECT doc_id AS region_id, greatest(1, CASE WHEN w > 1568 OR h > 1568 THEN trunc(w * k)::BIGINT * trunc(h * k)::BIGINT // 750 ELSE w * h // 750 END)::INT AS tokens FROM f")
def image_tokens(spark, d):
    return D.regions(spark, d).select("region_id", G.image_tokens(F.col("x2") * 7, F.col("y2") * 5).cast("int").alias("tokens"))


@query("grid_estimate", f"WITH {REGIONS}, g AS (SELECT doc_id, 100 + doc_id % 900 AS n, x2::DOUBLE / y2 AS a FROM boxes), y AS (SELECT *, greatest(1, trunc(sqrt(n / a)))::BIGINT AS ny FROM g) SELECT doc_id AS region_id, (CASE WHEN a > 1 THEN ceil(n / ny) ELSE n // ny END)::INT AS nx, (CASE WHEN a > 1 THEN ny ELSE ceil(n / greatest(1, n // ny)) END)::INT AS ny FROM y")
def grid_estimate(spark, d):
    nx, ny = G.estimate_grid(100 + F.col("region_id") % 900, F.col("x2").cast("double"), F.col("y2").cast("double"))
    return D.regions(spark, d).select("region_id", nx.cast("int").alias("nx"), ny.cast("int").alias("ny"))


# regions


def _scores(spark, d, aggregate="max"):
    return S.patch_scores(D.patches(spark, d), D.queries(spark, d), aggregate)


def _region_scores(spark, d, aggregate="iou_weighted", **options):
    return M.region_scores(D.patches(spark, d), D.regions(spark, d), D.queries(spark, d), D.NX, D.NY, D.WIDTH, D.HEIGHT, aggregate, **options)


for _name, _fold in (("max", "max"), ("mean", "avg"), ("sum", "sum")):

    @query(f"patch_scores_{_name}", f"WITH {PATCHES}, {QUERY}, {SIMS} SELECT query_id, page, px, py, round({_fold}(sim), 6) AS score FROM sims GROUP BY query_id, page, px, py")
    def _patch_scores(spark, d, name=_name):
        return _scores(spark, d, name).withColumns(_r("score"))


_HEAD = f"WITH {PATCHES}, {QUERY}, {SIMS}, {PATCH}, {REGIONS}, {CELLS}"
_ASKED = "FROM boxes b JOIN (SELECT DISTINCT query_id, page FROM patch) p USING (page) LEFT JOIN r ON r.doc_id = b.doc_id AND r.query_id = p.query_id"
_TAIL = f"SELECT p.query_id, b.page, b.doc_id AS region_id, round(coalesce(r.score, 0), 6) AS score {_ASKED}"
_FORMS = {
    "iou": ("iou_weighted", {}, "sum(iou * s) / sum(iou)", "iou > 0"),
    "max": ("max", {}, "max(s)", "true"),
    "mean": ("mean", {}, "avg(s)", "true"),
    "bench": ("iou_weighted", {"eps": 1e-8, "min_overlap": 0.05}, "sum(iou * s) / (sum(iou) + 1e-8)", "iou > 0.05"),
    "bench_max": ("max_floor", {"min_overlap": 0.05}, "greatest(0, max(s))", "iou > 0.05"),
}
for _name, (_aggregate, _options, _expression, _where) in _FORMS.items():

    @query(f"region_relevance_{_name}", f"{_HEAD}, r AS (SELECT query_id, doc_id, {_expression} AS score FROM ious JOIN patch USING (page, px, py) WHERE {_where} GROUP BY query_id, doc_id) {_TAIL}")
    def _relevance(spark, d, aggregate=_aggregate, options=_options):
        return _region_scores(spark, d, aggregate, digits=6, **options)


# round to 9 digits before any comparison with a cutoff, so that both engines compare the same numbers
_SCORE = f"{_HEAD}, r AS (SELECT query_id, doc_id, sum(iou * s) / sum(iou) AS score FROM ious JOIN patch USING (page, px, py) WHERE iou > 0 GROUP BY query_id, doc_id), sc AS (SELECT p.query_id, b.page, b.doc_id, round(coalesce(r.score, 0), 9) AS score {_ASKED})"
_CUTS = {
    "adaptive": ({"method": "adaptive"}, "avg(score) OVER p + stddev_pop(score) OVER p", 1000),
    "percentile": ({"method": "percentile", "percentile": 80.0}, "quantile_cont(score, 0.8) OVER p", 1000),
    "max": ({"method": "max"}, "max(score) OVER p", 1000),
    "none": ({"method": "none", "top_k": 7}, "-1e9", 7),
    "fixed": ({"method": "none", "threshold": 0.3, "top_k": 5}, "0.3", 5),
}
for _name, (_options, _cut, _top) in _CUTS.items():

    @query(f"region_threshold_{_name}", f"{_SCORE}, t AS (SELECT *, {_cut} AS cutoff FROM sc WINDOW p AS (PARTITION BY query_id, page)) SELECT query_id, page, region_id, score, rank FROM (SELECT query_id, page, doc_id AS region_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id, page ORDER BY t.score DESC, doc_id) AS rank FROM t WHERE t.score >= cutoff - 1e-12) WHERE rank <= {_top}")
    def _threshold(spark, d, options=_options):
        return _region_scores(spark, d, digits=9, select=options, shown=6)


@query("search_regions", f"{_SCORE}, {BEST}, {SCORED}, pages AS (SELECT query_id, page, score AS page_score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS page_rank FROM scored QUALIFY page_rank <= 5) SELECT query_id, page, page_rank, round(page_score, 6) AS page_score, doc_id AS region_id, round(score, 6) AS score FROM sc JOIN pages USING (query_id, page) WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY query_id, page ORDER BY sc.score DESC, doc_id) <= 4")
def search_regions(spark, d):
    o = Q.Options(k=5, threshold=0.1, region_top_k=4)
    got = Q.search_regions(D.patches(spark, d), D.regions(spark, d), D.queries(spark, d), D.NX, D.NY, D.WIDTH, D.HEIGHT, o)
    return got.select("query_id", "page", "page_rank", F.round("page_score", 6).alias("page_score"), "region_id", F.round("score", 6).alias("score"))


@query("heat_normalised", f"WITH {PATCHES}, {QUERY}, {SIMS}, {PATCH} SELECT query_id, page, px, py, round(CASE WHEN max(s) OVER w > min(s) OVER w THEN (s - min(s) OVER w) / (max(s) OVER w - min(s) OVER w) ELSE 0 END, 6) AS normal, round(greatest(s, 0) / (max(greatest(s, 0)) OVER w + 1e-8), 6) AS heat FROM patch WINDOW w AS (PARTITION BY query_id, page)")
def heat_normalised(spark, d):
    return M.heat(D.patches(spark, d), D.queries(spark, d), digits=6)


# grounded text: made from documents, three references each

_GROUNDED_SQL = """g AS (SELECT doc_id, concat('<|ref|>title<|/ref|><|det|>[[', doc_id % 900, ', 20, 500, 60]]<|/det|>\n', source, '\n<|ref|>text<|/ref|><|det|>[[10, 80, 500, ', 100 + doc_id % 800, '], [1, 2, 3, 4]]<|/det|>\n ', lang, ' ', source, ' <|x|>\n<|ref|>image<|/ref|><|det|>[[1, 1, 9, bad]]<|/det|>') AS raw FROM documents)"""


def _grounded(spark, d):
    raw = F.concat(F.lit("<|ref|>title<|/ref|><|det|>[["), (F.col("doc_id") % 900).cast("string"), F.lit(", 20, 500, 60]]<|/det|>\n"), "source", F.lit("\n<|ref|>text<|/ref|><|det|>[[10, 80, 500, "), (100 + F.col("doc_id") % 800).cast("string"), F.lit("], [1, 2, 3, 4]]<|/det|>\n "), "lang", F.lit(" "), "source", F.lit(" <|x|>\n<|ref|>image<|/ref|><|det|>[[1, 1, 9, bad]]<|/det|>"))
    return D.read(spark, d, "documents").select("doc_id", raw.alias("raw"))


@query("grounding_extract", f"""WITH {_GROUNDED_SQL}, r AS (SELECT doc_id, unnest(list_zip(range(0, 3), regexp_extract_all(raw, '<\\|ref\\|>([^<]*)<', 1), regexp_extract_all(raw, '<\\|det\\|>([^<]*)<', 1))) AS z FROM g), b AS (SELECT doc_id, z[1] AS ref_ord, z[2] AS label, unnest(list_zip(range(0, 9), regexp_extract_all(z[3], '\\[(\\d+, \\d+, \\d+, \\d+)\\]', 1))) AS y FROM r) SELECT doc_id, ref_ord::INT AS ref_ord, y[1]::INT AS box_ord, label, trunc(split_part(y[2], ', ', 1)::INT / 999 * 1000)::INT AS x1, trunc(split_part(y[2], ', ', 4)::INT / 999 * 1400)::INT AS y2 FROM b WHERE y[2] IS NOT NULL""")
def grounding_extract(spark, d):
    return O.boxes(_grounded(spark, d), "raw", 1000, 1400).select("doc_id", "ref_ord", "box_ord", "label", "x1", "y2")


@query("region_content_join", f"""WITH {_GROUNDED_SQL}, p AS (SELECT doc_id, unnest(list_zip(range(0, 3), string_split(raw, '<|ref|>')[2:])) AS z FROM g), c AS (SELECT doc_id, z[1] AS k, split_part(z[2], '<|/ref|>', 1) AS label, trim(regexp_replace(trim(split_part(z[2], '<|/det|>', 2), E' \\t\\n\\x0b\\f\\r'), '<\\|[^|]+\\|>', '', 'g'), E' \\t\\n\\x0b\\f\\r') AS content FROM p), o AS (SELECT doc_id, 1 AS ord, 'title' AS label FROM g UNION ALL SELECT doc_id, 2, 'text' FROM g UNION ALL SELECT doc_id, 3, 'text' FROM g) SELECT o.doc_id, o.ord::INT AS ord, concat(o.doc_id, '#region-', o.ord) AS region_id, o.label, nullif(c.content, '') AS content FROM o LEFT JOIN c ON c.doc_id = o.doc_id AND c.label = o.label AND o.ord < 3""")
def region_content_join(spark, d):
    return O.regions(_grounded(spark, d), "raw", 1000, 1400, "doc_id").select("doc_id", "ord", "region_id", "label", "content")


# strings


_LINES = r"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\x0b\f\r\x{85}\x{2028}\x{2029}]'), lambda x: trim(x, E' \t\n\x0b\f\r')), lambda x: x <> '')"


@query("text_segments", f"SELECT doc_id, len({_LINES}) AS n_segments, {_LINES}[1] AS first_segment FROM documents")
def text_segments(spark, d):
    s = T.segments(F.col("text"))
    return D.read(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n_segments"), F.get(s, F.lit(0)).alias("first_segment"))


@query("page_label", "SELECT doc_id, concat(source, ' - Page ', doc_id % 25, ' of ', n_chars) AS label FROM documents")
def page_label(spark, d):
    return D.read(spark, d, "documents").select("doc_id", T.page_label(F.col("source"), F.col("doc_id") % 25, F.col("n_chars")).alias("label"))


@query("image_url", "SELECT doc_id, concat('http://localhost/files/documents/', source, '/', doc_id % 25, '/image/', doc_id, '.jpg') AS url FROM documents")
def image_url(spark, d):
    return D.read(spark, d, "documents").select("doc_id", T.image_url("http://localhost/files/", "documents", F.col("source"), F.col("doc_id") % 25, F.col("doc_id")).alias("url"))


@query("url_parse", "SELECT page_id, regexp_extract(u, '^[^:]+://[^/]+/files/([^/]+)/', 1) AS bucket, regexp_extract(u, '^[^:]+://[^/]+/files/[^/]+/(.*)$', 1) AS path, regexp_extract(regexp_extract(u, '^([^?#]*)', 1), '/files/[^/]+/(.*?)/*$', 1) AS object FROM (SELECT page_id, concat('http://h/files/documents/', page_id, '/x/', split_part(url, '/', 4), '/i.png') AS u FROM pages)")
def url_parse(spark, d):
    u = F.concat(F.lit("http://h/files/documents/"), F.col("page_id").cast("string"), F.lit("/x/"), F.get(F.split("url", "/"), F.lit(3)), F.lit("/i.png"))
    p = T.parse_files_url(F.col("u"))
    return D.read(spark, d, "pages").withColumn("u", u).select("page_id", p["bucket"].alias("bucket"), p["path"].alias("path"), T.object_name(F.col("u"), "documents").alias("object"))


@query("slugify", "SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'documents') AS slug FROM documents")
def slugify(spark, d):
    return D.read(spark, d, "documents").select("doc_id", T.slugify(F.col("text")).alias("slug"))


@query("token_counts", r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0b\f\r]'))::INT AS tokens FROM documents")
def token_counts(spark, d):
    return D.read(spark, d, "documents").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


# evaluation


def _detected(spark, d):
    p = D.regions(spark, d)
    samples = D.truth(spark, d)
    predicted = samples.select("sample_id").join(p, p["page"] == samples["sample_id"] % D.PAGES).select("sample_id", "x1", "y1", "x2", "y2")
    return E.sample_metrics(E.localise(samples, predicted))


@query("eval_localization", f"WITH {TRUTH}, {REGIONS}, {IOU} SELECT item_id AS sample_id, round(mean_iou, 6) AS mean_iou, (mean_iou >= 0.5)::DOUBLE AS iou_at_0_5 FROM metric")
def eval_localization(spark, d):
    return _detected(spark, d).select("sample_id", F.round("mean_iou", 6).alias("mean_iou"), "iou_at_0_5")


@query("hit_rates", f"WITH {TRUTH}, {REGIONS}, {IOU} SELECT count(*) AS n, count_if(mean_iou >= 0.25) AS hits_0_25, round(count_if(mean_iou >= 0.25) / count(*), 6) AS rate_0_25, count_if(mean_iou >= 0.5) AS hits_0_5, round(count_if(mean_iou >= 0.5) / count(*), 6) AS rate_0_5, count_if(mean_iou >= 0.7) AS hits_0_7, round(count_if(mean_iou >= 0.7) / count(*), 6) AS rate_0_7 FROM metric")
def hit_rates(spark, d):
    return E.hit_rates(_detected(spark, d)).withColumns(_r("rate_0_25", "rate_0_5", "rate_0_7"))


@query("eval_summary", f"WITH {TRUTH}, {REGIONS}, {IOU} SELECT round(avg(mean_iou), 6) AS mean_iou, round(avg((mean_iou >= 0.5)::INT), 6) AS iou_at_0_5, count(*) AS n FROM metric")
def eval_summary(spark, d):
    return E.summarise(_detected(spark, d)).withColumns(_r("mean_iou", "iou_at_0_5"))


@query("category_rollup", f"WITH {TRUTH}, {REGIONS}, {IOU}, c AS (SELECT *, concat('c', item_id % 4) AS category FROM metric) SELECT coalesce(category, 'TOTAL') AS category, count(*) AS n, round(avg(mean_iou), 6) AS mean_iou, round(avg((mean_iou >= 0.25)::INT), 6) AS at_0_25, round(avg((mean_iou >= 0.5)::INT), 6) AS at_0_5, round(avg((mean_iou >= 0.7)::INT), 6) AS at_0_7, round(avg(mean_iou), 6) AS det_iou FROM c GROUP BY ROLLUP (category)")
def category_rollup(spark, d):
    m = _detected(spark, d).withColumn("category", F.concat(F.lit("c"), (F.col("sample_id") % 4).cast("string")))
    return E.by_category(m, m).withColumns(_r("mean_iou", "at_0_25", "at_0_5", "at_0_7", "det_iou")).drop("det_at_0_5")


_TOKENS = f"{REGIONS}, tk AS (SELECT *, CASE WHEN label IN ('image', 'figure') THEN greatest(1, (x2 - x1) * (y2 - y1) // 750) ELSE len(regexp_extract_all(coalesce(content, ''), '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\n\\x0b\\f\\r]')) END AS t, doc_id % 3 = 0 AS sel FROM boxes), per AS (SELECT page AS sample_id, coalesce(sum(t) FILTER (sel), 0)::BIGINT AS tokens_selected, sum(t)::BIGINT AS tokens_all_ocr, 266 AS tokens_full_image, count_if(sel AND label IN ('image', 'figure')) AS image_regions_selected, count_if(label IN ('image', 'figure')) AS image_regions_all FROM tk GROUP BY page)"


def _token_stats(spark, d):
    r = D.regions(spark, d).withColumn("selected", F.col("region_id") % 3 == 0).withColumnRenamed("page", "sample_id")
    return E.token_stats(r, D.WIDTH, D.HEIGHT)


@query("token_stats", f"WITH {_TOKENS} SELECT * FROM per")
def token_stats(spark, d):
    return _token_stats(spark, d)


@query("token_savings", f"WITH {_TOKENS}, s AS (SELECT sum(tokens_selected)::BIGINT AS a, sum(tokens_all_ocr)::BIGINT AS b, sum(tokens_full_image)::BIGINT AS c FROM per) SELECT a AS tokens_selected, b AS tokens_all_ocr, c AS tokens_full_image, printf('%.1f%%', (1 - a / b) * 100) AS savings_vs_ocr, printf('%.1f%%', (1 - a / c) * 100) AS savings_vs_image FROM s")
def token_savings(spark, d):
    return E.token_savings(_token_stats(spark, d))


@query("param_sweep", f"WITH {TRUTH}, {REGIONS}, {IOU}, p AS (SELECT unnest([1, 2, 3, 4]) * 0.2 AS level) SELECT round(level, 1)::DOUBLE AS level, count_if(mean_iou >= round(level, 1)) AS hits, count(*) AS n FROM metric, p GROUP BY level")
def param_sweep(spark, d):
    grid = spark.createDataFrame([(0.2,), (0.4,), (0.6,), (0.8,)], "level double")
    return E.sweep(_detected(spark, d), grid).groupBy("level").agg(F.count_if(F.col("mean_iou") >= F.col("level")).alias("hits"), F.count("*").alias("n"))


# analysis over lineitem


def _lines(spark, d):
    return D.read(spark, d, "lineitem")


@query("corr_features", "SELECT 'quantity' AS feature, count(*) AS n, round(corr(l_quantity::DOUBLE, l_extendedprice::DOUBLE), 6) AS r FROM lineitem UNION ALL SELECT 'log_quantity', count(*), round(corr(log10(l_quantity::DOUBLE + 1), l_extendedprice::DOUBLE), 6) FROM lineitem UNION ALL SELECT 'discount', count(*), round(corr(l_discount::DOUBLE, l_extendedprice::DOUBLE), 6) FROM lineitem")
def corr_features(spark, d):
    q = F.col("l_quantity").cast("double")
    rows = _lines(spark, d).withColumn("price", F.col("l_extendedprice").cast("double"))
    return A.correlations(rows, "price", {"quantity": q, "log_quantity": F.log10(q + 1), "discount": F.col("l_discount").cast("double")}).withColumns(_r("r"))


@query("category_stats", "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, round(avg(l_quantity), 4) AS mean_l_quantity FROM lineitem GROUP BY 1")
def category_stats(spark, d):
    return A.category_stats(_lines(spark, d), "l_returnflag", "l_extendedprice", ("l_quantity",)).withColumns(_r("mean", "std", "mean_l_quantity", digits=4))


@query("quartiles", "WITH q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS c FROM lineitem) SELECT CASE WHEN l_extendedprice < c[1] THEN 1 WHEN l_extendedprice < c[2] THEN 2 WHEN l_extendedprice < c[3] THEN 3 ELSE 4 END AS quartile, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem, q GROUP BY 1")
def quartiles(spark, d):
    return A.quartiles(_lines(spark, d), "l_extendedprice", "l_quantity").withColumns(_r("mean", "std"))


@query("within_doc", "SELECT l_orderkey, count(*) AS n, round(stddev_pop(l_quantity), 6) AS std, (max(l_quantity) - min(l_quantity))::DOUBLE AS range FROM lineitem GROUP BY 1 HAVING count(*) >= 2")
def within_doc(spark, d):
    return A.within_group(_lines(spark, d), "l_orderkey", "l_quantity").withColumn("range", F.col("range").cast("double")).withColumns(_r("std"))


@query("variance_decomp", "WITH o AS (SELECT var_pop(l_quantity) AS v FROM lineitem), w AS (SELECT avg(s * s) AS v FROM (SELECT stddev_pop(l_quantity) AS s FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 2)) SELECT round(o.v, 6) AS overall, round(w.v, 6) AS within, round(greatest(0, o.v - w.v), 6) AS between FROM o, w")
def variance_decomp(spark, d):
    return A.variance_parts(_lines(spark, d), "l_orderkey", "l_quantity").withColumns(_r("overall", "within", "between"))


@query("consistency_extremes", "WITH g AS (SELECT l_orderkey, round(stddev_pop(l_quantity), 6) AS std FROM lineitem GROUP BY 1 HAVING count(*) >= 2) (SELECT *, 'least' AS \"end\" FROM g ORDER BY std, l_orderkey LIMIT 5) UNION ALL (SELECT *, 'most' AS \"end\" FROM g ORDER BY std DESC, l_orderkey LIMIT 5)")
def consistency_extremes(spark, d):
    g = A.within_group(_lines(spark, d), "l_orderkey", "l_quantity").select("l_orderkey", F.round("std", 6).alias("std"))
    return A.extremes(g, "std", "l_orderkey")


_BOUNDS = {
    "percentile": ("quantile_cont(v, 0.02)", "quantile_cont(v, 0.98)"),
    "minmax": ("min(v)", "max(v)"),
    "robust": ("quantile_cont(v, 0.25)", "quantile_cont(v, 0.75)"),
    "zscore": ("avg(v) - 3 * stddev_pop(v)", "avg(v) + 3 * stddev_pop(v)"),
    "mad": ("median(v) - 3 * 1.4826 * mad(v)", "median(v) + 3 * 1.4826 * mad(v)"),
}
for _name, (_low, _high) in _BOUNDS.items():

    @query(f"heatmap_bounds_{_name}", f"SELECT event_type, round({_low}, 6) AS low, round({_high}, 6) AS high FROM (SELECT event_type, value::DOUBLE AS v FROM events) GROUP BY event_type")
    def _heat_bounds(spark, d, name=_name):
        e = D.read(spark, d, "events").select("event_type", F.col("value").cast("double").alias("v"))
        return A.heat_bounds(e, "event_type", "v", name).withColumns(_r("low", "high"))


@query("stratified_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY ((doc_id + 42) * 2654435761) % 1000003, doc_id) AS r FROM documents) WHERE r <= 5")
def stratified_sample(spark, d):
    return A.stratified(D.read(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 5, seed=42)


# contexts

_RESULTS = f"{PATCHES}, {QUERY}, {SIMS}, {BEST}, {SCORED}, ranked AS (SELECT query_id, page, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM scored QUALIFY rank <= 3), shown AS (SELECT query_id, rank, concat(source, ' - Page ', doc_id, ' of 25') AS label, concat('http://h/', doc_id, '.jpg') AS url, text FROM ranked JOIN documents ON doc_id = page)"


def _shown(spark, d):
    found = S.search(D.patches(spark, d), D.queries(spark, d), 3)
    docs = D.read(spark, d, "documents").select(F.col("doc_id").alias("page"), T.page_label(F.col("source"), F.col("doc_id"), F.lit(25)).alias("label"), F.format_string("http://h/%d.jpg", "doc_id").alias("image_url"), "text")
    return found.join(docs, "page")


@query("citations", f"WITH {_RESULTS} SELECT query_id, string_agg(concat(rank, '. [', label, '](', url, ')'), chr(10) ORDER BY rank) AS citations FROM shown GROUP BY query_id")
def citations(spark, d):
    return X.citations(_shown(spark, d))


@query("context_blocks", f"""WITH {_RESULTS} SELECT query_id, concat('Based on the search results for "q', query_id, '", here are the relevant document contents:', chr(10), chr(10), '**Available Documents:**', chr(10), string_agg(concat(rank, '. ', label), chr(10) ORDER BY rank), chr(10), chr(10), '**Important:** When citing information, use the EXACT document labels shown above.', chr(10), chr(10), '---', chr(10), chr(10), string_agg(concat('## ', label, chr(10), chr(10), trim(text)), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rank)) AS context FROM shown GROUP BY query_id""")
def context_blocks(spark, d):
    return X.build(_shown(spark, d), F.concat(F.lit("q"), F.col("query_id").cast("string")))


@query("dedupe_keep_first", "SELECT role, conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1")
def dedupe_keep_first(spark, d):
    c = D.read(spark, d, "conversations").withColumn("k", F.concat_ws("/", F.col("conv_id").cast("string"), "role"))
    return X.first_seen(c.dropDuplicates(["conv_id", "turn", "role"]), "k", "turn").select("role", "conv_id", "turn")


@query("multipage_text", "SELECT conv_id, string_agg(concat('### Page ', turn, chr(10), chr(10), coalesce(text, '')), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY turn, concat('### Page ', turn, chr(10), chr(10), coalesce(text, ''))) AS text FROM conversations GROUP BY conv_id")
def multipage_text(spark, d):
    return X.multipage(D.read(spark, d, "conversations").withColumnRenamed("turn", "page_number"), "conv_id")


# catalogue and progress


@query("collection_status", "SELECT count(*) AS vectors_count, count(DISTINCT source) AS unique_files, round(count(*) * 64 * 4 / 1048576, 2) AS size_mb FROM documents")
def collection_status(spark, d):
    return C.collection_status(D.read(spark, d, "documents").select(F.col("source").alias("filename")), {"original": 64})


@query("doc_pages", "SELECT DISTINCT doc_id % 25 AS page_number FROM documents WHERE source = 'src3'")
def doc_pages(spark, d):
    return C.document_pages(D.read(spark, d, "documents").select(F.col("source").alias("filename"), (F.col("doc_id") % 25).alias("page_number")), "src3")


@query("object_status", "SELECT count(*) AS object_count, sum(n_chars)::BIGINT AS total_bytes, count_if(doc_id % 2 = 0) AS image_count, count_if(doc_id % 2 = 1) AS ocr_count FROM documents")
def object_status(spark, d):
    path = F.when(F.col("doc_id") % 2 == 0, F.lit("d/1/image/x.jpg")).otherwise(F.lit("d/1/ocr/x.json"))
    return C.object_status(D.read(spark, d, "documents").select(path.alias("path"), F.col("n_chars").alias("length")))


@query("batch_outcomes", "SELECT source, count_if(n_chars > 500) AS successful, count_if(n_chars <= 500) AS failed, count(*) AS total FROM documents GROUP BY source")
def batch_outcomes(spark, d):
    s = F.when(F.col("n_chars") > 500, "success").otherwise("error")
    return C.batch_outcomes(D.read(spark, d, "documents").withColumn("status", s), "source")


@query("progress_changes", "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE r = 1 OR before <> event_type")
def progress_changes(spark, d):
    return C.progress_changes(D.read(spark, d, "events"), "user_id", "event_id", ("event_type",)).select("event_id", "user_id", "event_type")


@query("batch_completion", "SELECT user_id, count(DISTINCT event_type) AS n_stages FROM events GROUP BY user_id HAVING count(DISTINCT event_type) >= 4")
def batch_completion(spark, d):
    return C.complete_batches(D.read(spark, d, "events").withColumnRenamed("event_type", "stage"), ("user_id",), 4)


@query("job_percent", "SELECT event_id, (CASE WHEN event_id % 8 = 0 THEN 0 ELSE round_even(100.0 * (event_id % 5) / (event_id % 8), 0) END)::INT AS pct FROM events")
def job_percent(spark, d):
    return D.read(spark, d, "events").select("event_id", C.percent(F.col("event_id") % 5, F.col("event_id") % 8).alias("pct"))


@query("upsert_last", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def upsert_last(spark, d):
    e = D.read(spark, d, "events").select("user_id", "event_id")
    e = e.crossJoin(F.broadcast(e.agg((F.max("event_id") * 0.99).alias("since"))))
    late = F.coalesce(F.col("event_id") >= F.col("since"), F.lit(False))
    stored = C.upsert(None, e.where(~late), "user_id", "event_id")  # a row of each user, which the last hundredth of the events replaces or leaves
    return C.upsert(stored, e.where(late), "user_id", "event_id").select("user_id", "event_id")


@query("slow_stages", "SELECT event_id, CASE WHEN event_id % 7 > 5 THEN 'slow' ELSE 'ok' END AS pace FROM events")
def slow_stages(spark, d):
    return D.read(spark, d, "events").select("event_id", C.pace(F.lit("ocr"), (F.col("event_id") % 7).cast("double")).alias("pace"))


@query("job_states", "WITH s AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'running' END AS status, event_id % 100 AS current FROM events) SELECT user_id AS job_id, CASE WHEN bool_or(status = 'completed') THEN 'completed' ELSE 'running' END AS status, max(current) AS current FROM s GROUP BY user_id")
def job_states(spark, d):
    s = F.when(F.col("event_type") == "purchase", "completed").otherwise("running")
    e = D.read(spark, d, "events").select(F.col("user_id").alias("job_id"), "ts", s.alias("status"), (F.col("event_id") % 100).alias("current"), F.lit(100).alias("total"))
    return I.job_states(e).select("job_id", "status", "current")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    got = I.windowed(D.read(spark, d, "events"), "ts", "1 hour", None, "10 minutes", "event_type")
    return got.select("start", "event_type", "n", F.round("total", 4).alias("total"))


from . import document_queries, index_queries, service_queries, text_queries  # noqa: E402, F401  (they register their queries)
