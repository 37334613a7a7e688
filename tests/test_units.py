"""Hand-computed and property tests of functions and operators."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pagegrain.functions import geometry as G
from pagegrain.functions import grounding as O
from pagegrain.functions import text as T
from pagegrain.functions import vectors as V
from pagegrain.operators import analysis as A
from pagegrain.operators import catalog as C
from pagegrain.operators import context as X
from pagegrain.operators import evaluate as E
from pagegrain.operators import pooling as P
from pagegrain.operators import regions as R
from pagegrain.operators import search as S
from pagegrain.plans import registry
from pagegrain.plans import retrieval as Q
from pagegrain.sources import files, models, pages
from pagegrain.sources import tables as D
from pagegrain.streaming import ingest as I


def value(spark, column, **columns):
    names = {k: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for k, v in columns.items()}
    return spark.range(1).select(*(c.alias(k) for k, c in names.items()), F.lit(0).alias("_")).select(column.alias("x")).first()[0]


def test_iou_properties(spark):
    rnd = random.Random(1)
    rows = [tuple(rnd.randrange(-20, 60) for _ in range(8)) for _ in range(300)]
    df = spark.createDataFrame(rows, "x1 int, y1 int, x2 int, y2 int, b_x1 int, b_y1 int, b_x2 int, b_y2 int")
    for r in df.select("*", G.iou(G.box(), G.box("b_")).alias("ab"), G.iou(G.box("b_"), G.box()).alias("ba"), G.iou(G.box(), G.box()).alias("aa")).collect():
        assert r.ab == r.ba and 0 <= r.ab <= 1 and r.aa == (1.0 if r.x2 > r.x1 and r.y2 > r.y1 else 0.0)


def test_vectors(spark):
    a, b = [3.0, 0.0, -4.0], [0.0, 2.0, -1.0]
    assert value(spark, V.dot(F.col("a"), F.col("b")), a=a, b=b) == 4.0 and value(spark, V.norm(F.col("a")), a=a) == 5.0
    assert abs(value(spark, V.cosine(F.col("a"), F.col("b")), a=a, b=b) - 4 / (5 * math.sqrt(5))) < 1e-12
    assert value(spark, V.cosine(F.col("a"), F.col("b")), a=[0.0], b=[1.0]) is None and value(spark, V.cosine(F.col("a"), F.col("b"), 1e-8), a=[0.0], b=[1.0]) == 0.0
    assert value(spark, V.sign_code(F.col("a"), 3), a=a) == [1] and value(spark, V.hamming(F.col("a"), F.col("b")), a=[5, 1], b=[6, 0]) == 3
    assert value(spark, V.valid(F.col("a"), 3), a=a) and not value(spark, V.valid(F.col("a"), 2), a=a)


def test_search_properties(spark, sf):
    p, q = D.patches(spark, sf), D.queries(spark, sf).where("query_id = 2")
    score = {r.page: r.score for r in S.maxsim(p, q).collect()}
    native = p.crossJoin(q.select("token", F.col("vec").alias("w"))).select("page", "token", V.cosine(F.col("vec"), F.col("w")).alias("sim")).groupBy("page", "token").agg(F.max("sim").alias("s")).groupBy("page").agg(F.sum("s").alias("s"))
    assert all(abs(score[r.page] - r.s) < 1e-9 for r in native.collect())
    shuffled = {r.page: r.score for r in S.maxsim(p.orderBy(F.rand(3)), q).collect()}
    assert all(abs(score[k] - v) < 1e-9 for k, v in shuffled.items())
    exact = [r.page for r in S.search(p, q, 5).orderBy("rank").collect()]
    two = S.two_stage(p, P.pool(p, "py", False), P.pool(p, "px", False), q, k=5, prefetch=1000)
    assert [r.page for r in two.orderBy("query_id", "rank").collect()] == exact
    few = {r.page for r in S.two_stage(p, P.pool(p, "py", False), P.pool(p, "px", False), q, k=5, prefetch=2).collect()}
    assert few <= set(score) and len(few) <= 4
    assert [r.page for r in S.quantised(p, q, 64, k=5, oversampling=100).orderBy("rank").collect()] == exact
    assert len(S.quantised(p, q, 64, k=3, rescore=False).collect()) == 3
    assert S.maxsim(p, q.limit(0)).count() == 0 and S.clamp_k(0) == 1 and S.clamp_k(99, high=50) == 50
    with pytest.raises(ValueError):
        S.payload_filter({1: 2})
    with pytest.raises(ValueError):
        S.maxsim(p, q, "median")


def test_many_query_tokens_take_the_general_form(spark, sf, monkeypatch):
    p, q = D.patches(spark, sf), D.queries(spark, sf)
    want = {(r.query_id, r.page): r.score for r in S.maxsim(p, q).collect()}
    monkeypatch.setattr(S, "MAX_QUERY_TOKENS", 2)
    monkeypatch.setattr(S, "PACKED", 7)
    got = {(r.query_id, r.page): r.score for r in S.maxsim(p, q).collect()}
    assert got.keys() == want.keys() and all(abs(want[k] - v) < 1e-9 for k, v in got.items())


def test_one_kernel_for_all_similarities(spark, sf, monkeypatch):
    """Every use of the kernel against the expressions, in one block and in many, with vectors that have no similarity."""
    odd = spark.createDataFrame([(999, 0, 0, [0.0] * 64), (999, 1, 0, [1.0]), (999, 2, 0, None), (999, 3, 0, [None, *[1.0] * 63])], "page long, px int, py int, vec array<float>")
    p = D.patches(spark, sf).select("page", "px", "py", "vec").union(odd)
    q = D.queries(spark, sf).where("query_id < 3")
    pairs = p.join(q.select("query_id", "token", F.col("vec").alias("w"))).select("query_id", "token", "page", "px", "py", V.cosine(F.col("vec"), F.col("w")).alias("sim")).where("sim is not null")
    key = lambda *c: lambda rows: {tuple(r[k] for k in c): r[-1] for r in rows.collect()}
    near = lambda a, b: a.keys() == b.keys() and all(abs(a[k] - v) < 1e-9 for k, v in b.items())
    place = ("query_id", "page", "px", "py")
    every = key("query_id", "token", "page", "px", "py")(pairs)
    assert len(every) == 9 * 500
    folds = {"max": F.max, "mean": F.avg, "sum": F.sum, "other": F.max}
    want = {n: key(*place)(pairs.groupBy(*place).agg(f("sim"))) for n, f in folds.items()}
    for most, packed, product in ((4096, 4096, 32 << 20), (4, 50, 32 << 20), (4096, 4096, 8 * 9 * 5)):
        for name, value in (("MAX_QUERY_TOKENS", most), ("PACKED", packed), ("PRODUCT_BYTES", product)):
            monkeypatch.setattr(S, name, value)
        assert near(key("query_id", "token", "page", "px", "py")(S.similarities(p, q)), every)
        for n in folds:
            assert near(key(*place)(S.patch_scores(p, q, n)), want[n])
        got = S.nearest(p, q, 4).collect()
        best = sorted(((a, b), -v, c, d, e) for (a, b, c, d, e), v in every.items())
        expected = {(k, x[2:]) for k in {b[0] for b in best} for x in [b for b in best if b[0] == k][:4]}
        assert {((r.query_id, r.token), (r.page, r.px, r.py)) for r in got} == expected


def test_recall_of_candidates(spark):
    """Against exact scores of every query on the larger table: all of them by pooled vectors, nine in ten by levels."""
    d = "/root/testdata/sf0.1"
    p, q = D.patches(spark, d).cache(), D.queries(spark, d)
    pages = lambda df: {(r.query_id, r.page) for r in df.collect()}
    exact = pages(S.search(p, q, 5))
    assert len(exact) == 100
    share = lambda df: len(exact & pages(df)) / len(exact)
    assert share(S.two_stage(p, P.pool(p, "py", False), P.pool(p, "px", False), q, k=5)) >= 0.9
    assert share(S.quantised(p, q, 64, k=5, levels=True)) >= 0.9


def test_search_regions_meets_found_pages_alone(spark, sf):
    o = Q.Options(k=2, threshold=0.0)
    plan = Q.search_regions(D.patches(spark, sf), D.regions(spark, sf), D.queries(spark, sf), 5, 4, 500, 400, o)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_pooling_of_a_constant_grid_and_other_tokens(spark):
    rows = [(0, i, [1.0, 2.0]) for i in range(8)]
    tokens = spark.createDataFrame(rows, "page int, idx int, vec array<double>")
    placed = P.grid_places(tokens, 3, 2, global_tokens=2)
    out = P.pool(placed, "py").collect()
    assert len(out) == 4 and all(r.vec == [1.0, 2.0] for r in out)
    with pytest.raises(Exception, match="patches"):
        P.grid_places(tokens, 3, 3).count()


def test_map_layouts(spark):
    maps = spark.createDataFrame([(0, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])], "page int, similarity_map array<array<double>>")
    xy = {(r.px, r.py): r.sim for r in R.place_maps(maps, "xy").collect()}
    yx = {(r.px, r.py): r.sim for r in R.place_maps(maps, "yx").collect()}
    assert xy[1, 2] == 6.0 and yx[2, 1] == 6.0 and len(xy) == 6


def test_relevance_by_hand(spark):
    regions = spark.createDataFrame([(0, 1, 0, 0, 20, 10), (0, 2, 90, 90, 99, 99), (0, 3, 5, 5, 5, 5), (0, 4, 30, 0, 10, 10)], "page int, region_id int, x1 int, y1 int, x2 int, y2 int")
    scores = spark.createDataFrame([(0, 0, 0, 0, 0.2), (0, 0, 1, 0, 0.8), (0, 0, 0, 1, -1.0)], "query_id int, page int, px int, py int, score double")
    got = {a: {r.region_id: r.score for r in R.relevance(regions, scores, 3, 3, 30, 30, a).collect()} for a in ("iou_weighted", "max", "mean", "max_floor")}
    assert abs(got["iou_weighted"][1] - 0.5) < 1e-12 and got["max"][1] == 0.8 and got["mean"][1] == 0.5 and got["max_floor"][1] == 0.8
    assert all(got[a][i] == 0.0 for a in got for i in (2, 4))
    assert (got["iou_weighted"][3], got["max"][3], got["mean"][3], got["max_floor"][3]) == (0.0, 0.2, 0.2, 0.0)  # the cells a flat box touches, and those it overlaps
    assert {r.region_id for r in R.relevance(regions, scores, 3, 3, 30, 30, keep_invalid=False).collect()} == {1, 3}
    with pytest.warns(UserWarning, match="median"):
        other = {r.region_id: r.score for r in R.relevance(regions, scores, 3, 3, 30, 30, "median").collect()}
    assert other == got["iou_weighted"]


def test_selection_is_monotone_and_stable(spark):
    rows = spark.createDataFrame([(0, 0, i, s) for i, s in enumerate([0.1, 0.5, 0.5, 0.9, 0.3])], "query_id int, page int, region_id int, score double")
    sizes = [R.select(rows, threshold=t).count() for t in (0.0, 0.3, 0.5, 0.95)]
    assert sizes == sorted(sizes, reverse=True) == [5, 4, 3, 0]
    assert [r.region_id for r in R.select(rows, top_k=3).orderBy("rank").collect()] == [3, 1, 2]
    assert R.select(rows, "max").count() == 1 and R.select(rows, top_k=0).count() == 5
    with pytest.raises(ValueError):
        R.select(rows, "median")


RAW = "<|ref|>title<|/ref|><|det|>[[0, 0, 999, 100]]<|/det|>\nHead\n<|ref|>text<|/ref|><|det|>[[10, 80, 500, 200], [10, 210, 500]]<|/det|>\nBody <|x|>line\n<|ref|>image<|/ref|><|det|>[[1, 1, 9, 9]]<|/det|>\n<|ref|>figure<|/ref|><|det|>[[2, 2, 9, 9]]<|/det|>cap<|ref|>text<|/ref|><|det|>oops<|/det|>Last"


def test_grounding(spark):
    rows = spark.createDataFrame([(1, RAW), (2, "plain"), (3, None)], "k int, raw string")
    got = O.regions(rows, "raw", 1000, 2000, "k").orderBy("ord").collect()
    assert [(r.ord, r.label, r.content, r.image_index) for r in got] == [(1, "title", "Head", None), (2, "text", "Body line", None), (3, "image", None, 0), (4, "figure", "cap", 1)]
    assert (got[0].x2, got[0].y2, got[0].region_id) == (1000, 200, "1#region-1")
    texts = {r.k: r for r in rows.select("k", O.clean(F.col("raw"), include_images=True).alias("a"), O.clean(F.col("raw"), remove_labels=True).alias("b")).collect()}
    assert "**[Figure 1]**" in texts[1].a and texts[1].a.startswith("title\nHead") and texts[1].b.startswith("Head") and (texts[2].a, texts[3].a) == ("plain", "")
    assert value(spark, O.embed(F.col("m"), F.col("c")), m="a **[Figure 1]** b", c=["QQ=="]) == "a \n\n![Figure 1](data:image/png;base64,QQ==)\n\n b"
    assert "Describe" in value(spark, O.prompt(F.lit("describe"), F.lit("")))
    with pytest.raises(Exception, match="unknown task"):
        value(spark, O.prompt(F.lit("fly"), F.lit("")))


def test_texts(spark):
    one = lambda c, **k: value(spark, c, **k)
    t = F.col("t")
    assert one(T.segments(t), t=" a \n\n b\r\nc ") == ["a", "b", "c"] and one(T.slugify(t), t="Héllo  World!") == "h-llo-world" and one(T.slugify(t), t="!!") == "documents"
    url = T.parse_files_url(t)
    assert one(url["bucket"], t=" http://h/files/docs/a/b.png ") == "docs" and one(url["path"], t="/files/docs/a/b.png") == "a/b.png" and one(url["path"], t="/files/docs/") is None and one(url["path"], t="/x/docs/a") is None
    assert one(T.object_name(t, "docs"), t="http://h:1/files/docs/a/b.png?x=1") == "a/b.png" and one(T.object_name(t, "docs"), t="http://h/other/a") is None and one(T.object_name(t, "docs"), t="http://h/files/docs") is None
    assert one(T.replace_numbered(t, F.col("u")), t="![Figure 1](data:image/png;base64,AA) ![Figure 2](data:image/png;base64,BB)", u=["http://x/$1"]) == "![Figure 1](http://x/$1) ![Figure 2](data:image/png;base64,BB)"
    figures = F.create_map(F.lit(1), F.lit("u1"), F.lit(2), F.lit("u2"))
    assert one(T.ensure_figures(t, figures), t="see ![Figure 1](old) and ![Figure 3](x)") == "see ![Figure 1](u1) and ![Figure 3](x)\n\n![Figure 2](u2)"
    assert one(T.ensure_figures(t, figures), t="bare ![Figure 2] ok ![Figure 1]") == "bare ![Figure 2](u2) ok ![Figure 1](u1)" and one(T.ensure_figures(t, figures), t="") == "![Figure 1](u1)\n![Figure 2](u2)"
    hidden = json.loads(one(T.redact_json(t), t='{"a":{"api_key":"x","n":1},"Token":5,"b":[{"secret":null}]}'))
    assert hidden == {"a": {"api_key": T.REDACTED, "n": 1}, "Token": T.REDACTED, "b": [{"secret": T.REDACTED}]}
    assert one(T.clean_log(t, ("BASE", "==")), t="ok\n== x\nBASE 1\nfine") == "ok\nfine" and one(T.progress_entry(F.lit("OCR"), F.lit(2), F.lit(5))) == "OCR 2/5" and one(T.parse_list(t), t="a, b,,c") == ["a", "b", "c"]
    assert one(T.valid_version(t), t="1.2.3-rc.1") and not one(T.valid_version(t), t="1.2") and one(T.token_display(t), t="Ġa▁b") == " a b" and one(T.local_images(t), t="![a](http://localhost/x.png) ![b](http://e.com/y)") == ["http://localhost/x.png"]


def test_geometry_sizes(spark):
    size = lambda w, h: value(spark, G.image_tokens(F.lit(w), F.lit(h)))
    assert (size(10, 10), size(1568, 1568), size(3136, 1568), size(750, 2)) == (1, 3278, 1639, 2)
    nx, ny = G.estimate_grid(F.lit(20), F.lit(500), F.lit(400))
    assert (value(spark, nx), value(spark, ny)) == (5, 4) and value(spark, G.percent_saving(F.lit(1), F.lit(0))) == 0.0


def test_evaluation_edges(spark):
    truth = spark.createDataFrame([(1, 0, 0, 0, 10, 10), (1, 1, 50, 50, 60, 60), (2, 0, 0, 0, 4, 4)], "sample_id int, gt_ord int, x1 int, y1 int, x2 int, y2 int")
    predicted = spark.createDataFrame([(1, 0, 0, 10, 10), (1, 0, 0, 10, 20)], "sample_id int, x1 int, y1 int, x2 int, y2 int")
    got = {r.sample_id: (r.mean_iou, r.iou_at_0_5, r.n_gt) for r in E.sample_metrics(E.localise(truth, predicted)).collect()}
    assert got == {1: (0.5, 0.5, 2), 2: (0.0, 0.0, 1)}
    none = spark.createDataFrame([], "mean_iou double, iou_at_0_5 double")
    assert tuple(E.summarise(none).first()) == (0.0, 0.0, 0) and E.hit_rates(none).first().rate_0_5 == 0.0


def test_exact_quantiles(spark):
    rnd = random.Random(8)
    for values in ([rnd.gauss(0, 1) for _ in range(3000)], [5.0] * 500 + [1.0, 9.0], [float(rnd.randrange(4)) for _ in range(900)], [2.0], [float(i) for i in range(5001)]):
        df = spark.createDataFrame([*((v,) for v in values), (None,)], "v double")
        ordered = sorted(values)
        expected = []
        for s in (0.0, 0.25, 0.5, 0.9, 1.0):
            at = s * (len(values) - 1)
            a, b = ordered[math.floor(at)], ordered[math.ceil(at)]
            expected.append(a + (b - a) * (at - math.floor(at)))
        assert A.quantiles(df, "v", (0.0, 0.25, 0.5, 0.9, 1.0), held=40) == pytest.approx(expected, abs=1e-12)
    assert A.quantiles(df.limit(0), "v", (0.5,)) == [None]


def test_p_values():
    assert abs(A.p_value(0.5, 10) - 0.14111328125) < 1e-9 and A.p_value(0.0, 10) == 1.0 and A.p_value(1.0, 5) == 0.0 and A.p_value(None, 5) is None
    assert abs(A.p_value(-0.9, 20) - A.p_value(0.9, 20)) < 1e-15 and A.p_value(0.9, 20) < 1e-6


def test_contexts(spark):
    rows = spark.createDataFrame([(1, 1, "A", "http://a", " text a "), (1, 2, None, None, None), (2, 1, "B", "u", " ")], "query_id int, rank int, label string, image_url string, text string")
    built = {r.query_id: r.context for r in X.build(rows, F.lit("q")).collect()}
    assert list(built) == [1] and built[1].endswith("## A\n\ntext a") and "1. A\n2. Unknown" in built[1]
    assert {r.query_id: r.citations for r in X.citations(rows).collect()} == {1: "1. [A](http://a)\n2. [Unknown]()", 2: "1. [B](u)"}
    regions = spark.createDataFrame([(1, 1, [("Figure", None, "http://f"), ("text", None, "t"), ("chart", "https://c", "x"), ("image", "ftp://z", None)])], "query_id int, rank int, regions array<struct<label:string,image_url:string,content:string>>")
    assert [r.url for r in X.region_images(regions).orderBy("ord").collect()] == ["http://f", "https://c"]
    assert regions.select(X.page_text(F.lit(" "), F.lit(None).cast("string"), F.lit(""), F.col("regions")).alias("t")).first().t is None
    assert regions.select(X.page_text(F.lit(""), F.lit(None).cast("string"), F.lit(""), F.col("regions")).alias("t")).first().t == "t"
    assert regions.select(X.mode(F.lit(True), F.lit(True), F.col("regions")).alias("m")).first().m == "ocr_text_and_images"


def test_catalogue(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "page_id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "page_id int, v string")
    assert {(r.page_id, r.v) for r in C.upsert(old, new, "page_id", "v").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    left, n = C.delete_by(old, "v", "a")
    assert (left.count(), n) == (1, 1)
    assert C.create_if_absent(spark, "unit_points", "page_id int, v string") and not C.create_if_absent(spark, "unit_points", "page_id int")
    with pytest.raises(ValueError):
        C.create_if_absent(spark, "unit_points", "other int")
    old.write.insertInto("unit_points")
    assert C.clear(spark, "unit_points") == 2 and spark.table("unit_points").count() == 0 and (C.drop(spark, "unit_points"), C.drop(spark, "unit_points")) == ("success", "skipped")
    for i in range(3):
        (tmp_path / "p" / str(i)).mkdir(parents=True)
        (tmp_path / "p" / str(i) / "f").write_text("x")
    assert files.objects(spark, str(tmp_path / "p")).count() == 3 and C.delete_prefix(spark, str(tmp_path / "p")) == {"deleted": 3, "failed": 0} and C.delete_prefix(spark, str(tmp_path / "p")) == {"deleted": 0, "failed": 0}
    checks = spark.createDataFrame([("store", True), ("ocr", False)], "name string, ok boolean")
    assert tuple(C.health(checks).first()) == (True, 1) and [value(spark, C.percent(F.lit(a), F.lit(b))) for a, b in ((1, 8), (3, 8), (1, 0), (1, 200))] == [12, 38, 0, 0]


def test_upsert_query_keeps_and_replaces_stored_rows(spark, tmp_path, monkeypatch):
    rows = [(1, 0), (1, 1000), (2, 3), (2, 1), (3, 995), (4, 2), (4, 991), (4, 990), (5, 994)]
    spark.createDataFrame(rows, "user_id long, event_id long").write.parquet(str(tmp_path / "events.parquet"))
    calls, real = [], C.upsert
    monkeypatch.setattr(C, "upsert", lambda stored, new, *a, **k: calls.append((stored, new)) or real(stored, new, *a, **k))
    got = sorted(map(tuple, registry.QUERIES["upsert_last"](spark, str(tmp_path)).collect()))
    stored, new = ({r.user_id for r in df.collect()} for df in calls[-1])
    assert (stored - new, stored & new, new - stored) == ({2}, {1, 4}, {3, 5}) and got == [(1, 1000), (2, 3), (3, 995), (4, 991), (5, 994)]


def test_evaluation_files(spark, tmp_path):
    lines = [{"question": "q", "images": ["a.png"], "bbox": [[[1, 2, 3, 4]], [5, 6, 7, 8], [1, 2, 3]], "doc_name": "d", "category": "cs"}, {"query": "f", "image_paths": ["b.png"], "bbox": "x"}, {"question": " ", "images": ["c"]}, {"question": "z", "images": []}]
    (tmp_path / "s.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    got = files.samples(spark, str(tmp_path / "s.jsonl")).orderBy("sample_id").collect()
    assert [r.sample_id for r in got] == [0, 1, 2, 3] and got[0].boxes == [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0, 7.0, 8.0]] and got[1].question == "f" and [r.skip for r in got] == [None, None, "blank question", "no image"]
    assert files.samples(spark, str(tmp_path / "s.jsonl"), docs=["d"]).count() == 1 and files.samples(spark, str(tmp_path / "s.jsonl"), ids=[1, 2], limit=1).first().sample_id == 1
    (tmp_path / "run.json").write_text(json.dumps({"failed_count": 1, "sample_results": [{"sample_id": 1, "mean_iou": 0.5, "failed": False}, {"sample_id": 2, "failed": True}]}))
    assert files.run_summary(spark, str(tmp_path / "run.json")).where("not failed").count() == 1
    assert files.runs(spark, {"m": str(tmp_path / "run.json"), "gone": str(tmp_path / "no.json")}).select("model").distinct().count() == 1
    table = spark.createDataFrame([("cs", 0.5, 3), ("math", 0.25, 1)], "category string, iou double, n int")
    files.write_report(table, str(tmp_path / "report"), ["category", "iou", "n"], "category")
    back = files.report(spark, str(tmp_path / "report"))
    assert {(r.category, r.n, r.mean_iou, r.hits) for r in files.report_metrics(back, 0, 1).collect()} == {("cs", 1, 0.5, 1), ("math", 1, 0.25, 0)}
    sse = spark.createDataFrame([('data: {"a":1}\n\n: beat\n\ndata: {bad\n\ndata: {"a":2}\n\n',)], "value string")
    assert [json.loads(r.e)["a"] for r in files.sse_events(sse).select(F.to_json("event").alias("e")).collect()] == [1, 2]


def test_page_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 /Type /Pages " + b"/Type /Page x " * 9)
    (tmp_path / "b.pdf").write_bytes(b"broken /Type /Page ")
    spark.dataSource.register(pages.PageSource)
    rows = spark.read.format("pages").option("path", str(tmp_path)).option("batchSize", "4").load().collect()
    assert sorted(r.page_number for r in rows) == list(range(1, 10)) and {r.total_pages for r in rows} == {9}


def test_models(spark):
    rows = spark.createDataFrame([(1, "two words"), (2, None)], "k long, t string")
    got = models.embed(rows, "t", lambda: models.HashEmbedder(8), "k").collect()
    assert len([r for r in got if r.k == 1 and len(r.vec) == 8]) == 2 and [r.error is not None for r in got if r.k == 2] == [True]
    assert models.ocr(rows, "t", lambda: lambda x, task: f"{task}:{len(x)}", "k").where("raw = 'markdown:9'").count() == 1


def test_options_from_conf(spark):
    spark.conf.set("spark.pagegrain.k", "3")
    spark.conf.set("spark.pagegrain.pooling", "true")
    assert (Q.Options.from_conf(spark).k, Q.Options.from_conf(spark).pooling) == (3, True)
    spark.conf.unset("spark.pagegrain.k")
    spark.conf.unset("spark.pagegrain.pooling")


def test_region_join_hashes(spark, sf):
    r, s = D.regions(spark, sf), R.patch_scores(S.similarities(D.patches(spark, sf), D.queries(spark, sf)))
    plan = R.relevance(r, s, 5, 4, 500, 400)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_streaming_ingest(spark, sf, tmp_path):
    src, schema = str(tmp_path / "in"), D.read(spark, sf, "events").schema
    D.read(spark, sf, "events").limit(300).repartition(3).write.parquet(src)
    shape = lambda b: b.select(F.col("event_id").alias("page_id"), "event_type", "ts")
    run = lambda: I.ingest(I.landing(spark, src, schema, 1), shape, str(tmp_path / "out"), str(tmp_path / "ck"), "page_id", "ts").awaitTermination(60)
    assert run() and I.latest(spark, str(tmp_path / "out")).count() == 300
    D.read(spark, sf, "events").limit(10).write.mode("append").parquet(src)
    assert run() and I.latest(spark, str(tmp_path / "out")).count() == 300  # keyed: the same rows again


def test_streaming_completions_and_states(spark, sf, tmp_path):
    src = str(tmp_path / "ev")
    rows = [(1, s, f"2024-01-01 00:00:{i:02d}") for i, s in enumerate(["a", "b", "b", "c"])] + [(2, "a", "2024-01-01 00:00:09")]
    df = spark.createDataFrame(rows, "k int, stage string, t string").select("k", "stage", F.to_timestamp("t").alias("ts"))
    df.write.parquet(src)
    q = I.completions(I.landing(spark, src, df.schema), ("k",), 3).writeStream.outputMode("complete").format("memory").queryName("done").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.k for r in spark.table("done").collect()] == [1]
    jobs = spark.createDataFrame([("j", 1, "running", 1), ("j", 2, "failed", 2), ("j", 3, "running", 3), ("i", 1, "running", 1)], "job_id string, s int, status string, current int")
    jobs = jobs.select("job_id", F.timestamp_seconds("s").alias("ts"), "status", "current", F.lit(5).alias("total"))
    states = {r.job_id: r.status for r in I.job_states(jobs).collect()}
    assert states == {"j": "failed", "i": "running"}
    now = F.timestamp_seconds(F.lit(100))
    assert [r.job_id for r in I.stalled(jobs.where("job_id = 'i'"), now).collect()] == ["i"] and I.expired(I.job_states(jobs), F.timestamp_seconds(F.lit(1000))).count() == 1
