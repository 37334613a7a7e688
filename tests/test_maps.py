"""Whole pages against all queries, beside the joins that say the same."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagegrain.functions import vectors as V
from pagegrain.operators import analysis as A
from pagegrain.operators import maps as M
from pagegrain.operators import regions as R
from pagegrain.operators import search as S
from pagegrain.plans import registry

BOXES = "page long, region_id long, x1 int, y1 int, x2 int, y2 int"


def near(rows, digits=9):
    return sorted((tuple(round(v, digits) + 0.0 if isinstance(v, float) else v for v in r) for r in rows.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    """Pages with vectors that have no similarity, a page without regions and one without patches, an id that comes twice, boxes without a cell."""
    rnd = random.Random(5)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(8)]
    patches = [(p, x, y, vec()) for p in range(6) for x in range(5) for y in range(4) if (p + x * y) % 7]
    patches += [(1, 0, 0, [0.0] * 8), (1, 2, 2, [1.0]), (2, 3, 3, None), (3, None, None, vec()), (8, 0, 0, vec()), (None, 0, 0, vec())]
    boxes = [(p, 10 * p + r, *(b := (rnd.randrange(450), rnd.randrange(350))), b[0] + rnd.randrange(1, 160), b[1] + rnd.randrange(1, 160)) for p in range(7) for r in range(9)]
    boxes += [(0, 3, 0, 0, 40, 40), (1, 19, 600, 600, 700, 700), (2, 29, 50, 50, 50, 50), (4, 49, 100, 100, 200, 200)]
    queries = [(q, t, vec()) for q in range(7) for t in range(1 + q % 3)] + [(9, 0, [0.0] * 8), (9, 1, None)]
    make = spark.createDataFrame
    return make(patches, "page long, px int, py int, vec array<double>").repartition(3), make(boxes, BOXES).repartition(2), make(queries, "query_id long, token long, vec array<double>")


@pytest.mark.parametrize("limit", [1 << 15, 3])
@pytest.mark.parametrize("options", [{}, {"aggregate": "max"}, {"aggregate": "mean"}, {"eps": 1e-8, "min_overlap": 0.05}, {"aggregate": "max_floor", "min_overlap": 0.05}, {"aggregate": "max_floor"}])
def test_region_scores_equal_the_joins(spark, tables, options, limit, monkeypatch):
    patches, regions, queries = tables
    want = near(R.relevance(regions, S.patch_scores(patches, queries), 5, 4, 500, 400, **options))
    monkeypatch.setattr(S, "MAX_QUERY_TOKENS", limit)
    monkeypatch.setattr(M, "PIECE", 40)
    assert near(M.region_scores(patches, regions, queries, 5, 4, 500, 400, **options)) == want and want


@pytest.mark.parametrize("select", [{"method": "adaptive"}, {"method": "percentile", "percentile": 70.0}, {"method": "max"}, {"top_k": 3}, {"threshold": 0.1, "top_k": 2}])
def test_selected_regions_equal_the_windows(tables, select):
    patches, regions, queries = tables
    regions = regions.dropDuplicates(["region_id"])
    want = R.select(M.region_scores(patches, regions, queries, 5, 4, 500, 400, digits=9), **select)
    assert near(M.region_scores(patches, regions, queries, 5, 4, 500, 400, digits=9, select=select)) == near(want.select("query_id", "page", "region_id", "score", "rank"))


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n.startswith(("region_relevance_", "region_threshold_"))])
def test_what_pages_and_queries_make_is_never_shuffled(spark, sf, name):
    """The kernel's rows, pages times queries, are the result: no exchange, sort or window comes after it."""
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    after = plan[: plan.index("MapInArrow")]
    assert not any(x in after for x in ("Join", "Aggregate", "Window", "Sort", "Repartition")), after


def test_heat_equals_the_windows(tables, monkeypatch):
    patches, _, queries = tables
    want = near(A.heat(A.normalise(S.patch_scores(patches, queries), "score", "query_id", "page"), "score", "query_id", "page").select("query_id", "page", "px", "py", "normal", "heat"))
    monkeypatch.setattr(M, "PIECE", 40)
    got = M.heat(patches, queries)
    assert near(got) == want and want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.startswith("MapInArrow")


def test_guarded_cosine_equals_the_expression(tables, monkeypatch):
    patches, _, queries = tables
    queries = queries.union(queries.sparkSession.createDataFrame([(11, 0, [None, *[1.0] * 7]), (12, 0, [1.0])], queries.schema))
    patches = patches.union(patches.sparkSession.createDataFrame([(7, 0, 0, [1.0, None, *[1.0] * 6])], patches.schema))
    pairs = patches.crossJoin(queries.select("query_id", F.col("vec").alias("w"))).select("query_id", "page", "px", "py", V.cosine(F.col("vec"), F.col("w"), 1e-8))
    got = S.guarded(patches, queries)
    assert near(got) == near(pairs)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(S, "MAX_QUERY_TOKENS", 3)
    assert near(S.guarded(patches, queries)) == near(pairs)


def _same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, cursor = registry.QUERIES[name](spark, str(folder)), con.execute(registry.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, cursor.fetchall()))


@pytest.mark.parametrize("name", ["pool_rows", "pool_cols"])
def test_a_small_negative_mean_keeps_its_sign(spark, tmp_path, name):
    rows = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    small = pa.array([[-1e-9] * 64] * len(rows), rows.schema.field("embedding").type)
    pq.write_table(rows.set_column(rows.schema.get_field_index("embedding"), rows.schema.field("embedding"), small), tmp_path / "embeddings.parquet")
    pq.write_table(pq.read_table("/root/testdata/sf0.001/documents.parquet"), tmp_path / "documents.parquet")
    _same_as_sql(spark, tmp_path, name)


def test_regions_of_equal_score_go_by_id(spark, tmp_path):
    """All patches alike: scores are one but for noise of the sums, and of a page's regions those of least id are shown."""
    rows = pq.read_table("/root/testdata/sf0.001/embeddings.parquet")
    same = pa.array([[0.1, 0.7] * 32] * len(rows), rows.schema.field("embedding").type)
    pq.write_table(rows.set_column(rows.schema.get_field_index("embedding"), rows.schema.field("embedding"), same), tmp_path / "embeddings.parquet")
    pq.write_table(pq.read_table("/root/testdata/sf0.001/documents.parquet"), tmp_path / "documents.parquet")
    got = registry.QUERIES["search_regions"](spark, str(tmp_path)).collect()
    shown = {}
    for r in got:
        shown.setdefault((r.query_id, r.page), []).append(r.region_id)
    assert shown and all(sorted(v) == list(range(40 * page, 40 * page + 4)) for (_, page), v in shown.items())


@pytest.mark.parametrize("combine", ["sum", "mean"])
def test_a_task_keeps_the_best_pages_of_each_query(tables, combine, monkeypatch):
    """The same pages as by all scores, ties by page, in one product and in many; pages times queries leave no task."""
    patches, _, queries = tables
    twins = patches.where("page = 2").select(F.lit(12).cast("long").alias("page"), "px", "py", "vec")
    patches = patches.union(twins)
    for k in (1, 3, 99):
        want = near(S.top(S.maxsim(patches, queries, combine).withColumn("score", F.round("score", 9)), k))
        for product in (8 << 20, 8 * 5, 8 * 60):
            monkeypatch.setattr(S, "PRODUCT_BYTES", product)
            got = S.ranked(patches, queries, k, combine)
            assert near(got) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("MapInArrow")]
    assert S.ranked(patches, queries.limit(0), 3).count() == 0


@pytest.mark.parametrize("name", ["quantized_filtered", "two_stage_search", "citations", "context_blocks", "engine_search"])
def test_searches_shuffle_no_score_of_every_page(spark, sf, name, monkeypatch):
    def never(*_, **__):
        raise AssertionError("a row for each page, token and query")

    monkeypatch.setattr(S, "best", never)
    assert registry.QUERIES[name](spark, sf).count() > 0
