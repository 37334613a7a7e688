"""An index that changes by batches: what a batch writes, what a reader sees, merging by range; grids by page; filters in every kind of search."""

import pytest
from pyspark.sql import functions as F

from pagegrain.operators import regions as R
from pagegrain.operators import search as S
from pagegrain.plans.engine import TABLES, Engine
from pagegrain.plans.retrieval import Options
from pagegrain.plans.store import HIGH, LOW, Conflict, Store
from pagegrain.sources import models

SCHEMAS = {"points": "page_id bigint, name string", "patches": "page bigint, idx int"}


def store(spark, path):
    return Store(spark, str(path), SCHEMAS, {"points": "page_id"})


def batch(spark, lo, hi, name, n=2):
    pages = spark.range(lo, hi).select(F.col("id").alias("page"))
    return {"points": pages.select(F.col("page").alias("page_id"), F.lit(name).alias("name")), "patches": pages.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("page", F.col("idx").cast("int"))}, pages


def names(s):
    return {r.page_id: r.name for r in s.read("points").collect()}


def counts(s):
    return {r.page: r["count"] for r in s.read("patches").groupBy("page").count().collect()}


def test_newest_run_wins_before_and_after_merging(spark, tmp_path):
    s = store(spark, tmp_path)
    assert names(s) == {} and s.read("patches").columns == ["page", "idx"]
    s.put(*batch(spark, 0, 20, "a"))
    s.put(*batch(spark, 5, 8, "b", 1))
    want = {i: "b" if 5 <= i < 8 else "a" for i in range(20)}
    assert names(s) == want and counts(s) == {i: 1 if 5 <= i < 8 else 2 for i in range(20)}
    assert s.compact(most=6) == 4 and names(s) == want and not s.state()["runs"]
    ranges = s.state()["ranges"]
    assert ranges[0]["low"] == LOW and ranges[-1]["high"] == HIGH and all(a["high"] + 1 == b["low"] for a, b in zip(ranges, ranges[1:], strict=False))
    s.put(*batch(spark, 6, 30, "c"))
    s.put({"patches": batch(spark, 0, 3, "", 5)[0]["patches"]}, batch(spark, 0, 3, "")[1])  # one table alone
    want |= {i: "c" for i in range(6, 30)}
    patches = {i: 5 if i < 3 else 1 if i == 5 else 2 for i in range(30)}
    assert names(s) == want and counts(s) == patches
    assert s.compact([1]) == 1 and len(s.state()["runs"]) == 2  # one range: its rows come from there, others still from the runs
    assert names(s) == want and counts(s) == patches
    s.put(*batch(spark, 10, 12, "d"))
    want |= {10: "d", 11: "d"}
    assert names(s) == want
    s.compact()
    assert names(s) == want and counts(s) == patches and not s.state()["runs"]
    assert s.vacuum() > 0 and names(s) == want and s.compact() == 0
    s.clear()
    assert names(s) == {}
    s.put(*batch(spark, 1, 2, "e"))
    assert names(s) == {1: "e"}


def test_a_page_without_new_rows_has_none(spark, tmp_path):
    s = store(spark, tmp_path)
    s.put(*batch(spark, 0, 4, "a"))
    rows, _ = batch(spark, 0, 1, "b")
    s.put(rows, spark.createDataFrame([(0,), (1,), (None,)], "page long"))
    assert names(s) == {0: "b", 2: "a", 3: "a"} and counts(s) == {0: 2, 2: 2, 3: 2}


def test_a_batch_that_dies_between_tables_is_not_seen(spark, tmp_path):
    s = store(spark, tmp_path)
    s.put(*batch(spark, 0, 4, "a"))
    rows, pages = batch(spark, 0, 4, "b")
    rows["patches"] = rows["patches"].withColumn("idx", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        s.put(rows, pages)
    assert len(list((tmp_path / "runs").iterdir())) == 2 and set(names(s).values()) == {"a"}
    assert s.vacuum() == 1 and set(names(s).values()) == {"a"}


def test_two_writers(spark, tmp_path, monkeypatch):
    s, t = store(spark, tmp_path), store(spark, tmp_path)
    s.put(*batch(spark, 0, 2, "a"))
    old = t.state()
    s.put(*batch(spark, 1, 3, "b"))
    monkeypatch.setattr(t, "state", lambda: old)
    with pytest.raises(Conflict):
        t.put(*batch(spark, 0, 3, "c"))
    assert names(s) == {0: "a", 1: "b", 2: "b"}


def written(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


def test_bytes_of_a_batch_do_not_follow_the_index(spark, tmp_path):
    got = []
    for n in (1000, 100_000):
        s = store(spark, tmp_path / str(n))
        s.put(*batch(spark, 0, n, "a"))
        s.compact()
        before = written(tmp_path / str(n))
        s.put(*batch(spark, 0, 100, "b"))
        got.append(written(tmp_path / str(n)) - before)
        assert s.read("points").where("name = 'b'").count() == 100 and s.read("points").count() == n
    assert got[1] <= 1.2 * got[0]


def test_merging_a_range_reads_its_files_alone(spark, tmp_path):
    s = store(spark, tmp_path)
    s.put(*batch(spark, 0, 64, "a"))
    s.compact(most=16)
    state = s.state()
    r = state["ranges"][1]
    files = s._snapshot("points", state, (r["low"], r["high"])).inputFiles()
    assert files and all(f"base/{r['id']}/" in f for f in files)


def test_grids(spark):
    sizes = spark.createDataFrame([(1, 500, 400), (2, 100, 1000), (3, 0, 10), (4, None, 10), (5, 30, 30), (6, 10, 9000)], "page int, width int, height int")
    counts = spark.createDataFrame([(1, 20), (2, 20), (3, 20), (4, 20), (6, 1)], "page int, n long")
    got = {r.page: (r.nx, r.ny, r.error) for r in R.page_grids(sizes, counts).collect()}
    assert got[1][:2] == (5, 4) and got[2][:2] == (1, 20) and got[1][2] is got[2][2] is got[6][2] is None and got[6][0] == 1
    assert got[3] == (None, None, "size is missing or not positive") == got[4] and "no patches" in got[5][2]
    known = spark.createDataFrame([(1, 500, 400, 2, 3), (2, 500, 400, 4, 5)], "page int, width int, height int, nx int, ny int")
    got = {r.page: (r.nx, r.ny, r.error) for r in R.page_grids(known, counts).collect()}
    assert got[2] == (4, 5, None) and got[1] == (2, 3, "20 patches do not fit a grid of 2 x 3")


def test_regions_meet_their_own_pages_cells(spark):
    scores = spark.createDataFrame([(0, p, x, y, 10.0 * p + x + y / 10) for p, (nx, ny) in {1: (2, 1), 2: (1, 2)}.items() for x in range(nx) for y in range(ny)], "query_id long, page long, px int, py int, score double")
    regions = spark.createDataFrame([(1, "a", 100, 0, 200, 100, 2, 1, 200.0, 100.0), (2, "b", 0, 100, 100, 200, 1, 2, 100.0, 200.0), (2, "c", 0, 0, 9, 9, None, None, None, None)], "page long, region_id string, x1 int, y1 int, x2 int, y2 int, nx int, ny int, width double, height double")
    got = {r.region_id: r.score for r in R.relevance(regions, scores).collect()}
    assert got == {"a": 11.0, "b": 20.1, "c": 0.0}


def engine(spark, path, dim):
    e = Engine(spark, str(path), lambda: models.HashEmbedder(dim))
    image = lambda i: bytes((i * 7 + k) % 251 for k in range(64 * 20))
    rows = [(i, "d", f"f{i % 3}", i, 9, f"u{i}", bytearray(image(i)), *((500.0, 400.0) if i % 2 else (400.0, 500.0))) for i in range(9)]
    read = lambda image, task: "<|ref|>text<|/ref|><|det|>[[0, 0, 999, 999]]<|/det|>\nWords"
    assert e.index(spark.createDataFrame(rows, TABLES["points"] + ", image binary, width double, height double"), lambda: read).count() == 0
    return e


@pytest.mark.parametrize("dim", [64, 128])
def test_filters_hold_in_every_kind_of_search(spark, tmp_path, dim):
    e = engine(spark, tmp_path, dim)
    assert {(r.page % 2, r.nx, r.ny) for r in e.table("grids").collect()} == {(1, 5, 4), (0, 4, 5)}
    assert {(r.page % 2, r.x2, r.y2) for r in e.table("regions").collect()} == {(1, 500, 400), (0, 400, 500)}
    for how in ({}, {"pooling": True}, {"quantised": True}):
        o = Options(k=2, threshold=-1.0, **how)
        plain, kept = e.search({1: "a b", 2: "c"}, o).collect(), e.search({1: "a b", 2: "c"}, o, {"filename": "f2"}, include_ocr=True).collect()
        assert len(plain) == len(kept) == 4
        assert all(r.filename == "f2" and r.page % 3 == 2 and len(r.regions) == 1 for r in kept)
    assert e.similarity_maps({1: "a"}, [0, 1]).groupBy("page").count().collect()[0]["count"] == 20


def test_codes_of_another_width_are_an_error(spark):
    patches = spark.createDataFrame([(1, [1.0] * 128)], "page long, vec array<double>")
    queries = spark.createDataFrame([(1, 0, [1.0] * 64)], "query_id long, token long, vec array<double>")
    with pytest.raises(Exception, match="width"):
        S.quantised(patches, queries, coded=S.codes(patches, 128)).collect()


def test_pairs_equal_the_whole_product(spark, monkeypatch):
    import random

    rnd = random.Random(3)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(8)]
    patches = spark.createDataFrame([(p, x, y, vec()) for p in range(12) for x in range(3) for y in range(2)], "page long, px int, py int, vec array<double>").repartition(3)
    queries = spark.createDataFrame([(q, t, vec()) for q in range(5) for t in range(1 + q)], "query_id long, token long, vec array<double>")
    pairs = spark.createDataFrame([(q, p) for q in range(5) for p in range(12) if (q * p) % 3 == 1], "query_id long, page long")
    near = lambda df: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)
    want = near(S.maxsim(patches, queries).join(pairs, ["query_id", "page"], "left_semi")), near(S.patch_scores(patches, queries).join(pairs, ["query_id", "page"], "left_semi"))
    assert (near(S.maxsim_of(patches, queries, pairs)), near(S.patch_scores_of(patches, queries, pairs))) == want
    monkeypatch.setattr(S, "MAX_QUERY_TOKENS", 4)
    assert (near(S.maxsim_of(patches, queries, pairs)), near(S.patch_scores_of(patches, queries, pairs))) == want
