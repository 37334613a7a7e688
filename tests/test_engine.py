"""The engine end to end with stand-in models, joins, settings, keyed state."""

import time

import pytest
from pyspark.sql import functions as F

from pagegrain.operators import joins as J
from pagegrain.plans import config
from pagegrain.plans.engine import TABLES, Engine
from pagegrain.plans.retrieval import Options
from pagegrain.sources import files, models
from pagegrain.streaming import ingest as I
from pagegrain.streaming import state


POINT = TABLES["points"]


def test_engine(spark, tmp_path):
    def read_text(image, task):
        if image is None:
            raise ValueError("no image")
        return f"<|ref|>title<|/ref|><|det|>[[0, 0, 500, 200]]<|/det|>\nTitle {len(image)}\n<|ref|>image<|/ref|><|det|>[[0, 0, 99, 99]]<|/det|>"

    e = Engine(spark, str(tmp_path / "t"))
    e.initialise()
    assert e.status().first().vectors_count == 0
    image = lambda i: bytes((i * 7 + k) % 251 for k in range(64 * 20))
    rows = [(i, "d", "f.pdf", i, 3, f"http://h/{i}.png" if i else "", bytearray(image(i)) if i < 3 else None) for i in range(4)]
    failed = e.index(spark.createDataFrame(rows, POINT + ", image binary"), lambda: read_text).collect()
    assert sorted((r.page_id, r.stage) for r in failed) == [(3, "embedding"), (3, "ocr")]
    tables = {n: e.table(n).count() for n in TABLES}
    assert tables == {"points": 4, "patches": 60, "rows": 12, "columns": 15, "codes": 60, "regions": 6, "grids": 4}
    e.index(spark.createDataFrame(rows[:2], POINT + ", image binary"), lambda: read_text)
    assert {n: e.table(n).count() for n in TABLES} == tables  # the same pages again
    short = [(2, "d", "f.pdf", 2, 3, "http://h/2.png", bytearray(image(2)[: 64 * 5]))]
    e.index(spark.createDataFrame(short, POINT + ", image binary"), lambda: read_text)
    assert e.table("patches").count() == 45 and e.table("points").count() == 4
    e.index(spark.createDataFrame(rows[2:3], POINT + ", image binary"), lambda: read_text)
    assert {n: e.table(n).count() for n in TABLES} == tables
    again = spark.createDataFrame([(1, bytearray(b"x" * 99)), (2, None)], "page_id int, image binary")
    assert [r.page_id for r in e.read_text(again, lambda: read_text).collect()] == [2]
    assert sorted((r.page, r.content) for r in e.table("regions").where("label = 'title'").collect()) == [(0, "Title 1280"), (1, "Title 99")] and e.table("patches").count() == 60
    e.read_text(spark.createDataFrame(rows[1:3], POINT + ", image binary"), lambda: read_text)
    assert {n: e.table(n).count() for n in TABLES} == tables
    got = e.search({1: "two words", 2: "other"}, Options(k=3, threshold=-1.0), include_ocr=True).collect()
    assert {r.page for r in got} == {1, 2} and all(r.label == f"f.pdf - Page {r.page} of 3" and len(r.regions) == 2 for r in got)
    assert {r.page for r in e.search({1: "two words"}, Options(k=3, pooling=True)).collect()} == {1, 2}
    assert e.search({1: "x"}, conditions={"page_number": 2}).first().page == 2
    assert e.similarity_maps({1: "a b"}, 1).count() == 40 and e.relevance({1: "a"}).count() == 6
    assert "Title 1280" in e.context({5: "what"}).first().context
    e.register({1: "x"})
    assert spark.sql("SELECT count(*) FROM search_results").first()[0] == 2
    assert e.clear()["failed"] == 0


def test_streaming_index_with_progress_and_cancellation(spark, tmp_path):
    rows = [(i, "d", "f.pdf", i, 6, f"http://h/{i}.png", bytearray(bytes(64 * 4)) if i != 4 else None) for i in range(6)]
    schema = POINT + ", image binary"
    for i in range(3):
        spark.createDataFrame(rows[2 * i : 2 * i + 2], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    e = Engine(spark, str(tmp_path / "t"))
    e.initialise()
    seen = []
    done = I.indexing(I.landing(spark, str(tmp_path / "in"), schema, 1), e, str(tmp_path / "ck"), progress=seen.append)
    assert done == {"status": "completed", "pages": 6, "failed": 1, "batches": 3, "error": None} and [s["pages"] for s in seen] == [2, 4, 6, 6]
    assert e.table("points").count() == 6 and e.table("patches").count() == 20
    again = I.indexing(I.landing(spark, str(tmp_path / "in"), schema, 1), e, str(tmp_path / "ck2"), cancelled=lambda: True)
    assert again["status"] == "cancelled" and again["pages"] == 0
    f, calls = Engine(spark, str(tmp_path / "u")), []
    part = I.indexing(I.landing(spark, str(tmp_path / "in"), schema, 1), f, str(tmp_path / "ck3"), cancelled=lambda: calls.append(1) or len(calls) > 1)
    assert part["status"] == "cancelled" and part["pages"] == 2 and f.table("points").count() == 2
    rest = I.indexing(I.landing(spark, str(tmp_path / "in"), schema, 1), f, str(tmp_path / "ck3"), compact_every=2)
    assert rest["status"] == "completed" and rest["pages"] == 4 and f.table("points").count() == 6  # no page is lost


def test_progress_listener_and_incremental_report(spark, tmp_path):
    rows = spark.createDataFrame([(i, i / 10) for i in range(4)], "sample_id int, mean_iou double")
    for i in range(2):
        rows.where(f"sample_id % 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen, ends = [], []
    listener = I.Progress(seen.append, ends.append)
    spark.streams.addListener(listener)
    q = files.report_after(I.landing(spark, str(tmp_path / "in"), "sample_id int, mean_iou double", 1), str(tmp_path / "out"), ["sample_id", "mean_iou"], "sample_id", str(tmp_path / "ck"))
    assert q.awaitTermination(60)
    lines = [r.value for r in spark.read.text(str(tmp_path / "out" / "report")).collect()]
    assert lines == ["| sample_id | mean_iou |", "|---|---|", "| 0 | 0.000 |", "| 1 | 0.100 |", "| 2 | 0.200 |", "| 3 | 0.300 |"] and spark.read.json(str(tmp_path / "out" / "summary")).count() == 4
    for _ in range(50):
        if ends:
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert sum(s["rows"] for s in seen) == 4 and ends == [None]


def test_objects(spark, tmp_path):
    rows = spark.createDataFrame([("d/1/image/a.png", bytearray(b"one")), ("d/1/b.json", bytearray(b"two")), ("../out", bytearray(b"x"))], "path string, content binary")
    status = {r.path: r.status for r in files.put(rows, str(tmp_path)).collect()}
    assert status["d/1/b.json"] == "written" and status["../out"].startswith("error") and sorted(p.name for p in (tmp_path / "d" / "1").iterdir()) == ["b.json", "image"]
    assert files.put(rows.limit(1).withColumn("content", F.lit("new").cast("binary")), str(tmp_path)).first().status == "written" and (tmp_path / "d/1/image/a.png").read_bytes() == b"new"
    urls = spark.createDataFrame([("http://h/files/bk/d/1/b.json",), ("http://h/files/bk/gone.png",), ("http://h/other",)], "url string")
    assert sorted(r.status.split(":")[0] for r in files.delete_urls(urls, "bk", str(tmp_path)).collect()) == ["deleted", "deleted", "error"] and not (tmp_path / "d/1/b.json").exists()


def test_models_get_batches_and_single_rows_after_a_failure(spark):
    def factory():
        def model(items):
            if any(x == "bad" for x in items):
                raise ValueError("bad item")
            return [[[float(len(items))]] for _ in items]

        return model

    rows = spark.createDataFrame([(i, "bad" if i == 5 else "x") for i in range(10)], "k long, t string").coalesce(1)
    got = {r.k: (r.vec, r.error) for r in models.embed(rows, "t", factory, "k", at_once=4).collect()}
    assert got[0] == ([4.0], None) and got[4] == ([1.0], None) and got[5] == (None, "bad item") and got[9] == ([2.0], None)
    sized = lambda: lambda x, task, base, tile, cut: f"{task} {base} {tile} {cut}" if x != "bad" else ""
    texts = {r.k: (r.raw, r.error) for r in models.ocr(rows, "t", sized, "k", "locate", "Gundam").collect()}
    assert texts[0] == ("locate 1024 640 True", None) and "no text" in texts[5][1]
    with pytest.raises(ValueError):
        models.ocr(rows, "t", sized, "k", mode="Huge")


def test_joins(spark):
    rows = spark.createDataFrame([(1, [1, 2, 3], ["a", "b"]), (2, [], [])], "k int, x array<int>, y array<string>")
    assert [(r.k, r.ord, r.i, r.s) for r in J.zipped(rows, {"x": "i", "y": "s"}).collect()] == [(1, 0, 1, "a"), (1, 1, 2, "b")]
    with pytest.raises(Exception, match="unequal"):
        J.zipped(rows, {"x": "i", "y": "s"}, check=True).collect()
    left, right = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(1, "u", 5)], "id int, url string, n int")
    with pytest.raises(Exception, match="no url for id 2"):
        J.required(left, right, "id", "url").collect()
    assert {(r.id, r.n) for r in J.or_zero(left, right, "id", "n").collect()} == {(1, 5), (2, 0)}
    regions = spark.createDataFrame([(1, 0), (1, 1), (1, None)], "page int, image_index int")
    assert [r.image_url for r in J.crop_urls(regions, spark.createDataFrame([(1, ["u0"])], "page int, urls array<string>"), "page").collect()] == ["u0", None, None]
    one = spark.range(1).select(J.missing_figures(F.create_map(F.lit(1), F.lit("a"), F.lit(2), F.lit("b")), F.lit("![Figure 2](x)")).alias("m"), J.unique_indices(F.array(*map(F.lit, [3, 1, 3]))).alias("u")).first()
    assert one.m == [1] and one.u == [1, 3]
    assert [r.page_number for r in J.numbered_pages(spark.createDataFrame([("d", 9), ("d", 4)], "doc string, o int"), "doc", "o").orderBy("o").collect()] == [1, 2]


def test_worker_steps():
    assert [config.workers(c) for c in (2, 4, 8, 16, 64)] == [4, 4, 6, 10, 14] and config.workers(64, 20) == 32 and config.workers(4, 3) == 8
    assert [config.retries(w) for w in (4, 8, 16, 24)] == [2, 3, 4, 5] and [config.backoff(n) for n in (1, 2, 4)] == [0.25, 0.5, 2.0] and abs(config.backoff(1, 0.5) - 0.3) < 1e-12


def test_settings():
    got = config.resolve({"top_k": "99", "mean_pooling": "yes", "region_threshold": "x", "other": 1})
    assert (got["top_k"], got["mean_pooling"], got["region_threshold"], got["prefetch_limit"]) == (50, True, 0.3, 200) and "other" not in got
    assert config.changed({"top_k": 10}, {"top_k": 11, "zzz": 1}) == {"top_k": 11}
    limits = config.uploads([".PDF", "exe"], max_mb=999, max_files=0)
    assert limits.extensions == (".pdf",) and limits.max_bytes == 200 << 20 and limits.max_files == 1
    assert config.bucket("a/../b", "/r/x") == "/r/x/b"
    with pytest.raises(ValueError):
        config.bucket("../../y", "/r/x")


def test_keyed_state(spark, tmp_path):
    src, schema = str(tmp_path / "s"), "batch_key string, stage string, num_pages long"
    out = str(tmp_path / "o")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = state.complete(I.landing(spark, src, schema), 3).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "c")).start()
        until = time.monotonic() + 90
        while sum(p["numInputRows"] for p in q.recentProgress) < len(rows) and time.monotonic() < until:
            time.sleep(0.3)  # a timer-driven query never runs out of batches
        q.stop()
        return {(r.batch_key, r.n_stages, r.n_pages) for r in spark.read.schema(state.OUT).parquet(out).collect()}

    assert run([("a", "embed", 4), ("a", "embed", 4), ("b", "embed", 2)]) == set()
    assert run([("a", "store", 4), ("a", "upsert", 4)]) == {("a", 3, 4)}
