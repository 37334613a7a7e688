"""What a task, a batch and the driver hold, however large the tables are."""

import base64

import pytest

from pagegrain.functions import bpe
from pagegrain.functions.arrow import BATCH_BYTES
from pagegrain.plans import registry
from pagegrain.sources import models, objects

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(1 << 30))
    yield
    spark.conf.set(BATCH, before)


def test_token_counts_hold_no_ids_and_bounded_batches(spark, tmp_path, unbounded, monkeypatch):
    table = [bytes([b]) for b in range(256)] + [b"in", b"on", b"ing"]
    (tmp_path / "ranks").write_text("".join(f"{base64.b64encode(t).decode()} {k}\n" for k, t in enumerate(table)))
    rows = spark.createDataFrame([(0, "singing onion " * 40), (1, None), (2, "ing" * 200), (3, "")], "doc_id long, text string")
    counted = bpe.tokens(rows, "text", str(tmp_path / "ranks"))
    assert int(spark.conf.get(BATCH)) <= BATCH_BYTES
    want = {r.doc_id: len(r.token_ids) for r in bpe.tokens(rows, "text", str(tmp_path / "ranks"), ids=True).collect()}
    assert {r.doc_id: r.n_tokens for r in counted.collect()} == want and want[2] == 200
    known = {t: k for k, t in enumerate(table)}
    whole = [bpe.encoder(known)(t) for t in ("singing onion", "ing" * 200)]
    monkeypatch.setattr(bpe, "AT_ONCE", 3)
    assert [bpe.encoder(known)(t) for t in ("singing onion", "ing" * 200)] == whole
    assert [bpe.counter(known)(t) for t in ("singing onion", "ing" * 200)] == [len(x) for x in whole]


def test_models_get_bounded_batches(spark, unbounded):
    rows = spark.createDataFrame([(0, "[[1.0, 2.0]]")], "page_id long, image string")
    assert models.embed(rows, "image", models.Written, "page_id").count() == 1
    assert int(spark.conf.get(BATCH)) <= BATCH_BYTES


def test_objects_are_read_by_name(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"a/{k}/x.txt", b"z" * k) for k in range(40)], "path string, content binary")
    assert objects.write(rows, str(tmp_path)) == 40
    names = rows.select("path").union(spark.createDataFrame([("a/none.txt",), ("a",), (None,)], "path string"))
    got = objects.read(names, str(tmp_path)).collect()
    assert {(r.path, r.length, bytes(r.content)) for r in got} == {(f"a/{k}/x.txt", k, b"z" * k) for k in range(40)} and len(got) == 40
    assert {(r.length, r.content) for r in objects.read(names, str(tmp_path), content=False).collect()} == {(k, None) for k in range(40)}
    with pytest.raises(Exception, match="leaves its root"):
        objects.read(spark.createDataFrame([("../x",)], "path string"), str(tmp_path)).count()


@pytest.mark.parametrize("name", ["written_objects", "deleted_objects"])
def test_the_driver_lists_no_objects(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and "path" in plan
