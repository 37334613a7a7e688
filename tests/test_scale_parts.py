"""Inverted files, objects in two phases, byte-pair encoding and quantiles of groups."""

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagegrain.functions import bpe
from pagegrain.operators import analysis as A
from pagegrain.operators import ivf
from pagegrain.operators import search as S
from pagegrain.sources import objects as O


@pytest.fixture(scope="module")
def clustered(spark):
    """Pages whose vectors lie around a few directions each, and queries near some page's."""
    rng = np.random.default_rng(5)
    heads = rng.standard_normal((40, 16))
    rows = [(p, int(i), (heads[(p * 3 + i // 4) % 40] + 0.25 * rng.standard_normal(16)).tolist()) for p in range(200) for i in range(8)]
    asked = [(q, t, (heads[(q * 7 + t) % 40] + 0.25 * rng.standard_normal(16)).tolist()) for q in range(20) for t in range(2)]
    odd = [(900, 0, None), (901, 0, [0.0] * 16), (902, 0, [1.0] * 3)]
    return spark.createDataFrame(rows + odd, "page long, idx int, vec array<double>").repartition(4), spark.createDataFrame(asked, "query_id long, token long, vec array<double>")


def test_inverted_file(spark, clustered, tmp_path):
    patches, queries = clustered
    good = patches.where("page < 900")
    centres = ivf.train(patches, 32)
    assert centres.shape == (32, 16) and np.allclose(np.linalg.norm(centres, axis=1), 1)
    ivf.write(patches.select("page", "vec"), centres, str(tmp_path / "cells"), split=2)
    stored = ivf.open_cells(spark, str(tmp_path / "cells"))
    assert stored.count() == 1600
    exact = S.search(good, queries, 10)
    few = ivf.search(stored, patches, queries, centres, 6, 10)
    assert ivf.recall(few, exact) >= 0.9
    asked = ivf.probes(queries.where("query_id = 3"), centres, 6).select("cell").distinct()
    assert stored.join(asked, "cell", "left_semi").count() < 0.5 * stored.count()  # what one query reads
    assert "PartitionFilters: [cell" in stored.where("cell in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    every = ivf.search(stored, patches, queries, centres, 32, 10)
    assert sorted(every.select("query_id", "page", "rank").collect()) == sorted(exact.select("query_id", "page", "rank").collect())
    with pytest.raises(ValueError):
        ivf.train(patches, 0)
    assert len(ivf.train(patches.limit(0), 4)) == 0


def files(path):
    return sorted(str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.startswith("."))


def rows(spark, pairs):
    return spark.createDataFrame([(p, bytearray(c) if c is not None else None) for p, c in pairs], "path string, content binary").repartition(3)


def test_objects_all_or_none(spark, tmp_path):
    root = str(tmp_path / "o")
    assert O.write(rows(spark, [("a/1.png", b"one"), ("a/2.png", b"two"), ("b.json", None), ("a/1.png", b"one"), (None, b"x")]), root) == 3
    assert files(tmp_path / "o") == ["a/1.png", "a/2.png", "b.json"] and (tmp_path / "o/b.json").read_bytes() == b""
    with pytest.raises(Exception, match="leaves its root"):
        O.write(rows(spark, [("c/1", b"n"), ("../x", b"n"), ("c/2", b"n")]), root)
    bad = rows(spark, [("d/1", b"1"), ("d/2", b"2")]).withColumn("content", F.when(F.col("path") == "d/2", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        O.write(bad, root)
    assert files(tmp_path / "o") == ["a/1.png", "a/2.png", "b.json"]
    assert O.write(rows(spark, [("a/1.png", b"new")]), root) == 1 and (tmp_path / "o/a/1.png").read_bytes() == b"new"


def test_objects_of_a_lost_driver(spark, tmp_path, monkeypatch):
    root, finish = str(tmp_path / "o"), O._finish

    def lost(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(O, "_finish", lost)
    with pytest.raises(KeyboardInterrupt):
        O.write(rows(spark, [("a", b"1"), ("b", b"2")]), root, "job")
    monkeypatch.setattr(O, "_finish", finish)
    (tmp_path / "o/_staging/dead/objects").mkdir(parents=True)
    assert not (tmp_path / "o/a").exists()
    assert O.recover(spark, root) == {"finished": 1, "deleted": 1} and files(tmp_path / "o") == ["a", "b"]
    assert O.recover(spark, root) == {"finished": 0, "deleted": 0}


def test_steps_are_tried_again():
    waits, left = [], [OSError(), OSError()]

    def step():
        if left:
            raise left.pop()

    O.tried(step, pause=waits.append)
    assert len(waits) == 2 and waits[0] < waits[1]
    with pytest.raises(OSError):
        O.tried(lambda: (_ for _ in ()).throw(OSError()), pause=waits.append)
    assert O.filesystem("/a/b")[1] == "/a/b" and O.filesystem("file:///a/b")[1] == "/a/b" and O.filesystem("dbfs:/x/y")[1] == "/dbfs/x/y"


def test_objects_of_a_stream(spark, tmp_path):
    for k in range(3):
        rows(spark, [(f"{k}/x", b"%d" % k), ("same", b"%d" % k)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("path string, content binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert O.stream(source, str(tmp_path / "o"), str(tmp_path / "ck")).awaitTermination(90)
    assert files(tmp_path / "o") == ["0/x", "1/x", "2/x", "same"]


def naive(piece, table):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(table[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in table]
        if not pairs:
            return [table[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_merges(spark, tmp_path):
    rnd = random.Random(6)
    table = {bytes([b]): b for b in range(256)}
    for k in range(300):
        table.setdefault(b"".join(rnd.choice(list(table)[97:101] + list(table)[256:]) for _ in range(2)), 256 + k)
    for n in list(range(12)) * 30 + [400]:
        piece = bytes(rnd.choice(b"abcd") for _ in range(n))
        assert bpe.merge(piece, table) == naive(piece, table)
    assert len(bpe.merge(b"ab" * 50_000, table)) > 0
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in table.items()))
    df = spark.createDataFrame([(1, "abcd abba 12 don't\n"), (2, None), (3, ""), (4, "é😀")], "n_tokens int, text string")
    got = {r.text: (r.n_tokens, r.token_ids) for r in bpe.tokens(df, "text", str(path), ids=True).collect()}
    inverse = {r: t for t, r in table.items()}
    assert all(b"".join(inverse[i] for i in ids) == (t or "").encode() and n == len(ids) for t, (n, ids) in got.items())
    (tmp_path / "bad").write_text("YQ== 1\n")
    with pytest.raises(ValueError):
        bpe.ranks(spark, str(tmp_path / "bad"))


def test_ids_equal_a_public_vocabulary(spark):
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    table = bpe.ranks(spark, public.path("byte_bpe_50k.tiktoken"))
    theirs = tiktoken.Encoding("x", pat_str=bpe.PIECE, mergeable_ranks=table, special_tokens={})
    encode = bpe.encoder(table)
    for text in ["Hello world, don't stop!  \n\n x", "Übergrößen naïve 漢字 😀 123456", "a" * 3000, " " * 50, "İstanbul's we'll"]:
        assert encode(text) == theirs.encode_ordinary(text)


@pytest.mark.parametrize("shares", [(0.5,), (0.02, 0.25, 0.98), (0.0, 1.0)])
def test_quantiles_of_groups(spark, shares):
    rng = np.random.default_rng(1)
    groups = {"large": rng.standard_normal(60_000), "ties": rng.integers(0, 3, 30_000).astype(float), "one": [4.0], "two": [1.0, 2.0], None: [5.0, 7.0, 9.0], "same": [2.0] * 500}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("large", None), ("empty", None)]
    got = {r.g: [r[f"q{i}"] for i in range(len(shares))] for r in A.group_quantiles(spark.createDataFrame(rows, "g string, v double").repartition(4), ("g",), "v", shares).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert np.allclose(got[g], np.quantile(vs, shares), rtol=0, atol=1e-12), g


def test_brackets_that_miss_are_widened(spark, monkeypatch):
    monkeypatch.setattr(A, "ACCURACY", 2)
    monkeypatch.setattr(A, "REACH", 0.0)
    values = np.random.default_rng(2).standard_normal(20_001)
    got = A.group_quantiles(spark.createDataFrame([(1, float(v)) for v in values], "g int, v double"), ("g",), "v", (0.3, 0.9)).first()
    assert np.allclose([got.q0, got.q1], np.quantile(values, (0.3, 0.9)), atol=1e-12)


def test_line_numbers_over_splits(spark, tmp_path):
    from pagegrain.sources import files

    lines = [f"{k} {'x' * (k % 37)}" for k in range(4000)]
    (tmp_path / "a.txt").write_text("\n".join(lines[:3000]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(lines[3000:]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = files.numbered_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 4 and [(r.line, r.value) for r in got.orderBy("line").collect()] == list(enumerate(lines))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_reports_of_any_length(spark, tmp_path, monkeypatch):
    from pagegrain.sources import files

    rows = spark.createDataFrame([(k, k / 7) for k in range(50)], "k int, v double").repartition(4)
    got = []
    for most in (100, 10):
        monkeypatch.setattr(files, "MAX_REPORT", most)
        files.write_report(rows, str(tmp_path / str(most)), ["k", "v"], "k")
        parts = sorted((tmp_path / str(most)).glob("part-*"))
        got.append("".join(p.read_text() for p in parts))
        assert len(parts) == 1 or most == 10
    assert got[0] == got[1] and got[0].startswith("| k | v |\n|---|---|\n| 0 | 0.000 |\n| 1 | 0.143 |")


def test_ocr_engines_that_take_batches(spark):
    from pagegrain.sources import models

    def factory():
        class Engine:
            def batch(self, items, task):
                return [f"{x}{len(items)}" if x != "none" else "" for x in items]

        return Engine()

    rows = spark.createDataFrame([(k, "none" if k == 6 else "t") for k in range(9)], "k long, image string").coalesce(1)
    got = {r.k: (r.raw, r.error) for r in models.ocr(rows, "image", factory, "k", at_once=4).collect()}
    assert got[0] == ("t4", None) and got[5] == ("t1", None) and got[6][0] is None and "no text" in got[6][1] and got[8] == ("t1", None)
