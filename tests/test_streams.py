"""The page stream, page counts of PDFs, and the state machine of jobs."""

import datetime
import json
import time
import zlib

import pytest

from pagegrain.sources import pdf
from pagegrain.sources.pages import PageSource
from pagegrain.streaming import jobs


def plain_pdf(pages):
    """A PDF with a cross-reference table."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{3 + k} 0 R' for k in range(pages))}] /Count {pages} >>".encode()]
    objects += [b"<< /Type /Page /Parent 2 0 R >>"] * pages
    out, places = b"%PDF-1.4\n", []
    for k, o in enumerate(objects):
        places.append(len(out))
        out += f"{k + 1} 0 obj\n".encode() + o + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    return out + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF".encode()


def packed_pdf(pages, predictor=12):
    """A PDF whose objects are in a compressed object stream, found by a cross-reference stream."""
    inner = [b"<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Count {pages}/Kids[]>>".encode()]
    heads, body = b"", b""
    for k, o in enumerate(inner):
        heads += f"{k + 1} {len(body)} ".encode()
        body += o + b" "
    raw = zlib.compress(heads + body)
    out = b"%PDF-1.5\n"
    holder = len(out)
    out += f"3 0 obj\n<</Type/ObjStm/N 2/First {len(heads)}/Length {len(raw)}/Filter/FlateDecode>>stream\n".encode() + raw + b"\nendstream\nendobj\n"
    start = len(out)
    rows = [(0, 0, 255), (2, 3, 0), (2, 3, 1), (1, holder, 0), (1, start, 0)]
    table = [bytes([k]) + a.to_bytes(3, "big") + bytes([b]) for k, a, b in rows]
    before, lines = bytes(5), b""
    for line in table:
        if predictor == 12:
            lines += b"\x02" + bytes((x - y) & 255 for x, y in zip(line, before, strict=True))
        elif predictor == 11:
            lines += b"\x01" + bytes((x - (line[i - 1] if i else 0)) & 255 for i, x in enumerate(line))
        else:
            lines += line
        before = line
    raw = zlib.compress(lines)
    how = f"/DecodeParms<</Predictor {predictor}/Columns 5>>" if predictor > 1 else ""
    return out + f"4 0 obj\n<</Type/XRef/Size 5/W[1 3 1]/Root 1 0 R/Filter/FlateDecode{how}/Length {len(raw)}>>stream\n".encode() + raw + f"\nendstream\nendobj\nstartxref\n{start}\n%%EOF".encode()


def test_page_counts():
    assert pdf.count_pages(plain_pdf(7)) == 7
    assert [pdf.count_pages(packed_pdf(n, p)) for n, p in ((3, 12), (900, 11), (5, 1))] == [3, 900, 5]
    broken = [b"", b"%PDF-", b"no pdf", packed_pdf(3)[:-30], packed_pdf(3)[60:], b"%PDF-1.4\nstartxref\n99\n", b"%PDF-1.5 startxref 9 << /Prev 9 >>"]
    assert [pdf.count_pages(b) for b in broken] == [0] * 7
    assert pdf.count_pages(plain_pdf(4).replace(b"startxref", b"startxxxx")) == 4  # page objects that stand in the bytes
    assert pdf.count_pages(b"%PDF-1.4\n1 0 obj\n<< /Length 1 0 R >>\nstream\nx\nendstream\nstartxref\n9\n") == 0


@pytest.fixture
def source(spark, tmp_path, monkeypatch):
    spark.dataSource.register(PageSource)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(plain_pdf(50))
    return tmp_path


def run(spark, path, seconds=60, until=None, **options):
    """Rows of the micro-batches of a run of the stream."""
    got = []
    stream = spark.readStream.format("pages").option("path", str(path / "in")).option("stateLocation", str(path / "ledger"))
    for k, v in options.items():
        stream = stream.option(k, v)
    q = stream.load().select("path", "page_number", "total_pages").writeStream.foreachBatch(lambda df, n: got.append(df.collect())).option("checkpointLocation", str(path / "ck")).start()
    end = time.monotonic() + seconds
    while time.monotonic() < end and q.isActive and not until(got):
        time.sleep(0.2)
    q.stop()
    return [[(r.path.rsplit("/")[-1], r.page_number, r.total_pages) for r in b] for b in got]


def test_page_stream(spark, source):
    total = lambda got: sum(map(len, got))
    first = run(spark, source, until=lambda got: total(got) >= 16, maxPages=8, pagesPerPartition=3)
    assert all(len(b) <= 8 for b in first) and len(first) < 7  # pages came long before the file's last one
    (source / "in" / "0.pdf").write_bytes(packed_pdf(5))  # found later, by an earlier name
    (source / "in" / "x.txt").write_bytes(b"no")
    rest = run(spark, source, until=lambda got: total(first) + total(got) >= 55, maxPages=8, pagesPerPartition=3)
    rows = [r for b in first + rest for r in b]
    assert sorted(rows) == sorted([("a.pdf", p, 50) for p in range(1, 51)] + [("0.pdf", p, 5) for p in range(1, 6)])
    assert all(len(b) <= 8 for b in rest)


def test_page_ranges_of_a_batch(spark, source):
    df = spark.read.format("pages").option("path", str(source / "in")).option("pagesPerPartition", 20).load()
    assert df.rdd.getNumPartitions() == 3 and [r.page_number for r in df.orderBy("page_number").collect()] == list(range(1, 51))
    whole = spark.read.format("pages").option("path", str(source / "in")).load()
    assert whole.rdd.getNumPartitions() == 1 and sorted(whole.collect()) == sorted(df.collect())


def test_order_of_states():
    assert [jobs.after(None, e) for e in ("create", "start", "update", "cancel", "stopped", "x")] == ["pending", "running", "pending", "cancelling", None, None]
    assert [jobs.after("running", e) for e in jobs.EVENTS] == [None, None, "running", "completed", "failed", "cancelling", None]
    assert [jobs.after("cancelling", e) for e in jobs.EVENTS] == [None, None, "cancelling", "completed", "failed", None, "cancelled"]
    for ended in ("completed", "failed", "cancelled"):
        assert not any(jobs.after(ended, e) for e in jobs.EVENTS)
    assert "50" in jobs.frame("progress", "j", "running", 5, 10, None) and jobs.frame("heartbeat", "j", "running", 1, 2, None).endswith("{}\n\n")


SCHEMA = "job_id string, ts timestamp, event string, current long, total long, message string"


def tracked(spark, path, batches, done, **how):
    """Emitted rows, in order of batches, of a stream of batches of (job, event, current, total)."""
    at, got = datetime.datetime(2024, 1, 1), []
    (path / "in").mkdir()
    q = jobs.track(spark.readStream.schema(SCHEMA).parquet(str(path / "in")), **how).writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(path / "ck"))
    q = q.start()
    for k, rows in enumerate(batches):
        seen = sum(p["numInputRows"] for p in q.recentProgress)
        table = [(j, at + datetime.timedelta(seconds=100 * k + i), e, c, t, None) for i, (j, e, c, t) in enumerate(rows)]
        spark.createDataFrame(table, SCHEMA).coalesce(1).write.mode("append").parquet(str(path / "in"))
        end = time.monotonic() + 60
        while sum(p["numInputRows"] for p in q.recentProgress) < seen + len(rows) and time.monotonic() < end and q.isActive:
            time.sleep(0.2)
    end = time.monotonic() + 60
    while not done(got) and time.monotonic() < end and q.isActive:
        time.sleep(0.2)
    q.stop()
    return got


def test_jobs_on_a_stream(spark, tmp_path):
    first = [("a", "create", 0, 4), ("a", "start", None, None), ("a", "update", 1, None), ("a", "update", 1, None), ("b", "start", None, 9), ("b", "cancel", None, None), ("c", "start", None, 2)]
    second = [("a", "update", 4, None), ("a", "complete", None, None), ("a", "fail", None, None), ("b", "update", 3, None), ("d", "cancel", None, None), ("d", "stopped", None, None)]
    kinds = lambda got, job: [(r.kind, r.status, r.current) for r in got if r.job_id == job and r.kind != "heartbeat"]
    done = lambda got: {r.job_id for r in got if r.kind == "expired"} >= {"a", "b", "d"} and any(r.kind == "stalled" for r in got)
    got = tracked(spark, tmp_path, [first, second], done, stall=1500, grace=1000, ttl=1500, heartbeat=500)
    assert [x for x in kinds(got, "a") if x[0] != "stalled"] == [("progress", "pending", 0), ("progress", "running", 0), ("progress", "running", 1), ("progress", "running", 4), ("progress", "completed", 4), ("refused", "completed", 4), ("expired", "completed", 4)]
    b = kinds(got, "b")
    assert b[:2] == [("progress", "running", 0), ("progress", "cancelling", 0)] and not any(x[0] == "stalled" and x[1] != "cancelling" for x in b) and ("progress", "cancelled") in [x[:2] for x in b] and b[-1][:2] in (("expired", "cancelled"), ("refused", "cancelled"))
    assert kinds(got, "d")[:2] == [("progress", "cancelling", 0), ("progress", "cancelled", 0)]
    assert [k for k, _, _ in kinds(got, "c")] == ["progress", "stalled"]
    assert any(r.kind == "heartbeat" and r.job_id == "c" for r in got)
    assert not any(r.kind == "heartbeat" and r.status in ("completed", "failed", "cancelled") for r in got)
    last = next(r for r in got if r.job_id == "a" and r.status == "completed" and r.kind == "progress")
    assert json.loads(last.frame.split("data: ")[1])["percent"] == 100


def test_every_row_without_the_change_filter(spark, tmp_path):
    rows = [("a", "start", None, 4), ("a", "update", 1, None), ("a", "update", 1, None)]
    got = tracked(spark, tmp_path, [rows], lambda got: len(got) >= 3, on_change=False, heartbeat=60_000)
    assert [(r.kind, r.current) for r in got] == [("progress", 0), ("progress", 1), ("progress", 1)]
