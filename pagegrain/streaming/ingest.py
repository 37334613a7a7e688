"""Streaming ingestion: pages to points, and keyed progress state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import StreamingQueryException
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.catalog import TERMINAL, last


def landing(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 4, fmt: str = "parquet") -> DataFrame:
    """A stream of landed rows; files per trigger bound what is in flight."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(path)


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str, order: str, once: bool = True) -> StreamingQuery:
    """Runs a transformation on each micro-batch and writes it below ``target``/batch=n.

    Of a key's rows in a batch the last by ``order`` counts. A batch that runs again overwrites its own folder, so the sink is idempotent;
    ``latest`` reads the last row of each key.
    """

    def write(batch: DataFrame, number: int) -> None:
        last(transform(batch), key, order).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch={number}")

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def latest(spark: SparkSession, target: str, key: str = "page_id") -> DataFrame:
    """The last written row of each key."""
    rows = spark.read.option("basePath", target).parquet(target)
    cols = [c for c in rows.columns if c not in (key, "batch")]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("r"))
    return best.select(key, "r.*")


def completions(events: DataFrame, keys: tuple[str, ...], stages: int, watermark: str | None = None, ts: str = "ts") -> DataFrame:
    """Batch keys whose stages have all ended, each stage counted once. A key holds its set of stages, a handful."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    counts = rows.groupBy(*keys).agg(F.size(F.collect_set("stage")).alias("n_stages"))
    return counts.where(F.col("n_stages") >= stages)


class Cancelled(RuntimeError):
    """Raised inside a micro-batch that mustn't run, so that its offsets aren't committed and a resumed job gets it again."""


def indexing(stream: DataFrame, engine, checkpoint: str, ocr=None, cancelled: Callable[[], bool] = lambda: False, progress: Callable[[dict], None] = lambda state: None, compact_every: int = 0) -> dict:
    """Indexes a stream of pages, a micro-batch at a time, and reports after each; returns the last report.

    ``cancelled`` is asked before every batch: from then on no batch starts, and the job ends as cancelled. Its checkpoint holds what was indexed and no more, so
    the job goes on where it was when it is started again. A batch that runs again upserts the same pages. A failing batch ends the job as failed.
    The index is merged after every ``compact_every`` batches, if that isn't 0.
    """
    state = {"status": "running", "pages": 0, "failed": 0, "batches": 0, "error": None}

    def write(batch: DataFrame, number: int) -> None:
        if cancelled():
            state["status"] = "cancelled"
            raise Cancelled(f"cancelled before batch {number}")
        bad = engine.index(batch, ocr).count()
        state.update(pages=state["pages"] + batch.count(), failed=state["failed"] + bad, batches=state["batches"] + 1)
        if compact_every and state["batches"] % compact_every == 0:
            engine.compact()
        progress(dict(state))

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
        state["status"] = "completed"
    except StreamingQueryException as e:
        if state["status"] != "cancelled":
            state.update(status="failed", error=str(e)[:500])
    progress(dict(state))
    return state


class Progress(StreamingQueryListener):
    """Calls back with (name, batch, rows, rows a second, milliseconds by step) after each micro-batch, and at the end."""

    def __init__(self, on_progress: Callable[[dict], None], on_end: Callable[[str | None], None] = lambda error: None):
        self.on_progress, self.on_end = on_progress, on_end

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.on_progress({"name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond, "ms": dict(p.durationMs)})

    def onQueryTerminated(self, event) -> None:
        self.on_end(event.exception)


def windowed(events: DataFrame, ts: str, length: str, slide: str | None, late: str, *by: str) -> DataFrame:
    """Counts and sums by event-time window, with a bound on lateness. An extension: only processing time is asked for."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def job_states(events: DataFrame) -> DataFrame:
    """The state of each job from (job_id, ts, status, current, total): the last event, but a terminal state stays.

    Runs on a table, or as a complete-mode aggregation on a stream.
    """
    terminal = F.col("status").isin(*TERMINAL)
    return events.groupBy("job_id").agg(
        F.coalesce(F.min_by("status", F.when(terminal, F.col("ts"))), F.max_by("status", "ts")).alias("status"),
        F.max("current").alias("current"),
        F.max("total").alias("total"),
        F.min("ts").alias("started_at"),
        F.min(F.when(terminal, F.col("ts"))).alias("finished_at"),
    )


def stalled(events: DataFrame, now, seconds: int = 45) -> DataFrame:
    """Jobs not ended whose last event is older than a limit."""
    last = events.groupBy("job_id").agg(F.max("ts").alias("last"), F.max_by("status", "ts").alias("status"))
    return last.where(~F.col("status").isin(*TERMINAL) & (F.unix_timestamp(now) - F.unix_timestamp("last") > seconds))


def expired(jobs: DataFrame, now, ttl: int = 300) -> DataFrame:
    """Ended jobs whose state may go."""
    return jobs.where(F.col("status").isin(*TERMINAL) & (F.unix_timestamp(now) - F.unix_timestamp("finished_at") > ttl))
