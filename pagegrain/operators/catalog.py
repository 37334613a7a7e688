"""Points, objects and jobs: upserts, deletions, status and progress reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds from which a stage counts as slow, and job states that end a job.
SLOW = {"storage": 2.0, "embedding": 10.0, "ocr": 5.0, "upsert": 2.0}
TERMINAL = ("completed", "failed", "cancelled")


def last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that is last by ``order``; of equal ones the one whose other values hash highest."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(F.xxhash64(*rows.columns)))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(stored: DataFrame | None, new: DataFrame, key: str, order: str) -> DataFrame:
    """Stored rows replaced or joined by the last new row of each key."""
    new = last(new, key, order)
    return new if stored is None else stored.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_by(rows: DataFrame, column: str, value: object) -> tuple[DataFrame, int]:
    """The rows without those of a value, and how many went."""
    hit = F.col(column).eqNullSafe(F.lit(value))
    return rows.where(~hit), rows.where(hit).count()


def collection_status(points: DataFrame, dims: Mapping[str, int]) -> DataFrame:
    """Rows, distinct files, and MB as rows * sum of dimensions * 4 bytes, one vector a name."""
    n = F.count("*")
    return points.agg(n.alias("vectors_count"), F.countDistinct("filename").alias("unique_files"), F.round(n * sum(dims.values()) * 4 / (1 << 20), 2).alias("size_mb"))


def object_status(objects: DataFrame) -> DataFrame:
    """Objects, bytes, and objects by path class from (path, length)."""
    return objects.agg(F.count("*").alias("object_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"), F.count_if(F.col("path").like("%/image/%")).alias("image_count"), F.count_if(F.col("path").like("%/ocr%") & F.col("path").like("%.json")).alias("ocr_count"))


def document_pages(points: DataFrame, filename: str) -> DataFrame:
    return points.where(F.col("filename") == filename).select("page_number").distinct().orderBy("page_number")


def batch_outcomes(results: DataFrame, key: str) -> DataFrame:
    return results.groupBy(key).agg(F.count_if(F.col("status") == "success").alias("successful"), F.count_if(F.col("status") != "success").alias("failed"), F.count("*").alias("total"))


def rolled_up(status: Column) -> Column:
    """success if all succeeded or were skipped, partial if some succeeded, else error; an aggregate."""
    return F.when(F.bool_and(status.isin("success", "skipped")), "success").when(F.bool_or(status == "success"), "partial").otherwise("error")


def complete_batches(events: DataFrame, keys: tuple[str, ...], stages: int) -> DataFrame:
    """Keys whose distinct finished stages are as many as asked for."""
    return events.groupBy(*keys).agg(F.countDistinct("stage").alias("n_stages")).where(F.col("n_stages") >= stages)


def progress_changes(events: DataFrame, key: str, order: str, fields: tuple[str, ...]) -> DataFrame:
    """Events that differ in a field from the one before; the first always."""
    w = Window.partitionBy(key).orderBy(order)
    before = {f"_{f}": F.lag(f).over(w) for f in fields}
    changed = F.row_number().over(w) == 1
    out = events.withColumns(before).withColumn("_first", changed)
    cond = F.col("_first")
    for f in fields:
        cond = cond | ~F.col(f).eqNullSafe(F.col(f"_{f}"))
    return out.where(cond).drop("_first", *before)


def percent(current: Column, total: Column) -> Column:
    """Whole percent, halves to even; 0 without a total."""
    return F.when(total > 0, F.bround(100.0 * current / total, 0).cast("int")).otherwise(F.lit(0))


def pace(stage: Column, seconds: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in SLOW.items() for x in kv))
    return F.when(seconds > F.element_at(table, stage), "slow").otherwise("ok")


def running(events: DataFrame, job: str = "job_id", ts: str = "ts", pages: str = "pages") -> DataFrame:
    """Events with the pages done so far by their job, and pages a second since its first event (null until time has passed)."""
    w = Window.partitionBy(job).orderBy(ts)
    done = F.sum(pages).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000
    seconds = at - F.min(at).over(w)
    return events.withColumns({"done": done, "pages_per_second": F.when(seconds > 0, done / seconds)})


def progress_frames(events: DataFrame, job: str = "job_id", order: str = "event_id") -> DataFrame:
    """(job, order, frame): a server-sent event for each poll of a job's state, up to its first terminal one: ``progress`` where the
    count or the status changed, else ``heartbeat``."""
    w = Window.partitionBy(job).orderBy(order)
    ended = F.max(F.col("status").isin(*TERMINAL).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    same = F.col("current").eqNullSafe(F.lag("current").over(w)) & F.col("status").eqNullSafe(F.lag("status").over(w)) & (F.row_number().over(w) > 1)
    body = F.to_json(F.struct(F.col(job).alias("job_id"), "status", "current", "total", percent(F.col("current"), F.col("total")).alias("percent")))
    frame = F.when(same, F.lit("event: heartbeat\ndata: {}\n\n")).otherwise(F.concat(F.lit("event: progress\ndata: "), body, F.lit("\n\n")))
    return events.withColumns({"_ended": F.coalesce(ended, F.lit(0)), "frame": frame}).where("_ended = 0").select(job, order, "frame")


def health(checks: DataFrame) -> DataFrame:
    """Core health from (name, ok): optional services don't count."""
    return checks.agg(F.bool_and(F.when(F.col("name") != "ocr", F.col("ok")).otherwise(F.lit(True))).alias("healthy"), F.count_if(~F.col("ok")).alias("failing"))


def create_if_absent(spark: SparkSession, name: str, schema: str) -> bool:
    """Makes an empty table unless it exists; an existing one must have the columns."""
    if spark.catalog.tableExists(name):
        want = {f.name for f in spark.createDataFrame([], schema).schema.fields}
        if missing := want - set(spark.table(name).columns):
            raise ValueError(f"{name} lacks {sorted(missing)}")
        return False
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet")
    return True


def clear(spark: SparkSession, name: str) -> int:
    """Empties a table and returns the rows it had."""
    n = spark.table(name).count()
    spark.sql(f"TRUNCATE TABLE {name}")
    return n


def drop(spark: SparkSession, name: str) -> str:
    existed = spark.catalog.tableExists(name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return "success" if existed else "skipped"


def delete_prefix(spark: SparkSession, prefix: str) -> dict[str, int]:
    """Deletes the files below a path, on any file system that Spark reaches: {deleted, failed}."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(prefix)
    fs, deleted, failed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 0, 0
    if not fs.exists(path):
        return {"deleted": 0, "failed": 0}
    files = fs.listFiles(path, True)
    while files.hasNext():
        ok = fs.delete(files.next().getPath(), False)
        deleted, failed = deleted + bool(ok), failed + (not ok)
    if not failed:
        fs.delete(path, True)
    return {"deleted": deleted, "failed": failed}
