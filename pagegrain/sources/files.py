"""Readers and writers of the engine's files: evaluation samples, runs, reports, objects, uploads, page images."""

from __future__ import annotations

import posixpath
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import object_name

SAMPLE = "question string, query string, answer string, images array<string>, image_paths array<string>, bbox string, doc_name string, category string, evidence_page array<int>"
RUN = "token_summary map<string,string>, failed_count int, sample_results array<struct<sample_id:int,question:string,doc_name:string,category:string,gt_bboxes:array<array<double>>,pred_bboxes:array<array<double>>,mean_iou:double,iou_at_0_5:double,tokens_selected:int,tokens_all_ocr:int,tokens_full_image:int,failed:boolean,error_message:string>>"


#: Rows of a report that is one file; a longer one is several, in order of their names.
MAX_REPORT = 1 << 20


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a text file, or of a folder's files by name, with their numbers from 0, in as many tasks as it has splits.

    Lines are counted by split first; a split begins where those before it end. There are as many counts as splits."""
    m = F.col("_metadata")
    lines = spark.read.text(path).select("value", m["file_path"].alias("_f"), m["file_block_start"].alias("_s"), F.monotonically_increasing_id().alias("_at"))
    splits = lines.groupBy("_f", "_s").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select(F.col("_f").alias("_sf"), F.col("_s").alias("_ss"), (before - F.col("_first")).alias("_move"))
    return lines.join(F.broadcast(starts), (F.col("_f") == F.col("_sf")) & (F.col("_s") == F.col("_ss"))).select((F.col("_at") + F.col("_move")).alias("line"), "value")


def samples(spark: SparkSession, path: str, limit: int | None = None, docs: list[str] | None = None, ids: list[int] | None = None) -> DataFrame:
    """Evaluation samples of a JSON-lines file: its line number as id, fallbacks for question and images, boxes flattened.

    Rows without an image or question are kept with ``skip`` saying why, so callers count them; an id filter comes before a
    document filter. Line numbers follow the file's byte order, whatever its size.
    """
    rows = numbered_lines(spark, path).select(F.col("line").cast("int").alias("sample_id"), F.from_json("value", SAMPLE, {"mode": "PERMISSIVE"}).alias("s")).where(F.col("s").isNotNull())
    image = F.get(F.coalesce("s.images", "s.image_paths"), F.lit(0))
    question = F.coalesce("s.question", "s.query", F.lit(""))
    out = rows.select(
        "sample_id", question.alias("question"), F.coalesce("s.answer", F.lit("")).alias("answer"), image.alias("image_path"), flat_boxes(F.col("s.bbox")).alias("boxes"),
        F.coalesce("s.doc_name", F.lit("")).alias("doc_name"), F.coalesce("s.category", F.lit("")).alias("category"), F.coalesce("s.evidence_page", F.array().cast("array<int>")).alias("evidence_page"),
        F.when(image.isNull(), "no image").when(F.trim(question) == "", "blank question").alias("skip"),
    )
    out = out if ids is None else out.where(F.col("sample_id").isin(ids))
    out = out if docs is None else out.where(F.col("doc_name").isin(docs))
    return out if limit is None else out.orderBy("sample_id").limit(limit)


def flat_boxes(text):
    """Boxes in nested JSON lists, as arrays of four numbers; lists that aren't such boxes are left out."""
    number = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
    found = F.regexp_extract_all(text, F.lit(rf"\[\s*({number}(?:\s*,\s*{number}){{3,}})\s*\]"), 1)
    return F.transform(found, lambda b: F.transform(F.slice(F.split(b, r"\s*,\s*"), 1, 4), lambda x: x.cast("double")))


def objects(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path, length, modificationTime of every object; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "length", "modificationTime")


def object_bytes(spark: SparkSession, root: str, path_like: str) -> DataFrame:
    """path and content of the objects whose path is like a pattern."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.col("path").like(path_like)).select("path", "content")


def first_page_image(spark: SparkSession, root: str, document: str, page: int) -> DataFrame:
    """The first image of a page by path."""
    return object_bytes(spark, root, f"%/{document}/{page}/image/%").orderBy("path").limit(1)


def newest(spark: SparkSession, root: str) -> str | None:
    """The path last changed below a root."""
    return objects(spark, root).agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]


def uploads(spark: SparkSession, landing: str, max_bytes: int, extensions: tuple[str, ...]) -> DataFrame:
    """Landed files with ``problem``: too_large, empty, type, or null where fine."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return objects(spark, landing).withColumn("problem", F.when(F.col("length") == 0, "empty").when(F.col("length") > max_bytes, "too_large").when(~ext.isin(*extensions), "type"))


def run_summary(spark: SparkSession, path: str) -> DataFrame:
    """Sample results of a run's JSON summary, one a row."""
    return spark.read.schema(RUN).option("multiLine", "true").json(path).select(F.inline("sample_results"))


def runs(spark: SparkSession, paths: dict[str, str]) -> DataFrame | None:
    """The runs of several models; one whose file is missing is left out."""
    out = None
    for model, path in paths.items():
        store, p = _path(spark, path)
        if not store.exists(p):
            continue
        one = run_summary(spark, path).withColumn("model", F.lit(model))
        out = one if out is None else out.unionByName(one)
    return out


def report(spark: SparkSession, path: str) -> DataFrame:
    """Data rows of a markdown report's tables: (line, cells)."""
    lines = spark.read.text(path).where(F.trim("value").startswith("|") & ~F.col("value").rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    return lines.select(F.col("value").alias("line"), cells.alias("cells"))


def report_metrics(rows: DataFrame, category: int, iou: int) -> DataFrame:
    """(category, n, mean_iou, hits) of a report's rows by column number; rows whose value isn't a number are left out."""
    value = F.try_to_number(F.get("cells", F.lit(iou)), F.lit("9.999")).cast("double")
    parsed = rows.select(F.get("cells", F.lit(category)).alias("category"), value.alias("iou")).where(F.col("iou").isNotNull())
    return parsed.groupBy("category").agg(F.count("*").alias("n"), F.avg("iou").alias("mean_iou"), F.count_if(F.col("iou") >= 0.5).alias("hits"))


def categories(spark: SparkSession, path: str) -> DataFrame:
    """(category, sample_ids) of a JSON-lines file."""
    return samples(spark, path).groupBy("category").agg(F.array_sort(F.collect_list("sample_id")).alias("sample_ids"))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON document a row."""
    rows.write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str, columns: list[str], order: str) -> None:
    """A markdown table: one file up to MAX_REPORT rows, beyond that as many as the sort has parts, in order of their names."""
    head = rows.sparkSession.createDataFrame([(0, f"| {' | '.join(columns)} |"), (1, f"|{'---|' * len(columns)}")], "n int, value string").withColumn("o", F.lit(None).cast(rows.schema[order].dataType))
    cell = lambda c: F.when(F.col(c).cast("double").isNotNull() & F.lit(dict(rows.dtypes)[c] in ("double", "float")), F.format_string("%.3f", F.col(c).cast("double"))).otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    body = rows.select(F.lit(2).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, columns)), F.lit(" |")).alias("value"), F.col(order).alias("o"))
    lines = head.unionByName(body).orderBy("n", "o", "value").select("value")
    (lines if rows.limit(MAX_REPORT + 1).count() > MAX_REPORT else lines.coalesce(1)).write.mode("overwrite").text(path)


def put(objects: DataFrame, root: str) -> DataFrame:
    """Writes each row's ``content`` at its ``path`` below a folder: (path, status). Each task writes its own rows; an object is written
    under a temporary name and moved, so it is whole or absent, and one written again is replaced."""

    def run(batches):
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            status = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    to = f"{base}/{inside(path)}"
                    files.create_dir(to.rsplit("/", 1)[0], recursive=True)
                    temporary = f"{to}.{uuid.uuid4().hex}"
                    with files.open_output_stream(temporary) as out:
                        out.write(content or b"")
                    files.move(temporary, to)
                    status.append("written")
                except (OSError, ValueError) as e:
                    status.append(f"error: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(status)], ["path", "status"])

    return objects.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, status string")


def delete_urls(urls: DataFrame, bucket: str, root: str) -> DataFrame:
    """Deletes the objects that urls name, below a folder: (url, status), ``deleted`` where it is gone or never was, else an error."""

    def run(batches):
        files, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            status = []
            for name in batch.column("name").to_pylist():
                try:
                    if name is None:
                        raise ValueError("no object of the bucket")
                    if files.get_file_info(to := f"{base}/{inside(name)}").type == fs.FileType.File:
                        files.delete_file(to)
                    status.append("deleted")
                except (OSError, ValueError) as e:
                    status.append(f"error: {e}")
            yield pa.RecordBatch.from_arrays([batch.column("url"), pa.array(status)], ["url", "status"])

    return urls.select("url", object_name(F.col("url"), bucket).alias("name")).mapInArrow(run, "url string, status string")


def inside(path: str) -> str:
    """A path that stays below its root, or an error."""
    out = posixpath.normpath(path.lstrip("/"))
    if out in (".", "..") or out.startswith("../"):
        raise ValueError(f"path leaves its root: {path}")
    return out


def report_after(results: DataFrame, path: str, columns: list[str], order: str, checkpoint: str):
    """A stream of results whose report and summary below ``path`` are written again after each micro-batch, from all results so far."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/results/batch={number}")
        every = spark.read.option("basePath", f"{path}/results").parquet(f"{path}/results").drop("batch")
        write_report(every.select(*columns), f"{path}/report", columns, order)
        write_json(every, f"{path}/summary")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_images(images: DataFrame, path: str) -> None:
    """Images by document and page; a committed write is whole or absent, and failed tasks are tried again."""
    images.write.mode("overwrite").partitionBy("document_id", "page_number").parquet(path)


def sse_events(text: DataFrame) -> DataFrame:
    """The JSON payloads of a server-sent event text (a row an event block): ``data: `` lines alone, malformed ones skipped."""
    lines = text.select(F.explode(F.split("value", r"\n\n")).alias("block")).select(F.explode(F.split("block", "\n")).alias("line"))
    payload = F.try_parse_json(F.substring("line", 7, 1 << 30))
    return lines.where(F.col("line").startswith("data: ")).select(payload.alias("event")).where(F.col("event").isNotNull())


def decode_crops(crops):
    """Bytes of base64 crops, null where malformed."""
    return F.transform(crops, lambda c: F.try_to_binary(c, F.lit("base64")))


PAGE = T.StructType([T.StructField("path", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("total_pages", T.IntegerType()), T.StructField("content", T.BinaryType())])
