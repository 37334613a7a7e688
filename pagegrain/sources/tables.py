"""Base tables, and the retrieval tables derived from them: patches, queries, regions, truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The derived pages: a grid of patches over a page of fixed size.
NX, NY, WIDTH, HEIGHT, PER_PAGE = 5, 4, 500, 400, 20
#: Regions of a page; the pages that truth is spread over; and every how many embeddings one is a query.
REGIONS, PAGES, QUERY_STEP = 40, 25, 100
DIM = 64
LABELS = ("text", "title", "image", "table", "figure")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. A local session that names none has one below its warehouse; a cluster must name one."""
    sc = spark.sparkContext
    named, current = sc.getConf().get("spark.checkpoint.dir", None), sc._jsc.sc().getCheckpointDir()
    if named is None and current.isEmpty() and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    named = named or (current.get() if current.isDefined() else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder, so that what follows reads it instead of making it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, idx, px, py, label, vec"""
    e, idx = read(spark, sf_dir, "embeddings"), F.col("vec_id") % PER_PAGE
    return e.select(F.expr(f"vec_id div {PER_PAGE}").alias("page"), idx.cast("int").alias("idx"), (idx % NX).cast("int").alias("px"), F.expr(f"CAST((vec_id % {PER_PAGE}) div {NX} AS INT)").alias("py"), "label", F.col("embedding").alias("vec"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, token, vec: each embedding whose id is divisible by QUERY_STEP, with the two after it, is a query of three tokens."""
    e, at = read(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP
    return e.where(at < 3).select(F.expr(f"vec_id div {QUERY_STEP}").alias("query_id"), at.alias("token"), F.col("embedding").alias("vec"))


def _box(i, shift: int = 0) -> dict:
    x1, y1 = (i * 37) % 400 + shift, (i * 53) % 300 + shift
    return {"x1": x1.cast("int"), "y1": y1.cast("int"), "x2": (x1 + 20 + (i * 11) % 120).cast("int"), "y2": (y1 + 20 + (i * 7) % 90).cast("int")}


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, region_id, box, label, content, category"""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    label = F.element_at(F.array(*map(F.lit, LABELS)), (i % 5).cast("int") + 1)
    return d.select(F.expr(f"doc_id div {REGIONS}").alias("page"), i.alias("region_id"), *(c.alias(k) for k, c in _box(i).items()), label.alias("label"), F.col("text").alias("content"), F.col("lang").alias("category"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, gt_ord, box: one true box of each benchmark item, for the page of that number."""
    i = F.col("item_id")
    return read(spark, sf_dir, "benchmark").select(i.alias("sample_id"), F.lit(0).alias("gt_ord"), *(c.alias(k) for k, c in _box(i, 15).items()))
