"""Sharding by extendible hashing, in DataFrame operations alone.

A document's hash is the first 60 bits of the MD5 of its id and text. The directory is a binary trie over hash prefixes:
a bucket of more than ``limit`` bytes splits on its next bit, others stay, so a shard is named by the prefix
bits that lead to it and its depth is their number. Sums of cells some bits below the expected depth give
every bucket's size at once; only cells still too large are looked into further.

Edge cases: a null id or text hashes as empty; rows of one id part by text; identical rows can't be parted by
bits, so theirs, if too large, are numbered into pages ``bits:salt.page`` by the input partition; one row over the
limit is a shard of its own. An empty table gives no shard. Only the id and text columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import cut

BITS = 60
#: Bytes besides the text's that a row counts.
OVERHEAD = 16
LIMIT = 1 << 20
BELOW = 4
MAX_BROADCAST = 1 << 19


def _name(prefix: Column, depth: Column) -> Column:
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, "0"))


def keyed(docs: DataFrame, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, hash, bytes and the columns to keep of every row."""
    text = F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text))
    return docs.select(F.col(id_col).alias("id"), F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("hash"), (F.octet_length(text) + OVERHEAD).cast("long").alias("bytes"), *keep)


def _leaves(cells: DataFrame, depth: int, least: int, limit: int) -> DataFrame:
    """(cell, leaf) of the cells at ``depth`` that some bucket of depth ``least`` or more holds whole.

    Buckets are summed ``BELOW`` levels at a time from the cells up, and no further once none fits at a level: what holds
    a bucket too large is too large. So no level has fewer buckets than need be, down to one for all rows.
    """
    at, top, fits, rows = cells.select(F.col("cell").alias("bucket"), "bytes", "n"), depth, None, cells.select("cell")
    while True:
        low = max(least, top - BELOW)
        wide = at.select("bytes", "n", F.col("bucket").alias("at"), F.explode(F.sequence(F.lit(low), F.lit(top))).alias("d"))
        sums = cut(wide.groupBy("d", F.expr(f"shiftright(at, {top} - d)").alias("bucket")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")))
        good = sums.where((F.col("bytes") <= limit) | (F.col("n") == 1))
        fits = good.select("d", "bucket") if fits is None else fits.union(good.where(F.col("d") < top).select("d", "bucket"))
        if low == least or good.where(F.col("d") == low).isEmpty():
            break
        at, top = sums.where(F.col("d") == low).select("bucket", "bytes", "n"), low
    wide = rows.select("cell", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("d")).withColumn("bucket", F.expr(f"shiftright(cell, {depth} - d)"))
    return wide.join(fits, ["d", "bucket"]).groupBy("cell").agg(F.min("d").alias("leaf"))


def assign(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each of ``docs``: id, bytes, shard (its prefix bits), depth, and the columns to keep."""
    rows = keyed(docs, id_col, keep)
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    depth, least, out = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + BELOW), 0, None
    while True:
        at = rows.withColumn("cell", F.shiftright("hash", BITS - depth))
        cells = cut(at.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")))
        leaves = cut(_leaves(cells, depth, least, limit))
        n, m = cells.count(), leaves.count()
        small = F.broadcast(leaves) if m <= MAX_BROADCAST else leaves  # 12 bytes a row
        done = at.join(small, "cell").select("id", "bytes", _name(F.expr(f"shiftright(cell, {depth} - leaf)"), F.col("leaf")).alias("shard"), F.col("leaf").cast("int").alias("depth"), *keep)
        out = done if out is None else out.union(done)
        if n == m:
            break
        over = cells.join(leaves, "cell", "left_anti").select("cell")
        rest = at.join(F.broadcast(over) if n - m <= MAX_BROADCAST else over, "cell", "left_semi")
        if depth == BITS:
            salted = rest.withColumn("salt", F.spark_partition_id())
            number = F.row_number().over(Window.partitionBy("hash", "salt").orderBy("bytes")) - 1
            page = F.floor(number / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("bytes"))))
            name = F.format_string("%s:%d.%d", _name(F.col("hash"), F.lit(BITS)), F.col("salt"), page)
            out = out.union(salted.select("id", "bytes", name.alias("shard"), F.lit(BITS).alias("depth"), *keep))
            break
        rows, least, depth = rest.drop("cell"), depth + 1, min(BITS, depth + 2 * BELOW)
    return out.withColumnRenamed("id", id_col)


def directory(assigned: DataFrame) -> DataFrame:
    """One row a shard: its depth, rows and bytes."""
    return assigned.groupBy("shard", "depth").agg(F.count("*").alias("n_docs"), F.sum("bytes").alias("n_bytes"))


def write(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id") -> DataFrame:
    """Writes id and text of every row under ``path``/shard=_<bits>, one task a shard; returns the directory."""
    rows = assign(docs, limit, id_col, keep=("text",)).withColumn("shard", F.concat(F.lit("_"), "shard"))
    rows.repartition("shard").select(id_col, "text", "bytes", "depth", "shard").write.partitionBy("shard").mode("overwrite").parquet(path)
    written = docs.sparkSession.read.schema("depth int, bytes long, shard string").parquet(path)
    return directory(written.withColumn("shard", F.substring("shard", 2, 1 << 30)))
