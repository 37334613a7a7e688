"""Mean pooling of patch grids along rows or columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sums(batches):
    """Per batch: the sum and the number of the vectors of each (page, idx, dimension)."""
    for batch in batches:
        vec = batch.column("vec")
        size = pa.compute.list_value_length(vec).fill_null(0).to_numpy(zero_copy_only=False)
        page, idx = batch.column("page").to_numpy(), batch.column("idx").to_numpy()
        for dim in np.unique(size[size > 0]):
            rows = np.flatnonzero(size == dim)
            m = vec.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            order = np.lexsort((idx[rows], page[rows]))
            p, i = page[rows][order], idx[rows][order]
            first = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (i[1:] != i[:-1]))))
            total = np.add.reduceat(m[order], first, axis=0)
            n = np.diff(np.append(first, len(p)))
            offsets = pa.array(np.arange(0, total.size + 1, dim), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(p[first]), pa.array(i[first]), pa.ListArray.from_arrays(offsets, pa.array(total.ravel())), pa.array(n)], ["page", "idx", "total", "n"])


def pool(patches: DataFrame, axis: str, keep_others: bool = True) -> DataFrame:
    """(page, idx, vec): the mean vector of each row (axis py) or column (axis px) of a page's grid.

    Batches are summed before the shuffle; what a page's row or column has to merge is one partial sum a batch that held a part
    of it. Rows without a grid place (px or py null) are prefix or postfix tokens and stay as they are, after the pooled ones.
    """
    if axis not in ("px", "py"):
        raise ValueError(f"unknown axis: {axis}")
    grid = patches.where(F.col("page").isNotNull() & F.col("px").isNotNull() & F.col("py").isNotNull() & F.col("vec").isNotNull())
    parts = grid.select(F.col("page").cast("long").alias("page"), F.col(axis).cast("int").alias("idx"), F.col("vec").cast("array<double>").alias("vec")).mapInArrow(_sums, "page long, idx int, total array<double>, n long")
    add = F.aggregate(F.collect_list("total"), F.array().cast("array<double>"), lambda s, x: F.when(F.size(s) == 0, x).otherwise(F.zip_with(s, x, lambda a, b: a + b)))
    sums = parts.groupBy("page", "idx").agg(add.alias("total"), F.sum("n").alias("n"))
    out = sums.select("page", "idx", F.transform("total", lambda x: x / F.col("n")).alias("vec"))
    if not keep_others:
        return out
    others = patches.where(F.col("px").isNull() | F.col("py").isNull())
    return out.unionByName(others.select(F.col("page").cast("long").alias("page"), (F.col("idx") + 1_000_000).cast("int").alias("idx"), F.col("vec").cast("array<double>").alias("vec")))


def reshape(flat: DataFrame, nx: int, ny: int, scores: str = "scores") -> DataFrame:
    """Flat score arrays as grid rows (.., px, py, score) in raster order: a short array is filled with 0, a long one cut."""
    rest = [c for c in flat.columns if c != scores]
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(nx * ny - 1)), lambda i: F.coalesce(F.get(scores, i).cast("double"), F.lit(0.0))))
    return flat.select(*rest, at.alias("_i", "score")).select(*rest, (F.col("_i") % nx).alias("px"), F.floor(F.col("_i") / nx).cast("int").alias("py"), "score")


def grid_places(tokens: DataFrame, nx: int, ny: int, global_tokens: int = 0, check: bool = True) -> DataFrame:
    """px and py by raster order for (page, idx, vec) rows; the last ``global_tokens`` of a page, and what is beyond the grid, have none.

    With ``check``, a page with another number of patches than nx * ny raises an error.
    """
    n = tokens.groupBy("page").agg(F.count("*").alias("_n"))
    out = tokens.join(n, "page")
    patches = F.col("_n") - global_tokens
    if check:
        out = out.where(F.when(patches == nx * ny, F.lit(True)).otherwise(F.raise_error(F.format_string("page %s has %d patches", F.col("page").cast("string"), patches)).cast("boolean")))
    inside = (F.col("idx") < patches) & (F.col("idx") < nx * ny)
    return out.withColumns({"px": F.when(inside, (F.col("idx") % nx).cast("int")), "py": F.when(inside, F.floor(F.col("idx") / nx).cast("int"))}).drop("_n")
