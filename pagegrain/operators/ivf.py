"""Candidates by an inverted file: vectors in cells around trained centres, of which a query reads those nearest to its tokens.

Centres come from k-means by cosine over all vectors, each round one pass that sums the vectors of a cell within a batch before
the shuffle. Vectors are stored by cell, so the cells that are probed are read by partition pruning and others aren't opened. A page is a
candidate of a query if one of its vectors lies in a cell that a token of the query probes, and candidates are scored exactly; with all cells
probed the result is the exact one. There are ``MAX_CELLS`` at most, so centres are small enough to be in every task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import search as S

MAX_CELLS = 4096
#: Vectors that the first centres are drawn from, for each cell.
DRAWN = 16


def _near(vectors: pa.Array, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that count, their unit vectors, the number of the nearest centre; the first of equals)."""
    rows, m = S._matrix(vectors, centres.shape[1], False)
    step = max(1, S.PRODUCT_BYTES // (8 * len(centres)))
    cell = [np.argmax(np.round(m[a : a + step] @ centres.T, 12), axis=1) for a in range(0, len(m), step)]
    return rows, m, np.concatenate(cell) if cell else np.zeros(0, np.int64)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1)


def first_centres(vectors: DataFrame, cells: int) -> np.ndarray:
    """Vectors spread over a bounded draw: those of smallest hash, each next one the farthest from those taken."""
    drawn = vectors.select(F.col("vec").cast("array<double>").alias("vec")).where("vec is not null").orderBy(F.xxhash64("vec"), "vec").limit(DRAWN * cells)
    rows = [r.vec for r in drawn.collect() if None not in r.vec]
    pool = _unit(np.array([r for r in rows if len(r) == len(rows[0])], np.float64)) if rows else np.zeros((0, 1))
    pool = pool[np.linalg.norm(pool, axis=1) > 0]
    taken = [0] if len(pool) else []
    best = pool @ pool[0] if len(pool) else np.zeros(0)
    while len(taken) < min(cells, len(pool)):
        taken.append(int(np.argmin(best)))
        best = np.maximum(best, pool @ pool[taken[-1]])
    return pool[taken]


def train(vectors: DataFrame, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres (cell, dimension) of all vectors (page, vec). A cell that nothing is near to keeps its centre."""
    if not 0 < cells <= MAX_CELLS:
        raise ValueError(f"cells are 1 to {MAX_CELLS}")
    centres = first_centres(vectors, cells)
    for _ in range(rounds if len(centres) else 0):

        def sums(batches, centres=centres):
            for batch in batches:
                _, m, cell = _near(batch.column("vec"), centres)
                if len(m):
                    order = np.argsort(cell, kind="stable")
                    first, _ = S._bounds(cell[order])
                    total = np.add.reduceat(m[order], first, axis=0)
                    offsets = pa.array(np.arange(0, total.size + 1, total.shape[1]), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(cell[order][first]), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))], ["cell", "total"])

        parts = vectors.select("vec").mapInArrow(sums, "cell long, total array<double>")
        added = parts.select("cell", F.posexplode("total").alias("k", "x")).groupBy("cell", "k").agg(F.sum("x").alias("x"))
        new = centres.copy()
        for r in added.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).collect():  # MAX_CELLS at most
            new[r["cell"]] = [x["x"] for x in r["v"]]
        new = _unit(new)
        moved, centres = float(np.abs(new - centres).max()), new
        if moved < 1e-4:
            break
    return centres


def assign(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """The vectors' columns and ``cell``; a vector that has no direction, or another dimension than the centres, has none and is left out."""

    def run(batches):
        for batch in batches:
            rows, _, cell = _near(batch.column("vec"), centres)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    return vectors.mapInArrow(run, f"{S._ddl(vectors, ())}, cell int")


def write(vectors: DataFrame, centres: np.ndarray, path: str, split: int = 1) -> None:
    """Vectors stored by cell. A cell's vectors are dealt to ``split`` tasks by page, so a cell that holds many isn't one task's."""
    rows = assign(vectors, centres)
    rows.repartition("cell", F.pmod(F.xxhash64("page"), F.lit(split))).write.mode("overwrite").partitionBy("cell").parquet(path)


def probes(queries: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
    """(query_id, token, cell): the n cells nearest to each query token; ties by cell."""
    spark = queries.sparkSession
    rows = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "page long, vec array<double>")
    near = S.similarities(rows, queries).withColumn("sim", F.round("sim", 12))
    w = Window.partitionBy("query_id", "token").orderBy(F.desc("sim"), "page")
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select("query_id", "token", F.col("page").cast("int").alias("cell"))


def search(stored: DataFrame, patches: DataFrame, queries: DataFrame, centres: np.ndarray, n: int, k: int = 10, combine: str = "sum") -> DataFrame:
    """Top k pages of each query among the candidates of its n nearest cells for each token, scored exactly from ``patches``.

    ``stored`` is what ``write`` wrote (or ``assign`` gave): the probed cells, at most as many as there are, are a condition on its partitions.
    """
    queries = S.held(queries)
    asked = probes(queries, centres, n).select("query_id", "cell").distinct()
    wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # MAX_CELLS at most
    pairs = stored.where(F.col("cell").isin(wanted)).select("page", "cell").distinct().join(asked, "cell").select("query_id", "page").distinct()
    return S.top(S.maxsim_of(patches, queries, pairs, combine), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact (query_id, page) that were found."""
    hit = exact.join(found.select("query_id", "page", F.lit(1).alias("_hit")), ["query_id", "page"], "left")
    return hit.agg(F.avg(F.coalesce("_hit", F.lit(0)))).first()[0] or 0.0


def open_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
