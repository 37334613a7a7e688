"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates.

Features of a text are its words, word pairs, and the same over word shapes (letters, digits and other
characters collapsed; one shape for all pairs of equal words), each hashed into ``bits`` bits. A score is the logistic function of one sparse dot
product, normalised by the number of features, so a text's length alone says nothing.

Edge cases: a null or empty text has no feature and gets the bias' score; a null, missing or repeated
doc_id is scored row by row; of the rows of one labelled doc_id one is learnt from, the one of least text hash; labels that are null are ignored and labels of one doc_id that differ count by
their mean (1 from 0.5); with no usable label every score is 0.5, predicted 1. Other columns of the
input never enter and clashing names can't reach the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .session import bounded, tidy

BITS = 18
#: At most so many labelled documents are learnt from, those with the smallest hash of doc_id.
MAX_LABELLED = 12_000
EPOCHS = 3
SCALE = 24.0
_TWICE = np.uint64(0x2545F4914F6CDD1D)
ALPHA, BETA, L1, L2 = 0.35, 1.0, 0.002, 0.01


def features(texts: pa.Array, bits: int = BITS):
    """(block, feature ids, row offsets): four kinds of ids for each word, in row order by kind."""
    mask, salts = np.uint64((1 << bits) - 1), [np.uint64(0x51ED270B * (2 * k + 1)) for k in range(4)]
    for b in K.words(texts, shape=True):
        ids = []
        for one, k in ((b.hash, 0), (b.shape, 2)):
            pair = np.empty_like(one)
            if len(one):
                pair[:-1] = K.mix(one[:-1] + K.COMBINE[1]) + one[1:] * K.COMBINE[2]
                if k == 2:
                    pair[:-1][b.hash[1:] == b.hash[:-1]] = _TWICE  # a pair of one word with itself, whatever the word
                last = b.off[1:][b.counts > 0] - 1  # the last word of a row pairs with the end, whatever row is next
                pair[last] = K.mix(one[last] + K.COMBINE[3])
            ids += [(K.mix(one + salts[k]) & mask), (K.mix(pair + salts[k + 1]) & mask)]
        yield b, np.stack(ids, axis=1).astype(np.int32) if len(b.hash) else np.zeros((0, 4), np.int32)


def _gather(bits: int):
    """Rows of (order, y, features) from rows of (order, y, text)."""

    def run(batches):
        for batch in batches:
            order, y = batch.column("order").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False)
            out = []
            for b, ids in features(batch.column("text"), bits):
                out += [ids[b.off[i] : b.off[i + 1]].tobytes() for i in range(b.hi - b.lo)]
            yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(y), pa.array(out, pa.binary())], ["order", "y", "features"])

    return run


def ftrl(examples, size: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights and bias of FTRL-proximal over (ids, values, y), one example after the other."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for ids, values, y in examples:
            w = weight(ids)
            g = (1 / (1 + np.exp(-np.clip(w @ values, -30, 30))) - y) * values
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
            z[ids] += g - sigma * w
            n[ids] += g * g
    w = weight(np.arange(size + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def _example(ids: np.ndarray, y: float, size: int):
    unique, count = np.unique(ids, return_counts=True)
    return np.append(unique, size).astype(np.int32), np.append(count * (SCALE / max(1, len(ids))), 1.0).astype(np.float32), y


def _learn(bits: int):
    def run(batches):
        got = [(o, y, f) for b in batches for o, y, f in zip(*(b.column(k).to_pylist() for k in ("order", "y", "features")), strict=True)]
        got.sort()
        if got:
            size = 1 << bits
            for i, (_, y, f) in enumerate(got):  # in place, so texts' features and examples aren't both held
                got[i] = _example(np.frombuffer(f, np.int32), y, size)
            w, bias = ftrl(got, size)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], ["w", "bias"])

    return run


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Weights learnt from the labelled documents outside the held-out fold. The sample is bounded, so one task can hold it."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    known = known.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(max_labelled)
    rows = bounded(docs).select("doc_id", "text").join(F.broadcast(known), "doc_id")  # max_labelled rows of 24 bytes at most
    # one text an id, the one of least hash, so that an id with many rows is one example and the sample stays bounded
    rows = rows.groupBy("doc_id", "order", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("order", "y", "text")
    rows = rows.mapInArrow(tidy(_gather(bits)), "order long, y double, features binary")
    got = rows.repartition(1).mapInArrow(tidy(_learn(bits)), "w binary, bias double").collect()
    return (np.frombuffer(got[0]["w"], np.float32), got[0]["bias"]) if got else (np.zeros(1 << bits, np.float32), 0.0)


def held_out(doc_id):
    """The fold that no label is learnt from; a null doc_id is outside it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _scored(model, bits: int, fields: int):
    def run(batches):
        w, bias = model.value
        for batch in batches:
            score = np.full(batch.num_rows, 1 / (1 + np.exp(-bias)))
            for b, ids in features(batch.column(fields), bits):
                total = K.sums(w[ids].sum(axis=1, dtype=np.float64), b.off)
                score[b.lo : b.hi] = 1 / (1 + np.exp(-(bias + total * SCALE / np.maximum(1, 4 * b.counts))))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(fields)), pa.array(score)], [*batch.schema.names[:fields], "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), bits: int = BITS, max_labelled: int = MAX_LABELLED, with_text: bool = False) -> DataFrame:
    """``keep`` columns of every document with held_out, score and predicted; ``with_text`` keeps the text as well."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, bits, max_labelled))  # 4 * 2**bits bytes
    rows = docs.select(*keep, F.col("text").alias("_text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    if with_text:
        rows = rows.select(*keep, "_text", F.col("_text").alias("_again"))
        out = rows.mapInArrow(tidy(_scored(model, bits, len(keep) + 1)), f"{schema}, _text string, score double").withColumnRenamed("_text", "text")
    else:
        out = rows.mapInArrow(tidy(_scored(model, bits, len(keep))), f"{schema}, score double")
    return out.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= 0.5).cast("int")})
