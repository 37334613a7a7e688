"""Training-order materialisation of token ids in fixed-stride binary shards.

Texts become one stream of ids (each text's ids, then an end id) for each scan partition, cut into sequences of
``length`` ids; only a partition's last one is padded. A sequence's number is its place in that order; a keyed
Feistel permutation of [0, total), with cycle-walking from the next power of four, gives its slot. Shard s holds slots
[s * per_shard, (s + 1) * per_shard) in order as little-endian 16-bit ids, so slot k is at byte
(k % per_shard) * stride of its shard: training reads files from start to end and resumes at any slot.

Two passes over the input: the first counts ids by partition without making them, the second encodes again and deals sequences to
shards. A task of the second that doesn't find what the first counted raises an error, so an input whose partitions
aren't the same each time must be cut first (``stable=False`` does so). A shard is written under a temporary name and
moved, by one task; a task run again writes the same bytes.

Edge cases: a null or empty text is its end id; repeated rows are written each; a very long text spans many sequences;
an empty table has no sequence and no shard; ids are of any type. Only the id and text columns are read. ``path`` is one that
pyarrow's file systems know (local, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.objects import filesystem
from .session import bounded, cut, tidy
from .textkernel import mix
from .tokens import coder, default_path, with_end

LENGTH = 1024
SHARD_BYTES = 1 << 25
KEY = 0x5EED


def feistel(numbers: np.ndarray, total: int, key: int, rounds: int = 6, back: bool = False) -> np.ndarray:
    """The slots of the numbers in [0, total), a permutation fixed by the key; ``back``: the numbers of the slots."""
    half = max(1, (max(2, total) - 1).bit_length() + 1 >> 1)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.uint64(key) + np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.array(numbers, np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> shift, out[todo] & low
        for k in keys[::-1] if back else keys:
            a, b = (b ^ (mix(a ^ k) & low), a) if back else (b, a ^ (mix(b ^ k) & low))
        out[todo] = a << shift | b
        todo = todo[out[todo] >= total]  # walk on until inside
    return out.astype(np.int64)


def _count(path: str):
    def run(batches):
        ids, seen = 0, 0
        for batch in batches:
            for sizes in coder(path).sizes(batch.column("text")):
                ids += int(sizes.sum()) + len(sizes)
                seen = zlib.crc32((sizes + 1).astype("<i8").tobytes(), seen)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([ids]), pa.array([seen])], ["part", "ids", "check"])

    return run


def _deal(path: str, sent, length: int, per_shard: int, total: int, key: int, end: int, id_type: pa.DataType):
    """Rows of (shard, slot, sequence, ids, documents, starts, lengths)."""
    names = ["shard", "slot", "sequence", "ids", "docs", "starts", "sizes"]

    def run(batches):
        first, expected, check = sent.value[TaskContext.get().partitionId()]
        number, seen, held = first, 0, np.zeros(0, np.uint16)
        docs: deque = deque()  # of what is held: [doc, start in doc, ids]

        def rows(n: int, pad: bool):
            nonlocal number, held
            out = [[] for _ in names]
            block = held[: n * length]
            if pad:
                block = np.concatenate((block, np.full(n * length - len(block), end, np.uint16)))
            slots = feistel(np.arange(number, number + n), total, key)
            for k in range(n):
                room, parts = length, []
                while room and docs:
                    doc, start, size = docs[0]
                    take = min(room, size)
                    parts.append((doc, start, take))
                    room -= take
                    if take == size:
                        docs.popleft()
                    else:
                        docs[0] = [doc, start + take, size - take]
                blob = block[k * length : (k + 1) * length].astype("<u2").tobytes()
                for column, value in zip(out, (slots[k] // per_shard, slots[k], number + k, pa.compress(blob, "zstd", asbytes=True), *map(list, zip(*parts, strict=True))), strict=True):
                    column.append(value)
            number += n
            held = held[n * length :]
            kinds = [pa.int64()] * 3 + [pa.binary(), pa.list_(id_type)] + [pa.list_(pa.int64())] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

        for batch in batches:
            for lo, hi, ids, bounds in coder(path).encode(batch.column("text")):
                ids, bounds = with_end(ids, bounds, end)
                sizes = np.diff(bounds)
                seen = zlib.crc32(sizes.astype("<i8").tobytes(), seen)
                docs.extend([d, 0, n] for d, n in zip(batch.column("id").slice(lo, hi - lo).to_pylist(), sizes.tolist(), strict=True))
                held = np.concatenate((held, ids))
                if n := len(held) // length:
                    yield rows(n, False)
        ids = (number - first) * length + len(held)
        if (ids, seen) != (expected, check):
            raise RuntimeError("the input's partitions changed between the passes; pass stable=False")
        if len(held):
            yield rows(1, True)

    return run


def _write(path: str, id_type: pa.DataType):
    """Writes the partition's slots, in order, as one shard; yields a row for each piece of a document."""
    names = ["id", "start", "length", "sequence", "slot", "shard", "at", "record_crc32"]

    def run(batches):
        files, root = filesystem(path)
        name, out = f"{root}/.{uuid.uuid4().hex}", None
        try:
            for batch in batches:
                rows = batch.to_pylist()
                if rows and out is None:
                    shard = rows[0]["shard"]
                    out = files.open_output_stream(name)
                columns = [[] for _ in names]
                for r in rows:
                    record = pa.decompress(r["ids"], r["bytes"], "zstd", asbytes=True)
                    out.write(record)
                    at, crc = 0, zlib.crc32(record)
                    for doc, start, n in zip(r["docs"], r["starts"], r["sizes"], strict=True):
                        for column, value in zip(columns, (doc, start, n, r["sequence"], r["slot"], r["shard"], at, crc), strict=True):
                            column.append(value)
                        at += n
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, pa.int64()) for c in columns[1:])], names)
            if out is not None:
                out.close()
                files.move(name, shard_path(root, shard))
        except BaseException:  # a failed or ended attempt leaves nothing behind
            if out is not None:
                out.close()
                files.delete_file(name)
            raise

    return run


def shard_path(root: str, shard: int) -> str:
    return f"{root.rstrip('/')}/shard-{shard:08d}.bin"


def materialise(docs: DataFrame, path: str, tokenizer: str | None = None, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, key: int = KEY, end: int = 0, id_col: str = "doc_id", stable: bool = True) -> DataFrame:
    """Writes the shards and ``manifest.json`` under ``path`` (a folder that all executors share); returns one row for each piece
    of a document: id, start and length in its ids, sequence, slot, shard, place in the slot and the record's checksum."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_path()
    rows = bounded(docs).select(F.col(id_col).alias("id"), "text")
    kind, id_type = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)
    rows = rows if stable else cut(rows)
    counted = rows.select("text").mapInArrow(tidy(_count(tokenizer)), "part long, ids long, check long").collect()  # one row an input partition
    firsts, total = {}, 0
    for r in sorted(counted, key=lambda r: r["part"]):
        firsts[r["part"]] = (total, r["ids"], r["check"])
        total += -(-r["ids"] // length)
    per_shard = max(1, shard_bytes // (2 * length))
    shards = -(-total // per_shard)
    files, root = filesystem(path)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root.rstrip('/')}/manifest.json") as f:
        f.write(json.dumps({"total": total, "length": length, "stride": 2 * length, "per_shard": per_shard, "shards": shards, "key": key, "dtype": "<u2"}).encode())
    schema = f"id {kind}, start long, length long, sequence long, slot long, shard long, at long, record_crc32 long"
    if not total:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    sent = spark.sparkContext.broadcast(firsts)
    dealt = rows.mapInArrow(tidy(_deal(tokenizer, sent, length, per_shard, total, key, end, id_type)), f"shard long, slot long, sequence long, ids binary, docs array<{kind}>, starts array<long>, sizes array<long>")
    dealt = dealt.withColumn("bytes", F.lit(2 * length)).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("slot")
    return cut(dealt.mapInArrow(tidy(_write(path, id_type)), schema)).withColumnRenamed("id", id_col)


def read(path: str, first: int = 0, count: int | None = None):
    """The sequences from slot ``first`` on, in training order, as arrays; each shard is read forward once."""
    files, root = filesystem(path)
    with files.open_input_stream(f"{root.rstrip('/')}/manifest.json") as f:
        m = json.loads(f.read())
    last = m["total"] if count is None else min(m["total"], first + count)
    while first < last:
        shard, skip = divmod(first, m["per_shard"])
        n = min(last - first, m["per_shard"] - skip)
        with files.open_input_file(shard_path(root, shard)) as f:
            f.seek(skip * m["stride"])
            for _ in range(n):
                yield np.frombuffer(f.read(m["stride"]), m["dtype"])
        first += n
