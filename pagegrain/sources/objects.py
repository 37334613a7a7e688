"""Objects written in two phases: a job's objects are all there or none is, whatever task or executor is lost.

Tasks put contents under ``_staging/<job>`` and tell what they put; that list is written as the job's manifest; then one record,
``_commits/<job>``, says that the job is good. Only after that are objects moved to their names, by tasks again, each move one that may be repeated.
``recover`` ends what a lost driver left: jobs with a record are moved on, others are deleted. Each step is tried again with growing
pauses. Nothing of the contents passes the driver, and the manifest stays a table.

Paths are those that pyarrow's file systems know; ``s3a`` and ``s3n`` are the same store as ``s3``, ``dbfs`` a mounted folder.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import BATCH_BYTES, bounded
from ..plans.config import backoff
from .files import inside

#: Other names of schemes, and what they begin with for pyarrow.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "dbfs:/": "/dbfs/", "file:///": "/"}
ATTEMPTS = 4
#: Objects that are asked for at once.
READ = 256


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    for ours, theirs in SCHEMES.items():
        if uri.startswith(ours):
            uri = theirs + uri[len(ours) :].lstrip("/")
            break
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def tried(step: Callable, attempts: int = ATTEMPTS, pause: Callable[[float], None] = time.sleep):
    """The result of a step, which runs again after each failure of the store, with growing pauses."""
    for n in range(1, attempts + 1):
        try:
            return step()
        except OSError:
            if n == attempts:
                raise
            pause(backoff(n))


def _stage(root: str, job: str):
    def run(batches):
        files, base = filesystem(root)
        folder = f"{base}/_staging/{job}/objects"
        files.create_dir(folder, recursive=True)
        for batch in batches:
            names, sizes = [], []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                inside(path)  # a path that leaves the root fails the job
                name, body = f"{folder}/{uuid.uuid4().hex}", content.as_buffer() if content.is_valid else b""

                def put(name=name, body=body):
                    with files.open_output_stream(name) as out:
                        out.write(body)

                tried(put)
                names.append(name)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["path", "staged", "size"])

    return run


def _move(root: str):
    def run(batches):
        files, base = filesystem(root)
        for batch in batches:
            for path, staged in zip(batch.column("path").to_pylist(), batch.column("staged").to_pylist(), strict=True):
                to = f"{base}/{inside(path)}"

                def move(to=to, staged=staged):
                    if files.get_file_info(staged).type == fs.FileType.File:  # else an earlier attempt moved it
                        files.create_dir(to.rsplit("/", 1)[0], recursive=True)
                        files.move(staged, to)

                tried(move)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("size")], ["path", "size"])

    return run


def _manifest(spark: SparkSession, root: str, job: str) -> DataFrame:
    return spark.read.schema("path string, staged string, size long").parquet(f"{root}/_staging/{job}/manifest")


def _finish(spark: SparkSession, root: str, job: str) -> int:
    """Moves a good job's objects to their names and forgets it; returns how many there are."""
    done = _manifest(spark, root, job).mapInArrow(_move(root), "path string, size long").agg(F.count("*")).first()[0]
    files, base = filesystem(root)
    files.delete_dir(f"{base}/_staging/{job}")
    files.delete_file(f"{base}/_commits/{job}")
    return done


def write(objects: DataFrame, root: str, job: str | None = None) -> int:
    """Writes rows (path, content) below a folder, all or none, and returns how many; an object of that name is replaced, and of
    rows with one path the one whose content hashes highest stays. A job of a name that was recorded before is carried on, not written again."""
    spark, root, job = objects.sparkSession, root.rstrip("/"), job or uuid.uuid4().hex
    files, base = filesystem(root)
    if files.get_file_info(f"{base}/_commits/{job}").type == fs.FileType.File:
        return _finish(spark, root, job)
    rows = objects.where("path is not null").groupBy("path").agg(F.max_by(F.col("content").cast("binary"), F.xxhash64("content")).alias("content"))
    try:
        bounded(rows).mapInArrow(_stage(root, job), "path string, staged string, size long").write.mode("overwrite").parquet(f"{root}/_staging/{job}/manifest")
    except Exception:
        if files.get_file_info(f"{base}/_staging/{job}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/_staging/{job}")
        raise
    files.create_dir(f"{base}/_commits", recursive=True)
    with files.open_output_stream(f"{base}/_commits/{job}") as out:
        out.write(b"good")
    return _finish(spark, root, job)


def read(names: DataFrame, root: str, content: bool = True) -> DataFrame:
    """(path, length, content) of the objects below a folder that rows (path) name, each read by the task that has its name, its content null where that isn't
    wanted; a name without an object has no row. Nothing is listed, so the driver knows no file."""
    root = root.rstrip("/")

    def run(batches):
        files, base = filesystem(root)
        for batch in batches:
            paths, rows, held = [p for p in batch.column("path").to_pylist() if p is not None], [], 0
            for a in range(0, len(paths), READ):
                some = paths[a : a + READ]
                at = [f"{base}/{inside(p)}" for p in some]
                for path, place, info in zip(some, at, tried(lambda at=at: files.get_file_info(at)), strict=True):
                    if info.type != fs.FileType.File:
                        continue
                    body = tried(lambda place=place: _content(files, place)) if content else None
                    rows.append((path, info.size, body))
                    held += len(body or b"")
                    if held >= BATCH_BYTES:
                        yield _rows(rows)
                        rows, held = [], 0
            if rows:
                yield _rows(rows)

    return names.select("path").mapInArrow(run, "path string, length long, content binary")


def _content(files: fs.FileSystem, place: str) -> bytes:
    with files.open_input_stream(place) as source:
        return source.read()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    path, length, content = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(length, pa.int64()), pa.array(content, pa.binary())], ["path", "length", "content"])


def recover(spark: SparkSession, root: str) -> dict[str, int]:
    """Ends the jobs of a writer that was lost, while none is writing: {finished, deleted}."""
    root = root.rstrip("/")
    files, base = filesystem(root)
    out = {"finished": 0, "deleted": 0}
    names = lambda folder: [f.base_name for f in files.get_file_info(fs.FileSelector(f"{base}/{folder}", allow_not_found=True))]
    good = set(names("_commits"))
    for job in names("_staging"):
        if job in good:
            _finish(spark, root, job)
            out["finished"] += 1
        else:
            files.delete_dir(f"{base}/_staging/{job}")
            out["deleted"] += 1
    for job in good - set(names("_staging")):  # moved and deleted, but for its record
        if files.get_file_info(f"{base}/_commits/{job}").type == fs.FileType.File:
            files.delete_file(f"{base}/_commits/{job}")
    return out


def stream(objects: DataFrame, root: str, checkpoint: str, once: bool = True):
    """A stream of (path, content) written batch by batch, each all or none; a batch that runs again is the same job."""
    out = objects.writeStream.foreachBatch(lambda batch, number: write(batch, root, f"batch-{number}") and None).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
