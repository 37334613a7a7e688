"""A data source of document pages, for batches and streams.

``spark.dataSource.register(PageSource)``, then ``spark.read.format("pages")`` or ``spark.readStream.format("pages")`` with ``path``. Page counting
and rendering are functions that a caller names by import path, since no renderer is part of this package; by default pages are counted from a PDF's page
tree (``pdf.count_pages``) and have no image.

Batch: a partition is a file, or, with ``pagesPerPartition``, a range of a file's pages. Stream: pages are numbered through all files in the order in which
these were found, and an offset is such a number, so a micro-batch has at most ``maxPages`` pages (what is in flight), a file larger than that
spans several, and a restarted query goes on at the page where it was. ``stateLocation`` names the folder of the ledger of files found, which belongs
to the query as its checkpoint does.
"""

from __future__ import annotations

import importlib
import json
import uuid

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .pdf import count_pages


def no_image(data: bytes, first: int, last: int):
    """(page, image) for pages first to last, without images."""
    return ((p, None) for p in range(first, last + 1))


def _named(name: str | None, default):
    if not name:
        return default
    module, _, attribute = name.rpartition(".")
    return getattr(importlib.import_module(module), attribute)


class Pages(InputPartition):
    """Pages first to last of a file; last 0: all. ``total``: its pages, where they are known."""

    def __init__(self, path: str, first: int = 1, last: int = 0, total: int = 0):
        self.path, self.first, self.last, self.total = path, first, last, total


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "path string, page_number int, pdf_page_index int, total_pages int, file_size_bytes bigint, image binary"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStream(self.options)


class _Files:
    """What batch and stream share: listing, counting and rendering."""

    def __init__(self, options):
        self.path, self.batch = options["path"], int(options.get("batchSize", 4))
        self.counter, self.render = options.get("count"), options.get("render")
        self.each = int(options.get("pagesPerPartition", 0))

    def files(self, path: str | None = None):
        path = path or self.path
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def listed(self) -> list:
        files, root = self.files()
        info = files.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            return []
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        return [f for f in sorted(found, key=lambda f: f.path) if f.is_file and (info.is_file or f.path.lower().endswith(".pdf"))]

    def bytes(self, path: str) -> bytes:
        with self.files()[0].open_input_stream(path) as f:
            return f.read()

    def count(self, path: str) -> int:
        return _named(self.counter, count_pages)(self.bytes(path))

    def read(self, partition: Pages):
        """The rows of a range of pages, ``batchSize`` of them rendered at a time."""
        data = self.bytes(partition.path)
        total = partition.total or _named(self.counter, count_pages)(data)
        end = partition.last or total
        for first in range(partition.first, end + 1, self.batch):
            for page, image in _named(self.render, no_image)(data, first, min(first + self.batch - 1, end)):
                yield partition.path, page, page, total, len(data), image


class PageReader(_Files, DataSourceReader):
    """One partition a file, from a listing alone; with ``pagesPerPartition``, files are counted first and a partition is a range."""

    def partitions(self) -> list[Pages]:
        paths = [f.path for f in self.listed()]
        if not self.each:
            return [Pages(p) for p in paths]
        totals = [(p, self.count(p)) for p in paths]
        return [Pages(p, a, min(a + self.each - 1, n), n) for p, n in totals for a in range(1, n + 1, self.each)]


class PageStream(_Files, DataSourceStreamReader):
    """Pages by their number in the ledger. Files are listed at each trigger, and counted no further ahead than the next batch needs."""

    def __init__(self, options):
        super().__init__(options)
        self.state, self.most, self.each = options["stateLocation"].rstrip("/"), int(options.get("maxPages", 64)), self.each or 16
        self.ledger: list[tuple[str, int]] | None = None
        self.granted = self.planned = self.step = 0
        self.asked = False

    def _load(self) -> None:
        if self.ledger is not None:
            return
        files, root = self.files(self.state)
        files.create_dir(root, recursive=True)
        self.ledger = []
        for info in sorted(files.get_file_info(fs.FileSelector(root)), key=lambda f: f.path):
            if info.base_name.endswith(".json") and not info.base_name.startswith("_"):
                with files.open_input_stream(info.path) as f:
                    entry = json.loads(f.read())
                self.ledger += [tuple(x) for x in entry["files"]]
                self.granted, self.step = entry["granted"], self.step + 1

    def _save(self, found: list[tuple[str, int]], granted: int) -> None:
        files, root = self.files(self.state)
        temporary = f"{root}/_{uuid.uuid4().hex}"
        with files.open_output_stream(temporary) as f:
            f.write(json.dumps({"files": found, "granted": granted}).encode())
        files.move(temporary, f"{root}/{self.step:012d}.json")
        self.ledger += found
        self.granted, self.step = granted, self.step + 1

    def initialOffset(self) -> dict:
        return {"pages": 0}

    def latestOffset(self) -> dict:
        """At most ``maxPages`` beyond what was granted before. What was granted is offered again until it was planned, once after a restart."""
        self._load()
        if self.planned < self.granted and not self.asked:
            self.asked = True
            return {"pages": self.granted}
        have, known, found = sum(n for _, n in self.ledger), {p for p, _ in self.ledger}, []
        for f in self.listed():
            if have >= self.granted + self.most:
                break
            if f.path not in known:
                found.append((f.path, self.count(f.path)))
                have += found[-1][1]
        granted = min(have, self.granted + self.most)
        if found or granted > self.granted:
            self._save(found, granted)
            self.asked = False
        return {"pages": self.granted}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self._load()
        self.planned = max(self.planned, end["pages"])
        out, base = [], 0
        for path, n in self.ledger:
            a, b = max(start["pages"], base), min(end["pages"], base + n)
            out += [Pages(path, p - base + 1, min(p + self.each, b) - base, n) for p in range(a, b, self.each)]
            base += n
        return out
