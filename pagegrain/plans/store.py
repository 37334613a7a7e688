"""Tables of pages that change by small batches: each batch adds a run, the newest run of a page wins, prefixes are merged one at a time.

``root/runs/<id>/<table>`` holds what one batch put in the place of its pages' rows, sorted by the page's hash, and ``touched`` which pages
those are and which tables they were replaced in. ``root/base/<id>/<table>`` holds merged rows of one range of hashes; ranges split as
they grow, so the directory of ranges grows with the tables. ``root/commits/<n>.json`` says which runs and ranges there are: it is written last
and whole, and a reader takes the newest, so all tables change at once or not at all, and what a failed job left is never read.
A batch writes its own rows and its marker and no others; ``compact`` rewrites the rows of the ranges it is asked for.

Reading unites the ranges with the runs that aren't merged into them yet. Rows of a page that a later run touched are left out by one
join with those runs' pages; where there are none, a table is a plain scan. Runs are sorted by hash, so merging a range reads what it needs of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Pages of a range before it is halved when it is merged: some 100 GB where a page has 12,288 vectors of 128 parts.
RANGE_PAGES = 1 << 14
PART = "touched"


class Conflict(RuntimeError):
    """Another writer committed first; nothing of this batch is visible. It may be tried again."""


def _hash(key: str) -> Column:
    return F.xxhash64(F.col(key).cast("long"))


class Store:
    """``tables``: name to schema; ``keys``: name to its page column where that isn't ``page``."""

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, str], keys: Mapping[str, str]):
        self.spark, self.root, self.tables, self.keys = spark, root.rstrip("/"), dict(tables), dict(keys)

    # markers

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def state(self) -> dict:
        """The newest marker: {n, runs: [{id, seq, tables}], ranges: [{low, high, id, upto, pages}]}."""
        for name in reversed([n for n in self._names("commits") if n.endswith(".json")]):
            fs, p = self._fs(f"{self.root}/commits/{name}")
            stream = fs.open(p)
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            return json.loads(text)
        return {"n": 0, "seq": 0, "runs": [], "ranges": [{"low": LOW, "high": HIGH, "id": None, "upto": 0, "pages": 0}]}

    def _commit(self, state: dict) -> None:
        """Writes the next marker under another name and renames it, which fails where a marker of that number is."""
        state = {**state, "n": state["n"] + 1}
        fs, to = self._fs(f"{self.root}/commits/{state['n']:020d}.json")
        _, temporary = self._fs(f"{self.root}/commits/_{uuid.uuid4().hex}")
        fs.mkdirs(to.getParent())
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if fs.exists(to) or not fs.rename(temporary, to):
            fs.delete(temporary, False)
            raise Conflict(f"marker {state['n']} was written by another writer")

    # reading

    def _schema(self, name: str) -> str:
        return f"{self.tables[name]}, h bigint" if name != PART else "page bigint, h bigint"

    def _scan(self, name: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self._schema(name)).parquet(*paths)

    @staticmethod
    def _open(ranges: Iterable[dict], seq: int) -> Column | None:
        """Whether a hash lies in a range that a run isn't merged into; None where that's everywhere. Neighbouring ranges make one condition."""
        spans: list[list[int]] = []
        for r in ranges:
            if r["upto"] < seq:
                if spans and spans[-1][1] + 1 == r["low"]:
                    spans[-1][1] = r["high"]
                else:
                    spans.append([r["low"], r["high"]])
        if spans == [[LOW, HIGH]]:
            return None
        return reduce(lambda a, b: a | b, (F.col("h").between(a, b) for a, b in spans), F.lit(False))

    def _snapshot(self, name: str, state: dict, span: tuple[int, int] = (LOW, HIGH)) -> DataFrame:
        """The rows of a table whose hash, ``h``, lies in a span."""
        ranges = [r for r in state["ranges"] if r["low"] <= span[1] and r["high"] >= span[0]]
        within = None if span == (LOW, HIGH) else F.col("h").between(*span)
        limited = lambda df: df if within is None else df.where(within)
        parts, touched = [], []
        if paths := [f"{self.root}/base/{r['id']}/{name}" for r in ranges if r["id"]]:
            parts.append(limited(self._scan(name, paths)).withColumn("_seq", F.lit(0)))
        for run in state["runs"]:
            still = self._open(state["ranges"], run["seq"])
            if name in run["tables"]:
                for which, to in ((name, parts), (PART, touched)):
                    got = limited(self._scan(which, [f"{self.root}/runs/{run['id']}/{which}"]))
                    to.append((got if still is None else got.where(still)).withColumn("_seq", F.lit(run["seq"])))
        if not parts:
            return self.spark.createDataFrame([], self._schema(name))
        rows = reduce(DataFrame.unionByName, parts)
        if not touched:
            return rows.drop("_seq")
        last = reduce(DataFrame.unionByName, touched).groupBy(F.col("page").alias("_page"), F.col("h").alias("_h")).agg(F.max("_seq").alias("_last"))
        rows = rows.join(last, (F.col("h") == F.col("_h")) & (F.col(self.keys.get(name, "page")) == F.col("_page")), "left")
        return rows.where("_last is null or _seq >= _last").drop("_seq", "_page", "_h", "_last")

    def read(self, name: str) -> DataFrame:
        """A table as the newest marker has it."""
        return self._snapshot(name, self.state()).drop("h")

    # writing

    def put(self, rows: Mapping[str, DataFrame], pages: DataFrame) -> str:
        """Puts rows in the place of all that ``pages`` (a column ``page``) have in those tables, at once. Tables not named keep theirs."""
        state, run = self.state(), uuid.uuid4().hex
        whole = {**rows, PART: pages.select(F.col("page").cast("long").alias("page")).where("page is not null").distinct()}
        for name, df in whole.items():
            columns = [c.split()[0] for c in self._schema(name).split(", ")]
            df.withColumn("h", _hash(self.keys.get(name, "page"))).select(*columns).sort("h").write.parquet(f"{self.root}/runs/{run}/{name}")
        seq = state["seq"] + 1
        names = [n for n in self.tables if n in rows]
        self._commit({**state, "seq": seq, "runs": [*state["runs"], {"id": run, "seq": seq, "tables": names}]})
        return run

    def clear(self) -> None:
        """Empties all tables at once. Files go by ``vacuum``."""
        state = self.state()
        self._commit({"n": state["n"], "seq": state["seq"], "runs": [], "ranges": [{"low": LOW, "high": HIGH, "id": None, "upto": state["seq"], "pages": 0}]})

    def compact(self, ranges: Iterable[int] | None = None, most: int = RANGE_PAGES, key_table: str = "points") -> int:
        """Merges all runs into the ranges of these numbers (all, if none are given), one range a commit, and halves those of more than ``most``
        pages. A run that is merged everywhere leaves the marker. Returns the ranges written."""
        state = self.state()
        wanted = [r["low"] for k, r in enumerate(state["ranges"]) if ranges is None or k in set(ranges)]
        written = 0
        for low in wanted:
            state = self.state()
            at = next(k for k, r in enumerate(state["ranges"]) if r["low"] == low)
            old = state["ranges"][at]
            top = max((r["seq"] for r in state["runs"]), default=0)
            if old["upto"] >= top:
                continue
            n = self._snapshot(key_table, state, (old["low"], old["high"])).count()
            pieces = 1 << max(0, (-(-n // most) - 1).bit_length())
            width = (old["high"] - old["low"] + 1) // pieces
            new = []
            for k in range(pieces):
                low_, high_ = old["low"] + k * width, old["low"] + (k + 1) * width - 1
                name = uuid.uuid4().hex
                for t in self.tables:
                    self._snapshot(t, state, (low_, high_)).sort("h").write.parquet(f"{self.root}/base/{name}/{t}")
                new.append({"low": low_, "high": high_, "id": name, "upto": top, "pages": n // pieces})
                written += 1
            merged = [*state["ranges"][:at], *new, *state["ranges"][at + 1 :]]
            least = min(r["upto"] for r in merged)
            self._commit({**state, "ranges": merged, "runs": [r for r in state["runs"] if r["seq"] > least]})
        return written

    def vacuum(self) -> int:
        """Deletes runs, ranges and markers that the newest marker doesn't name; a reader of an older one must be done. Returns how many folders went."""
        state, gone = self.state(), 0
        live = {"runs": {r["id"] for r in state["runs"]}, "base": {r["id"] for r in state["ranges"]}, "commits": {f"{state['n']:020d}.json"}}
        for folder, keep in live.items():
            for name in self._names(folder):
                if name not in keep:
                    fs, p = self._fs(f"{self.root}/{folder}/{name}")
                    gone += bool(fs.delete(p, True))
        return gone
