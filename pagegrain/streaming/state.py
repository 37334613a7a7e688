"""Keyed state with a time to live: batches complete when all their stages are, then their state goes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "batch_key string, n_stages int, n_pages long"


class Completion(StatefulProcessor):
    """Rows (batch_key, stage, num_pages): emits a batch once its stages are complete, and forgets it."""

    def __init__(self, stages: int, ttl_ms: int = 300_000):
        self.stages, self.ttl = stages, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "stages string, pages long", ttlDurationMs=self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.seen.get() if self.seen.exists() else None
        done, pages = (set(filter(None, held[0].split("\x1f"))), held[1]) if held else (set(), 0)
        for batch in rows:
            done |= set(batch["stage"])
            pages = max(pages, int(batch["num_pages"].max()))
        if len(done) >= self.stages:
            self.seen.clear()
            yield pd.DataFrame({"batch_key": [key[0]], "n_stages": [len(done)], "n_pages": [pages]}).astype({"n_stages": "int32"})
        else:
            self.seen.update(("\x1f".join(sorted(done)), pages))
            yield pd.DataFrame({"batch_key": pd.Series([], dtype=str), "n_stages": pd.Series([], dtype="int32"), "n_pages": pd.Series([], dtype="int64")})

    def close(self) -> None:
        pass


def complete(events: DataFrame, stages: int, ttl_ms: int = 300_000) -> DataFrame:
    """Completed batches of a stream of stage events; needs the RocksDB state store."""
    return events.groupBy("batch_key").transformWithStateInPandas(statefulProcessor=Completion(stages, ttl_ms), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime")
