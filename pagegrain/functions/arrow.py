"""Arrow batches between Spark and its Python workers: their size, and numbers rounded in them."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch between Spark and its Python workers.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to BATCH_BYTES unless the session asks for less; the default counts rows alone."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(re.match(r"-?\d+", str(conf.get(name)))[0])
    if not 0 < now <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """Numbers to so many digits, halves away from zero; what a negative number leaves of a zero keeps its sign."""
    y = x * 10.0**digits
    r = np.rint(y)
    tied = np.abs(y - r) == 0.5
    if tied.any():
        r[tied] = np.trunc(y[tied]) + np.sign(y[tied])
    return r / 10.0**digits
