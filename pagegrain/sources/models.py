"""Models as injected functions over Arrow batches: embedding, similarity maps, OCR; with deterministic stand-ins.

An embedder maps a list of texts or images to a list of vector lists; an OCR engine maps images to grounded texts. They are
made once a task by a factory, so a real model loads once. Failures become a row's ``error``, not the task's.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.arrow import bounded

Embedder = Callable[[list], list[list[list[float]]]]


class HashEmbedder:
    """Unit vectors from hashes: one for each word of a text, or for each 64 bytes of an image."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _one(self, part: bytes) -> list[float]:
        v = np.random.default_rng(zlib.crc32(part)).standard_normal(self.dim)
        return (v / np.linalg.norm(v)).tolist()

    def __call__(self, items: list) -> list[list[list[float]]]:
        return [[self._one(p) for p in ([w.encode() for w in x.split()] if isinstance(x, str) else [x[i : i + 64] for i in range(0, len(x), 64)])] for x in items]


class Written:
    """An embedder of texts that are the vectors themselves, as JSON."""

    def __call__(self, items: list) -> list:
        return [json.loads(x) for x in items]


class WrittenText:
    """An OCR engine of such texts: a title with the number of vectors, a text, and a figure."""

    def __call__(self, image: str, task: str) -> str:
        return f"<|ref|>title<|/ref|><|det|>[[0, 0, 999, 99]]<|/det|>\nPage of {len(json.loads(image))}\n<|ref|>text<|/ref|><|det|>[[0, 100, 999, 999]]<|/det|>\n{task} text\n<|ref|>image<|/ref|><|det|>[[0, 0, 99, 99]]<|/det|>"


def _each(model: Callable, items: list) -> list[tuple]:
    """(result, error) of each item: the model gets them all at once, and one by one only where that fails."""
    try:
        out = list(model(items))
        if len(out) == len(items):
            return [(x, None) for x in out]
    except Exception:  # which item it was, the second try tells
        pass
    out = []
    for x in items:
        try:
            out.append((model([x])[0], None))
        except Exception as e:
            out.append((None, str(e)[:500]))
    return out


def embed(rows: DataFrame, column: str, factory: Callable[[], Embedder], key: str, at_once: int = 64) -> DataFrame:
    """(key, idx, vec, error): the vectors of a text or binary column, one a row; a failing row has its error and no vector. The model gets ``at_once`` items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            for a in range(0, len(batch), at_once):
                part, out = batch.iloc[a : a + at_once], []
                for k, (vectors, error) in zip(part[key], _each(model, list(part[column])), strict=True):
                    out += [(k, None, None, error)] if error is not None else [(k, i, v, None) for i, v in enumerate(vectors)]
                yield pd.DataFrame(out, columns=[key, "idx", "vec", "error"]).astype({"idx": "Int32"})

    kind = rows.schema[key].dataType.simpleString()
    return bounded(rows).select(key, column).mapInPandas(run, f"`{key}` {kind}, idx int, vec array<double>, error string")


#: Sizes by mode: the whole image's, a tile's, and whether it is cut into tiles.
MODES = {"Gundam": (1024, 640, True), "Tiny": (512, 512, False), "Small": (640, 640, False), "Base": (1024, 1024, False), "Large": (1280, 1280, False)}


def ocr(rows: DataFrame, column: str, factory: Callable[[], Callable], key: str, task: str = "markdown", mode: str | None = None, at_once: int = 8) -> DataFrame:
    """(key, raw, error): the grounded text of each image. With a mode, the engine gets its three sizes as well; no text is an error.

    An engine with a method ``batch`` gets ``at_once`` images in one call of it, and after a failure one at a time; another gets each image by itself.
    """
    if mode is not None and mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    sizes = () if mode is None else MODES[mode]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = factory()

        many = getattr(engine, "batch", None)

        def read(items: list) -> list:
            out = list(many(items, task, *sizes)) if many else [engine(x, task, *sizes) for x in items]
            if not all(out):
                raise ValueError("no text extracted from image")
            return out

        step = at_once if many else 1
        for batch in batches:
            images = list(batch[column])
            read_ = [r for a in range(0, len(images), step) for r in _each(read, images[a : a + step])]
            found = [(k, *r) for k, r in zip(batch[key], read_, strict=True)]
            yield pd.DataFrame(found, columns=[key, "raw", "error"])

    kind = rows.schema[key].dataType.simpleString()
    return bounded(rows).select(key, column).mapInPandas(run, f"`{key}` {kind}, raw string, error string")
