"""Typed settings with defaults and bounds, upload limits, and overlays of stored values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

#: Name -> (default, least, most).
SETTINGS: dict[str, tuple] = {
    "mean_pooling": (False, None, None), "prefetch_limit": (200, 10, 1000), "search_limit": (10, 1, 100), "binary_quantization": (True, None, None), "quantization_rescore": (True, None, None), "quantization_oversampling": (2.0, 1.0, 5.0), "quantization_ignore": (False, None, None),
    "top_k": (10, 1, 50), "region_retrieval": (False, None, None), "region_threshold": (0.3, 0.0, 1.0), "region_top_k": (0, 0, 50), "region_aggregation": ("iou_weighted", None, None), "batch_size": (4, 1, 16), "batches_in_flight": (1, 1, 8), "upload_max_mb": (10, 1, 200), "upload_max_files": (5, 1, 20),
}
#: File kinds an upload may have.
KINDS = {"pdf": ((".pdf",), ("application/pdf",))}


def coerce(name: str, value: object) -> object:
    """A setting's value in its type and within its bounds; text that doesn't parse gives the default."""
    default, low, high = SETTINGS[name]
    try:
        if isinstance(default, bool):
            value = value if isinstance(value, bool) else str(value).strip().lower() in ("true", "1", "yes", "on")
        else:
            value = type(default)(value)
    except (TypeError, ValueError):
        return default
    return max(low, min(high, value)) if low is not None else value


def resolve(stored: Mapping[str, object]) -> dict[str, object]:
    """Every setting, stored values over defaults; unknown names are left out."""
    return {name: coerce(name, stored[name]) if name in stored else spec[0] for name, spec in SETTINGS.items()}


def changed(before: Mapping[str, object], after: Mapping[str, object]) -> dict[str, object]:
    """The known settings whose values differ."""
    return {k: v for k, v in after.items() if k in SETTINGS and before.get(k) != v}


def workers(cpu: int, concurrency: int = 1) -> int:
    """Writers for so many processors: 4, 6, 10 or 14, and two more for each further concurrent batch, within 4 to 32."""
    base = next((n for most, n in ((4, 4), (8, 6), (16, 10)) if cpu <= most), 14)
    return max(4, min(32, base + 2 * max(0, concurrency - 1)))


def retries(n_workers: int) -> int:
    """Attempts after a failure, by the number of writers."""
    return next((n for least, n in ((24, 5), (16, 4), (8, 3)) if n_workers >= least), 2)


def backoff(attempt: int, jitter: float = 0.0) -> float:
    """Seconds to wait after an attempt, counted from 1: a quarter, doubled each time, and a tenth of ``jitter`` (0 to 1)."""
    return 0.25 * 2 ** (attempt - 1) + 0.1 * jitter


@dataclass(frozen=True)
class Uploads:
    extensions: tuple[str, ...]
    mimes: tuple[str, ...]
    max_files: int
    max_bytes: int


def uploads(kinds: Iterable[str] = ("pdf",), max_mb: object = 10, max_files: object = 5) -> Uploads:
    """Upload limits: known kinds alone, all of them where none is known, sizes within bounds."""
    names = [k for k in dict.fromkeys(x.strip().lower().lstrip(".") for x in kinds) if k in KINDS] or list(KINDS)
    pick = lambda i: tuple(sorted({x for k in names for x in KINDS[k][i]}))
    return Uploads(pick(0), pick(1), coerce("upload_max_files", max_files), coerce("upload_max_mb", max_mb) << 20)


def bucket(path: str, root: str) -> str:
    """A path below a root, or an error where it leads out of it."""
    import posixpath

    out = posixpath.normpath(posixpath.join(root, path.lstrip("/")))
    if out != root.rstrip("/") and not out.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"path leaves {root}: {path}")
    return out
