"""Boxes, patch grids, coordinate spaces and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The side an image is fitted into, pixels a token, and the range of normalised coordinates.
MAX_SIDE, PIXELS_PER_TOKEN, NORMALISED = 1568, 750, 999

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(b: Box) -> Column:
    return F.greatest(F.lit(0), b[2] - b[0]) * F.greatest(F.lit(0), b[3] - b[1])


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 without a proper overlap or union."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = (w * h).cast("double")
    union = (area(a) + area(b)).cast("double") - both
    return F.when((w > 0) & (h > 0) & (union > 0), both / union).otherwise(F.lit(0.0))


def patch_box(px: Column, py: Column, pw: Column | float, ph: Column | float) -> Box:
    return px * pw, py * ph, (px + 1) * pw, (py + 1) * ph


def patch_range(b: Box, pw, ph, nx, ny) -> Box:
    """First patch and the one after the last, in x and y, clamped to the grid: (px1, py1, px2, py2)."""
    low = lambda v, size: F.greatest(F.lit(0), (v / size).cast("int"))
    high = lambda v, size, n: F.least(F.lit(n) if isinstance(n, int) else n, F.ceil(v / size).cast("int"))
    return low(b[0], pw), low(b[1], ph), high(b[2], pw, nx), high(b[3], ph, ny)


def to_pixels(v: Column, size: Column | int) -> Column:
    """A coordinate of 0-999 in pixels, cut to an integer."""
    return (v / NORMALISED * size).cast("int")


def image_tokens(w: Column, h: Column) -> Column:
    """Tokens of an image fitted into a square, at least 1."""
    scale = F.least(F.lit(float(MAX_SIDE)) / w, F.lit(float(MAX_SIDE)) / h)
    large = (w > MAX_SIDE) | (h > MAX_SIDE)
    fit = lambda v: F.when(large, (v * scale).cast("int")).otherwise(v.cast("int"))
    return F.greatest(F.lit(1), F.floor(fit(w) * fit(h) / PIXELS_PER_TOKEN).cast("int"))


def estimate_grid(n: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """(nx, ny) whose product holds n patches, from the aspect ratio; the longer side grows."""
    aspect = width / height
    ny = F.greatest(F.lit(1), F.sqrt(n / aspect).cast("int"))
    nx = F.greatest(F.lit(1), F.floor(n / ny).cast("int"))  # a page far taller than wide
    return F.when(aspect > 1, F.ceil(n / ny).cast("int")).otherwise(nx), F.when(aspect > 1, ny).otherwise(F.ceil(n / nx).cast("int"))


def pixel_patch(x: Column, y: Column, pw, ph) -> tuple[Column, Column]:
    """The patch that holds a pixel."""
    return F.floor(x / pw).cast("int"), F.floor(y / ph).cast("int")


def patch_index(px: Column, py: Column, nx: int) -> Column:
    """A patch's place in raster order."""
    return py * nx + px


def index_box(index: Column, nx: int, pw, ph) -> Box:
    """The box of the patch at a place in raster order."""
    return patch_box(index % nx, F.floor(index / nx), pw, ph)


def shape(b: Box, page_width: float, page_height: float) -> dict[str, Column]:
    """Area, aspect, and the centre as a share of the page; null for a box without width or height."""
    w, h = (b[2] - b[0]).cast("double"), (b[3] - b[1]).cast("double")
    ok = (w > 0) & (h > 0)
    return {"area": F.when(ok, w * h), "aspect": F.when(ok, w / h), "center_x": F.when(ok, (b[0] + b[2]) / 2 / page_width), "center_y": F.when(ok, (b[1] + b[3]) / 2 / page_height)}


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def percent_saving(selected: Column, base: Column) -> Column:
    """Percent saved against a base; 0 where the base is 0."""
    return F.when(base > 0, (1 - selected / base) * 100).otherwise(F.lit(0.0))
