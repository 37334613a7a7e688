"""Grounded OCR text: references, coordinates, contents, figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .geometry import to_pixels

#: The reference mark-up.
REFERENCE = r"(?s)<\|ref\|>(.*?)<\|/ref\|><\|det\|>(.*?)<\|/det\|>"
CONTENT = r"(?s)<\|ref\|>([^<]+)<\|/ref\|><\|det\|>.*?<\|/det\|>\s*(.*?)(?=<\|ref\|>|$)"
MARKER = r"<\|[^|]+\|>"
_TRIM = r"^\s+|\s+$"
#: Prompts by task.
PROMPTS = {"markdown": "<image>\n<|grounding|>Convert the document to markdown.", "plain_ocr": "<image>\nFree OCR.", "locate": "<image>\nLocate <|ref|>{}<|/ref|> in the image.", "describe": "<image>\nDescribe this image in detail.", "custom": "<image>\n{}"}


def references(text: Column) -> Column:
    """Array of (ref_ord, full, label, coords), in text order."""
    full, label, coords = (F.regexp_extract_all(text, F.lit(REFERENCE), g) for g in range(3))
    return F.transform(F.arrays_zip(full.alias("full"), label.alias("label"), coords.alias("coords")), lambda r, i: F.struct(i.alias("ref_ord"), r["full"].alias("full"), r["label"].alias("label"), r["coords"].alias("coords")))


def boxes(rows: DataFrame, text: str, width, height) -> DataFrame:
    """One row a box: the other columns, ref_ord, box_ord, label and pixel corners. Malformed coordinates and short boxes give none."""
    rest = [c for c in rows.columns if c != text]
    one = rows.select(*rest, F.inline(references(F.col(text))))
    parsed = F.from_json("coords", "array<array<double>>")
    one = one.select(*rest, "ref_ord", F.trim("label").alias("label"), F.posexplode(parsed).alias("box_ord", "b")).where(F.size("b") >= 4)
    size = lambda k: width if k % 2 == 0 else height
    return one.select(*rest, "ref_ord", "box_ord", "label", *(to_pixels(F.get("b", F.lit(k)), size(k)).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))))


def contents(rows: DataFrame, text: str) -> DataFrame:
    """One row a reference with content: the other columns, label, content and its place among the label's."""
    rest = [c for c in rows.columns if c != text]
    label, content = (F.regexp_extract_all(F.col(text), F.lit(CONTENT), g) for g in (1, 2))
    one = rows.select(*rest, F.posexplode(F.arrays_zip(label.alias("label"), content.alias("content"))).alias("ord", "r"))
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("r.content", _TRIM, ""), MARKER, ""), _TRIM, "")
    one = one.select(*rest, "ord", F.regexp_replace("r.label", _TRIM, "").alias("label"), clean.alias("content")).where("content <> ''")
    return one.withColumn("place", F.row_number().over(Window.partitionBy(*rest, "label").orderBy("ord"))).drop("ord")


def regions(rows: DataFrame, text: str, width, height, key: str) -> DataFrame:
    """Boxes as regions: ordinal and id by page, image index, and the k-th content of the label for its k-th box. A size is a number, or
    the name of a column with the page's own."""
    own = [c for c in (width, height) if isinstance(c, str)]
    found = boxes(rows.select(key, text, *own), text, *(F.col(c) if isinstance(c, str) else c for c in (width, height))).drop(*own)
    page = Window.partitionBy(key).orderBy("ref_ord", "box_ord")
    image = F.lower("label").isin("image", "figure")
    found = found.withColumns({"ord": F.row_number().over(page), "place": F.row_number().over(Window.partitionBy(key, "label").orderBy("ref_ord", "box_ord"))})
    before = F.sum(image.cast("int")).over(page.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("image_index", F.when(image, F.coalesce(before, F.lit(0)).cast("int")))
    found = found.join(contents(rows.select(key, text), text), [key, "label", "place"], "left")
    return found.select(key, "ord", F.format_string("%s#region-%d", F.col(key).cast("string"), "ord").alias("region_id"), "label", "x1", "y1", "x2", "y2", "content", "image_index")


def clean(text: Column, include_images: bool = False, remove_labels: bool = False) -> Column:
    """Text without reference mark-up: image references as numbered figures or nothing, others as their label or nothing."""
    image = r"(?s)<\|ref\|>image<\|/ref\|><\|det\|>.*?<\|/det\|>"
    if include_images:
        parts = F.split(text, image)
        out = F.aggregate(F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), F.lit(""), lambda acc, x: F.when(x["i"] == 0, x["p"]).otherwise(F.concat(acc, F.lit("\n\n**[Figure "), x["i"].cast("string"), F.lit("]**\n\n"), x["p"])))
    else:
        out = F.regexp_replace(text, image, "")
    out = F.regexp_replace(out, REFERENCE, "" if remove_labels else "$1")
    return F.regexp_replace(F.coalesce(out, F.lit("")), _TRIM, "")


def embed(markdown: Column, crops: Column) -> Column:
    """Numbered placeholders with embedded images, given as base64 texts."""
    fold = lambda acc, i: F.replace(acc, F.concat(F.lit("**[Figure "), i.cast("string"), F.lit("]**")), F.concat(F.lit("\n\n![Figure "), i.cast("string"), F.lit("](data:image/png;base64,"), F.element_at(crops, i), F.lit(")\n\n")))
    return F.when(F.size(crops) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(crops))), markdown, fold)).otherwise(markdown)


def prompt(task: Column, custom: Column) -> Column:
    """The prompt of a task; an unknown task, or a custom text that is missing where needed, is an error."""
    out = None
    for name, template in PROMPTS.items():
        value = F.replace(F.lit(template), F.lit("{}"), F.trim(custom)) if "{}" in template else F.lit(template)
        if "{}" in template:
            value = F.when(F.trim(custom) != "", value).otherwise(F.raise_error(F.lit("custom text is required")).cast("string"))
        out = F.when(task == name, value) if out is None else out.when(task == name, value)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown task: "), task)).cast("string"))
