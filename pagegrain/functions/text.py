"""Strings: labels, URLs, markdown, segments, JSON and configuration values."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of image regions in evaluation, and in contexts.
IMAGE_LABELS = ("image", "figure", "chart", "diagram")
CONTEXT_IMAGE_LABELS = ("figure", "diagram", "image", "chart", "graph")
#: Content types by extension.
CONTENT_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".json": "application/json", ".gif": "image/gif", ".svg": "image/svg+xml", ".pdf": "application/pdf"}
#: Parts of keys whose values logs don't show, what they show instead, and parts of lines that an OCR log leaves out.
SENSITIVE = ("password", "secret", "token", "key", "api_key", "access_key", "secret_key", "authorization", "cookie", "session")
REDACTED = "***REDACTED***"
NOISE = ("image:", "other:", "PATCHES", "====", "BASE:", "%|", "torch.Size")


def page_label(filename: Column, page: Column, total: Column) -> Column:
    return F.format_string("%s - Page %d of %d", filename, page, total)


def image_url(base: str, bucket: str, document: Column, page: Column, page_id: Column, fmt: str = "jpeg") -> Column:
    ext = "jpg" if fmt.lower() == "jpeg" else fmt.lower()
    parts = [F.lit(base.rstrip("/")), *([F.lit(bucket)] if bucket else []), document.cast("string"), page.cast("string"), F.lit("image"), F.concat(page_id.cast("string"), F.lit(f".{ext}"))]
    return F.concat_ws("/", *parts)


def parse_files_url(url: Column) -> Column:
    """struct(bucket, path) of ``.../files/{bucket}/{path}``; both null where the form is another."""
    rest = F.regexp_extract(F.trim(url), r"^.*?/files/+([^/]+/.*)$", 1)
    rest = F.regexp_replace(rest, r"/files/.*$", "")
    bucket, path = F.trim(F.regexp_extract(rest, r"^([^/]+)/", 1)), F.regexp_extract(rest, r"^[^/]+/+(.*)$", 1)
    ok = (bucket != "") & (path != "")
    return F.struct(F.when(ok, bucket).alias("bucket"), F.when(ok, path).alias("path"))


def files_url_problem(url: Column) -> Column:
    """Why ``parse_files_url`` has no bucket or path for a url, null where it has both. A null url is one without the mark."""
    plain = F.coalesce(F.trim(url), F.lit(""))
    rest = F.regexp_replace(F.regexp_extract(plain, r"(?s)^.*?/files/(.*)$", 1), r"(?s)/files/.*$", "")
    inner = F.regexp_replace(rest, "^/+", "")
    out = F.when(~F.contains(plain, F.lit("/files/")), "no /files/ in it").when(rest == "", "nothing after /files/").when(~F.contains(inner, F.lit("/")), "no path")
    return out.when(F.trim(F.substring_index(inner, "/", 1)) == "", "no bucket").when(F.regexp_replace(F.regexp_extract(inner, r"(?s)^[^/]*/(.*)$", 1), "^/+", "") == "", "no path")


def object_name(url: Column, bucket: str) -> Column:
    """What follows the bucket in a URL's path, a leading ``files`` left out; null where it isn't there."""
    parts = F.split(F.regexp_replace(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), r"^/+|/+$", ""), "/")
    parts = F.when(F.get(parts, F.lit(0)) == "files", F.slice(parts, 2, 1 << 20)).otherwise(parts)
    at = F.array_position(parts, bucket)
    return F.when((at > 0) & (at < F.size(parts)), F.array_join(F.slice(parts, at.cast("int") + 1, F.size(parts)), "/"))


def slugify(name: Column, default: str = "documents") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9-]+", "-"), "-{2,}", "-")
    return F.coalesce(F.nullif(F.regexp_replace(out, "^-+|-+$", ""), F.lit("")), F.lit(default))


def segments(text: Column) -> Column:
    """Lines of a text, trimmed, without empty ones."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\R")
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def token_display(token: Column) -> Column:
    return F.translate(token, "Ġ▁", "  ")


def token_count(text: Column) -> Column:
    """Words and other marks, one each: a stand-in for a tokenizer's count, never claimed equal to it."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_ \t\n\x0B\f\r])"), 1))


def content_type(name: Column) -> Column:
    """Content type by extension, a general one where unknown."""
    table = F.create_map(*(F.lit(x) for kv in CONTENT_TYPES.items() for x in kv))
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))), F.lit("application/octet-stream"))


def preview(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def replace_numbered(text: Column, urls: Column) -> Column:
    """Embedded figures ``![Figure n](data:image/...)`` with the n-th url, counted from 1; others stay."""
    fold = lambda acc, i: F.regexp_replace(acc, F.concat(F.lit(r"!\[Figure "), i.cast("string"), F.lit(r"\]\(data:image/[^;]+;base64,[^)]+\)")), F.concat(F.lit("![Figure "), i.cast("string"), F.lit("]("), F.regexp_replace(F.element_at(urls, i), r"([\\$])", r"\\$1"), F.lit(")")))
    return F.when(F.size(urls) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(urls))), text, fold)).otherwise(text)


def ensure_figures(content: Column, figures: Column) -> Column:
    """Figure references of a map number -> url linked to their urls; those without a reference appended."""
    content = F.coalesce(content, F.lit(""))
    keys = F.map_keys(figures)
    link = lambda n: F.concat(F.lit("![Figure "), n.cast("string"), F.lit("]("), F.element_at(figures, n), F.lit(")"))
    safe = lambda n: F.regexp_replace(link(n), r"([\\$])", r"\\$1")
    fold = lambda acc, n: F.regexp_replace(acc, F.concat(F.lit(r"!\[Figure 0*"), n.cast("string"), F.lit(r"\](?:\([^)]*\))?")), safe(n))
    updated = F.aggregate(keys, content, fold)
    missing = F.filter(keys, lambda n: ~F.contains(content, F.concat(F.lit("![Figure "), n.cast("string"), F.lit("]"))))
    added = F.array_join(F.transform(missing, link), "\n")
    base = F.trim(updated)
    return F.when(F.size(keys) == 0, content).otherwise(F.concat_ws("\n\n", F.nullif(base, F.lit("")), F.nullif(added, F.lit(""))))


def local_images(markdown: Column) -> Column:
    """URLs of images that markdown shows from this machine."""
    return F.filter(F.regexp_extract_all(markdown, F.lit(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)"), 1), lambda u: u.rlike("localhost|127\\.0\\.0\\.1"))


def progress_entry(label: Column, current: Column, total: Column) -> Column:
    return F.when(total > 0, F.format_string("%s %d/%d", label, current, total)).otherwise(F.format_string("%s %d", label, current))


def allowed_file(name: Column, mime: Column, extensions: tuple[str, ...], mimes: tuple[str, ...]) -> Column:
    """Extension or content type among the allowed."""
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))
    return F.coalesce(ext.isin(*extensions), F.lit(False)) | F.coalesce(F.lower(mime).isin(*mimes), F.lit(False))


def redact(values: Column, mark: str = REDACTED) -> Column:
    """A map whose values under sensitive keys are hidden."""
    pattern = "|".join(SENSITIVE)
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).rlike(pattern), F.lit(mark)).otherwise(v))


def _hidden(value: object, mark: str) -> object:
    if isinstance(value, dict):
        return {k: mark if any(s in k.lower() for s in SENSITIVE) else _hidden(v, mark) for k, v in value.items()}
    return [_hidden(v, mark) for v in value] if isinstance(value, list) else value


def redact_json(text: Column, mark: str = REDACTED) -> Column:
    """JSON text whose values under sensitive keys, objects and arrays too, are hidden at every depth; what isn't JSON is null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return None if text is None else json.dumps(_hidden(json.loads(text), mark), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return texts.map(one)

    return run(text)


def search_item(json_text: Column) -> Column:
    """A search result from JSON: url, label and score, each null where it is of another type, and the payload's two typed fields."""
    v = F.try_parse_json(json_text)
    typed = lambda path, kind, good: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")).isin(*good), F.try_variant_get(v, path, kind))
    number = ("BIGINT", "DOUBLE", "DECIMAL")
    is_number = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant")).rlike("^(" + "|".join(number) + ")")
    return F.struct(
        typed("$.image_url", "string", ("STRING",)).alias("image_url"),
        typed("$.label", "string", ("STRING",)).alias("label"),
        F.when(is_number("$.score"), F.try_variant_get(v, "$.score", "double")).alias("score"),
        typed("$.payload.filename", "string", ("STRING",)).alias("filename"),
        F.when(is_number("$.payload.pdf_page_index"), F.try_variant_get(v, "$.payload.pdf_page_index", "int")).alias("pdf_page_index"),
    )


def inline_images(markdown: Column, data: Column) -> Column:
    """Markdown whose images of this machine are given by a map of url to data url; a url that the map lacks stays."""
    urls = local_images(markdown)
    return F.aggregate(F.array_distinct(urls), markdown, lambda acc, u: F.replace(acc, F.concat(F.lit("]("), u), F.concat(F.lit("]("), F.coalesce(F.try_element_at(data, u), u))))


def clean_log(text: Column, markers: tuple[str, ...] = NOISE) -> Column:
    """The lines that hold none of the markers."""
    bad = lambda line: F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(line, m))
    return F.regexp_replace(F.array_join(F.filter(F.split(text, "\n"), lambda line: ~bad(line)), "\n"), r"^\s+|\s+$", "")


def percent_text(v: Column) -> Column:
    return F.format_string("%.1f%%", v)


def parse_bool(v: Column) -> Column:
    return F.lower(F.trim(v)).isin("true", "1", "yes", "on")


def parse_list(v: Column) -> Column:
    return F.filter(F.transform(F.split(v, ","), lambda x: F.trim(x)), lambda x: x != "")


def valid_version(v: Column) -> Column:
    return v.rlike(r"^\d+\.\d+\.\d+(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$")
