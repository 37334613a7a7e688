"""Contexts for a downstream language model: page blocks, citations, region images, de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import CONTEXT_IMAGE_LABELS

#: The texts around a context's labels and pages.
OPENING = 'Based on the search results for "{}", here are the relevant document contents:\n\n**Available Documents:**\n'
ADVICE = "\n\n**Important:** When citing information, use the EXACT document labels shown above.\n\n---\n\n"
BETWEEN_PAGES = "\n\n---\n\n"
#: The name of a text delta, and the heading of the sources.
DELTA, SOURCES = "response.output_text.delta", "\n\n---\n\n**Sources:**\n\n"


def joined(value: Column, order: Column, sep: str) -> Column:
    """Texts of a group in order, as one; the group is one answer's results, a few rows."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda e: e["v"]), sep)


def page_text(markdown: Column, text: Column, raw: Column, regions: Column) -> Column:
    """The first of markdown, text, raw text and the regions' contents that isn't blank; image regions are left out."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    texts = F.filter(F.transform(F.filter(regions, lambda r: ~F.coalesce(F.lower(r["label"]).isin(*CONTEXT_IMAGE_LABELS), F.lit(False))), lambda r: F.coalesce(r["content"], F.lit(""))), lambda x: F.trim(x) != "")
    return F.nullif(F.trim(F.coalesce(some(markdown), some(text), some(raw), some(F.array_join(texts, "\n\n")))), F.lit(""))


def ocr_content(task: Column, markdown: Column, text: Column, raw: Column) -> Column:
    """struct(text, markdown, raw) by task: for markdown its output in both places; else the text, and it stands in where the others are empty."""
    some = lambda c, other: F.trim(F.coalesce(F.nullif(c, F.lit("")), other))
    plain = F.when(task == "markdown", F.trim(F.coalesce(markdown, F.lit("")))).otherwise(F.trim(F.coalesce(text, F.lit(""))))
    return F.struct(plain.alias("text"), F.when(task == "markdown", plain).otherwise(some(markdown, plain)).alias("markdown"), some(raw, plain).alias("raw"))


def sse(results: DataFrame, deltas: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, stream): the event stream of an answer: its start, the items found, the deltas by ``ord``, and the sources as a last delta."""
    frame = lambda json: F.concat(F.lit("data: "), json, F.lit("\n\n"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "image_url"))), lambda x: F.struct(x["label"].alias("label"), x["image_url"].alias("image_url")))
    line = F.format_string("%d. [%s](%s)", F.col("rank"), F.coalesce("label", F.lit("Unknown")), F.coalesce("image_url", F.lit("#")))
    found = results.groupBy(key).agg(items.alias("_items"), joined(line, F.col("rank"), "\n").alias("_cited"))
    kind = lambda event, data: F.to_json(F.struct(F.lit(event).alias("event"), F.struct(data).alias("data")))
    said = deltas.groupBy(key).agg(joined(frame(kind(DELTA, F.col("delta"))), F.col("ord"), "").alias("_said"))
    head = F.coalesce(frame(kind("kb.images", F.col("_items").alias("items"))), F.lit(""))
    tail = F.coalesce(frame(kind(DELTA, F.concat(F.lit(SOURCES), F.col("_cited")).alias("delta"))), F.lit(""))
    both = said.join(found, key, "full")
    return both.select(key, F.concat(F.lit(": stream-start\n\n"), F.when(F.col("_items").isNotNull(), head).otherwise(F.lit("")), F.coalesce("_said", F.lit("")), F.when(F.col("_cited").isNotNull(), tail).otherwise(F.lit(""))).alias("stream"))


def citations(results: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, citations): ``n. [label](url)`` lines by rank."""
    line = F.format_string("%d. [%s](%s)", F.col("rank"), F.coalesce("label", F.lit("Unknown")), F.coalesce("image_url", F.lit("")))
    return results.groupBy(key).agg(joined(line, F.col("rank"), "\n").alias("citations"))


def build(results: DataFrame, query: Column, key: str = "query_id") -> DataFrame:
    """(key, context) from ranked rows with label and page text: the labels, then a block for each page with text; none without one."""
    label = F.coalesce("label", F.lit("Unknown"))
    has = F.col("text").isNotNull() & (F.trim("text") != "")
    out = results.groupBy(key).agg(
        F.first(query).alias("_q"),
        joined(F.format_string("%d. %s", F.col("rank"), label), F.col("rank"), "\n").alias("_labels"),
        joined(F.when(has, F.concat(F.lit("## "), label, F.lit("\n\n"), F.trim("text"))), F.col("rank"), BETWEEN_PAGES).alias("_pages"),
        F.count_if(has).alias("_n"),
    )
    before, after = OPENING.split("{}")
    text = F.concat(F.lit(before), "_q", F.lit(after), "_labels", F.lit(ADVICE), "_pages")
    return out.where("_n > 0").select(key, text.alias("context"))


def region_images(results: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, rank, ord, url): the urls of image regions, their content where no url is set; http and https alone."""
    rows = results.select(key, "rank", F.posexplode("regions").alias("ord", "r"))
    url = F.trim(F.coalesce(F.nullif("r.image_url", F.lit("")), "r.content"))
    return rows.where(F.lower("r.label").isin(*CONTEXT_IMAGE_LABELS)).select(key, "rank", "ord", url.alias("url")).where(F.col("url").rlike("^https?://"))


def image_counts(results: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, n): how many image urls a query's regions have, 0 where none."""
    n = region_images(results, key).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n"))
    return results.select(key).distinct().join(n, F.col(key).eqNullSafe(F.col("_k")), "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def mode(ocr: Column, images: Column, regions: Column) -> Column:
    """What a chat turn shows: ocr_text, ocr_text_and_images, or page_images."""
    return F.when(~ocr, "page_images").when(images & F.exists(F.coalesce(regions, F.array()), lambda r: F.lower(r["label"]).isin(*CONTEXT_IMAGE_LABELS)), "ocr_text_and_images").otherwise("ocr_text")


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def multipage(pages: DataFrame, key: str) -> DataFrame:
    """(key, text): pages' texts under numbered headings, in order."""
    block = F.concat(F.lit("### Page "), F.col("page_number").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return pages.groupBy(key).agg(joined(block, F.col("page_number"), "\n\n---\n\n").alias("text"))
