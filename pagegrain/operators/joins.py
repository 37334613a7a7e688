"""Joins by position, by ordinal and with required matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zipped(rows: DataFrame, columns: dict[str, str], index: str = "ord", check: bool = False) -> DataFrame:
    """Arrays of a row side by side, an element a row, to the shortest one's length; with ``check`` unequal lengths are an error."""
    rest = [c for c in rows.columns if c not in columns]
    least = F.least(*(F.size(c) for c in columns)) if len(columns) > 1 else F.size(next(iter(columns)))
    most = F.greatest(*(F.size(c) for c in columns)) if len(columns) > 1 else least
    n = F.when(least == most, least).otherwise(F.raise_error(F.lit("arrays of unequal lengths")).cast("int")) if check else least
    at = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.struct(i.alias(index), *(F.get(c, i).alias(name) for c, name in columns.items())))
    return rows.where(least > 0).select(*rest, F.inline(at)) if not check else rows.where(most > 0).select(*rest, F.inline(at))


def crop_urls(regions: DataFrame, urls: DataFrame, key: str) -> DataFrame:
    """Regions with the url that their image index points at, in the page's ``urls`` array."""
    return regions.join(urls.select(key, "urls"), key, "left").withColumn("image_url", F.get("urls", F.col("image_index"))).drop("urls")


def required(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Left rows with the right side's value; a key that the right side lacks is an error."""
    found = left.join(right.select(key, value), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.col(key).cast("string"))).cast(dict(right.dtypes)[value])
    return found.withColumn(value, F.coalesce(F.col(value), missing))


def or_zero(left: DataFrame, right: DataFrame, key: str, *values: str) -> DataFrame:
    """Left rows with the right side's values, 0 where it has none."""
    found = left.join(right.select(key, *values), key, "left")
    return found.withColumns({v: F.coalesce(v, F.lit(0)) for v in values})


def missing_figures(figures: Column, content: Column) -> Column:
    """Figure numbers of a map that a text doesn't refer to."""
    shown = F.transform(F.regexp_extract_all(content, F.lit(r"!\[Figure (\d+)\]"), 1), lambda n: n.cast("int"))
    return F.array_except(F.map_keys(figures), shown)


def unique_indices(indices: Column, expected: Column | None = None) -> Column:
    """Indices sorted, once each; another number of them than expected is an error."""
    out = F.array_sort(F.array_distinct(indices))
    return out if expected is None else F.when(F.size(out) == expected, out).otherwise(F.raise_error(F.lit("unexpected number of patch indices")).cast("array<int>"))


def numbered_pages(documents: DataFrame, key: str, order: str, first: int = 1) -> DataFrame:
    """Pages with their running number within a document."""
    from pyspark.sql.window import Window

    return documents.withColumn("page_number", F.row_number().over(Window.partitionBy(key).orderBy(order)) + first - 1)


def page_batches(pages: DataFrame, key: str, size: int, number: str = "page_number") -> DataFrame:
    """Pages with ``batch`` (from 0, of ``size`` pages by their number), ``batch_pages`` of it and ``is_last`` of their document's batches."""
    from pyspark.sql.window import Window

    out = pages.withColumn("batch", F.floor((F.col(number) - 1) / size).cast("int"))
    whole = Window.partitionBy(key)
    return out.withColumns({"batch_pages": F.count("*").over(Window.partitionBy(key, "batch")), "is_last": F.col("batch") == F.max("batch").over(whole)})
