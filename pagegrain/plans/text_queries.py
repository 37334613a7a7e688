"""Text functions over the tables' own texts, each with its SQL; long results as their MD5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grounding as O
from ..functions import text as T
from ..sources import tables as D
from .document_queries import _docs
from .registry import query


def _text():
    return F.coalesce(F.col("text"), F.lit(""))


_TEXT = "coalesce(text, '')"


@query("text_lists", f"SELECT doc_id, len(l)::INT AS n, md5(array_to_string(l, '|')) AS items FROM (SELECT doc_id, list_filter(list_transform(string_split({_TEXT}, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)")
def text_lists(spark, d):
    items = T.parse_list(_text())
    return _docs(spark, d).select("doc_id", items.alias("l")).select("doc_id", F.size("l").alias("n"), F.md5(F.array_join("l", "|").cast("binary")).alias("items"))


@query("text_without_lines", f"SELECT doc_id, md5(regexp_replace(array_to_string(list_filter(string_split({_TEXT}, chr(10)), lambda x: NOT contains(x, 'the ') AND NOT contains(x, 'que')), chr(10)), '^\\s+|\\s+$', '', 'g')) AS kept FROM documents")
def text_without_lines(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.clean_log(_text(), ("the ", "que")).cast("binary")).alias("kept"))


@query("text_figures", f"SELECT doc_id, md5(replace({_TEXT}, '. ', concat('. ', chr(10), chr(10), '![Figure 1](data:image/png;base64,', lang, ')', chr(10), chr(10), ' '))) AS markdown FROM documents")
def text_figures(spark, d):
    marked = F.replace(_text(), F.lit(". "), F.lit(". **[Figure 1]** "))
    return _docs(spark, d).select("doc_id", F.md5(O.embed(marked, F.array("lang")).cast("binary")).alias("markdown"))


_LINE = "replace(coalesce(text, ''), chr(10), ' ![Figure 01](old) ')"
_LINK = "concat('![Figure 1](', source, ')')"


@query("text_links", f"SELECT doc_id, md5(CASE WHEN contains(coalesce(text, ''), chr(10)) THEN concat(trim(replace({_LINE}, '![Figure 01](old)', {_LINK})), chr(10), chr(10), {_LINK}) ELSE concat_ws(chr(10) || chr(10), nullif(trim(coalesce(text, '')), ''), {_LINK}) END) AS content FROM documents")
def text_links(spark, d):
    content = F.replace(_text(), F.lit("\n"), F.lit(" ![Figure 01](old) "))
    figures = F.create_map(F.lit(1), F.col("source"))
    return _docs(spark, d).select("doc_id", F.md5(T.ensure_figures(content, figures).cast("binary")).alias("content"))


@query("event_redaction", """SELECT event_id, concat('{"', event_type, '":', user_id, ',"in":[{"', event_type, '_token":"***REDACTED***","props":', replace(props, ' ', ''), '}]}') AS text FROM events""")
def event_redaction(spark, d):
    text = F.concat(F.lit('{"'), "event_type", F.lit('": '), F.col("user_id").cast("string"), F.lit(', "in": [{"'), "event_type", F.lit('_token": '), "props", F.lit(', "props": '), "props", F.lit("}]}"))
    return D.read(spark, d, "events").select("event_id", T.redact_json(text).alias("text"))
