"""URL filter: explicit rules, and gradient-boosted trees over lexical features for the urls that no rule fits.

The trees learn from urls that a rule labels. Features: lengths, depth, digit ratio, entropy, parameter counts,
hyphens, and suffix statistics, kept in hashed cells of a fixed number: of the host's last one and two labels
and of the first path segment. All urls of one rule have one label, so what they say of a cell is one piece of evidence however
many they are: a cell's statistic is the share of block among the rules seen there, with half a vote on either side, so that
a cell never seen stands at 0.5. The whole host is no cell: it would tell a ruled url's label and nothing of another's. In
training every rule weighs the same within its verdict, and both verdicts the same.
Statistics cover every labelled url; the trees are fit on at most ``MAX_URLS`` distinct ones, those of smallest hash.

Edge cases: a null url, or one without ``://``, has an empty host and path, no rule, and is judged from features
of the empty text; a url none of whose cells any rule was seen in is allowed (score 0.5); repeated urls are judged row by row
alike; without labelled urls, or with one verdict only, the trees are a constant, and at 0.5 or below a url is allowed.
Urls of any length are read whole. Only the id column and url are read, so other columns' names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from . import trees
from .session import bounded

#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MAX_URLS = 20_000
CELLS = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a rule says of a cell counts in full from so many urls on, about; and the weight of no evidence, at 0.5.
ENOUGH, PRIOR = 4, 1.0
N_CELLS = 3


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """host, path, rule and the rule's verdict; the longest rule that fits wins, else both are null."""
    at, to = F.col("host"), F.col("path")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((at == h) | at.endswith("." + h)) & to.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return pages.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))}).withColumns({"rule": name, "ruled": verdict})


def cells(rows: DataFrame) -> DataFrame:
    """Adds the hashed cells c0 to c2: of the host's last label, of its last two, and of the first path segment."""
    labels = F.split("host", r"\.")
    names = (F.element_at(labels, -1), F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)), F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit("")))
    return rows.withColumns({f"c{k}": (F.crc32(F.concat(F.lit(f"{k} "), name).cast("binary")) % CELLS).cast("int") for k, name in enumerate(names)})


def _histogram(texts: pa.Array) -> np.ndarray:
    """Counts of every byte in each text."""
    data, off = K.raw(texts)
    n = len(off) - 1
    at = np.repeat(np.arange(n), np.diff(off)) * 256 + data[off[0] : off[-1]]
    return np.bincount(at, minlength=256 * n).reshape(n, 256)


def features(rows: pa.RecordBatch, statistics: np.ndarray) -> np.ndarray:
    """One row for each of (url, host, path, c0, c1, c2), from bytes counted for a whole batch at once."""
    url, host, path = (rows.column(c).fill_null("") for c in ("url", "host", "path"))
    out = np.zeros((rows.num_rows, 16 + N_CELLS), np.float32)
    for a in range(0, rows.num_rows, 1024):
        u, h, p = (_histogram(x.slice(a, 1024)) for x in (url, host, path))
        size, of = u.sum(axis=1), np.maximum(1, u.sum(axis=1))
        share = u / of[:, None]
        entropy = -(share * np.log2(np.where(u > 0, share, 1))).sum(axis=1)
        digits, q = u[:, 48:58].sum(axis=1), u[:, ord("?")]
        ends = np.array(pc.ends_with(path.slice(a, 1024), "/").to_numpy(zero_copy_only=False), float)
        secure = np.array(pc.starts_with(url.slice(a, 1024), "https").to_numpy(zero_copy_only=False), float)
        out[a : a + 1024, :16] = np.stack((
            size, h.sum(axis=1), p.sum(axis=1), h[:, ord(".")], p[:, ord("/")], digits / of, digits, entropy, u[:, ord("=")], u[:, ord("&")] + q,
            size - h.sum(axis=1) - p.sum(axis=1), h[:, ord("-")], p[:, ord("-")] + p[:, ord("_")], secure, u[:, ord("#")] > 0, ends,
        ), axis=1)
    for k in range(N_CELLS):
        out[:, 16 + k] = statistics[0][rows.column(f"c{k}").to_numpy()]
    return out


def statistics(labelled: DataFrame) -> np.ndarray:
    """For every cell the share of block among the rules seen there, and how many they are, from rows of (rule, y, c0, c1, c2)."""
    seen = labelled.select("rule", "y", F.explode(F.array(*(f"c{k}" for k in range(N_CELLS)))).alias("cell")).groupBy("rule", "y", "cell").count()
    block, every = np.zeros(CELLS), np.zeros(CELLS)
    for r in seen.collect():  # at most CELLS rows a rule
        vote = r["count"] / (r["count"] + ENOUGH)
        block[r["cell"]] += vote * r["y"]
        every[r["cell"]] += vote
    return np.stack(((block + PRIOR / 2) / (every + PRIOR), every))


def fit(labelled: DataFrame, max_urls: int = MAX_URLS) -> tuple[trees.Forest, np.ndarray]:
    """From rows of (url, host, path, rule, y, c0, c1, c2): the forest and the statistics it reads."""
    known = statistics(labelled)
    sample = labelled.distinct().withColumn("order", F.xxhash64("url")).orderBy("order", "url").limit(max_urls).drop("order").toArrow().combine_chunks()
    y = sample.column("y").to_numpy().astype(float)
    if not len(y):
        return trees.fit(np.zeros((0, 16 + N_CELLS)), y), known
    _, rule, n = np.unique(sample.column("rule").to_numpy(zero_copy_only=False).astype(str), return_inverse=True, return_counts=True)
    weight = 1 / n[rule]
    for verdict in (0, 1):
        weight[y == verdict] *= len(y) / 2 / max(weight[y == verdict].sum(), 1e-9)
    return trees.fit(features(sample.to_batches()[0], known), y, trees=30, depth=2, weight=weight), known


def _judge(model):
    def run(batches):
        forest, known = model.value
        for batch in batches:
            todo = np.flatnonzero(batch.column("ruled").is_null().to_numpy(zero_copy_only=False))
            score = np.full(batch.num_rows, np.nan)
            if len(todo):
                rows = batch.take(pa.array(todo))
                score[todo] = forest.predict(features(rows, known))
                score[todo[sum(known[1][rows.column(f"c{k}").to_numpy()] for k in range(N_CELLS)) == 0]] = 0.5
            kept = [i for i, name in enumerate(batch.schema.names) if name not in ("c0", "c1", "c2")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(score, mask=np.isnan(score))], [*(batch.schema.names[i] for i in kept), "block_score"])

    return run


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_urls: int = MAX_URLS, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns, url, host, path, rule, verdict and block_score (null where a rule decides) of every page."""
    rows = ruled(bounded(pages).select(*keep, "url"), rules)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = cells(rows)
    labelled = rows.where(F.col("ruled").isNotNull()).select("url", "host", "path", "rule", (F.col("ruled") == "block").cast("int").alias("y"), "c0", "c1", "c2")
    model = pages.sparkSession.sparkContext.broadcast(fit(labelled, max_urls))  # 30 trees and two rows of CELLS numbers
    out = rows.mapInArrow(_judge(model), f"{schema}, block_score double")
    return out.withColumn("verdict", F.coalesce("ruled", F.when(F.col("block_score") > 0.5, "block").otherwise("allow"))).drop("ruled")


def held_out_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_urls: int = MAX_URLS) -> dict[str, tuple[int, int]]:
    """For each rule: its urls, and how many of them the trees judge like the rule when fit without it."""
    rows = cells(ruled(pages.select("url"), rules)).where(F.col("ruled").isNotNull())
    labelled = rows.select("url", "host", "path", "rule", (F.col("ruled") == "block").cast("int").alias("y"), "c0", "c1", "c2")
    out = {}
    for verdict, h, p in rules:  # a handful
        model = pages.sparkSession.sparkContext.broadcast(fit(labelled.where(F.col("rule") != h + p), max_urls))
        mine = rows.where(F.col("rule") == h + p).select("url", "host", "path", "c0", "c1", "c2", F.lit(None).cast("string").alias("ruled"))
        judged = mine.mapInArrow(_judge(model), "url string, host string, path string, ruled string, block_score double")
        n, right = judged.agg(F.count("*"), F.count_if((F.col("block_score") > 0.5) == F.lit(verdict == "block"))).first()
        out[h + p] = (n, right)
    return out
