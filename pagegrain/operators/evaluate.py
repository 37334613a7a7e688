"""Localisation metrics, hit rates, token savings and their roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T

HIT_LEVELS = (0.25, 0.5, 0.7)


def localise(truth: DataFrame, predicted: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, gt_ord, best_iou): the best predicted IoU of each true box, 0 without a prediction."""
    p = predicted.select(key, *(F.col(c).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")))
    pairs = truth.join(p, key, "left").withColumn("iou", F.coalesce(G.iou(G.box(), G.box("p_")), F.lit(0.0)))
    return pairs.groupBy(key, "gt_ord").agg(F.max("iou").alias("best_iou"))


def sample_metrics(best: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, mean_iou, iou_at_0_5, n_gt)."""
    return best.groupBy(key).agg(F.avg("best_iou").alias("mean_iou"), F.avg((F.col("best_iou") >= 0.5).cast("double")).alias("iou_at_0_5"), F.count("*").alias("n_gt"))


def summarise(metrics: DataFrame) -> DataFrame:
    """Means over samples, zeros without any."""
    return metrics.agg(F.coalesce(F.avg("mean_iou"), F.lit(0.0)).alias("mean_iou"), F.coalesce(F.avg("iou_at_0_5"), F.lit(0.0)).alias("iou_at_0_5"), F.count("*").alias("n"))


def succeeded(results: DataFrame) -> DataFrame:
    """The samples that didn't fail: those that aggregates count."""
    return results.where(~F.coalesce(F.col("failed"), F.lit(False)))


#: The page that centres are a share of.
PAGE_WIDTH, PAGE_HEIGHT = 2480, 3508


def sample_features(samples: DataFrame) -> DataFrame:
    """Features of each sample's first true box, of rows with failed, gt_boxes, pred_boxes (arrays of four numbers) and two token counts.

    Samples that failed, have no true box, or one without width or height, are left out.
    """
    gt = F.get("gt_boxes", F.lit(0))
    found = G.shape(tuple(F.get(gt, F.lit(k)).cast("double") for k in range(4)), PAGE_WIDTH, PAGE_HEIGHT)
    size = lambda b: (F.get(b, F.lit(2)) - F.get(b, F.lit(0))) * (F.get(b, F.lit(3)) - F.get(b, F.lit(1)))
    predicted = F.aggregate(F.coalesce("pred_boxes", F.array().cast("array<array<double>>")), F.lit(0.0), lambda s, b: s + size(b).cast("double"))
    rows = succeeded(samples).withColumns(found).where("area is not null")
    rows = rows.withColumns({"n_pred": F.coalesce(F.size("pred_boxes"), F.lit(0)), "pred_area": predicted, "log_area": F.log10(F.col("area") + 1)})
    saving = G.percent_saving(F.col("tokens_selected"), F.col("tokens_all_ocr"))
    return rows.withColumns({"area_ratio": F.col("pred_area") / F.col("area"), "token_savings_pct": saving}).drop("gt_boxes", "pred_boxes", "failed")


def hit_rates(metrics: DataFrame, levels: tuple[float, ...] = HIT_LEVELS) -> DataFrame:
    """Counts and rates of samples whose mean IoU reaches each level."""
    n = F.count("*")
    out = [n.alias("n")]
    for level in levels:
        name, hits = f"{level:g}".replace(".", "_"), F.count_if(F.col("mean_iou") >= level)
        out += [hits.alias(f"hits_{name}"), F.coalesce(hits / F.nullif(n, F.lit(0)), F.lit(0.0)).alias(f"rate_{name}")]
    return metrics.agg(*out)


def by_category(metrics: DataFrame, detection: DataFrame | None = None, category: str = "category", key: str = "sample_id") -> DataFrame:
    """One row a category and a TOTAL: samples, mean IoU, three hit rates, and those of detection where given."""
    rows = metrics
    if detection is not None:
        rows = rows.join(detection.select(key, F.col("mean_iou").alias("det_iou"), F.col("iou_at_0_5").alias("det_at_0_5")), key, "left")
    else:
        rows = rows.withColumns({"det_iou": F.lit(None).cast("double"), "det_at_0_5": F.lit(None).cast("double")})
    rate = lambda level: F.avg((F.col("mean_iou") >= level).cast("double"))
    out = rows.rollup(category).agg(F.grouping_id().alias("_g"), F.count("*").alias("n"), F.avg("mean_iou").alias("mean_iou"), rate(0.25).alias("at_0_25"), rate(0.5).alias("at_0_5"), rate(0.7).alias("at_0_7"), F.avg("det_iou").alias("det_iou"), F.avg("det_at_0_5").alias("det_at_0_5"))
    return out.withColumn(category, F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col(category))).drop("_g")


def region_tokens(label, content, box: G.Box):
    """Tokens of a region: its image's for image labels, else its text's."""
    image = F.coalesce(F.lower(label).isin(*T.IMAGE_LABELS), F.lit(False))
    return F.when(image, G.image_tokens(F.abs(box[2] - box[0]), F.abs(box[3] - box[1]))).otherwise(T.token_count(content))


def token_stats(regions: DataFrame, width, height, key: str = "sample_id") -> DataFrame:
    """Five counters of each sample from regions with label, content, box and ``selected``."""
    rows = regions.withColumn("_t", region_tokens(F.col("label"), F.col("content"), G.box()))
    image = F.coalesce(F.lower("label").isin(*T.IMAGE_LABELS), F.lit(False))
    size = lambda v: v if not isinstance(v, int) else F.lit(v)
    return rows.groupBy(key).agg(
        F.coalesce(F.sum(F.when(F.col("selected"), F.col("_t"))), F.lit(0)).alias("tokens_selected"),
        F.sum("_t").alias("tokens_all_ocr"),
        F.max(G.image_tokens(size(width), size(height))).alias("tokens_full_image"),
        F.count_if(F.col("selected") & image).alias("image_regions_selected"),
        F.count_if(image).alias("image_regions_all"),
    )


def token_savings(stats: DataFrame) -> DataFrame:
    """Totals and savings in percent against both baselines; N/A where a baseline is 0."""
    sums = stats.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_selected", "tokens_all_ocr", "tokens_full_image")))
    text = lambda base: F.when(F.col(base) > 0, T.percent_text(G.percent_saving(F.col("tokens_selected"), F.col(base)))).otherwise(F.lit("N/A"))
    return sums.withColumns({"savings_vs_ocr": text("tokens_all_ocr"), "savings_vs_image": text("tokens_full_image")})


def sweep(samples: DataFrame, parameters: DataFrame) -> DataFrame:
    """Every sample under every parameter row; parameters are few (a grid), so they are broadcast behind a check."""
    few = len(parameters.limit(4097).collect()) <= 4096
    return samples.crossJoin(F.broadcast(parameters) if few else parameters)
