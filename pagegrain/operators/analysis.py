"""Error analysis: correlations, category and quartile statistics, consistency, variance, heatmap bounds, sampling."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import cut


def correlations(rows: DataFrame, target: str, features: dict[str, Column]) -> DataFrame:
    """(feature, n, r) by Pearson for each feature, in one pass."""
    named = rows.select(F.col(target).alias("_y"), *(c.alias(k) for k, c in features.items()))
    one = named.agg(F.count("*").alias("n"), *(F.corr(k, "_y").alias(k) for k in features))
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).alias("r")) for k in features)))
    return one.select("n", pairs.alias("p")).select("p.feature", "n", "p.r")


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def p_value(r: float | None, n: int) -> float | None:
    """Two-sided p of a Pearson correlation, from the regularised incomplete beta function."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    a, b, x = (n - 2) / 2, 0.5, 1 - r * r
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) if 0 < x < 1 else 0.0
    if x == 1:
        return 1.0
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def with_p(found: DataFrame) -> DataFrame:
    """Adds p to a correlation table (a row a feature)."""
    rows = [(r["feature"], r["n"], r["r"], p_value(r["r"], r["n"])) for r in found.collect()]
    return found.sparkSession.createDataFrame(rows, "feature string, n long, r double, p double")


def category_stats(rows: DataFrame, category: str, target: str, others: tuple[str, ...]) -> DataFrame:
    """Count, mean and population deviation of the target, and means of other columns, by category."""
    return rows.groupBy(category).agg(F.count("*").alias("n"), F.avg(target).alias("mean"), F.stddev_pop(target).alias("std"), *(F.avg(c).alias(f"mean_{c}") for c in others))


#: Values of a column that one task may hold.
HELD = 1 << 20


def quantiles(rows: DataFrame, by: str, shares: tuple[float, ...], held: int | None = None) -> list[float | None]:
    """Exact quantiles, linear between ranks, of a column of any length; nulls don't count.

    Each pass brackets a rank between two approximate quantiles and counts what lies below, until few enough distinct values are left
    between them to be held; a pass narrows a bracket some thousandfold.
    """
    held = HELD if held is None else held
    values = rows.select(F.col(by).cast("double").alias("v")).where("v is not null")
    n = values.count()
    if n <= held:
        return values.agg(F.percentile("v", [float(s) for s in shares])).first()[0] if n else [None] * len(shares)
    wanted = sorted({k for s in shares for k in (math.floor(s * (n - 1)), math.ceil(s * (n - 1)))})
    found = {k: _ranked(values, n, k, held) for k in wanted}
    out = []
    for s in shares:
        low, at = math.floor(s * (n - 1)), s * (n - 1)
        a, b = found[low], found[math.ceil(at)]
        out.append(a + (b - a) * (at - low))
    return out


def _ranked(values: DataFrame, n: int, rank: int, held: int) -> float:
    """The value of a rank, counted from 0."""
    low, high, below, size = None, None, 0, n
    while True:
        part = values if low is None else values.where((F.col("v") >= low) & (F.col("v") <= high))
        if low is not None and low == high:
            return low
        if size <= held:
            for r in part.groupBy("v").count().orderBy("v").collect():  # ``held`` rows at most
                below += r["count"]
                if below > rank:
                    return r["v"]
        share = (rank - below) / max(1, size - 1)
        a, b = part.agg(F.percentile_approx("v", [max(0.0, share - 1e-3), min(1.0, share + 1e-3)], 10_000)).first()[0]
        less, inside = part.agg(F.count_if(F.col("v") < a), F.count_if((F.col("v") >= a) & (F.col("v") <= b))).first()
        while not below + less <= rank < below + less + inside:  # the approximation missed: take the rest on that side
            ends = part.agg(F.min("v"), F.max("v")).first()
            a, b = (ends[0], a) if rank < below + less else (b, ends[1])
            less, inside = part.agg(F.count_if(F.col("v") < a), F.count_if((F.col("v") >= a) & (F.col("v") <= b))).first()
        if inside == size and a != b:  # nothing gained: halve the values
            middle = part.agg(F.percentile_approx("v", 0.5)).first()[0]
            left = part.agg(F.count_if(F.col("v") <= middle)).first()[0]
            a, b, less, inside = (a, middle, 0, left) if rank < below + left else (part.where(F.col("v") > middle).agg(F.min("v")).first()[0], b, left, size - left)
        low, high, below, size = a, b, below + less, inside


def quartiles(rows: DataFrame, by: str, target: str) -> DataFrame:
    """(quartile, n, mean, std) of the target within the half-open quartiles of ``by``; cut points are exact."""
    cuts = [F.lit(c) for c in quantiles(rows, by, (0.25, 0.5, 0.75))]
    at, value = rows, F.col(by).cast("double")
    q = F.when(value < cuts[0], 1).when(value < cuts[1], 2).when(value < cuts[2], 3).otherwise(4)
    return at.where(F.col(by).isNotNull()).groupBy(q.alias("quartile")).agg(F.count("*").alias("n"), F.avg(target).alias("mean"), F.stddev_pop(target).alias("std"))


def within_group(rows: DataFrame, group: str, target: str, least: int = 2) -> DataFrame:
    """(group, n, std, range) of groups with enough rows."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.stddev_pop(target).alias("std"), (F.max(target) - F.min(target)).alias("range")).where(F.col("n") >= least)


def variance_parts(rows: DataFrame, group: str, target: str) -> DataFrame:
    """Overall variance, the mean variance within groups of two or more, and what is left between them, not below 0."""
    overall = rows.agg(F.var_pop(target).alias("overall"))
    inside = within_group(rows, group, target).agg(F.coalesce(F.avg(F.col("std") * F.col("std")), F.lit(0.0)).alias("within"))
    return overall.crossJoin(inside).withColumn("between", F.greatest(F.lit(0.0), F.col("overall") - F.col("within")))  # one row each


def extremes(groups: DataFrame, by: str, key: str, n: int = 5) -> DataFrame:
    """The n least and the n most by a column, ties by key."""
    low = groups.orderBy(by, key).limit(n).withColumn("end", F.lit("least"))
    return low.unionByName(groups.orderBy(F.desc(by), key).limit(n).withColumn("end", F.lit("most")))


#: Ranks that an approximate quantile may be off by, as a share of a group, and how far a bracket reaches from its share.
ACCURACY, REACH = 10_000, 4e-4


def group_quantiles(rows: DataFrame, keys: tuple[str, ...], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(keys, q0, q1, ..): exact quantiles of each group, linear between ranks, for groups of any size; nulls don't count, a null key is a key.

    One pass makes a sketch of each group, of bounded size and merged before the shuffle, whose quantiles bracket each rank. A second counts what lies below each
    bracket and what values lie inside, some thousandth of the group; ranks are then found by a running sum over a sort that spills. A group whose
    bracket missed (which the counts tell) is bracketed by its least and greatest value instead.
    """
    spread = [min(1.0, max(0.0, s + d)) for s in shares for d in (-REACH, REACH)]
    values = rows.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    sketch = F.percentile_approx("_v", F.array(*map(F.lit, spread)), F.lit(ACCURACY)).alias("_a")
    stats = values.groupBy(*keys).agg(F.count("*").alias("_n"), sketch, F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    named = stats.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_n", "_a", "_min", "_max")

    def inside(wide: bool, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(values by bracket with their numbers, how many lie below each bracket)."""
        low = [F.col("_min") if wide else F.get("_a", F.lit(2 * i)) for i in range(len(shares))]
        high = [F.col("_max") if wide else F.get("_a", F.lit(2 * i + 1)) for i in range(len(shares))]
        met = values.join(groups, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        marks = F.array(*(F.when(F.col("_v") < a, F.lit(-1)).when(F.col("_v") <= b, F.lit(0)).otherwise(F.lit(1)) for a, b in zip(low, high, strict=True)))
        counted = met.withColumn("_m", marks).groupBy(*keys).agg(F.max("_n").alias("_n"), *(F.count_if(F.get("_m", F.lit(i)) == -1).alias(f"_b{i}") for i in range(len(shares))), *(F.count_if(F.get("_m", F.lit(i)) == 0).alias(f"_i{i}") for i in range(len(shares))))
        held = met.withColumn("_m", marks).select(*keys, "_v", F.explode(F.filter(F.transform("_m", lambda m, i: F.when(m == 0, i)), lambda i: i.isNotNull())).alias("_q"))
        return held.groupBy(*keys, "_q", "_v").agg(F.count("*").alias("_c")), counted

    at = lambda i: F.col("_n").cast("double") * F.lit(float(shares[i])) - F.lit(float(shares[i]))  # noqa: E731  (n - 1) * share
    low_rank, high_rank = (lambda i: F.floor(at(i) + 1e-9)), (lambda i: F.ceil(at(i) - 1e-9))

    def ranked(held: DataFrame, counted: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys, "_q").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = held.withColumn("_to", F.sum("_c").over(w))
        pick = lambda *columns: F.element_at(F.array(*columns), F.col("_q") + 1)
        many = range(len(shares))
        info = counted.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_n", F.array(*(F.col(f"_b{i}") for i in many)).alias("_b"))
        sums = sums.join(info, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        to = F.col("_to") + F.get("_b", F.col("_q"))
        first = to - F.col("_c")
        has = lambda rank: (rank >= first) & (rank < to)
        got = sums.select(*keys, "_q", "_n", F.when(has(pick(*map(low_rank, many))), F.col("_v")).alias("_x"), F.when(has(pick(*map(high_rank, many))), F.col("_v")).alias("_y"))
        got = got.where("_x is not null or _y is not null").groupBy(*keys, "_q").agg(F.max("_x").alias("_x"), F.max("_y").alias("_y"), F.max("_n").alias("_n"))
        share = F.greatest(F.lit(0.0), pick(*map(at, many)) - pick(*map(low_rank, many)))
        got = got.withColumn("_r", F.col("_x") + (F.col("_y") - F.col("_x")) * share)
        return got.groupBy(*keys).agg(*(F.max(F.when(F.col("_q") == i, F.col("_r"))).alias(f"q{i}") for i in many))

    held, counted = inside(False, named)
    sound = reduce(lambda a, b: a & b, ((F.col(f"_b{i}") <= low_rank(i)) & (F.col(f"_b{i}") + F.col(f"_i{i}") > high_rank(i)) for i in range(len(shares))))
    missed = counted.where(~sound).select(*(F.col(k).alias(f"_w{i}") for i, k in enumerate(keys)))
    again = named.join(missed, [F.col(f"_k{i}").eqNullSafe(F.col(f"_w{i}")) for i in range(len(keys))], "left_semi")
    good = held.join(missed, [F.col(k).eqNullSafe(F.col(f"_w{i}")) for i, k in enumerate(keys)], "left_anti")
    return ranked(good, counted).unionByName(ranked(*inside(True, again)))


def heat_bounds(rows: DataFrame, group: str, value: str, strategy: str = "percentile") -> DataFrame:
    """(group, low, high) for a colour scale; an unknown strategy counts as percentile (2 and 98). Groups may be of any size."""
    if strategy == "mad":
        mid = cut(group_quantiles(rows, (group,), value, (0.5,)).select(F.col(group).alias("_g"), F.col("q0").alias("_m")))  # a row a group, read twice
        off = rows.join(mid, F.col(group).eqNullSafe(F.col("_g"))).select(group, F.abs(F.col(value) - F.col("_m")).alias("_d"))
        out = group_quantiles(off, (group,), "_d", (0.5,)).join(mid, F.col(group).eqNullSafe(F.col("_g")))
        return out.select(group, (F.col("_m") - 3 * 1.4826 * F.col("q0")).alias("low"), (F.col("_m") + 3 * 1.4826 * F.col("q0")).alias("high"))
    if strategy == "minmax":
        return rows.groupBy(group).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    if strategy == "zscore":
        return rows.groupBy(group).agg((F.avg(value) - 3 * F.stddev_pop(value)).alias("low"), (F.avg(value) + 3 * F.stddev_pop(value)).alias("high"))
    shares = (0.25, 0.75) if strategy == "robust" else (0.02, 0.98)
    return group_quantiles(rows, (group,), value, shares).select(group, F.col("q0").alias("low"), F.col("q1").alias("high"))


def normalise(rows: DataFrame, value: str, *group: str) -> DataFrame:
    """Adds ``normal``: min-max within the group, 0 where all are equal."""
    w = Window.partitionBy(*group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn("normal", F.when(high > low, (F.col(value) - low) / (high - low)).otherwise(F.lit(0.0)))


def heat(rows: DataFrame, value: str, *group: str) -> DataFrame:
    """Adds ``heat``: the value above 0 over the group's greatest."""
    up = F.greatest(F.col(value), F.lit(0.0))
    return rows.withColumn("heat", up / (F.max(up).over(Window.partitionBy(*group)) + 1e-8))


def stratified(rows: DataFrame, category: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each category, chosen by a hash of key and seed that any engine can compute."""
    mixed = ((F.col(key) + seed) * 2654435761) % 1000003
    w = Window.partitionBy(category).orderBy("_mixed", key)
    return rows.withColumn("_mixed", mixed).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_mixed", "_r")
