"""Benchmark decontamination with SimHash windows, in DataFrame operations alone.

A benchmark item of m words is compared with the windows of m consecutive words of a document (lower-cased A-Z, split at
ASCII white space); a document of fewer words than the item is one window as a whole. Windows and items get a 64-bit SimHash
of their shingles of five words, each occurrence of one hashed with its number, so that the distance follows the weighted
similarity. Fingerprints are cut into RADIUS + 1 blocks, so two of them within RADIUS bits agree in some block. Pairs
within the radius are then verified by exact weighted Jaccard similarity of the shingles: a document is contaminated by an
item from 0.75 on. At a similarity of 0.75 the expected distance is 11 bits with a deviation of 3; the radius is 23.

Which windows get a fingerprint: a document is read at all windows of an item's length around the item's anchors and nowhere else.
Anchors are those of an item's shingles that fewest items have, so many that the others alone can't make a similarity of 0.75: a window without any
anchor can't reach the threshold. They are found by one join, which a shingle that thousands of items share takes no part in. One anchor in
a window is all that is asked there; whether a window goes on is for the fingerprints: it goes into the index under its item, meets
that item's blocks, and of the windows around anchors those within the radius are verified.

Edge cases: items of fewer than five words have their whole sequence as one shingle; null, empty or blank items
and texts match nothing; repeated rows report once; ties in similarity give the first window; items of any length, and any
number of items of one id, count; null ids are an id like any other; an empty table on either side gives no row. Only the id
and text columns are read, and clashing names can't reach the result. What is broadcast is checked: up to ``MAX_BROADCAST``
bytes; beyond, the joins shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .session import cut

WIDTH = 5
NUM, DEN = 75, 100
RADIUS = 23
#: Bytes of a table that is broadcast at most, about.
MAX_BROADCAST = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\x0c\r"
#: The most shingles that sums of 16 bits can count.
NARROW = (1 << 15) - 1


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once. A column of a projection below may be inlined wherever it is read, in lambdas at each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text; an empty array without one."""
    plain = F.btrim(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_SPACE))
    return let(plain, lambda t: F.when(F.length(t) > 0, F.split(t, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")))


def shingles(ws: Column, width: int) -> Column:
    """Hashes of the runs of ``width`` words, from hashes of the words; none where words are fewer."""

    def runs(hw: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hw) - width)
        return F.when(F.size(hw) >= width, F.transform(at, lambda i: F.xxhash64(*(F.get(hw, i + k) for k in range(width))))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(ws, lambda w: F.xxhash64(w)), runs)


def _numbered(rows: DataFrame, name: str = "hs") -> DataFrame:
    """``hs`` as hashes with their occurrence, so that sets of them are multisets of the shingles."""
    number = lambda s: F.transform(s, lambda h, i: F.when((i > 0) & (h == F.get(s, i - 1)), F.xxhash64(h, i + 1 - F.array_position(s, h))).otherwise(F.xxhash64(h, F.lit(0).cast("long"))))
    return rows.withColumn(name, let(F.sort_array(name), number))


def fingerprint(longest: int, hs: str = "hs") -> Column:
    """The SimHash of ``hs``, ``longest`` at most. A sum holds four counts of 16 bits, or two of 32 where an array may be long."""
    wide = 16 if longest <= NARROW else 32
    lane = sum(1 << a for a in range(0, 64, wide))
    # with half - k / 2 added, a lane's last bit but one says that more than half of the shingles have the bit
    half, tops = (1 << (wide - 2)) - 1, lane << (wide - 2)
    marks = []
    for j in range(wide):
        total = f"aggregate({hs}, 0L, (s, h) -> s + (shiftrightunsigned(h, {j}) & {lane}L))"
        mark = f"({total} + ({half} - size({hs}) DIV 2) * {lane}L) & {tops}L"
        marks.append(f"shiftrightunsigned({mark}, {wide - 2 - j})" if j < wide - 1 else f"shiftleft({mark}, 1)")
    return F.expr(" | ".join(marks))


def _blocks(fp: str = "fp") -> Column:
    """The RADIUS + 1 blocks of a fingerprint as numbers."""
    n = RADIUS + 1
    edges = [64 * i // n for i in range(n + 1)]
    cuts = ", ".join(f"struct({a} AS a, {(1 << (b - a)) - 1} AS m)" for a, b in zip(edges, edges[1:], strict=False))
    return F.expr(f"transform(array({cuts}), e -> CAST(shiftrightunsigned({fp}, e.a) & e.m AS INT))")


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= MAX_BROADCAST else df


def _begins(ps: Column) -> Column:
    """The windows of k that hold one of the places: for each, those that none before it had."""
    n, k = F.col("n"), F.col("k")

    def run(p: Column, i: Column) -> Column:
        low = F.greatest(F.lit(0), p - k + 1, F.when(i > 0, F.get(ps, i - 1) + 1).otherwise(F.lit(0)))
        high = F.least(p, n - F.least("n", "m"))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(ps, run))


def anchors(items: DataFrame) -> DataFrame:
    """(ik, m, width, h): of each item's distinct shingles those that fewest items have, and so many that the others are fewer, repeats
    counted, than a similar window has in common with the item. That is least for the shortest window that can be similar, of 0.75
    of the item's shingles, all of them in the item."""
    each = items.select("ik", "m", "width", F.explode("hs").alias("h")).groupBy("ik", "m", "width", "h").agg(F.count("*").alias("c"))
    shared = each.groupBy("h", "width").agg(F.count("*").alias("items"))
    w = Window.partitionBy("ik").orderBy(F.desc("items"), "h")  # one item's shingles
    ranked = each.join(shared, ["h", "width"]).withColumn("others", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    least = F.ceil(F.lit(NUM) * (F.col("m") - F.col("width") + 1) / DEN)
    return ranked.where(F.col("others") >= least).select("ik", "m", "width", "h")


def starts(docs: DataFrame, items: DataFrame, id_col: str, n_shingles: int, widths: list[int]) -> DataFrame:
    """(id, row, ik, width, k, start): the windows of k shingles with an anchor of the item, each once.

    Only k that a similar window can have count: ``need`` of its shingles would be in the item.
    """
    found, marks = None, cut(anchors(items))
    for w in widths:
        spots = marks.where(F.col("width") == w).select("ik", "m", "h")
        texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, "text").alias("row"), shingles(words(F.col("text")), w).alias("hs"))
        places = texts.select("id", "row", (F.size("hs") + (w - 1)).alias("n"), F.posexplode_outer("hs").alias("p", "h"))  # outer: no filter on the array, which would make it twice
        hits = places.join(_small(spots, 40 * n_shingles), "h").withColumn("k", F.least("n", "m") - (w - 1))
        hits = hits.withColumn("need", F.expr(f"CAST(({NUM} * (k + m - {w - 1}) + {NUM + DEN - 1}) DIV {NUM + DEN} AS INT)")).where("need <= k")
        rows = hits.groupBy("id", "row", "n", "ik", "m", "k").agg(F.collect_set("p").alias("ps"))
        rows = rows.select("id", "row", "ik", F.lit(w).alias("width"), "k", F.explode_outer(let(F.sort_array("ps"), _begins)).alias("start")).where("start is not null")
        found = rows if found is None else found.union(rows)
    return found


def windows(docs: DataFrame, near: DataFrame, id_col: str, widths: list[int]) -> DataFrame:
    """``near`` with the shingles ``hs`` of its windows; texts that hold none are passed over before they are cut into words."""
    wanted = near.select("row").distinct()
    rows = docs.withColumn("row", F.xxhash64(id_col, "text")).select("row", "text").join(_small(wanted, 16 * wanted.count()), "row", "left_semi")
    by = let(words(F.col("text")), lambda ws: F.map_from_arrays(F.array(*map(F.lit, widths)), F.array(*(shingles(ws, w) for w in widths))))
    rows = rows.dropDuplicates(["row"]).select("row", by.alias("by"))
    return near.join(rows, "row").select(*near.columns, F.expr("slice(try_element_at(by, width), start + 1, k)").alias("hs"))


def candidates(near: DataFrame, items: DataFrame, n_items: int) -> DataFrame:
    """(id, row, ik, start) of the windows within RADIUS bits of their item, by the index of blocks, from rows with ``fp``."""
    keys = ["id", "row", "ik", "start"]
    prints = near.select(*keys, "fp", _blocks().alias("blocks")).select("*", F.posexplode("blocks").alias("block", "bits"))
    marks = items.select("ik", F.col("fp").alias("mark"), _blocks().alias("theirs")).select("*", F.posexplode("theirs").alias("block", "bits"))
    pairs = prints.join(_small(marks, 160 * n_items * (RADIUS + 1)), ["ik", "block", "bits"])
    pairs = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("mark"))) <= RADIUS)
    return pairs.where("size(filter(sequence(0, block), i -> get(blocks, i) = get(theirs, i))) = 1").select(*keys)  # once, at the first block in common


def _proof(docs: DataFrame, benchmark: DataFrame, id_col: str, item_col: str) -> DataFrame:
    """(id, row, start, of, similarity): the windows that reach the threshold, with the item they hold."""
    items = benchmark.select(F.col(item_col).alias("item"), words(F.col("text")).alias("ws")).where("size(ws) > 0").distinct()
    items = items.withColumns({"m": F.size("ws"), "width": F.least(F.size("ws"), F.lit(WIDTH)), "ik": F.xxhash64("item", "ws")})
    hs = F.lit(None).cast("array<bigint>")
    for w in range(1, WIDTH + 1):
        hs = F.when(F.col("width") == w, shingles(F.col("ws"), w)).otherwise(hs)
    items = cut(cut(items).withColumn("hs", hs).drop("ws"))
    facts = items.agg(F.sum(F.size("hs")), F.count("*"), F.sort_array(F.collect_set("width")), F.max(F.size("hs"))).first()  # at most five widths
    kinds = (docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString())
    if not facts[1]:
        return docs.sparkSession.createDataFrame([], f"id {kinds[0]}, row long, start int, of {kinds[1]}, similarity double")
    near = cut(starts(docs, items, id_col, facts[0], facts[2]))
    # what later expressions read again is written first: an expression inlined into a lambda is evaluated at each element
    near = cut(_numbered(cut(windows(docs, near, id_col, facts[2]))).withColumn("fp", fingerprint(facts[3])))
    items = cut(_numbered(items).withColumn("fp", fingerprint(facts[3])))
    pairs = candidates(near, items, facts[1])
    near = near.withColumnRenamed("hs", "mine")
    same = near["id"].eqNullSafe(pairs["id"]) & (near["row"] == pairs["row"]) & (near["ik"] == pairs["ik"]) & (near["start"] == pairs["start"])
    proof = near.join(pairs, same, "left_semi").join(_small(items.select("ik", F.col("item").alias("of"), F.col("hs").alias("its")), 8 * facts[0] + 64 * facts[1]), "ik")
    k, both = F.size("mine") + F.size("its"), F.size(F.array_intersect("mine", "its"))
    proof = proof.select("id", "row", "start", "of", k.alias("k"), both.alias("both")).where(F.expr(f"{DEN} * both >= {NUM} * (k - both)"))
    return proof.select("id", "row", "start", "of", (F.col("both") / (F.col("k") - F.col("both"))).alias("similarity")).distinct()


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """One row for each document and item it holds: id, item, similarity, the first best window's start, and the windows that reach the threshold."""
    proof = _proof(docs, benchmark, id_col, item_col)
    out = proof.groupBy("id", "of").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best"), F.count("*").alias("n_windows"))
    return out.select(F.col("id").alias(id_col), F.col("of").alias(item_col), "best.similarity", (-F.col("best.s")).cast("int").alias("start"), "n_windows")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """The documents that hold no item; of rows with one id, or with none, those that hold one alone go."""
    bad = cut(_proof(docs, benchmark, id_col, item_col).select(F.col("id").alias("_bad"), F.col("row").alias("_bad_row")).distinct())
    same = F.col(id_col).eqNullSafe(F.col("_bad")) & (F.xxhash64(id_col, "text") == F.col("_bad_row"))
    return docs.join(_small(bad, 64 * bad.count()), same, "left_anti")
