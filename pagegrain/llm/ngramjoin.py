"""N-gram Jaccard join over count-vector R-trees.

Shingles of a text are hashed into ``GROUPS`` groups; the counts by group are a point. For two texts the sum of
coordinate minima bounds their overlap from above, and against a node's upper corner it bounds the overlap with everything
below, so an R-tree over the points finds every possible partner; exact set comparison verifies the survivors.

One R-tree over a whole corpus can't prune (points of unrelated texts of one length lie close together in every box),
so texts are first dealt to trees without loss: of the first n - ceil(3n/4) + k shingles in any one global order, two
linked texts share the lesser k of the two; here k is n/8, so a text with fewer prefix shingles
in common with the whole rest of the corpus has no link. The order is by hash with the shingles found frequent last; frequency only shapes
the order, so how it is estimated can't change the result. Shingles in one text only deal it to no tree at all.

1. one row a document: set size and set key; equal keys are one class, represented once (copies never multiply);
2. prefix shingles shared by two or more classes, and the classes with enough of them;
3. each class follows the first class of most of its shared shingles to a shard, and shards are dealt to blocks of bounded
   size, with one class of the shard in all its blocks; in each block an R-tree join links classes, passing over what
   is connected already;
4. classes of different blocks, not yet connected, with enough shingles in common are joined the same way, in blocks of
   bounded size, and survivors verified; the links' components are the result. Of a shingle's texts those of its largest component
   are split and each part meets the rest alone, so a large group of near copies costs its size and not the square of it.

Edge cases: null, empty or blank text: no shingle, its own component. Fewer words than the width: the whole sequence is
the one shingle. Repeated rows and repeated ids are rows of their own; ids are of any type that has an order; a null id joins
like any other row but never names a component unless alone in it, which then is null. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .components import components
from .session import bounded, cut, partitions, tidy

WIDTH = 5
NUM, DEN = 75, 100
GROUPS = 128
#: Shingles ordered last: those found in the most texts within a task's chunk. A matter of speed alone.
MAX_HOT, HOT_IN_CHUNK, CHUNK = 1 << 16, 4, 1 << 20
#: Shingles in a block's R-tree, about; texts of a shingle compared in one task.
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 22, 1 << 9
#: Rows (16 bytes) of a broadcast at most; beyond, the join shuffles.
MAX_BROADCAST = 1 << 19


def set_key(hashes: np.ndarray) -> int:
    """A hash of a set of hashes."""
    if not len(hashes):
        return 0
    mixed = np.bitwise_xor.reduce(hashes, keepdims=True) * K.COMBINE[5] + K.mix(hashes).sum(dtype=np.uint64, keepdims=True)
    return int(K.mix(mixed + np.uint64(len(hashes))).view(np.int64)[0])


def prefix_length(n: int) -> int:
    """So many that linked texts share at least ``common`` of both sizes' lesser one in both prefixes."""
    return n - -(-NUM * n // DEN) + common(n) if n else 0


def common(n: int) -> int:
    return max(1, n // 8)


def _profile(batches):
    """kind 0: (text hash, set key, size) with the id of every row; kind 1: a chunk's frequent shingles and their texts."""

    def frequent(chunk, id_type):
        values, counts = np.unique(np.concatenate(chunk), return_counts=True)
        hot = np.flatnonzero(counts >= HOT_IN_CHUNK)
        hot = hot[np.argsort(-counts[hot], kind="stable")[:4096]]
        n = len(hot)
        return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int64)), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), pa.array(values[hot].view(np.int64)), pa.array(counts[hot])], names)

    names, chunk, size, seen = ["kind", "id", "th", "key", "n"], [], 0, set()
    for batch in batches:
        keys, ns = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        for i, s in K.shingle_sets(batch.column(2), WIDTH):
            keys[i], ns[i] = set_key(s), len(s)
            if len(s) and keys[i] not in seen:
                seen.add(keys[i])
                chunk.append(s)
                size += len(s)
                if size >= CHUNK:
                    yield frequent(chunk, batch.column(0).type)
                    chunk, size, seen = [], 0, set()
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int64)), batch.column(0), batch.column(1), pa.array(keys), pa.array(ns)], names)
    if chunk:
        yield frequent(chunk, batch.column(0).type)


def _prefixes(hot, bits: int):
    """Rows of (bucket, blob of shingles and set keys). A bucket has a range of shingles; of frequent ones, below 0, a range of (shingle, set key)."""

    def dealt(by, h, k, sign):
        order = np.argsort(by, kind="stable")
        h, k = h[order], k[order]
        cuts = np.searchsorted(by[order], np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        bounds = np.concatenate(([0], cuts, [len(h)]))
        full = np.flatnonzero(np.diff(bounds))
        blobs = [np.concatenate((h[bounds[b] : bounds[b + 1]], k[bounds[b] : bounds[b + 1]].view(np.uint64))).tobytes() for b in full]
        return pa.RecordBatch.from_arrays([pa.array(sign * full - (sign < 0)), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def run(batches):
        values, rank = hot.value

        def flush(hs, ks):
            h, k = np.concatenate(hs), np.repeat(np.array(ks, np.int64), [len(x) for x in hs])
            at = np.searchsorted(values, h)
            is_hot = values[np.minimum(at, len(values) - 1)] == h if len(values) else np.zeros(len(h), bool)
            if is_hot.any():
                yield dealt(K.mix(h[is_hot] ^ k[is_hot].view(np.uint64)), h[is_hot], k[is_hot], -1)
            yield dealt(h[~is_hot], h[~is_hot], k[~is_hot], 1)

        hs, ks, size, seen = [], [], 0, set()
        for batch in batches:
            for _, s in K.shingle_sets(batch.column(0), WIDTH):
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    found = values[at] == s
                    if found.any():
                        s = np.concatenate((s[~found], s[found][np.argsort(rank[at[found]], kind="stable")]))
                hs.append(s[: prefix_length(len(s))])
                ks.append(key)
                size += len(hs[-1])
                if size >= CHUNK:
                    yield from flush(hs, ks)
                    hs, ks, size, seen = [], [], 0, set()
        if hs:
            yield from flush(hs, ks)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """The (shingle, set key) of a bucket whose shingle may have two or more keys."""
    pairs = [np.frombuffer(b.as_buffer(), np.uint64).reshape(2, -1) for b in table.column("blob")]
    h, k = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    order = np.lexsort((k, h))
    h, k = h[order], k[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
    h, k = h[new], k[new]
    hit = np.full(len(h), table.column("bucket")[0].as_py() < 0)  # frequent ones are shared
    same = h[1:] == h[:-1]
    hit[1:] |= same
    hit[:-1] |= same
    return pa.table({"h": h[hit].view(np.int64), "key": k[hit].view(np.int64)})


class RTree:
    """Bulk-loaded over the rows of ``points``, with sizes; nodes of 16. Upper corners alone bound an overlap."""

    FAN = 16

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._pack(points, np.argsort(sizes, kind="stable"))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.place = np.empty(len(points), np.int64)
        self.place[self.order] = np.arange(len(points))
        self.levels = []  # from the leaves up: starts, upper corner, least and greatest size
        hi, lo_n, hi_n = self.points, self.sizes, self.sizes
        while len(hi) > 1 or not self.levels:
            starts = np.arange(0, len(hi), self.FAN)
            hi, lo_n, hi_n = np.maximum.reduceat(hi, starts), np.minimum.reduceat(lo_n, starts), np.maximum.reduceat(hi_n, starts)
            self.levels.append((hi, lo_n, hi_n))
        self.low = self.high = None

    def _pack(self, points: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Halved by size, then by the coordinate that varies most, until a leaf is left."""
        done, todo = [], [(order, 0)]
        while todo:
            part, depth = todo.pop()
            if len(part) <= self.FAN:
                done.append(part)
                continue
            if depth % 3:
                part = part[np.argsort(points[part, points[part].var(axis=0).argmax()], kind="stable")]
            half = self.FAN * -(-len(part) // (2 * self.FAN))
            todo += [(part[half:], depth + 1), (part[:half], depth + 1)]
        return np.concatenate(done)

    def colour(self, colours: np.ndarray) -> None:
        """The least and greatest colour below each node; a query passes over nodes of its own colour alone."""
        low = high = colours[self.order]
        self.low, self.high = [], []
        for _ in self.levels:
            starts = np.arange(0, len(low), self.FAN)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            self.low.append(low)
            self.high.append(high)

    def search(self, point: np.ndarray, size: int, colour: int | None = None) -> np.ndarray:
        """The rows whose overlap with ``point`` may reach the threshold."""
        at = np.zeros(1, np.int64) if len(self.levels[-1][0]) == 1 else np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -2, -1):
            hi, lo_n, hi_n = self.levels[k] if k >= 0 else (self.points, self.sizes, self.sizes)
            fits = (DEN * hi_n[at] >= NUM * size) & (NUM * lo_n[at] <= DEN * size)
            if colour is not None and self.low is not None and k >= 0:
                fits &= (self.low[k][at] != colour) | (self.high[k][at] != colour)
            at = at[fits]
            bound = np.minimum(hi[at], point).sum(axis=1, dtype=np.int64)
            at = at[(DEN + NUM) * bound >= NUM * (size + lo_n[at])]
            if k < 0:
                return self.order[at]
            below = len(self.levels[k - 1][0]) if k > 0 else len(self.points)
            at = (at[:, None] * self.FAN + np.arange(self.FAN)).ravel()
            at = at[at < below]
        return at


def points(sets: list[np.ndarray]) -> np.ndarray:
    shift = np.uint64(64 - (GROUPS.bit_length() - 1))
    return np.stack([np.bincount((s >> shift).astype(np.int64), minlength=GROUPS) for s in sets]).astype(np.int32)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def join_block(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first set of its component, under the links among these sets."""
    m = len(sets)
    colour, members = np.arange(m), [[i] for i in range(m)]
    sizes, at = np.array([len(s) for s in sets]), points(sets)
    tree = RTree(at, sizes)
    for step, q in enumerate(np.argsort(sizes, kind="stable")):
        if m > 64 and step % 64 == 0:
            tree.colour(colour)
        found = tree.search(at[q], int(sizes[q]), int(colour[q]) if m > 64 else None)
        found = found[colour[found] != colour[q]]
        if len(found) > 1:
            found = found[np.argsort(-np.minimum(at[found], at[q]).sum(axis=1), kind="stable")]
        while len(found):
            f, found = found[0], found[1:]
            if linked(sets[q], sets[f]):
                a, b = sorted((int(colour[q]), int(colour[f])), key=lambda c: -len(members[c]))
                colour[members[b]] = a
                members[a] += members[b]
                members[b] = []
                found = found[colour[found] != colour[q]]
    first = np.full(m, m)
    np.minimum.at(first, colour, np.arange(m))
    return first[colour]


def _join_shards(table: pa.Table) -> pa.Table:
    """Links (class, first class of its component) within each shard and block of the bin."""
    shard, block, key = (table.column(c).to_numpy() for c in ("shard", "block", "key"))
    blobs, out = table.column("shingles"), ([], [])
    order = np.lexsort((key, block, shard))
    cuts = np.flatnonzero((np.diff(shard[order]) != 0) | (np.diff(block[order]) != 0)) + 1
    for part in np.split(order, cuts):
        part = part[np.unique(key[part], return_index=True)[1]]
        if len(part) < 2:
            continue
        sets = [np.frombuffer(blobs[int(i)].as_buffer(), np.uint64) for i in part]
        first = join_block(sets)
        moved = np.flatnonzero(first != np.arange(len(part)))
        out[0].append(key[part[moved]])
        out[1].append(key[part[first[moved]]])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    return pa.table({"a": a, "b": b})


def _cross(table: pa.Table) -> pa.Table:
    """Pairs of classes, of different components and blocks, that the bound lets through, for each shingle of the bin."""
    h, left, right, side, key, root, unit, n = (table.column(c).to_numpy() for c in ("h", "left", "right", "side", "key", "root", "unit", "n"))
    blobs, out = table.column("point"), ([], [], [])
    order = np.lexsort((right, left, h))
    cuts = np.flatnonzero((np.diff(h[order]) != 0) | (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)) + 1
    for part in np.split(order, cuts):
        if root[part].min() == root[part].max():
            continue
        at = np.stack([np.frombuffer(blobs[int(i)].as_buffer(), np.int32) for i in part])
        tree = RTree(at, n[part])
        tree.colour(root[part])
        alone = left[part[0]] == right[part[0]]
        ask = np.ones(len(part), bool)
        if not alone:  # the side of fewer texts asks
            ask = side[part] == left[part[0]]
            ask = ask if 2 * ask.sum() <= len(part) else ~ask
        for q in np.flatnonzero(ask):
            i = part[q]
            found = part[tree.search(at[q], int(n[i]), int(root[i]))]
            found = found[(root[found] != root[i]) & (unit[found] != unit[i]) & ((key[found] > key[i]) if alone else (side[found] != side[i]))]
            out[0].append(np.full(len(found), key[i]))
            out[1].append(key[found])
            out[2].append(np.maximum(1, np.minimum(n[found], n[i]) // 8))  # common() of the lesser
    a, b, k = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "k": k})


def _verify(batches):
    for batch in batches:
        ok = [linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok, pa.bool_())), batch.column("b").filter(pa.array(ok, pa.bool_()))], ["a", "b"])


def _sets(batches):
    """Rows of the wanted classes with their points and shingles."""
    for batch in batches:
        want, rows, blobs, places = batch.column("key").to_numpy(), [], [], []
        for i, s in K.shingle_sets(batch.column("text"), WIDTH):
            if set_key(s) == want[i]:
                rows.append(i)
                blobs.append(s.tobytes())
                places.append(points([s])[0].tobytes())
        kept = batch.select(["key", "shard", "block", "n"]).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(places, pa.binary()), pa.array(blobs, pa.binary())], ["key", "shard", "block", "n", "point", "shingles"])


def _by(small: DataFrame) -> DataFrame:
    """``small``, marked for broadcast where its bytes, ids of any type among them, are few."""
    long = [F.sum(F.octet_length(F.col(c).cast("string"))) for c, t in small.dtypes if t not in ("int", "bigint", "boolean", "double")]
    n, *sizes = small.agg(F.count("*"), *long).first()
    return F.broadcast(small) if n * 8 * len(small.columns) + sum(x or 0 for x in sizes) <= MAX_BROADCAST * 16 else small


def classes_and_links(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, n) of every document, and links (a, b) between set keys that span the components."""
    spark = docs.sparkSession
    texts = bounded(docs).select(F.col(id_col).alias("id"), F.xxhash64("text").alias("th"), "text")
    got = cut(texts.mapInArrow(tidy(_profile), f"kind long, id {docs.schema[id_col].dataType.simpleString()}, th long, key long, n long"))
    rows = got.where("kind = 0").drop("kind")
    hot = got.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(MAX_HOT).collect()  # at most MAX_HOT
    values, rank = np.array([r["key"] for r in hot], np.int64).view(np.uint64), np.array([r["n"] for r in hot], np.int64)
    order = np.argsort(values)
    sent = spark.sparkContext.broadcast((values[order], rank[order]))
    total = rows.agg(F.sum("n")).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(4 * partitions(spark), total / 4 / (1 << 20))))))
    dealt = docs.select("text").mapInArrow(tidy(_prefixes(sent, bits)), "bucket long, blob binary")
    dealt = dealt.repartition(max(partitions(spark), (1 << bits) // 4), "bucket")  # by size, so that a task's share doesn't grow
    shared = cut(dealt.groupBy("bucket").applyInArrow(tidy(_shared), "h long, key long"))

    alike = rows.where("n > 0").groupBy("key", "id", "th").agg(F.first("n").alias("n"), F.count("*").alias("copies"))
    one = alike.groupBy("key").agg(F.first("n").alias("n"), F.min(F.struct("id", "th", "copies")).alias("rep"))
    least = F.floor(F.ceil(F.lit(NUM) * F.col("n") / DEN) / 8)  # common() of the smallest partner
    enough = shared.groupBy("key").count().join(one, "key").where(F.col("count") >= F.greatest(F.lit(1), least)).drop("count")
    enough = cut(enough)
    shared = shared.join(enough.select("key"), "key")
    several = shared.groupBy("h").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("h")
    shared = cut(shared.join(several, "h"))

    low = shared.groupBy("h").agg(F.min("key").alias("s"))
    votes = shared.join(low, "h").groupBy("key", "s").agg(F.count("*").alias("n"))
    lead = cut(votes.groupBy("key").agg(F.max_by("s", F.struct("n", F.bitwise_not("s"))).alias("shard")))
    for _ in range(2):  # the leader's leader's
        lead = lead.join(lead.toDF("shard", "next"), "shard").select("key", F.col("next").alias("shard"))
    shard = lead
    live = enough.join(shard, "key")
    # by shingles alone: a group of many short texts is one block, whose tree leaves few pairs; cut into several, its unlinked texts
    # would meet in _cross instead, as many pairs as the square of the group
    weight = live.groupBy("shard").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"), F.min("key").alias("pivot"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x.cast("long"))
    block = F.when(F.col("key") == F.col("pivot"), every).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("blocks"))))
    live = cut(live.join(weight, "shard").select("key", "n", "shard", F.col("rep.id").alias("id"), F.col("rep.th").alias("th"), (F.col("rep.copies") > 1).alias("copied"), F.explode(block).alias("block")))
    if live.isEmpty():
        return rows, spark.createDataFrame([], "a long, b long")
    found = texts.join(_by(live), texts["id"].eqNullSafe(live["id"]) & (texts["th"] == live["th"])).select("text", "key", "shard", "block", "n", "copied")
    if not live.where("copied").isEmpty():  # rows equal in id and text can't be told apart before they meet
        found = found.where("NOT copied").union(found.where("copied").dropDuplicates(["key", "shard", "block"]))
    found = found.drop("copied")
    sets = cut(found.mapInArrow(tidy(_sets), "key long, shard long, block long, n long, point binary, shingles binary"))
    weight = sets.agg(F.sum("n")).first()[0] or 0
    bins = int(max(4 * partitions(spark), weight // BLOCK_SHINGLES))
    local = sets.select("key", "shard", "block", "shingles", F.pmod(F.xxhash64("shard", "block"), F.lit(bins)).alias("bin"))
    local = local.repartition(max(partitions(spark), bins // 4), "bin")
    links = cut(local.groupBy("bin").applyInArrow(tidy(_join_shards), "a long, b long"))

    roots = components(links)
    unit = sets.dropDuplicates(["key"]).select("key", "n", "point", F.xxhash64("shard", "block").alias("unit"))
    at = shared.join(unit.select("key", "unit"), "key").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    at = at.join(unit.select("key", "n"), "key")
    for _ in range(2):  # shingles across components and blocks, then classes with enough of them
        across = at.groupBy("h").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("unit").alias("u0"), F.max("unit").alias("u1")).where("r0 <> r1 and u0 <> u1")
        across = cut(across.select("h"))  # read on its own, so that a join on a frequent shingle can be split
        at = at.join(_by(across), "h")
        full = at.groupBy("key").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= F.greatest(F.lit(1), least)).select("key")
        at = cut(at.join(full, "key"))
    # a shingle's largest component needs no pairs of its own: its texts are sides 0 .. big - 1, which meet the other sides alone
    mine = at.groupBy("h", "root").agg(F.count("*").alias("c"))
    split = mine.groupBy("h").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    parts = lambda c: F.ceil(c / BLOCK_TEXTS).cast("long")
    split = cut(split.select("h", "main", parts(F.col("most")).alias("big"), parts(F.col("all") - F.col("most")).alias("rest")))
    if split.isEmpty():
        return rows, links
    wide = at.join(_by(split), "h").withColumn("of_main", F.col("root") == F.col("main"))
    wide = wide.withColumn("side", F.when(F.col("of_main"), F.pmod(F.xxhash64("key"), F.col("big"))).otherwise(F.col("big") + F.pmod(F.xxhash64("key"), F.col("rest"))))
    others = F.sequence(F.when(F.col("of_main"), F.col("big")).otherwise(F.lit(0).cast("long")), F.col("big") + F.col("rest") - 1)
    wide = wide.withColumn("other", F.explode(others)).join(unit.select("key", "point"), "key")
    wide = wide.select("h", F.least("side", "other").alias("left"), F.greatest("side", "other").alias("right"), "side", "key", "root", "unit", "n", "point")
    wide = wide.withColumn("bin", F.pmod(F.xxhash64("h", "left", "right"), F.lit(bins)))
    pairs = wide.groupBy("bin").applyInArrow(tidy(_cross), "a long, b long, k long").groupBy("a", "b", "k").agg(F.count("*").alias("c"))
    pairs = cut(pairs.where("c >= k").select("a", "b"))  # as many shingles in common as linked texts have
    blobs = sets.dropDuplicates(["key"]).select("key", "shingles")
    proof = pairs.join(blobs.toDF("a", "x"), "a").join(blobs.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return rows, links.union(cut(proof.mapInArrow(tidy(_verify), "a long, b long")))


def grouped(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: id, th (its text's hash), n and root, the key of its component; root is null without shingles."""
    rows, links = classes_and_links(docs, id_col)
    roots = components(links).withColumnRenamed("node", "key")
    named = rows.where("n > 0").join(_by(roots), "key", "left").select("id", "th", "n", F.coalesce("root", "key").alias("root"))
    return named.union(rows.where("n = 0").select("id", "th", "n", F.lit(None).cast("long")))


def join(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: its id, n_shingles and component_id, the smallest id that links reach from it."""
    rows, links = classes_and_links(docs, id_col)
    roots = components(links)
    classes = rows.where("n > 0").groupBy("key").agg(F.min("id").alias("least")).join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = cut(classes)
    least = cut(classes.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = cut(classes.join(_by(least), "root").select("key", "component_id"))
    full = rows.where("n > 0").join(_by(classes), "key").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return full.union(rows.where("n = 0").select("id", "n", "id"))


def thin(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents without all but one of each component, the one of smallest id, then text hash; a row equal to it in both goes as well.

    Texts aren't shuffled where those that go are few enough to broadcast.
    """
    rows = cut(grouped(docs, id_col))
    first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("id", "th")).alias("rep")).select(F.col("rep.id").alias("_first"), F.col("rep.th").alias("_at"))
    # id and text hash tell the component, so rows needn't meet by component, of which one may hold many
    goes = rows.where("root is not null").join(first, F.col("id").eqNullSafe(F.col("_first")) & (F.col("th") == F.col("_at")), "left_anti").select("id", "th").distinct()
    goes = cut(goes.toDF("_id", "_th"))
    twice = cut(rows.where("root is not null").groupBy("id", "th").count().where("count > 1").select("id", "th").toDF("_id", "_th"))
    th = F.xxhash64("text")
    match = docs[id_col].eqNullSafe(F.col("_id")) & (th == F.col("_th"))
    kept = docs.join(_by(goes), match, "left_anti")
    if twice.isEmpty():
        return kept
    small = _by(twice)
    again = kept.join(small, match, "left_semi").withColumn("_h", th).dropDuplicates([id_col, "_h"]).drop("_h")
    return kept.join(small, match, "left_anti").unionByName(again)
