"""Every operator against brute force on the awkward corpus, and on empty tables."""

import collections
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pagegrain.llm import decontaminate, html, lm, materialise, ngramjoin, packing, quality, rules, sharding
from pagegrain.llm.tokens import coder, default_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def key(row):
    return tuple((v is None, v) for v in row)


def test_lm_base_counts_and_probabilities(docs, corpus, empty):
    got = lm.score(docs).collect()
    assert len(got) == len(corpus)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in corpus if not held(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    expected = sorted((key((i, held(i), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]))), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6)) for i, t in corpus)
    assert sorted((key((r.doc_id, r.held_out, r.n_tokens, r.n_known)), round(r.base_score, 6)) for r in got) == expected
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    assert lm.score(empty).count() == 0


def test_lm_probabilities_sum_to_one():
    m, rnd = lm.Model(), np.random.default_rng(1)
    slots = rnd.integers(0, lm.SLOTS, 5000)
    context = lm.contexts(slots, np.array([0, 2000, 2000, 5000]))
    m.update(slots[:4096], context[:4096])
    every = np.arange(lm.SLOTS)
    total = (10 ** m.log10(every, np.repeat(context[77:78], lm.SLOTS, axis=0))).sum()
    assert abs(total - 1) < 1e-4
    before = lm.Model().log10(slots[:4096], context[:4096]).mean()
    assert m.log10(slots[:4096], context[:4096]).mean() > before


def test_lm_contexts_stay_in_their_text():
    c = lm.contexts(np.array([1, 2, 3, 4, 5]), np.array([0, 3, 3, 4, 5]))
    start = lm.contexts(np.array([9]), np.array([0, 1]))[0]
    assert (c[0] == start).all() and (c[3] == start).all() and (c[4] == start).all() and not (c[1] == start).all()


def test_lm_score_is_a_plain_softmax(spark, docs, corpus, monkeypatch):
    """Every text's score again, event by event, from the trained weights: histories, both softmaxes, shares and unknown words."""
    kept, real = {}, lm.train

    def train(texts, heads, bits):
        kept["model"], kept["heads"] = real(texts, heads, bits), heads
        return kept["model"]

    monkeypatch.setattr(lm, "train", train)
    short = docs.where("doc_id is not null and length(text) < 900 or text is null")
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.score(short).collect()}
    rows = [(i, t) for i, t in corpus if t is None or i is not None and len(t) < 900]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in rows if not held(i) for w in [*words(t), None])
    total, once = sum(counts.values()), sum(n == 1 for n in counts.values())
    unknown = min(0.5, max(once, 1) / total)
    hashed = lambda w: lm.END if w is None else next(lm.K.words(pa.array([w]), lower=True)).hash[0]
    place = {int(h): k for k, h in enumerate(kept["heads"])}
    slot = lambda w: place.get(int(hashed(w)), lm.HEADS + int(lm.K.mix(np.array([hashed(w)]))[0] >> np.uint64(20)) % lm.TAILS)
    mass = collections.defaultdict(float)
    for w, n in counts.items():
        mass[slot(w)] += n - 0.5
    model = kept["model"]

    def probability(before, target):
        history = np.array([*before, target], np.int64)
        context = lm.contexts(history, np.array([0, len(history)]))[-1:]
        out = 1.0
        for weights, at, k in zip((model.outer, model.inner), lm.feature_rows(context, np.array([target // lm.MEMBERS]), model.bits), (target // lm.MEMBERS, target % lm.MEMBERS), strict=True):
            z = [sum(float(weights[r, j]) for r in at[0]) for j in range(weights.shape[1])]
            out *= math.exp(z[k]) / sum(map(math.exp, z))
        return out

    for i, t in rows[:40]:
        events, score = [*words(t), None], 0.0
        slots = [slot(w) for w in events]
        for k, w in enumerate(events):
            p = (1 - unknown) * probability(slots[max(0, k - 2) : k], slots[k]) * ((counts[w] - 0.5) / mass[slots[k]] if slots[k] >= lm.HEADS else 1) if counts[w] else unknown
            score += math.log10(p)
        assert abs(got[i, len(events)] - score) < 1e-3 * len(events)


def test_lm_tables_follow_the_vocabulary():
    assert [lm.table_bits(n) for n in (0, 1000, 1 << 19, 1 << 20, 1 << 40)] == [(13, 15), (13, 15), (15, 16), (16, 16), (16, 16)]
    m = lm.Model((16, 16))
    rnd = np.random.default_rng(2)
    slots = rnd.integers(0, lm.SLOTS, 4096)
    context = lm.contexts(slots, np.array([0, 4096]))
    rows = lm.feature_rows(context, slots // lm.MEMBERS, m.bits)
    assert all(r.max() < 1 << 16 for r in rows) and rows[1].max() >= 1 << 15
    m.update(slots, context)
    assert all(np.count_nonzero(n) == len(np.unique(r)) for n, r in zip(m.steps, rows, strict=True))


def test_lm_parts_many_identical_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(3, "the same few words again")] * 10_000 + [(i, f"other words {i}") for i in range(4, 52)], "doc_id long, text string").repartition(8)
    monkeypatch.setattr(lm, "HELD", 8)  # tasks let go of their words at each batch
    got = lm.score(rows).collect()
    assert len(got) == 10_048 and len({(round(r.base_score, 9), round(r.score, 3), r.n_known) for r in got if r.doc_id == 3}) == 1 and all(r.n_known >= 1 for r in got)
    dealt = rows.withColumn("block", lm.F.pmod(lm.F.xxhash64("doc_id", "text", lm.F.spark_partition_id()), lm.F.lit(64)))
    assert dealt.where("doc_id = 3").select("block").distinct().count() > 4


def test_lm_averages_shares(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN_IN", 2)
    rows = spark.createDataFrame([(f"a b c d{i}",) for i in range(40)], "text string").repartition(7)
    m = lm.train(rows, np.zeros(0, np.uint64))
    assert np.isfinite(m.outer).all() and np.abs(m.outer).sum() > 0


def test_quality_learns_and_keeps_folds(spark, docs, empty):
    rnd = np.random.default_rng(2)
    rows = [(i, " ".join(rnd.choice(["good", "fine", "text"] if i % 2 else ["bad###", "junk&&&", "text"], 20))) for i in range(300)]
    table = spark.createDataFrame([*rows, (None, None), (7, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, i % 2, 0) for i in range(300)), (None, 1, 0), (3, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(table, labels).collect()
    assert len(got) == 302 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id != 7]
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.97
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert {(r.score, r.predicted) for r in quality.classify(docs, labels.limit(0)).collect()} == {(0.5, 1)}
    assert quality.classify(empty, labels).count() == 0


def test_quality_score_is_a_plain_logistic(spark, monkeypatch):
    """Every text's score again from the weights, feature by feature, and the weights by plain updates one example after the other."""
    rnd = np.random.default_rng(5)
    rows = [(i, " ".join(rnd.choice(["Good", "fine", "text9", "A-b", "x"] if i % 2 else ["bad###", "junk&&&", "text9", "x"], int(rnd.integers(0, 12))))) for i in range(60)]
    rows += [(200, None), (201, ""), (202, "one"), (203, "x x x")]
    labels = [(i, i % 2) for i in range(40)]
    kept, real = {}, quality.fit
    monkeypatch.setattr(quality, "fit", lambda *a: kept.setdefault("model", real(*a)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in quality.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), bits=12).collect()}
    w, bias = kept["model"]
    hashes = lambda w: next(quality.K.words(pa.array([w]), shape=True))

    def grams(t):
        ws = WORD.findall(t or "")
        one = [hashes(x) for x in ws]
        out = []
        for k, part in ((0, [b.hash for b in one]), (2, [b.shape for b in one])):
            for j, h in enumerate(part):
                pair = quality.K.mix(h + quality.K.COMBINE[3]) if j + 1 == len(part) else quality.K.mix(h + quality.K.COMBINE[1]) + part[j + 1] * quality.K.COMBINE[2]
                if k == 2 and j + 1 < len(part) and ws[j] == ws[j + 1]:
                    pair = np.array([quality._TWICE])
                for salt, x in ((k, h), (k + 1, pair)):
                    out.append(int((quality.K.mix(x + np.uint64(0x51ED270B * (2 * salt + 1))) & np.uint64((1 << 12) - 1))[0]))
        return out

    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for i, t in rows:
        ids = grams(t)
        assert abs(got[i] - sigmoid(bias + quality.SCALE * sum(float(w[x]) for x in ids) / max(1, len(ids)))) < 1e-5
    order = {r.doc_id: r.o for r in spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("doc_id", "xxhash64(doc_id) AS o").collect()}
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    texts = dict(rows)
    learnt = sorted((order[i], y, texts[i]) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1)
    for _ in range(quality.EPOCHS):
        for _, y, t in learnt:
            ids = collections.Counter(grams(t))
            x = {**{k: c * quality.SCALE / max(1, ids.total()) for k, c in ids.items()}, -1: 1.0}
            ws = {k: weight(k) for k in x}
            p = sigmoid(sum(ws[k] * v for k, v in x.items()))
            for k, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA
                z[k], n[k] = z[k] + g - sigma * ws[k], n[k] + g * g
    assert max(abs(weight(k) - float(w[k])) for k in range(1 << 12)) < 1e-3 and abs(weight(-1) - bias) < 1e-3


def test_quality_learns_one_text_of_an_id_and_reads_long_ones_whole(spark):
    rows = [(1, f"many rows of one id {i}") for i in range(3000)] + [(2, "good words here"), (3, "bad ### here"), (4, "word " * 200_000 + "###")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 0)], "doc_id long, quality int")
    got = quality.classify(table, labels).collect()
    assert len(got) == 3003 and all(0 <= r.score <= 1 for r in got)
    one = table.where("doc_id = 1").groupBy("doc_id").agg(quality.F.min_by("text", quality.F.xxhash64("text")).alias("text"))
    alone = quality.fit(one.union(table.where("doc_id > 1")), labels)
    both = quality.fit(table, labels)
    assert (alone[0] == both[0]).all() and alone[1] == both[1]


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95


def brute_components(corpus):
    sets = []
    for _, t in corpus:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            parent[find(a)] = find(b)
    least = collections.defaultdict(list)
    for i in range(len(sets)):
        least[find(i)].append(corpus[i][0])
    return [(corpus[i][0], len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i in range(len(sets))]


@pytest.mark.parametrize("small", [False, True])
def test_ngram_join(docs, corpus, empty, monkeypatch, small):
    if small:  # many blocks, chunks and sides; few shingles are frequent
        for name, value in (("BLOCK_SHINGLES", 300), ("BLOCK_TEXTS", 3), ("MAX_HOT", 20)):
            monkeypatch.setattr(ngramjoin, name, value)
    got = ngramjoin.join(docs).collect()
    assert sorted(key((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(map(key, brute_components(corpus)))
    assert ngramjoin.join(empty).count() == 0


def test_ngram_join_of_copies_and_of_text_ids(spark, monkeypatch):
    """Identical rows have one set between them, and ids may be strings."""
    rnd = np.random.default_rng(13)
    base = [f"w{rnd.integers(10**6)}" for _ in range(60)]
    near = " ".join([*base[:58], "x", "y"])
    rows = [(None, " ".join(base))] * 500 + [("b", near), ("a", "other words altogether here now"), ("c", "b")]
    table = spark.createDataFrame(rows, "doc_id string, text string").repartition(6)
    seen, real = [], ngramjoin.cut

    def spy(df):
        out = real(df)
        if "shingles" in out.columns:
            seen.append(out.count())
        return out

    monkeypatch.setattr(ngramjoin, "cut", spy)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.join(table).collect())
    assert got == {(None, 56, "b"): 500, ("b", 56, "b"): 1, ("a", 1, "a"): 1, ("c", 1, "c"): 1}
    assert seen == [2]


def test_ngram_join_of_one_common_passage(spark, monkeypatch):
    """A large group of near copies and texts that share a part with it, in many small blocks, against brute force."""
    monkeypatch.setattr(ngramjoin, "BLOCK_TEXTS", 4)
    monkeypatch.setattr(ngramjoin, "BLOCK_SHINGLES", 400)
    rnd = np.random.default_rng(14)
    word = lambda n: [f"w{rnd.integers(3000)}" for _ in range(n)]
    base = word(40)
    corpus = []
    for d in range(60):
        w = list(base)
        for _ in range(d % 4):
            w[int(rnd.integers(40))] = f"e{rnd.integers(99)}"
        corpus.append((d, " ".join(w if d < 40 else [*word(d % 9), *base[:30], *word(d % 5)])))
    table = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.join(table).collect())
    assert got == sorted(brute_components(corpus))


def test_thin_keeps_one_of_each(docs, corpus):
    kept = ngramjoin.thin(docs).collect()
    component = collections.Counter((r[2], r[1] > 0) for r in brute_components(corpus))
    blank = sum(n for (_, has), n in component.items() if not has)
    assert len(kept) == blank + sum(has for _, has in component)


def test_rtree_bound_loses_nothing():
    rnd = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rnd.integers(0, 1 << 63, rnd.integers(5, 80)).astype(np.uint64) * np.uint64(2)
        for _ in range(6):
            keep = base[rnd.random(len(base)) > 0.08]
            sets.append(np.unique(np.concatenate((keep, rnd.integers(0, 1 << 63, 2).astype(np.uint64)))))
    at, sizes = ngramjoin.points(sets), np.array([len(s) for s in sets])
    tree = ngramjoin.RTree(at, sizes)
    for q in range(len(sets)):
        found = set(tree.search(at[q], int(sizes[q])).tolist())
        assert {i for i in range(len(sets)) if ngramjoin.linked(sets[q], sets[i])} <= found
        assert len(found) < len(sets)


def test_rules_measure_like_python(docs, corpus, empty):
    def plain(t):
        t = t or ""
        w = WORD.findall(t)
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat)

    led = rules.ledger(docs)
    got = led.collect()
    assert sorted(key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in got) == sorted(key((i, *plain(t))) for i, t in corpus)
    assert all((r.failures & 1 == 1) == (r.n_words < 50) for r in got)
    kept = rules.apply_policy(led, "base").count()
    assert kept == sum(1 for r in got if r.n_words >= 50 and 100 * r.n_repeat_words <= 50 * r.n_words)
    table = {(r.policy, r.rule): r for r in rules.ablate(led).collect()}
    assert table["base", "short"].n_dropped == len(got) - kept
    for r in table.values():
        assert r.n_rows == len(got) and r.n_only + r.n_without == r.n_dropped
    assert rules.ledger(empty).count() == 0 and {r.n_rows for r in rules.ablate(rules.ledger(empty)).collect()} == {0}


def test_rules_lines_and_symbols(spark):
    rows = spark.createDataFrame([(1, "a b\n\na b\n \na b "), (2, "#é| $\n"), (3, "x y z x y z"), (4, "a a a")], "doc_id long, text string")
    got = {r.doc_id: r for r in rules.ledger(rows).collect()}
    assert (got[1].n_dup_lines, got[2].n_symbols, got[2].word_chars, got[3].n_repeat_words, got[4].n_repeat_words) == (1, 3, 4, 6, 0)


def brute_hits(docs, items):
    out = {}
    for (d, t), (i, b) in itertools.product(docs, items):
        w, m = words(t), words(b)
        if not m or len(w) < len(m):
            continue
        width = min(5, len(m))
        grams = lambda ws: collections.Counter(tuple(ws[k : k + width]) for k in range(len(ws) - width + 1))  # noqa: B023, E731
        want, k = grams(m), len(m) - width + 1
        for s in range(len(w) - len(m) + 1):
            both = sum((grams(w[s : s + len(m)]) & want).values())
            if 100 * both >= 75 * (2 * k - both):
                sim = both / (2 * k - both)
                best = out.get((d, i))
                out[d, i] = (max(sim, best[0]) if best else sim, s if not best or sim > best[0] else best[1], (best[2] if best else 0) + 1)
    return out


def test_decontamination(spark):
    rnd = np.random.default_rng(6)
    word = lambda n: [f"w{rnd.integers(400)}" for _ in range(n)]
    items = [(i, " ".join(word(int(rnd.integers(8, 40))))) for i in range(12)] + [(12, "solo"), (13, "Two Words"), (14, None), (15, " "), (16, "a a a a a a a a")]
    docs = []
    for d in range(60):
        body = word(int(rnd.integers(5, 120)))
        if d % 2:
            passage = items[d % 12][1].split(" ")
            for _ in range(d % 5):
                passage[int(rnd.integers(len(passage)))] = "other"
            at = int(rnd.integers(len(body)))
            body[at:at] = passage
        docs.append((d, " ".join(body)))
    docs += [(60, None), (61, ""), (62, "solo"), (63, "x TWO words y"), (64, "a " * 30), (65, items[3][1].upper()), (66, items[3][1] * 2)]
    table = spark.createDataFrame([*((d, t, 0) for d, t in docs), (65, items[3][1].upper(), 0)], "doc_id long, text string, item int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_windows) for r in decontaminate.find(table, bench).collect()}
    assert got == brute_hits(docs, items)
    bad = {d for d, _ in got}
    assert {r.doc_id for r in decontaminate.clean(table, bench).collect()} == {d for d, _ in docs} - bad
    assert decontaminate.find(table.limit(0), bench).count() == 0 and decontaminate.find(table, bench.limit(0)).count() == 0


def test_decontamination_of_texts_shorter_than_the_item(spark):
    item = [f"w{k}" for k in range(38)]
    texts = [item[:-1], item[3:], item[:30], item[:29], item[:4], [*item[:20], "other", *item[21:37]], [*item, "more"]]
    table = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(item[::-1])), (2, "w0 w1 w2 w3 w4 w5")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start, r.n_windows) for r in decontaminate.find(table, bench).collect()}
    shares = {0: 33 / 34, 1: 31 / 34, 2: 26 / 34}  # 25 / 34 and 28 / 39 are below 0.75
    assert {d: x for (d, i), x in got.items() if i == 0 and d < 6} == {d: (round(x, 9), 0, 1) for d, x in shares.items()}
    assert {d for d, i in got if i == 2} == {0, 2, 3, 5, 6} and not any(i == 1 for _, i in got) and got[6, 0][:2] == (1.0, 0)
    assert [r.doc_id for r in decontaminate.clean(table, bench).orderBy("doc_id").collect()] == [4]


def test_decontamination_of_a_repeated_shingle(spark):
    rnd = np.random.default_rng(8)
    items = [(i, [f"i{i}w{k}" for k in range(204)]) for i in range(20)]
    docs = [(i, " ".join(w[:176] + [f"tail{rnd.integers(10**9)}"] * 28)) for i, w in items]
    bench = [(i, " ".join(w)) for i, w in items]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_windows) for r in decontaminate.find(*tables).collect()}
    assert len(got) == 20 and got == brute_hits(docs, bench)


def test_fingerprints_of_any_length(spark):
    want, longest = {}, 70_000
    rnd = np.random.default_rng(9)
    rows = []
    for i, k in enumerate((3, 16_383, 16_384, 32_767, 32_768, longest)):
        for same in (False, True):
            hs = np.full(k, -7 - i) if same else rnd.integers(-(2**63), 2**63 - 1, k)
            bits = 2 * (hs[:, None] >> np.arange(64) & 1).sum(axis=0) > k
            want[2 * i + same] = int(np.packbits(bits, bitorder="little").view(np.int64)[0])
            rows.append((2 * i + same, hs.tolist()))
    table = spark.createDataFrame(rows, "i int, hs array<long>")
    assert {r.i: r.fp for r in table.select("i", decontaminate.fingerprint(longest).alias("fp")).collect()} == want
    short = table.where(f"size(hs) <= {decontaminate.NARROW}").select("i", decontaminate.fingerprint(decontaminate.NARROW).alias("fp"))
    assert {r.i: r.fp for r in short.collect()} == {i: fp for i, fp in want.items() if len(rows[i][1]) <= decontaminate.NARROW}


def test_decontamination_of_a_long_item(spark):
    item = [f"w{k}" for k in range(66_000)]
    docs = [(0, " ".join(["before", *item[:-9]])), (1, " ".join(item[:40_000]))]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find(*tables).collect()] == [(0, 0)]


def test_clean_drops_rows_and_not_ids(spark):
    item = " ".join(f"w{k}" for k in range(20))
    rows = [(None, f"x {item} y", 0), (None, "clean", 1), (None, None, 2), (7, item, 3), (7, "clean", 4), (7, None, 5), (7, item, 6), (8, item + " z", 7), (9, "clean", 8)]
    table = spark.createDataFrame(rows, "doc_id long, text string, row long")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert sorted(r.row for r in decontaminate.clean(table, bench).collect()) == [1, 2, 4, 5, 8]


def test_decontamination_by_anchors_and_fingerprints(spark, monkeypatch):
    """Of all windows and items few meet at an anchor, of those the fingerprints leave few, and none that is similar is lost; the same when nothing is broadcast."""
    rnd = np.random.default_rng(10)
    word = lambda n: [f"w{rnd.integers(60)}" for _ in range(n)]
    template = " ".join(word(12))
    items = [(i, " ".join([template, *word(24)])) for i in range(60)]
    docs = [(d, " ".join([*word(30), *items[d % 60][1].split(" ")[: 36 - d % 3], *word(30)])) for d in range(120)]
    docs += [(1000 + d, " ".join([*word(20), *items[d % 60][1].split(" ")[d % 20 + 6 : d % 20 + 20], *word(40)])) for d in range(120)]  # parts of items
    docs += [(2000 + d, " ".join([*word(20), template, *word(40)])) for d in range(40)]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    seen = {}
    real = decontaminate.candidates

    def count(near, marks, n_items):
        out = real(near, marks, n_items)
        seen["windows"], seen["pairs"], seen["docs"] = near.count(), out.count(), near.select("id").distinct().count()
        return out

    monkeypatch.setattr(decontaminate, "candidates", count)
    got = {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_windows) for r in decontaminate.find(*tables).collect()}
    assert got == brute_hits(docs, items) and len(got) >= 120
    every = sum(max(1, len(t.split()) - 35) for _, t in docs) * len(items)  # windows of an item's length, and items
    assert seen["windows"] < 0.05 * every and seen["pairs"] < 0.7 * seen["windows"] and sum(n for _, _, n in got.values()) <= seen["pairs"]
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST", 0)
    again = {(r.doc_id, r.item_id): (r.similarity, r.start, r.n_windows) for r in decontaminate.find(*tables).collect()}
    assert again == got


def test_anchors_lose_no_similar_window(spark):
    """Shingles that aren't anchors are fewer, repeats counted, than a similar window shares, and the most shared ones."""
    rnd = np.random.default_rng(3)
    texts = [" ".join(f"w{rnd.integers(3 if i % 3 else 40)}" for _ in range(rnd.integers(1, 40))) for i in range(40)]
    shing = lambda t: [tuple(t.split()[i : i + min(5, len(t.split()))]) for i in range(max(1, len(t.split()) - 4))]
    rows = []
    for k, t in enumerate(texts):
        n = len(t.split())
        rows.append((k, n, min(n, 5), [hash(s) for s in shing(t)]))
    items = spark.createDataFrame(rows, "ik long, m int, width int, hs array<long>")
    marks = {}
    for r in decontaminate.anchors(items).collect():
        marks.setdefault(r.ik, set()).add(r.h)
    for k, m, width, hs in rows:
        left = sum(h not in marks[k] for h in hs)
        assert left < math.ceil(0.75 * (m - width + 1)) and marks[k] <= set(hs)


def test_decontamination_of_repeated_and_null_ids_and_a_very_long_text(spark):
    rnd = np.random.default_rng(12)
    word = lambda n: [f"w{rnd.integers(5000)}" for _ in range(n)]
    a, b, c = (" ".join(word(20)) for _ in range(3))
    items = spark.createDataFrame([(1, a, 0), (1, b, 1), (None, c, 2), (1, a, 3)], "item_id long, text string, row long")
    long = " ".join([*word(300_000), a, *word(10), a, *word(100_000)])
    rows = [(None, f"x {b} y"), (None, "clean words alone"), (5, long), (6, c), (6, f"{a} and {b}"), (None, f"x {b} y")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((key((r.doc_id, r.item_id)), r.similarity, r.start, r.n_windows >= 2) for r in decontaminate.find(table, items).collect())
    assert got == sorted([(key((None, 1)), 1.0, 1, True), (key((5, 1)), 1.0, 300_000, True), (key((6, None)), 1.0, 0, False), (key((6, 1)), 1.0, 0, True)])
    assert [r.text for r in decontaminate.clean(table, items).collect()] == ["clean words alone"]


def test_decontamination_stays_native(spark, docs):
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    plan = decontaminate.find(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def ids_of(t):
    return [*coder(default_path()).tokenizer.encode(t or "", add_special_tokens=False).ids, 0]


def test_materialised_sequences_round_trip(docs, corpus, empty, tmp_path):
    got = materialise.materialise(docs, str(tmp_path / "a"), length=64, shard_bytes=2048, key=9, stable=False).collect()
    seqs = list(materialise.read(str(tmp_path / "a")))
    assert len(seqs) == len({r.slot for r in got}) and sorted({r.slot for r in got}) == list(range(len(seqs)))
    pieces = collections.defaultdict(list)
    for r in got:
        assert r.shard == r.slot // 16 and zlib.crc32(seqs[r.slot].tobytes()) == r.record_crc32
        pieces[r.doc_id].append((r.start, tuple(seqs[r.slot][r.at : r.at + r.length])))
    for i in {i for i, _ in corpus if i not in (None, 20, 21)}:
        flat = [x for _, p in sorted(pieces[i]) for x in p]
        assert flat in [ids_of(t) for j, t in corpus if j == i]
    assert sum(r.length for r in got) == sum(len(ids_of(t)) for _, t in corpus)
    assert [r.slot for r in sorted(got, key=lambda r: r.sequence)][:6] != list(range(6))
    assert (next(materialise.read(str(tmp_path / "a"), 5, 1)) == seqs[5]).all()
    assert materialise.materialise(empty, str(tmp_path / "b")).count() == 0 and list(materialise.read(str(tmp_path / "b"))) == []


def test_materialised_text_ids(spark, tmp_path):
    rows = spark.createDataFrame([("a", "some words"), (None, None), ("b", "x " * 300)], "doc_id string, text string").coalesce(1)
    got = materialise.materialise(rows, str(tmp_path / "c"), length=64, stable=False).collect()
    assert {r.doc_id for r in got} == {"a", "b", None} and sum(r.length for r in got) == sum(len(ids_of(r.text)) for r in rows.collect())
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == ["manifest.json", "shard-00000000.bin"]


def test_feistel_is_a_keyed_permutation():
    for n in (1, 2, 3, 17, 256, 1000):
        slots = materialise.feistel(np.arange(n), n, 5)
        assert sorted(slots) == list(range(n)) and (materialise.feistel(slots, n, 5, back=True) == np.arange(n)).all()
    assert (materialise.feistel(np.arange(1000), 1000, 5) != materialise.feistel(np.arange(1000), 1000, 6)).any()


def test_sharding(docs, corpus, empty, tmp_path):
    limit = 1500
    got = sharding.assign(docs, limit).collect()
    assert len(got) == len(corpus)
    shards = collections.defaultdict(list)
    for r in got:
        assert r.depth == len(r.shard.split(":")[0])
        shards[r.shard].append(r.bytes)
    assert all(sum(b) <= limit or len(b) == 1 for b in shards.values())
    names = sorted(shards)
    assert not any(b.startswith(a) and a != b for a in names for b in names if ":" not in a + b)  # no shard is a prefix of another
    for s in (s for s in names if ":" not in s):  # a shard's parent was too large
        if s:
            assert sum(sum(b) for t, b in shards.items() if t.startswith(s[:-1])) > limit
    written = {r.shard: (r.n_docs, r.n_bytes) for r in sharding.write(docs, str(tmp_path / "s"), limit).collect()}
    assert written == {s: (len(b), sum(b)) for s, b in shards.items()}
    assert sharding.assign(empty, limit).count() == 0


def test_sharding_pages_of_identical_rows(spark):
    rows = spark.createDataFrame([(1, "x" * 84)] * 95 + [(2, "y" * 5000)], "doc_id long, text string").repartition(3)
    shards = collections.defaultdict(list)
    for r in sharding.assign(rows, 1000).collect():
        shards[r.shard].append(r.bytes)
    assert sum(map(len, shards.values())) == 96 and all(sum(b) <= 1000 or len(b) == 1 for b in shards.values())
    plan = sharding.assign(rows, 1000)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sharding_of_tables_that_fit_in_few_shards(docs, corpus):
    """The directory's sums go up to the root where that fits, and a very long text is a shard of its own."""
    total = sum(len((t or "").encode()) + sharding.OVERHEAD for _, t in corpus)
    assert {r.shard for r in sharding.assign(docs, total).collect()} == {""}
    for limit in (total - 1, total // 3):
        shards = collections.defaultdict(list)
        for r in sharding.assign(docs, limit).collect():
            shards[r.shard].append(r.bytes)
        assert 2 <= len(shards) <= 16 and all(sum(b) <= limit or len(b) == 1 for b in shards.values())
        for s in shards:
            assert sum(sum(b) for t, b in shards.items() if t.startswith(s[:-1])) > limit
    one = [r for r in sharding.assign(docs, 1000).collect() if r.doc_id == 10]
    assert len(one) == 1 and one[0].bytes == 200_016


def test_packing(docs, corpus, empty):
    got = packing.pack(docs, window=64).collect()
    by_sequence, total = collections.defaultdict(list), sum(len(ids_of(t)) for _, t in corpus)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert sorted(by_sequence) == list(range(-(-total // 64)))
    for parts in by_sequence.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    whole = collections.Counter((i, tuple(ids_of(t))) for i, t in corpus)
    for (i, ids), n in whole.items():
        if i in (20, 21, None):
            continue
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        at = 0
        for r in mine:
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) * n
    assert packing.pack(empty).count() == 0


def test_plan_covers_every_rest():
    rnd = np.random.default_rng(7)
    for _ in range(25):
        h = np.zeros(256, int)
        for n in rnd.integers(1, 256, rnd.integers(0, 120)):
            h[n] += rnd.integers(1, 20)
        plan = packing.Plan(h, 256)
        total = int(h @ np.arange(256))
        assert plan.sequences == -(-total // 256)
        for n in np.flatnonzero(h):
            for rank in {0, int(h[n]) - 1}:
                parts = plan.parts(n, rank)
                parts = parts[np.argsort(parts[:, 0])]
                assert parts[:, 1].sum() == n and (parts[:, 0] == np.cumsum(parts[:, 1]) - parts[:, 1]).all()


def test_nnls_fills_an_exact_histogram():
    combos = packing.combinations(np.array([20, 44, 10, 34]), 64)
    target = np.zeros(64)
    target[20], target[44], target[10] = 52, 50, 1
    target[34] += 1  # 20 + 10 + 34
    x = packing.nnls(combos, target, sweeps=50)
    got = np.zeros(64)
    for k, c in enumerate(combos):
        for m in c:
            got[m] += x[k]
    assert (x >= 0).all() and np.abs(got - target).max() < 0.5


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site. Accept them.</div><div class="ad">Buy now, buy cheap.</div>
<article><h1>Head&nbsp;line &lt;one&gt;</h1><p>First   <b>para</b>graph with<br>a break, and &eacute; &#233; &amp;amp; it goes on for a while here.
<p>Second paragraph, unclosed, with <a href=x>a link</a> in the middle of its words.<div class="sponsored ad">Sponsored words.</div>
<ul><li>Point one of the article, in words.</li><li>Point two of the article, in more words.</li></ul><!-- hidden <p>x</p> --></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this a lot, thanks for the long article about it.</p></div></section>
<aside class="sidebar"><p>Related: other articles to read.</p></aside><form><p>Your mail</p><input name=a><textarea>x</textarea></form>
<footer>&copy; 2020 <p>Legal words.</p></footer></body></html>"""


def test_html_extraction(spark):
    expected = "Head line <one>\nFirst paragraph with a break, and é é &amp; it goes on for a while here.\nSecond paragraph, unclosed, with a link in the middle of its words.\nPoint one of the article, in words.\nPoint two of the article, in more words."
    rows = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", PAGE[: PAGE.index("<!-- hidden")] + "<p", "t"), (5, "u", "<" * 3000, "t"), (6, "u", "<div>" * 3000 + "x", "t")], "page_id long, url string, html string, text string")
    got = collections.defaultdict(list)
    for r in html.extract_pages(rows).collect():
        got[r.page_id].append((r.text, r.n_chars))
    assert got[1] == [(expected, len(expected))] * 2 and got[2] == got[3] == [("", 0)] and got[4] == [(expected, len(expected))] and len(got) == 6
    assert html.extract_pages(rows.limit(0)).count() == 0


def test_decoding_keeps_no_child_of_a_dropped_node():
    parents = [-1, 0, 1, 1, 0, 4]
    kept = html.decode(parents, np.array([0.9, 0.4, 0.99, 0.99, 0.3, 0.6]))
    assert kept.tolist() == [True, True, True, True, False, False]


def test_html_on_made_pages_never_trained_on():
    good = total = 0
    forest = html.model()
    for root in html.made(99, 60):
        nodes, parents = html.flatten(root)
        label = np.zeros(len(nodes), bool)
        for i, n in enumerate(nodes):
            label[i] = n.kinds >> 40 & 1 if n.kinds >> 41 & 1 else True if n.tag in ("html", "body") else label[parents[i]]
            n.kinds &= (1 << 40) - 1
        kept = html.decode(parents, forest.predict(html.node_features(nodes, parents)))
        leaves = np.array([bool(n.runs) for n in nodes])
        good, total = good + (kept == label)[leaves].sum(), total + leaves.sum()
    assert good / total > 0.9
