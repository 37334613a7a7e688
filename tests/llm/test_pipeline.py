"""The pipeline's stages against brute force, and the registry."""

import collections
import zlib

import corpus_pipeline as P
import numpy as np
import test_operators as B

from pagegrain.llm import registry


def test_stages_on_the_corpus(spark, docs, corpus, sf):
    rows = docs.select(*P.COLUMNS)
    one = P.quality_classifier(spark, rows, sf)
    assert one.columns == list(P.COLUMNS) and one.count() <= len(corpus)
    two = P.quality_rules(spark, rows, sf)
    expected = [(i, t) for i, t in corpus if len(B.WORD.findall(t or "")) >= 50]
    assert {r.doc_id for r in two.collect()} <= {i for i, _ in expected}
    three = P.ngram_jaccard_join(spark, rows, sf)
    assert three.columns == list(P.COLUMNS)
    four = P.benchmark_decontamination(spark, rows, sf)
    assert four.count() == len(corpus)
    assert P.pack(spark, rows.limit(0), sf).count() == 0
    for _, f in P.STAGES[:4]:
        assert f(spark, rows.limit(0), sf).count() == 0


def test_run_against_brute_force(spark, tmp_path):
    """All stages on a table with null and repeated ids, ties, copies, long and empty texts and benchmark passages, each again in plain Python."""
    rnd = np.random.default_rng(21)
    word = lambda n: [f"w{rnd.integers(4000)}" for _ in range(n)]
    items = [(i, " ".join(word(20))) for i in range(6)] + [(6, None)]
    clean = [" ".join(word(int(n))) for n in rnd.integers(60, 200, 24)]
    copies = [clean[0], clean[0].upper(), " ".join([*clean[0].split(" ")[:-1], "other"])]
    bad = [" ".join([*word(60), items[k][1], *word(10)]) for k in range(3)]
    rows = [(i, t) for i, t in enumerate([*clean, *copies, *bad, "short text", "", None, "a b c " * 60, " ".join(word(30_000))])]
    rows += [(None, " ".join(word(80))), (None, " ".join(word(90))), (None, f"{' '.join(word(70))} {items[4][1]}"), (3, clean[3]), (3, " ".join(word(75))), (70, " ".join(f"###{k}" for k in range(99)))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([*((i, 1, 0) for i in range(24)), (70, 0, 0), (24, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    scored = B.quality.classify(docs, spark.read.parquet(f"{d}/labels.parquet"), with_text=True).collect()  # its own test has its brute force
    kept = [(r.doc_id, r.text) for r in scored if r.predicted == 1]

    def passes(t):
        w = B.WORD.findall(t or "")
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeat = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        chars = sum(map(len, w))
        shouting = [x for x in w if any("A" <= c <= "Z" for c in x) and not any("a" <= c <= "z" or c > "\x7f" for c in x)]
        return len(w) >= 50 and 100 * len(repeat) <= 50 * len(w) and 100 * sum(c in "#*$%&|<>" for c in t) <= 10 * chars and 2 * len(w) <= chars <= 15 * len(w) and 100 * len(shouting) <= 60 * len(w)

    kept = [(i, t) for i, t in kept if passes(t)]
    hashes = {(r.doc_id, r.text): r.h for r in docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    groups = collections.defaultdict(list)
    parent = components(kept)
    for k, row in enumerate(kept):
        groups[parent[k]].append(row)
    order = lambda row: (row[0] is not None, row[0] or 0, hashes[row])
    kept = [min(g, key=order) for g in groups.values()]
    whole = [(k, t) for k, (_, t) in enumerate(kept)]
    hit = {k for k, _ in B.brute_hits([x for x in whole if len(x[1]) < 5000], items)}
    kept = [row for k, row in enumerate(kept) if k not in hit]
    expected = collections.Counter((i, tuple(B.ids_of(t))) for i, t in kept)
    assert len(expected) > 20 and any(i is None for i, _ in expected) and len(kept) < len(rows) - 8

    got = P.run(spark, d).collect()
    total = sum(len(ids) * n for (_, ids), n in expected.items())
    assert sum(r.length for r in got) == total and len({r.sequence_id for r in got}) == -(-total // 1024)
    assert collections.Counter(r.doc_id for r in got if r.start == 0) == collections.Counter(i for i, _ in expected.elements())
    lengths = {(i, len(ids)): ids for i, ids in expected}
    for r in got:
        ids = lengths[r.doc_id, r.doc_tokens]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def components(rows):
    sets = []
    for _, t in rows:
        w = B.words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    return [find(i) for i in range(len(rows))]


def test_run_is_whole(spark, sf):
    got = P.run(spark, sf).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc and all(sum(r.length for r in rs) == rs[0].doc_tokens for rs in by_doc.values())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
