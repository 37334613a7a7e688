"""URL filter: rules by cases, statistics and features against plain Python, verdicts on urls held out."""

import collections
import math
import zlib

import numpy as np

from pagegrain.llm import urls


def test_url_rules(spark):
    cases = {
        "http://A.com": ("a.com", "", None), "http://a.com/": ("a.com", "/", "com/"), "https://www.Example.com/en/x?q=://b/": ("www.example.com", "/en/x", "www.example.com/en/"),
        "http://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/"), "x://a.net/es/1#y": ("a.net", "/es/1", "net/es/"), "x://net/fr/": ("net", "/fr/", "net/fr/"),
        "http://xcom/": ("xcom", "/", None), "a.com/": ("", "", None), "": ("", "", None), "http://a.net/de/": ("a.net", "/de/", None), "http://b.com/" + "x1/" * 100_000: ("b.com", "/" + "x1/" * 100_000, "com/"), "http://b.org/" + "x1/" * 100_000: ("b.org", "/" + "x1/" * 100_000, None),
    }
    rows = spark.createDataFrame([*((i, u, "h") for i, u in enumerate(cases)), (99, None, "h"), (99, None, "h")], "page_id long, url string, host string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(rows).collect()]
    assert sorted(x[:4] for x in got if x[0] < 99) == sorted((i, *cases[u]) for i, u in enumerate(cases)) and len(got) == len(cases) + 2
    verdicts = {"com/": "allow", "www.example.com/en/": "allow", None: None}
    assert all(v == verdicts.get(r, "block") for _, _, _, r, v in got if r)
    assert urls.filter_urls(rows.limit(0)).count() == 0
    assert {r.verdict for r in urls.filter_urls(rows.where("page_id in (0, 99)")).collect()} == {"allow"}  # no labelled url


def plain_cells(host, path):
    labels = host.split(".")
    segment = path.split("/")[1] if "/" in path else ""
    return [zlib.crc32(x.encode()) % urls.CELLS for x in ("0 " + labels[-1], "1 " + ".".join(labels[-2:]), "2 " + segment)]


def test_statistics_and_features_like_python(spark):
    made = [(f"http://h{i % 7}.{'com' if i % 3 else 'net'}/{'es' if i % 2 else 'de'}/{i}?a=1&b={i}#c", i) for i in range(60)] + [("https://éa-b.net/fr/", 60), ("https://example.com/en/_x-y/", 61)]
    rows = urls.cells(urls.ruled(spark.createDataFrame(made, "url string, page_id long"))).collect()
    votes = collections.Counter((r.rule, r.ruled == "block", c) for r in rows if r.rule for c in (r.c0, r.c1, r.c2))
    block, every = collections.defaultdict(float), collections.defaultdict(float)
    for (_, y, c), n in votes.items():
        every[c] += n / (n + urls.ENOUGH)
        block[c] += y * n / (n + urls.ENOUGH)
    table = urls.cells(urls.ruled(spark.createDataFrame(made, "url string, page_id long")))
    known = urls.statistics(table.where("rule is not null").selectExpr("rule", "int(ruled = 'block') AS y", "c0", "c1", "c2"))
    expected = [(block[c] + urls.PRIOR / 2) / (every[c] + urls.PRIOR) for c in range(urls.CELLS)]
    assert np.allclose(known[0], expected)
    got = urls.features(table.select("url", "host", "path", "c0", "c1", "c2").toArrow().combine_chunks().to_batches()[0], known)
    for r, x in zip(rows, got, strict=True):
        assert [r.c0, r.c1, r.c2] == plain_cells(r.host, r.path)
        u, h, p = (s.encode() for s in (r.url, r.host, r.path))
        share = [n / len(u) for n in collections.Counter(u).values()]
        digits = sum(48 <= c < 58 for c in u)
        plain = [len(u), len(h), len(p), h.count(b"."), p.count(b"/"), digits / len(u), digits, -sum(s * math.log2(s) for s in share), u.count(b"="), u.count(b"&") + u.count(b"?"), len(u) - len(h) - len(p), h.count(b"-"), p.count(b"-") + p.count(b"_"), u.startswith(b"https"), b"#" in u, p.endswith(b"/")]
        assert np.allclose(x, [*plain, *(expected[c] for c in (r.c0, r.c1, r.c2))], atol=1e-4)


def test_trees_judge_what_no_rule_fits(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = [(10_000 + i, f"http://a{i}.zzz/unseen{i}/") for i in range(5)] + [(20_000, "http://a.net/unseen/"), (20_001, "http://a.zzz/en/1")]
    rows = pages.select("page_id", "url").union(spark.createDataFrame(extra, "page_id long, url string"))
    got = urls.filter_urls(rows).where("rule is null").collect()
    assert {r.verdict for r in got if r.page_id < 10_000} == {"allow", "block"}
    assert all(r.verdict == "allow" and r.block_score == 0.5 for r in got if 10_000 <= r.page_id < 20_000)  # an unseen ending and an unseen first segment
    assert {r.page_id: r.verdict for r in got if r.page_id >= 20_000} == {20_000: "block", 20_001: "block"}  # one part has been seen


def test_held_out_urls_of_the_rules(spark):
    """Trees fit on half of the urls judge the other half as the rules do."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    half = "pmod(xxhash64(url), 2) = 0"
    rows = urls.cells(urls.ruled(pages)).where("rule is not null")
    labelled = rows.selectExpr("url", "host", "path", "rule", "int(ruled = 'block') AS y", "c0", "c1", "c2")
    forest, known = urls.fit(labelled.where(half))
    rest = labelled.where(f"NOT ({half})").toArrow().combine_chunks().to_batches()[0]
    assert ((forest.predict(urls.features(rest, known)) > 0.5) == rest.column("y").to_numpy()).mean() > 0.95


def test_rules_left_out(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = urls.held_out_rules(pages)
    assert set(got) == {h + p for _, h, p in urls.RULES}
    assert sum(n == right for n, right in got.values() if n) >= 3
