"""Personal data: rules against Python's own regular expressions, contexts against what was planted."""

import hashlib
import random
import re

import pytest

from pagegrain.llm import pii

GREEDY = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def stands(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and luhn(digits or "0"), "phone": 8 <= len(digits) <= 15}[kind]


def spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in GREEDY.items() for m in re.finditer(p, text or "") if stands(k, m.group())]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(9)
    rows = [None, "", " ", "a@b.c@d.e f@g", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3.99999999999", "9" * 20000, "a" * 2000 + "@x.y", "+" + "1" * 9 + " +1 2 3", "a@b.c%d@e.f x@y.z.w-1", "9 " * 9000]
    rows.append(" ".join(f"mail{i}@x.org" for i in range(1000)))
    rows += ["😀é 4111 1111 1111 1111 and 4111-1111-1111-1111, 4111111111111112"]
    rows += [" ".join(rnd.choice(list("0123456789+-.@ ()ab")) for _ in range(300)) for _ in range(40)]
    return rows + ["".join(rnd.choice(list("01+-.@ ()aé😀4")) for _ in range(300)) for _ in range(40)]


def test_rules_equal_regular_expressions(spark, texts):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1, 2), (None, "me@x.io", None, 0, 0), (None, None, None, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string, row int, instance int").repartition(4)
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.digest(pii.find(df)).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        s = spans(t)
        want.append((i, *(sum(x.startswith(k + ":") for x in s) for k in GREEDY), hashlib.sha256(",".join(s).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_running_sums_of_long_arrays(spark):
    sizes = list(range(1000))
    got = spark.createDataFrame([(sizes,), ([],)], "a array<long>").select(pii.running("a").alias("s")).collect()
    assert got[0].s == [sum(sizes[:k]) for k in range(len(sizes))] and got[1].s == []


def planted(n_known, n_new, n_other):
    rows = [f"Some words about it, write to user{k}@host{k}.org by noon" for k in range(n_known)]
    rows += [f"Once more: write to user.{4000 + k}(at)host by noon" for k in range(n_new)]
    rows += [f"They write to nobody {k + 10000} times" for k in range(n_other)]
    return rows + [f"and user.4000(at)host stands elsewhere, near 20{k:02}-x" for k in range(3)]


def find(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    return {r.doc_id: r for r in pii.find(df).collect()}


def test_contexts_find_what_rules_do_not(spark):
    rows = planted(50, 5, 4)
    got = find(spark, rows)
    for i, r in got.items():
        held = [rows[i][f["start"] : f["end"]] for f in r["found"]]
        assert held == re.findall(r"user\.\d+\(at\)host", rows[i])
        assert all(f["k"] == 0 and 0.8 <= f["confidence"] < 1 for f in r["found"])


def test_patterns_need_their_share_and_support(spark):
    assert not any(r["found"] for r in find(spark, planted(50, 5, 60)).values())  # before other words as often
    assert not any(r["found"] for r in find(spark, planted(2, 1, 0)).values())  # two seeds are too few
    copies = ["please write to me@host.org or call"] * 60 + ["please write to me.4000(at)host or call"]
    assert not any(r["found"] for r in find(spark, copies).values())  # copies of one are one


def test_second_round_learns_from_the_first(spark):
    rows = planted(50, 5, 0)
    rows += [f"Again the address is user.{4000 + k}(at)host here" for k in range(5)] * 2 + [f"For the address is user-{7000 + k}=host here" for k in range(2)]
    got = find(spark, rows)
    last = [got[i] for i in range(len(rows) - 2, len(rows))]
    assert all(not r["found"] or r["found"][0]["confidence"] < 1 for r in last)
    scores = pii.discover(
        spark.createDataFrame([(1, f"k{i}", 1, 10) for i in range(9)] + [(1, "a", 1, 10), (2, "a", 3, 10), (2, "k0", 3, 10), (2, "k1", 3, 10), (2, "b", 1, 10)], "context long, instance string, n long, total long"),
        spark.createDataFrame([(f"k{i}", 0) for i in range(9)], "instance string, kind int"),
    ).collect()
    assert {r.instance for r in scores} == {"a", "b"}  # b is known by the context that a made good
    assert abs(next(r.confidence for r in scores if r.instance == "a") - 0.9) < 1e-9


def test_empty(spark, empty):
    assert pii.digest(pii.find(empty)).count() == 0


def test_no_python_in_the_plan(spark, docs):
    plan = pii.digest(pii.find(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
