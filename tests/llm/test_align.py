"""Alignment of two tokenizers against a brute force over each text alone."""

import collections
import hashlib

import pytest

from pagegrain.llm import align

public = pytest.importorskip("public_tokenizers")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = ["a▁b", "<s> </s> <|endoftext|> <0x41>", "\x00nul", "tab\tand\r\nlines\n\n\n", "   ", " lead", "😀 é ñ 漢字", "x" * 3000, "▁", "don't  stop"]


def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    name = {i: t for t, i in a.get_vocab().items()}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    of_a = lambda i: bytes(letter[c] for c in name[i])
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return lambda t: [(i, of_a(i)) for i in a.encode(" " + t, add_special_tokens=False).ids], lambda t: [(i, of_b(i)) for i in b.encode(t)]


def one(text, a_of, b_of):
    """(a, b, groups, links) of a text, or None."""
    if not text:
        return None
    a, b, whole = a_of(text), b_of(text), (" " + text).encode()
    if not b"".join(x for _, x in a) == whole == b"".join(x for _, x in b):
        return None
    ends = [_ends(a), _ends(b)]
    links, i, j = [], 0, 0
    groups, ga, gb = [], [], []
    while i < len(a):
        links.append((a[i][0], b[j][0]))
        x, y = ends[0][i], ends[1][j]
        if x <= y:
            ga.append(a[i][0])
            i += 1
        if y <= x:
            gb.append(b[j][0])
            j += 1
        if x == y:
            groups.append((ga, gb))
            ga, gb = [], []
    return a, b, groups, links


def _ends(side):
    out, at = [], 0
    for _, x in side:
        at += len(x)
        out.append(at)
    return out


def brute(texts):
    a_of, b_of = sides()
    found = [one(t, a_of, b_of) for t in texts]
    count = collections.Counter(p for f in found if f for p in f[3])
    high = collections.Counter()
    for (_, b), n in count.items():
        high[b] = max(high[b], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        line = ";".join("|".join(",".join(map(str, ids)) for ids in g) for g in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == high[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(line.encode()).hexdigest()))
    return out


def test_digest_equals_brute_force(spark, corpus):
    short = [(i, t if t is None or len(t) < 5000 else t[:5000]) for i, t in corpus] + [(1000 + k, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, "en", 1, b"z", 2) for i, t in short], "doc_id long, text string, id string, block int, links binary, n_a int").repartition(5)
    got = sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in align.align(df).collect()), key=str)
    want = sorted(((i, *v) for (i, _), v in zip(short, brute([t for _, t in short]), strict=True)), key=str)
    assert got == want


def test_small_blocks_and_groups(spark):
    texts = [*ODD, None, "", "one two", "one two"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string")
    blocks = [{r["key"]: tuple(r[c] for c in COLUMNS) for r in align.align(df, id_col="key", **how).collect()} for how in ({}, {"block_links": 1})]
    assert blocks[0] == blocks[1] == dict(zip(map(str, range(len(texts))), brute(texts), strict=True))
    found = {r["key"]: r for r in align.groups(df, id_col="key").collect()}
    a_of, b_of = sides()
    for i, t in enumerate(texts):
        want, got = one(t, a_of, b_of), found[str(i)]
        if want is None:
            assert not got["a"] and not got["b"] and not got["a_ends"] and not got["b_ends"]
            continue
        assert got["a"] == [x for x, _ in want[0]] and got["b"] == [x for x, _ in want[1]]
        cuts = [0, *got["a_ends"]], [0, *got["b_ends"]]
        assert [(got["a"][s:e], got["b"][u:v]) for s, e, u, v in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:], strict=False)] == [(x, y) for x, y in want[2]]


def test_empty(spark, empty):
    assert align.align(empty).count() == 0
    assert align.groups(empty).count() == 0
