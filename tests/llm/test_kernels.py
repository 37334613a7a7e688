"""The shared kernels against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pagegrain.llm import textkernel as K
from pagegrain.llm import lm, tokens, trees

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\nAÉ|.\u00a0\u3000中'", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.booleans())
def test_words_and_hashes(texts, lower):
    seen = {}
    for b in K.words(pa.array(texts, pa.string()), lower=lower, shape=True):
        for i in range(b.hi - b.lo):
            expected = WORD.findall(texts[b.lo + i] or "")
            a, z = b.off[i], b.off[i + 1]
            assert [bytes(b.data[s:e]).decode() for s, e in zip(b.start[a:z], b.end[a:z], strict=True)] == expected
            for w, h in zip(expected, b.hash[a:z], strict=True):
                w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w) if lower else w
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_row_is_cut_at_white_space(monkeypatch):
    t = " ".join(f"w{i}" for i in range(3000))
    whole = np.concatenate([b.hash for b in K.words(pa.array([t, "x"]))])
    monkeypatch.setattr(K, "BLOCK", 512)
    assert (np.concatenate([b.hash for b in K.words(pa.array([t, "x"]))]) == whole).all()


def test_shingle_sets_match_python():
    texts = ["a b c d e f g", "A B C D E f g", "a b", "", None, "a a a a a a a"]
    got = dict(K.shingle_sets(pa.array(texts)))
    assert (got[0] == got[1]).all() and len(got[0]) == 3 and len(got[2]) == 1 and len(got[3]) == len(got[4]) == 0 and len(got[5]) == 1


@settings(max_examples=40, deadline=None)
@given(TEXTS)
def test_ids_equal_the_tokenizers(texts):
    c = tokens.coder(tokens.default_path())
    for lo, hi, ids, off in c.encode(pa.array(texts, pa.string())):
        for i in range(hi - lo):
            assert ids[off[i] : off[i + 1]].tolist() == c.tokenizer.encode(texts[lo + i] or "", add_special_tokens=False).ids


def test_ids_of_long_and_odd_texts():
    c = tokens.coder(tokens.default_path())
    texts = ["x" * 5000, "it's  \n\n we'll<|endoftext|> 12 ", "a\u2003 b", "\u00e9" * 300, " " * 50]
    ids, off = tokens.with_end(*next(c.encode(pa.array(texts)))[2:])
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == [*c.tokenizer.encode(t, add_special_tokens=False).ids, 0]


def test_new_pieces_reach_the_engine_as_one_text(monkeypatch):
    """The ids of each row as by itself: white space at ends and beyond ASCII, rows without any, pieces that lose their place in a small table; and their numbers alone."""
    rnd, calls = random.Random(3), []
    parts = [" ", "  ", "\n", " \t", "\u00a0", "\u2003", "\u3000", "\u0085", "\u2019", "'s", "'", "ab", "xyzzy", "\u00e9t\u00e9", "12", "...", "\U0001f600", "<|endoftext|>", "\u4e2d"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(3000)] + [None, "", "   ", " ".join(f"w{k}q" for k in range(20_000))]
    plain = tokens.coder(tokens.default_path()).tokenizer
    expected = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for bits, joined in ((4, 50), (21, 1 << 16)):
        monkeypatch.setattr(tokens, "TABLE_BITS", bits)
        monkeypatch.setattr(tokens, "JOINED", joined)
        c = tokens.Coder(tokens.default_path())
        if engine := c._piece:
            c._piece = lambda text: calls.append(text) or engine(text)
        for _ in range(2):
            got = [ids[a:b].tolist() for _, _, ids, off in c.encode(pa.array(texts)) for a, b in zip(off, off[1:], strict=False)]
            assert got == expected
            assert [n for sizes in c.sizes(pa.array(texts)) for n in sizes] == list(map(len, expected))
    c = tokens.Coder(tokens.default_path())
    if engine := c._piece:
        calls.clear()
        c._piece = lambda text: calls.append(text) or engine(text)
        list(c.encode(pa.array(texts[-1:])))
        assert len(calls) < 10  # of 20,000 words


def test_gradients_of_a_key_are_summed():
    rng = np.random.default_rng(4)
    for width in (24, 5):
        g, keys = rng.standard_normal((500, width)).astype(np.float32), np.minimum(rng.zipf(1.4, 500), 90).astype(np.uint16)
        row, size, total = lm._row_sums(g, keys)
        expected = np.zeros((91, width))
        np.add.at(expected, keys, g)
        assert row.tolist() == np.unique(keys).tolist() and size.tolist() == np.bincount(keys)[row].tolist()
        assert np.allclose(total, expected[row], atol=1e-4)


def test_forest_learns_a_rule():
    x = np.random.default_rng(0).random((2000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    f = trees.fit(x[:1500], y[:1500], trees=20, depth=3)
    assert ((f.predict(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97
    assert trees.fit(x[:0], y[:0]).predict(x[:2]).tolist() == [0.5, 0.5]
    assert (trees.fit(x, np.ones(2000)).predict(x[:3]) > 0.9).all()
