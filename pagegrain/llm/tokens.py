"""Token ids of whole texts by a byte-level BPE, each distinct piece of text encoded once.

The pre-tokeniser of such vocabularies never lets a token run on over the place where white space begins after
something else, so a text's ids are those of its pieces (white space, then up to the next white space), one
after the other. Pieces are hashed all at once, and only those not in the worker's cache reach the tokenizer.
Rows with white space outside ASCII are encoded whole. The cache is bounded and belongs to one Python worker.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa

from . import textkernel as K

BLOCK = 1 << 21
MAX_CACHED = 1_000_000
#: Bits of the cache's table and of a piece's number of ids in it, and bytes of pieces in a text for the engine, about.
TABLE_BITS, SIZE_BITS, JOINED = 21, 20, 1 << 16
MAX_SIZE = (1 << SIZE_BITS) - 1
_tokenizers: dict[str, Coder] = {}


class Coder:
    """Encodes with the tokenizer file at ``path``; ids must be below 65,536."""

    def __init__(self, path: str):
        self.path, self._size = path, None
        self._piece = self._core(path)
        if self._piece is None and self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.clear()

    @cached_property
    def tokenizer(self):
        """The tokenizer itself; it is loaded where a text needs it, to spare the worker's memory."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = True
        return out

    def _core(self, path: str):
        """A faster engine with the same ids, where merges stand in the order of their ids and the engine is installed."""
        try:
            import tiktoken
        except ImportError:
            return None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        kind, vocab = file.get("pre_tokenizer") or {}, file["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"].get("merges", [])]
        order = [vocab[a + b] for a, b in merges]
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or file.get("normalizer") or order != sorted(order) or len(vocab) < 256 + len(order) or max(vocab.values()) >= 1 << 16:
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest follow from 256
        letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        added = {a["content"] for a in file.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in added}
        self._size = np.zeros(1 << 16, np.int64)  # bytes of each id
        self._size[list(ranks.values())] = [len(b) for b in ranks]
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def clear(self) -> None:
        """An empty table: at a hash's place, the hash, and where its ids begin and how many they are (-1: none)."""
        self.hash, self.at = np.zeros(1 << TABLE_BITS, np.uint64), np.full(1 << TABLE_BITS, -1, np.int64)
        self.known, self.ids = 0, np.zeros(0, np.uint16)

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of new pieces begin, and how many they are."""
        sizes, ids = self._pieces(data, starts, ends)
        begin = len(self.ids) + np.cumsum(sizes) - sizes
        self.ids, self.known = np.concatenate((self.ids, ids)), self.known + len(hashes)
        kept = sizes <= MAX_SIZE
        hashes, packed = hashes[kept], (begin << SIZE_BITS | sizes)[kept]
        place = hashes >> np.uint64(64 - TABLE_BITS)
        self.hash[place], self.at[place] = hashes, packed
        lost = self.hash[place] != hashes  # two of them have one place: neither stays
        self.at[place[lost]] = -1
        return begin, sizes

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all their ids."""
        each = np.ones(len(starts), bool)
        if self._piece:
            each = ~_joinable(data, starts, ends)
        sizes, parts = np.zeros(len(starts), np.int64), {}
        together = np.flatnonzero(~each)
        length = np.cumsum((ends - starts)[together])
        a = 0
        while a < len(together):
            b = max(a + 1, int(np.searchsorted(length, length[a] + JOINED, "right")))
            some = together[a:b]
            n = (ends - starts)[some]
            to = np.cumsum(n)
            text = data[np.repeat(starts[some] - (to - n), n) + np.arange(to[-1])].tobytes().decode("utf-8", "replace")
            got = np.frombuffer(array("H", self._piece(text)), np.uint16)
            reached = np.cumsum(self._size[got])
            at = np.searchsorted(reached, to)
            if len(got) and at[-1] < len(got) and (reached[at] == to).all() and at[-1] == len(got) - 1:
                sizes[some] = np.diff(at, prepend=-1)
                parts[a] = some, got
            else:  # an id lies across two pieces
                each[some] = True
            a = b
        alone = np.flatnonzero(each)
        got = []
        if len(alone):
            texts = [data[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)]
            got = list(map(self._piece, texts)) if self._piece else self._raw(texts)
            sizes[alone] = np.fromiter(map(len, got), np.int64, len(got))
            parts[-1] = alone, np.fromiter(chain.from_iterable(got), np.uint16, int(sizes[alone].sum()))
        first = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), np.uint16)
        for some, got in parts.values():
            n = sizes[some]
            ids[np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(len(got))] = got
        return sizes, ids

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(lo, hi, ids, offsets) for consecutive blocks of rows; a null is empty."""
        for i, j, block, rows in self._rows(texts):
            yield i, j, *self._block(block, rows)

    def sizes(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """How many ids each row has, for consecutive blocks of rows."""
        for _, _, block, rows in self._rows(texts):
            yield np.diff(self._block(block, rows, False)[1])

    @staticmethod
    def _rows(texts: pa.Array):
        data, off = K.raw(texts)
        n, i = len(off) - 1, 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1)
            yield i, j, data[int(off[i]) : int(off[j])], off[i : j + 1] - off[i]
            i = j

    def _block(self, block: np.ndarray, rows: np.ndarray, wanted: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
        """Ids, if they are wanted, and their offsets by row."""
        n = len(block)
        if not n:
            return np.zeros(0, np.uint16), np.zeros(len(rows), np.int64)
        space = block == 32
        space |= block - np.uint8(9) < 5
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[rows[:-1][rows[:-1] < n]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], n)
        hashes = np.concatenate([K.span_hashes(block[starts[a] : ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a]) for a, b in _cuts(starts, ends)])
        place = hashes >> np.uint64(64 - TABLE_BITS)
        at = self.at[place]
        missed = np.flatnonzero((self.hash[place] != hashes) | (at < 0))
        if len(missed):
            unique, where, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            if self.known + len(unique) > MAX_CACHED and self.known:
                self.clear()
                missed = np.arange(len(hashes))
                unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
            where = missed[where]
            learned, sizes = self._learn(unique, block, starts[where], ends[where])
        begin, size = at >> SIZE_BITS, at & MAX_SIZE
        if len(missed):
            begin[missed], size[missed] = learned[back], sizes[back]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])] if wanted else None
        return self._whole(block, rows, ids, total[np.searchsorted(starts, rows)])

    def _whole(self, block, rows, ids, bounds):
        """Encodes anew the rows that hold white space beyond ASCII."""
        odd = np.flatnonzero((block[:-1] == 0xC2) & ((block[1:] == 0x85) | (block[1:] == 0xA0)))
        three = np.flatnonzero((block[:-2] == 0xE1) | (block[:-2] == 0xE2) | (block[:-2] == 0xE3)) if len(block) > 2 else np.zeros(0, np.int64)
        a, b, c = (block[three + k] for k in range(3))
        hit = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F))
        hit |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        odd = np.unique(np.searchsorted(rows, np.concatenate((odd, three[hit])), "right") - 1)
        if not len(odd):
            return ids, bounds
        texts = [block[rows[r] : rows[r + 1]].tobytes().decode("utf-8", "replace") for r in odd]
        anew, n = self._raw(texts), np.diff(bounds)
        n[odd] = [len(got) for got in anew]
        if ids is not None:
            parts = [ids[bounds[r] : bounds[r + 1]] for r in range(len(rows) - 1)]
            for r, got in zip(odd, anew, strict=True):
                parts[r] = np.array(got, np.uint16)
            ids = np.concatenate(parts)
        return ids, np.concatenate(([0], np.cumsum(n)))


def _joinable(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Pieces that begin with white space, end in something else, and have no white space outside ASCII: a run of such pieces has the ids of its pieces."""
    out = K._SPACE[data[starts]] & ~K._SPACE[data[ends - 1]]
    lead, then = data[:-1], data[1:]
    odd = ((lead == 0xC2) & ((then == 0x85) | (then == 0xA0))) | ((lead == 0xE1) & (then == 0x9A)) | ((lead == 0xE2) & ((then == 0x80) | (then == 0x81))) | ((lead == 0xE3) & (then == 0x80))
    places = np.flatnonzero(odd)
    if len(places):
        out &= np.searchsorted(places, starts) == np.searchsorted(places, ends)
    return out


def _cuts(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of pieces of about a hashing block each."""
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + K.BLOCK, "right")))
        yield a, b
        a = b


def coder(path: str) -> Coder:
    """The worker's coder for a tokenizer file, with what its cache holds."""
    if path not in _tokenizers:
        _tokenizers[path] = Coder(path)
    return _tokenizers[path]


def default_path() -> str:
    """The public byte-level vocabulary of 50,257 ids that this machine offers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ids followed by ``end``."""
    n = len(bounds) - 1
    to = bounds + np.arange(n + 1)
    out = np.full(len(ids) + n, end, np.uint16)
    out[np.repeat(np.arange(n), np.diff(bounds)) + np.arange(len(ids))] = ids
    return out, to
