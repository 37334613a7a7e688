"""Alignment of two tokenizers over the same bytes: groups of tokens that end together, links of tokens that overlap.

A text is encoded twice, as a byte-level BPE's ids of space + text (A) and as a piece model's ids of the text (B, which adds that space).
Both cut the same bytes, so an Arrow batch is laid out as one run of bytes with the offsets of its documents: the ends of all tokens of
A and of B are counted once each (``bincount``), a cut is where both end, a link where either ends (the bytes between two such places
belong to one token of each, and no pair of tokens meets in two of them). Sums of those marks up to a document's end, less those up to
its beginning, are its numbers of groups and links.

Corpus-wide counts of linked id pairs reach the links by a block join: a block of links names its distinct pairs once, with their number;
they are summed by pair, met by the highest count of their B id, and come back to the block. No table of pairs is broadcast or collected.
Encoded blocks are written in the shared folder, so texts are encoded once and a lost executor costs no encoding.

Edge cases: a null or empty text, and one whose tokens' bytes aren't space + text (a text with U+2581, for instance), has no tokens:
zeros, and an empty digest. Strings of special tokens are plain text. Repeated rows are rows each, and count each; a null id is an id;
ids may be of any type; a text of any length is encoded whole and is one block if it must. An empty table gives no row. Only the id and
text columns are read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .session import bounded, cut, tidy
from .tokens import coder, default_path

#: Links of a block before it is closed.
BLOCK_LINKS = 1 << 22
#: Texts go to the piece model in parts of so many bytes, since ids come back as Python numbers.
PART = 1 << 20
_EMPTY = np.zeros(0, np.int64)


def piece_path() -> str:
    """The public piece vocabulary of 32,000 ids that this machine offers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Bytes:
    """The bytes of each id of a vocabulary, laid end to end."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        to = np.cumsum(size)
        return self.flat[np.repeat(self.start[ids] - to + size, size) + np.arange(int(to[-1]) if len(to) else 0)]


@functools.cache
def byte_level(path: str) -> Bytes:
    """Entries of a byte-level vocabulary, their letters read as the bytes they stand for."""
    vocab = coder(path).tokenizer.get_vocab(with_added_tokens=True)
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}  # fixed: bytes that stand for themselves; the rest follow from 256
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    return Bytes(out)


@functools.cache
def pieces(path: str):
    """The piece model and the bytes of its ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = ((model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size()))
    return model, Bytes([bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in names])


def _piece_ids(model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds by row)."""
    _, off = K.raw(texts)
    ids, sizes, i, n = [_EMPTY], [], 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + PART, "right")) - 1)
        got = model.encode(texts.slice(i, j - i).to_pylist(), num_threads=1)
        sizes += map(len, got)
        ids += [np.array(g, np.int64) for g in got]
        i = j
    return np.concatenate(ids), np.concatenate(([0], np.cumsum(np.array(sizes, np.int64))))


def _take(ids: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the kept rows."""
    size = np.diff(bounds)
    return ids[np.repeat(keep, size)], np.concatenate(([0], np.cumsum(np.where(keep, size, 0))))


class Aligned:
    """Rows of texts, encoded by both and aligned. Arrays by row have a row more for the end; rows without tokens have none of anything."""

    def __init__(self, texts: pa.Array, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], kinds: tuple[Bytes, Bytes]):
        data, off = K.raw(texts)
        size = np.diff(off) + 1
        keep = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
        sides = [(ids.astype(np.int64), bounds) for ids, bounds in (a, b)]
        for (ids, bounds), kind in zip(sides, kinds, strict=True):
            keep = keep & (K.sums(kind.size[ids], bounds) == size)
        base = np.concatenate(([0], np.cumsum(np.where(keep, size, 0))))  # documents' byte offsets in the run of all of them
        run = np.full(int(base[-1]), 32, np.uint8)
        inside = np.ones(len(run), bool)
        inside[base[:-1][keep]] = False
        run[inside] = data[int(off[0]) : int(off[-1])][np.repeat(keep, np.diff(off))] if len(data) else 0
        sides = [_take(*s, keep) for s in sides]
        wrong = sum((kind.joined(ids) != run).astype(np.int64) for (ids, _), kind in zip(sides, kinds, strict=True))
        if np.any(wrong):
            still = K.sums(np.asarray(wrong), base) == 0
            sides = [_take(*s, still) for s in sides]
            base = np.concatenate(([0], np.cumsum(np.where(still, np.diff(base), 0))))
        (self.a, self.a_of), (self.b, self.b_of) = sides
        n = int(base[-1]) + 1
        ends = [np.bincount(np.cumsum(kind.size[ids]), minlength=n)[:n] for (ids, _), kind in zip(sides, kinds, strict=True)]
        for e in ends:
            e[0] = 0
        both, some = (ends[0] & ends[1]) > 0, (ends[0] | ends[1]) > 0
        self.cut, at = np.flatnonzero(both), np.flatnonzero(some)
        upto = [np.cumsum(e) for e in ends]
        # tokens that end before a place: the number of the token that covers the bytes up to it
        self.link_a, self.link_b = self.a[upto[0][at - 1]], self.b[upto[1][at - 1]]
        self.group_a, self.group_b = upto[0][self.cut], upto[1][self.cut]  # tokens up to each group's end
        self.groups_of, self.links_of = np.cumsum(both)[base], np.cumsum(some)[base]


def aligned(texts: pa.Array, a_path: str, b_path: str):
    """(lo, hi, Aligned) for consecutive blocks of rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    model, b_bytes = pieces(b_path)
    led = pc.binary_join_element_wise(" ", pc.fill_null(texts, ""), "")
    for lo, hi, ids, bounds in coder(a_path).encode(led):
        part = texts.slice(lo, hi - lo)
        yield lo, hi, Aligned(part, (ids, bounds), _piece_ids(model, pc.fill_null(part, "")), (byte_level(a_path), b_bytes))


def _split(values: np.ndarray, bounds: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32), pa.int32()), pa.array(values, kind))


def _shape(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    rows = bounded(docs).select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    return rows, rows.schema["id"].dataType.simpleString()


def groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, a, b, a_ends, b_ends): each text's ids by both, and for each group how many of A's and of B's ids lie up to its end."""
    a_path, b_path = a_path or default_path(), b_path or piece_path()
    rows, kind = _shape(docs, id_col)

    def run(batches):
        for batch in batches:
            for lo, hi, x in aligned(batch.column("text"), a_path, b_path):
                row = np.repeat(np.arange(hi - lo), np.diff(x.groups_of))
                ends = [_split(g - of[row], x.groups_of, pa.int32()) for g, of in ((x.group_a, x.a_of), (x.group_b, x.b_of))]
                out = [batch.column("id").slice(lo, hi - lo), _split(x.a, x.a_of, pa.int32()), _split(x.b, x.b_of, pa.int32()), *ends]
                yield pa.RecordBatch.from_arrays(out, ["id", "a", "b", "a_ends", "b_ends"])

    return rows.mapInArrow(tidy(run), f"id {kind}, a array<int>, b array<int>, a_ends array<int>, b_ends array<int>").withColumnRenamed("id", id_col)


@functools.cache
def _decimals(n: int, sep: str) -> list[str]:
    return [f"{i}{sep}" for i in range(n)]


def digests(x: Aligned, n_a: int, n_b: int) -> list[str]:
    """Each row's SHA-256 of its groups as decimal ids, ``a1,a2|b1;a3|b2``; an empty text without tokens."""
    words = _decimals(n_a, ",") + _decimals(n_a, "|") + _decimals(n_b, ",") + _decimals(n_b, ";")
    a, b = x.a.copy(), x.b + 2 * n_a
    a[x.group_a - 1] += n_a
    b[x.group_b - 1] += n_b
    sizes = [np.diff(g, prepend=0) for g in (x.group_a, x.group_b)]
    # a token's place: its own number, and the other side's tokens of the groups before it (and, for B, of its own)
    before_a, before_b = np.repeat(x.group_b - sizes[1], sizes[0]), np.repeat(x.group_a, sizes[1])
    line = np.empty(len(a) + len(b), np.int64)
    line[np.arange(len(a)) + before_a], line[np.arange(len(b)) + before_b] = a, b
    text = list(map(words.__getitem__, line.tolist()))
    of = (x.a_of + x.b_of).tolist()
    return [hashlib.sha256("".join(text[s:e])[:-1].encode()).hexdigest() if e > s else "" for s, e in zip(of[:-1], of[1:], strict=True)]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _encoded(a_path: str, b_path: str, size: int, most: int):
    """Blocks of rows: their ids, counts and digests as arrays, and their links as one compressed run of pair numbers (a * size + b)."""

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, sums, shas, links = [], [], [], []

        def block():
            nonlocal seq
            counts = np.concatenate(sums, axis=1)
            run_, keys = np.concatenate(links).astype("<u4"), pa.chunked_array(ids).combine_chunks()
            one = pa.array(np.array([0, len(keys)], np.int32))
            cols = [pa.array([(part << 31) + seq]), pa.ListArray.from_arrays(one, keys), pa.array([[h for s in shas for h in s]], pa.list_(pa.string()))]
            cols += [pa.ListArray.from_arrays(one, pa.array(c)) for c in counts]
            cols += [pa.array([len(run_)]), pa.array([pa.compress(run_.tobytes(), "zstd", asbytes=True)], pa.binary())]
            seq += 1
            for held in (ids, sums, shas, links):
                held.clear()
            return pa.RecordBatch.from_arrays(cols, ["block", "id", "groups_sha256", *_COUNTS, "total", "links"])

        for batch in batches:
            for lo, hi, x in aligned(batch.column("text"), a_path, b_path):
                ids.append(batch.column("id").slice(lo, hi - lo))
                sums.append(np.stack([np.diff(of) for of in (x.a_of, x.b_of, x.groups_of, x.links_of)]))
                shas.append(digests(x, len(byte_level(a_path).size), size))
                links.append(x.link_a * size + x.link_b)
                if sum(map(len, links)) >= most:
                    yield block()
        if ids:
            yield block()

    return run


def _pairs(blob: pa.Scalar, total: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob.as_buffer(), 4 * total, "zstd"), "<u4")


def _named(batches):
    """(block, pair, n): the distinct pairs of each block."""
    for batch in batches:
        for k in range(batch.num_rows):
            pair, n = np.unique(_pairs(batch.column("links")[k], batch.column("total")[k].as_py()), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), batch.column("block")[k].as_py())), pa.array(pair.astype(np.int64)), pa.array(n)], ["block", "pair", "n"])


def _summed(blocks: pa.Table, known: pa.Table) -> pa.Table:
    """The rows of a block with their sums over links."""
    out = []
    pair, count, best = (known.column(c).to_numpy() for c in ("pair", "count", "best"))
    order = np.argsort(pair)
    pair, count, best = pair[order], count[order], best[order].astype(np.int64)
    for batch in blocks.to_batches():
        for k in range(batch.num_rows):
            at = np.searchsorted(pair, _pairs(batch.column("links")[k], batch.column("total")[k].as_py()))
            lists = {c: batch.column(c)[k].values for c in ("id", *_COUNTS, "groups_sha256")}
            of = np.concatenate(([0], np.cumsum(lists["n_links"].to_numpy())))
            out.append(pa.table({**lists, "n_best": K.sums(best[at], of), "count_sum": K.sums(count[at], of)}))
    return pa.concat_tables(out)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", block_links: int = BLOCK_LINKS) -> DataFrame:
    """One row a text: id, n_a, n_b, n_groups, n_links, n_best (links whose pair has its B id's highest count), count_sum (over links), groups_sha256."""
    a_path, b_path = a_path or default_path(), b_path or piece_path()
    rows, kind = _shape(docs, id_col)
    size = len(pieces(b_path)[1].size)
    lists = ", ".join(f"{c} array<long>" for c in _COUNTS)
    blocks = cut(rows.mapInArrow(tidy(_encoded(a_path, b_path, size, block_links)), f"block long, id array<{kind}>, groups_sha256 array<string>, {lists}, total long, links binary"))
    named = blocks.where("total > 0").select("block", "links", "total").mapInArrow(tidy(_named), "block long, pair long, n long")
    counts = named.groupBy("pair").agg(F.sum("n").alias("count"))
    b = (F.col("pair") % size).alias("b")
    high = counts.groupBy(b).agg(F.max("count").alias("high"))
    marked = counts.withColumn("b", b).join(high, "b").select("pair", "count", (F.col("count") == F.col("high")).alias("best"))
    known = named.select("block", "pair").join(marked, "pair")
    schema = f"id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, groups_sha256 string, n_best long, count_sum long"
    out = blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(tidy(_summed), schema)
    return out.withColumnRenamed("id", id_col)
