"""The number of pages of a PDF, from its cross-reference tables or streams and its page tree."""

from __future__ import annotations

import re
import zlib

_PAGE = re.compile(rb"/Type\s*/Page(?![a-zA-Z])")
_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*[\r\n]\s*)*(<<|>>|\[|\]|\((?:\\.|[^\\()]|\([^()]*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s<>\[\]()/%]*|[^\s<>\[\]()/%]+)", re.S)
#: Bytes of an inflated stream, and links of a chain, that are followed at most.
MAX_STREAM, MAX_CHAIN = 1 << 28, 1 << 12


class Broken(ValueError):
    """Not a PDF that can be followed to its page tree."""


def value(data: bytes, at: int):
    """(a value, the place after it): names and numbers as bytes, dictionaries, lists, and references as ("R", number)."""
    token = _TOKEN.match(data, at)
    if not token:
        raise Broken("no value")
    word, at = token.group(1), token.end()
    if word == b"<<":
        out = {}
        while (mark := _TOKEN.match(data, at)) and mark.group(1) != b">>":
            key, at = value(data, at)
            out[key], at = value(data, at)
        if not mark:
            raise Broken("open dictionary")
        return out, mark.end()
    if word == b"[":
        out = []
        while (mark := _TOKEN.match(data, at)) and mark.group(1) != b"]":
            item, at = value(data, at)
            out.append(item)
        if not mark:
            raise Broken("open list")
        return out, mark.end()
    if word.isdigit() and (ref := re.compile(rb"\s+\d+\s+R(?![^\s<>\[\]()/%])").match(data, at)):
        return ("R", int(word)), ref.end()
    return word, at


def _rows(data: bytes, predictor: int, columns: int) -> bytes:
    """PNG predictors undone."""
    if predictor < 10:
        return data
    out, before = bytearray(), bytearray(columns)
    for a in range(0, len(data), columns + 1):
        kind, line = data[a], bytearray(data[a + 1 : a + 1 + columns])
        for i in range(len(line)):
            left, up, corner = (line[i - 1] if i else 0), before[i], (before[i - 1] if i else 0)
            if kind == 4:
                guess = min((left, up, corner), key=lambda v: abs(left + up - corner - v))
            else:
                guess = {0: 0, 1: left, 2: up, 3: (left + up) // 2}.get(kind, 0)
            line[i] = (line[i] + guess) & 255
        out += line
        before = line + bytearray(columns - len(line))
    return bytes(out)


class File:
    """A PDF's objects, by number."""

    def __init__(self, data: bytes):
        self.data, self.at, self.inside, self.root, self.held = data, {}, {}, None, {}
        found = data.rfind(b"startxref")
        if data[:5] != b"%PDF-" or found < 0:
            raise Broken("no cross reference")
        at, seen = int(value(data, found + 9)[0]), set()
        while at is not None and at not in seen and len(seen) < MAX_CHAIN:
            seen.add(at)
            at = self._section(at, seen)

    def _section(self, at: int, seen: set[int]) -> int | None:
        """Reads a table or a stream of places; those of a newer section stay. Returns where an older one is."""
        word, to = value(self.data, at)
        if word == b"xref":
            word, to = value(self.data, to)
            while word != b"trailer":
                first, (count, to) = int(word), value(self.data, to)
                for n in range(first, first + int(count)):
                    place, to = value(self.data, to)
                    _, to = value(self.data, to)
                    kind, to = value(self.data, to)
                    if kind == b"n" and n not in self.inside:
                        self.at.setdefault(n, int(place))
                word, to = value(self.data, to)
            head, _ = value(self.data, to)
            if (hybrid := head.get(b"/XRefStm")) and int(hybrid) not in seen:
                seen.add(int(hybrid))
                self._section(int(hybrid), seen)
        else:
            head, body = self._object(at)
            widths = [int(w) for w in head[b"/W"]]
            ranges = [int(i) for i in head.get(b"/Index", [b"0", head[b"/Size"]])]
            row = 0
            for first, count in zip(ranges[::2], ranges[1::2], strict=True):
                for n in range(first, first + count):
                    cells, a = [], row * sum(widths)
                    for w in widths:
                        cells.append(int.from_bytes(body[a : a + w], "big"))
                        a += w
                    row += 1
                    kind = cells[0] if widths[0] else 1
                    if n in self.at or n in self.inside:
                        continue
                    if kind == 1:
                        self.at[n] = cells[1]
                    elif kind == 2:
                        self.inside[n] = (cells[1], cells[2])
        self.root = self.root or head.get(b"/Root")
        before = head.get(b"/Prev")
        return int(before) if before is not None else None

    def _object(self, at: int) -> tuple[object, bytes]:
        """(value, inflated stream) of the object at a place."""
        mark = re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.data, at)
        if not mark:
            raise Broken("no object")
        got, to = value(self.data, mark.end())
        body = re.compile(rb"\s*stream(\r\n|\n|\r)").match(self.data, to)
        if not body or not isinstance(got, dict):
            return got, b""
        length = self.get(got.get(b"/Length", b"0"))
        raw = self.data[body.end() : body.end() + int(length)]
        kind = got.get(b"/Filter")
        kind = kind[0] if isinstance(kind, list) and len(kind) == 1 else kind
        if kind is None or kind == []:
            return got, raw
        if kind != b"/FlateDecode":
            raise Broken("another filter")
        how = got.get(b"/DecodeParms", {})
        how = how[0] if isinstance(how, list) else how
        raw = zlib.decompressobj().decompress(raw, MAX_STREAM)
        return got, _rows(raw, int(how.get(b"/Predictor", b"1")), int(how.get(b"/Columns", b"1"))) if isinstance(how, dict) else raw

    def get(self, ref):
        """What a reference stands for; anything else is itself."""
        if not (isinstance(ref, tuple) and ref[0] == "R"):
            return ref
        n = ref[1]
        if n not in self.held:
            self.held[n] = None  # an object that needs itself has no value
            if n in self.at:
                self.held[n] = self._object(self.at[n])[0]
            elif n in self.inside:
                holder, k = self.inside[n]
                head, body = self._object(self.at[holder])
                places = [int(x) for x in body[: int(self.get(head[b"/First"]))].split()]
                self.held[n] = value(body, int(self.get(head[b"/First"])) + places[2 * k + 1])[0]
        return self.held[n]


def count_pages(data: bytes) -> int:
    """The page tree's count; where that can't be followed, the page objects that stand in the bytes; 0 for anything else."""
    try:
        file = File(data)
        tree = file.get(file.get(file.root)[b"/Pages"])
        return max(0, int(file.get(tree[b"/Count"])))
    except (ValueError, KeyError, TypeError, IndexError, zlib.error, RecursionError, AttributeError):
        return len(_PAGE.findall(data)) if data[:5] == b"%PDF-" else 0
