"""Secret scan with a recursive decoding worklist (operator 7).

A text is scanned for assignments, access keys and long hex runs. Then its encoded stretches are unwrapped: percent codes,
Unicode escapes, base64, and gzip, zlib, bzip2 or xz data inside base64. Codes are decoded together with the words
beside them, so an assignment may have some of its parts encoded and spaces between them. Base64 is joined over line ends
and read from every start, and of compressed data all members are read, and what comes before damage. Each decoded layer joins a worklist, is
scanned by the same rules and unwrapped again, until no new layer comes up. A layer is left out only if the same stretch of
the root text has given the same text before, so cycles end and equal stretches at several places are all reported. Each
decoded character keeps the stretch of the root text that it came from, so a finding in any layer has a span there; what was
compressed maps to its whole encoded stretch, and what is inside equal compressed texts is worked out once for a document.

Memory: what inflates to over `limit` bytes is read in windows of that size, which end at a sign that no rule can go across, so
nothing is lost. Only where there is no such sign in a whole window is it cut; windows then overlap by OVERLAP bytes, and the
encoded stretch is reported whole as well, as kind `packed`. A long text is held whole, with two numbers for each character of
a layer.

Spans are code points of the root text, end exclusive, ordered by start, then kind as listed, then end.

Defined cases: a null text is empty and has no findings. Rows with the same doc_id, and equal rows, each get a row. An
empty table gives an empty result.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Generator, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparloom.llm.common import free_name, per_text

KINDS = ("assign", "access", "hex", "packed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of 32 or more are those of [0-9a-f]+ that are long enough
#: One of them, in lower case, is in every assignment.
CUES = ("passw", "secret", "token", "apikey", "api_key")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
ONE_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|[uUx]([0-9A-Fa-f]+))")
#: Lines of base64 that follow each other are joined; any of them may be short.
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+|[A-Za-z0-9+/_-]++(?=~[A-Za-z0-9+/_-]))(?:~[A-Za-z0-9+/_-]++)*+={0,2}".replace("~", r"[\x20\t]*+(?:\r\n|\n|\r)[\x20\t]*+"))
LINE = re.compile("[A-Za-z0-9+/_-]+")
STANDARD = str.maketrans("-_", "+/")
#: Findings and encoded stretches consist of these bytes, and none has fewer than LEAST.
LEAST = 14
READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{14,}")
RUN = re.compile(r"\S+")
LINE_END = re.compile(r"[\x20\t]*(?:\r\n|\n|\r)[\x20\t]*")
MAGIC = {b"\x1f\x8b": "gzip", b"x\x01": "zlib", b"x\x5e": "zlib", b"x\x9c": "zlib", b"x\xda": "zlib", b"BZh": "bzip2", b"\xfd7zXZ": "xz"}
PACKED_START = re.compile(b"|".join(map(re.escape, MAGIC)))
PACKED = frozenset(MAGIC.values())
MAX_LAYER = 32 << 20
OVERLAP = 1 << 20
#: 1 for the ASCII signs that stand in no rule and no code.
ENDS_RULES = bytes(int(c < 128 and not chr(c).isalnum() and chr(c) not in "+/_.=-\"' :%\\{}\t\n\r\x0b\x0c") for c in range(256))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), leftmost and non-overlapping for each kind, ordered."""
    out = []
    low = text.lower()
    if any(c in low for c in CUES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A text with the root span of each character; None stands for the root itself.

    `known` are base spans of the layer around this one, in its characters, and `at` and `to` the stretch there of each
    character here: a layer of codes holds their neighbourhood too, and what was found there without them isn't found again.
    """

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> None:
        self.text, self.starts, self.ends = text, starts, ends
        self.known: set[tuple[int, int, int]] = set()
        self.at = self.to = None

    def root(self, a: int, b: int) -> tuple[int, int]:
        """The root span of characters a to b; they may come out of one stretch."""
        if self.starts is None:
            return a, b
        return int(self.starts[a:b].min()), int(self.ends[a:b].max())

    def inner(self, text: str, a: np.ndarray, b: np.ndarray) -> Layer:
        """A layer whose characters come from stretches a to b (arrays) of this one."""
        if self.starts is None:
            return Layer(text, a, b)
        return Layer(text, self.starts[a], self.ends[b - 1])

    def spans(self) -> list[tuple[int, int, int]]:
        """Base spans of the text, but for those that stand in the layer around it as they are, with no code beside them."""
        found = base_spans(self.text)
        if not self.known:
            return found
        plain = lambda i: not 0 <= i < len(self.text) or self.to[i] - self.at[i] == 1
        return [(a, k, b) for a, k, b in found if (int(self.at[a]), k, int(self.to[b - 1])) not in self.known or not (plain(a - 1) and plain(b))]


def decoded(layer: Layer, codes: re.Pattern, decode) -> Iterator[Layer]:
    """Layers with all codes of a part decoded: all that a match or a base64 run with one of the codes in it may cover.

    An assignment has up to two stretches of spaces in it, so a part is the run without white space around the codes and two
    runs more on each side, over spaces only; and over line ends, as base64 is wrapped, any number of runs. Parts that
    share a run are one.
    """
    text = layer.text
    found = list(codes.finditer(text))
    if not found:
        return
    known = set(base_spans(text))
    runs = [m.span() for m in RUN.finditer(text)]
    gaps = [text[a:b] for (_, a), (b, _) in pairwise(runs)]
    near, wrap = [not g.strip(" ") for g in gaps], [LINE_END.fullmatch(g) is not None for g in gaps]

    last_line = list(range(len(runs)))
    for i in range(len(gaps) - 1, -1, -1):
        if wrap[i]:
            last_line[i] = last_line[i + 1]

    def right_of(i: int) -> int:
        return last_line[i] if last_line[i] > i else i + (i < len(gaps) and near[i]) * (1 + (i + 1 < len(gaps) and near[i + 1]))

    def left_of(i: int) -> int:
        if i and wrap[i - 1]:
            while i and wrap[i - 1]:
                i -= 1
            return i
        return i - (i > 0 and near[i - 1]) * (1 + (i > 1 and near[i - 2]))

    parts: list[list[int]] = []
    i, last = 0, -1
    for m in found:
        while runs[i][1] <= m.start():
            i += 1
        if i == last:
            continue
        last = i
        left = i if parts and parts[-1][1] >= i else left_of(i)
        right = right_of(i)
        if parts and left <= parts[-1][1]:
            parts[-1][1] = max(parts[-1][1], right)
        else:
            parts.append([left, right])
    k = 0
    for left, right in parts:
        here, end = runs[left][0], runs[right][1]
        out, a, b = [], [], []
        while k < len(found) and found[k].start() < end:
            m = found[k]
            chars = decode(m[0], m.start())
            out += [text[here : m.start()], "".join(c for c, _, _ in chars)]
            a += [np.arange(here, m.start()), np.array([x for _, x, _ in chars], np.int64)]
            b += [np.arange(here + 1, m.start() + 1), np.array([y for _, _, y in chars], np.int64)]
            here, k = m.end(), k + 1
        at, to = np.concatenate([*a, np.arange(here, end)]), np.concatenate([*b, np.arange(here + 1, end + 1)])
        inner = layer.inner("".join([*out, text[here:end]]), at, to)
        inner.known, inner.at, inner.to = known, at, to
        yield inner


def utf8_chars(data: bytes, offset: int, step: int) -> list[tuple[str, int, int]]:
    """Characters of bytes that stand `step` characters apart from offset on; bad bytes become U+FFFD."""
    out, i = [], 0
    for c in data.decode("utf-8", "surrogateescape"):
        n = 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
        out.append(("\ufffd" if "\udc80" <= c <= "\udcff" else c, offset + step * i, offset + step * (i + n)))
        i += n
    return out


def escaped_chars(run: str, offset: int) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    for m in ONE_ESCAPE.finditer(run):
        code = int(m[1] or m[2], 16)
        if out and 0xDC00 <= code < 0xE000 and "\ud800" <= out[-1][0] <= "\udbff":
            high = out.pop()
            out.append((chr(0x10000 + (ord(high[0]) - 0xD800 << 10) + code - 0xDC00), high[1], offset + m.end()))
        else:
            out.append((chr(code) if code < 0x110000 else "\ufffd", offset + m.start(), offset + m.end()))
    return [("\ufffd" if "\ud800" <= c <= "\udfff" else c, a, b) for c, a, b in out]


def outputs(data: memoryview, kind: str) -> Generator[bytes, None, int]:
    """What the member at the start inflates to, piece by piece; returns the bytes it takes, 0 if it is cut off or damaged.

    Of damaged data there is what comes before the damage.
    """
    made = {"gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor}[kind]()
    step, most = 256, 1 << 20
    try:
        for at in range(0, len(data), step):
            chunk = bytes(data[at : at + step])
            while True:
                out = made.decompress(chunk, most)
                if out:
                    yield out
                if made.eof:
                    return min(at + step, len(data)) - len(made.unused_data)
                chunk = getattr(made, "unconsumed_tail", b"")
                if not chunk and len(out) < most:
                    break
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        pass
    return 0


def all_outputs(data: bytes, start: int) -> Generator[bytes, None, int]:
    """The pieces of all members from start on; returns where they end, -1 if the last is cut off or damaged."""
    view, at = memoryview(data), start
    while m := PACKED_START.match(data, at):
        got = False
        member = outputs(view[at:], MAGIC[m[0]])
        try:
            while True:
                out = next(member)
                got = True
                yield out
        except StopIteration as end:
            used = end.value
        if not used:
            return at if at > start and not got else -1
        at += used
        while data[at : at + 4] == bytes(4):  # padding between streams of xz
            at += 4
    return at


def unpack(data: bytes, start: int, limit: int) -> tuple[bytes | None, int]:
    """What all members from start on inflate to (None if that is over `limit`; it isn't held then), and where they end."""
    parts, size, pieces = [], 0, all_outputs(data, start)
    while True:
        try:
            out = next(pieces)
        except StopIteration as end:
            return (b"".join(parts) if size <= limit else None), end.value
        size += len(out)
        parts = [*parts, out] if size <= limit and len(parts) < 64 else [b"".join(parts) + out] if size <= limit else []


def windows(data: bytes, start: int, limit: int) -> Iterator[tuple[bytes, bool]]:
    """What is inflated, in windows of about `limit` bytes that end where no rule can go on, so nothing is cut.

    True: the window has no such place; the next one begins a bit before its end.
    """
    rest = b""
    for out in all_outputs(data, start):
        rest += out
        if len(rest) >= limit:
            cut = rest.translate(ENDS_RULES).rfind(b"\1") + 1
            yield (rest[:cut], False) if cut else (rest, True)
            rest = rest[cut:] if cut else rest[-max(1, min(OVERLAP, limit // 2)) :]
    if rest:
        yield rest, False


def in_base64(layer: Layer, core: str, at: np.ndarray, end: int, limit: int) -> Iterator[tuple[str, Layer | tuple[int, int]]]:
    """What the characters of base64, which stand at the places `at`, hold; what goes on to their end maps to `end`.

    Path signs or letters may stand before or after a code, so all four alignments are decoded; of each, all readable parts
    and all compressed data are taken, whatever is around them.
    """
    for shift in range(4):
        n = len(core) - shift
        n -= n % 4 == 1
        data = binascii.a2b_base64(core[shift : shift + n] + "=" * (-n % 4))
        if len(data) < LEAST - 2:
            break
        to = lambda j: int(at[min(shift - (-j * 4 // 3), len(core)) - 1]) + 1
        done = 0
        for m in PACKED_START.finditer(data):
            if m.start() < done or m.start() % 3:  # a code begins with a group
                continue
            plain, stop = unpack(data, m.start(), limit)
            if plain is not None and len(plain) < LEAST:
                continue
            a, b = int(at[shift + m.start() // 3 * 4]), to(stop) if 0 <= stop < len(data) else end
            for part, cut in [(plain, False)] if plain is not None else windows(data, m.start(), limit):
                inside = part.decode("utf-8", "replace")
                yield MAGIC[m[0]], layer.inner(inside, np.full(len(inside), a), np.full(len(inside), b))
                if cut:
                    yield "packed", (a, b)
            done = max(done, stop)
        for m in READABLE.finditer(data):
            j = np.arange(m.start(), m.end())
            yield "base64", layer.inner(m[0].decode(), at[shift + j * 4 // 3], at[np.minimum(shift - (-(j + 1) * 4 // 3), len(core)) - 1] + 1)


def unwrapped(layer: Layer, limit: int) -> Iterator[tuple[str, Layer | tuple[int, int]]]:
    """(coding, layer inside), and ("packed", stretch) for what had to be cut somewhere."""
    text = layer.text
    if "%" in text:
        for inside in decoded(layer, PERCENT, lambda run, at: utf8_chars(bytes.fromhex(run.replace("%", "")), at, 3)):
            yield "url", inside
    if "\\" in text:
        for inside in decoded(layer, ESCAPE, escaped_chars):
            yield "unicode", inside
    for m in BASE64.finditer(text):
        lines = [x.span() for x in LINE.finditer(m[0])]
        if sum(b - a for a, b in lines) < 16:
            continue
        # lines that only follow each other are codes of their own
        for part in [lines, *([x] for x in lines if len(lines) > 1 and x[1] - x[0] >= 16)]:
            core = "".join(m[0][a:b] for a, b in part).translate(STANDARD)
            at = m.start() + np.concatenate([np.arange(a, b) for a, b in part])
            yield from in_base64(layer, core, at, m.end() if part[-1] == lines[-1] else int(at[-1]) + 1, limit)


def contents(text: str, limit: int) -> set[tuple[int, str]]:
    """(kind, codings) of what a compressed text holds; all of it has one stretch in the root, so a text is taken once."""
    found, seen, work = set(), {text}, [(Layer(text), "")]
    while work:
        layer, path = work.pop()
        found |= {(k, path) for _, k, _ in layer.spans()}
        for coding, inner in unwrapped(layer, limit):
            way = f"{path}>{coding}".lstrip(">")
            if coding == "packed":
                found.add((3, way))
            elif inner.text not in seen:
                seen.add(inner.text)
                work.append((inner, way))
    return found


def scan(text: str, limit: int = MAX_LAYER) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str]]]:
    """Base spans (start, kind, end), and those of the layers inside (start, kind, end, codings from the outside in)."""
    base = base_spans(text)
    found, seen, inside, work = set(), {(0, len(text), text)}, {}, [(Layer(text), "")]
    while work:
        layer, path = work.pop()
        if path:
            found |= {((r := layer.root(a, b))[0], k, r[1], path) for a, k, b in layer.spans()}
        for coding, inner in unwrapped(layer, limit):
            way = f"{path}>{coding}".lstrip(">")
            if coding == "packed":
                a, b = layer.root(*inner)
                found.add((a, 3, b, way))
                continue
            a, b = inner.root(0, len(inner.text))
            if coding in PACKED:
                key = hashlib.sha256(inner.text.encode()).digest()
                if key not in inside:
                    inside[key] = contents(inner.text, limit)
                found |= {(a, k, b, f"{way}>{p}".rstrip(">")) for k, p in inside[key]}
            elif (a, b, inner.text) not in seen:
                seen.add((a, b, inner.text))
                work.append((inner, way))
    return base, sorted(found)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = MAX_LAYER) -> DataFrame:
    """Per row of docs: doc_id, base and inner: arrays of (kind string, start, end long, codings string)."""
    ident = free_name(docs, "_doc")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("codings", pa.string())]))

    def make():
        def work(texts):
            got = [scan(t.decode("utf-8", "replace"), limit) for t in texts]
            rows = lambda spans: [{"kind": KINDS[k], "start": a, "end": b, "codings": p} for a, k, b, p in spans]
            return {"base": pa.array([rows((*s, "") for s in b) for b, _ in got], kind), "inner": pa.array([rows(i) for _, i in got], kind)}

        return work

    span = "array<struct<kind:string,start:long,end:long,codings:string>>"
    return per_text(docs.withColumn(ident, docs[id_col]), text_col, [ident], f"base {span}, inner {span}", make).withColumnRenamed(ident, "doc_id")
