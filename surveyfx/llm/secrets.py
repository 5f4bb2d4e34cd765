"""Secrets in texts, also where they hide in encoded layers.

A text is scanned for three kinds of secret. Then a worklist takes it apart: URL escapes and Unicode escapes are undone over the whole layer; runs
of base64 letters, wrapped into lines or not, are decoded (UTF-8 or UTF-16) and, where they turn out compressed, unpacked with all members. Every layer that comes out is scanned in the same way and taken apart in
turn, until nothing new comes up. A layer that stands at several places is taken apart once and counts at each; only a layer within itself is not
taken apart again. What is found in a layer is mapped back, layer by layer, to the
characters of the original text that it came from. Spans count code points, ends are exclusive.

A null or empty text has no spans. Texts are scanned whole. A compressed layer is unpacked up to `LAYER_BYTES`; beyond, it is left packed and counted
in `too_large`, so that a bomb cannot take a worker down. Repeated rows are treated alike; the added column replaces one of its name.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyfx.llm.common import without

#: The kinds in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16
ASSIGN_HINTS = ("passw", "secret", "token", "api")
#: Largest layer that is unpacked.
LAYER_BYTES = 1 << 26

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 in lines, as mail and key files wrap it.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{48,128}(?:\r?\n[A-Za-z0-9+/_-]{2,128})+={0,2}(?![A-Za-z0-9+/_=-])")
LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Where a run decodes to no text: what stands between its separators, all ways to read it.
PIECES = [re.compile(p) for p in (r"[A-Za-z0-9+/]{16,}={0,2}", r"[A-Za-z0-9_-]{16,}={0,2}", r"[A-Za-z0-9]{16,}={0,2}")]
SEPARATOR = re.compile(r"[+/_-]")
#: Text within decoded bytes, and how compressed bytes begin.
READABLE = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){8,}")
PACKED = (b"\x1f\x8b", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda", b"BZh", b"\xfd7zXZ")
UNPRINTABLE = re.compile(r"[\x00-\x08\x0e-\x1f\x7f-\x9f�]")

Origin = Callable[[int, int], tuple[int, int]]


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans that stand in a text as it is."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def plain_escape(run: str) -> str | None:
    """What a run of escapes stands for; None if it is no text."""
    try:
        if run[0] == "%":
            return bytes.fromhex(run.replace("%", "")).decode(errors="replace")
        if run.startswith("\\x"):
            return bytes.fromhex(run.replace("\\x", "")).decode(errors="replace")
        if run.startswith("\\u{"):
            return chr(int(run[3:-1], 16)).encode().decode()
        if run[0] == "\\":
            return bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be")
        return chr(int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1])).encode().decode()
    except (ValueError, OverflowError):
        return None


def unescaped(text: str, pattern: re.Pattern) -> tuple[str, Origin] | None:
    """The layer under the escapes, and the way back to this text's positions."""
    parts, new, old, at, size = [], [0], [0], 0, 0
    whole = [True]
    for m in pattern.finditer(text):
        plain = plain_escape(m[0])
        if plain is None:
            continue
        parts += [text[at : m.start()], plain]
        size += m.start() - at
        new.append(size)
        old.append(m.start())
        whole.append(False)
        size += len(plain)
        new.append(size)
        old.append(m.end())
        whole.append(True)
        at = m.end()
    if not at:
        return None
    parts.append(text[at:])

    def origin(start: int, end: int) -> tuple[int, int]:
        k, j = bisect_right(new, start) - 1, bisect_right(new, end - 1) - 1
        first = old[k] + (start - new[k] if whole[k] else 0)
        return first, (old[j] + end - new[j] if whole[j] else old[j + 1])

    return "".join(parts), origin


def unpacked(data: bytes) -> bytes | None:
    """Compressed bytes in plain, all members; the bytes themselves if they are not compressed; None if the plain layer is too large."""
    parts, rest, room = [], data, LAYER_BYTES
    try:
        while rest:
            if rest[:2] == b"\x1f\x8b" or rest[:1] == b"\x78" and len(rest) > 2 and int.from_bytes(rest[:2], "big") % 31 == 0:
                unzip = zlib.decompressobj(47)
            elif rest[:3] == b"BZh":
                unzip = bz2.BZ2Decompressor()
            elif rest[:6] == b"\xfd7zXZ\x00":
                unzip = lzma.LZMADecompressor()
            else:
                break
            if room <= 0:
                return None
            parts.append(unzip.decompress(rest, room))
            room -= len(parts[-1])
            if not unzip.eof and room <= 0:
                return None
            rest = unzip.unused_data if unzip.eof else b""
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        pass
    return b"".join(parts) if parts else data


def printable(data: bytes) -> tuple[str, str] | None:
    """Text and its encoding. UTF-16 is tried where at least half of the high bytes are zero."""
    for codec, high in (("utf-8", None), ("utf-16-le", 1), ("utf-16-be", 0)):
        if high is not None and (len(data) % 2 or 4 * data[high::2].count(0) < len(data)):
            continue
        try:
            text = data.decode(codec)
        except UnicodeDecodeError:
            continue
        if text and not UNPRINTABLE.search(text):
            return text, codec
    return None


def decoded_run(text: str, start: int, end: int) -> tuple[str | None, Origin | None, bool]:
    """The layer in a run of base64 letters, the way back, and whether it was too large."""
    run = text[start:end].rstrip("=")
    if len(run) % 4 == 1:
        return None, None, False
    data = run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4)
    try:
        raw = binascii.a2b_base64(data)
    except binascii.Error:
        return None, None, False
    plain, packed = raw, False
    while (inner := unpacked(plain)) is not plain:
        packed = True
        if inner is None:
            return None, None, True
        plain = inner
    # what was packed was meant; bytes that are no text stay as marks in it
    layer, codec = printable(plain) or (plain.decode(errors="replace") if packed else "", "utf-8")
    if not layer:
        return None, None, False

    def origin(a: int, b: int) -> tuple[int, int]:
        if packed:
            return start, end
        first, last = len(layer[:a].encode(codec)), len(layer[:b].encode(codec))
        return start + first // 3 * 4, min(end, start + -(-last // 3) * 4)

    return layer, origin, False


def decoded_parts(text: str, start: int, end: int) -> tuple[list[tuple[str, Origin]], int]:
    """The layers in a run that decodes to no text as a whole: between its separators, behind one of them, and at every alignment; and how many were too large."""
    run, under, large = text[start:end], [], 0
    places = {(start + x.start(), start + x.end()) for pattern in PIECES for x in pattern.finditer(run)} - {(start, end)}
    # compressed bytes may hold separators themselves
    for x in SEPARATOR.finditer(run):
        head = run[x.end() : x.end() + 8].replace("-", "+").replace("_", "/")
        if len(head) == 8 and "=" not in head and binascii.a2b_base64(head).startswith(PACKED):
            places.add((start + x.end(), end))
    taken = []
    for first, last in sorted(places):
        layer, origin, over = decoded_run(text, first, last)
        large += over
        if layer:
            under.append((layer, origin))
            taken.append((first, last))
    for shift in range(4):
        letters = run[shift:].rstrip("=").replace("-", "+").replace("_", "/")
        letters = letters[: len(letters) - (len(letters) % 4 == 1)]
        raw = binascii.a2b_base64(letters + "=" * (-len(letters) % 4))
        for x in READABLE.finditer(raw):
            layer = x[0].decode(errors="ignore")
            first, last = start + shift + x.start() // 3 * 4, min(end, start + shift + -(-x.end() // 3) * 4)
            if len(layer.encode()) < x.end() - x.start() or any(a <= first and last <= b for a, b in taken):
                continue

            def origin(a: int, b: int, at: int = x.start(), layer: str = layer, base: int = start + shift) -> tuple[int, int]:
                return base + (at + len(layer[:a].encode())) // 3 * 4, min(end, base + -(-(at + len(layer[:b].encode())) // 3) * 4)

            under.append((layer, origin))
    return under, large


def wrapped_run(text: str, start: int, end: int) -> tuple[str | None, Origin | None, bool]:
    """As `decoded_run`, of base64 letters that are wrapped into lines."""
    lines = [(start + m.start(), m[0]) for m in LINE.finditer(text[start:end])]
    at = [0, *accumulate(len(line) for _, line in lines)]
    layer, inner, over = decoded_run("".join(line for _, line in lines), 0, at[-1])

    def place(k: int) -> int:
        j = bisect_right(at, k) - 1
        return lines[j][0] + k - at[j]

    def origin(a: int, b: int) -> tuple[int, int]:
        first, last = inner(a, b)
        return place(first), place(last - 1) + 1

    return layer, origin, over


def layers(text: str) -> tuple[list[tuple[str, Origin]], int]:
    """The layers directly under a text, and how many were too large."""
    under, large = [], 0
    for sign, pattern in (("%", PERCENT), ("\\", ESCAPE), ("&#", ESCAPE)):
        if sign in text and (got := unescaped(text, pattern)):
            under.append(got)
            # forms write a blank as a plus sign
            if sign == "%" and "+" in got[0]:
                under.append((got[0].replace("+", " "), got[1]))
    if "\n" in text:
        for m in WRAPPED.finditer(text):
            layer, origin, over = wrapped_run(text, m.start(), m.end())
            large += over
            if layer:
                under.append((layer, origin))
    for m in BASE64.finditer(text):
        layer, origin, over = decoded_run(text, m.start(), m.end())
        if layer:
            under.append((layer, origin))
        elif not over:
            inner, more = decoded_parts(text, m.start(), m.end())
            under += inner
            over = more
        large += over
    return under, large


def spans(text: str) -> tuple[list[tuple[int, int, int, int]], int]:
    """(start, kind, end, depth) by start and kind, depth 0 for what stands in the text itself; and the number of layers too large to unpack."""
    large = 0
    known: dict[str, dict[tuple[int, int, int], int]] = {}
    # a frame: layer, layers under it that remain, spans so far, way to the frame above, lowest frame that a cycle led back to
    frames: list[list] = []
    opened: dict[str, int] = {}

    def enter(layer: str, origin: Origin | None) -> int:
        under, over = layers(layer)
        opened[layer] = len(frames)
        frames.append([layer, under, dict.fromkeys(scan(layer), 0), origin, len(frames)])
        return over

    def add(found: dict, inner: dict, origin: Origin) -> None:
        for (start, kind, end), depth in inner.items():
            start, end = origin(start, end)
            found[start, kind, end] = min(depth + 1, found.get((start, kind, end), depth + 1))

    large += enter(text, None)
    while True:
        layer, under, found, back, low = frames[-1]
        if under:
            inner, origin = under.pop()
            if inner in known:
                add(found, known[inner], origin)
            elif inner in opened:
                add(found, dict.fromkeys(scan(inner), 0), origin)
                frames[-1][4] = min(low, opened[inner])
            else:
                large += enter(inner, origin)
            continue
        frames.pop()
        del opened[layer]
        if not frames:
            return sorted((s, k, e, d) for (s, k, e), d in found.items()), large
        if low >= len(frames):
            known[layer] = found
        else:
            frames[-1][4] = min(frames[-1][4], low)
        add(frames[-1][2], found, back)


def find(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Add a struct of `spans` (kind, start, end, depth; by start, then kind) and `too_large`."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("depth", pa.int32())])

    @F.arrow_udf("struct<spans array<struct<kind string, start long, end long, depth int>>, too_large long>")
    def found(texts: pa.Array) -> pa.Array:
        rows = [spans(t.as_py() or "") for t in texts]
        lists = pa.array([[{"kind": KINDS[k], "start": s, "end": e, "depth": d} for s, k, e, d in r] for r, _ in rows], pa.list_(span))
        return pa.StructArray.from_arrays([lists, pa.array([n for _, n in rows], pa.int64())], names=["spans", "too_large"])

    result = found(F.col(f"`{text}`"))
    return without(df.withColumn("__secrets", result), out).withColumnRenamed("__secrets", out)


def listed(spans: Column) -> Column:
    """kind:start:end of an array of spans, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
