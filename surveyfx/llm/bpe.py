"""Byte-pair encoding by backtracking over longest token matches, and decoding through an offset table.

A text is cut into pieces by the tokenizer's own pattern. A piece is encoded from left to right: an Aho-Corasick automaton gives the longest
token that starts at a position, and a token may follow another only if exact merging would keep the border between them (`compatible`). When
no token fits, the last one gives way to its next shorter prefix and its end is marked as a dead end, so every position is left at most once
and the work is linear. The result equals the merges applied in order of rank.

Nulls count as empty texts and give an empty list. Repeated rows are encoded alike. Rows of other columns pass through; `ids` and `decoded`
replace columns of these names. Special tokens written out in a text become their ids, as the public libraries do by default.
"""

from __future__ import annotations

import json
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyfx.llm.common import without, worker_tables

#: The pattern that byte-level tokenizers split a text with before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII and Latin letters only, where the standard library's faster engine agrees; `OTHER` finds what it is not meant for.
LATIN = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PLAIN_PATTERN = re.compile(rf" ?[{LATIN}]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{LATIN}0-9]+|\s+(?!\S)|\s+")
OTHER = re.compile(r"[^\x00-\x1b\x20-\x7f\u00c0-\u024f]")
#: Distinct pieces whose ids a worker remembers; beyond, it starts anew. Longer pieces are not remembered.
CACHE_PIECES, CACHE_LENGTH = 150_000, 48
#: Token pairs whose compatibility a worker remembers.
FITS = 150_000


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write every byte as a printable letter: itself where it is one, else from 256 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PieceCache(dict):
    """Piece -> its ids as bytes; encodes what it has not seen."""

    def __init__(self, encode, limit: int = CACHE_PIECES):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids


class Backtracking:
    """The tables of one vocabulary: automaton, next shorter prefix, pair compatibility."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = {tuple(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        of = {bytes(t): i for t, i in vocab.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = [(bytes(letters[c] for c in a), bytes(letters[c] for c in b)) for a, b in merges]
        # work in ranks: single bytes first, then the merges in their order
        base = [bytes([b]) for b in range(256)]
        self.token_of = base + [a + b for a, b in pairs]
        rank = {t: r for r, t in reversed(list(enumerate(self.token_of)))}
        self.id_bytes = [of.get(t, -1).to_bytes(4, "little", signed=True) for t in self.token_of]
        self.length = [len(t) for t in self.token_of]
        self.left, self.right = list(range(256)), list(range(256))
        self.merged: dict[int, int] = {}
        for r, (a, b) in enumerate(pairs, 256):
            self.left.append(rank[a])
            self.right.append(rank[b])
            self.merged.setdefault(rank[a] << 20 | rank[b], r)
        self.automaton = ahocorasick.Automaton()
        for t, r in rank.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.shorter = [next((rank[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in rank), -1) for t in self.token_of]
        self.fits: dict[int, bool] = {}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = regex.compile("|".join(f"({regex.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.full_pattern = regex.compile(PATTERN)
        self.cache = PieceCache(self.encode_piece)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging keeps the border between tokens a and b: undo merges from the newest; no pair met at the border may have merged earlier."""
        merged, left, right, limit = self.merged, self.left, self.right, len(self.token_of)
        while True:
            if merged.get(a << 20 | b, limit) < limit:
                return False
            if a > b:
                limit, a = a, right[a]
            elif b < 256:
                return True
            else:
                limit, b = b + 1, left[b]
            if a < 256 and b < 256:
                return merged.get(a << 20 | b, limit) >= limit

    def encode_piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else piece.encode("utf-8").decode("latin-1")
        longest, length, shorter, fits, id_bytes = self.automaton.iter_long, self.length, self.shorter, self.fits, self.id_bytes
        (stop, token) = next(longest(text))
        end = len(text)
        if stop + 1 == end:
            return id_bytes[token]
        pos, out, last, dead = 0, [], -1, set()
        while True:
            while token >= 0:
                stop = pos + length[token]
                if stop not in dead:
                    if last < 0:
                        break
                    key = last << 20 | token
                    fit = fits.get(key)
                    if fit is None:
                        if len(fits) >= FITS:
                            fits.clear()
                        fit = fits[key] = self.compatible(last, token)
                    if fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if stop == end:
                    return b"".join([id_bytes[t] for t in out])
                pos, last = stop, token
                token = next(longest(text, pos))[1]
            else:
                dead.add(pos)
                token = out.pop()
                pos -= length[token]
                last = out[-1] if out else -1

    def pieces(self, text: str) -> list[str]:
        return self.full_pattern.findall(text) if OTHER.search(text) else PLAIN_PATTERN.findall(text)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian signed 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(self.cache.__getitem__, self.pieces(text)))
        parts = []
        for part in self.cut.split(text):
            if part in self.special:
                parts.append(np.int32(self.special[part]).tobytes())
            elif part:
                parts += map(self.cache.__getitem__, self.pieces(part))
        return b"".join(parts)

class Offsets:
    """One run of bytes that holds the text of every token, and where each begins: the bytes of id i are blob[start[i] : start[i] + size[i]]."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        text_of = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in spec["model"]["vocab"].items()}
        text_of |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        ordered = [text_of.get(i, b"") for i in range(max(text_of) + 1)]
        self.size = np.array([len(t) for t in ordered], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.blob = np.frombuffer(b"".join(ordered), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - ends + size, size)
        at += np.arange(len(at))
        return self.blob[at].tobytes()


@worker_tables
def tables(path: str) -> Backtracking:
    return Backtracking(path)


@worker_tables
def offsets(path: str) -> Offsets:
    return Offsets(path)


def encode(df: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of a text column as an array. `tokenizer` is a path that every machine has."""

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        bpe = tables(tokenizer)
        parts = [b"" if t is None else bpe.encode(t) for t in (x.as_py() for x in texts)]
        offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))

    ids = ids_of(F.col(f"`{text}`"))
    return without(df.withColumn("__ids", ids), out).withColumnRenamed("__ids", out)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of an id column; null ids give the empty text. Bytes that are no UTF-8 become U+FFFD."""

    @F.arrow_udf("string")
    def text_of(lists: pa.Array) -> pa.Array:
        table = offsets(tokenizer)
        flat, ends = np.asarray(lists.values), np.asarray(lists.offsets)
        return pa.array([table.decode(flat[a:b]).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.string())

    text = text_of(F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")))
    return without(df.withColumn("__decoded", text), out).withColumnRenamed("__decoded", out)
