"""Token ids of a lower-casing word tokenizer, one call of the tokenizers library for each new word.

The tokenizer's own steps (canonical composition, lower case letter by letter, split into words) are taken here; the library encodes each distinct
word once a worker, so a frequent word costs a look-up. New words of ASCII and Latin letters go straight to the library's merging, others through all
its steps. Nulls count as empty texts and give an empty list; an added column replaces one of its name.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyfx.llm.bpe import LATIN, OTHER, PieceCache, byte_letters
from surveyfx.llm.common import without, worker_tables

#: The word pattern of the tokenizer, and the same for ASCII and Latin letters only.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: White space of the tokenizer: Python's own also counts the four separators from 1C to 1F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PLAIN_PATTERN = re.compile(rf"[{LATIN}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^{SPACE}{LATIN}0-9]+")
#: Distinct words whose ids a worker remembers; beyond, it starts anew.
CACHE_WORDS = 400_000
#: Byte-level vocabularies write a byte as a letter: turns a word's bytes, read as Latin-1, into these letters.
LETTERS = {b: c for c, b in byte_letters().items()}


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.cache = PieceCache(self.word, CACHE_WORDS)

    def words(self, text: str) -> list[str]:
        # letter by letter: a final capital sigma gets no form of its own
        low = text.lower() if (plain := text.isascii()) else text.replace("Σ", "σ").lower()
        if plain or not OTHER.search(low):
            return PLAIN_PATTERN.findall(low)
        return PATTERN.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.words(text)
        return [w for part in self.cut.split(text) if part for w in ([part] if part in self.special else self.words(part))]

    def word(self, word: str) -> bytes:
        """The ids of a word that is new to this worker, as little-endian 32-bit integers."""
        if word in self.special:
            return np.uint32(self.special[word]).tobytes()
        if OTHER.search(word):  # words of other scripts once more through the library's own steps
            return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()
        letters = word.encode().decode("latin-1").translate(LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        ids_of = self.cache.__getitem__
        return [b"".join(map(ids_of, self.pieces(t))) for t in texts]


@worker_tables
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode(df: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        parts = encoder(tokenizer).encode(x.as_py() or "" for x in texts)
        offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))

    ids = ids_of(F.col(f"`{text}`"))
    return without(df.withColumn("__ids", ids), out).withColumnRenamed("__ids", out)
