"""Byte-level BPE by the tiktoken library from a local file of ranks.

The library matches a pattern and merges the bytes of each match. Its matching
engine gives up on very long runs of white space, and its time and memory grow
with a text, so long texts are cut first, at places where a match ends whatever
stands around it:

* after a character that is no white space and before a space or line feed;
* between a letter and a digit of ASCII, either way;
* after a letter or digit of ASCII, or a Han, Kana or Hangul character, before
  punctuation;
* after punctuation of ASCII other than an apostrophe, before a letter or digit
  (an apostrophe may begin a match like 's);
* at both ends of a long run of white space, less its last character where text
  follows: that part is one match, and its bytes are merged without the pattern.

No alternative of the pattern spans such a place or looks back, and the one that
looks ahead, at what follows white space, ends before it. A text without such
places goes to the library whole. Ids are packed as little-endian unsigned
32-bit integers; decoding gives raw bytes, as ids may end within a character.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded_batches, whole_text

#: Code points from which a text is cut, and of a run of white space that goes round the pattern; ids decoded at once.
CHUNK, RUN, _IDS = 1 << 16, 1 << 12, 1 << 16
# White space by Unicode.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PUNCTUATION = r"!-&(-/:-@\[-`{-~"  # of ASCII, less the apostrophe
_PLACES = (
    rf"(?<=[^{_BLANK}])(?=[ \n])",
    r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])",
    rf"(?<=[A-Za-z0-9\u4e00-\u9fff\u3041-\u3096\u30a1-\u30fa\uac00-\ud7a3])(?=[{_PUNCTUATION}'\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])",
    rf"(?<=[{_PUNCTUATION}])(?=[A-Za-z0-9])",
)


class Codec:
    """Encode and decode by a file of ranks (base64 bytes and rank, a line each) and a pattern."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, run: int = RUN):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.one_match = tiktoken.Encoding("one match", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.chunk, self.runs, self.place = chunk, re.compile(f"[{_BLANK}]{{{max(run, 2)},}}"), re.compile("|".join(_PLACES))

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Parts of a text that are encoded apart, and whether one is a single match."""
        lo = 0
        if len(text) > self.chunk:
            for m in self.runs.finditer(text):
                a, b = m.start(), m.end() - (m.end() < len(text))
                yield from self._cut(text, lo, a)
                yield text[a:b], True
                lo = b
        yield from self._cut(text, lo, len(text))

    def _cut(self, text: str, lo: int, hi: int) -> Iterator[tuple[str, bool]]:
        while lo < hi:
            m = self.place.search(text, lo + self.chunk, hi) if hi - lo > self.chunk else None
            at = m.start() if m else hi
            yield text[lo:at], False
            lo = at

    def encode(self, text: str) -> bytes:
        own = [(self.one_match if single else self.library).encode_ordinary(part) for part, single in self.parts(text)]
        return b"".join(np.array(ids, "<u4").tobytes() for ids in own)

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        return b"".join(self.library.decode_bytes(ids[i : i + _IDS].tolist()) for i in range(0, len(ids), _IDS))


_codecs: dict[str, Codec] = {}


def codec(path: str | None = None) -> Codec:
    """The codec of a rank file, read once by a worker; by default that for many languages."""
    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def packed_ids(text: Column, path: str | None = None) -> Column:
    """Ids of a text, packed in four bytes each; null has none (null)."""

    def encode(texts: pa.Array) -> pa.Array:
        return pa.array((codec(path).encode(t.as_py()) if t.is_valid else None for t in texts), pa.binary())

    return arrow_udf(encode, "binary")(text)


def raw_bytes(packed: Column, path: str | None = None) -> Column:
    """Bytes of packed ids; null stays null, an id without a rank raises."""

    def decode(values: pa.Array) -> pa.Array:
        return pa.array((codec(path).decode(v.as_py()) if v.is_valid else None for v in values), pa.binary())

    return arrow_udf(decode, "binary")(packed)


def ids_of(packed: Column) -> Column:
    """Packed ids as an array of whole numbers."""

    def unpack(values: pa.Array) -> pa.Array:
        return pa.array((np.frombuffer(v.as_py(), "<u4") if v.is_valid else None for v in values), pa.list_(pa.int64()))

    return arrow_udf(unpack, "array<bigint>")(packed)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id and packed ids of every whole text, null counting as empty.

    Rows stay apart, also where they repeat an id or have none; other columns
    are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", packed_ids(whole_text(), path).alias("ids"))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The result of ``encode`` with the bytes that its ids stand for."""
    bounded_batches(encoded.sparkSession)
    return encoded.withColumn("bytes", raw_bytes(F.col("ids"), path))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text; see ``encode``."""
    ids = F.col("ids")
    return decode(encode(docs, path), path).select("doc_id", (F.octet_length(ids) / 4).cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
