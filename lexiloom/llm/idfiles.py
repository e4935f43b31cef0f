"""Token-id files: documents compressed one by one with a shared zstd dictionary.

A file holds, after an 8-byte magic, an id width (2 or 4) and the SHA-256 of its
dictionary, one zstd frame for each document, then the index, and last the
index's length. The index has for each document: whether it has an id, its
doc_id, the ids before it in the file, its number of ids, and its frame's offset
and length; so one short document is read without touching the others.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded_batches, cut, new_folder, one_task_a_file, whole_text
from .files import create, opened, stream

MAGIC = b"LXIDS\x00\x00\x01"
INDEX = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("first", "<i8"), ("n_ids", "<i8"), ("offset", "<i8"), ("size", "<i8")])
END_ID = 0
FILE_BYTES = 256 << 20
#: The dictionary is trained on at most so many documents, at most so many code points of each.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 512, 1 << 14, 1 << 16
#: Parts of texts that a worker remembers the ids of, parts that go to the library as one text, and bytes of text taken at once.
REMEMBERED, _JOINED, _SLICE = 1 << 19, 1 << 14, 2 << 20
#: White space by Unicode, and the separators that only Python counts as such.
_BLANK = r"\x1c-\x1f\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD_SPACE, _PART_START = rf" (?:[{_BLANK}]|\z)", rf" ([^{_BLANK}])"


class Encoder:
    """The tokenizers library's ids, with remembered ids of space-separated parts.

    A byte-level pre-tokenizer always begins a new pre-token at a space before a
    non-space, so a text's ids are those of its parts between such places. Arrow
    splits texts and numbers their distinct parts; unseen parts go to the library
    as one text, whose ids are cut where the bytes of its pieces add up to a
    part. Only around an added token (``<|endoftext|>``) may spaces fall
    otherwise, so a text that holds one (or a NUL, which marks places here) goes
    to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.apart = "|".join(map(re.escape, ["\0", *(t.content for t in added.values())]))
        vocabulary = self.tokenizer.get_vocab()
        self.size_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # of a piece in bytes, each of which is a character of its name
        self.size_of[list(vocabulary.values())] = [len(p) for p in vocabulary]
        self.dtype = np.dtype("<u2" if len(self.size_of) <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.parts = [pa.array([], pa.string())]
        self.ids = [np.zeros(0, self.dtype)]
        self.sizes = [np.zeros(0, np.int64)]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: pa.Array) -> None:
        """Remember the ids of parts, each of which follows a space."""
        for lo in range(0, len(parts), _JOINED):
            some = parts.slice(lo, _JOINED)
            ids = self._library([" " + " ".join(some.to_pylist())])[0]
            reached = np.cumsum(self.size_of[ids])
            ends = np.cumsum(pc.binary_length(some.cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            at = np.searchsorted(reached, ends)
            if len(ends) and (at[-1] + 1 != len(ids) or (reached[at] != ends).any()):
                raise ValueError("pieces of this tokenizer don't spell the text out")
            self.parts.append(some)
            self.ids.append(ids)
            self.sizes.append(np.diff(at + 1, prepend=0))

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Parts of all texts and how many each has; a part but the first follows a space."""
        split = pc.split_pattern(texts, " ")
        odd = pc.match_substring_regex(texts, _ODD_SPACE)
        if pc.any(odd).as_py():
            marked = pc.replace_substring_regex(texts, _PART_START, "\0\\1")
            split = pc.if_else(odd, pc.split_pattern(marked, "\0"), split)
        return split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)

    def _placed(self, texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Ids that are remembered and those of heads; where among them each part's begin and how many it has; each text's first part."""
        whole = pc.match_substring_regex(texts, self.apart)
        alone = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        kept = pc.if_else(whole, "", texts) if len(alone) else texts
        values, counts = self._split(kept)
        starts = np.cumsum(counts) - counts
        first = np.zeros(len(values), bool)
        first[starts] = True
        heads = values.take(pa.array(starts)).to_pylist()
        for i in alone.tolist():
            heads[i] = texts[i].as_py()
        own = self._library(heads)
        coded = values.filter(pa.array(~first)).dictionary_encode()
        known = self._places(coded.dictionary)
        flat, sizes = np.concatenate(self.ids), np.concatenate(self.sizes)
        begins = np.cumsum(sizes) - sizes
        head_sizes = np.array([len(x) for x in own], np.int64)
        # the ids of heads stand after those that are remembered
        begin = np.zeros(len(values), np.int64)
        size = np.zeros(len(values), np.int64)
        begin[first], size[first] = len(flat) + np.cumsum(head_sizes) - head_sizes, head_sizes
        place = known[coded.indices.to_numpy()]
        begin[~first], size[~first] = begins[place], sizes[place]
        return [flat, *own], begin, size, starts

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        _, _, size, starts = self._placed(texts)
        return np.add.reduceat(size, starts) if len(starts) else size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        known, begin, size, starts = self._placed(texts)
        ends = np.cumsum(size)
        out = np.concatenate(known)[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)]
        return out, np.add.reduceat(size, starts) if len(starts) else size

    def _places(self, parts: pa.Array) -> np.ndarray:
        """The number under which each part is remembered."""
        found = pc.index_in(parts, pa.concat_arrays(self.parts))
        n = sum(map(len, self.parts))
        if n + found.null_count > REMEMBERED and n:
            self._forget()
            found, n = pc.index_in(parts, self.parts[0]), 0
        unseen = pc.is_null(found)
        self._learn(parts.filter(unseen))
        new = unseen.to_numpy(zero_copy_only=False)
        out = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        out[new] = n + np.arange(np.count_nonzero(new))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def n_tokens(column: str = "text", tokenizer: str | None = None) -> Column:
    """How many ids the files have for a text: those of the text (null: none) and the end id."""
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def count(texts: pa.Array) -> pa.Array:
        own = pa.RecordBatch.from_arrays([texts], names=["text"])
        sizes = [encoder(tokenizer).counts(some.column("text")) + 1 for some in _slices(own)]
        return pa.array(np.concatenate([np.zeros(0, np.int64), *sizes]), pa.int64())

    return arrow_udf(count, "bigint")(whole_text(column))


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """Dictionary from the ids of the documents with the smallest hashed doc_id.

    A threshold that about four times as many documents pass comes first, as each
    task would send the driver a whole sample else.
    """
    share = min(1.0, 4 * SAMPLE_DOCS / max(docs.count(), 1))
    sample = (
        docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)).alias("h"), F.left(whole_text(), F.lit(SAMPLE_CHARS)).alias("text"))
        .where(F.col("h") < int(share * (1 << 32)))
        .orderBy("h", "text")
        .limit(SAMPLE_DOCS)
        .collect()
    )
    ids, sizes = encoder(tokenizer)(pa.array([r["text"] for r in sample], pa.string()))
    samples = [x.tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1]) if len(x)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes() if samples else b""
    except zstandard.ZstdError:  # too few or too small samples
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about ``_SLICE`` bytes of text at a time, one row at least."""
    upto = np.cumsum(pc.binary_length(batch.column("text").cast(pa.binary())).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    lo = 0
    while lo < len(upto):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _SLICE, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, dictionary: bytes, file_bytes: int) -> Iterator[pa.RecordBatch]:
    encode, chosen = encoder(tokenizer), _dictionary(dictionary)
    if chosen:
        chosen.precompute_compress(level=3)
    pack = zstandard.ZstdCompressor(level=3, dict_data=chosen, write_checksum=False).compress
    end = np.array([END_ID], encode.dtype).tobytes()
    start = struct.pack("<8sB32s", MAGIC, encode.dtype.itemsize, hashlib.sha256(dictionary).digest())
    done: list[tuple] = []
    out, uri, at, first, index = None, "", 0, 0, []

    def close() -> None:
        body = np.array(index, INDEX).tobytes()
        out.write(body + struct.pack("<q", len(body)))
        out.close()
        done.append((uri, TaskContext.get().partitionId(), len(done), len(index), first))

    for some in (x for batch in batches for x in _slices(batch)):
        ids, sizes = encode(some.column("text"))
        ends = np.cumsum(sizes).tolist()
        raw, width = ids.tobytes(), encode.dtype.itemsize
        for doc_id, lo, hi in zip(some.column("doc_id").to_pylist(), [0, *ends], ends, strict=False):
            if out is not None and at >= file_bytes:
                close()
                out = None
            if out is None:
                uri, out = create(folder, ".ids")
                out.write(start)
                at, first, index = len(start), 0, []
            frame = pack(raw[lo * width : hi * width] + end)
            n = hi - lo + 1
            index.append((doc_id is not None, doc_id or 0, first, n, at, len(frame)))
            out.write(frame)
            at, first = at + len(frame), first + n
    if out is not None:
        close()
    columns = zip(*done) if done else [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["path", "part", "file", "n_docs", "n_ids"])


def write_id_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode and write ``docs(doc_id, text, ...)`` in ascending doc_id order.

    Each document's ids are followed by id 0. Returns the manifest: path,
    n_docs, n_ids, first_id (ids in the files before) and dictionary (path, or
    null if the documents are too few to train one). doc_id is cast to bigint: an
    id that is no number raises (or counts as null, without ANSI mode). Null text
    is empty; null ids come first; rows that repeat an id follow each other by
    text; an empty table gives a manifest without files.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "ids")
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    bounded_batches(spark)
    dictionary = train_dictionary(docs, tokenizer)
    dict_path = None
    if dictionary:
        files, path = opened(folder)
        files.create_dir(path, recursive=True)
        name = f"{hashlib.sha256(dictionary).hexdigest()}.dict"
        with files.open_output_stream(f"{path}/{name}") as out:
            out.write(dictionary)
        dict_path = f"{folder}/{name}"
    # repeated and null ids are dealt out by text, in whose order they follow each other
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole_text().alias("text")).withColumn("same", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "same").sortWithinPartitions("doc_id", "same", "text").select("doc_id", "text")
    written = cut(ordered.mapInArrow(lambda it: _write(it, folder, tokenizer, dictionary, file_bytes), "path string, part int, file int, n_docs bigint, n_ids bigint"))
    before = F.sum("n_ids").over(Window.orderBy("part", "file")) - F.col("n_ids")  # one row a file
    return written.select("path", "n_docs", "n_ids", before.alias("first_id"), F.lit(dict_path).cast("string").alias("dictionary"))


def _head(raw, dictionary: bytes) -> np.dtype:
    magic, width, digest = struct.unpack("<8sB32s", raw.read(41))
    if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not an id file, or not with this dictionary")
    return np.dtype(f"<u{width}")


def _index(raw, size: int) -> np.ndarray:
    raw.seek(size - 8)
    (n,) = struct.unpack("<q", raw.read(8))
    raw.seek(size - 8 - n)
    return np.frombuffer(raw.read(n), INDEX)


def _load(path: str | None) -> bytes:
    if path is None or pd.isna(path):
        return b""
    with stream(path) as raw:
        return raw.read()


def read_file(path: str, dictionary: bytes, wanted: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the file, ids) of all documents or of one."""
    files, local = opened(path)
    with files.open_input_file(local) as raw:
        dtype = _head(raw, dictionary)
        index = _index(raw, raw.size())
        if wanted is not None:  # doc_ids ascend, those that are null first
            known = index[index["known"] == 1]
            lo, hi = np.searchsorted(known["doc_id"], [wanted, wanted + 1])
            index = known[lo:hi]
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress
        for known, doc_id, first, n_ids, offset, size in index.tolist():
            raw.seek(offset)
            ids = np.frombuffer(unpack(raw.read(size)), dtype)
            if len(ids) != n_ids:
                raise ValueError(f"{path} has {len(ids)} ids where its index has {n_ids}")
            yield (doc_id if known else None), first, ids


def _rows_of(manifest: DataFrame, last: str, value) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(held: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(held, columns=["doc_id", "start", "n_tokens", last.split()[0]]).astype({"doc_id": "Int64"})

        for pdf in batches:
            for path, base, dict_path in zip(pdf["path"], pdf["first_id"], pdf["dictionary"], strict=True):
                held, size = [], 0
                for doc_id, first, ids in read_file(path, _load(dict_path)):
                    held.append((doc_id, base + first, len(ids), value(ids)))
                    size += len(ids)
                    if size >= 1 << 20:
                        yield frame(held)
                        held, size = [], 0
                if held:
                    yield frame(held)

    spread = one_task_a_file(manifest.select("path", "first_id", "dictionary"))
    return spread.mapInPandas(rows, f"doc_id bigint, start bigint, n_tokens bigint, {last}")


def read_id_files(manifest: DataFrame) -> DataFrame:
    """Manifest -> doc_id, start (ids of all documents before it), n_tokens, ids; a row for each document written, none for an empty manifest."""
    return _rows_of(manifest, "ids array<bigint>", lambda ids: ids.astype(np.int64))


def id_file_round_trip(docs: DataFrame) -> DataFrame:
    """One row for each document, as read back from the files written for it.

    Columns doc_id, start, n_tokens (with the end id) and ids_crc32, over the
    ids as little-endian unsigned 32-bit integers. Null text counts as empty and
    has the end id alone; null doc_ids come first; rows that repeat a doc_id
    follow each other by the hashes of their texts; an empty table gives an empty result; other
    columns are ignored.
    """
    return _rows_of(write_id_files(docs), "ids_crc32 bigint", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))
