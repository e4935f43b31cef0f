"""Mutual information of n-grams' triples with one shuffle of them.

Triples are summed where lines are parsed and sent to a home: a part of their path's
words, or all of them where the path has a preposition that isn't common. A home
has all that its rows need but the marginals of words, and of paths in parts. It
asks for those, each once: sorted keys and its own sums of them, packed by bucket
of the key, go to where a bucket's sums of all homes are added up, and totals come
back in the order of the keys. So joins with marginals move no triples. All packs
are Arrow streams, compressed; what reads the homes twice reads one exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mi, ngrams

#: Homes for each shuffle partition: a task works on one at a time.
HOMES = 4
# Prepositions whose paths may be hot, and so go in parts.
COMMON = frozenset("of in to for with on at by from as into".split())
_SLOTS = ("X", "Y")


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, "zstd") as out, pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(pack: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(pa.CompressedInputStream(pa.BufferReader(pack.as_buffer()), "zstd")).read_all()


def in_parts(pid: str) -> bool:
    """Whether a path has no preposition, or a common one."""
    words = pid.split(" ")
    return len(words) <= 3 or words[2] in COMMON


def _by_home(own: pa.Table, homes: int) -> Iterator[tuple[int, bytes]]:
    """Summed triples (pid, slot as number, word, cnt) of each home, packed."""
    pids = own["pid"].combine_chunks().dictionary_encode()
    words = pa.concat_arrays([c for s in ("x", "y") for c in own[s].chunks]).dictionary_encode()
    order = pc.sort_indices(words.dictionary)  # like words beside each other pack better
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    names, paths = words.dictionary.take(order), pids.dictionary
    part = np.array([crc32(w.encode()) % ngrams.PARTS for w in names.to_pylist()], np.int64)
    first = np.array([crc32(p.encode()) for p in paths.to_pylist()], np.int64)
    parted = np.array([in_parts(p) for p in paths.to_pylist()], bool)
    p, w = np.tile(pids.indices.to_numpy().astype(np.int64), 2), rank[words.indices.to_numpy()]
    slot = np.repeat(np.arange(2), len(own))
    home = (first[p] + np.where(parted[p], part[w], 0) * 0x9E3779B1) % homes
    key = ((home * len(paths) + p) * 2 + slot) * len(names) + w  # far from 2^63, as a flush has about TOGETHER rows
    at = np.argsort(key)
    new = np.flatnonzero(np.diff(key[at], prepend=-1))
    cnt = np.add.reduceat(np.tile(own["cnt"].to_numpy(), 2)[at], new)
    at = at[new]
    home, p, w, slot = home[at], p[at], w[at], slot[at]
    ends = [*np.flatnonzero(home[1:] != home[:-1]) + 1, len(home)]
    for lo, hi in zip([0, *ends], ends):
        columns = []
        for codes, of in ((p[lo:hi], paths), (w[lo:hi], names)):
            used, codes = np.unique(codes, return_inverse=True)
            columns.append(pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32()), of.take(pa.array(used))))
        table = pa.table([columns[0], pa.array(slot[lo:hi], pa.int8()), columns[1], pa.array(cnt[lo:hi], pa.int64())], names=["pid", "slot", "word", "cnt"])
        yield int(home[lo]), _pack(table)


def _packs(batches: Iterator[pa.RecordBatch], homes: int, stem_all: bool, filter_aux: bool) -> Iterator[pa.RecordBatch]:
    for own in ngrams._paths(batches, stem_all, filter_aux):
        if len(own):
            home, pack = zip(*_by_home(own, homes), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(pack, pa.binary())], names=["home", "pack"])


def _triples(packs: pa.ChunkedArray) -> pa.Table:
    """A home's triples, each once: pid, slot, word, cnt."""
    plain = pa.schema([("pid", pa.string()), ("slot", pa.int8()), ("word", pa.string()), ("cnt", pa.int64())])
    rows = pa.concat_tables([_unpack(x).cast(plain) for x in packs])
    return rows.group_by(["pid", "slot", "word"], use_threads=False).aggregate([("cnt", "sum")]).rename_columns(plain.names)


def _wanted(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Keys that a home asks for, sorted, with its own sums: kind (slot of a word, 2 + slot of a path in parts) and name; the key of each row's word, and of its path (-1: has all rows here)."""
    paths = rows["pid"].combine_chunks().dictionary_encode()
    parted = np.array([in_parts(p) for p in paths.dictionary.to_pylist()], bool)[paths.indices.to_numpy()]
    slot = rows["slot"].to_numpy()
    at = pa.array(np.flatnonzero(parted))
    names = pa.concat_arrays([*rows["word"].chunks, *rows["pid"].take(at).chunks]).dictionary_encode()
    order = pc.sort_indices(names.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    code = rank[names.indices.to_numpy()] * 4 + np.concatenate([slot, 2 + slot[parted]])
    keys, which = np.unique(code, return_inverse=True)
    cnt = rows["cnt"].to_numpy()
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, which, np.concatenate([cnt, cnt[parted]]))
    path = np.full(len(rows), -1)
    path[parted] = which[len(rows) :]
    table = pa.table([pa.array(keys % 4, pa.int8()), names.dictionary.take(order).take(pa.array(keys // 4)), pa.array(sums)], names=["kind", "name", "cnt"])
    return table, which[: len(rows)], path


def _buckets(wanted: pa.Table, buckets: int) -> np.ndarray:
    return np.array([crc32(x.encode()) % buckets for x in wanted["name"].to_pylist()], np.int64)


def _asked(home: pa.Table, buckets: int) -> pa.Table:
    wanted, _, _ = _wanted(_triples(home["pack"]))
    bucket = _buckets(wanted, buckets)
    at = np.argsort(bucket, kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=buckets))
    some = np.flatnonzero(np.diff(ends, prepend=0))
    packs = [_pack(wanted.take(pa.array(at[(ends[b - 1] if b else 0) : ends[b]]))) for b in some.tolist()]
    return pa.table([pa.array(some, pa.int32()), pa.array(np.repeat(home["home"][0].as_py(), len(some)), pa.int32()), pa.array(packs, pa.binary())], names=["bucket", "home", "pack"])


def _sums(asked: pa.Table) -> tuple[list[int], pa.Table]:
    """Keys of each pack of a bucket, and the totals of all, as a table of as many rows."""
    each = [_unpack(x) for x in asked["pack"]]
    rows = pa.concat_tables(each)
    names = rows["name"].combine_chunks().dictionary_encode()
    code = names.indices.to_numpy().astype(np.int64) * 4 + rows["kind"].to_numpy()
    totals = np.zeros(4 * len(names.dictionary), np.int64)
    np.add.at(totals, code, rows["cnt"].to_numpy())
    return [len(x) for x in each], pa.table([rows["kind"], rows["cnt"], pa.array(totals[code])], names=["kind", "cnt", "total"])


def _answered(asked: pa.Table) -> pa.Table:
    sizes, rows = _sums(asked)
    ends = np.cumsum(sizes)
    packs = [_pack(rows.slice(hi - n, n).select(["total"])) for n, hi in zip(sizes, ends.tolist(), strict=True)]
    return pa.table([asked["home"], asked["bucket"], pa.array(packs, pa.binary())], names=["home", "bucket", "pack"])


def _slot_sums(asked: pa.Table) -> pa.Table:
    _, rows = _sums(asked)
    kind, cnt = rows["kind"].to_numpy(), rows["cnt"].to_numpy()
    return pa.table([pa.array(_SLOTS), pa.array([int(cnt[kind == k].sum()) for k in range(2)], pa.int64())], names=["slot", "d"])


def _with_marginals(home: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    """A home's triples with the totals of their paths (b) and words (c) in a slot."""
    rows = _triples(home["pack"])
    wanted, word, path = _wanted(rows)
    bucket = _buckets(wanted, buckets)
    told = dict(zip(answers["bucket"].to_pylist(), answers["pack"], strict=True))
    totals = np.empty(len(wanted), np.int64)
    totals[np.argsort(bucket, kind="stable")] = np.concatenate([_unpack(told[b])["total"].to_numpy() for b in sorted(told)])
    slot, cnt = rows["slot"].to_numpy(), rows["cnt"].to_numpy()
    place = rows["pid"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) * 2 + slot
    here = np.zeros(place.max() + 1, np.int64)
    np.add.at(here, place, cnt)
    b = np.where(path >= 0, totals[path], here[place])
    own = pa.table([rows["pid"], pa.array(_SLOTS).take(pa.array(slot)), rows["word"], rows["cnt"], pa.array(b), pa.array(totals[word])], names=["pid", "slot", "word", "cnt", "b", "c"])
    return own.take(pa.array(np.lexsort((word, place))))  # a path's rows beside each other, which what is written makes use of


def mutual_information(lines: DataFrame, stem_all: bool = True, filter_aux: bool = True) -> DataFrame:
    """pid, slot, word, mi, cnt as ``mi.mutual_information`` of ``ngrams.triples``."""
    buckets = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    homes = HOMES * buckets
    packs = ngrams._over(lines, lambda it: _packs(it, homes, stem_all, filter_aux), "home int, pack binary")
    asked = packs.groupBy("home").applyInArrow(lambda t: _asked(t, buckets), "bucket int, home int, pack binary")
    answers = asked.groupBy("bucket").applyInArrow(_answered, "home int, bucket int, pack binary")
    totals = asked.groupBy("bucket").applyInArrow(_slot_sums, "slot string, d bigint").groupBy("slot").agg(F.sum("d").alias("d"))
    rows = packs.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(lambda a, b: _with_marginals(a, b, buckets), "pid string, slot string, word string, cnt bigint, b bigint, c bigint")
    return mi._positive(rows.join(F.broadcast(totals), "slot"))
