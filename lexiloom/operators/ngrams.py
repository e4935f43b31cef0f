"""Dependency n-grams to predicate-path instances, in Arrow batches.

Nothing shuffles here. A batch's lines are split by Arrow; equal tokens are
looked at once, by numbers into the batch's distinct ones. Trees, common ancestors
and pairs of nouns are flat arrays over all lines of a batch (``trees``). What takes
n-grams takes those of ``parse`` or lines themselves (``value``), which are then
parsed in the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem_word
from . import trees

# Tag and relation names.
FUNCTIONAL = ("det", "poss", "neg", "aux", "auxpass", "ps", "mark", "complm", "prt")
AUXILIARY = ("is", "are", "was", "were", "am", "been", "being", "do", "does", "did", "have", "has", "had")
SUBJECT = ("nsubj", "nsubjpass", "subj", "subjpass")

_TOKEN = pa.struct([("word", pa.string()), ("pos", pa.string()), ("dep", pa.string()), ("head", pa.int32())])
_PARSED = "head string, tokens array<struct<word:string,pos:string,dep:string,head:int>>, cnt bigint"
_CONTROL = "".join(map(chr, range(33)))


def _whole(values: pa.Array, bits: int) -> pa.Array:
    """Signed integers without spaces, else null, also where they have more bits."""
    digits = pc.replace_substring_regex(values, r"^\+", "")
    good = pc.fill_null(pc.match_substring_regex(values, r"^[+-]?[0-9]+\z"), False)
    short = pc.less(pc.fill_null(pc.binary_length(digits), 0), 10 if bits == 32 else 19)
    out = pc.cast(pc.if_else(pc.and_(good, short), digits, None), pa.int64())
    for i in np.flatnonzero(pc.and_(good, pc.invert(short)).to_numpy(zero_copy_only=False)):  # leading zeros, or near the limits
        x = int(values[i].as_py())
        if -(1 << bits - 1) <= x < 1 << bits - 1:
            out = pa.concat_arrays([out[:i], pa.array([x], pa.int64()), out[i + 1 :]])
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields = pc.split_pattern(batch.column("value"), "\t")
        fields = fields.filter(pc.fill_null(pc.greater_equal(pc.list_value_length(fields), 3), False))
        cnt = _whole(pc.utf8_trim(pc.list_element(fields, 2), _CONTROL), 64)
        fields, cnt = fields.filter(pc.is_valid(cnt)), cnt.drop_null()
        raw = pc.split_pattern(pc.utf8_trim(pc.list_element(fields, 1), _CONTROL), " ")
        sizes = pc.list_value_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = raw.flatten().dictionary_encode()
        parts = pc.split_pattern(coded.dictionary, "/", max_splits=3, reverse=True)
        whole = pc.equal(pc.list_value_length(parts), 4)
        parts = pc.if_else(whole, parts, pa.scalar(["", "", "", ""], pa.list_(pa.string())))
        head = _whole(pc.if_else(whole, pc.list_element(parts, 3), None), 32)
        distinct = pa.StructArray.from_arrays([*[pc.list_element(parts, i) for i in range(3)], head.cast(pa.int32())], fields=list(_TOKEN))
        place = coded.indices.to_numpy()
        bad = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=head.is_null().to_numpy(zero_copy_only=False)[place], minlength=len(sizes)) > 0
        tokens = distinct.take(pa.array(place[~np.repeat(bad, sizes)]))
        good = pa.array(~bad)
        ends = np.concatenate([[0], np.cumsum(sizes[~bad])])
        yield pa.RecordBatch.from_arrays([pc.list_element(fields, 0).filter(good), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens), cnt.filter(good)], names=["head", "tokens", "cnt"])


def parse(lines: DataFrame) -> DataFrame:
    """``value`` lines -> head, tokens, cnt; lines with any bad part are left out.

    A token is word/POS/dep/head, split from the right; tokens are split at single
    spaces, so that two spaces reject a line.
    """
    return lines.select("value").mapInArrow(_parse, _PARSED)


def _over(ngrams: DataFrame, function, schema: str) -> DataFrame:
    if "value" in ngrams.columns:
        return ngrams.select("value").mapInArrow(lambda it: function(_parse(it)), schema)
    return ngrams.select("tokens", "cnt").mapInArrow(function, schema)


#: Rows of a task that are summed before they leave it.
TOGETHER = 1 << 19


def _sent(table: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    yield from table.rename_columns(names).combine_chunks().to_batches(max_chunksize=1 << 16)


class _Batch:
    """Tokens of a batch's lines one after the other, by numbers of distinct words, tags and relations."""

    def __init__(self, batch: pa.RecordBatch):
        tokens = batch.column("tokens")
        self.cnt = batch.column("cnt")
        self.sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        self.line = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        flat = tokens.flatten()
        self.word, self.pos, self.dep = (pc.struct_field(flat, c).dictionary_encode() for c in ("word", "pos", "dep"))
        self.parent = trees.parents(pc.struct_field(flat, "head").to_numpy().astype(np.int64), self.sizes)

    @staticmethod
    def which(coded: pa.DictionaryArray, test) -> np.ndarray:
        """Whether each token passes a test of its distinct value."""
        return np.array([test(x) for x in coded.dictionary.to_pylist()], bool)[coded.indices.to_numpy()]

    def forest(self) -> trees.Forest:
        return trees.Forest(self.parent, int(self.sizes.max(initial=1)))

    def nouns(self) -> np.ndarray:
        return self.which(self.pos, lambda x: x.startswith("NN")) & ~self.which(self.dep, lambda x: x in FUNCTIONAL)


def _parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b = _Batch(batch)
        local = np.where(b.parent == trees.NONE, -1, b.parent - b.first[b.line])
        ends = np.concatenate([[0], np.cumsum(b.sizes)])
        yield pa.RecordBatch.from_arrays([b.cnt, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(local, pa.int32()))], names=["cnt", "parent"])


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parents(batches):
        lists = batch.column("parent")
        shape = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, lists.values.cast(pa.string())), ",")
        counts = pa.table({"parents": shape}).group_by(["parents"], use_threads=False).aggregate([([], "count_all")])
        yield from _sent(counts.select(["parents", "count_all"]), ["parents", "n"])


def tree_shapes(ngrams: DataFrame) -> DataFrame:
    """parents (as text, comma-joined) and n: how many lines have each tree; a batch's equal trees leave it as one."""
    return _over(ngrams, _shapes, "parents string, n bigint").groupBy("parents").agg(F.sum("n").alias("n"))


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, held, rows = ["word", "pos", "dep", "parent"], [], 0

    def sums() -> Iterator[pa.RecordBatch]:
        own = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("n", "sum"), ("cnt", "sum")])
        yield from _sent(own.select([*keys, "n_sum", "cnt_sum"]), [*keys, "n", "cnt"])

    for batch in batches:
        tokens, cnt = batch.column("tokens"), batch.column("cnt")
        own = [tokens.flatten().field(i) for i in range(4)]
        table = pa.table([*own, cnt.take(pc.list_parent_indices(tokens))], names=[*keys, "cnt"])
        table = table.group_by(keys, use_threads=False).aggregate([([], "count_all"), ("cnt", "sum")])
        held.append(table.select([*keys, "count_all", "cnt_sum"]).rename_columns([*keys, "n", "cnt"]))
        rows += len(table)
        if rows >= TOGETHER:
            yield from sums()
            held, rows = [], 0
    if rows:
        yield from sums()


def token_counts(ngrams: DataFrame) -> DataFrame:
    """word, pos, dep, parent, n and cnt: how many tokens are alike, and the sum of their lines' counts; a task's alike ones leave it mostly as one."""
    rows = _over(ngrams, _token_counts, "word string, pos string, dep string, parent int, n bigint, cnt bigint")
    return rows.groupBy("word", "pos", "dep", "parent").agg(F.sum("n").alias("n"), F.sum("cnt").alias("cnt"))


def with_tree(ngrams: DataFrame) -> DataFrame:
    """cnt and the parent of each token (-1: root) of every line."""
    return _over(ngrams, _parents, "cnt bigint, parent array<int>")


def _ancestors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b = _Batch(batch)
        forest = b.forest()
        for i, j in trees.pairs(b.nouns(), b.sizes):
            found = forest.common(i, j)
            line = b.line[i]
            base = b.first[line]
            none = found == trees.NONE
            columns = [b.cnt.take(pa.array(line)), pa.array(i - base, pa.int32()), pa.array(j - base, pa.int32()), pa.array(found - base, pa.int32(), mask=none)]
            yield pa.RecordBatch.from_arrays(columns, names=["cnt", "i", "j", "lca"])


def common_ancestors(ngrams: DataFrame) -> DataFrame:
    """One row for each pair of nouns of a line: cnt and i, j, lca (null: none)."""
    return _over(ngrams, _ancestors, "cnt bigint, i int, j int, lca int")


def _prepositions(b: _Batch) -> tuple[np.ndarray, pa.Array]:
    """For each token the number of its preposition (-1: none) in the words and suffixes that are returned."""

    def suffix(dep: str) -> str:
        return next((dep[len(p) :] for p in ("prep_", "prepc_") if dep.startswith(p)), "")

    suffixes = [suffix(x) for x in b.dep.dictionary.to_pylist()]
    words, deps = b.word.indices.to_numpy(), b.dep.indices.to_numpy()
    out = np.where(np.array([bool(s.strip(" ")) for s in suffixes], bool)[deps], len(b.word.dictionary) + deps, -1)
    object_ = b.which(b.dep, lambda x: x in ("pobj", "pcomp")) & b.which(b.pos, lambda x: x in ("IN", "TO"))[b.parent]
    out = np.where(object_, words[b.parent], out)
    return np.where(b.parent == trees.NONE, -1, out), pa.concat_arrays([b.word.dictionary, pa.array(suffixes, pa.string())])


_RAW = "verb string, verb_dep string, prep string, x string, y string, cnt bigint"


def _instances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b = _Batch(batch)
        if not len(b.line):
            continue
        forest = b.forest()
        verb, subject = b.which(b.pos, lambda x: x.startswith("VB")), b.which(b.dep, lambda x: x in SUBJECT)
        prep, names = _prepositions(b)
        for i, j in trees.pairs(b.nouns(), b.sizes):
            v = forest.common(i, j)
            kept = (v != trees.NONE) & verb[v]
            i, j, v = i[kept], j[kept], v[kept]
            # with a preposition Y is its noun, else X is the subject, or the first noun
            turned = np.where(prep[i] >= 0, True, (prep[j] < 0) & subject[j] & ~subject[i])
            own = np.where(prep[i] >= 0, prep[i], prep[j])
            word = lambda at: b.word.dictionary.take(b.word.indices.take(pa.array(at)))
            columns = [word(v), b.dep.dictionary.take(b.dep.indices.take(pa.array(v))), names.take(pa.array(own, mask=own < 0)), word(np.where(turned, j, i)), word(np.where(turned, i, j)), b.cnt.take(pa.array(b.line[i]))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RAW.split(", ")])


def _mapped(column: pa.Array, function) -> pa.Array:
    """A function of each value that is not null; equal ones are looked at once."""
    coded = column.dictionary_encode()
    return pa.array([function(x) for x in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def _paths(batches: Iterator[pa.RecordBatch], stem_all: bool, filter_aux: bool) -> Iterator[pa.Table]:
    """pid, x, y and cnt of instances, words stemmed, about TOGETHER at a time."""
    held, rows = [], 0
    for batch in _instances(batches):
        raw = {c: batch.column(c) for c in batch.schema.names}
        if filter_aux:
            bad = pc.or_(pc.is_in(_mapped(raw["verb"], str.lower), pa.array(AUXILIARY)), pc.is_in(raw["verb_dep"], pa.array(["aux", "auxpass"])))
            raw = {c: v.filter(pc.invert(bad)) for c, v in raw.items()}
        pid = pc.binary_join_element_wise("X", _mapped(raw["verb"], stem_word), _mapped(raw["prep"], str.lower), "Y", " ", null_handling="skip")
        nouns = [_mapped(raw[c], stem_word if stem_all else str.lower) for c in ("x", "y")]
        held.append(pa.table([pid, *nouns, raw["cnt"]], names=["pid", "x", "y", "cnt"]))
        rows += len(pid)
        if rows >= TOGETHER:
            yield pa.concat_tables(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_tables(held)


def path_instances(ngrams: DataFrame, stem_all: bool = True, filter_aux: bool = True) -> DataFrame:
    """pid, slot (X or Y), word, cnt and n: two rows for each instance, alike instances of a task (n of them) mostly as one. Nothing shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _paths(batches, stem_all, filter_aux):
            alike = own.group_by(["pid", "x", "y", "cnt"], use_threads=False).aggregate([([], "count_all")])
            yield from _sent(alike.select(["pid", "x", "y", "cnt", "count_all"]), ["pid", "x", "y", "cnt", "n"])

    rows = _over(ngrams, run, "pid string, x string, y string, cnt bigint, n bigint")
    two = F.array(*[F.struct(F.lit(s.upper()).alias("slot"), F.col(s).alias("word")) for s in ("x", "y")])
    return rows.select("pid", F.explode(two).alias("s"), "cnt", "n").select("pid", "s.slot", "s.word", "cnt", "n")


def path_totals(ngrams: DataFrame, stem_all: bool = True, filter_aux: bool = True) -> DataFrame:
    """pid, slot, n and cnt: how many ``path_instances`` there are, and the sum of their counts; tasks and then Spark sum by path, as both slots have as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _paths(batches, stem_all, filter_aux):
            sums = own.group_by(["pid"], use_threads=False).aggregate([([], "count_all"), ("cnt", "sum")])
            yield from _sent(sums.select(["pid", "count_all", "cnt_sum"]), ["pid", "n", "cnt"])

    sums = _over(ngrams, run, "pid string, n bigint, cnt bigint").groupBy("pid").agg(F.sum("n").alias("n"), F.sum("cnt").alias("cnt"))
    return sums.select("pid", F.explode(F.array(F.lit("X"), F.lit("Y"))).alias("slot"), "n", "cnt")


#: Parts by word of a path without a preposition, which may be hot: each goes to a task of its own.
PARTS = 8


def _packed(own: pa.Table) -> pa.Table:
    """pid, part, words and counts: all words of a path and part beside each other, each after its slot's letter, and their sums likewise."""
    two = pa.concat_tables([pa.table([own["pid"], pc.binary_join_element_wise(s.upper(), own[s], ""), own["cnt"]], names=["pid", "word", "cnt"]) for s in ("x", "y")])
    sums = two.group_by(["pid", "word"], use_threads=False).aggregate([("cnt", "sum")])
    words = sums["word"].combine_chunks().dictionary_encode()
    part = pa.array([crc32(w.encode()) % PARTS for w in words.dictionary.to_pylist()], pa.int32()).take(words.indices)
    part = pc.if_else(pc.less_equal(pc.count_substring(sums["pid"], " "), 2), part, pa.scalar(0, pa.int32()))
    sums = sums.append_column("part", part).append_column("count", sums["cnt_sum"].cast(pa.string()))
    lists = sums.group_by(["pid", "part"], use_threads=False).aggregate([("word", "list"), ("count", "list")])
    return pa.table([lists["pid"], lists["part"], *[pc.binary_join(lists[c].combine_chunks(), " ") for c in ("word_list", "count_list")]], names=["pid", "part", "words", "counts"])


def triples(ngrams: DataFrame, stem_all: bool = True, filter_aux: bool = True) -> DataFrame:
    """Summed path instances.

    Words are stemmed and counts summed where n-grams are parsed, so there is one
    shuffle: of rows that have all words of a path and part beside each other (no
    token holds a space), which takes half of what single words would.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _paths(batches, stem_all, filter_aux):
            yield from _packed(own).combine_chunks().to_batches(max_chunksize=1 << 16)

    packed = _over(ngrams, run, "pid string, part int, words string, counts string").repartition("pid", "part")
    both = F.arrays_zip(F.split("words", " ").alias("word"), F.split("counts", " ").alias("cnt"))
    rows = packed.select("pid", "part", F.explode(both).alias("v")).select("pid", "part", F.substring("v.word", 1, 1).alias("slot"), F.expr("substring(v.word, 2)").alias("word"), F.col("v.cnt").cast("bigint").alias("cnt"))
    return rows.groupBy("pid", "part", "slot", "word").agg(F.sum("cnt").alias("cnt")).drop("part")
