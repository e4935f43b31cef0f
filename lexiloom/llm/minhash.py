"""One-permutation MinHash with optimal densification and b-bit packing.

Every shingle is hashed once; the high bits of the hash choose a bin, and a bin
keeps its smallest hash. An empty bin takes the value of the first filled bin in
its own pseudo-random probe order over all bins, which depends on the bin alone,
so that equal sets fill equally. A bin's value is mixed with the bin's number, so
that copies of one value collide independently, and its four low bits are kept.
Two unrelated bins agree with chance 1/16, which the likeness is corrected for.
Everything is a DataFrame expression.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, whole_text

WORDS = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
BITS = 4
#: Ranges of ids for each shuffle partition.
RANGES = 8
_SHIFT = 64 - BIN_BITS
_LOW = (1 << _SHIFT) - 1
_QUICK = 6
#: Nibbles of a 64-bit word: the lowest bit of each.
_NIBBLES = 0x1111111111111111


def _numbers(values, kind: str) -> Column:
    return F.expr(f"array({', '.join(f'{v}{kind}' for v in values)})")


def _probe_order() -> tuple[Column, Column]:
    """Step (odd, so that it visits all bins) and start of each bin's probes."""
    rule = random.Random(42)
    return _numbers([2 * rule.randrange(BINS // 2) + 1 for _ in range(BINS)], ""), _numbers([rule.randrange(BINS) for _ in range(BINS)], "")


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """xxHash64 of every word shingle; fewer words make one shingle."""

    def over(w: Column) -> Column:
        n = F.size(w)
        rolling = F.transform(F.sequence(F.lit(0), n - words), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(words)]))
        return F.when(n >= words, rolling).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return let(F.array_remove(F.split(text, "[ \\t-\\r]+"), ""), over)


def packed_fingerprint(text: Column, words: int = WORDS) -> Column:
    """Array of 16 longs, 16 bins of four bits in each; empty when no words."""
    steps, starts = _probe_order()
    markers = _numbers([(b << _SHIFT) + _LOW for b in range(-BINS // 2, BINS // 2)], "L")

    def first_of_bins(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT) != F.shiftright(F.get(s, i - 1), _SHIFT)))

    def densify(bins: Column) -> Column:
        def probe(j: Column, t) -> Column:
            return F.get(bins, (F.get(steps, j) * t + F.get(starts, j)).bitwiseAND(BINS - 1))

        def fill(v: Column, j: Column) -> Column:
            rest = F.aggregate(F.sequence(F.lit(_QUICK), F.lit(BINS - 1)), F.lit(None).cast("bigint"), lambda acc, t: F.coalesce(acc, probe(j, t)))
            chosen = F.coalesce(v, *[probe(j, F.lit(t)) for t in range(_QUICK)], rest)
            return F.xxhash64(chosen, j).bitwiseAND((1 << BITS) - 1)

        return F.transform(bins, fill)

    def pack(full: Column) -> Column:
        per = 64 // BITS
        return F.transform(
            F.sequence(F.lit(0), F.lit(BINS // per - 1)),
            lambda k: F.aggregate(F.slice(full, k * per + 1, per), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(x)),
        )

    def over(hashes: Column) -> Column:
        mins = let(F.sort_array(F.concat(hashes, markers)), first_of_bins)
        kept = F.transform(mins, lambda x: F.when(x.bitwiseAND(_LOW) != _LOW, x))
        return F.when(F.size(hashes) > 0, let(let(kept, densify), pack)).otherwise(F.expr("cast(array() as array<bigint>)"))

    return let(shingle_hashes(text, words), over)


def as_hex(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1.

    Two fingerprints of texts without words are alike (1); one against any
    other is not (0).
    """

    def differing(x: Column) -> Column:
        any_ = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(any_.bitwiseAND(F.lit(_NIBBLES)))

    apart = F.aggregate(F.zip_with(left, right, lambda a, b: a.bitwiseXOR(b)), F.lit(0), lambda acc, x: acc + differing(x))
    chance = 1.0 / (1 << BITS)
    corrected = ((BINS - apart) / F.lit(float(BINS)) - chance) / (1.0 - chance)
    return F.when((F.size(left) == 0) & (F.size(right) == 0), 1.0).when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(F.greatest(corrected, F.lit(0.0)))


def _upper_ids(docs: DataFrame) -> list[int | None]:
    """Ascending ids that end the ranges of doc_id; the last is the largest id.

    There are ``RANGES`` for each shuffle partition, whatever the table holds.
    """
    n = RANGES * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = F.array(*[F.lit(i / n) for i in range(1, n)])
    row = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.percentile_approx("doc_id", share, max(10_000, 8 * n)).alias("inner"), F.max("doc_id").alias("last")).first()
    return sorted({*(row["inner"] or []), row["last"]}) if row["last"] is not None else [None]


def _with_next(docs: DataFrame, words: int) -> DataFrame:
    """Every row with text and packed, and the next document's as next_text and next_packed.

    Ranges of ids are dealt out whole, so texts are shuffled once. The rows of a
    range's largest id are also guests at the start of the range above; those of
    the largest id of all are guests of the lowest range.
    """
    uppers = _upper_ids(docs)
    ends = _numbers(uppers, "L") if uppers != [None] else F.expr("cast(array() as array<bigint>)")
    key = F.col("doc_id").cast("bigint")
    own = F.coalesce(F.size(F.filter(ends, lambda x: x < F.col("key"))), F.lit(0))
    rows = docs.select("doc_id", key.alias("key"), whole_text().alias("text"), F.sha2(whole_text(), 256).alias("sha"), packed_fingerprint(whole_text(), words).alias("packed")).withColumn("own", F.when(F.col("key").isNull(), 0).otherwise(own))
    is_last = F.col("key").eqNullSafe(F.lit(uppers[-1]).cast("bigint"))
    is_end = F.coalesce(F.array_contains(ends, F.col("key")), F.lit(False))
    place = F.struct(F.col("own").alias("range"), F.lit(False).alias("guest"))
    above = F.struct(F.when(is_last, 0).otherwise(F.col("own") + 1).alias("range"), F.lit(True).alias("guest"))
    placed = rows.withColumn("place", F.explode(F.when(is_last | is_end, F.array(place, above)).otherwise(F.array(place)))).select("doc_id", "key", "text", "sha", "packed", "place.range", "place.guest")
    # windows over plain columns, so that one exchange serves both and carries each text once
    order = Window.partitionBy("range").orderBy(F.col("guest").desc(), F.col("key").asc_nulls_first(), "sha")
    before = placed.withColumns({f"before_{c}": F.lag(c).over(order) for c in ("guest", "key", "text", "packed")})
    # of rows that repeat an id only the first follows another id; the others take over what it found
    new_id = F.col("before_guest") | ~F.col("before_key").eqNullSafe(F.col("key"))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return before.withColumns({f"next_{c}": F.last(F.when(new_id, F.col(f"before_{c}")), ignorenulls=True).over(so_far) for c in ("text", "packed")}).where(~F.col("guest"))


def fingerprint_edits(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses.

    The edited text has its last floor(n/2) code points replaced by as many (or
    all) of the next document's first ones; next is the next smaller doc_id, and
    the largest after the smallest. Null text counts as empty, a null doc_id as
    smaller than all. Rows that repeat a doc_id each get a row, and the one with
    the largest digest stands for the id as next document. Empty tables give
    empty results; a single document is its own next; other columns are ignored.
    """
    n = F.length("text")
    edited = _with_next(docs, words).select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        "packed",
        "next_packed",
        F.concat(F.left("text", n - F.floor(n / 2).cast("int")), F.left("next_text", F.floor(n / 2).cast("int"))).alias("edited"),
    )
    return edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "packed", "next_packed", packed_fingerprint(F.col("edited"), words).alias("edited_packed")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("packed")).alias("fingerprint"),
        as_hex(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
