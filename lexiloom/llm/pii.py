"""Personal data: patterns, and terms that give their owners away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. For every
such entity the corpus tells which terms reveal it: with p(e) the share of
documents that hold entity e and p(e|t) the share of the documents with term t
that hold e too, the pointwise mutual information log p(e|t)/p(e) is what t tells
of e, out of the -log p(e) that there is to tell. Terms are runs of two or more
letters and digits of any script. A term that tells ``disclosure`` of e or more,
in ``support`` documents or more, is a span wherever it stands, with or without
e. In sanitised text it is generalised to its class, or removed where it tells
everything.

Counts are exact. A pair (e, t) is counted only if e and t are in ``support``
documents with entities each, and t in no more of them than it may be to tell
enough of e even if all of e's documents held it; this drops common words beside
rare entities, which most are. ``reach`` asks for terms that also stand within so
many code points of e in one document at least (``None``, the default: anywhere).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..sources.shared import forget, stored
from .common import bounded_batches, cut, flag_bits, passes, whole_text

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: What a revealing term is generalised to: digits, letters and digits, letters.
CLASSES = ("[NUMBER]", "[CODE]", "[TERM]")
#: Code points on either side of an entity in which a term must stand once; None: anywhere in the document.
REACH: int | None = None
DISCLOSURE, SUPPORT = 0.8, 2
#: Terms that a worker remembers or counts at once, and code points of texts whose finds it holds.
_HELD, _TOGETHER = 1 << 17, 1 << 19
#: One part in so many of the documents is counted first, to drop terms that are too common already there.
FIRST = 8

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A digit run never begins within another, so no start is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]{2,}")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """Driven by the at signs, as runs of local characters can be very long."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            end = domain.end()
            out.append((start, end))
        at = text.find("@", max(end, at + 1))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in code points, end exclusive."""

    def small(m: re.Match) -> bool:
        return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))

    def card(m: re.Match) -> bool:
        digits = _NOT_DIGIT.sub("", m[0])
        return 13 <= len(digits) <= 19 and luhn(digits)

    def phone(m: re.Match) -> bool:
        return 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15

    rest = [[m.span() for m in pattern.finditer(text) if good(m)] for pattern, good in ((_IP, small), (_CARD, card), (_PHONE, phone))]
    return [_emails(text), *rest]


def _entity(kind: str, value: str) -> int:
    value = value.lower() if kind == "email" else value if kind == "ip" else _NOT_DIGIT.sub("", value)
    return xxhash.xxh64_intdigest(f"{kind}:{value}") - (1 << 63)


def _outside(text: str, spans: list[list[tuple[int, int]]], lo: int = 0, hi: int | None = None) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of each whole word of a part of ``text`` that touches no span."""
    hi = len(text) if hi is None else hi
    taken = sorted(s for kind in spans for s in kind)
    starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for m in _WORD.finditer(text, lo, hi):
        a, b = m.span()
        cut_off = (a == lo and a > 0 and text[a - 1].isalnum()) or (b == hi and b < len(text) and text[b].isalnum())
        i = bisect_left(starts, b) - 1
        if not cut_off and not (i >= 0 and ends[i] > a):
            yield m[0].lower(), a, b


def _free(text: str, spans: list[list[tuple[int, int]]], words: set[str]) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) of each of some words of ``text`` that touches no span."""
    if not words:
        return
    taken = sorted(s for kind in spans for s in kind)
    starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for m in _WORD.finditer(text):
        if (w := m[0]) in words:
            a, b = m.span()
            i = bisect_left(starts, b) - 1
            if not (i >= 0 and ends[i] > a):
                yield w, a, b


def entities_of(text: str, spans: list[list[tuple[int, int]]]) -> set[int]:
    return {_entity(kind, text[a:b]) for kind, own in zip(KINDS, spans, strict=True) for a, b in own}


def near_terms(text: str, spans: list[list[tuple[int, int]]], reach: int) -> set[tuple[int, str]]:
    """(entity, term) of each whole word in reach of an entity and in no span."""
    out = set()
    for kind, own in zip(KINDS, spans, strict=True):
        for start, end in own:
            e = _entity(kind, text[start:end])
            for lo, hi in ((max(0, start - reach), start), (end, min(len(text), end + reach))):
                out.update((e, t) for t, _, _ in _outside(text, spans, lo, hi))
    return out


_FOUND = "entities array<bigint>, terms array<string>, near array<struct<e:bigint,t:string>>"


def _find(batches: Iterator[pd.DataFrame], reach: int | None) -> Iterator[pd.DataFrame]:
    """Entities and terms of each text, and which of them are near; texts without entities give no row."""
    for pdf in batches:
        rows, size = [], 0
        for text in pdf["text"]:
            spans = base_spans(text)
            if any(spans):
                size += len(text)
                near = [] if reach is None else [{"e": e, "t": t} for e, t in near_terms(text, spans, reach)]
                rows.append((list(entities_of(text, spans)), list({t for t, _, _ in _outside(text, spans)}), near))
            if size >= _TOGETHER:
                yield pd.DataFrame(rows, columns=["entities", "terms", "near"])
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=["entities", "terms", "near"])


class _Flagged(dict):
    """Whether each word of a text passes ``flag_bits``; remembers words."""

    def __init__(self, bits: bytes):
        self.bits = bits

    def __missing__(self, word: str) -> bool:
        if len(self) >= _HELD:
            self.clear()
        self[word] = out = passes(self.bits, xxhash.xxh64_intdigest(word.lower(), 42))
        return out

    def words(self, text: str) -> set[str]:
        """The words of ``text``, as they stand, whose terms are flagged."""
        return {w for w in set(_WORD.findall(text)) if self[w]}

    def held(self, text: str) -> set[str]:
        """The flagged terms of ``text``."""
        return {w.lower() for w in self.words(text)}


def _count(batches: Iterator[pd.DataFrame], bits: bytes) -> Iterator[pd.DataFrame]:
    """Documents without entities that hold each flagged term, as partial counts."""
    seen: Counter[str] = Counter()
    known = _Flagged(bits)

    def out() -> pd.DataFrame:
        return pd.DataFrame({"t": list(seen), "n": list(seen.values())}).astype({"t": "object", "n": "int64"})

    for pdf in batches:
        for text in pdf["text"]:
            held = known.held(text)
            if held and not any(base_spans(text)):
                seen.update(held)
            if len(seen) >= _HELD:
                yield out()
                seen.clear()
    yield out()


def disclosing_terms(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, reach: int | None = REACH) -> DataFrame:
    """``(e, t, told)``: terms that reveal an entity, and how much of it (0 to 1)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(whole_text().alias("text"))
    found, folder = stored(texts.mapInPandas(lambda it: _find(it, reach), _FOUND).withColumn("doc", F.monotonically_increasing_id()), "entities")
    p = F.col("n_entity") / F.lit(float(max(docs.count(), 1)))

    def told(n_both, n_term):
        return F.when(p >= 1, 0.0).otherwise(1.0 - F.log(n_both / n_term) / F.log(p))

    entities, terms = found.select("doc", F.explode("entities").alias("e")), found.select("doc", F.explode("terms").alias("t"))
    most = F.when(p >= 1, 0.0 if disclosure > 0 else float("inf")).otherwise(F.col("n_entity") * F.pow(p, F.lit(disclosure - 1.0)) * (1 + 1e-9))
    known = cut(entities.groupBy("e").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= support).withColumn("most", most))
    upto = known.agg(F.max("most")).first()[0] or 0.0
    beside = terms.groupBy("t").agg(F.count(F.lit(1)).alias("n_beside")).where((F.col("n_beside") >= support) & (F.col("n_beside") <= F.lit(upto)))
    pairs = entities.join(known, "e").join(terms.join(beside, "t"), "doc").where("n_beside <= most")
    pairs = pairs.groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_both"), F.max("n_entity").alias("n_entity"), F.max("n_beside").alias("n_beside"))
    hopeful = pairs.where((F.col("n_both") >= support) & (told(F.col("n_both"), F.col("n_beside")) >= disclosure))
    if reach is not None:
        hopeful = hopeful.join(found.select(F.explode("near").alias("n")).select("n.e", "n.t").distinct(), ["e", "t"], "left_semi")
    hopeful = cut(hopeful)
    forget(spark, folder)
    # the other documents are counted in two parts: a term that is too common after the first is not counted in the second
    first = F.pmod(F.xxhash64("text"), F.lit(FIRST)) == 0
    for part in (first, ~first):
        shared = spark.sparkContext.broadcast(flag_bits(hopeful.select("t").distinct(), F.xxhash64("t")))
        elsewhere = texts.where(part).mapInPandas(lambda it, bits=shared: _count(it, bits.value), "t string, n bigint").groupBy("t").agg(F.sum("n").alias("n"))
        counted = hopeful.join(elsewhere, "t", "left").withColumn("n_beside", F.col("n_beside") + F.coalesce("n", F.lit(0))).drop("n")
        hopeful = cut(counted.where(told(F.col("n_both"), F.col("n_beside")) >= disclosure))
    return hopeful.select("e", "t", told(F.col("n_both"), F.col("n_beside")).alias("told"))


_MARKED = "doc_id string, text_hash bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, held array<struct<t:string,a:bigint,b:bigint>>"


def _mark(batches: Iterator[pd.DataFrame], bits: bytes) -> Iterator[pd.DataFrame]:
    """Base spans, and every occurrence of a flagged term, of each text."""
    known = _Flagged(bits)
    columns = ["doc_id", "text_hash", *(f"n_{k}" for k in KINDS), "base", "held"]
    for pdf in batches:
        rows, size = [], 0
        for doc_id, text_hash, text in zip(pdf["doc_id"], pdf["text_hash"], pdf["text"], strict=True):
            spans = base_spans(text)
            base = ",".join(f"{kind}:{a}:{b}" for kind, own in zip(KINDS, spans, strict=True) for a, b in own)
            held = [{"t": w.lower(), "a": a, "b": b} for w, a, b in _free(text, spans, known.words(text))]
            rows.append((doc_id, text_hash, *map(len, spans), base, held))
            size += len(text)
            if size >= _TOGETHER:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=columns)


def marked(docs: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Every row of ``docs`` with a row number and its base spans; ``(row, terms)``: its spans of revealing terms, beside an entity or not."""
    revealing = disclosing_terms(docs, **how).groupBy("t").agg(F.max("told").alias("told"))
    shared = docs.sparkSession.sparkContext.broadcast(flag_bits(revealing, F.xxhash64("t")))
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    found = cut(rows.mapInPandas(lambda it: _mark(it, shared.value), _MARKED)).withColumn("row", F.monotonically_increasing_id())  # stable: the checkpoint fixes rows and partitions
    held = found.where(F.size("held") > 0).select("row", F.explode("held").alias("x")).select("row", "x.t", "x.a", "x.b")
    hit = held.join(revealing, "t").select("row", F.struct("a", "b", "told").alias("span"))
    return found, hit.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("terms"))


def personal_data(docs: DataFrame, **how) -> DataFrame:
    """Spans of personal data of every row of ``docs(doc_id, text, ...)``.

    Returns doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256 of the
    base spans (kind:start:end, comma-joined) and spans, which adds the revealing
    terms. ``how``: disclosure, support and reach. Null and empty texts have no spans; a null doc_id stays null; repeated
    rows each get a row; an empty table gives an empty result; other columns are
    ignored.
    """
    found, hits = marked(docs, **how)
    as_text = F.array_join(F.transform("terms", lambda x: F.concat(F.lit(f"{TERM}:"), x["a"].cast("string"), F.lit(":"), x["b"].cast("string"))), ",")
    counts = [f"n_{k}" for k in KINDS]
    return (
        found.select("row", "doc_id", *counts, "base")
        .join(hits, "row", "left")
        .select(
            F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
            *counts,
            F.coalesce(F.size("terms"), F.lit(0)).cast("bigint").alias("n_term"),
            F.sha2("base", 256).alias("base_sha256"),
            F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("terms") > 0, as_text)).alias("spans"),
        )
    )


def generalised(term: str) -> str:
    number, code, letters = CLASSES
    return number if term.isdigit() else letters if term.isalpha() else code


def replaced(text: str, terms: list[tuple[int, int, float]]) -> str:
    """``text`` with base spans and terms generalised; overlapping spans act as one.

    What only becomes a base span by that (digits that no longer run on) goes too.
    """
    spans = [(a, b, f"[{kind.upper()}]") for kind, own in zip(KINDS, base_spans(text), strict=True) for a, b in own]
    spans += [(a, b, "" if told >= 1.0 - 1e-9 else generalised(text[a:b])) for a, b, told in terms]
    out, at, last = [], 0, 0
    for a, b, label in sorted(spans, key=lambda s: s[0]):
        if a >= last:
            out += [text[at:a], label]
            at = b
        last = at = max(at, b)
    out = "".join([*out, text[at:]])
    return replaced(out, []) if any(base_spans(out)) else out


def sanitize(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with personal data replaced in text, and n_chars (if any) set anew.

    Base spans become [EMAIL], [IP], [CARD] or [PHONE]; a revealing term becomes
    [NUMBER], [CODE] or [TERM], or goes where it tells everything. ``how``:
    disclosure, support and reach. Texts without spans stay as they are, null
    texts included. Rows and columns stay: rows with a null doc_id find their
    terms by their text, repeated rows are cleaned alike, an empty table stays
    empty. Columns may have any names.
    """
    found, hits = marked(docs, **how)
    hits = hits.join(found.select("row", "doc_id", "text_hash"), "row")
    hits = hits.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.first("terms").alias("terms"))
    own = docs.select(F.struct("*").alias("own"), F.col("doc_id").cast("string").alias("own_id"), F.xxhash64(whole_text()).alias("own_hash"))
    joined = own.join(hits, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")), "left")

    def clean(text: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else replaced(t, [(int(x["a"]), int(x["b"]), float(x["told"])) for x in (() if own is None else own)]) for t, own in zip(text, terms, strict=True)], dtype="object")

    cleaned = joined.select("own", pandas_udf(clean, "string")("own.text", "terms").alias("cleaned"))
    new = {"text": F.col("cleaned")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("cleaned"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return cleaned.select(*[new.get(c, F.col("own").getField(c)).alias(c) for c in docs.columns])
