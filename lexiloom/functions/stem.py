"""Porter stemming as a chain of SQL expressions, the same text for any engine.

Each step is a CASE over regular expressions on the word so far. ``rlike`` builds
an engine's regular-expression test. Apply it to distinct words and join back.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import kept

_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"
_SOME = f"^({_C})?{_V}{_C}"
_MORE = f"^({_C})?{_V}{_C}{_V}{_C}"
_ONE = f"^({_C})?{_V}{_C}({_V})?$"
_VOWEL = f"^({_C})?[aeiouy]"
_SHORT = "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$"

# The suffix rules of the published algorithm.
_STEP_3 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
_STEP_4 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_5 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

Test = Callable[[str, str], str]


def _split(suffixes) -> tuple[str, str]:
    """Expressions of what stands before the longest of some suffixes, and of it."""
    pattern = f"(?s)^(.*?)({'|'.join(suffixes)})$"
    return f"regexp_extract(w, '{pattern}', 1)", f"regexp_extract(w, '{pattern}', 2)"


def _less(n: int) -> str:
    return f"substr(w, 1, length(w) - {n})"


def _replace(rules: dict[str, str], rlike: Test) -> str:
    before, suffix = _split(rules)
    into = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.items())
    return f"CASE WHEN {rlike('w', f'({"|".join(rules)})$')} AND {rlike(before, _SOME)} THEN concat({before}, CASE {suffix} {into} ELSE '' END) ELSE w END"


def steps(rlike: Test) -> list[str]:
    """Expressions over the column ``w``, each to be applied to the last one's result.

    The first takes the word; a mark ``+`` at the end of a word says between the
    third and fourth that an ending -ed or -ing was taken off.
    """
    five, suffix = _split((*_STEP_5, "ion"))
    ed, _ = _split(("ed", "ing"))
    return [
        "CASE WHEN length(lower(w)) <= 2 THEN concat('!', lower(w)) WHEN substr(lower(w), 1, 1) = 'y' THEN concat('Y', substr(lower(w), 2)) ELSE lower(w) END",
        f"CASE WHEN {rlike('w', '^!')} THEN w WHEN {rlike('w', 'sses$')} THEN {_less(2)} WHEN {rlike('w', 'ies$')} THEN {_less(2)} WHEN {rlike('w', '(?s)[^s]s$')} THEN {_less(1)} ELSE w END",
        f"CASE WHEN {rlike('w', '^!')} THEN w WHEN {rlike('w', 'eed$')} THEN CASE WHEN {rlike(_less(3), _SOME)} THEN {_less(1)} ELSE w END WHEN {rlike('w', '(ed|ing)$')} AND {rlike(ed, _VOWEL)} THEN concat({ed}, '+') ELSE w END",
        f"CASE WHEN NOT {rlike('w', '[+]$')} OR {rlike('w', '^!')} THEN w WHEN {rlike('w', '(at|bl|iz)[+]$')} THEN concat({_less(1)}, 'e')"
        f" WHEN substr(w, length(w) - 1, 1) = substr(w, length(w) - 2, 1) AND length(w) > 2 AND {rlike('w', '[^aeiou][+]$')} THEN CASE WHEN {rlike('w', '[lsz][+]$')} THEN {_less(1)} ELSE {_less(2)} END"
        f" WHEN {rlike(_less(1), _SHORT)} THEN concat({_less(1)}, 'e') ELSE {_less(1)} END",
        f"CASE WHEN NOT {rlike('w', '^!')} AND {rlike('w', 'y$')} AND {rlike(_less(1), _VOWEL)} THEN concat({_less(1)}, 'i') ELSE w END",
        _replace(_STEP_3, rlike),
        _replace(_STEP_4, rlike),
        f"CASE WHEN {rlike('w', f'({"|".join(_STEP_5)}|ion)$')} AND {rlike(five, _MORE)} AND ({suffix} <> 'ion' OR {rlike(five, '[st]$')}) THEN {five} ELSE w END",
        f"CASE WHEN {rlike('w', '(?s)[^!].*e$')} AND ({rlike(_less(1), _MORE)} OR ({rlike(_less(1), _ONE)} AND NOT {rlike(_less(1), _SHORT)})) THEN {_less(1)} ELSE w END",
        f"CASE WHEN {rlike('w', 'll$')} AND {rlike('w', _MORE)} THEN {_less(1)} ELSE w END",
        "CASE WHEN substr(w, 1, 1) = '!' THEN substr(w, 2) WHEN substr(w, 1, 1) = 'Y' THEN concat('y', substr(w, 2)) ELSE w END",
    ]


def _re(pattern: str) -> re.Pattern:
    """A pattern of the expressions for Python: there too the end is before a last line's end."""
    return re.compile(pattern.replace("$", "(?=(?:\\r\\n|(?<!\\r)\\n|[\\r\\u0085\\u2028\\u2029])?\\Z)"))


_RE = {p: _re(p).search for p in (_SOME, _MORE, _ONE, _VOWEL, _SHORT, "sses$", "ies$", "(?s)[^s]s$", "eed$", "(ed|ing)$", "(at|bl|iz)[+]$", "[+]$", "[^aeiou][+]$", "[lsz][+]$", "y$", "[st]$", "(?s)[^!].*e$", "ll$")}
_PARTS = {id(x): (_re(f"({'|'.join(x)})$").search, _re(f"(?s)^(.*?)({'|'.join(x)})$").search) for x in (_STEP_3, _STEP_4)}
_ED, _FIVE = _re("(?s)^(.*?)(ed|ing)$").search, _re(f"(?s)^(.*?)({'|'.join((*_STEP_5, 'ion'))})$").search


@lru_cache(maxsize=1 << 17)
def stem_word(word: str) -> str:
    """``stem`` of one word, by the same steps, for tasks that have words at hand already."""
    has, less = (lambda p, x: _RE[p](x) is not None), (lambda x, n: x[: max(len(x) - n, 0)])
    w = word.lower()
    if len(w) <= 2:
        return w
    w = "Y" + w[1:] if w[0] == "y" else w
    marked = w[0] == "!"
    if not marked:
        w = less(w, 2) if has("sses$", w) or has("ies$", w) else less(w, 1) if has("(?s)[^s]s$", w) else w
        if has("eed$", w):
            w = less(w, 1) if has(_SOME, less(w, 3)) else w
        elif has("(ed|ing)$", w) and (before := m[1] if (m := _ED(w)) else "") is not None and has(_VOWEL, before):
            w = before + "+"
        if has("[+]$", w):
            if has("(at|bl|iz)[+]$", w):
                w = less(w, 1) + "e"
            elif len(w) > 2 and w[-2] == w[-3] and has("[^aeiou][+]$", w):
                w = less(w, 1 if has("[lsz][+]$", w) else 2)
            else:
                w = less(w, 1) + ("e" if has(_SHORT, less(w, 1)) else "")
        if has("y$", w) and has(_VOWEL, less(w, 1)):
            w = less(w, 1) + "i"
    for rules in (_STEP_3, _STEP_4):
        ends, split = _PARTS[id(rules)]
        if ends(w) and (m := split(w)) and has(_SOME, m[1]):
            w = m[1] + rules[m[2]]
    if (m := _FIVE(w)) and has(_MORE, m[1]) and (m[2] != "ion" or has("[st]$", m[1])):
        w = m[1]
    if has("(?s)[^!].*e$", w) and (has(_MORE, less(w, 1)) or (has(_ONE, less(w, 1)) and not has(_SHORT, less(w, 1)))):
        w = less(w, 1)
    if has("ll$", w) and has(_MORE, w):
        w = less(w, 1)
    return w[1:] if w[:1] == "!" else "y" + w[1:] if w[:1] == "Y" else w


def stem(words: DataFrame, column: str = "word", to: str = "stem") -> DataFrame:
    """Add the stem of a column of words; null has none (null)."""
    out = words.withColumn("w", F.col(column))
    for step in steps(lambda x, p: f"({x} rlike '{p}')"):
        out = out.withColumn("w", F.expr(step))
    return out.withColumnRenamed("w", to)


def stem_sql(relation: str, column: str = "word") -> str:
    """The same over a relation for DuckDB: its columns and ``stem``."""
    sql = f"SELECT *, {column} AS w FROM {relation}"
    for step in steps(lambda x, p: f"regexp_matches({x}, '{p}')"):
        sql = f"SELECT * REPLACE ({step} AS w) FROM ({sql})"
    return f"SELECT * RENAME (w AS stem) FROM ({sql})"


def stems_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """word and stem of every word in some columns, each stemmed once and written once."""
    words = df.select(F.explode(F.array(*columns)).alias("word")).where("word is not null").distinct()
    return kept(stem(words))


def with_stems(df: DataFrame, columns: list[str], stems: DataFrame | None = None) -> DataFrame:
    """Replace columns of words by their stems (of ``stems_of``); null stays null."""
    stems = stems_of(df, columns) if stems is None else stems
    for c in columns:
        df = df.join(stems.select(F.col("word").alias(c), F.col("stem").alias("__stem")), c, "left").withColumn(c, F.col("__stem")).drop("__stem")
    return df
