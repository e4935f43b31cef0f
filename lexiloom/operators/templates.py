"""Canonical form of predicate templates such as ``X result from Y``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stem import with_stems
from ..functions.text import trim_control


def normalize(templates: DataFrame, column: str = "template") -> DataFrame:
    """Add pid, swapped and logical to rows with a template column.

    The text is trimmed, lower-cased and its white space collapsed. Fewer than
    three words, or no x or y after the first, are left as they are. Else the
    second word is the verb (stemmed), the last x or y the second variable, and
    the words between are the preposition. ``swapped`` says that it begins with y.
    """
    clean = F.regexp_replace(F.lower(trim_control(F.col(column))), r"[ \t\n\x0B\f\r]+", " ")
    out = templates.withColumn("__c", clean).withColumn("__t", F.split("__c", " "))
    last = "case when array_position(reverse(slice(__t, 2, size(__t))), 'x') = 0 and array_position(reverse(slice(__t, 2, size(__t))), 'y') = 0 then null else size(__t) - array_min(filter(array(array_position(reverse(slice(__t, 2, size(__t))), 'x'), array_position(reverse(slice(__t, 2, size(__t))), 'y')), p -> p > 0)) end"
    out = out.withColumn("__l", F.expr(f"case when size(__t) >= 3 then cast({last} as int) end"))
    out = out.withColumn("__v", F.expr("case when __l is not null then get(__t, 1) end"))
    out = with_stems(out, ["__v"])
    prep = F.expr("array_join(slice(__t, 3, greatest(__l - 2, 0)), ' ')")
    verb = F.expr("coalesce(__v, '')")
    swapped = F.expr("size(__t) >= 3 and get(__t, 0) = 'y'")

    def path(x, y):
        return F.concat(x, F.lit(" "), verb, F.when(prep != "", F.concat(F.lit(" "), prep)).otherwise(""), F.lit(" "), y)

    logical = path(F.when(swapped, "Y").otherwise("X"), F.expr("if(get(__t, __l) = 'x', 'X', 'Y')"))
    return (
        out.withColumn("pid", F.when(F.col("__l").isNull(), F.col("__c")).otherwise(path(F.lit("X"), F.lit("Y"))))
        .withColumn("swapped", swapped)
        .withColumn("logical", F.when(F.col("__l").isNull(), F.col("__c")).otherwise(logical))
        .drop("__c", "__t", "__l", "__v")
    )


def whitelist(pairs: DataFrame) -> DataFrame:
    """Distinct canonical paths of both sides of all pairs."""
    both = pairs.select(F.explode(F.array("lhs", "rhs")).alias("template"))
    return normalize(both.distinct()).select("pid").distinct()
