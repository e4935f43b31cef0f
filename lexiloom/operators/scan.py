"""Running values over ranges that follow the data: a distributed prefix scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: How totals of rows that stand one after the other become the total of all.
_KINDS = {
    "sum": (F.sum, lambda a, b: a + b, 0),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b), 0),
}


def running(rows: DataFrame, by: list[str], order: list[Column | str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """``rows`` with a running value for every name of ``values``: its kind (sum or xor) and column of whole numbers.

    A row's value is over the rows of its key ``by`` (none: of the table) that
    stand before it in ``order``, and itself. Spark samples (by, order) and deals
    the rows out by range, so that ranges follow the data; values run within the
    rows that a key has in a range, and start from the totals of its ranges
    before. No task gets a hot key whole. At most one key enters a range from the
    range before, so there are fewer starts than ranges and they can be sent to
    all tasks. ``order`` should tell a key's rows apart: rows that it doesn't are
    in one range, in any order. Null keys are a key; empty rows stay empty.
    """
    columns = rows.columns
    held = rows.select("*", *[F.coalesce(v, F.lit(_KINDS[kind][2])).cast("bigint").alias(f"__{n}") for n, (kind, v) in values.items()])
    held = cut(held.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    totals = held.groupBy(*by, "__range").agg(*[_KINDS[kind][0](f"__{n}").alias(f"__{n}") for n, (kind, _) in values.items()])
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(c).alias(f"__of_{i}") for i, c in enumerate(by)],
        F.col("__range").alias("__at"),
        *[_KINDS[kind][0](f"__{n}").over(before).alias(f"__start_{n}") for n, (kind, _) in values.items()],
    ).where(F.col(f"__start_{next(iter(values))}").isNotNull())
    same = F.col("__range") == F.col("__at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__of_{i}"))
    upto = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = held.select("*", *[_KINDS[kind][0](f"__{n}").over(upto).alias(f"__upto_{n}") for n, (kind, _) in values.items()])
    out = within.join(F.broadcast(starts), same, "left")
    return out.select(*columns, *[_KINDS[kind][1](F.col(f"__upto_{n}"), F.coalesce(f"__start_{n}", F.lit(_KINDS[kind][2]))).alias(n) for n, (kind, _) in values.items()])
