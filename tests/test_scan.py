"""Running values over ranges against plain loops."""

import random
from itertools import accumulate

from pyspark.sql import functions as F

from lexiloom.operators.scan import running


def test_running_values_of_hot_and_null_keys(spark, many_ranges):
    rule = random.Random(2)
    rows = [(rule.choice(["hot"] * 8 + ["a", "b", None]), i, rule.randrange(-50, 50) if rule.random() < 0.9 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, at bigint, value bigint").repartition(7)
    got = running(df, ["key"], [F.col("at").desc()], {"total": ("sum", F.col("value")), "place": ("sum", F.lit(1)), "mixed": ("xor", F.col("value"))}).collect()
    want = set()
    for key in ("hot", "a", "b", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: -r[1])
        values = [r[2] or 0 for r in own]
        want |= {(*r, t, i + 1, x) for i, (r, t, x) in enumerate(zip(own, accumulate(values), accumulate(values, lambda a, b: a ^ b)))}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)


def test_running_values_of_a_whole_table_and_of_none(spark, many_ranges):
    df = spark.range(0, 1000, 1, 6).select(F.col("id").alias("at"))
    got = running(df, [], ["at"], {"n": ("sum", F.lit(2))}).orderBy("at").collect()
    assert [r.n for r in got] == [2 * (i + 1) for i in range(1000)]
    assert running(df.where("at < 0"), [], ["at"], {"n": ("sum", F.lit(2))}).count() == 0
