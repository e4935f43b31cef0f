"""Files by key, all or none; and files by address."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexiloom.sources import keyed, tables


def there(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file()}


def test_keys_name_files(spark, tmp_path):
    out = tmp_path / "out"
    rows = spark.range(40).select(F.concat(F.lit("reports/j"), F.col("id"), F.lit("/summary é.html")).alias("key"), F.when(F.col("id") > 0, F.concat(F.lit("<p>"), F.col("id"))).alias("value")).repartition(7)
    keyed.write_keyed(rows, str(out))
    want = {f"reports/j{i}/summary é.html": f"<p>{i}" if i else "" for i in range(40)}
    assert there(out) == want and {p.name for p in out.iterdir()} == {"reports"}
    keyed.write_keyed(spark.createDataFrame([("reports/j3/summary é.html", "new"), ("x", "y")], "key string, value string"), str(out), mode="append")
    assert there(out) == want | {"reports/j3/summary é.html": "new", "x": "y"}
    keyed.write_keyed(spark.createDataFrame([("only", bytearray(b"this"))], "key string, value binary"), f"file://{out}")
    assert there(out) == {"only": "this"}
    keyed.write_keyed(rows.limit(0), str(out))
    assert there(out) == {}


@pytest.mark.parametrize("bad", [None, "", "/a", "a//b", "a/../b", "..", "_pending/x", "a/"])
def test_a_failed_task_leaves_no_file(spark, tmp_path, bad):
    rows = spark.createDataFrame([(f"k{i}", "v") for i in range(20)] + [(bad, "v")], "key string, value string").repartition(4)
    with pytest.raises(PySparkException):
        keyed.write_keyed(rows, str(tmp_path))
    assert not [k for k in there(tmp_path) if not k.startswith("_pending/")]


def test_repeated_keys_fail(spark, tmp_path):
    (tmp_path / "a").write_text("old")
    with pytest.raises(PySparkException):
        keyed.write_keyed(spark.createDataFrame([("a", "1"), ("a", "2")], "key string, value string").repartition(2), str(tmp_path))
    assert there(tmp_path) == {"a": "old"}


def test_files_by_address(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "a.txt").write_text("é text")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "long.txt").write_text("x" * 100)
    (tmp_path / "empty.txt").write_text("")
    addresses = ["sub dir/a.txt", "bad.txt", "long.txt", "none.txt", "empty.txt", None, "sub dir/a.txt"]
    tasks = spark.createDataFrame([(i, u, "x") for i, u in enumerate(addresses)], "n int, url string, length string")
    for folder in (str(tmp_path), f"file://{tmp_path}/"):
        got = {r.n: (r.text, r.error) for r in tables.fetch_files(tasks.drop("length"), folder, 50).collect()}
        failed = "Failed to download file from URL: "
        assert got == {0: ("é text", None), 1: (None, "Failed to analyze file: "), 2: (None, failed + "longer than 50 bytes"), 3: (None, failed + "none.txt"), 4: (None, failed + "empty.txt"), 5: (None, failed), 6: ("é text", None)}
