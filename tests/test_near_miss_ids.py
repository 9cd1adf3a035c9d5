"""Near-miss ids of all names, whatever their keys."""

import duckdb
from pyspark.sql import functions as F

from gridwake.functions.text import near_miss
from gridwake.operators.matching import near_misses
from gridwake.plans import REGISTRY

from .oracle import differences

NAMES = ["", "C", "Customer#000000000", "Customer#000000001", "Customer#000000101", "Customer#00000000", "Customer#0000000000", "Customer#000000010", "ustomer#000000000", "Customer#999", "aab", "aaab", "ab", "ba", "b", None]


def test_every_row_is_asked(spark, tmp_path):
    rows = [(i * 100 + 7, n) for i, n in enumerate(NAMES)] + [(100, "ab"), (207, NAMES[2]), (None, "aa"), (3, "Customer#998")]  # the third repeats a row
    spark.createDataFrame(rows, "c_custkey long, c_name string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = REGISTRY["near_miss_ids"].run(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"create view customer as select * from read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    want = con.execute(REGISTRY["near_miss_ids"].sql).df()
    assert not differences(got, want)
    one = lambda a, b: a.startswith(b) or b.startswith(a) or len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1 or abs(len(a) - len(b)) == 1 and min(a, b, key=len) in {max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] for i in range(max(len(a), len(b)))}
    pairs = [(a, b) for a, x in rows for b, y in rows if x is not None and y is not None and x != y and one(x, y)]
    assert len(got) == len(pairs) and {(a, b) for a, b in pairs if a and b} == {(int(a), int(b)) for a, b in got.dropna().itertuples(index=False)}


def test_a_pair_of_names_meets_once(spark):
    names = spark.createDataFrame([(i, "a" * i + c + "b" * j) for i in range(5) for j in range(5) for c in ("", "a", "b", "ba")], "key long, name string").distinct()
    a, b = names.toDF("asked_key", "a"), names.toDF("key", "b")
    want = a.crossJoin(b).where(near_miss(F.col("a"), F.col("b"))).select("asked_key", "key")
    assert sorted(near_misses(names, names).collect()) == sorted(want.collect())
    assert near_misses(names.limit(0), names).isEmpty() and near_misses(names, names.limit(0)).isEmpty()
