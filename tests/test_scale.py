"""Bucketed ordered helpers against plain windows and numpy, with one key holding most rows."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from docsentry.functions.scale import balanced, exact_quantiles, first_row, row_numbers, running_totals, with_halo


def skewed(spark, n=3000):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 30)}", rng.randint(0, 500), i, float(rng.randint(0, 40))) for i in range(n)]
    return spark.createDataFrame(rows, "k string, t int, id int, v double")


def test_row_numbers_equal_window(spark):
    df = skewed(spark)
    got = row_numbers(df, ["k"], F.floor(F.col("t") / 37), [F.col("t"), F.col("id")], "rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")).cast("long"))
    assert sorted(map(tuple, got.select("k", "id", "rn").collect())) == sorted(map(tuple, want.select("k", "id", "rn").collect()))


def test_running_totals_without_keys(spark):
    df = skewed(spark)
    got = running_totals(df, [], F.floor(F.col("t") / 50), [F.col("t"), F.col("id")], {"total": F.col("v")})
    want = df.withColumn("total", F.sum("v").over(Window.orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted((r["id"], r["total"]) for r in got.collect()) == sorted((r["id"], r["total"]) for r in want.collect())


def test_exact_quantiles(spark):
    df = skewed(spark)
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", F.floor(F.col("v") / 3), {"p90": ("linear", 0.9), "up": ("upper", 0.5)}).collect()}
    values = {}
    for r in df.collect():
        values.setdefault(r["k"], []).append(r["v"])
    for k, vs in values.items():
        assert abs(got[k]["p90"] - np.percentile(vs, 90)) < 1e-9
        assert got[k]["up"] == sorted(vs)[len(vs) // 2]
    overall = exact_quantiles(df, [], "v", F.floor("v"), {"p": ("linear", 0.37)}).first()["p"]
    assert abs(overall - np.percentile([v for vs in values.values() for v in vs], 37)) < 1e-9


def test_first_row_and_halo(spark):
    df = skewed(spark)
    first = {r["k"]: r["id"] for r in first_row(df, ["k"], F.struct("t", "id")).collect()}
    want = {}
    for r in df.orderBy("t", "id").collect():
        want.setdefault(r["k"], r["id"])
    assert first == want
    numbered = row_numbers(df, ["k"], F.floor(F.col("t") / 37), [F.col("t"), F.col("id")], "rn")
    halo = with_halo(numbered, "rn", 3, 64)
    w = Window.partitionBy("k", "_block").orderBy("rn").rowsBetween(-3, -1)
    got = {r["id"]: r["s"] for r in halo.withColumn("s", F.sum("v").over(w)).where("_home").collect()}
    plain = Window.partitionBy("k").orderBy("rn").rowsBetween(-3, -1)
    assert got == {r["id"]: r["s"] for r in numbered.withColumn("s", F.sum("v").over(plain)).collect()}


def test_shares_of_equal_cost(spark):
    # one text of 20 million bytes in a thousand: its size stands for it here
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 1000 == 7, 20_000_000).otherwise(F.col("id") % 5000).alias("bytes"))
    spread = balanced(rows, F.col("bytes"), [F.col("id")], 16)
    loads = sorted(r["cost"] for r in spread.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("bytes").alias("cost")).collect())
    assert len(loads) == 16 and loads[-1] < 2 * loads[8] and spread.count() == 40_000
    odd = spark.createDataFrame([(None, None), (1, None), (2, 5)], "id long, bytes long")
    assert sorted(map(str, balanced(odd, F.col("bytes"), [F.col("id")], 3).collect())) == sorted(map(str, odd.collect()))
    assert balanced(odd.limit(0), F.col("bytes"), [F.col("id")], 3).count() == 0


def test_nested_metric_values(spark):
    from docsentry.operators import metrics as M

    rows = spark.createDataFrame([(1, '{"a": {"b": [1, 2.5]}, "s": "x"}'), (2, "no json"), (3, None), (4, '{"a": 7}')], "id int, metric_data string")
    got = {r["id"]: (r["first"], r["second"], r["s"]) for r in M.with_nested(rows, {"first": ("$.a.b[0]", "int"), "second": ("$.a.b[1]", "double"), "s": ("$.s", "string")}).collect()}
    assert got == {1: (1, 2.5, "x"), 2: (None, None, None), 3: (None, None, None), 4: (None, None, None)}
