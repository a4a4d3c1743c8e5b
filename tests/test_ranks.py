import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from pictorium.operators import ranks


def brute(rows, q):
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    out = {}
    for g, vs in groups.items():
        vs.sort()
        n = len(vs)
        out[g] = vs[max(1, math.ceil(q * n)) - 1]
    return out


def test_places_in_large_skewed_and_small_groups(spark):
    rng = np.random.default_rng(0)
    rows = [("big", float(v)) for v in rng.normal(size=30_000).round(3)] + [("ties", 1.0)] * 20_000 + [("ties", 2.0)] * 900 + [("few", float(v)) for v in range(7)] + [(None, 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        got = {r.g: r.x for r in ranks.values_at(df, ["g"], "v", q, {"x": ranks.discrete(q)}).collect()}
        assert got == brute(rows, q), q
    low, high = ranks.between(0.95)
    row = {r.g: (r.a, r.b) for r in ranks.values_at(df, ["g"], "v", 0.95, {"a": low, "b": high}).collect()}
    big = sorted(v for g, v in rows if g == "big")
    at = 0.95 * (len(big) - 1)
    assert row["big"] == (big[math.floor(at)], big[math.ceil(at)])


def test_no_keys_no_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "x", 3.0), (2, "x", 4.0)], "_v int, _n string, v double")
    assert ranks.values_at(df, ["_n"], "v", 0.5, {"m": ranks.discrete(0.5)}).collect()[0].m == 3.0
    assert ranks.values_at(df.limit(0), ["_n"], "v", 0.5, {"m": ranks.discrete(0.5)}).count() == 0
    assert ranks.values_at(df, [], "v", 1.0, {"m": ranks.discrete(1.0)}).collect()[0].m == 4.0


def test_joined_keeps_null_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, n int")
    right = spark.createDataFrame([(None, 7), ("a", 8)], "k string, m int")
    assert {(r.k, r.n, r.m) for r in ranks.joined(left, right, ["k"], ["m"]).select(F.col("k"), "n", "m").collect()} == {(None, 1, 7), ("a", 2, 8)}
