from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pictorium.llm import capping, mixing

SCHEMA = "result_id bigint, search bigint, artist string, score double, bin int, _score double"


def brute(rows, cap):
    groups = defaultdict(list)
    for r, s, a, x, *_ in rows:
        if s is not None and a is not None:
            x = None if x is None or x != x else x
            groups[s, a].append((x is None, -(x or 0.0), r))
    return {r for g in groups.values() for _, _, r in sorted(g)[cap:]}


def out(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r[0] for r in capping.left_out(df, ["search", "artist"], score="score", record="result_id", **options).collect()}


def test_nulls_ties_infinities(spark):
    scores = [0.5, 0.5, 0.5, None, float("nan"), 0.9, float("inf"), -1.0, 0.5]
    rows = [(n, 1, "a", s, 7, 0.0) for n, s in enumerate(scores)] + [(20, None, "a", 1.0, 1, 1.0), (21, 1, None, 1.0, 1, 1.0), (22, 2, "a", None, 1, None)]
    for cap in (1, 3, 6, 20):
        assert out(spark, rows, cap=cap) == brute(rows, cap)
    assert out(spark, rows, cap=0) == {*range(9), 22}


def test_hot_contributor(spark):
    rng = np.random.default_rng(0)
    rows = [(n, int(rng.integers(0, 4)), "hot" if rng.random() < 0.5 else f"a{rng.integers(0, 9)}", float(np.round(rng.random(), 2)) if rng.random() < 0.9 else None, 0, 0.0) for n in range(3_000)]
    assert out(spark, rows, cap=3) == brute(rows, 3)
    assert out(spark, rows, max_share=0.01) == brute(rows, int(0.01 * len(rows)))


def test_empty_and_equal_scores(spark):
    assert out(spark, [], cap=3) == set()
    rows = [(n, 1, "a", 0.0, 0, 0.0) for n in range(9)]
    assert out(spark, rows, cap=3) == set(range(3, 9))
    df = spark.createDataFrame(rows, SCHEMA)
    assert capping.capped(df, ["artist"], score="score", record="result_id", cap=2).count() == 2


DOCS = "doc_id bigint, text string, source string, tokens int, key string"


def documents(n=600):
    rng = np.random.default_rng(3)
    names = ["big", "Big ", "BIG", "mid", "small"]
    return [(k, " ".join("word" for _ in range(int(rng.integers(1, 40)))), names[min(4, int(rng.integers(0, 9)) // 2)], 5, "x") for k in range(n)]


def test_shares_come_out_and_repeats_are_capped(spark):
    docs = spark.createDataFrame([*documents(), (None, "x", "big", 1, ""), (900, None, "big", 1, ""), (901, "  ", None, 1, ""), (902, "", "mid", 1, "")], DOCS)
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "Mid", 0.3, 2), ("m", "small", 0.2, 5), ("n", "small", 0.9, 3), ("n", "none here", 0.1, 3)], "mix_id string, source string, target_share double, max_repeats bigint")
    mixed = mixing.mixture(docs, targets)
    shares = {(r.mix_id, r.source): r for r in mixing.mixture_shares(mixed, targets).collect()}
    for (mix, source), r in shares.items():
        if mix == "m":
            assert r.actual_share == pytest.approx(r.target_share, abs=0.01)
    assert shares["m", "mid"].passes <= 2 and shares["m", "small"].passes <= 5 and shares["n", "small"].passes == 3
    assert shares["n", "none_here"].actual_tokens == 0
    assert mixed.groupBy("mix_id", "doc_id").count().where("count > 1").count() == 0


def test_prefix_sums_are_those_of_one_sort(spark):
    docs = spark.createDataFrame([(n, f"s{n % 2}", n % 7 + 1) for n in range(500)], "doc_id bigint, source string, tokens bigint")
    rows = mixing.prefix_sums(docs, seed=5, per_range=40).withColumn("k", F.xxhash64(F.lit(5), "doc_id")).collect()
    for source in ("s0", "s1"):
        total = 0
        for r in sorted((r for r in rows if r.source == source), key=lambda r: (r.k, r.doc_id)):
            total += r.tokens
            assert r.upto == total
        assert total == r.source_tokens


def test_exact_budget_and_empty_tables(spark):
    docs = spark.createDataFrame(documents(200), DOCS)
    targets = spark.createDataFrame([("m", "big", 1.0, 9)], "mix_id string, source string, target_share double, max_repeats bigint")
    total = mixing.mixture(docs, targets, total_tokens=3_000).agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
    assert 3_000 - 60 < total <= 3_000
    assert mixing.mixture(docs, targets.limit(0)).count() == 0
    assert mixing.mixture(docs.limit(0), targets).count() == 0


def test_tokens_of_whole_long_texts():
    path = f"{mixing.TOKENIZERS}/{mixing.VOCABULARY}"
    sentence = "The quick brown fox, painted twice. "
    assert mixing.count_tokens(sentence * 20_000, path) == pytest.approx(20_000 * mixing.count_tokens(sentence, path), rel=0.15)
    assert mixing.count_tokens(None, path) == mixing.count_tokens("", path) == 0
    assert mixing.count_tokens("x" * 300_000, path) > 10_000
