import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pictorium.functions import vectors
from pictorium.operators import evaluation, inference, vector_search


def test_group_is_left_out_before_truncation(spark):
    df = spark.createDataFrame([("q", "a", [1.0, 0.0]), ("a-match", "a", [0.99, 0.01]), ("b-match", "b", [0.9, 0.1]), ("none", "b", None), ("zero", "c", [0.0, 0.0])], "id string, artist string, v array<double>")
    got = vector_search.exact_top_k(df.where("id = 'q'"), df, "id", "v", 1, group="artist").collect()
    assert [(r["item"], r["rank"]) for r in got] == [("b-match", 1)]


def test_exact_top_k_equals_numpy_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK_BYTES", 8 * 6 * 10)
    x = np.random.default_rng(0).normal(size=(80, 6))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id bigint, v array<double>").repartition(5)
    got = {(r["query"], r["rank"]): r["item"] for r in vector_search.exact_top_k(df.where("id < 25"), df, "id", "v", 4).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    for q in range(25):
        want = np.lexsort((np.arange(80), -s[q]))[:4]
        assert [got[q, r] for r in (1, 2, 3, 4)] == want.tolist()


def test_no_queries(spark):
    df = spark.createDataFrame([], "id bigint, v array<double>")
    assert vector_search.exact_top_k(df, df, "id", "v", 3).count() == 0


def test_two_stage_flips_the_pooled_winner(spark):
    rows = [("q", [1.0, 0.0], [[1.0, 0.0]]), ("pooled", [1.0, 0.1], [[0.0, 1.0]]), ("patch", [1.0, 0.5], [[1.0, 0.0]]), ("far", [-1.0, 0.0], [[1.0, 0.0]])]
    df = spark.createDataFrame(rows, "id string, v array<double>, p array<array<double>>")
    got = vector_search.two_stage(df.where("id = 'q'"), df, "id", "v", F.col("p"), k=2, shortlist=2).orderBy("rank").collect()
    assert [(r["item"], r["pooled_rank"]) for r in got] == [("patch", 2), ("pooled", 1)]


def test_fusion_and_tail(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query string, item string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query string, item string, rank int")
    fused = vector_search.reciprocal_rank_fusion([a, b]).orderBy("rank").collect()
    assert [r["item"] for r in fused] == ["y", "x", "z"]
    hits = spark.createDataFrame([("q", c, n + 1) for n, c in enumerate("abcd")], "query string, item string, rank int")
    scores = spark.createDataFrame([("q", "b", 0.2), ("q", "c", 0.9), ("q", "d", 1.0)], "query string, item string, patch_score double")
    again = vector_search.rerank_with_tail(hits, scores, 3).orderBy("final_rank").collect()
    assert [r["item"] for r in again] == ["c", "b", "a", "d"]


def judged(spark):
    return spark.createDataFrame([("m", "q", 1, True, 3, 0.9), ("m", "q", 2, False, 3, -1.0), ("m", "q", 3, True, 3, 1.0)], "mode string, query string, rank int, relevant boolean, result_count int, score double")


def test_ranking_measures(spark):
    r = evaluation.ranking_metrics(judged(spark), ["mode"], "query").first()
    assert (r.annotation_coverage, r.mrr, r.relevant) == (1.0, 1.0, 2) and math.isclose(r.judged_precision, 2 / 3, abs_tol=1e-9)
    assert math.isclose(r.map, 5 / 6, abs_tol=1e-9) and math.isclose(r.ndcg, 1.5 / (1 + 1 / math.log2(3)), abs_tol=1e-9)
    at = {x.k: x for x in evaluation.prefix_metrics(judged(spark), ["mode"], "query").collect()}
    assert at[1].judged_precision == 1.0 and at[5].pool_recall == 1.0 and at[1].pool_recall == 0.5


def test_calibration_closes_the_last_bin(spark):
    bins = {r.bin: (r.judgments, r.precision) for r in evaluation.score_calibration(judged(spark), ["mode"]).collect()}
    assert bins == {0: (1, 0.0), 1: (0, None), 2: (0, None), 3: (0, None), 4: (2, 1.0)}


def test_threshold_sweep_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(float(np.round(s, 2)), bool(rng.random() < s)) for s in rng.random(200)] + [(None, True), (1.5, True), (-0.5, False)]
    sweep = evaluation.threshold_sweep(spark.createDataFrame(rows, "score double, truth boolean"), "score", "truth").collect()
    known = [r for r in rows if r[0] is not None]
    for r in sweep:
        chosen = [t for s, t in known if (s >= r.threshold if r.kind == "accept" else s <= r.threshold)]
        good = sum(t is (r.kind == "accept") for t in chosen)
        assert r.decisions == len(chosen)
        assert r.precision == (round(good / len(chosen), 9) if chosen else None)


def test_recommendation(spark):
    rows = [(0.9, True), (0.4, False)]
    sweep = evaluation.threshold_sweep(spark.createDataFrame(rows, "score double, truth boolean"), "score", "truth")
    r = evaluation.recommended_thresholds(sweep, 0.2, 0.2, 1).first()
    assert (r.accept_threshold, r.reject_threshold) == (0.41, 0.40)


def test_classes_of_either_side(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "t string, p string")
    got = {r["class"]: (r.support, r.precision, r.recall, r.f1) for r in evaluation.multiclass_metrics(df, "t", "p").collect()}
    assert got["a"] == (2, 0.5, 0.5, 0.5) and got["b"] == (0, 0.0, None, None) and got["c"] == (1, None, 0.0, None)


def test_a_bad_row_fails_alone_and_cache_is_used(spark):
    class Fragile(inference.HashEmbedding):  # local, so that it travels by value
        def embed(self, contents):
            if any(c == b"bad" for c in contents):
                raise RuntimeError("broken")
            return inference.HashEmbedding.embed(self, contents)

    df = spark.createDataFrame([("1", "good"), ("2", "bad"), ("3", "fine"), ("4", None)], "k string, content string")
    got = {r.k: r for r in inference.embed_rows(df, "k", "content", Fragile(4)).collect()}
    assert got["2"].error == "RuntimeError: broken" and len(got["1"].vector) == 4 and "4" not in got
    cache = inference.embed_rows(df.where("k = '1'"), "k", "content", inference.HashEmbedding(4)).drop("error")
    both = {r.k: r for r in inference.embed_missing(df.where("k <> '4'"), cache, "k", "content", Fragile(4)).collect()}
    assert set(both) == {"1", "2", "3"} and both["1"].vector == pytest.approx(got["1"].vector)


def test_patch_matches(spark):
    df = spark.createDataFrame([("q", "i", [[1.0, 0.0], [0.0, 1.0]], [[0.0, 1.0], [1.0, 0.0]])], "query string, item string, a array<array<double>>, b array<array<double>>")
    got = vector_search.patch_matches(df, "a", "b", 1).orderBy("query_patch").collect()
    assert [(r.query_patch, r.item_patch, r.similarity) for r in got] == [(0, 1, 1.0), (1, 0, 1.0)]
    assert df.select(vectors.maxsim(F.col("a"), F.col("b"))).first()[0] == 1.0
