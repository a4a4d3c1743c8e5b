from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pictorium.operators import audit, latest, moderation, near_duplicates, relational, sampling

T0 = datetime(2026, 8, 11, 10)


def test_latest_ties_and_null_times(spark):
    rows = [("one", "a", T0, 1), ("one", "a", T0, 2), ("one", None, None, 3), ("one", None, T0, 4), ("two", "b", None, 5)]
    df = spark.createDataFrame(rows, "k string, v string, at timestamp, n int")
    got = {(r.k, r.v): r.n for r in latest.source_versions(df, "k", "v", "at", "n").collect()}
    assert got == {("one", "a"): 2, ("one", ""): 4, ("two", "b"): 5}
    assert latest.source_versions(df.limit(0), "k", "v", "at", "n").count() == 0


def test_current_row_prefers_time_over_version(spark):
    rows = [("x", "a", T0, 1), ("x", "b", T0 - timedelta(1), 2)]
    df = spark.createDataFrame(rows, "k string, v string, at timestamp, n int")
    assert [r.n for r in latest.current_rows(df, "k", "v", "at", "n").collect()] == [1]


def test_diversity_one_per_group(spark):
    rows = [(1, "a", 1), (2, "a", 2), (3, "b", 3), (4, None, 4), (5, None, 5)]
    df = spark.createDataFrame(rows, "i int, g string, rank int")
    got = latest.capped_per_group(df, "g", [F.col("rank")], 1, limit=10).orderBy("final_rank").collect()
    assert [(r.i, r.final_rank) for r in got] == [(1, 1), (3, 2), (4, 3)]


def test_join_validation(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "z")], "k int, b string")
    assert relational.validated_join(a, b, ["k"]).count() == 2
    with pytest.raises(relational.ContractError):
        relational.validated_join(a, b, ["k"], validate="1:1")
    with pytest.raises(relational.ContractError):
        relational.validated_join(b, a, ["k"])
    with pytest.raises(relational.ContractError, match="missing columns: q"):
        relational.require_columns(a, ["k", "q"])


def test_sync_plan_is_idempotent(spark):
    wanted = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", None)], "k string, h string")
    held = spark.createDataFrame([("b", "3"), ("c", "4"), ("d", None)], "k string, h string")
    plan = {r.k: r.action for r in relational.sync_plan(wanted, held, "k", "h").collect()}
    assert plan == {"a": "insert", "b": "update", "c": "delete", "d": "unchanged"}
    again = {r.action for r in relational.sync_plan(wanted, wanted, "k", "h").collect()}
    assert again == {"unchanged"}
    assert {r.action for r in relational.sync_plan(wanted, wanted, "k", "h", force=True).collect()} == {"update"}


def test_upsert_insert_update(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, "B"), (3, None), (3, None)], "k int, v string")
    assert sorted(relational.upsert(base, delta.distinct(), ["k"]).collect()) == [(1, "a"), (2, "B"), (3, None)]
    assert sorted((r.k for r in relational.insert_if_absent(base, delta, ["k"]).collect())) == [1, 2, 3]
    assert sorted(relational.updated(base, delta.distinct(), ["k"], ["v"]).collect()) == [(1, "a"), (2, "B")]


def test_cascade_takes_the_first_rule(spark):
    df = spark.createDataFrame([(None, 1), (True, 2), (False, 3)], "flag boolean, n int")
    got = relational.first_match(df, [("flagged", F.col("flag")), ("late", F.col("n") > 1)], "kept").collect()
    assert [r.reason for r in got] == ["kept", "flagged", "late"]


def test_quality_counts_null_checks_as_violations(spark):
    df = spark.createDataFrame([(1,), (None,)], "n int")
    got = {r.metric: r.value for r in audit.quality_counts(df, {"big": F.col("n") > 5}).collect()}
    assert got == {"row_count": 2, "big": 1}


def test_near_duplicates_equal_brute_force(spark):
    import random

    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    rows = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + base[:5]
    df = spark.createDataFrame([(n, f"{h:x}") for n, h in enumerate(rows)] + [(-1, "junk"), (-2, None)], "id int, phash string")
    got = {(r.a, r.b, r.distance) for r in near_duplicates.near_duplicates(df, "id", "phash").collect()}
    distinct = sorted(set(rows))
    want = {(f"{min(a, b):016x}", f"{max(a, b):016x}", bin(a ^ b).count("1")) for a in distinct for b in distinct if a < b and bin(a ^ b).count("1") <= 6}
    assert got == want


def test_sessions_repeat_for_a_seed_without_repeated_rows(spark):
    df = spark.createDataFrame([(g, f"{g}{n}") for g in "ab" for n in range(5)], "g string, k string")
    one = sorted(sampling.sessions(df, "g", "k", 3, seed=4).collect())
    assert one == sorted(sampling.sessions(df.repartition(3), "g", "k", 3, seed=4).collect())
    assert len({r.k for r in one}) == 6 and sorted(r.session for r in one) == [0, 0, 1, 1, 2, 2]


FEED = [
    '{"post":{"uri":"at://a/1","cid":"c1","author":{"did":"d","handle":"h","labels":[]},"record":{"text":"new piece","createdAt":"2026-01-01T00:00:00Z","langs":["en"]},"embed":{"images":[{"thumb":"t0","fullsize":"f0","alt":null},{"thumb":"t1","fullsize":"f1","alt":"cat","aspectRatio":{"width":3,"height":4}}]}}}',
    '{"reason":{"$type":"x#reasonRepost"},"post":{"uri":"at://a/2","author":{"did":"e"},"record":{"text":"quote"},"embed":{"media":{"images":[{"thumb":"t"}]},"record":{"author":{"did":"q"}}}}}',
    '{"post":{"uri":"at://a/3","author":{"did":"e"},"record":{"text":"NSFW artwork"},"embed":{"images":[{"thumb":"t"}]}}}',
    '{"post":{"uri":"at://a/4","labels":[{"val":"Porn ","neg":true},{"val":" Porn"}],"author":{"did":"e"},"record":{"text":""},"embed":{"images":[{"thumb":"t"}]}}}',
    '{"post":{"uri":"at://a/5","author":{"did":"e"},"record":{"text":"no image"}}}',
]


def test_flattening(spark):
    items = spark.createDataFrame([(x,) for x in FEED], "value string").select(F.from_json("value", moderation.FEED_SCHEMA).alias("j")).select("j.*")
    rows = moderation.flatten_feed(items).collect()
    assert sorted((r.post_uri, r.image_index, r.alt_text, r.is_repost, r.is_quote_post, r.quoted_author_did) for r in rows) == [
        ("at://a/1", 0, "", False, False, None), ("at://a/1", 1, "cat", False, False, None), ("at://a/2", 0, "", True, True, "q"),
    ]
    assert moderation.flatten_feed(items, public_safe=False).count() == 5


def test_rule_precedence(spark):
    df = spark.createDataFrame([(120, 120, True, False), (3000, 300, False, False), (900, 900, True, False), (900, 900, False, False), (None, 5, None, None)], "w bigint, h bigint, r boolean, q boolean")
    got = df.select(moderation.disposition(moderation.rule_hits(*(F.col(c) for c in "whrq"))).alias("d")).collect()
    assert [r.d for r in got] == ["force_reject", "force_review", "force_review", "continue", "force_reject"]
