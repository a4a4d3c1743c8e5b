from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
from hypothesis import given, settings, strategies as st

from pictorium.operators.delivery import IdentifierIndex, exactly_once_sink, first_deliveries, in_sorted, message_version, repeated_deliveries

SCHEMA = "delivery_id bigint, candidate_id string, post_cid string, received_at timestamp, hi string, extra int"
T0 = datetime(2026, 1, 1)


def brute(rows):
    groups = defaultdict(list)
    for d, c, p, at, *_ in rows:
        c = (c or "").strip().lower()
        if c and d is not None:
            groups[(c, (p or "").strip().lower())].append((at is None, at or T0, d))
    return {d for g in groups.values() for _, _, d in sorted(g)[1:]}


def found(spark, rows, **options):
    return {r[0] for r in repeated_deliveries(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def test_nulls_ties_and_spellings(spark):
    rows = [
        (1, " A ", None, T0, "x", 1),
        (2, "a", "", T0, "x", 1),
        (3, "a", "V1", T0 + timedelta(days=1), None, None),
        (4, "A", "v1 ", None, None, None),
        (5, None, "v1", T0, None, None),
        (6, "", "v1", T0, None, None),
        (7, "b", "v", T0, None, None),
        (8, "b", "v", T0 - timedelta(days=3), None, None),
        (None, "b", "v", T0 - timedelta(days=9), None, None),
    ]
    assert found(spark, rows) == brute(rows) == {2, 4, 7}


def test_empty(spark):
    assert found(spark, []) == set()


def test_hot_version_and_many_slices(spark):
    rng = np.random.default_rng(0)
    rows = [(k, "hot" if rng.random() < 0.4 else f"c{rng.integers(0, 300)}", f"v{rng.integers(0, 2)}", T0 + timedelta(minutes=int(rng.integers(0, 500))), None, None) for k in range(2_000)]
    assert found(spark, rows, slices=5, per_prefix=100) == brute(rows)


def test_kept_and_repeated_are_all(spark):
    rows = [(k, f"c{k % 7}", None, T0 + timedelta(hours=k), None, None) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {r["delivery"] for r in first_deliveries(df).collect()}
    assert kept | found(spark, rows) == set(range(40)) and kept == set(range(7))


def test_runs_are_merged_and_still_known(spark):
    index = IdentifierIndex(spark, prefixes=3, merge_every=2)
    for batch in range(5):
        rows = [(batch * 10 + k, f"c{batch * 5 + k}", None, T0, None, None) for k in range(10)]
        novel = index.check(message_version(spark.createDataFrame(rows, SCHEMA)), "received_at", "delivery_id")
        assert novel.count() == (10 if batch == 0 else 5)
    # Runs of one size class are merged, so what is held is rewritten seldom.
    assert len(index.runs) <= 2 and index.held == 30


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3))), st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), min_size=1))
def test_binary_search(held, asked):
    held = sorted(set(held))
    hi, lo = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
    q = np.array(asked, np.int64)
    assert in_sorted(hi, lo, q[:, 0], q[:, 1]).tolist() == [tuple(a) in set(held) for a in asked]


def test_an_index_is_found_again_and_its_prefixes_grow(spark, tmp_path):
    place = f"file://{tmp_path}/index"
    for batch in range(4):
        index = IdentifierIndex(spark, place=place, per_prefix=8, merge_every=2)
        rows = [(batch * 10 + k, f"c{batch * 5 + k}", None, T0, None, None) for k in range(10)]
        novel = index.check(message_version(spark.createDataFrame(rows, SCHEMA)), "received_at", "delivery_id")
        assert novel.count() == (10 if batch == 0 else 5)
    again = IdentifierIndex(spark, place=place)
    assert again.held == 25 and again.prefixes > 2 and again.prefixes * 8 >= 25
    held = again.state.read("prefix int, hi array<bigint>, lo array<bigint>").collect()
    assert sum(len(r.hi) for r in held) == 25 and all(list(r.hi) == sorted(r.hi) for r in held)


class Killed(Exception):
    pass


def test_a_sink_killed_between_its_steps_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    import pytest

    place, out = f"file://{tmp_path}/index", f"file://{tmp_path}/out"
    how = {"id_col": "candidate_id", "version_col": "post_cid", "arrived": "received_at", "delivery": "delivery_id"}
    batches = [[(n * 10 + k, f"c{(n * 4 + k) % 15}", None, T0, None, None) for k in range(10)] for n in range(3)]
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    with monkeypatch.context() as patch:
        patch.setattr(IdentifierIndex, "accept", lambda *_: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            exactly_once_sink(IdentifierIndex(spark, place=place), out, **how)(frames[0], 0)
    for epoch in (0, 0, 1, 1, 0, 2):  # each run by a process that was started anew
        exactly_once_sink(IdentifierIndex(spark, place=place), out, **how)(frames[epoch], epoch)
    got = [r.candidate_id for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted({c for b in batches for _, c, *_ in b})
