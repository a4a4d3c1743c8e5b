from datetime import datetime

import pictorium.operators.orphans as orphans
from pictorium.operators.orphans import Reference, orphan_references, orphan_report

AT = datetime(2026, 3, 4)


def tables(spark, parents, children):
    p = spark.createDataFrame(parents, "id string, parent string, keys int")
    c = spark.createDataFrame(children, "child string, ref string, at timestamp, key string, rng int")
    return {"people": (p, "id")}, [Reference("c.ref", c, "child", "ref", "people", "at")]


def test_nulls_blanks_and_spellings(spark):
    parents = [("Ann", None, 1), (" bob ", "x", 2), (None, None, None), ("bob", None, None)]
    children = [("1", " ANN", AT, None, 1), ("2", "", AT, None, 1), ("3", None, AT, None, 1), ("4", "Zoe", None, "k", 1), ("4", "Zoe", None, "k", 1), (None, "yan", AT, None, 1), ("5", "BOB ", AT, "z", 0)]
    found = orphan_references(*tables(spark, parents, children)).collect()
    assert sorted((r["child_key"] or "", r["key"], r["month"] or "") for r in found) == [("", "yan", "2026-03"), ("4", "zoe", ""), ("4", "zoe", "")]


def test_empty_parents_and_children(spark):
    assert orphan_references(*tables(spark, [], [("1", "a", AT, None, 1)])).count() == 1
    assert orphan_references(*tables(spark, [("a", None, 1)], [])).count() == 0


def test_many_ranges_and_salted_hot_key(spark, monkeypatch):
    monkeypatch.setattr(orphans, "KEYS_PER_RANGE", 50)
    monkeypatch.setattr(orphans, "REFS_PER_GROUP", 100)
    parents = [(f"k{n:04d}", None, n) for n in range(0, 1000, 2)]
    children = [(str(n), "k0001" if n % 3 == 0 else f"k{n % 1000:04d}", AT, None, 1) for n in range(2_000)]
    found = {r["child_key"] for r in orphan_references(*tables(spark, parents, children)).collect()}
    held = {p[0] for p in parents}
    assert found == {c[0] for c in children if c[1] not in held}


def test_report(spark):
    found = orphan_references(*tables(spark, [], [("1", "a", AT, None, 1), ("2", "a", AT, None, 1), ("3", "b", None, None, 1)]))
    rows = {r["month"]: (r["orphan_rows"], r["missing_keys"]) for r in orphan_report(found).collect()}
    assert rows == {"2026-03": (2, 1), None: (1, 1)}


def test_counted_references_give_the_same_report(spark):
    children = [(str(n), f"k{n % 5}" if n % 2 else "gone", AT if n % 3 else None, None, 1) for n in range(60)]
    args = tables(spark, [("k1", None, 1), ("k2", None, 1)], children)
    rows = [sorted(map(tuple, orphan_report(orphan_references(*args, counted=c)).collect()), key=str) for c in (False, True)]
    assert rows[0] == rows[1] and sum(r[2] for r in rows[0]) == 48
    assert "child_key" not in orphan_references(*args, counted=True).columns
