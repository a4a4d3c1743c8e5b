import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from pictorium.operators import inference, relational, vector_search
from pictorium.operators.relational import ContractError
from pictorium.functions import vectors
from pictorium.runtime import fresh_path, intermediate, retried, shared_dir, written
from pictorium.sources import readers, writers
from pictorium.streaming import intake


def test_feeds_have_no_hidden_limit(spark, tmp_path):
    (tmp_path / "ann").mkdir()
    for page in range(14):
        body = {"feed": [{"n": page}], **({"cursor": f"c{page + 1}"} if page < 13 else {})}
        (tmp_path / "ann" / ("first.json" if page == 0 else f"c{page}.json")).write_text(json.dumps(body))
    spark.dataSource.register(readers.FeedPages)
    df = spark.read.format("feed_pages").option("path", str(tmp_path))
    assert df.load().count() == 14
    cut = df.option("pages", 3).option("mark_cut", "true").load().collect()
    assert [(r.page, r["item"]) for r in cut if r.page < 0] == [(-1, '{"cursor": "c3"}')] and len(cut) == 4


def test_sqlite_in_ranges_read_only_and_missing(spark, tmp_path):
    place = str(tmp_path / "x.db")
    with sqlite3.connect(place) as db:
        db.execute("CREATE TABLE works (id TEXT, n INTEGER)")
        db.executemany("INSERT INTO works VALUES (?, ?)", [(f"w{k}", k if k % 3 else None) for k in range(25)])
    spark.dataSource.register(readers.SqliteTable)
    read = lambda table, path=place: spark.read.format("sqlite_table").schema("n bigint, id string").option("path", path).option("table", table).option("rows", 10).load()
    rows = read("works")
    assert rows.count() == 25 and rows.where("n is null").count() == 9 and rows.rdd.getNumPartitions() == 3
    assert read("nothing").count() == 0 and read("works", str(tmp_path / "none.db")).count() == 0


def test_config_types_checks_and_hash(tmp_path):
    place = tmp_path / "c.json"
    place.write_text('{"a": 2, "share": 1}')
    settings = readers.load_config(str(place), {"a": 1, "share": 0.5, "name": "x"}, {"a": lambda v: v > 0})
    assert settings == {"a": 2, "share": 1, "name": "x"} and readers.config_hash(settings) == readers.config_hash(dict(reversed(settings.items())))
    with pytest.raises(ContractError, match="a can't be 2"):
        readers.load_config(str(place), {"a": 1, "share": 0.5}, {"a": lambda v: v > 5})
    with pytest.raises(ContractError, match="a must be a str"):
        readers.load_config(str(place), {"a": "1", "share": 0.5})


def test_manifest_of_records(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"name": "ann", "n": 1}, {"name": "bob"}]')
    assert [tuple(r) for r in readers.read_manifest(spark, str(tmp_path / "m.json"), "name string, n int").collect()] == [("ann", 1), ("bob", None)]
    with pytest.raises(ContractError):
        readers.read_manifest(spark, str(tmp_path / "m.json"), "name string")


def test_reports_have_no_row_limit(spark, tmp_path):
    writers.write_json_report(spark.range(12_000).select("id", F.lit(None).cast("string").alias("x")), str(tmp_path / "r.json"))
    rows = json.loads((tmp_path / "r.json").read_text())
    assert len(rows) == 12_000 and sorted(r["id"] for r in rows) == list(range(12_000))
    writers.write_json_report(spark.range(0), str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text()) == []


def test_lines_roster_gallery_and_bundle(spark, tmp_path):
    df = spark.createDataFrame([("ann", None), ("bob", "</script>")], "name string, note string")
    writers.write_json_lines(df, str(tmp_path / "lines"))
    assert {r.name: r.note for r in spark.read.json(str(tmp_path / "lines")).collect()} == {"ann": None, "bob": "</script>"}
    writers.write_roster(df, "name", str(tmp_path / "roster.txt"), "pilot")
    assert {r.name for r in readers.read_list(spark, str(tmp_path / "roster.txt")).collect()} == {"ann", "bob"}
    writers.write_gallery(df.select(F.to_json(F.struct("name", "note")).alias("j")), "j", str(tmp_path / "g.html"), "a < b")
    page = (tmp_path / "g.html").read_text()
    payload = page.split('id="payload">')[1].split("</script>")[0]
    assert "a &lt; b" in page and {r["name"]: r.get("note") for r in json.loads(payload)} == {"ann": None, "bob": "</script>"}
    store = writers.ObjectStore(spark, str(tmp_path / "o"))
    first = writers.publish_bundle(store, {"b": b"2", "a": b"1"}, {"run": 7})
    assert first == writers.publish_bundle(store, {"a": b"1", "b": b"2"}, {"run": 7})
    assert json.loads(store.get(first["path"]))["artifacts"]["a"]["bytes"] == 1


def test_checkpoints_per_settings(spark, tmp_path):
    work = spark.createDataFrame([("ann",), ("bob",), (None,)], "actor string")
    store = intake.CheckpointStore(spark, str(tmp_path / "done"), {"pages": 3})
    assert store.mark(work.where("actor = 'ann'"), "actor") == 1 and store.mark(work.where("actor = 'ann'"), "actor") == 0
    assert {r.actor for r in store.pending(work, "actor").collect()} == {"bob", None}
    assert intake.CheckpointStore(spark, str(tmp_path / "done"), {"pages": 4}).pending(work, "actor").count() == 3


def test_durability(spark):
    def fails(_):
        raise OSError("disk full")

    rows = spark.createDataFrame([(1, None)], "id int, error string")
    assert intake.durable(rows, fails).first().error == "OSError: disk full"
    assert intake.durable(rows, fails, strict=False).first().error is None and intake.durable(rows, lambda df: df.count()).first().error is None


def test_retries():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("again")
        return "done"

    assert retried(flaky, 3) == "done" and len(calls) == 3
    with pytest.raises(OSError):
        retried(lambda: (_ for _ in ()).throw(OSError("no")), 2)


def test_feature_cache_and_smoke_test(spark, tmp_path):
    provider = inference.HashEmbedding(4)
    cache = inference.FeatureCache(spark, str(tmp_path / "cache"), provider)
    assert cache.get().count() == 0
    rows = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0]), ("a", [1.0, 0.0, 0.0, 0.0]), ("b", [float("nan"), 0.0, 0.0, 1.0]), ("c", [1.0]), ("d", None)], "content_hash string, vector array<float>")
    assert cache.put(rows) == 1 and cache.put(rows) == 0 and [r.content_hash for r in cache.get().collect()] == ["a"]
    assert inference.FeatureCache(spark, str(tmp_path / "cache"), inference.HashEmbedding(4, version="2")).get().count() == 0
    assert inference.smoke_test(provider, [b"x", b"y"])["passed"]

    class Shaky(inference.HashEmbedding):
        def embed(self, contents):
            return super().embed(contents) + len(contents)

    assert not inference.smoke_test(Shaky(4), [b"x", b"y"])["passed"]
    with pytest.raises(ValueError):
        inference.smoke_test(provider, [])


def test_bytes_and_point_hash(spark):
    import hashlib

    import numpy as np

    df = spark.createDataFrame([([1.5, -2.0],), (None,), ([],)], "v array<float>").withColumn("b", vectors.to_bytes("v"))
    assert [r.x for r in df.select(vectors.from_bytes("b").alias("x")).collect()] == [[1.5, -2.0], None, []]
    odd = spark.createDataFrame([(b"abc",)], "b binary").select(vectors.from_bytes("b").alias("x"), vectors.reshaped(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), 2).alias("y")).first()
    assert odd.x is None and odd.y is None
    got = df.where("v is not null and size(v) > 0").select(vectors.point_hash([vectors.to_bytes("v")], F.lit('{"a":1}')).alias("h")).first().h
    assert got == hashlib.sha256(np.array([1.5, -2.0], "<f4").tobytes() + b'{"a":1}').hexdigest()


def test_zip_strict_and_funnel_limits(spark):
    a, b = spark.createDataFrame([(3,), (1,), (2,)], "x int"), spark.createDataFrame([("q",), ("r",), ("p",)], "y string")
    assert {(r.x, r.y) for r in relational.zip_strict(a, b, ["x"], [F.col("y").desc()]).collect()} == {(1, "r"), (2, "q"), (3, "p")}
    with pytest.raises(ContractError):
        relational.zip_strict(a, b.limit(2), ["x"], ["y"])
    with pytest.raises(ValueError):
        vector_search.funnel_limits(50, 100, 20, 10)


def test_errors_and_counters(spark):
    df = spark.createDataFrame([(k, "bad" if k % 2 else None) for k in range(300)], "k int, e string")
    count, some = relational.sample_errors(df, F.col("e"), 100)
    assert count.first().errors == 150 and some.count() == 100
    parts = [spark.createDataFrame([("a", 2), ("b", 1)], "o string, n bigint"), spark.createDataFrame([("a", 3)], "o string, n bigint")]
    assert {r.o: r.n for r in relational.merge_counters(parts, ["o"]).collect()} == {"a": 5, "b": 1}


def test_intermediate_tables_go_with_their_block(spark):
    import os

    with intermediate(spark):
        df = written(spark.range(3).toDF("n"), "block")
        place = [p for p in os.listdir(shared_dir(spark)[7:]) if p.startswith("block-")]
        assert df.count() == 3 and place
    assert not [p for p in os.listdir(shared_dir(spark)[7:]) if p.startswith("block-")]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        fresh_path(Session(), "x")


def test_low_variance_rule(spark):
    from pictorium.operators.moderation import disposition, rule_hits

    df = spark.createDataFrame([(900, 900, False, 1.0), (900, 900, True, 50.0), (900, 900, None, None)], "w int, h int, a boolean, s double")
    hits = rule_hits(F.col("w"), F.col("h"), F.lit(False), F.lit(False), F.col("a"), F.col("s"))
    assert [r.d for r in df.select(disposition(hits).alias("d")).collect()] == ["force_review", "force_reject", "continue"]
