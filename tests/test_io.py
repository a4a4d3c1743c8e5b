import json
import os

import pytest

from pictorium.operators.relational import ContractError
from pictorium.sources import readers, writers
from pictorium.streaming import intake

SCHEMA = "candidate_id string, post_cid string, received_at timestamp, delivery_id bigint"


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_strict_and_lenient_logs(spark, tmp_path):
    place = lines(tmp_path / "log.jsonl", [{"a": 1}, "{broken", {"a": 2}])
    assert readers.read_json_log(spark, place, "a int", strict=False).where("a is not null").count() == 2
    with pytest.raises(Exception):
        readers.read_json_log(spark, place, "a int").collect()
    assert [r.line for r in readers.malformed_lines(spark, place, "a int").collect()] == ["{broken"]


def test_lists_ids_and_missing_tables(spark, tmp_path):
    place = lines(tmp_path / "names.txt", ["# note", "", "  ann ", "bob"])
    assert [r.name for r in readers.read_list(spark, place).collect()] == ["ann", "bob"]
    assert readers.read_or_empty(spark, str(tmp_path / "nowhere"), "a int").count() == 0
    df = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "y")], "k string, d string")
    assert readers.distinct_ids(df, "k", "d = 'x'").count() == 1
    with pytest.raises(ContractError):
        readers.distinct_ids(df, "k")


def test_review_sheet(spark, tmp_path):
    place = tmp_path / "review.csv"
    place.write_text("id,label,note\n1,yes,\n2,,\n,,\n")
    rows, counts = readers.read_review_csv(spark, str(place), ["id", "label", "note"], ["id", "label"])
    assert rows.count() == 1 and tuple(counts.first()) == (2 + counts.first().blank, 1, counts.first().blank, 1)
    with pytest.raises(ContractError, match="missing columns: other"):
        readers.read_review_csv(spark, str(place), ["other"], ["other"])


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.JPG").write_bytes(b"x")
    (tmp_path / "d" / "b.txt").write_bytes(b"y")
    got = readers.read_files(spark, str(tmp_path)).collect()
    assert [r.sha256 for r in got] == ["2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"]


def test_feed_pages_follow_cursors(spark, tmp_path):
    os.makedirs(tmp_path / "ann")
    (tmp_path / "ann" / "first.json").write_text('{"feed":[{"n":1}],"cursor":"c2"}')
    (tmp_path / "ann" / "c2.json").write_text('{"feed":[{"n":2}]}')
    spark.dataSource.register(readers.FeedPages)
    df = spark.read.format("feed_pages").option("path", str(tmp_path))
    assert sorted((r.page, r["item"]) for r in df.load().collect()) == [(0, '{"n": 1}'), (1, '{"n": 2}')]
    assert spark.read.format("feed_pages").option("path", str(tmp_path)).option("pages", 1).load().count() == 1


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text("a = 2\n")
    assert readers.load_config(str(tmp_path / "c.toml"), {"a": 1, "b": 3}) == {"a": 2, "b": 3}
    with pytest.raises(ContractError):
        readers.load_config(str(tmp_path / "c.toml"), {"b": 3})


def test_append_once(spark, tmp_path):
    place = str(tmp_path / "log")
    df = spark.createDataFrame([("a", None), ("a", None), ("b", "1")], "k string, v string")
    assert writers.append_new(df, place, ["k", "v"]) == 2
    assert writers.append_new(df, place, ["k", "v"]) == 0
    assert writers.append_changed(df, str(tmp_path / "labels"), ["k", "v"]) == 2
    assert spark.read.parquet(place).count() == 2


def test_replace_is_whole(spark, tmp_path):
    place = str(tmp_path / "t")
    writers.replace_table(spark.range(3).toDF("n"), place)
    writers.replace_table(spark.read.parquet(place).where("n > 0"), place)
    assert spark.read.parquet(place).count() == 2 and os.listdir(tmp_path) == ["t"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("=SUM(A1)", 1)], "t string, n int")
    writers.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().t == "'=SUM(A1)"
    writers.write_json_report(df, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"n": 1, "t": "=SUM(A1)"}]
    writers.write_ordered(spark.createDataFrame([(2,), (1,)], "n int"), str(tmp_path / "o"), ["n"])
    assert [r.n for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [1, 2]
    writers.write_table(spark.createDataFrame([], "a int"), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).columns == ["a"]


def test_objects(spark, tmp_path):
    store = writers.ObjectStore(spark, str(tmp_path / "o"))
    path = store.put("raw", b"content", ".bin")
    assert store.put("raw", b"content", ".bin") == path and store.get(path) == b"content" and store.exists(path)
    os.remove(os.path.join(os.path.dirname(path), "." + os.path.basename(path) + ".crc"))
    with open(path, "wb") as file:
        file.write(b"other")
    with pytest.raises(ContractError):
        store.put("raw", b"content", ".bin")
    assert store.delete(path) and not store.exists(path)
    with pytest.raises(ContractError):
        store.path("raw", "XYZ")


def test_versions_and_archive(spark, tmp_path):
    table = writers.VersionedTable(spark, str(tmp_path / "v"))
    first = table.write(spark.range(1), "m1")
    second = table.write(spark.range(2), "m2")
    table.promote(first, "m1")
    table.promote(second, "m2")
    with pytest.raises(ContractError):
        table.promote(first, "m2")
    assert table.current().count() == 2
    spark.range(3).write.parquet(str(tmp_path / "data"))
    kept = writers.archive(spark, str(tmp_path / "data"), str(tmp_path / "old"), "2026")
    assert not os.path.exists(tmp_path / "data") and writers.restore(spark, kept).endswith("data")
    assert spark.read.parquet(str(tmp_path / "data")).count() == 3
    writers.log_run(spark, str(tmp_path / "runs"), "r", "start", {"a": 1})
    assert spark.read.parquet(str(tmp_path / "runs")).first().event == "start"


def feed(path, name, rows):
    lines(path / name, [{"candidate_id": c, "post_cid": v, "received_at": "2026-01-01T00:00:00Z", "delivery_id": n} for c, v, n in rows])


def test_stream_resumes_and_keeps_versions_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    feed(tmp_path / "in", "1.json", [("a", None, 1), ("a", "", 2), ("b", "x", 3)])
    stream = lambda: intake.file_stream(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=1)
    from pictorium.operators.delivery import IdentifierIndex

    index = IdentifierIndex(spark, prefixes=2)
    intake.once_only(spark, stream(), str(tmp_path / "out"), str(tmp_path / "cp"), index)
    feed(tmp_path / "in", "2.json", [("b", "x", 4), ("b", "y", 5)])
    intake.once_only(spark, stream(), str(tmp_path / "out"), str(tmp_path / "cp"), index)
    intake.once_only(spark, stream(), str(tmp_path / "out"), str(tmp_path / "cp"), index)
    assert sorted(r.delivery_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3, 5]


def test_stream_dedupe_state(spark, tmp_path):
    (tmp_path / "in").mkdir()
    feed(tmp_path / "in", "1.json", [("a", None, 1), ("a", "", 2), ("b", "x", 3)])
    seen = []
    rows = intake.versioned(intake.file_stream(spark, str(tmp_path / "in"), SCHEMA), at="received_at")
    intake.process_available(rows, lambda df, _: seen.append(df.count()), str(tmp_path / "cp"))
    assert sum(seen) == 2


def test_resume_filter_and_error_budget(spark):
    work = spark.createDataFrame([("a", None), ("b", "1"), ("c", "1")], "candidate_id string, post_cid string")
    done = spark.createDataFrame([("a", "", "m1", None), ("b", "1", "m1", "failed"), ("c", "1", "m0", None)], "candidate_id string, post_cid string, model string, error string")
    left = intake.completed_filter(work, done, ["candidate_id", "post_cid"], {"model": "m1"})
    assert sorted(r.candidate_id for r in left.collect()) == ["b", "c"]
    outcomes = spark.createDataFrame([(True,), (True,), (False,), (None,)], "ok boolean")
    assert intake.error_budget(outcomes, "ok", 0.5) == 0.5
    with pytest.raises(ContractError):
        intake.error_budget(outcomes, "ok", 0.05)
