import math
import uuid

import pytest
from pyspark.sql import functions as F

from pictorium.functions import geometry, keys, numeric, text, times, vectors
from pictorium.operators.vector_search import gram_schmidt


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


def test_normalised_text(spark):
    raw = "WORK in \n  ﬁne　PROGRESS "
    assert one(spark, text.normalize_text(F.col("t")), "t string", (raw,)) == "work in fine progress"
    assert one(spark, text.normalize_text(F.col("t")), "t string", (None,)) == ""


def test_terms_match_whole_words(spark):
    scored = lambda t: text.with_text_scores(spark.createDataFrame([(t,)], "t string"), "t").first()
    s = scored("sketch, commissioné and my cat: wip_ wip")
    assert s.positive_terms == ["sketch", "wip"] and s.negative_terms == ["my cat"] and s.net_score == 0.25
    empty = scored("")
    assert (empty.positive_score, empty.negative_score, empty.net_score) == (0.0, 0.0, 0.0)


def test_wilson_and_guards(spark):
    low, high = numeric.wilson(F.col("h"), F.col("n"))
    got = one(spark, F.struct(low.alias("l"), high.alias("h")), "h int, n int", (8, 10))
    assert math.isclose(got.l, 0.4901624715, abs_tol=1e-9) and math.isclose(got.h, 0.9433178486, abs_tol=1e-9)
    none = one(spark, F.struct(low.alias("l"), high.alias("h")), "h int, n int", (0, 0))
    assert none.l is None and none.h is None
    assert one(spark, numeric.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, numeric.clamp(F.lit(float("nan")), 0, 1)) == 0 and one(spark, numeric.clamp(F.lit(7.0), 0, 1)) == 1


def test_softmax_family(spark):
    s = one(spark, numeric.softmax(F.array(F.lit(1000.0), F.lit(1000.0))))
    assert s == [0.5, 0.5]
    assert math.isclose(one(spark, numeric.logsumexp(F.array(F.lit(1000.0), F.lit(1000.0)))), 1000 + math.log(2))
    assert one(spark, numeric.sigmoid(F.lit(-800.0))) == 0.0 and one(spark, numeric.sigmoid(F.lit(0.0))) == 0.5


def planned(spark, width, height, *how):
    return geometry.with_transform_plan(spark.createDataFrame([(width, height)], "w int, h int"), "w", "h", "p", *how).first().p


@pytest.mark.parametrize("width,height,want", [(800, 400, (0, 0, 0.56, 448, 224, 0, 112, 112)), (400, 1200, (0, 100, 0.448, 179, 448, 134, 0, 0)), (100, 100, (0, 0, 4.48, 448, 448, 0, 0, 0))])
def test_geometry(spark, width, height, want):
    p = planned(spark, width, height)
    assert (p.crop_left, p.crop_top, p.scale_factor, p.resized_width, p.resized_height, p.pad_left, p.pad_top, p.pad_bottom) == want


def test_geometry_with_other_ratio(spark):
    p = planned(spark, 400, 1200, 448, 2.0)
    assert (p.crop_top, p.crop_bottom, p.resized_width, p.resized_height, p.pad_left, p.pad_right) == (200, 200, 224, 448, 112, 112)
    assert planned(spark, 0, 5) is None and planned(spark, None, 5) is None


def test_geometry_round_trip(spark):
    df = geometry.with_transform_plan(spark.createDataFrame([(37.0, 911.0, 400, 1200)], "x double, y double, w int, h int"), "w", "h", "p")
    sx, sy = geometry.to_standard(F.col("x"), F.col("y"), F.col("p"))
    back = df.withColumns({"sx": sx, "sy": sy}).select(*geometry.to_original(F.col("sx"), F.col("sy"), F.col("p"))).first()
    assert math.isclose(back[0], 37) and math.isclose(back[1], 911)


def test_keys(spark):
    name = "art_1é"
    assert one(spark, keys.uuid5(uuid.NAMESPACE_URL, F.col("n")), "n string", (name,)) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert one(spark, keys.stable_json_hash(F.col("j")), "j string", ('{"b":1,"a":"é"}',)) == one(spark, keys.stable_json_hash(F.col("j")), "j string", ('{"a": "é", "b": 1}',))
    assert one(spark, keys.stable_json_hash(F.col("j")), "j string", ("{",)) is None
    assert one(spark, keys.content_path("n", F.lit("xyz"))) is None
    assert one(spark, keys.hamming(keys.hash_bits(F.lit("f")), keys.hash_bits(F.lit("8000000000000000")))) == 5
    assert one(spark, text.safe_component(F.lit("../a b?.png"))) == "a_b_.png" and one(spark, text.safe_component(F.lit("._"))) == "review"
    assert one(spark, keys.routed_filename(F.lit("id-1"), F.lit(None).cast("string"))) == "id-1.jpg"
    assert one(spark, F.length(keys.routed_filename(F.lit("id/1"), F.lit("v")))) == 64 + 13 + 4
    assert one(spark, text.spreadsheet_safe(F.lit("=1+1"))) == "'=1+1"


def test_times(spark):
    assert one(spark, times.parsed(F.lit("not a time"))) is None
    assert one(spark, times.epoch_seconds(F.lit(None).cast("timestamp"))) == 0.0
    assert one(spark, times.rfc3339(F.lit("2026-01-02 03:04:05").cast("timestamp"))) == "2026-01-02T03:04:05.000000Z"


def test_vectors(spark):
    assert one(spark, vectors.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    q, c = F.array(F.array(F.lit(1.0), F.lit(0.0))), F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(-1.0), F.lit(0.0)))
    assert one(spark, vectors.maxsim(q, c, 1)) == 1.0 and one(spark, vectors.maxsim(q, c, 2)) == 0.0
    with pytest.raises(ValueError):
        vectors.maxsim(q, c, 0)
    moved = one(spark, vectors.shifted(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)), 1.0))
    assert moved == pytest.approx([2**-0.5, 2**-0.5])
    assert gram_schmidt([[1, 0], [1, 1]]) == [[1, 0], [0, 1]]
    with pytest.raises(ValueError):
        gram_schmidt([[1, 0], [2, 0]])


def test_addresses(spark):
    from pictorium.functions import web

    for url, want in [("https://img.a.example/x", True), ("https://a.example", True), ("http://a.example/x", False), ("https://bada.example/", False), ("https://10.0.0.1/", False), ("not one", False), (None, False)]:
        assert one(spark, web.allowed(F.col("u"), ("a.example",)), "u string", (url,)) is want
    assert one(spark, web.post_link(F.lit("at://did:x/feed.post/k y"))) == "https://posts.example/profile/did:x/post/k%20y"
    assert one(spark, web.post_link(F.lit("https://x"))) is None
    assert one(spark, web.relative_path(F.lit("/data/raw/a/b.jpg"), "/data/raw/")) == "a/b.jpg"


def test_error_codes(spark):
    from pictorium.operators.snapshots import nearest_rank, reason_codes

    code = reason_codes(F.col("e"), {"TimeoutError": "error.timeout"})
    assert one(spark, code, "e string", ("TimeoutError: late",)) == "error.timeout"
    assert one(spark, code, "e string", ("Other",)) == "error.unknown" and one(spark, code, "e string", (None,)) is None
    df = spark.createDataFrame([("a", v) for v in range(1, 11)] + [("b", None), ("c", 5)], "g string, v int")
    assert {r.g: r.p for r in nearest_rank(df, ["g"], "v", 0.5, "p").collect()} == {"a": 6.0, "c": 5.0}


def test_snapshots(spark):
    from pictorium.operators.snapshots import snapshot_join

    labels = spark.createDataFrame([("one", 1, 10), ("two", 2, None), ("three", 3, 99)], "k string, label int, snap int")
    decisions = spark.createDataFrame([("one", 10, 1, "review"), ("one", 11, 2, "reject"), ("two", 5, 3, "old"), ("two", 6, 4, "accept"), ("three", 1, 5, "x")], "k string, at int, n int, d string")
    got = {r.label: r.d for r in snapshot_join(labels, decisions, "k", "label", "snap", "at", "n").collect()}
    assert got == {1: "review", 2: "accept"}
