import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pictorium.functions import text
from pictorium.operators import relational

DATA = os.environ.get("PICTORIUM_TESTDATA", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_places_over_many_ranges(spark):
    df = spark.range(3_000).select(F.pmod(F.xxhash64("id"), F.lit(7)).alias("distance"), "id")
    got = [(r.distance, r.id) for r in relational.placed(df.repartition(9), ["distance", "id"]).orderBy("place").collect()]
    want = sorted((r.distance, r.id) for r in df.collect())
    places = sorted(r.place for r in relational.placed(df, ["distance", "id"]).collect())
    assert got == want and places == list(range(1, 3_001))
    assert relational.placed(df.limit(0), ["distance", "id"]).count() == 0


@tables
def test_review_queue_is_whole(spark):
    from pictorium.plans.retrieval_queries import _judged

    scored = _judged(spark, DATA).where("score is not null").count()
    got = entry.queries()["review_priority"](spark, DATA).orderBy("place").collect()
    assert scored > 50 and [r.place for r in got] == list(range(1, scored + 1))
    assert [(r.distance, r.result_id) for r in got] == sorted((r.distance, r.result_id) for r in got)


@tables
def test_every_candidate_has_a_payload(spark):
    candidates = spark.read.parquet(f"{DATA}/candidates.parquet").select("candidate_id").distinct().count()
    got = entry.queries()["gallery_payload"](spark, DATA).collect()
    assert candidates > 100 and len({r.delivery_id for r in got}) == len(got) == candidates


def test_terms_are_found_in_whole_texts(spark):
    df = spark.createDataFrame([("so " * 2_000 + "sketch",)], "t string")
    whole, cut = text.with_text_scores(df, "t").first(), text.with_text_scores(df, "t", 4_000).first()
    assert whole.positive_terms == ["sketch"] and cut.positive_terms == []
