"""Measures of ranked lists and of classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pictorium.functions.numeric import f1, ratio, wilson


def latest_judgments(df: DataFrame, keys: list[str], at: str, ordinal: str) -> DataFrame:
    """The last judgment per key; equal times go to the later ordinal."""
    last = Window.partitionBy(*keys).orderBy(F.col(at).desc_nulls_last(), F.col(ordinal).desc())
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def query_metrics(judged: DataFrame, by: list[str], query: str, rank: str = "rank", relevant: str = "relevant", result_count: str = "result_count") -> DataFrame:
    """Per query: judgments, relevant, expected, reciprocal rank, average precision, nDCG."""
    keys = [*by, query]
    seen = F.sum(F.col(relevant).cast("int")).over(Window.partitionBy(*keys).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    gain = F.when(F.col(relevant), F.lit(1.0) / F.log2(F.col(rank) + 1.0))
    rows = judged.withColumn("_seen", seen)
    per = rows.groupBy(*keys).agg(
        F.count("*").alias("judgments"),
        F.count_if(relevant).alias("relevant_count"),
        F.max(result_count).alias("expected"),
        F.min(F.when(F.col(relevant), F.col(rank))).alias("_first"),
        F.sum(F.when(F.col(relevant), F.col("_seen") / F.col(rank))).alias("_precisions"),
        F.sum(gain).alias("_dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("relevant_count"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + F.lit(1.0) / F.log2(r + F.lit(1.0)))
    some = F.col("relevant_count") > 0
    return per.withColumns(
        {
            "reciprocal_rank": F.when(some, F.lit(1.0) / F.col("_first")).otherwise(0.0),
            "average_precision": F.when(some, F.col("_precisions") / F.col("relevant_count")).otherwise(0.0),
            "ndcg": F.when(some, F.col("_dcg") / ideal).otherwise(0.0),
        }
    ).drop("_first", "_precisions", "_dcg")


def ranking_metrics(judged: DataFrame, by: list[str], query: str, digits: int = 9) -> DataFrame:
    """Per mode: judgments, coverage, precision, MRR, MAP, nDCG over its queries."""
    per = query_metrics(judged, by, query)
    return per.groupBy(*by).agg(
        F.sum("judgments").alias("judgments"),
        F.count("*").alias("query_count"),
        F.sum("relevant_count").alias("relevant"),
        F.round(ratio(F.sum("judgments"), F.sum("expected")), digits).alias("annotation_coverage"),
        F.round(ratio(F.sum("relevant_count"), F.sum("judgments")), digits).alias("judged_precision"),
        F.round(F.avg("reciprocal_rank"), digits).alias("mrr"),
        F.round(F.avg("average_precision"), digits).alias("map"),
        F.round(F.avg("ndcg"), digits).alias("ndcg"),
    )


def prefix_metrics(judged: DataFrame, by: list[str], query: str, ks: tuple[int, ...] = (1, 5, 10), scope: str = "judged", digits: int = 9) -> DataFrame:
    """Per mode and k: judgments, relevant, coverage, precision, hit rate, pool recall.

    ``scope='judged'`` counts all judged queries for the hit rate;
    ``scope='session'`` those with a judgment within k.
    """
    cut = judged.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    inside = F.col("rank") <= F.col("k")
    per = cut.groupBy(*by, "k", query).agg(
        F.count_if(inside).alias("n"), F.count_if(inside & F.col("relevant")).alias("r"), F.count_if("relevant").alias("all_r"), F.max("result_count").alias("results")
    )
    population = F.count("*") if scope == "judged" else F.count_if(F.col("n") > 0)
    return per.groupBy(*by, "k").agg(
        F.sum("n").alias("judgments"),
        F.sum("r").alias("relevant"),
        F.round(ratio(F.sum("n"), F.sum(F.least("k", "results"))), digits).alias("coverage"),
        F.round(ratio(F.sum("r"), F.sum("n")), digits).alias("judged_precision"),
        F.round(ratio(F.count_if(F.col("r") > 0), population), digits).alias("query_hit_rate"),
        F.round(F.avg(F.when(F.col("all_r") > 0, F.col("r") / F.col("all_r"))), digits).alias("pool_recall"),
    )


def score_calibration(judged: DataFrame, by: list[str], score: str = "score", bins: int = 5, low: float = -1.0, width: float = 0.4) -> DataFrame:
    """Equal bins on the score, the last one closed; every bin is reported."""
    edges = [low + k * width for k in range(bins)]
    inside = [(F.col(score) >= e) & ((F.col(score) < e + width) | (F.lit(k == bins - 1) & (F.col(score) == e + width))) for k, e in enumerate(edges)]
    stats = []
    for k, c in enumerate(inside):
        stats += [F.count_if(c).alias(f"n{k}"), F.count_if(c & F.col("relevant")).alias(f"r{k}")]
    wide = judged.groupBy(*by).agg(*stats)
    bin_ = [F.struct(F.lit(k).alias("bin"), F.lit(e).alias("score_min"), F.lit(e + width).alias("score_max"), F.col(f"n{k}").alias("judgments"), F.col(f"r{k}").alias("relevant")) for k, e in enumerate(edges)]
    long_ = wide.select(*by, F.explode(F.array(*bin_)).alias("b")).select(*by, "b.*")
    return long_.withColumn("precision", F.round(ratio(F.col("relevant"), F.col("judgments")), 9))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def multiclass_metrics(df: DataFrame, truth: str, predicted: str, digits: int = 9) -> DataFrame:
    """Per class of either column: support, precision, recall, F1."""
    cells = confusion(df, truth, predicted)
    both = cells.select(F.explode(F.array(F.struct(F.col(truth).alias("class"), F.col("n").alias("actual"), F.lit(0).alias("guessed"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col(predicted).alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").cast("int").alias("guessed"), F.lit(0).cast("bigint").alias("hit")))).alias("x")).select("x.*")
    per = both.groupBy("class").agg(F.sum("actual").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    precision, recall = ratio(F.col("hit"), F.col("guessed")), ratio(F.col("hit"), F.col("support"))
    return per.select("class", "support", F.round(precision, digits).alias("precision"), F.round(recall, digits).alias("recall"), F.round(f1(precision, recall), digits).alias("f1"))


def binary_metrics(df: DataFrame, by: list[str], truth: Column, predicted: Column, digits: int = 9) -> DataFrame:
    """Per group: counts, precision with its Wilson interval, recall, accuracy, F1."""
    hit, guess, real, n = F.count_if(truth & predicted), F.count_if(predicted), F.count_if(truth), F.count("*")
    low, high = wilson(F.col("hit"), F.col("predicted"))
    per = df.groupBy(*by).agg(n.alias("samples"), guess.alias("predicted"), real.alias("actual"), hit.alias("hit"), F.count_if(truth == predicted).alias("same"))
    precision, recall = ratio(F.col("hit"), F.col("predicted")), ratio(F.col("hit"), F.col("actual"))
    return per.select(
        *by, "samples", "predicted", "actual", "hit",
        F.round(precision, digits).alias("precision"), F.round(low, digits).alias("precision_low"), F.round(high, digits).alias("precision_high"),
        F.round(recall, digits).alias("recall"), F.round(ratio(F.col("same"), F.col("samples")), digits).alias("accuracy"), F.round(f1(precision, recall), digits).alias("f1"),
    )


def group_macro(per_group: DataFrame, measures: list[str], digits: int = 9) -> DataFrame:
    """Means over groups of the measures that are defined."""
    return per_group.agg(F.count("*").alias("groups"), *[F.round(F.avg(m), digits).alias(m) for m in measures])


def threshold_sweep(df: DataFrame, score: str, truth: str, steps: int = 100, digits: int = 9) -> DataFrame:
    """For thresholds 0, 1/steps .. 1 on accept (score >= t) and reject (score <= t).

    Scores are first counted per step, so the sweep is a running sum over a
    table of ``steps + 1`` rows instead of a comparison of every row with every
    threshold.
    """
    rows = df.select(F.col(score).cast("double").alias("s"), F.col(truth).alias("truth")).where("s is not null")
    # The number of thresholds up to a score: its floor, put right by one where division and product round apart.
    guess = F.when(F.isnan("s"), steps).otherwise(F.least(F.greatest(F.floor(F.col("s") * steps), F.lit(-1)), F.lit(steps))).cast("int")
    step = lambda k: k.cast("double") / float(steps)
    at = F.col("guess")
    right = F.when((at < steps) & (step(at + 1) <= F.col("s")), at + 1).when((at >= 0) & (step(at) > F.col("s")), at - 1).otherwise(at)
    placed = rows.withColumn("guess", guess).withColumn("reach", right + 1)
    placed = placed.select("reach", F.when((F.col("reach") > 0) & (step(F.col("reach") - 1) == F.col("s")), F.col("reach") - 1).otherwise(F.col("reach")).alias("first"), "truth")
    counted = placed.groupBy("reach", "first").agg(F.count("*").alias("n"), F.count_if("truth").alias("p"))
    # From here on there are at most (steps + 2) squared rows, whatever the input.
    everything = Window.partitionBy()
    counted = counted.withColumns({"total": F.sum("n").over(everything), "positives": F.sum("p").over(everything)})
    accepts = counted.where("reach > 0").select(F.explode(F.sequence(F.lit(0), F.col("reach") - 1)).alias("t"), "n", "p", "total", "positives")
    rejects = counted.where(f"first <= {steps}").select(F.explode(F.sequence("first", F.lit(steps))).alias("t"), "n", "p", "total", "positives")
    cells = [
        accepts.groupBy("t").agg(F.sum("n").alias("accepted"), F.sum("p").alias("accepted_hit"), F.max("total").alias("total"), F.max("positives").alias("positives")),
        rejects.groupBy("t").agg(F.sum("n").alias("rejected"), F.sum(F.col("n") - F.col("p")).alias("rejected_hit"), F.max("total").alias("total2"), F.max("positives").alias("positives2")),
    ]
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("t")).join(cells[0], "t", "left").join(cells[1], "t", "left")
    whole = {c: F.max(F.coalesce(c, f"{c}2")).over(everything) for c in ("total", "positives")}
    grid = grid.withColumns(whole).fillna(0, ["accepted", "accepted_hit", "rejected", "rejected_hit"])
    out: DataFrame | None = None
    for kind, n, hit, base in (("accept", "accepted", "accepted_hit", F.col("positives")), ("reject", "rejected", "rejected_hit", F.col("total") - F.col("positives"))):
        low, _ = wilson(F.col(hit), F.col(n))
        part = grid.select(
            F.lit(kind).alias("kind"), (F.col("t").cast("double") / float(steps)).alias("threshold"), F.col(n).alias("decisions"),
            F.round(ratio(F.col(hit), F.col(n)), digits).alias("precision"), F.round(low, digits).alias("precision_low"),
            F.round(ratio(F.col(hit), base), digits).alias("recall"), F.round(ratio(F.col(n), F.col("total")), digits).alias("coverage"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def recommended_thresholds(sweep: DataFrame, accept_target: float, reject_target: float, least: int) -> DataFrame:
    """The lowest accept threshold, and the highest reject threshold below it, whose precision surely reaches the target."""
    enough = F.col("decisions") >= least
    accept = sweep.where((F.col("kind") == "accept") & enough & (F.col("precision_low") >= accept_target)).agg(F.min("threshold").alias("accept_threshold"))
    reject = sweep.where((F.col("kind") == "reject") & enough & (F.col("precision_low") >= reject_target)).select("threshold")
    both = accept.join(reject, F.col("threshold") < F.coalesce(F.col("accept_threshold"), F.lit(float("inf"))), "left")
    return both.groupBy("accept_threshold").agg(F.max("threshold").alias("reject_threshold"))


def policy_projection(df: DataFrame, score: str, truth: str, accept: float, reject: float, digits: int = 9) -> DataFrame:
    """What a pair of thresholds would decide."""
    a, r, t = F.col(score) >= accept, F.col(score) <= reject, F.col(truth)
    n = F.count("*")
    return df.agg(
        F.count_if(a).alias("accept_count"), F.round(ratio(F.count_if(a & t), F.count_if(a)), digits).alias("accept_precision"),
        F.count_if(r).alias("reject_count"), F.round(ratio(F.count_if(r & ~t), F.count_if(r)), digits).alias("reject_precision"),
        (n - F.count_if(a | r)).alias("review_count"), F.round(ratio(n - F.count_if(a | r), n), digits).alias("review_rate"),
    )


def false_accepts(df: DataFrame, subtype: str, truth: Column, accepted: Column, digits: int = 9) -> DataFrame:
    """Per subtype of the samples that are none: how many there are, how many were accepted, and the rate."""
    hit = F.count_if(F.coalesce(accepted, F.lit(False)))
    return df.where(~truth).groupBy(subtype).agg(F.count("*").alias("support"), hit.alias("accepted"), F.round(ratio(hit, F.count("*")), digits).alias("rate"))


def mode_report(judged: DataFrame, by: list[str], query: str, score: str = "score", digits: int = 9) -> DataFrame:
    """:func:`ranking_metrics` with the retrieved confusion and the mean scores of relevant and other results.

    What wasn't retrieved isn't judged, so true and false negatives are NULL.
    """
    mine = F.col("relevant")
    extra = judged.groupBy(*by).agg(
        F.count_if(~mine).alias("not_relevant"), F.round(F.avg(F.when(mine, F.col(score))), digits).alias("mean_relevant_score"), F.round(F.avg(F.when(~mine, F.col(score))), digits).alias("mean_not_relevant_score")
    )
    rows = ranking_metrics(judged, by, query, digits).join(extra, by)
    none = F.lit(None).cast("bigint")
    return rows.withColumns({"true_positive": F.col("relevant"), "false_positive": F.col("not_relevant"), "true_negative": none, "false_negative": none})
