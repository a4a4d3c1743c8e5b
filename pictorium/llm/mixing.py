"""Mix sources to target weights, measured in tokens of a public tokenizer.

Every document gets a random key from a hash of its identifier and the seed.
The key space of each source is cut into equal ranges; ranges are summed with a
partial aggregate, the short list of range sums gives every range its offset,
and a running sum inside one range completes the distributed prefix sum of the
source.  A mix then takes whole epochs of a source and, of the last one, the
documents whose running sum stays within the exact rest of the budget.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pictorium.runtime import spread, written

TOKENIZERS = os.environ.get("PICTORIUM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
try:
    from public_tokenizers import PATTERN
except ImportError:  # the published splitting pattern of these vocabularies
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Documents per key range; a range is summed in one task.
PER_RANGE = 20_000
#: A text is cut at blanks into pieces of about this size for the tokenizer.
PIECE = 100_000


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str) -> int:
    """Tokens of the whole text; long texts are encoded in pieces that end before a blank."""
    if not text:
        return 0
    encode, total, start = _encoder(path).encode_ordinary, 0, 0
    while len(text) - start > PIECE:
        stop = start + PIECE
        while stop < min(len(text), start + 2 * PIECE) and not (text[stop] == " " and text[stop - 1].isalnum()):
            stop += 1
        total, start = total + len(encode(text[start:stop])), stop
    return total + len(encode(text[start:]))


def token_counts(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``df`` without its text and with ``tokens``."""
    path = path or os.path.join(TOKENIZERS, VOCABULARY)
    kept = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text) + ", tokens bigint"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame[kept].assign(tokens=[count_tokens(t, path) for t in frame[text]])

    return spread(df).mapInPandas(count, schema)


def source_name(column: Column) -> Column:
    """Sources written unevenly become one: trimmed, lower-cased, runs of blanks, - and _ as one _."""
    name = F.regexp_replace(F.lower(F.trim(column)), r"[\s_-]+", "_")
    return F.when(name != "", name)


def prefix_sums(docs: DataFrame, seed: int = 0, per_range: int = PER_RANGE) -> DataFrame:
    """Add ``upto``, the source's tokens up to and with this document in random order, and ``source_tokens``."""
    n = docs.count()
    ranges = max(1, min(1 << 20, -(-n // per_range)))
    keyed = docs.withColumn("key", F.xxhash64(F.lit(seed), "doc_id"))
    # The high 31 bits place the key in one of equal ranges of the key space.
    part = F.floor((F.shiftright("key", 33) + F.lit(1 << 30)) * F.lit(ranges) / F.lit(1 << 31)).cast("int")
    keyed = keyed.withColumn("range", F.least(part, F.lit(ranges - 1)))
    sums = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("in_range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    sums = sums.withColumn("source_tokens", F.sum("in_range").over(Window.partitionBy("source"))).drop("in_range")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id")
    placed = keyed.withColumn("inside", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.join(sums, ["source", "range"]).withColumn("upto", F.col("offset") + F.col("inside")).drop("offset", "inside", "key", "range")


def budgets(available: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(mix_id, source, target_share, source_tokens, budget) per target.

    Without ``total_tokens`` a mix is as large as it can be with every source
    that has tokens at its exact share.  Targets without documents get 0.
    """
    wanted = targets.select(
        "mix_id", source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats")
    ).where("mix_id is not null and source is not null and target_share > 0")
    wanted = wanted.groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = wanted.join(available, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    most = F.col("source_tokens") * F.col("max_repeats")
    mix = Window.partitionBy("mix_id")
    joined = joined.withColumn("possible", F.min(F.when(most > 0, most / F.col("target_share"))).over(mix))
    size = F.col("possible") if total_tokens is None else F.lit(float(total_tokens))
    return joined.withColumn("budget", F.least(most, F.floor(F.coalesce(size, F.lit(0.0)) * F.col("target_share") + 1e-6)).cast("bigint"))


def mixture(docs: DataFrame, targets: DataFrame, *, seed: int = 0, total_tokens: int | None = None, tokenizer: str | None = None) -> DataFrame:
    """(mix_id, source, doc_id, tokens, copies): every document a mix takes and how often.

    ``max_repeats`` is the most passes over a source.  Defined results: blank
    or NULL texts and documents without a source or id have no part; equal keys
    are ordered by ``doc_id``; a target without documents yields no rows and
    shows with share 0 in :func:`mixture_shares`; an empty target table yields
    an empty mix.  A source is cut at the last document that fits its budget,
    so it falls short of it by less than one document.
    """
    rows = docs.select(F.col("doc_id"), source_name(F.col("source")).alias("source"), F.col("text"))
    rows = rows.where("doc_id is not null and source is not null and text is not null")
    counted = written(token_counts(rows, path=tokenizer).where("tokens > 0"), "token-counts")
    summed = prefix_sums(counted, seed)
    plan = mixture_plan(counted, targets, total_tokens)
    full = F.floor(F.col("budget") / F.col("source_tokens"))
    rest = F.col("budget") - full * F.col("source_tokens")
    # The plan has one row per target; the planner broadcasts it only while its size allows.
    taken = summed.drop("source_tokens").join(plan.select("mix_id", "source", "budget", "source_tokens"), "source")
    taken = taken.withColumn("copies", (full + F.when(F.col("upto") <= rest, 1).otherwise(0)).cast("bigint"))
    return taken.where("copies > 0").select("mix_id", "source", "doc_id", "tokens", "copies")


def mixture_plan(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    available = counted.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    return budgets(available, targets, total_tokens)


def mixture_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, actual_tokens, actual_share, passes) per target of a mix."""
    wanted = targets.select("mix_id", source_name(F.col("source")).alias("source"), "target_share").groupBy("mix_id", "source").agg(F.sum("target_share").alias("target_share"))
    got = mixed.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.max("copies").alias("passes"))
    both = wanted.join(got, ["mix_id", "source"], "left").fillna(0, ["actual_tokens", "passes"])
    whole = F.sum("actual_tokens").over(Window.partitionBy("mix_id"))
    return both.withColumn("actual_share", F.when(whole > 0, F.col("actual_tokens") / whole).otherwise(F.lit(0.0)))
