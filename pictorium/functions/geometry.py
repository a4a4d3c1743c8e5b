"""Standardisation geometry: crop to a ratio, scale to a square, pad evenly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CANONICAL, MOST_RATIO = 448, 2.5


def with_transform_plan(df: DataFrame, width: str, height: str, name: str = "plan", size: int = CANONICAL, most_ratio: float = MOST_RATIO) -> DataFrame:
    """``df`` with ``name``, a struct of crops, scale, resized size and pads; NULL for missing or non-positive sizes.

    Halves round to even.  Each step is a column of its own, for the expression
    of the last would otherwise repeat the first ones hundreds of times.
    """
    col = F.col
    w, h = col("_w"), col("_h")
    some = (col(width) > 0) & (col(height) > 0)
    rows = df.withColumns({"_w": F.when(some, col(width).cast("bigint")), "_h": F.when(some, col(height).cast("bigint"))})
    rows = rows.withColumns({"_long": F.greatest(w, h), "_short": F.least(w, h), "_wide": w > h})
    kept = F.when(col("_long") / col("_short") > most_ratio, F.bround(col("_short") * F.lit(most_ratio)).cast("bigint")).otherwise(col("_long"))
    rows = rows.withColumn("_excess", col("_long") - kept).withColumn("_first", F.floor(col("_excess") / 2))
    sides = {"left": (col("_wide"), col("_first")), "top": (~col("_wide"), col("_first")), "right": (col("_wide"), col("_excess") - col("_first")), "bottom": (~col("_wide"), col("_excess") - col("_first"))}
    rows = rows.withColumns({f"_crop_{k}": F.when(c, v).otherwise(F.lit(0)).cast("bigint") for k, (c, v) in sides.items()})
    rows = rows.withColumns({"_cw": w - col("_crop_left") - col("_crop_right"), "_ch": h - col("_crop_top") - col("_crop_bottom")})
    rows = rows.withColumn("_scale", F.lit(float(size)) / F.greatest("_cw", "_ch"))
    rows = rows.withColumns({f"_r{k}": F.greatest(F.lit(1), F.bround(col(f"_c{k}") * col("_scale"))).cast("bigint") for k in "wh"})
    rows = rows.withColumns({f"_p{k}": F.floor((F.lit(size) - col(f"_r{k}")) / 2).cast("bigint") for k in "wh"})
    plan = F.struct(
        *[col(f"_crop_{k}").alias(f"crop_{k}") for k in sides],
        col("_scale").alias("scale_factor"),
        col("_rw").alias("resized_width"),
        col("_rh").alias("resized_height"),
        col("_pw").alias("pad_left"),
        col("_ph").alias("pad_top"),
        (F.lit(size) - col("_rw") - col("_pw")).alias("pad_right"),
        (F.lit(size) - col("_rh") - col("_ph")).alias("pad_bottom"),
    )
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], F.when(w.isNotNull(), plan).alias(name))


def to_standard(x: Column, y: Column, plan: Column) -> tuple[Column, Column]:
    return (x - plan["crop_left"]) * plan["scale_factor"] + plan["pad_left"], (y - plan["crop_top"]) * plan["scale_factor"] + plan["pad_top"]


def to_original(x: Column, y: Column, plan: Column) -> tuple[Column, Column]:
    return (x - plan["pad_left"]) / plan["scale_factor"] + plan["crop_left"], (y - plan["pad_top"]) / plan["scale_factor"] + plan["crop_top"]
