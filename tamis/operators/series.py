"""Per-key series: first sustained crossings, baselines, windows around a frame, releases and grades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sustained_first(frames: DataFrame, key: str, order: str, over: Column, run: int = 2) -> DataFrame:
    """(key, first): the first position from which ``over`` holds for ``run`` rows on end; null if nowhere."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(0, run - 1)
    hold = frames.select(key, order, (F.min(F.coalesce(over, F.lit(False)).cast("int")).over(w) == 1).alias("h"), F.count("*").over(w).alias("n"))
    return hold.groupBy(key).agg(F.min(F.when(F.col("h") & (F.col("n") == run), F.col(order))).alias("first"))


def baseline(frames: DataFrame, key: str, frame: str, value: str, fps: float) -> DataFrame:
    """(key, n, baseline): the median of the first max(2, min(n / 5, round(0.75 fps))) frames."""
    n = frames.groupBy(key).agg(F.count("*").alias("n"))
    most = F.greatest(F.lit(2), F.least(F.floor(F.col("n") / 5), F.lit(round(0.75 * fps)).cast("long")))
    return frames.join(n, key).where(F.col(frame) < most).groupBy(key, "n").agg(F.expr(f"percentile({value}, 0.5)").alias("baseline"))


def release(nozzle: DataFrame, liquid: DataFrame, key: str, fps: float, after: float = 10.0) -> DataFrame:
    """(key, release, target, method): the nozzle's index if it isn't later than the liquid's, else the frame before the liquid's (0 at least), else null; ``target`` is ``after`` seconds on, rounded half to even."""
    j = nozzle.select(key, F.col("first").alias("n_")).join(liquid.select(key, F.col("first").alias("l_")), key, "full")
    use_nozzle = F.col("n_").isNotNull() & (F.col("l_").isNull() | (F.col("n_") <= F.col("l_")))
    at = F.when(use_nozzle, F.col("n_")).when(F.col("l_").isNotNull(), F.greatest(F.col("l_") - 1, F.lit(0)))
    method = F.when(use_nozzle, "nozzle").when(F.col("l_").isNotNull(), "liquid").otherwise("abstain")
    return j.select(key, at.alias("release"), F.bround(at + after * fps).cast("long").alias("target"), method.alias("method"))


def around(frames: DataFrame, targets: DataFrame, key: str, frame: str, value: str, reach: int) -> DataFrame:
    """(key, target, n, median, highest) of the values within ``reach`` frames of each key's target."""
    j = frames.join(targets.select(key, "target").where("target IS NOT NULL"), key)
    near = j.where(F.col(frame).between(F.col("target") - reach, F.col("target") + reach))
    return near.groupBy(key, "target").agg(F.count("*").alias("n"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.max(value).alias("highest"))


def lifecycle(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, first, last, n): the first and last value in order."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.count("*").alias("n"))


def bench(rows: DataFrame, axes: list[str], error: str, graded: str) -> DataFrame:
    """(axis, bucket, n, n_graded, abstention, mae_all, mae_graded) over each axis, by one grouping-sets pass."""
    sets = rows.withColumns({a: F.col(a).cast("string") for a in axes}).groupingSets([[a] for a in axes], *axes)
    g = F.col(graded)
    made = sets.agg(*(F.grouping(a).alias(f"g_{a}") for a in axes), F.count("*").alias("n"), F.count_if(g).alias("n_graded"), F.avg((~g).cast("double")).alias("abstention"), F.avg(F.abs(error)).alias("mae_all"), F.avg(F.when(g, F.abs(error))).alias("mae_graded"))
    axis, bucket = F.lit(None).cast("string"), F.lit(None).cast("string")
    for a in axes:
        axis, bucket = F.when(F.col(f"g_{a}") == 0, a).otherwise(axis), F.when(F.col(f"g_{a}") == 0, F.col(a)).otherwise(bucket)
    return made.select(axis.alias("axis"), bucket.alias("bucket"), "n", "n_graded", "abstention", "mae_all", "mae_graded")


def sessions(rows: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, session_start, n, last): runs of rows no further apart than the gap."""
    return rows.groupBy(key, F.session_window(ts, f"{gap_seconds} seconds").alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("last")).select(key, F.col("w.start").alias("session_start"), "n", "last")
