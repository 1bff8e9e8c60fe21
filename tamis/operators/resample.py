"""Bootstrap intervals from draws that depend on the seed, replicate, class and position alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, replicate: Column, stratum: Column, position: Column, size: Column) -> Column:
    """An index below ``size``: the first eight hex digits of an MD5, modulo the size."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), replicate, stratum, position)), 1, 8), 16, 10).cast("long") % size).cast("int")


def stratified_draws(d: DataFrame, stratum: str, order: str, replicates: int, seed: int = 2026) -> DataFrame:
    """Rows drawn with replacement, ``replicates`` times, as many of each stratum as there are; adds ``replicate``.

    The numbering needs a window a stratum; the draws join back on (stratum, number).
    """
    numbered = d.withColumn("nth_", F.row_number().over(Window.partitionBy(stratum).orderBy(order)) - 1)
    sizes = d.groupBy(stratum).agg(F.count("*").alias("size_"))
    drawn = numbered.select(stratum, "nth_").join(F.broadcast(sizes), stratum).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    drawn = drawn.select(stratum, "replicate", draw(seed, F.col("replicate"), F.col(stratum), F.col("nth_"), F.col("size_")).alias("nth_"))
    return drawn.join(numbered, [stratum, "nth_"]).drop("nth_")


def interval(replicated: DataFrame, keys: list[str], values: list[str], level: float = 0.95) -> DataFrame:
    """For each value its percentile interval over the replicates; nulls and NaN left out."""
    a = (1 - level) / 2
    out = []
    for v in values:
        clean = f"nullif({v}, double('NaN'))"
        out += [F.expr(f"percentile({clean}, {a}D)").alias(f"{v}_lo"), F.expr(f"percentile({clean}, {1 - a}D)").alias(f"{v}_hi")]
    return replicated.groupBy(*keys).agg(*out)


def paired_gain(draws: DataFrame, better: Column) -> DataFrame:
    """(replicates, mean_gain, p_positive) of a per-row difference averaged within each replicate."""
    per = draws.groupBy("replicate").agg(F.avg(better).alias("g"))
    return per.agg(F.count("*").alias("replicates"), F.avg("g").alias("mean_gain"), F.avg((F.col("g") > 0).cast("double")).alias("p_positive"))
