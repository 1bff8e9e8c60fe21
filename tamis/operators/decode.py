"""From a row of class probabilities to a level and a confidence, in array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalised(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.transform(p, lambda x: x / total)


def survival(p: Column) -> Column:
    """1 less the cumulative sum, from left to right, for all classes but the last."""
    sums = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: F.aggregate(F.slice(p, F.lit(1), k), F.lit(0.0), lambda a, x: a + x))
    return F.transform(sums, lambda c: 1 - c)


def rank_level(s: Column, cut: float = 0.5) -> Column:
    """How many survival values exceed the cut (strictly; NaN never does)."""
    return F.size(F.filter(s, lambda x: ~F.isnan(x) & (x > cut)))


def thresholded_level(s: Column, cuts: Column) -> Column:
    """The same with a cut of its own for each value."""
    return F.size(F.filter(F.zip_with(s, cuts, lambda x, c: ~F.isnan(x) & (x > c)), lambda x: x))


def argmax_level(p: Column) -> Column:
    """The first class of the highest probability."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def top_two(p: Column) -> Column:
    """struct(lo, hi): the two likeliest classes if they are neighbours, else the likeliest twice; ties go to the lower class."""
    ranked = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("p"), i.alias("k"))))
    a, b = ranked[0]["k"], ranked[1]["k"]
    near = F.abs(a - b) == 1
    return F.struct(F.when(near, F.least(a, b)).otherwise(a).alias("lo"), F.when(near, F.greatest(a, b)).otherwise(a).alias("hi"))


def band_mass(p: Column, band: Column) -> Column:
    """The probability of a band; of a point, once."""
    return F.when(band["lo"] == band["hi"], F.get(p, band["lo"])).otherwise(F.get(p, band["lo"]) + F.get(p, band["hi"]))


def boundary_margin(s: Column, level: Column, cut: float = 0.5) -> Column:
    """The smaller slack of the survival values on both sides of the level; a missing side counts as infinite."""
    inf = F.lit(float("inf"))
    return F.least(F.coalesce(F.get(s, level - 1) - cut, inf), F.coalesce(cut - F.get(s, level), inf))


def decode_margin(s: Column, cut: float = 0.5) -> Column:
    """The distance of the survival value nearest to the cut."""
    return F.array_min(F.transform(s, lambda x: F.abs(x - cut)))


def valid_prediction(p: Column, label: Column, classes: int = 5) -> Column:
    """Finite, non-negative probabilities of ``classes`` classes with a positive sum, and a label 0..classes-1."""
    fine = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf")))
    return F.coalesce((F.size(p) == classes) & fine & (F.aggregate(p, F.lit(0.0), lambda a, x: a + x) > 0) & label.between(0, classes - 1), F.lit(False))


def decoded(predictions: DataFrame, probs: str = "probs") -> DataFrame:
    """Adds surv, pred, conf (the mass on it), argmax, lo, hi, band, margin and near."""
    p, s = F.col("p_"), F.col("surv")
    return (
        predictions.withColumn("p_", normalised(F.col(probs)))
        .withColumn("surv", survival(p))
        .withColumn("pred", rank_level(s))
        .withColumn("conf", F.get(p, F.col("pred")))
        .withColumn("argmax", argmax_level(p))
        .withColumn("band_", top_two(p))
        .withColumns({"lo": F.col("band_.lo"), "hi": F.col("band_.hi"), "band": band_mass(p, F.col("band_")), "margin": boundary_margin(s, F.col("pred")), "near": decode_margin(s)})
        .drop("p_", "band_")
    )


def decision(pred: Column, conf: Column, threshold: float) -> Column:
    """struct(decision, level): a level where the confidence reaches the threshold (NaN never does), else ``unclear``."""
    sure = ~F.isnan(conf) & (conf >= threshold)
    return F.struct(F.when(sure, "level_compatibility").otherwise("unclear").alias("decision"), F.when(sure, pred).alias("level"))


def reconstructed(logits: Column) -> Column:
    """Class probabilities from the logits of the cut points: differences of their sigmoids."""
    s = F.transform(logits, lambda x: 1 / (1 + F.exp(-x)))
    padded = F.concat(F.array(F.lit(1.0)), s, F.array(F.lit(0.0)))
    return F.transform(F.sequence(F.lit(1), F.size(padded) - 1), lambda k: F.greatest(F.lit(0.0), F.get(padded, k - 1) - F.get(padded, k)))


def interior_ceiling(predictions: DataFrame, keys: list[str], logits: str = "logits", tolerance: float = 1e-3) -> DataFrame:
    """(keys, ceiling): the most mass that an interior level can get, tanh(smallest gap / 4).

    Gaps are the medians over rows of differences of neighbouring logits; null if rows disagree on
    a gap by over ``tolerance`` of it, or if there are fewer than two usable rows.
    """
    gaps = F.transform(F.sequence(F.lit(1), F.size(logits) - 1), lambda k: F.get(F.col(logits), k - 1) - F.get(F.col(logits), k))
    usable = F.forall(F.col(logits), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 30))
    each = predictions.where(usable).select(*keys, F.posexplode(gaps).alias("k", "gap"))
    per = each.groupBy(*keys, "k").agg(F.expr("percentile(gap, 0.5)").alias("mid"), (F.max("gap") - F.min("gap")).alias("range"), F.count("*").alias("n"))
    bad = (F.col("n") < 2) | (F.col("range") > tolerance * F.abs(F.col("mid")))
    return per.groupBy(*keys).agg(F.when(~F.bool_or(bad), F.tanh(F.min("mid") / 4)).alias("ceiling"))
