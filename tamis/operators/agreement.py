"""Agreement of two raters: joins of their labels, crosstabs, chance-corrected coefficients."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.labels import valid_level


def paired_labels(first: DataFrame, second: DataFrame, id_col: str = "event_id", level: str = "level", order: str = "line_no") -> DataFrame:
    """(id, t, p): rows of ``first`` with a valid level, joined with the last valid level of each id in ``second``."""
    last = second.select(id_col, valid_level(F.col(level)).alias("p"), order).where("p IS NOT NULL").groupBy(id_col).agg(F.max_by("p", order).alias("p"))
    return first.select(id_col, valid_level(F.col(level)).alias("t")).where("t IS NOT NULL").join(last, id_col)


def crosstab(pairs: DataFrame, domain: tuple[int, ...], keys: list[str] | None = None) -> DataFrame:
    """(keys, t, p, n, row_share) over the whole domain, zeros included."""
    keys = keys or []
    counts = pairs.groupBy(*keys, "t", "p").agg(F.count("*").alias("n"))
    spark = pairs.sparkSession
    cells = spark.createDataFrame([(a, b) for a in domain for b in domain], "t int, p int")
    groups = counts.select(*keys).distinct() if keys else None
    grid = F.broadcast(cells) if groups is None else groups.crossJoin(F.broadcast(cells))
    full = grid.join(counts, [*keys, "t", "p"], "left").select(*keys, "t", "p", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys, "t"))
    return full.withColumn("row_share", F.try_divide(F.col("n").cast("double"), total))


def coefficients(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, n, agreement, kappa, linear, quadratic, quadratic_compressed), null where chance explains all.

    ``quadratic`` takes levels at their distance; ``quadratic_compressed`` renumbers the levels that
    occur on either side. Everything after the first count runs over the table of (t, p).
    """
    keys = keys or []
    cells = pairs.where("t IS NOT NULL AND p IS NOT NULL").groupBy(*keys, "t", "p").agg(F.count("*").cast("double").alias("n"))
    seen = cells.select(*keys, F.explode(F.array("t", "p")).alias("x")).distinct()
    ranks = seen.withColumn("r", F.dense_rank().over(Window.partitionBy(*keys).orderBy("x")).cast("double"))
    cells = cells.join(ranks.select(*keys, F.col("x").alias("t"), F.col("r").alias("tr")), [*keys, "t"]).join(ranks.select(*keys, F.col("x").alias("p"), F.col("r").alias("pr")), [*keys, "p"])
    t, p, n = F.col("t").cast("double"), F.col("p").cast("double"), F.col("n")
    mean = lambda x: F.sum(x * n) / F.sum(n)
    quadratic = lambda a, b: F.lit(1.0) - F.try_divide(mean((a - b) ** 2), mean(a * a) + mean(b * b) - 2 * mean(a) * mean(b))
    whole = cells.groupBy(*keys).agg(F.sum("n").cast("long").alias("n_pairs"), mean((F.col("t") == F.col("p")).cast("double")).alias("agreement"), mean(F.abs(t - p)).alias("distance"), quadratic(t, p).alias("quadratic"), quadratic(F.col("tr"), F.col("pr")).alias("quadratic_compressed"))
    rows = cells.groupBy(*keys, F.col("t").alias("a")).agg(F.sum("n").alias("na"))
    columns = cells.groupBy(*keys, F.col("p").alias("b")).agg(F.sum("n").alias("nb"))
    both = rows.join(columns, keys) if keys else rows.crossJoin(columns)  # of two lists of levels
    chance = both.groupBy(*keys).agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("na") * F.col("nb")).otherwise(0.0)).alias("same"), F.sum(F.abs(F.col("a") - F.col("b")) * F.col("na") * F.col("nb")).alias("apart"))
    joined = whole.join(chance, keys) if keys else whole.crossJoin(chance)
    square = F.col("n_pairs").cast("double") ** 2
    pe = F.col("same") / square
    return joined.select(
        *keys,
        F.col("n_pairs").alias("n"),
        "agreement",
        F.try_divide(F.col("agreement") - pe, 1 - pe).alias("kappa"),
        (1 - F.try_divide(F.col("distance"), F.col("apart") / square)).alias("linear"),
        "quadratic",
        "quadratic_compressed",
    )


def kappa_from_matrix(cells: DataFrame) -> DataFrame:
    """Quadratic kappa of a table (t, p, n); an empty or degenerate one raises."""
    t, p, n = F.col("t").cast("double"), F.col("p").cast("double"), F.col("n").cast("double")
    mean = lambda x: F.sum(x * n) / F.sum(n)
    spread = mean(t * t) + mean(p * p) - 2 * mean(t) * mean(p)
    sums = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), mean((t - p) ** 2).alias("d"), spread.alias("e"))
    bad = (F.col("n") == 0) | F.col("e").isNull() | (F.col("e") == 0)
    return sums.select(F.when(bad, F.raise_error(F.lit("the matrix is empty or degenerate"))).otherwise(1 - F.col("d") / F.col("e")).cast("double").alias("quadratic"))


def rates_by_level(pairs: DataFrame) -> DataFrame:
    """(t, n, agree, rate, higher, lower) of second labels by first level."""
    count = lambda c: F.count_if(c).alias
    return pairs.groupBy("t").agg(F.count("*").alias("n"), count(F.col("t") == F.col("p"))("agree"), F.avg((F.col("t") == F.col("p")).cast("double")).alias("rate"), count(F.col("p") > F.col("t"))("higher"), count(F.col("p") < F.col("t"))("lower"))


def rater_pairs(votes: DataFrame, id_col: str, rater: str = "rater", level: str = "level") -> DataFrame:
    """(rater_a, rater_b, n, agree, rate): every two raters of the same events, by a join on the event."""
    a = votes.select(id_col, F.col(rater).alias("rater_a"), F.col(level).alias("la"))
    b = votes.select(id_col, F.col(rater).alias("rater_b"), F.col(level).alias("lb"))
    met = a.join(b, id_col).where("rater_a < rater_b")
    return met.groupBy("rater_a", "rater_b").agg(F.count("*").alias("n"), F.count_if(F.col("la") == F.col("lb")).alias("agree"), F.avg((F.col("la") == F.col("lb")).cast("double")).alias("rate"))


def transitions(old: DataFrame, new: DataFrame, id_col: str, label: str) -> DataFrame:
    """(was, now, n) over events that both label sets hold."""
    return old.select(id_col, F.col(label).alias("was")).join(new.select(id_col, F.col(label).alias("now")), id_col).groupBy("was", "now").agg(F.count("*").alias("n"))


def overlay(*layers: DataFrame, id_col: str, label: str) -> DataFrame:
    """(id, label): the label of the last layer that has the id."""
    tagged = [x.select(id_col, F.col(label).alias("label"), F.lit(i).alias("layer")) for i, x in enumerate(layers)]
    return reduce(DataFrame.unionByName, tagged).groupBy(id_col).agg(F.max_by("label", "layer").alias(label))


def one_vote_out(votes: DataFrame, id_col: str, level: str = "level") -> DataFrame:
    """(id, level, alternate): the majority label (ties to the lowest) and the lowest other vote, null if there is none."""
    counted = votes.groupBy(id_col, level).agg(F.count("*").alias("n"))
    best = counted.groupBy(id_col).agg(F.max_by(level, F.struct("n", -F.col(level))).alias("level"))
    other = counted.select(id_col, F.col(level).alias("vote")).join(best, id_col).where("vote <> level").groupBy(id_col).agg(F.min("vote").alias("alternate"))
    return best.join(other, id_col, "left")
