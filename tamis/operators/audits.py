"""Comparisons of tables, counts and published figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled_counts(rows: DataFrame, key: str, across: str, domain: list[str]) -> DataFrame:
    """Counts by ``key`` with a column for each value of the domain, zeros filled in."""
    return rows.groupBy(key).pivot(across, domain).count().na.fill(0, domain)


def absent_cells(grid: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): cells of the grid that weren't seen, and seen ones that the grid lacks."""
    missing = grid.select(*keys).distinct().join(seen, keys, "left_anti").withColumn("side", F.lit("missing"))
    extra = seen.select(*keys).distinct().join(grid, keys, "left_anti").withColumn("side", F.lit("unexpected"))
    return missing.unionByName(extra)


def set_difference(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """(n_a, n_b, n_both, only_a, only_b, equal) of two sets of ids."""
    x = a.select(id_col).distinct().withColumn("a_", F.lit(True))
    y = b.select(id_col).distinct().withColumn("b_", F.lit(True))
    j = x.join(y, id_col, "full")
    ina, inb = F.col("a_").isNotNull(), F.col("b_").isNotNull()
    return j.agg(F.count_if(ina).alias("n_a"), F.count_if(inb).alias("n_b"), F.count_if(ina & inb).alias("n_both"), F.count_if(ina & ~inb).alias("only_a"), F.count_if(~ina & inb).alias("only_b")).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def in_every(rows: DataFrame, id_col: str, part: str, n_parts: int) -> DataFrame:
    """(id) of ids that occur in all ``n_parts`` parts."""
    return rows.groupBy(id_col).agg(F.count_distinct(part).alias("n_")).where(F.col("n_") == n_parts).select(id_col)


def reconcile(published: DataFrame, measured: DataFrame, name: str = "name", tolerance: Column | float = 5e-4) -> DataFrame:
    """(name, published, measured, status): match within the tolerance, differs, unpublished or unmeasured."""
    p = published.select(name, F.col("value").alias("published"), *([c for c in published.columns if c not in (name, "value")]))
    j = p.join(measured.select(name, F.col("value").alias("measured")), name, "full")
    status = F.when(F.col("published").isNull(), "unpublished").when(F.col("measured").isNull(), "unmeasured").when(F.abs(F.col("published") - F.col("measured")) <= tolerance, "match").otherwise("differs")
    return j.select(name, "published", "measured", status.alias("status"))


def largest_difference(a: DataFrame, b: DataFrame, id_col: str, values: str) -> DataFrame:
    """(n, max_abs, n_unmatched): positional comparison of arrays of the same ids."""
    j = a.select(id_col, F.col(values).alias("x")).join(b.select(id_col, F.col(values).alias("y")), id_col, "full")
    d = F.array_max(F.zip_with("x", "y", lambda p, q: F.abs(p - q)))
    return j.agg(F.count("*").alias("n"), F.max(d).alias("max_abs"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("n_unmatched"))


def shares_by_denominator(numerator: Column, denominators: dict[str, Column], rows: DataFrame) -> DataFrame:
    """(denominator, hits, n, share): one numerator over several populations, each with its own count."""
    parts = [F.struct(F.lit(k).alias("denominator"), F.count_if(numerator & c).alias("hits"), F.count_if(c).alias("n")) for k, c in denominators.items()]
    return rows.agg(F.array(*parts).alias("x")).select(F.inline("x")).withColumn("share", F.try_divide(F.col("hits").cast("double"), "n"))


def hygiene(rows: DataFrame, id_col: str, conditions: dict[str, Column]) -> DataFrame:
    """One row: n, n_ids, and for each named condition its rows and ids."""
    aggs = [F.count("*").alias("n"), F.count_distinct(id_col).alias("n_ids")]
    for k, c in conditions.items():
        aggs += [F.count_if(c).alias(f"n_{k}"), F.count_distinct(F.when(c, F.col(id_col))).alias(f"ids_{k}")]
    return rows.agg(*aggs)


def summarise_runs(runs: DataFrame, arm: str, value: str, reference: str) -> DataFrame:
    """(arm, n, mean, low, high, spread, delta) of runs by arm; delta of the mean against the reference arm."""
    s = runs.groupBy(arm).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    ref = s.where(F.col(arm) == reference).select(F.col("mean").alias("ref_"))
    return s.crossJoin(F.broadcast(ref)).select(arm, "n", "mean", "low", "high", (F.col("high") - F.col("low")).alias("spread"), (F.col("mean") - F.col("ref_")).alias("delta"))


def relabelled(rows: DataFrame, labels: DataFrame, id_col: str, field: str) -> DataFrame:
    """Rows with the field taken from ``labels`` where these have one, and whether that changed it."""
    j = rows.join(labels.select(id_col, F.col(field).alias("new_")), id_col, "left")
    value = F.coalesce("new_", field)
    return j.select(*(value.alias(c) if c == field else F.col(c) for c in rows.columns), (~value.eqNullSafe(F.col(field))).alias("changed"))


def long_form(rows: DataFrame, keys: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """A row for each of the value columns."""
    return rows.unpivot(keys, values, name, value)


def joined_strictly(left: DataFrame, right: DataFrame, key: str, equal: dict[str, str]) -> DataFrame:
    """(check, n): how many keys only one side has, and how many rows of both differ in each pair of columns (null-safe). All zero where the tables agree."""
    a = left.select(F.col(key).alias("a_"), F.lit(True).alias("in_a"), *(F.col(x).alias(f"l_{x}") for x in equal))
    b = right.select(F.col(key).alias("b_"), F.lit(True).alias("in_b"), *(F.col(y).alias(f"r_{y}") for y in equal.values()))
    j = a.join(b, F.col("a_") == F.col("b_"), "full")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    counts = {"only_left": F.col("in_b").isNull(), "only_right": F.col("in_a").isNull()} | {f"{x}_differs": both & ~F.col(f"l_{x}").eqNullSafe(F.col(f"r_{y}")) for x, y in equal.items()}
    one = j.agg(*(F.count_if(c).alias(name) for name, c in counts.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in counts))).alias("x")).select("x.*")
