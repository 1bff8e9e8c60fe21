"""Ordered operators that scale: running totals in two levels, sweeps over thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.tables import numbered, numbered_within


def running_totals(df: DataFrame, keys: list[str], order: str, measures: list[str], buckets: int = 512) -> DataFrame:
    """Adds ``cum_<measure>`` for each: the sum over rows of the key with ``order`` (in [0, 1], distinct within a key) at least the row's.

    Rows are dealt into ranges of ``order``; windows run within a range, and over the ranges'
    totals (``buckets`` rows a key), so that a key's rows need not fit one task.
    """
    ranged = df.withColumn("bucket_", F.least(F.floor(F.col(order) * buckets), F.lit(buckets - 1)))
    inner = Window.partitionBy(*keys, "bucket_").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*keys).orderBy(F.col("bucket_").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "bucket_").agg(*(F.sum(m).alias(f"b_{m}") for m in measures))
    totals = totals.select(*keys, "bucket_", *(F.coalesce(F.sum(f"b_{m}").over(outer), F.lit(0)).alias(f"b_{m}") for m in measures))
    joined = ranged.select("*", *(F.sum(m).over(inner).alias(f"w_{m}") for m in measures)).join(totals, [*keys, "bucket_"])
    return joined.select(*df.columns, *((F.col(f"w_{m}") + F.col(f"b_{m}")).alias(f"cum_{m}") for m in measures))


def sweep(df: DataFrame, keys: list[str], value: str, thresholds: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """(keys, threshold, n_total, sums over rows with ``value`` at least the threshold), for every threshold of the key.

    ``thresholds``: (keys, ts), one sorted array a key, of bounded length. Each row finds its place among
    them, so rows aren't multiplied; totals are then summed over the thresholds alone. NaN is under all.
    """
    placed = df.join(F.broadcast(thresholds), keys) if keys else df.crossJoin(F.broadcast(thresholds))
    at = F.when(F.isnan(value), 0).otherwise(F.size(F.filter("ts", lambda t: t <= F.col(value))))
    sums = placed.select(*keys, at.alias("at"), *(m.alias(k) for k, m in measures.items())).groupBy(*keys, "at").agg(F.count("*").alias("n_"), *(F.sum(k).alias(k) for k in measures))
    grid = thresholds.select(*keys, F.posexplode("ts").alias("k", "threshold")).withColumn("at", F.col("k") + 1)
    zero = thresholds.select(*keys, F.lit(-1).alias("k"), F.lit(None).cast("double").alias("threshold"), F.lit(0).alias("at"))
    full = grid.unionByName(zero).join(sums, [*keys, "at"], "left")
    above = Window.partitionBy(*keys).orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n_").over(Window.partitionBy(*keys))
    out = full.select(*keys, "threshold", total.alias("n_total"), F.coalesce(F.sum("n_").over(above), F.lit(0)).alias("n"), *(F.coalesce(F.sum(k).over(above), F.lit(0)).alias(k) for k in measures))
    return out.where("threshold IS NOT NULL")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order; rows with a null key all stay."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    return df.withColumn("nth_", F.when(some, n).otherwise(1)).where("nth_ = 1").drop("nth_")


def interleave(df: DataFrame, source: str, order: str) -> DataFrame:
    """Adds ``turn`` and sorts round-robin over the sources: first of each, second of each, and so on."""
    turn = F.row_number().over(Window.partitionBy(source).orderBy(order))
    return df.withColumn("turn", turn).orderBy("turn", source)


def capped(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group: the feature asked for is the cap. Of use after all other rungs of a ladder."""
    return df.withColumn("nth_", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("nth_") <= limit).drop("nth_")


def top_up(df: DataFrame, stratum: str, order: str, each: int, total: int) -> DataFrame:
    """``each`` rows of every stratum first, then more in order until there are ``total``; adds ``picked``: stratum or backfill."""
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    marked = df.withColumn("picked", F.when(nth <= each, "stratum").otherwise("backfill"))
    return marked.orderBy(F.col("picked").desc(), order).limit(total)


def sections(lines: DataFrame, doc: str, line_no: str, text: str, header: str) -> DataFrame:
    """Adds ``section``: the last line before or at this one that matches ``header`` (its first group); null before any."""
    name = F.regexp_extract(F.col(text), header, 1)
    upto = Window.partitionBy(doc).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(F.when(F.col(text).rlike(header), name), ignorenulls=True).over(upto))


def near_marker(lines: DataFrame, doc: str, line_no: str, text: str, mention: str, marker: str, reach: int) -> DataFrame:
    """Lines that match ``mention``, with ``marked``: whether one within ``reach`` lines matches ``marker``."""
    around = Window.partitionBy(doc).orderBy(line_no).rowsBetween(-reach, reach)
    near = F.max(F.col(text).rlike(marker).cast("int")).over(around) == 1
    return lines.withColumn("marked", near).where(F.col(text).rlike(mention))


def paragraphs(lines: DataFrame, doc: str, line_no: str, text: str) -> DataFrame:
    """(doc, paragraph, first_line, n_lines, body): blocks between blank lines; a bullet starts a block of its own."""
    blank = F.btrim(F.col(text)) == ""
    opens = F.col(text).rlike(r"^\s*([-*+]|\d+\.)\s")
    before = F.lag(blank, 1, True).over(Window.partitionBy(doc).orderBy(line_no))
    marked = lines.withColumn("start_", (~blank & (before | opens)).cast("int")).withColumn("blank_", blank)
    number = F.sum("start_").over(Window.partitionBy(doc).orderBy(line_no).rowsBetween(Window.unboundedPreceding, 0))
    solid = marked.withColumn("paragraph", number).where("NOT blank_")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(line_no, F.btrim(F.col(text)).alias("t")))), lambda x: x["t"]), " ")
    return solid.groupBy(doc, "paragraph").agg(F.min(line_no).alias("first_line"), F.count("*").alias("n_lines"), body.alias("body"))


def one_per_level(rows: DataFrame, level: str, order: str) -> DataFrame:
    """Of each level the row whose place in order (from 0) is the level modulo the level's number of rows, so that levels differ in what they pick."""
    placed = numbered_within(rows, level, [order], "nth_", "n_")
    return placed.where(F.col("nth_") == F.col(level) % F.col("n_")).select(*rows.columns)


def best_first(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Adds ``rank``, from 1 on: the greatest value first, equal ones by name, nulls last."""
    placed = numbered(rows.withColumn("down_", -F.col(value)).withColumn("none_", F.col(value).isNull()), ["none_", "down_", name], "nth_")
    return placed.select(*rows.columns, (F.col("nth_") + 1).alias("rank"))
