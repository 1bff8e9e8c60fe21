"""Choosing thresholds, cut points and temperatures."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.ordered import running_totals, sweep


def candidates(d: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold, n_total, n, under, errors) at each distinct confidence and at 0, from one aggregation and running totals."""
    rows = d.where(~F.isnan("conf")).groupBy(*keys, F.col("conf").alias("threshold")).agg(F.count("*").alias("n"), F.count_if(F.col("pred") < F.col("label")).alias("under"), F.count_if(F.col("pred") != F.col("label")).alias("errors"))
    totals = d.groupBy(*keys).agg(F.count("*").alias("n_total"))
    run = running_totals(rows, keys, "threshold", ["n", "under", "errors"]).select(*keys, "threshold", F.col("cum_n").alias("n"), F.col("cum_under").alias("under"), F.col("cum_errors").alias("errors"))
    zero = rows.groupBy(*keys).agg(F.lit(0.0).alias("threshold"), F.sum("n").alias("n"), F.sum("under").alias("under"), F.sum("errors").alias("errors"))
    return run.unionByName(zero).join(totals, keys)


def select_threshold(d: DataFrame, keys: list[str], target: float = 0.05, most_abstained: float = 0.3, tie: str = "high", ceiling: float | None = None, slack: float = 0.0) -> DataFrame:
    """(keys, threshold, coverage, under_rate, feasible): of the candidates that cover enough, those whose under-rate meets the target.

    The most covering of those is taken, ties going to the ``high`` (or ``low``) threshold; if none
    is feasible, the least under-rate, then error rate, then highest coverage, then lowest
    threshold. ``ceiling`` leaves out thresholds that no confidence can exceed.
    """
    c = candidates(d, keys).withColumns({"coverage": F.col("n") / F.col("n_total"), "under_rate": F.try_divide("under", "n"), "error_rate": F.try_divide("errors", "n")})
    if ceiling is not None:
        c = c.where(F.col("threshold") <= ceiling + 1e-12)
    c = c.where(F.col("coverage") >= 1 - most_abstained - slack)
    ok = F.coalesce(F.col("under_rate") <= target + slack, F.lit(False))
    t = F.col("threshold") if tie == "high" else -F.col("threshold")
    rank = F.when(ok, F.struct(F.lit(1).alias("a"), F.col("coverage").alias("b"), t.alias("c"), F.lit(0.0).alias("d"), F.lit(0.0).alias("e"))).otherwise(
        F.struct(F.lit(0).alias("a"), (-F.col("under_rate")).alias("b"), (-F.col("error_rate")).alias("c"), F.col("coverage").alias("d"), (-F.col("threshold")).alias("e"))
    )
    return c.groupBy(*keys).agg(F.max_by(F.struct("threshold", "coverage", "under_rate", ok.alias("feasible")), rank).alias("x")).select(*keys, "x.*")


def coverage_thresholds(d: DataFrame, keys: list[str], targets: tuple[float, ...] = (0.7, 0.8, 0.9)) -> DataFrame:
    """(keys, target, threshold, n_accepted, coverage): the k-th largest confidence, k = ceil(target n) in 1..n; all ties accepted."""
    c = candidates(d, keys).where("threshold > 0 OR n = n_total")
    k = F.greatest(F.lit(1), F.least(F.col("n_total"), F.ceil(F.col("target") * F.col("n_total") - 1e-9)))
    wide = c.withColumn("target", F.explode(F.array(*map(F.lit, targets)))).where(F.col("n") >= k)
    return wide.groupBy(*keys, "target").agg(F.max_by(F.struct("threshold", F.col("n").alias("n_accepted"), (F.col("n") / F.col("n_total")).alias("coverage")), "threshold").alias("x")).select(*keys, "target", "x.*")


def matched_threshold(d: DataFrame, keys: list[str], coverage: float) -> DataFrame:
    """(keys, threshold, coverage): the confidence whose coverage is nearest to the one given; ties to the higher."""
    c = candidates(d, keys).where("threshold > 0").withColumn("coverage", F.col("n") / F.col("n_total"))
    return c.groupBy(*keys).agg(F.min_by(F.struct("threshold", "coverage"), F.struct(F.round(F.abs(F.col("coverage") - coverage), 12), -F.col("threshold"))).alias("x")).select(*keys, "x.*")


def threshold_grid(d: DataFrame, keys: list[str], steps: int = 20) -> DataFrame:
    """(keys, threshold, n_total, n, coverage, accuracy, under_rate, under_all) on an even grid from 0 to 1."""
    ts = d.select(*keys).distinct().withColumn("ts", F.array(*(F.lit(k / steps) for k in range(steps + 1))))
    s = sweep(d, keys, "conf", ts, {"rights": (F.col("pred") == F.col("label")).cast("int"), "under": (F.col("pred") < F.col("label")).cast("int")})
    return s.select(*keys, "threshold", "n_total", "n", (F.col("n") / F.col("n_total")).alias("coverage"), F.try_divide("rights", "n").alias("accuracy"), F.try_divide("under", "n").alias("under_rate"), (F.col("under") / F.col("n_total")).alias("under_all"))


def risk_coverage(d: DataFrame, keys: list[str], points: int = 51) -> DataFrame:
    """(keys, threshold, n, coverage, risk) at the different quantiles of the confidences."""
    grid = ", ".join(repr(k / (points - 1)) for k in range(points))
    ts = d.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.expr(f"percentile(conf, array({grid}))"))).alias("ts"))
    s = sweep(d, keys, "conf", ts, {"wrong": (F.col("pred") != F.col("label")).cast("int")})
    return s.select(*keys, "threshold", "n", (F.col("n") / F.col("n_total")).alias("coverage"), F.try_divide("wrong", "n").alias("risk"))


def cumulative_risk(d: DataFrame, keys: list[str], id_col: str = "event_id") -> DataFrame:
    """(keys, id, nth, risk) in order of falling confidence; equal confidences in order of the id."""
    w = Window.partitionBy(*keys).orderBy(F.col("conf").desc(), id_col)
    wrong = (F.col("pred") != F.col("label")).cast("double")
    return d.select(*keys, id_col, F.row_number().over(w).alias("nth"), (F.sum(wrong).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.row_number().over(w)).alias("risk"))


def risk_area(d: DataFrame, keys: list[str], id_col: str = "event_id") -> DataFrame:
    """(keys, n, augrc): the trapezoid under the cumulative risk against coverage."""
    c = cumulative_risk(d, keys, id_col)
    w = Window.partitionBy(*keys).orderBy("nth")
    step = (F.col("risk") + F.lag("risk").over(w)) / 2
    return c.withColumn("step", step).groupBy(*keys).agg(F.count("*").alias("n"), (F.coalesce(F.sum("step"), F.lit(0.0)) / F.count("*")).alias("augrc"))


def widest_gap(d: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_values, lower, gap): the largest difference of neighbouring confidences; ties to the lowest."""
    v = d.select(*keys, "conf").distinct()
    w = Window.partitionBy(*keys).orderBy("conf")
    g = v.withColumn("gap", F.lead("conf").over(w) - F.col("conf"))
    best = F.max_by(F.struct(F.col("conf").alias("lower"), "gap"), F.when(F.col("gap").isNotNull(), F.struct("gap", -F.col("conf"))))
    return g.groupBy(*keys).agg(F.count("*").alias("n_values"), best.alias("x")).select(*keys, "n_values", "x.*")


def coverage_ladder(d: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold, n, coverage): what can be reached at each different confidence, ties counted whole."""
    return candidates(d, keys).where("threshold > 0").select(*keys, "threshold", "n", (F.col("n") / F.col("n_total")).alias("coverage"))


def near_boundary(d: DataFrame, keys: list[str], threshold: float, tolerances: tuple[float, ...] = (0.005, 0.01, 0.02, 0.05)) -> DataFrame:
    """(keys, tolerance, n): confidences within each tolerance of the threshold."""
    wide = d.withColumn("tolerance", F.explode(F.array(*map(F.lit, tolerances))))
    return wide.groupBy(*keys, "tolerance").agg(F.count_if(F.abs(F.col("conf") - threshold) <= F.col("tolerance")).alias("n"))


def rank_window(d: DataFrame, keys: list[str], low: int, high: int, id_col: str = "event_id") -> DataFrame:
    """The rows of ranks low..high by falling confidence (equal ones by id), with their rank."""
    w = Window.partitionBy(*keys).orderBy(F.col("conf").desc(), id_col)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank").between(low, high))


def fit_temperature(d: DataFrame, keys: list[str], points: int = 81, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """(keys, temperature, nll): the first of a geometric grid with the least mean NLL of p^(1/T), scaled to one."""
    grid = [low * math.exp(math.log(high / low) * k / (points - 1)) for k in range(points)]
    wide = d.select(*keys, "label", "probs", F.posexplode(F.array(*map(F.lit, grid))).alias("k", "t"))
    powed = F.transform("probs", lambda x: F.pow(F.greatest(x, F.lit(1e-12)), 1 / F.col("t")))
    nll = -F.ln(F.greatest(F.get("q", F.col("label")) / F.aggregate("q", F.lit(0.0), lambda a, x: a + x), F.lit(1e-12)))
    per = wide.withColumn("q", powed).groupBy(*keys, "k", "t").agg(F.avg(nll).alias("nll"))
    return per.groupBy(*keys).agg(F.min_by(F.struct(F.col("t").alias("temperature"), "nll"), F.struct(F.round("nll", 12), "k")).alias("x")).select(*keys, "x.*")


def marginal_cuts(d: DataFrame, classes: int = 5) -> list[float]:
    """For each cut k the quantile of S_k at 1 - mean(label > k), so that as many exceed it as have a higher level.

    Two aggregations; the second needs the first's ``classes`` - 1 numbers on the driver.
    """
    shares = d.agg(*(F.avg((F.col("label") > k).cast("double")).alias(f"q{k}") for k in range(classes - 1))).first()
    cuts = d.agg(*(F.expr(f"percentile(surv[{k}], {1 - shares[k]!r}D)").alias(f"t{k}") for k in range(classes - 1))).first()
    return list(cuts)


def recall_grid_cuts(d: DataFrame, points: int = 20, classes: int = 5) -> DataFrame:
    """(cut1..cut4, macro_recall): the first combination, in the grid's order, of the highest macro recall.

    A row's level under any cuts follows from how many grid points each of its survival values
    exceeds, so rows are first counted by these: a table of classes x (points + 1)^4 rows at most,
    which one task sums up along each cut; a combination's hits are then sums over few boxes.
    """
    cuts = classes - 1
    grid = [(k + 1) / (points + 1) for k in range(points)]

    def exceeded(k: int) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, grid)), lambda g: F.get("surv", F.lit(k)) > g)).alias(f"o{k}")

    over = [exceeded(k) for k in range(cuts)]
    cells = d.groupBy("label", *over).agg(F.count("*").alias("n"))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        if not len(rows):
            return
        at = rows[[f"o{k}" for k in range(cuts)]].to_numpy()
        recalls = []
        for label, some in rows.groupby("label"):
            count = np.zeros((points + 1,) * cuts)
            which = (rows["label"] == label).to_numpy()
            np.add.at(count, tuple(at[which].T), some["n"].to_numpy())
            hits = np.zeros((points,) * cuts)
            for above in product((False, True), repeat=cuts):  # which cuts are exceeded
                if sum(above) == label:
                    box = count
                    for k, more in enumerate(above):
                        upto = box.cumsum(axis=k)
                        low = np.take(upto, range(points), axis=k)  # of rows that exceed c points at most: not cut c
                        box = np.take(upto, [points], axis=k) - low if more else low
                    hits += box
            recalls.append(hits / some["n"].sum())
        macro = np.mean(recalls, axis=0).round(12)
        first = np.unravel_index(int(macro.argmax()), macro.shape)
        yield pd.DataFrame([[*(grid[c] for c in first), float(macro[first])]], columns=[*(f"cut{k + 1}" for k in range(cuts)), "macro_recall"])

    return cells.coalesce(1).mapInPandas(best, ", ".join(f"cut{k + 1} double" for k in range(cuts)) + ", macro_recall double")


def rank_runs(m: DataFrame, run: str = "seed") -> DataFrame:
    """Adds ``rank``: gates met first, then macro-F1, coverage, and the lowest false-negative rate; the run's name settles ties."""
    order = [F.col("gates_met").desc(), F.round("macro_f1", 9).desc(), F.round("coverage", 9).desc(), F.round("detector_fnr", 9).asc_nulls_last(), F.col(run)]
    return m.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order)))
