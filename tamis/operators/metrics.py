"""Metrics of decoded predictions with abstention; every rate comes with its denominator's count.

All take (keys..., label, pred, conf) rows and aggregate once; NaN confidences are never accepted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.operators.agreement import crosstab


def accepted(threshold: Column | float, conf: str = "conf") -> Column:
    return ~F.isnan(conf) & (F.col(conf) >= threshold)


def with_abstention(d: DataFrame, threshold: Column | float) -> DataFrame:
    """Adds ``final``: the level, or -1 where the gate abstains."""
    return d.withColumn("final", F.when(accepted(threshold), F.col("pred")).otherwise(-1))


def gate_metrics(d: DataFrame, keys: list[str], threshold: Column | float, probs: str | None = None) -> DataFrame:
    """n, n_covered, coverage, accuracy and MAE on covered rows, three under-classification rates, NLL if ``probs`` is given."""
    a, under = accepted(threshold), F.col("pred") < F.col("label")
    both = F.count_if(a & under)
    nll = [F.avg(-F.ln(F.greatest(F.get(F.col(probs), F.col("label")), F.lit(1e-12)))).alias("nll")] if probs else []
    return d.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(a).alias("n_covered"),
        F.avg(a.cast("double")).alias("coverage"),
        F.avg(F.when(a, (F.col("pred") == F.col("label")).cast("double"))).alias("accuracy_covered"),
        F.avg(F.when(a, F.abs(F.col("pred") - F.col("label")).cast("double"))).alias("mae_covered"),
        F.try_divide(both, F.count_if(a)).alias("under_covered"),
        F.try_divide(both, F.count("*")).alias("under_all"),
        F.try_divide(both, F.count_if(under)).alias("detector_fnr"),
        *nll,
    )


def class_counts(d: DataFrame, keys: list[str], pred: str = "final") -> DataFrame:
    """(keys, class, support, predicted, hits)."""
    one = F.struct(F.col("label").cast("int").alias("class"), F.lit(1).alias("s"), F.lit(0).alias("q"), (F.col("label") == F.col(pred)).cast("int").alias("h"))
    two = F.struct(F.col(pred).cast("int").alias("class"), F.lit(0).alias("s"), F.lit(1).alias("q"), F.lit(0).alias("h"))
    return d.select(*keys, F.inline(F.array(one, two))).groupBy(*keys, "class").agg(F.sum("s").alias("support"), F.sum("q").alias("predicted"), F.sum("h").alias("hits"))


def macro_f1(d: DataFrame, keys: list[str], threshold: Column | float, domain: int = 5) -> DataFrame:
    """macro_f1 over the classes that the truth has (an abstention is a miss), and over abstention and all ``domain`` classes."""
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0))
    per = class_counts(with_abstention(d, threshold), keys)
    return per.groupBy(*keys).agg(F.avg(F.when(F.col("support") > 0, f1)).alias("macro_f1"), (F.sum(f1) / (domain + 1)).alias("macro_f1_abstention_as_class"))


def bin_of(conf: str, bins: int) -> Column:
    """Equal-width bins [lo, hi), the last closed, by the edges as doubles: multiples of the width."""
    edges = F.array(*(F.lit(k * (1.0 / bins)) for k in range(1, bins)))
    return F.size(F.filter(edges, lambda e: F.col(conf) >= e))


def reliability(d: DataFrame, keys: list[str], bins: int = 10, hit: Column | None = None, conf: str = "conf") -> DataFrame:
    """(keys, bin, n, mean_conf, accuracy, gap), empty bins kept (null means)."""
    right = (F.col("pred") == F.col("label") if hit is None else hit).cast("double")
    per = d.where(~F.isnan(conf)).groupBy(*keys, bin_of(conf, bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(conf).alias("mean_conf"), F.avg(right).alias("accuracy"))
    grid = d.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(per, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_conf", "accuracy", (F.col("accuracy") - F.col("mean_conf")).alias("gap"))


def calibration_error(d: DataFrame, keys: list[str], bins: tuple[int, ...] = (5, 10, 15, 20)) -> DataFrame:
    """(keys, bins, n, ece) for each number of bins; null without rows."""
    out = None
    for b in bins:
        r = reliability(d, keys, b)
        part = r.groupBy(*keys).agg(F.lit(b).alias("bins"), F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * F.abs("gap")), F.sum("n")).alias("ece"))
        out = part if out is None else out.unionByName(part)
    return out


def level_recall(d: DataFrame, keys: list[str], threshold: Column | float, classes: int = 5) -> DataFrame:
    """(keys, level, support, covered_support, emitted, recall_pre_gate, recall_post_gate, recall_covered), all levels."""
    a, right = accepted(threshold), F.col("pred") == F.col("label")
    by_truth = d.groupBy(*keys, F.col("label").cast("int").alias("level")).agg(F.count("*").alias("support"), F.count_if(a).alias("covered_support"), F.count_if(right).alias("hits"), F.count_if(a & right).alias("kept_hits"))
    by_pred = d.where(a).groupBy(*keys, F.col("pred").cast("int").alias("level")).agg(F.count("*").alias("emitted"))
    grid = d.select(*keys).distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    j = grid.join(by_truth, [*keys, "level"], "left").join(by_pred, [*keys, "level"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select(*keys, "level", zero("support"), zero("covered_support"), zero("emitted"), F.try_divide("hits", "support").alias("recall_pre_gate"), F.try_divide("kept_hits", "support").alias("recall_post_gate"), F.try_divide("kept_hits", "covered_support").alias("recall_covered"))


def confusion(d: DataFrame, keys: list[str], threshold: Column | float, classes: int = 5) -> DataFrame:
    """The crosstab of truth and final level, with -1 for abstention on both axes."""
    pairs = with_abstention(d, threshold).select(*keys, F.col("label").cast("int").alias("t"), F.col("final").cast("int").alias("p"))
    return crosstab(pairs, tuple(range(-1, classes)), keys)


def gaps(d: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of errors one, two, and three or more levels off."""
    off = F.abs(F.col("pred") - F.col("label"))
    return d.groupBy(*keys).agg(F.count_if(off == 0).alias("exact"), F.count_if(off == 1).alias("one_off"), F.count_if(off == 2).alias("two_off"), F.count_if(off >= 3).alias("more_off"))


def signed_errors(d: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, n, over, under, exact, mean, median, mae), of all rows (level null) and by true level: one pass by grouping sets."""
    e = (F.col("pred") - F.col("label")).cast("double")
    rows = d.select(*keys, F.col("label").cast("int").alias("level"), e.alias("e"))
    sets = [[*keys], [*keys, "level"]]
    return rows.groupingSets(sets, *keys, "level").agg(F.count("*").alias("n"), F.count_if(F.col("e") > 0).alias("over"), F.count_if(F.col("e") < 0).alias("under"), F.count_if(F.col("e") == 0).alias("exact"), F.avg("e").alias("mean"), F.expr("percentile(e, 0.5)").alias("median"), F.avg(F.abs("e")).alias("mae"))


def error_histogram(d: DataFrame, keys: list[str], widest: int = 4) -> DataFrame:
    """(keys, error, n) for every error from -widest to widest."""
    counts = d.groupBy(*keys, (F.col("pred") - F.col("label")).cast("int").alias("error")).agg(F.count("*").alias("n"))
    grid = d.select(*keys).distinct().withColumn("error", F.explode(F.sequence(F.lit(-widest), F.lit(widest))))
    return grid.join(counts, [*keys, "error"], "left").fillna(0, ["n"])


def axis_errors(d: DataFrame, axes: list[str], least: int = 1) -> DataFrame:
    """(axis, value, n, errors, error_rate, mae, under_rate) over each axis on its own, by one grouping-sets pass."""
    off = F.col("pred") - F.col("label")
    agg = d.withColumns({a: F.col(a).cast("string") for a in axes}).groupingSets([[a] for a in axes], *axes)
    made = agg.agg(*(F.grouping(a).alias(f"g_{a}") for a in axes), F.count("*").alias("n"), F.count_if(off != 0).alias("errors"), F.avg((off != 0).cast("double")).alias("error_rate"), F.avg(F.abs(off).cast("double")).alias("mae"), F.avg((off < 0).cast("double")).alias("under_rate"))
    axis, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for a in axes:
        axis = F.when(F.col(f"g_{a}") == 0, a).otherwise(axis)
        value = F.when(F.col(f"g_{a}") == 0, F.col(a)).otherwise(value)
    return made.select(axis.alias("axis"), value.alias("value"), "n", "errors", "error_rate", "mae", "under_rate").where(F.col("n") >= least)


def worst_group(table: DataFrame) -> DataFrame:
    """(axis, value, errors, rights, rest_errors, rest_rights): the group of the highest error rate on each axis against the others."""
    top = table.groupBy("axis").agg(F.max_by(F.struct("value", "n", "errors"), F.struct("error_rate", "n", "value")).alias("w"), F.sum("n").alias("all_n"), F.sum("errors").alias("all_errors"))
    return top.select("axis", "w.value", F.col("w.errors").alias("errors"), (F.col("w.n") - F.col("w.errors")).alias("rights"), (F.col("all_errors") - F.col("w.errors")).alias("rest_errors"), (F.col("all_n") - F.col("w.n") - F.col("all_errors") + F.col("w.errors")).alias("rest_rights"))


def log_choose_half(n: Column, k: Column) -> Column:
    """P(X <= k) for X binomial(n, 1/2), from the logarithms of its terms."""
    steps = F.sequence(F.lit(1), F.greatest(k, F.lit(1)))
    folded = F.aggregate(
        steps,
        F.struct((n * F.ln(F.lit(0.5))).alias("t"), F.exp(n * F.ln(F.lit(0.5))).alias("s")),
        lambda a, i: F.struct((a["t"] + F.ln((n - i + 1) / i)).alias("t"), (a["s"] + F.exp(a["t"] + F.ln((n - i + 1) / i))).alias("s")),
    )
    return F.when(k < 1, F.exp(n * F.ln(F.lit(0.5)))).otherwise(folded["s"])


def mcnemar(a: DataFrame, b: DataFrame, id_col: str, threshold: float) -> DataFrame:
    """(n, only_a, only_b, p_value): exact two-sided test on events that one run alone gets right; abstention is wrong."""
    right = accepted(threshold) & (F.col("pred") == F.col("label"))
    j = a.select(id_col, right.alias("ra")).join(b.select(id_col, right.alias("rb")), id_col)
    c = j.agg(F.count("*").alias("n"), F.count_if(F.col("ra") & ~F.col("rb")).alias("only_a"), F.count_if(~F.col("ra") & F.col("rb")).alias("only_b"))
    m = (F.col("only_a") + F.col("only_b")).cast("double")
    tail = log_choose_half(m, F.least("only_a", "only_b"))
    return c.select("n", "only_a", "only_b", F.when(m == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)).alias("p_value"))


def ensemble(predictions: DataFrame, id_col: str = "event_id") -> DataFrame:
    """(id, label, probs): the mean of the runs' probabilities, slot by slot."""
    size = 5
    means = [F.avg(F.get("probs", F.lit(k))).alias(f"p{k}") for k in range(size)]
    return predictions.groupBy(id_col, "label").agg(*means).select(id_col, "label", F.array(*(f"p{k}" for k in range(size))).alias("probs"))


def majority_vote(d: DataFrame, id_col: str = "event_id") -> DataFrame:
    """(id, label, vote, voters, vote_conf, spread): the commonest level (ties to the lowest), its share, the voters' mean confidence, and max - min."""
    votes = d.groupBy(id_col, "label", "pred").agg(F.count("*").alias("v"), F.sum("conf").alias("c"))
    best = F.max_by(F.struct("pred", "v", "c"), F.struct("v", -F.col("pred"))).alias("b")
    out = votes.groupBy(id_col, "label").agg(best, (F.max("pred") - F.min("pred")).alias("spread"))
    return out.select(id_col, "label", F.col("b.pred").alias("vote"), F.col("b.v").alias("voters"), (F.col("b.c") / F.col("b.v")).alias("vote_conf"), "spread")


def run_pairs(d: DataFrame, id_col: str = "event_id", run: str = "seed") -> DataFrame:
    """(run_a, run_b, n, agree, cosine): every two runs on the same events: share of equal levels, mean cosine of probabilities."""
    one = lambda s: d.select(id_col, F.col(run).alias(f"run_{s}"), F.col("pred").alias(f"l{s}"), F.col("probs").alias(f"p{s}"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, z: s + z)
    cos = dot("pa", "pb") / F.sqrt(dot("pa", "pa") * dot("pb", "pb"))
    return one("a").join(one("b"), id_col).where("run_a < run_b").groupBy("run_a", "run_b").agg(F.count("*").alias("n"), F.avg((F.col("la") == F.col("lb")).cast("double")).alias("agree"), F.avg(cos).alias("cosine"))


def survival_stats(d: DataFrame) -> DataFrame:
    """(label, cut, n, p10, p50, p90, over_half) of the survival values by true level."""
    each = d.select("label", F.posexplode("surv").alias("cut", "s"))
    q = F.expr("percentile(s, array(0.1, 0.5, 0.9))").alias("q")
    return each.groupBy("label", "cut").agg(F.count("*").alias("n"), q, F.avg((F.col("s") > 0.5).cast("double")).alias("over_half")).select("label", "cut", "n", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"), "over_half")


def quantile_summary(d: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sd (0 for one row), min, q05, q25, q50, q75, q95, max, iqr; NaN and nulls left out."""
    v = F.col(value)
    rows = d.where(v.isNotNull() & ~F.isnan(v))
    q = F.expr(f"percentile({value}, array(0.05, 0.25, 0.5, 0.75, 0.95))").alias("q")
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.min(v).alias("min"), q, F.max(v).alias("max"))
    return s.select(*keys, "n", "mean", "sd", "min", *(F.col("q")[i].alias(x) for i, x in enumerate(("q05", "q25", "q50", "q75", "q95"))), "max", (F.col("q")[3] - F.col("q")[1]).alias("iqr"))


def value_counts(d: DataFrame, value: str, digits: int = 6) -> DataFrame:
    """(value, n, share) of values rounded half to even."""
    c = d.groupBy(F.bround(value, digits).alias("value")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def balance_weights(d: DataFrame, label: str, beta: float) -> DataFrame:
    """(label, n, weight): (1 - beta) / (1 - beta^n), scaled to a mean of 1 over the classes present; all 1 for beta 0."""
    c = d.groupBy(label).agg(F.count("*").alias("n"))
    raw = F.lit(1.0) if beta == 0 else (1 - beta) / (1 - F.pow(F.lit(beta), F.col("n").cast("double")))
    return c.withColumn("raw_", raw).withColumn("weight", F.col("raw_") / F.avg("raw_").over(Window.partitionBy())).drop("raw_")


def constant_baselines(d: DataFrame, classes: int = 5) -> DataFrame:
    """(level, n, accuracy, mae, under_rate) of always answering a level."""
    c = d.groupBy("label").agg(F.count("*").alias("m"))
    levels = d.sparkSession.range(classes).select(F.col("id").cast("int").alias("level"))
    off = F.col("level") - F.col("label")
    s = c.crossJoin(F.broadcast(levels)).groupBy("level")  # of class counts
    return s.agg(F.sum("m").alias("n"), (F.sum(F.when(off == 0, F.col("m")).otherwise(0)) / F.sum("m")).alias("accuracy"), (F.sum(F.abs(off) * F.col("m")) / F.sum("m")).alias("mae"), (F.sum(F.when(off < 0, F.col("m")).otherwise(0)) / F.sum("m")).alias("under_rate"))


def prior_baseline(d: DataFrame) -> DataFrame:
    """(n, prior_accuracy): the chance of a guess by class shares, the sum of their squares."""
    c = d.groupBy("label").agg(F.count("*").cast("double").alias("m"))
    return c.agg(F.sum("m").cast("long").alias("n"), (F.sum(F.col("m") ** 2) / F.sum("m") ** 2).alias("prior_accuracy"))


def emitted_census(d: DataFrame, keys: list[str], threshold: float, classes: int = 5) -> DataFrame:
    """(keys, n_emitted, n_levels, never): accepted answers, different levels among them, and those never given, joined by |."""
    seen = d.where(accepted(threshold)).groupBy(*keys).agg(F.count("*").alias("n_emitted"), F.collect_set(F.col("pred").cast("int")).alias("seen"))
    never = F.array_except(F.sequence(F.lit(0), F.lit(classes - 1)), F.col("seen"))
    return seen.select(*keys, "n_emitted", F.size("seen").alias("n_levels"), F.array_join(never.cast("array<string>"), "|").alias("never"))


def gate_table(m: DataFrame, keys: list[str]) -> DataFrame:
    """The release gates as booleans, and all of them together, from columns kappa_covered, macro_f1, under_covered, coverage."""
    k, f, u, a = F.col("kappa_covered") >= 0.70, F.col("macro_f1") >= 0.75, F.col("under_covered") <= 0.05, (1 - F.col("coverage")) <= 0.30
    yes = lambda c: F.coalesce(c, F.lit(False))
    return m.select(*keys, yes(k).alias("gate_kappa"), yes(f).alias("gate_f1"), yes(u).alias("gate_under"), yes(a).alias("gate_abstention"), yes(f & u & a).alias("gate_release"), yes(k & f & u & a).alias("gate_all"))


def yardsticks(runs: DataFrame, truths: DataFrame, least: int = 20) -> DataFrame:
    """(yardstick, version, n_runs, mean, low, high) of quadratic kappa: every run against every label set, by one equi-join.

    ``runs``: (version, seed, event_id, pred); ``truths``: (yardstick, event_id, label). Cells of
    under ``least`` matched events a run are left out.
    """
    from tamis.operators.agreement import coefficients

    j = runs.join(truths, "event_id").select("yardstick", "version", "seed", F.col("label").alias("t"), F.col("pred").alias("p"))
    k = coefficients(j, ["yardstick", "version", "seed"]).where(F.col("n") >= least)
    return k.groupBy("yardstick", "version").agg(F.count("*").alias("n_runs"), F.avg("quadratic").alias("mean"), F.min("quadratic").alias("low"), F.max("quadratic").alias("high"))


def ln_factorial(x: Column) -> Column:
    """The logarithm of x!, by Stirling's series from 20 on (its rest is under 2e-15 there)."""
    y = F.greatest(x, F.lit(20)).cast("double")
    series = y * F.ln(y) - y + F.ln(2 * math.pi * y) / 2 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    known = F.array(*(F.lit(math.log(math.factorial(k))) for k in range(20)))
    return F.when(x < 20, F.get(known, x.cast("int"))).otherwise(series)


def fisher(table: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Adds ``p_value``: Fisher's exact two-sided test of the 2x2 table in each row, from log factorials of its margins.

    The walk goes both ways from the table at hand, over those whose probability can be told from
    zero: by Hoeffding's bound, tables over sqrt(373 k) from the mean, k the smallest margin, have
    less than exp(-746) all together, which is 0 as a double.
    """
    n = F.col(a) + F.col(b) + F.col(c) + F.col(d)
    r1, c1 = F.col(a) + F.col(b), F.col(a) + F.col(c)
    here = F.lit(0.0)
    for x in (r1, n - r1, c1, n - c1):
        here = here + ln_factorial(x)
    for x in (n, *map(F.col, (a, b, c, d))):
        here = here - ln_factorial(x)
    far = F.ceil(F.sqrt(373 * F.least(r1, c1, n - r1, n - c1))) + 1
    mean = r1.cast("double") * c1 / F.greatest(n, F.lit(1))
    low = F.greatest(F.lit(0).cast("bigint"), r1 + c1 - n, F.floor(mean) - far)
    high = F.least(r1, c1, F.ceil(mean) + far)
    # from one table to the next the probability changes by a ratio of four numbers; p is relative to the table at hand
    up = lambda x: F.ln((r1 - x).cast("double") * (c1 - x) / ((x + 1).cast("double") * (n - r1 - c1 + x + 1)))
    none = F.array().cast("array<bigint>")

    def walked(xs: Column, ratio) -> Column:
        start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("total"))
        return F.aggregate(xs, start, lambda s, x: F.struct((s["p"] + ratio(x)).alias("p"), (s["total"] + F.when(s["p"] + ratio(x) <= 1e-9, F.exp(s["p"] + ratio(x))).otherwise(0.0)).alias("total")))["total"]

    at = F.col(a).cast("bigint")
    above = walked(F.when((low <= at) & (at < high), F.sequence(at, high - 1)).otherwise(none), up)
    below = walked(F.when((low < at) & (at <= high), F.sequence(at - 1, low, F.lit(-1).cast("bigint"))).otherwise(none), lambda x: -up(x))
    return table.withColumn("p_value", F.least(F.lit(1.0), F.exp(here) * (1 + above + below)))
