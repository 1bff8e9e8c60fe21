"""Splits that keep groups whole, folds, weights, and audits of leakage."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.labels import unit_hash
from tamis.operators.components import group_by_shared_fields
from tamis.tables import numbered_within


def hash_split(rows: DataFrame, id_col: str, fields: list[str], seed: str, test: float, val: float, synthetic: Column | None = None) -> DataFrame:
    """(id, component, split): components over shared fields; a hash of the seed and the component's smallest id decides.

    external_test below ``test``, val below ``test`` + ``val``, else train; a component with a
    synthetic member goes to val in place of external_test.
    """
    comp = group_by_shared_fields(rows, id_col, fields)
    u = unit_hash(seed, F.col("component").cast("string"))
    made = comp.select("id", "component", F.when(u < test, "external_test").when(u < test + val, "val").otherwise("train").alias("split"))
    if synthetic is None:
        return made
    flags = rows.select(F.col(id_col).alias("id"), synthetic.alias("synthetic"))
    tainted = made.join(flags, "id").groupBy("component").agg(F.max("synthetic").alias("tainted"))
    return made.join(tainted, "component").select("id", "component", F.when((F.col("split") == "external_test") & F.col("tainted"), "val").otherwise(F.col("split")).alias("split"))


def leaks(rows: DataFrame, group: str, split: str) -> DataFrame:
    """(group, n_splits, splits) of groups that span splits."""
    s = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("s"))
    return s.where(F.size("s") > 1).select(group, F.size("s").alias("n_splits"), F.array_join("s", "|").alias("splits"))


def majority_label(rows: DataFrame, group: str, label: str, order: str) -> DataFrame:
    """(group, label): the commonest; ties go to the label met first."""
    c = rows.groupBy(group, label).agg(F.count("*").alias("n"), F.min(order).alias("p"))
    return c.groupBy(group).agg(F.max_by(label, F.struct("n", -F.col("p"))).alias(label))


def stratified_split(groups: DataFrame, group: str, label: str, seed: str, test: float, val: float) -> DataFrame:
    """(group, label, split): within each label groups are dealt by a keyed hash's order.

    Of n groups round(test n) go to test and round(val n) to val (half to even): one at least to
    val from two groups on and to test from three on, and one always stays in train.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string")), 256)
    placed = numbered_within(groups.select(group, label, key.alias("key_")), label, ["key_", group], "nth_", "n_")
    n = F.col("n_")
    least = lambda share, of: F.greatest(F.bround(n * share).cast("int"), F.when(n >= of, 1).otherwise(0))
    n_test = F.least(least(test, 3), F.greatest(n - 2, F.lit(0)))
    n_val = F.least(least(val, 2), F.greatest(n - n_test - 1, F.lit(0)))
    nth = F.col("nth_") + 1
    return placed.select(group, label, F.when(nth <= n_test, "test").when(nth <= n_test + n_val, "val").otherwise("train").alias("split"))


def fold_of(rows: DataFrame, id_col: str, label: str, seed: str, k: int) -> DataFrame:
    """(id, label, fold): round-robin within each label in a keyed hash's order."""
    key = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")), 256)
    placed = numbered_within(rows.select(id_col, label, key.alias("key_")), label, ["key_", id_col], "nth_", "n_")
    return placed.select(id_col, label, (F.col("nth_") % k).cast("int").alias("fold"))


def balanced_split(groups: DataFrame, group: str, size: str, label: str, targets: dict[str, float], seed: str, slack: int = 40) -> DataFrame:
    """(group, split): groups in a keyed order, each to the split that is furthest below its target for the group's label and size.

    The rule is sequential, over groups (not rows): one task per label takes that label's groups in
    Arrow batches and keeps a few counters. A split may exceed its target by ``slack`` rows.
    """
    names = list(targets)
    total = groups.groupBy(label).agg(F.sum(size).alias("total_"))
    key = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string")), 256)
    dealt = groups.select(group, size, label, key.alias("key_")).join(total, label).repartition(label).sortWithinPartitions(label, F.col(size).desc(), "key_")
    kind = dict(groups.dtypes)[group]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, filled = None, {}
        for b in batches:
            out = []
            for lab, n, whole in zip(b[label], b[size], b["total_"], strict=True):
                if lab != at:
                    at, filled = lab, dict.fromkeys(names, 0)
                want = {s: targets[s] * whole for s in names}
                open_ = [s for s in names if filled[s] + n <= want[s] + slack] or names
                best = min(open_, key=lambda s: ((filled[s] + n) / max(want[s], 1e-9), names.index(s)))
                filled[best] += n
                out.append(best)
            yield pd.DataFrame({group: b[group], "split": out})

    return dealt.mapInPandas(run, f"{group} {kind}, split string")


def sampling_weights(rows: DataFrame, label: str, source_weight: Column | None = None) -> DataFrame:
    """Rows with ``weight``: the source's weight over the number of rows of the label, so that labels draw alike."""
    c = rows.groupBy(label).agg(F.count("*").alias("n_"))
    return rows.join(F.broadcast(c), label).withColumn("weight", (F.lit(1.0) if source_weight is None else source_weight) / F.col("n_")).drop("n_")


def weighted_order(rows: DataFrame, weight: str, seed: str, id_col: str) -> DataFrame:
    """Rows with ``draw_key`` = -ln(u) / weight, u hashed from the id: the k smallest are a weighted sample of k."""
    u = (unit_hash(seed, F.col(id_col).cast("string")) * (2.0**64) + 1) / (2.0**64 + 1)
    return rows.withColumn("draw_key", -F.ln(u) / F.col(weight))
