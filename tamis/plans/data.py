"""The driver's tables seen as what the operators work on, with the same views in DuckDB's SQL.

Predictions: five components of an embedding a seed, as probabilities of five levels; the label
modulo five is the truth and raises its own level's odds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.operators.decode import decoded
from tamis.plans.registry import table

SEEDS = (0, 1, 2)
THRESHOLD = 0.35


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("event_id"), (F.col("label") % 5).alias("label"), "embedding")
    rows = rows.withColumn("seed", F.explode(F.array(*map(F.lit, SEEDS))))
    part = F.slice("embedding", F.col("seed") * 5 + 1, F.lit(5))
    raw = F.transform(part, lambda x, i: F.exp(x.cast("double") * 8 + F.when(i == F.col("label"), 1.0).otherwise(0.0)))
    rows = rows.withColumn("raw", raw)
    total = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x)
    return rows.select("seed", "event_id", "label", F.transform("raw", lambda x: F.round(x / total, 9)).alias("probs"))


PRED = f"""
WITH e AS (SELECT vec_id AS event_id, label % 5 AS label, embedding, unnest({list(SEEDS)}) AS seed FROM embeddings),
r AS (SELECT seed, event_id, label, list_transform(embedding[seed * 5 + 1 : seed * 5 + 5], lambda x, i: exp(x::DOUBLE * 8 + CASE WHEN i - 1 = label THEN 1.0 ELSE 0.0 END)) AS raw FROM e),
pred0 AS (SELECT seed, event_id, label, list_transform(raw, lambda x: round(x / list_sum(raw), 9)) AS probs FROM r),
pn AS (SELECT *, list_transform(probs, lambda x: x / (probs[1] + probs[2] + probs[3] + probs[4] + probs[5])) AS p FROM pred0),
sv AS (SELECT *, [1 - p[1], 1 - (p[1] + p[2]), 1 - (p[1] + p[2] + p[3]), 1 - (p[1] + p[2] + p[3] + p[4])] AS surv FROM pn),
d0 AS (SELECT *, len(list_filter(surv, lambda x: x > 0.5))::INT AS pred, list_position(p, list_max(p)) - 1 AS argmax FROM sv),
dec AS (SELECT *, p[pred + 1] AS conf FROM d0)
"""


def decoded_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return decoded(predictions(spark, sf))


def first_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A first judge's ledger: a level for each document."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("event_id"), (3 + F.col("doc_id") % 5).cast("double").alias("level"), F.col("doc_id").alias("line_no"))


def second_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A second judge's: two lines for every other event, some of them no level."""
    d = table(spark, sf, "documents")
    level = F.when(F.col("doc_id") % 13 == 0, F.lit(3.5)).when(F.col("doc_id") % 3 == 0, 3 + (F.col("doc_id") - F.col("doc_id") % 2) % 5).otherwise(3 + F.col("n_chars") % 5)
    return d.select((F.col("doc_id") - F.col("doc_id") % 2).alias("event_id"), level.cast("double").alias("level"), F.col("doc_id").alias("line_no"))


PAIRS = """
WITH a AS (SELECT doc_id AS event_id, (3 + doc_id % 5)::INT AS t FROM documents),
b0 AS (SELECT doc_id - doc_id % 2 AS event_id, doc_id AS line_no, CASE WHEN doc_id % 13 = 0 THEN 3.5 WHEN doc_id % 3 = 0 THEN 3 + (doc_id - doc_id % 2) % 5 ELSE 3 + n_chars % 5 END AS level FROM documents),
b AS (SELECT event_id, arg_max(level::INT, line_no) AS p FROM b0 WHERE level = floor(level) GROUP BY event_id),
pairs AS (SELECT event_id, t, p FROM a JOIN b USING (event_id))
"""
