"""Queries on the agreement of judges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.labels import LEVELS
from tamis.operators import agreement
from tamis.plans.data import PAIRS, first_labels, second_labels
from tamis.plans.registry import query, table


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.paired_labels(first_labels(spark, sf), second_labels(spark, sf))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the last bits of a sum's order don't matter."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(PAIRS + "SELECT event_id, t, p FROM pairs")
def judge_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf)


@query(PAIRS + """, g AS (SELECT a.v::INT AS t, b.v::INT AS p FROM (VALUES (3),(4),(5),(6),(7)) a(v), (VALUES (3),(4),(5),(6),(7)) b(v)),
c AS (SELECT g.t, g.p, count(pairs.event_id) AS n FROM g LEFT JOIN pairs ON g.t = pairs.t AND g.p = pairs.p GROUP BY ALL)
SELECT t, p, n, round(n / nullif(sum(n) OVER (PARTITION BY t), 0), 6) AS row_share FROM c""")
def judge_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agreement.crosstab(_pairs(spark, sf), LEVELS))


KAPPAS = """, x AS (SELECT {k} t::DOUBLE AS t, p::DOUBLE AS p FROM {src}),
u AS (SELECT {k} v, dense_rank() OVER ({part} ORDER BY v) AS r FROM (SELECT DISTINCT {k} v FROM (SELECT {k} t AS v FROM x UNION ALL SELECT {k} p FROM x))),
y AS (SELECT {xk} x.t, x.p, ut.r::DOUBLE AS tr, up.r::DOUBLE AS pr FROM x JOIN u ut ON x.t = ut.v {onut} JOIN u up ON x.p = up.v {onup}),
m AS (SELECT {k} count(*) AS n, avg((t = p)::INT) AS agreement, avg(abs(t - p)) AS dist,
  1 - avg((t-p)*(t-p)) / (avg(t*t) + avg(p*p) - 2*avg(t)*avg(p)) AS quadratic,
  1 - avg((tr-pr)*(tr-pr)) / (avg(tr*tr) + avg(pr*pr) - 2*avg(tr)*avg(pr)) AS quadratic_compressed FROM y {grp}),
mt AS (SELECT {k} t, count(*)::DOUBLE AS n FROM x GROUP BY ALL), mp AS (SELECT {k} p, count(*)::DOUBLE AS n FROM x GROUP BY ALL),
ch AS (SELECT {mk} sum(CASE WHEN t = p THEN mt.n * mp.n ELSE 0 END) AS same, sum(abs(t - p) * mt.n * mp.n) AS apart FROM mt JOIN mp ON true {onmp} {grp2})
SELECT {ok} n, round(agreement, 6) AS agreement, round((agreement - same / (n*n)) / (1 - same / (n*n)), 6) AS kappa,
  round(1 - dist / (apart / (n*n)), 6) AS linear, round(quadratic, 6) AS quadratic, round(quadratic_compressed, 6) AS quadratic_compressed
FROM m JOIN ch ON true {onch}"""


def kappas_sql(src: str, key: str = "") -> str:
    k = f"{key}, " if key else ""
    on = lambda a, b: f"AND {a}.{key} = {b}.{key}" if key else ""
    return KAPPAS.format(src=src, k=k, part=f"PARTITION BY {key}" if key else "", xk=f"x.{key}, " if key else "", onut=on("x", "ut"), onup=on("x", "up"), grp=f"GROUP BY {key}" if key else "", mk=f"mt.{key}, " if key else "", onmp=on("mt", "mp"), grp2=f"GROUP BY mt.{key}" if key else "", ok=f"m.{key}, " if key else "", onch=on("m", "ch"))


@query(PAIRS + kappas_sql("pairs"))
def judge_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agreement.coefficients(_pairs(spark, sf)))


@query(PAIRS + "SELECT t, count(*) AS n, count(*) FILTER (t = p) AS agree, round(avg((t = p)::INT), 6) AS rate, count(*) FILTER (p > t) AS higher, count(*) FILTER (p < t) AS lower FROM pairs GROUP BY t")
def judge_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agreement.rates_by_level(_pairs(spark, sf)))


@query(PAIRS + "SELECT round(1 - avg((t-p)*(t-p)) / (avg(t*t) + avg(p*p) - 2*avg(t)*avg(p)), 6) AS quadratic FROM pairs")
def matrix_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agreement.kappa_from_matrix(agreement.crosstab(_pairs(spark, sf), LEVELS)))


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.create_map(F.lit("ann"), 3 + F.col("doc_id") % 5, F.lit("bob"), 3 + F.col("n_chars") % 5, F.lit("cy"), 3 + (F.col("doc_id") + F.col("n_chars")) % 5).alias("votes"))
    return d.select("doc_id", F.explode("votes").alias("rater", "level"))


VOTES = """WITH votes AS (SELECT doc_id, 'ann' AS rater, 3 + doc_id % 5 AS level FROM documents UNION ALL SELECT doc_id, 'bob', 3 + n_chars % 5 FROM documents
UNION ALL SELECT doc_id, 'cy', 3 + (doc_id + n_chars) % 5 FROM documents)
"""


@query(VOTES + """SELECT a.rater AS rater_a, b.rater AS rater_b, count(*) AS n, count(*) FILTER (a.level = b.level) AS agree, round(avg((a.level = b.level)::INT), 6) AS rate
FROM votes a JOIN votes b ON a.doc_id = b.doc_id AND a.rater < b.rater GROUP BY ALL""")
def rater_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(agreement.rater_pairs(_votes(spark, sf), "doc_id"))


@query(VOTES + """, c AS (SELECT doc_id, level, count(*) AS n FROM votes GROUP BY ALL),
m AS (SELECT doc_id, level, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, level) AS r FROM c)
SELECT m.doc_id, m.level, coalesce(min(c.level) FILTER (c.level <> m.level), -1) AS alternate FROM m JOIN c USING (doc_id) WHERE r = 1 GROUP BY ALL""")
def label_alternates(spark: SparkSession, sf: str) -> DataFrame:
    return agreement.one_vote_out(_votes(spark, sf), "doc_id").fillna(-1, ["alternate"])


@query(PAIRS + "SELECT t AS was, p AS now, count(*) AS n FROM pairs GROUP BY ALL")
def label_transitions(spark: SparkSession, sf: str) -> DataFrame:
    p = _pairs(spark, sf)
    return agreement.transitions(p.select("event_id", F.col("t").alias("label")), p.select("event_id", F.col("p").alias("label")), "event_id", "label")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 3 + n_chars % 5 ELSE 3 + doc_id % 5 END AS level FROM documents")
def label_overlay(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    old = d.select("doc_id", (3 + F.col("doc_id") % 5).alias("level"))
    new = d.where("doc_id % 4 = 0").select("doc_id", (3 + F.col("n_chars") % 5).alias("level"))
    return agreement.overlay(old, new, id_col="doc_id", label="level")
