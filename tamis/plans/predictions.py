"""Queries on predictions: decoding, metrics with abstention, thresholds, ensembles, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions.labels import ordinal_targets
from tamis.operators import agreement, metrics, resample, selection
from tamis.operators import decode as dc
from tamis.plans.data import PRED, THRESHOLD, decoded_predictions, predictions
from tamis.plans.judges import kappas_sql, rounded
from tamis.plans.registry import query

T = THRESHOLD
K = ["seed"]
A = f"(conf >= {T})"
FIN = PRED + f", fin AS (SELECT seed, event_id, label, CASE WHEN {A} THEN pred ELSE -1 END AS final, pred, conf FROM dec)"


def r(*parts: str) -> str:
    return ", ".join(f"round({p}, 6) AS {n}" for p, n in (x.rsplit(" AS ", 1) for x in parts))


@query(PRED + """, t AS (SELECT seed, event_id, label, pred, argmax, p, surv, conf, list_sort([{'p': -p[1], 'k': 0}, {'p': -p[2], 'k': 1}, {'p': -p[3], 'k': 2}, {'p': -p[4], 'k': 3}, {'p': -p[5], 'k': 4}]) AS o FROM dec),
b AS (SELECT *, o[1].k AS a, o[2].k AS b FROM t), w AS (SELECT *, CASE WHEN abs(a-b)=1 THEN least(a,b) ELSE a END AS lo, CASE WHEN abs(a-b)=1 THEN greatest(a,b) ELSE a END AS hi FROM b)
SELECT seed, event_id, label, pred, argmax, lo, hi, round(conf, 6) AS conf, round(CASE WHEN lo = hi THEN p[lo+1] ELSE p[lo+1] + p[hi+1] END, 6) AS band,
round(least(coalesce(surv[nullif(pred, 0)] - 0.5, 1e9), coalesce(0.5 - surv[pred + 1], 1e9)), 6) AS margin, round(list_min(list_transform(surv, lambda x: abs(x - 0.5))), 6) AS near FROM w""")
def decode_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(decoded_predictions(spark, sf).select("seed", "event_id", "label", "pred", "argmax", "lo", "hi", "conf", "band", "margin", "near"))


@query(PRED + f"""SELECT seed, event_id, CASE WHEN {A} THEN 'level_compatibility' ELSE 'unclear' END AS decision, CASE WHEN {A} THEN pred ELSE -9 END AS level FROM dec""")
def decisions(spark: SparkSession, sf: str) -> DataFrame:
    d = decoded_predictions(spark, sf).withColumn("x", dc.decision(F.col("pred"), F.col("conf"), T))
    return d.select("seed", "event_id", "x.decision", F.coalesce("x.level", F.lit(-9)).alias("level"))


@query(PRED + "SELECT seed, count(*) FILTER (surv[1] > 0.6) AS over1, count(*) FILTER ((surv[1] > 0.6)::INT + (surv[2] > 0.5)::INT + (surv[3] > 0.4)::INT + (surv[4] > 0.3)::INT = label) AS hits, count(*) AS n FROM dec GROUP BY seed")
def own_cuts(spark: SparkSession, sf: str) -> DataFrame:
    cuts = F.array(*map(F.lit, (0.6, 0.5, 0.4, 0.3)))
    d = decoded_predictions(spark, sf).withColumn("own", dc.thresholded_level(F.col("surv"), cuts))
    return d.groupBy("seed").agg(F.count_if(F.get("surv", F.lit(0)) > 0.6).alias("over1"), F.count_if(F.col("own") == F.col("label")).alias("hits"), F.count("*").alias("n"))


@query(PRED + f"""SELECT seed, count(*) AS n, count(*) FILTER {A.join(['(WHERE ', ')'])} AS n_covered, {r(f'avg({A}::INT) AS coverage', f'avg((pred = label)::INT) FILTER (WHERE {A}) AS accuracy_covered', f'avg(abs(pred - label)) FILTER (WHERE {A}) AS mae_covered',
f'count(*) FILTER (WHERE {A} AND pred < label) / count(*) FILTER (WHERE {A}) AS under_covered', f'count(*) FILTER (WHERE {A} AND pred < label) / count(*) AS under_all',
f'count(*) FILTER (WHERE {A} AND pred < label) / count(*) FILTER (WHERE pred < label) AS detector_fnr', 'avg(-ln(greatest(probs[label + 1], 1e-12))) AS nll')} FROM dec GROUP BY seed""")
def gate_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.gate_metrics(decoded_predictions(spark, sf), K, T, "probs"))


CLASSES = FIN + """, cc AS (SELECT seed, c, sum(s) AS support, sum(q) AS predicted, sum(h) AS hits FROM (
SELECT seed, label AS c, 1 AS s, 0 AS q, (label = final)::INT AS h FROM fin UNION ALL SELECT seed, final, 0, 1, 0 FROM fin) GROUP BY ALL),
f1 AS (SELECT seed, avg(2 * hits / (support + predicted)) FILTER (support > 0) AS macro_f1, sum(2 * hits / (support + predicted)) / 6 AS macro_f1_abstention_as_class FROM cc GROUP BY seed)"""


@query(CLASSES + f"SELECT seed, {r('macro_f1 AS macro_f1', 'macro_f1_abstention_as_class AS macro_f1_abstention_as_class')} FROM f1")
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.macro_f1(decoded_predictions(spark, sf), K, T))


def _edges(bins: int) -> str:
    return f"len(list_filter([{', '.join(repr(k * (1.0 / bins)) + '::DOUBLE' for k in range(1, bins))}], lambda e: conf >= e))"


@query(PRED + f""", g AS (SELECT DISTINCT seed, b.bin FROM dec, (SELECT unnest(range(10)) AS bin) b), c AS (SELECT seed, {_edges(10)} AS bin, count(*) AS n, avg(conf) AS mc, avg((pred = label)::INT) AS acc FROM dec GROUP BY ALL)
SELECT g.seed, g.bin, coalesce(n, 0) AS n, {r('coalesce(mc, -1) AS mean_conf', 'coalesce(acc, -1) AS accuracy', 'coalesce(acc - mc, -1) AS gap')} FROM g LEFT JOIN c USING (seed, bin)""")
def reliability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.reliability(decoded_predictions(spark, sf), K)).fillna(-1.0)


def _ece(bins: int) -> str:
    return f"SELECT seed, {bins} AS bins, sum(n) AS n, round(sum(n * abs(acc - mc)) / sum(n), 6) AS ece FROM (SELECT seed, {_edges(bins)} AS bin, count(*) AS n, avg(conf) AS mc, avg((pred = label)::INT) AS acc FROM dec GROUP BY ALL) GROUP BY seed"


@query(PRED + " UNION ALL ".join(map(_ece, (5, 10, 15, 20))))
def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.calibration_error(decoded_predictions(spark, sf), K))


GRID = "g AS (SELECT DISTINCT seed, l.level FROM dec, (SELECT unnest(range(5)) AS level) l)"


@query(PRED + f""", {GRID}, t AS (SELECT seed, label AS level, count(*) AS support, count(*) FILTER {A.join(['(WHERE ', ')'])} AS cs, count(*) FILTER (pred = label) AS h, count(*) FILTER (WHERE {A} AND pred = label) AS kh FROM dec GROUP BY ALL),
q AS (SELECT seed, pred AS level, count(*) AS emitted FROM dec WHERE {A} GROUP BY ALL)
SELECT g.seed, g.level, coalesce(support, 0) AS support, coalesce(cs, 0) AS covered_support, coalesce(emitted, 0) AS emitted, {r('coalesce(h / support, -1) AS recall_pre_gate', 'coalesce(kh / support, -1) AS recall_post_gate', 'coalesce(kh / nullif(cs, 0), -1) AS recall_covered')}
FROM g LEFT JOIN t USING (seed, level) LEFT JOIN q USING (seed, level)""")
def level_recall(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.level_recall(decoded_predictions(spark, sf), K, T)).fillna(-1.0)


@query(FIN + """, g AS (SELECT DISTINCT seed, a.t, b.p FROM fin, (SELECT unnest(range(-1, 5)) AS t) a, (SELECT unnest(range(-1, 5)) AS p) b), c AS (SELECT seed, label AS t, final AS p, count(*) AS n FROM fin GROUP BY ALL),
f AS (SELECT g.seed, g.t, g.p, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (seed, t, p)) SELECT seed, t, p, n, coalesce(round(n / nullif(sum(n) OVER (PARTITION BY seed, t), 0), 6), -1) AS row_share FROM f""")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.confusion(decoded_predictions(spark, sf), K, T)).fillna(-1.0)


@query(PRED + "SELECT seed, count(*) FILTER (pred = label) AS exact, count(*) FILTER (abs(pred - label) = 1) AS one_off, count(*) FILTER (abs(pred - label) = 2) AS two_off, count(*) FILTER (abs(pred - label) >= 3) AS more_off FROM dec GROUP BY seed")
def adjacent_errors(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.gaps(decoded_predictions(spark, sf), K)


@query(PRED + """SELECT seed, coalesce(label, -1) AS level, count(*) AS n, count(*) FILTER (e > 0) AS over, count(*) FILTER (e < 0) AS under, count(*) FILTER (e = 0) AS exact, round(avg(e), 6) AS mean, median(e) AS median, round(avg(abs(e)), 6) AS mae
FROM (SELECT seed, label, (pred - label)::DOUBLE AS e FROM dec) GROUP BY GROUPING SETS ((seed), (seed, label))""")
def signed_errors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.signed_errors(decoded_predictions(spark, sf), K)).fillna(-1, ["level"])


@query(PRED + ", g AS (SELECT DISTINCT seed, x.error FROM dec, (SELECT unnest(range(-4, 5)) AS error) x), c AS (SELECT seed, pred - label AS error, count(*) AS n FROM dec GROUP BY ALL) SELECT seed, error, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (seed, error)")
def error_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.error_histogram(decoded_predictions(spark, sf), K)


AXES = PRED + """, ax AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'web' WHEN event_id % 3 = 1 THEN 'lab' ELSE 'crowd' END AS provider, event_id % 4 AS kitchen FROM dec),
long AS (SELECT 'provider' AS axis, provider AS value, pred, label FROM ax UNION ALL SELECT 'kitchen', kitchen::VARCHAR, pred, label FROM ax UNION ALL SELECT 'label', label::VARCHAR, pred, label FROM ax),
axt AS (SELECT axis, value, count(*) AS n, count(*) FILTER (pred <> label) AS errors, avg((pred <> label)::INT) AS error_rate, avg(abs(pred - label)) AS mae, avg((pred < label)::INT) AS under_rate FROM long GROUP BY ALL)
"""


def _axes(spark: SparkSession, sf: str) -> DataFrame:
    d = decoded_predictions(spark, sf)
    provider = F.when(F.col("event_id") % 3 == 0, "web").when(F.col("event_id") % 3 == 1, "lab").otherwise("crowd")
    named = d.select("pred", "label", provider.alias("provider"), (F.col("event_id") % 4).alias("kitchen"))
    return metrics.axis_errors(named.withColumn("true_level", F.col("label")).select("pred", F.col("true_level"), "provider", "kitchen", "label"), ["provider", "kitchen", "true_level"])


@query(AXES + "SELECT CASE WHEN axis = 'label' THEN 'true_level' ELSE axis END AS axis, value, n, errors, round(error_rate, 6) AS error_rate, round(mae, 6) AS mae, round(under_rate, 6) AS under_rate FROM axt")
def axis_errors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_axes(spark, sf))


@query(AXES + """, w AS (SELECT axis, arg_max({'v': value, 'n': n, 'e': errors}, {'r': error_rate, 'n': n, 'v': value}) AS w, sum(n) AS an, sum(errors) AS ae FROM axt GROUP BY axis)
SELECT CASE WHEN axis = 'label' THEN 'true_level' ELSE axis END AS axis, w.v AS value, w.e AS errors, w.n - w.e AS rights, ae - w.e AS rest_errors, an - w.n - ae + w.e AS rest_rights FROM w""")
def worst_groups(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.worst_group(_axes(spark, sf))


@query(PRED + f""", j AS (SELECT a.event_id, {A.replace('conf', 'a.conf')} AND a.pred = a.label AS ra, {A.replace('conf', 'b.conf')} AND b.pred = b.label AS rb FROM dec a JOIN dec b ON a.event_id = b.event_id WHERE a.seed = 0 AND b.seed = 1),
c AS (SELECT count(*) AS n, count(*) FILTER (ra AND NOT rb) AS only_a, count(*) FILTER (rb AND NOT ra) AS only_b FROM j),
k AS (SELECT c.*, unnest(range(0, least(only_a, only_b) + 1)) AS k FROM c)
SELECT n, only_a, only_b, round(least(1.0, 2 * sum(exp(lgamma(only_a + only_b + 1) - lgamma(k + 1) - lgamma(only_a + only_b - k + 1) + (only_a + only_b) * ln(0.5)))), 6) AS p_value FROM k GROUP BY n, only_a, only_b""")
def mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    d = decoded_predictions(spark, sf).select("seed", "event_id", "label", "pred", "conf")
    return rounded(metrics.mcnemar(d.where("seed = 0"), d.where("seed = 1"), "event_id", T))


@query(PRED + """, m AS (SELECT event_id, label, avg(probs[1]) AS p1, avg(probs[2]) AS p2, avg(probs[3]) AS p3, avg(probs[4]) AS p4, avg(probs[5]) AS p5 FROM pred0 GROUP BY ALL),
s AS (SELECT *, p1+p2+p3+p4+p5 AS z FROM m) SELECT event_id, label, ((1-p1/z > 0.5)::INT + (1-(p1/z+p2/z) > 0.5)::INT + (1-(p1/z+p2/z+p3/z) > 0.5)::INT + (1-(p1/z+p2/z+p3/z+p4/z) > 0.5)::INT) AS pred, round(p1, 6) AS p1, round(p5, 6) AS p5 FROM s""")
def ensemble(spark: SparkSession, sf: str) -> DataFrame:
    e = dc.decoded(metrics.ensemble(predictions(spark, sf)))
    return rounded(e.select("event_id", "label", "pred", F.get("probs", F.lit(0)).alias("p1"), F.get("probs", F.lit(4)).alias("p5")))


@query(PRED + """, v AS (SELECT event_id, label, pred, count(*) AS v, sum(conf) AS c FROM dec GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY v DESC, pred) AS rn, max(pred) OVER (PARTITION BY event_id) - min(pred) OVER (PARTITION BY event_id) AS spread FROM v)
SELECT event_id, label, pred AS vote, v AS voters, round(c / v, 6) AS vote_conf, spread FROM b WHERE rn = 1""")
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.majority_vote(decoded_predictions(spark, sf)))


@query(PRED + """SELECT a.seed AS run_a, b.seed AS run_b, count(*) AS n, round(avg((a.pred = b.pred)::INT), 6) AS agree, round(avg(list_cosine_similarity(a.probs, b.probs)), 6) AS cosine FROM dec a JOIN dec b ON a.event_id = b.event_id AND a.seed < b.seed GROUP BY ALL""")
def run_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.run_pairs(decoded_predictions(spark, sf)))


@query(PRED + """, x AS (SELECT label, unnest([0,1,2,3]) AS cut, unnest(surv) AS s FROM dec) SELECT label, cut, count(*) AS n, round(quantile_cont(s, 0.1), 6) AS p10, round(quantile_cont(s, 0.5), 6) AS p50, round(quantile_cont(s, 0.9), 6) AS p90, round(avg((s > 0.5)::INT), 6) AS over_half FROM x GROUP BY ALL""")
def survival_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.survival_stats(decoded_predictions(spark, sf)))


@query(PRED + "SELECT seed, count(*) AS n, " + r("avg(conf) AS mean", "stddev_samp(conf) AS sd", "min(conf) AS min", *(f"quantile_cont(conf, {q / 100}) AS q{q:02d}" for q in (5, 25, 50, 75, 95)), "max(conf) AS max", "quantile_cont(conf, 0.75) - quantile_cont(conf, 0.25) AS iqr") + " FROM dec GROUP BY seed")
def confidence_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.quantile_summary(decoded_predictions(spark, sf), K, "conf"))


@query(PRED + ", c AS (SELECT round_even(conf, 2) AS value, count(*) AS n FROM dec GROUP BY ALL) SELECT value, n, round(n / sum(n) OVER (), 6) AS share FROM c")
def confidence_values(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.value_counts(decoded_predictions(spark, sf), "conf", 2))


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), w AS (SELECT label, n, 0.001 / (1 - pow(0.999, n)) AS raw FROM c) SELECT label, n, round(raw / avg(raw) OVER (), 6) AS weight FROM w")
def balance_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.balance_weights(spark.read.parquet(f"{sf}/embeddings.parquet"), "label", 0.999))


@query(PRED + ", c AS (SELECT label, count(*) AS m FROM dec GROUP BY label) SELECT l AS level, sum(m) AS n, round(sum(CASE WHEN l = label THEN m ELSE 0 END) / sum(m), 6) AS accuracy, round(sum(abs(l - label) * m) / sum(m), 6) AS mae, round(sum(CASE WHEN l < label THEN m ELSE 0 END) / sum(m), 6) AS under_rate FROM c, (SELECT unnest(range(5)) AS l) GROUP BY l")
def constant_baselines(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.constant_baselines(predictions(spark, sf)))


@query(PRED + ", c AS (SELECT label, count(*)::DOUBLE AS m FROM dec GROUP BY label) SELECT sum(m)::BIGINT AS n, round(sum(m*m) / (sum(m)*sum(m)), 6) AS prior_accuracy FROM c")
def prior_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.prior_baseline(predictions(spark, sf)))


@query(PRED + f", s AS (SELECT seed, count(*) AS n_emitted, list(DISTINCT pred) AS seen FROM dec WHERE {A} GROUP BY seed) SELECT seed, n_emitted, len(seen) AS n_levels, array_to_string(list_filter(range(5), lambda x: NOT list_contains(seen, x::INT)), '|') AS never FROM s")
def emitted_census(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.emitted_census(decoded_predictions(spark, sf), K, T)


@query(PRED + f", kx AS (SELECT seed, label AS t, pred AS p FROM dec WHERE {A})" + kappas_sql("kx", "seed"))
def covered_kappa(spark: SparkSession, sf: str) -> DataFrame:
    d = decoded_predictions(spark, sf).where(metrics.accepted(T))
    return rounded(agreement.coefficients(d.select("seed", F.col("label").alias("t"), F.col("pred").alias("p")), K))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    d = decoded_predictions(spark, sf)
    kappa = agreement.coefficients(d.where(metrics.accepted(T)).select("seed", F.col("label").alias("t"), F.col("pred").alias("p")), K)
    return metrics.gate_metrics(d, K, T).join(metrics.macro_f1(d, K, T), "seed").join(kappa.select("seed", F.col("quadratic_compressed").alias("kappa_covered")), "seed")


GATES = CLASSES + f""", q AS (SELECT seed, avg({A}::INT) AS coverage, count(*) FILTER (WHERE {A} AND pred < label) / count(*) FILTER (WHERE {A}) AS under, count(*) FILTER (WHERE {A} AND pred < label) / count(*) FILTER (WHERE pred < label) AS fnr,
1 - avg((label-pred)*(label-pred)) FILTER (WHERE {A}) / (avg(label*label) FILTER (WHERE {A}) + avg(pred*pred) FILTER (WHERE {A}) - 2 * avg(label) FILTER (WHERE {A}) * avg(pred) FILTER (WHERE {A})) AS kap FROM dec GROUP BY seed),
gt AS (SELECT seed, kap >= 0.7 AS gate_kappa, macro_f1 >= 0.75 AS gate_f1, under <= 0.05 AS gate_under, 1 - coverage <= 0.3 AS gate_abstention, macro_f1, coverage, fnr FROM q JOIN f1 USING (seed))
"""


@query(GATES + "SELECT seed, gate_kappa, gate_f1, gate_under, gate_abstention, gate_f1 AND gate_under AND gate_abstention AS gate_release, gate_kappa AND gate_f1 AND gate_under AND gate_abstention AS gate_all FROM gt")
def gate_table(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.gate_table(_runs(spark, sf), K)


@query(GATES + "SELECT seed, row_number() OVER (ORDER BY gate_f1::INT + gate_under::INT + gate_abstention::INT DESC, round(macro_f1, 9) DESC, round(coverage, 9) DESC, round(fnr, 9), seed) AS rank FROM gt")
def run_ranking(spark: SparkSession, sf: str) -> DataFrame:
    runs = _runs(spark, sf)
    gates = metrics.gate_table(runs, K)
    met = F.col("gate_f1").cast("int") + F.col("gate_under").cast("int") + F.col("gate_abstention").cast("int")
    return selection.rank_runs(runs.join(gates.select("seed", met.alias("gates_met")), "seed")).select("seed", "rank")


CAND = PRED + """, cu AS (SELECT seed, threshold, n_total, count(*) FILTER (ok) AS n, count(*) FILTER (ok AND pred < label) AS under, count(*) FILTER (ok AND pred <> label) AS errors FROM (
SELECT t.seed, t.threshold, d.pred, d.label, d.conf >= t.threshold AS ok, count(*) OVER (PARTITION BY t.seed, t.threshold) AS n_total FROM (SELECT DISTINCT seed, conf AS threshold FROM dec UNION SELECT DISTINCT seed, 0.0 FROM dec) t JOIN dec d USING (seed)) GROUP BY ALL)
"""


def _select_sql(order: str) -> str:
    return CAND + f""", s AS (SELECT *, n / n_total AS coverage, under / n AS ur, errors / n AS er, under / n <= 0.2 AS feasible FROM cu WHERE n / n_total >= 0.7),
k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY feasible DESC, CASE WHEN feasible THEN -coverage ELSE ur END, CASE WHEN feasible THEN {order} ELSE er END, -coverage, threshold) AS rn FROM s)
SELECT seed, round(threshold, 6) AS threshold, round(coverage, 6) AS coverage, round(ur, 6) AS under_rate, feasible FROM k WHERE rn = 1"""


@query(_select_sql("-threshold"))
def threshold_high(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.select_threshold(decoded_predictions(spark, sf), K, target=0.2))


@query(_select_sql("threshold"))
def threshold_low(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.select_threshold(decoded_predictions(spark, sf), K, target=0.2, tie="low"))


@query(CAND + """, k AS (SELECT cu.*, t.target, greatest(1, least(n_total, ceil(t.target * n_total - 1e-9))) AS need FROM cu, (VALUES (0.7), (0.8), (0.9)) t(target) WHERE threshold > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY seed, target ORDER BY threshold DESC) AS rn FROM k WHERE n >= need) SELECT seed, target::DOUBLE AS target, round(threshold, 6) AS threshold, n AS n_accepted, round(n / n_total, 6) AS coverage FROM b WHERE rn = 1""")
def coverage_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.coverage_thresholds(decoded_predictions(spark, sf), K))


@query(CAND + ", b AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(abs(n / n_total - 0.8), 12), threshold DESC) AS rn FROM cu WHERE threshold > 0) SELECT seed, round(threshold, 6) AS threshold, round(n / n_total, 6) AS coverage FROM b WHERE rn = 1")
def matched_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.matched_threshold(decoded_predictions(spark, sf), K, 0.8))


@query(CAND + "SELECT seed, round(threshold, 6) AS threshold, n, round(n / n_total, 6) AS coverage FROM cu WHERE threshold > 0")
def coverage_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.coverage_ladder(decoded_predictions(spark, sf), K))


@query(PRED + """, t AS (SELECT k / 20 AS threshold FROM (SELECT unnest(range(21)) AS k)), s AS (SELECT seed, threshold, count(*) AS n_total, count(*) FILTER (conf >= threshold) AS n, count(*) FILTER (conf >= threshold AND pred = label) AS ri, count(*) FILTER (conf >= threshold AND pred < label) AS un FROM dec, t GROUP BY ALL)
SELECT seed, round(threshold, 6) AS threshold, n_total, n, round(n / n_total, 6) AS coverage, coalesce(round(ri / nullif(n, 0), 6), -1) AS accuracy, coalesce(round(un / nullif(n, 0), 6), -1) AS under_rate, round(un / n_total, 6) AS under_all FROM s""")
def threshold_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.threshold_grid(decoded_predictions(spark, sf), K)).fillna(-1.0)


@query(PRED + ", t AS (SELECT seed, unnest(list_distinct(quantile_cont(conf, [" + ", ".join(repr(k / 50) for k in range(51)) + "]))) AS threshold FROM dec GROUP BY seed), s AS (SELECT t.seed, t.threshold, count(*) AS nt, count(*) FILTER (conf >= threshold) AS n, count(*) FILTER (conf >= threshold AND pred <> label) AS w FROM t JOIN dec d ON t.seed = d.seed GROUP BY ALL) SELECT seed, round(threshold, 6) AS threshold, n, round(n / nt, 6) AS coverage, coalesce(round(w / nullif(n, 0), 6), -1) AS risk FROM s")
def risk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.risk_coverage(decoded_predictions(spark, sf), K)).fillna(-1.0)


@query(PRED + "SELECT seed, event_id, row_number() OVER w AS nth, round(sum((pred <> label)::INT) OVER w / row_number() OVER w, 6) AS risk FROM dec WINDOW w AS (PARTITION BY seed ORDER BY conf DESC, event_id ROWS UNBOUNDED PRECEDING)")
def cumulative_risk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.cumulative_risk(decoded_predictions(spark, sf), K))


@query(PRED + ", c AS (SELECT seed, row_number() OVER w AS nth, sum((pred <> label)::INT) OVER w / row_number() OVER w AS risk FROM dec WINDOW w AS (PARTITION BY seed ORDER BY conf DESC, event_id ROWS UNBOUNDED PRECEDING)), s AS (SELECT seed, (risk + lag(risk) OVER (PARTITION BY seed ORDER BY nth)) / 2 AS step FROM c) SELECT seed, count(*) AS n, round(sum(step) / count(*), 6) AS augrc FROM s GROUP BY seed")
def risk_area(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.risk_area(decoded_predictions(spark, sf), K))


@query(PRED + ", v AS (SELECT DISTINCT seed, conf FROM dec), g AS (SELECT seed, conf, lead(conf) OVER (PARTITION BY seed ORDER BY conf) - conf AS gap FROM v), b AS (SELECT *, count(*) OVER (PARTITION BY seed) AS n_values, row_number() OVER (PARTITION BY seed ORDER BY gap DESC NULLS LAST, conf) AS rn FROM g) SELECT seed, n_values, round(conf, 6) AS lower, round(gap, 6) AS gap FROM b WHERE rn = 1")
def widest_gap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.widest_gap(decoded_predictions(spark, sf), K))


@query(PRED + f"SELECT seed, t::DOUBLE AS tolerance, count(*) FILTER (abs(conf - {T}) <= t) AS n FROM dec, (VALUES (0.005), (0.01), (0.02), (0.05)) x(t) GROUP BY ALL")
def near_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return selection.near_boundary(decoded_predictions(spark, sf), K, T)


@query(PRED + ", k AS (SELECT seed, event_id, row_number() OVER (PARTITION BY seed ORDER BY conf DESC, event_id) AS rank FROM dec) SELECT seed, event_id, rank FROM k WHERE rank BETWEEN 10 AND 45")
def rank_window(spark: SparkSession, sf: str) -> DataFrame:
    return selection.rank_window(decoded_predictions(spark, sf), K, 10, 45).select("seed", "event_id", "rank")


@query(PRED + """, g AS (SELECT k, 0.25 * exp(ln(16.0) * k / 80) AS t FROM (SELECT unnest(range(81)) AS k)), q AS (SELECT seed, k, t, avg(-ln(greatest(pow(greatest(probs[label+1], 1e-12), 1/t) / list_sum(list_transform(probs, lambda x: pow(greatest(x, 1e-12), 1/t))), 1e-12))) AS nll FROM dec, g GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(nll, 12), k) AS rn FROM q) SELECT seed, round(t, 6) AS temperature, round(nll, 6) AS nll FROM b WHERE rn = 1""")
def temperature(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.fit_temperature(decoded_predictions(spark, sf), K))


def _cut_sql(k: int) -> str:
    return f"""SELECT {k + 1} AS cut, round(lo + (hi - lo) * (pos - floor(pos)), 6) AS threshold FROM (SELECT min(pos) AS pos, max(s) FILTER (rn - 1 = floor(pos)) AS lo, max(s) FILTER (rn - 1 = least(ceil(pos), n - 1)) AS hi FROM (
SELECT surv[{k + 1}] AS s, row_number() OVER (ORDER BY surv[{k + 1}]) AS rn, count(*) OVER () AS n, (count(*) OVER () - 1) * (1 - avg((label > {k})::INT) OVER ()) AS pos FROM dec WHERE seed = 0))"""


@query(PRED + " UNION ALL ".join(map(_cut_sql, range(4))))
def marginal_cuts(spark: SparkSession, sf: str) -> DataFrame:
    cuts = selection.marginal_cuts(decoded_predictions(spark, sf).where("seed = 0"))
    return rounded(spark.createDataFrame([(k + 1, float(c)) for k, c in enumerate(cuts)], "cut int, threshold double"))


def _over(k: int) -> str:
    return f"len(list_filter([{', '.join(f'{g + 1}/21::DOUBLE' for g in range(20))}], lambda g: surv[{k + 1}] > g)) AS o{k}"


@query(PRED + f""", c AS (SELECT label, {', '.join(map(_over, range(4)))}, count(*) AS n FROM dec GROUP BY ALL), g AS (SELECT id, (id // 8000) % 20 AS a, (id // 400) % 20 AS b, (id // 20) % 20 AS c, id % 20 AS d FROM (SELECT unnest(range(160000)) AS id)),
h AS (SELECT id, a, b, g.c AS c2, d, label, sum(CASE WHEN (o0 > a)::INT + (o1 > b)::INT + (o2 > g.c)::INT + (o3 > d)::INT = label THEN n ELSE 0 END) / sum(n) AS rc FROM g, c GROUP BY ALL), m AS (SELECT id, a, b, c2, d, round(avg(rc), 12) AS mr FROM h GROUP BY ALL)
SELECT round((a + 1)/21, 6) AS cut1, round((b + 1)/21, 6) AS cut2, round((c2 + 1)/21, 6) AS cut3, round((d + 1)/21, 6) AS cut4, round(mr, 6) AS macro_recall FROM m ORDER BY mr DESC, id LIMIT 1""")
def recall_grid_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(selection.recall_grid_cuts(decoded_predictions(spark, sf)))


@query("SELECT unnest([0, 1, 2])::INT AS seed, round(tanh(0.8 / 4), 6) AS ceiling")
def interior_ceiling(spark: SparkSession, sf: str) -> DataFrame:
    d = predictions(spark, sf).withColumn("logits", F.transform(F.array(*map(F.lit, (1.5, 0.7, -0.2, -1.4))), lambda x: x + F.col("event_id") % 7 * 0.25))
    return rounded(dc.interior_ceiling(d, K))


@query("SELECT vec_id AS event_id, array_to_string(list_transform([0,1,2,3], lambda k: CASE WHEN label % 5 > k THEN '0.95' ELSE '0.05' END), '|') AS targets FROM embeddings")
def smoothed_targets(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/embeddings.parquet")
    t = F.transform(ordinal_targets(F.col("label") % 5, smoothing=0.1), lambda x: F.round(x, 6).cast("string"))
    return d.select(F.col("vec_id").alias("event_id"), F.array_join(t, "|").alias("targets"))


DRAWS = PRED + """, nb AS (SELECT event_id, label, pred, conf, row_number() OVER (PARTITION BY label ORDER BY event_id) - 1 AS nth, count(*) OVER (PARTITION BY label) AS size FROM dec WHERE seed = 0),
dr AS (SELECT a.replicate, n.label, (('0x' || substr(md5('2026:' || a.replicate || ':' || n.label || ':' || n.nth), 1, 8))::BIGINT % n.size) AS nth FROM nb n, (SELECT unnest(range(1, 21)) AS replicate) a),
bs AS (SELECT dr.replicate, nb.* FROM dr JOIN nb ON dr.label = nb.label AND dr.nth = nb.nth)
"""


def _draws(spark: SparkSession, sf: str) -> DataFrame:
    return resample.stratified_draws(decoded_predictions(spark, sf).where("seed = 0").select("event_id", "label", "pred", "argmax", "conf"), "label", "event_id", 20)


@query(DRAWS + f""", m AS (SELECT replicate, avg({A}::INT) AS coverage, avg((pred = label)::INT) AS accuracy, avg(abs(pred - label)) AS mae FROM bs GROUP BY replicate)
SELECT {', '.join(f'round(quantile_cont({v}, {q}), 6) AS {v}_{n}' for v in ('coverage', 'accuracy', 'mae') for q, n in ((0.025, 'lo'), (0.975, 'hi')))} FROM m""")
def bootstrap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    per = _draws(spark, sf).groupBy("replicate").agg(F.avg(metrics.accepted(T).cast("double")).alias("coverage"), F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"), F.avg(F.abs(F.col("pred") - F.col("label")).cast("double")).alias("mae"))
    return rounded(resample.interval(per, [], ["coverage", "accuracy", "mae"]))


@query(DRAWS + ", aa AS (SELECT event_id, argmax FROM dec WHERE seed = 0), m AS (SELECT replicate, avg((bs.pred = bs.label)::INT - (aa.argmax = bs.label)::INT) AS g FROM bs JOIN aa USING (event_id) GROUP BY replicate) SELECT count(*) AS replicates, round(avg(g), 6) AS mean_gain, round(avg((g > 0)::INT), 6) AS p_positive FROM m")
def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    gain = (F.col("pred") == F.col("label")).cast("double") - (F.col("argmax") == F.col("label")).cast("double")
    return rounded(resample.paired_gain(_draws(spark, sf), gain))
