"""Queries over cells, calibration metrics, tests and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import calibrate as K
from ..operators import cells as C
from ..operators import checks, inference, ngram, peers, ranks
from ..operators.quantiles import with_quantiles
from ..sources import io
from ..sources.io import table
from .base import FEATURES, NGRAMS_SQL, audit, calib, doc_tok, matrix, query, sql

CELL = C.CELL


def phi(z: str) -> str:
    return S.PHI_SQL.format(z=f"({z})")


def t_tail_sql(t: str, df: str, steps: int = 2000) -> str:
    """The two-sided tail of Student's t by Simpson's rule on its density, which is not how Spark's side gets it."""
    f = f"pow(1 + pow(abs({t}) * i / {steps}.0::DOUBLE, 2) / ({df}), -(({df}) + 1) / 2.0::DOUBLE)"
    area = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f})) * abs({t}) / {steps * 3}.0::DOUBLE"
    return f"greatest(0, 1 - 2 * exp(lgamma((({df}) + 1) / 2.0::DOUBLE) - lgamma(({df}) / 2.0::DOUBLE)) / sqrt(({df}) * pi()) * {area})"


def long_calib(spark, sf):
    return K.long_form(calib(spark, sf), FEATURES, ["variant", "split", "row_id", "label"])


@query(sql("SELECT n, docs, tokens, ngrams FROM (SELECT count(*) AS docs, sum(len(t))::BIGINT AS tokens FROM doc_tok), (SELECT 8::BIGINT AS n, count(DISTINCT g) AS ngrams FROM (SELECT unnest(" + NGRAMS_SQL.format(t="t", n=8) + ") AS g FROM doc_tok) UNION ALL SELECT 13, count(DISTINCT g) FROM (SELECT unnest(" + NGRAMS_SQL.format(t="t", n=13) + ") AS g FROM doc_tok))", "doc_tok"))
def index_manifest(spark, sf):
    return ngram.index_manifest(doc_tok(spark, sf), [8, 13])


@query()
def growing_manifest(spark, sf):
    """A corpus that grows by half: the stored sketches of both halves, merged; n-grams to within 5 %."""
    docs = doc_tok(spark, sf).select(F.col("lang").alias("corpus"), "t", (F.col("doc_id") % 2).alias("half"))
    parts = [io.stored(ngram.sketch_manifest(docs.where(F.col("half") == h), [8, 13])) for h in (0, 1)]
    return ngram.manifest_counts(ngram.merge_manifests(*parts))


@query(sql("SELECT model, benchmark, count(*) AS n_items, avg(p) AS p_mean, quantile_cont(p, 0.9) AS p_p90, avg((p > 0.5)::INT) AS high_risk_rate, avg(loss) AS mean_loss, avg(delta) AS mean_delta FROM audit GROUP BY 1, 2", "audit", rnd="p_mean p_p90 high_risk_rate mean_loss mean_delta"))
def audit_summary(spark, sf):
    return C.audit_summary(audit(spark, sf))


COV = "count(*) AS n_total, count(*) FILTER (p < 0.1) AS n_clean, count(*) FILTER (p >= 0.1 AND p <= 0.5) AS n_mid, count(*) FILTER (p > 0.5) AS n_contam, count(*) FILTER (p > 0.5) / count(*) AS frac_contam"


@query(sql(f"SELECT model, benchmark, {COV} FROM audit GROUP BY 1, 2", "audit", rnd="frac_contam"))
def coverage(spark, sf):
    return C.coverage(audit(spark, sf), CELL)


@query(sql("SELECT benchmark, rate, CASE WHEN rate < 0.05 THEN 'clean' WHEN rate < 0.25 THEN 'salvageable' ELSE 'compromised' END AS verdict FROM (SELECT benchmark, avg((p * CASE benchmark WHEN '1-URGENT' THEN 0.52 WHEN '5-LOW' THEN 0.6 ELSE 1 END > 0.5)::INT) AS rate FROM audit GROUP BY 1)", "audit", rnd="rate"))
def salvageability(spark, sf):
    scale = F.when(F.col("benchmark") == "1-URGENT", 0.52).when(F.col("benchmark") == "5-LOW", 0.6).otherwise(1.0)
    return C.salvageability(audit(spark, sf).withColumn("p", F.col("p") * scale))


@query(sql("SELECT model, benchmark, avg(p) AS p_mean, quantile_cont(p, 0.9) AS p_p90, avg((p > 0.5)::INT) AS high_risk_rate FROM audit GROUP BY 1, 2 ORDER BY round(avg(p), 9) DESC, 1, 2 LIMIT 10", "audit", rnd="p_mean p_p90 high_risk_rate"))
def top_contaminated(spark, sf):
    s = C.audit_summary(audit(spark, sf)).select(*CELL, "p_mean", "p_p90", "high_risk_rate")
    return s.orderBy(F.round("p_mean", 9).desc(), *CELL).limit(10)


@query(sql("SELECT * FROM cells", "cells", rnd="clean_acc contam_acc gap"))
def cell_gap(spark, sf):
    return C.gap(audit(spark, sf), CELL)


@query(sql("SELECT model, benchmark, count(*) AS full_n, avg(correct) AS full_acc, avg(correct) FILTER (p < 0.1) AS clean_acc, avg(correct) FILTER (p > 0.5) AS contam_acc, avg(correct) - avg(correct) FILTER (p < 0.1) AS drop_clean, avg(correct) FILTER (p < 0.1) - avg(correct) FILTER (p > 0.5) AS clean_minus_contam FROM audit GROUP BY 1, 2", "audit", rnd="full_acc clean_acc contam_acc drop_clean clean_minus_contam"))
def subset_accuracy(spark, sf):
    return C.subset_accuracy(audit(spark, sf), CELL)


BENCHES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(sql("SELECT model, " + ", ".join(f"avg(p) FILTER (benchmark = '{b}') AS \"{b[0]}\"" for b in BENCHES) + ", avg(p) AS overall FROM audit GROUP BY 1", "audit", rnd='"1" "2" "3" "4" "5" overall'))
def heatmap_pivot(spark, sf):
    a = audit(spark, sf).withColumn("b", F.left("benchmark", F.lit(1)))
    return a.groupBy("model").pivot("b", [b[0] for b in BENCHES]).agg(F.avg("p")).join(a.groupBy("model").agg(F.avg("p").alias("overall")), "model")


@query(sql("SELECT model, avg(a.gap) AS v2_gap, count(a.gap) AS v2_n, avg(b.gap) AS v1_gap, count(b.gap) AS v1_n FROM cells a FULL JOIN cells1 b USING (model, benchmark) GROUP BY 1", "cells", "cells1", rnd="v2_gap v1_gap"))
def inversion_pivot(spark, sf):
    a = audit(spark, sf)
    both = C.gap(a, CELL).withColumn("e", F.lit("v2")).unionByName(C.gap(a.withColumn("p", F.col("p1")), CELL).withColumn("e", F.lit("v1")))
    return both.groupBy("model").pivot("e", ["v2", "v1"]).agg(F.avg("gap").alias("gap"), F.count("gap").alias("n"))


AUC_SQL = "SELECT variant, detector, greatest(a, 1 - a) AS auc, (CASE WHEN a < 0.5 THEN -1 ELSE 1 END)::BIGINT AS sign FROM (SELECT variant, detector, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS a FROM (SELECT *, rank() OVER (PARTITION BY variant, detector ORDER BY score) + (count(*) OVER (PARTITION BY variant, detector, score) - 1) / 2 AS r FROM long_calib WHERE score IS NOT NULL) GROUP BY 1, 2)"


@query(sql(AUC_SQL, "long_calib", rnd="auc"))
def roc_auc(spark, sf):
    return ranks.roc_auc(long_calib(spark, sf), "score", "label", ["variant", "detector"])


CURVE = "SELECT variant, detector, score, sum(a) OVER w AS tp, sum(b) OVER w AS fp, sum(a) OVER v AS p, sum(b) OVER v AS q FROM (SELECT variant, detector, score, count(*) FILTER (label = 1) AS a, count(*) FILTER (label = 0) AS b FROM long_calib WHERE score IS NOT NULL GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY variant, detector ORDER BY score DESC ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY variant, detector)"


@query(sql(f"SELECT variant, detector, score AS threshold, f AS best_f1 FROM (SELECT *, round(2 * tp / (tp + fp + p), 12) AS f, row_number() OVER (PARTITION BY variant, detector ORDER BY round(2 * tp / (tp + fp + p), 12) DESC, score) AS r FROM ({CURVE})) WHERE r = 1", "long_calib", rnd="threshold best_f1"))
def best_threshold(spark, sf):
    return ranks.best_threshold(long_calib(spark, sf), "score", "label", ["variant", "detector"])


@query(sql("SELECT variant, detector, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM (SELECT variant, detector, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (NOT score >= 0.5 AND label = 1) AS fn FROM long_calib GROUP BY 1, 2)", "long_calib", rnd="precision recall f1"))
def prf_at_threshold(spark, sf):
    return ranks.prf(long_calib(spark, sf), "score", "label", F.lit(0.5), ["variant", "detector"])


@query(sql(f"SELECT variant, detector, max(2 * tp / (tp + fp + p)) AS max_f1 FROM ({CURVE}) GROUP BY 1, 2", "long_calib", rnd="max_f1"))
def pr_curve_max_f1(spark, sf):
    return K.max_f1(long_calib(spark, sf), "score", "label", ["variant", "detector"])


@query(sql(f"SELECT variant, detector, score, fp / nullif(q, 0) AS fpr, tp / nullif(p, 0) AS tpr FROM ({CURVE})", "long_calib", rnd="score fpr tpr"))
def roc_curve(spark, sf):
    c = ranks.curve(long_calib(spark, sf), "score", "label", ["variant", "detector"])
    return c.select("variant", "detector", "score", F.try_divide("fp", "q").alias("fpr"), F.try_divide("tp", "p").alias("tpr"))


PRED = "SELECT variant, row_id, 'chars' AS detector, (n_chars > 1500)::INT AS pred FROM calib UNION ALL SELECT variant, row_id, 'words', (n_words > 250)::INT FROM calib UNION ALL SELECT variant, row_id, 'toxic', toxic FROM calib"


def _preds(spark, sf):
    c = calib(spark, sf)
    flags = c.select("variant", "row_id", (F.col("n_chars") > 1500).cast("int").alias("chars"), (F.col("n_words") > 250).cast("int").alias("words"), F.col("toxic").cast("int").alias("toxic"))
    return flags.unpivot(["variant", "row_id"], ["chars", "words", "toxic"], "detector", "pred")


@query(sql(f"SELECT variant, a, b, n, agreement, (agreement - pe) / nullif(1 - pe, 0) AS kappa FROM (SELECT x.variant, x.detector AS a, y.detector AS b, count(*) AS n, avg((x.pred = y.pred)::INT) AS agreement, avg(x.pred) * avg(y.pred) + (1 - avg(x.pred)) * (1 - avg(y.pred)) AS pe FROM ({PRED}) x JOIN ({PRED}) y ON x.row_id = y.row_id AND x.detector < y.detector GROUP BY 1, 2, 3)", "calib", rnd="agreement kappa"))
def cohen_kappa(spark, sf):
    return ranks.kappa(_preds(spark, sf), ["variant"])


JUDGES = "SELECT variant, row_id, toxic, (1 + least(4, floor(distinct_ratio * 5)) >= 4)::INT AS one, (1 + least(4, floor(n_words / 100)) >= 4)::INT AS two FROM calib"


@query(sql(f"""SELECT variant, a, b, n, agreement, (agreement - pe) / nullif(1 - pe, 0) AS kappa, tpr, fpr FROM (SELECT variant, a, b, count(*) AS n, avg((x = y)::INT) AS agreement, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) AS pe, avg(x) FILTER (y = 1) AS tpr, avg(x) FILTER (y = 0) AS fpr
    FROM (SELECT variant, 'one' AS a, 'detector' AS b, one AS x, toxic AS y FROM j UNION ALL SELECT variant, 'two', 'detector', two, toxic FROM j UNION ALL SELECT variant, 'one', 'two', one, two FROM j) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2, 3)""", "calib", rnd="agreement kappa tpr fpr").replace(") SELECT * REPLACE", f"), j AS ({JUDGES}) SELECT * REPLACE", 1))
def judge_agreement(spark, sf):
    """Two judges, whose ratings of 4 and 5 say yes, each against the detector and against each other."""
    rating = lambda x: (1 + F.least(F.lit(4), F.floor(x)) >= 4).cast("int")
    c = calib(spark, sf).select("variant", rating(F.col("distinct_ratio") * 5).alias("one"), rating(F.col("n_words") / 100).alias("two"), F.col("toxic").cast("int").alias("detector"))
    return ranks.agreement(c, ["variant"], [("one", "detector"), ("two", "detector"), ("one", "two")])


PER_METHOD = """WITH r AS (SELECT *, rank() OVER (PARTITION BY detector ORDER BY score) + (count(*) OVER (PARTITION BY detector, score) - 1) / 2 AS r FROM long_calib WHERE split = 'dev' AND score IS NOT NULL),
    a AS (SELECT detector, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS auc FROM r GROUP BY 1),
    t AS (SELECT l.detector, split, label, score * CASE WHEN auc < 0.5 THEN -1 ELSE 1 END AS score FROM long_calib l JOIN a USING (detector)),
    g AS (SELECT detector, score, count(*) FILTER (label = 1) AS p, count(*) AS n FROM t WHERE split = 'dev' AND score IS NOT NULL GROUP BY 1, 2),
    f AS (SELECT detector, score, round(2 * sum(p) OVER w / (sum(n) OVER w + sum(p) OVER (PARTITION BY detector)), 12) AS f FROM g WINDOW w AS (PARTITION BY detector ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT detector, score AS threshold, f AS best_f1 FROM f QUALIFY row_number() OVER (PARTITION BY detector ORDER BY f DESC, score) = 1),
    m AS (SELECT detector, split, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp, count(*) FILTER (NOT score >= threshold AND label = 1) AS fn FROM t JOIN c USING (detector) GROUP BY 1, 2),
    q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM m)
    SELECT detector, (CASE WHEN auc < 0.5 THEN -1 ELSE 1 END)::BIGINT AS sign, greatest(auc, 1 - auc) AS dev_auc, threshold, best_f1, d.precision AS dev_precision, d.recall AS dev_recall, d.f1 AS dev_f1, v.precision AS val_precision, v.recall AS val_recall, v.f1 AS val_f1
    FROM a JOIN c USING (detector) JOIN (SELECT * FROM q WHERE split = 'dev') d USING (detector) LEFT JOIN (SELECT * FROM q WHERE split = 'val') v USING (detector)"""


@query(sql(PER_METHOD, "long_calib", rnd="dev_auc threshold best_f1 dev_precision dev_recall dev_f1 val_precision val_recall val_f1"))
def per_method_calibration(spark, sf):
    return K.per_method(long_calib(spark, sf), "label")


@query(sql("SELECT benchmark, item_id, max(p) AS p_max, avg(p) AS p_mean, count(*) FILTER (p > 0.5) AS n_flag, count(*) FILTER (p < 0.1) AS n_clear FROM (SELECT benchmark, item_id % 500 AS item_id, p FROM audit) GROUP BY 1, 2", "audit", rnd="p_max p_mean"))
def union_flags(spark, sf):
    return C.union_flags(audit(spark, sf).withColumn("item_id", F.col("item_id") % 500))


@query(sql("""SELECT way, benchmark, count(*) FILTER (side = 'clean') AS n_clean, count(*) FILTER (side = 'contam') AS n_contam, avg(correct) FILTER (side = 'clean') AS clean_acc, avg(correct) FILTER (side = 'contam') AS contam_acc, avg(correct) FILTER (side = 'clean') - avg(correct) FILTER (side = 'contam') AS gap
    FROM (SELECT benchmark, correct, 'any' AS way, CASE WHEN n_flag > 0 THEN 'contam' ELSE 'clean' END AS side FROM j UNION ALL SELECT benchmark, correct, 'majority', CASE WHEN n_flag >= 3 THEN 'contam' ELSE 'clean' END FROM j UNION ALL SELECT benchmark, correct, 'max_score', CASE WHEN p_max > 0.5 THEN 'contam' WHEN p_max < 0.1 THEN 'clean' END FROM j)
    GROUP BY 1, 2 HAVING count(*) FILTER (side = 'clean') > 0 AND count(*) FILTER (side = 'contam') > 0""", "audit", rnd="clean_acc contam_acc gap").replace(") SELECT * REPLACE", "), j AS (SELECT a.benchmark, a.correct, n_flag, p_max FROM (SELECT benchmark, item_id % 3000 AS item_id, correct FROM audit) a JOIN (SELECT benchmark, item_id % 3000 AS item_id, count(*) FILTER (p > 0.5) AS n_flag, max(p) AS p_max FROM audit GROUP BY 1, 2) USING (benchmark, item_id)) SELECT * REPLACE", 1))
def transfer_slice(spark, sf):
    a = audit(spark, sf).withColumn("item_id", F.col("item_id") % 3000)
    return C.transfer_slice(C.union_flags(a), a.select("benchmark", "item_id", "correct"))


IV = f"""SELECT model, count(*) AS n_strata, sum(g / v) / sum(1 / v) AS iv_gap, sqrt(1 / sum(1 / v)) AS iv_se, sum(g / v) / sum(1 / v) / sqrt(1 / sum(1 / v)) AS z FROM (SELECT model, stratum, avg(correct) FILTER (p < 0.1) - avg(correct) FILTER (p > 0.5) AS g,
    var_samp(correct) FILTER (p < 0.1) / count(*) FILTER (p < 0.1) + var_samp(correct) FILTER (p > 0.5) / count(*) FILTER (p > 0.5) AS v FROM {{t}} GROUP BY 1, 2 HAVING count(*) >= 10 AND count(*) FILTER (p < 0.1) >= 5 AND count(*) FILTER (p > 0.5) >= 5) WHERE v > 0 GROUP BY 1"""


@query(sql(f"SELECT *, 2 * (1 - {phi('abs(z)')}) AS p_two, {phi('z')} AS p_one FROM ({IV.format(t='audit')})", "audit", rnd="iv_gap iv_se z p_two p_one"))
def iv_weighted_gap(spark, sf):
    return C.iv_weighted_gap(audit(spark, sf), ["model"], "stratum")


def _se_cells(spark, sf):
    v = lambda c: F.greatest(F.col(c) * (1 - F.col(c)), F.lit(0.01))
    return C.gap(audit(spark, sf), CELL).withColumn("se", F.sqrt(v("clean_acc") / F.col("n_clean") + v("contam_acc") / F.col("n_contam")))


META = """WITH d AS (SELECT benchmark, gap AS y, 1 / (se * se) AS w FROM ({t})), a AS (SELECT benchmark, count(*) AS k, sum(w) AS sw, sum(w * y * y) - sum(w * y) ** 2 / sum(w) AS q, sum(w * w) AS sww FROM d GROUP BY 1),
    b AS (SELECT *, greatest(0, (q - (k - 1)) / (sw - sww / sw)) AS tau2, greatest(0, (q - (k - 1)) / q) AS i2 FROM a), r AS (SELECT benchmark, k, q, tau2, i2, sum(1 / (1 / w + tau2)) AS su, sum(y / (1 / w + tau2)) AS suy, sum(y * y / (1 / w + tau2)) AS suyy FROM d JOIN b USING (benchmark) GROUP BY 1, 2, 3, 4, 5)"""


@query(sql(f"SELECT benchmark, k, q, i2, tau2, re_mean, re_se, z, 2 * (1 - {phi('abs(z)')}) AS p FROM (" + META.format(t="SELECT * FROM se_cells") + " SELECT *, suy / su AS re_mean, sqrt(1 / su) AS re_se, suy / su / sqrt(1 / su) AS z FROM r)", "se_cells", rnd="q i2 tau2 re_mean re_se z p"))
def meta_analysis(spark, sf):
    return inference.meta_analysis(_se_cells(spark, sf), "gap", "se", ["benchmark"]).select("benchmark", "k", "q", "i2", "tau2", "re_mean", "re_se", "z", "p")


@query(sql("SELECT benchmark, hk_se, suy / su / hk_se AS t, df FROM (" + META.format(t="SELECT * FROM se_cells") + " SELECT *, sqrt((suyy - suy * suy / su) / ((k - 1) * su)) AS hk_se, k - 1 AS df FROM r)", "se_cells", rnd="hk_se t"))
def hartung_knapp(spark, sf):
    return inference.meta_analysis(_se_cells(spark, sf), "gap", "se", ["benchmark"]).select("benchmark", "hk_se", "t", "df")


@query(sql("SELECT model, benchmark, m AS mde, abs(gap) >= m AS reached FROM (SELECT *, CASE WHEN clean_acc > 0 AND clean_acc < 1 THEN (1.6448536 + 0.8416212) * sqrt(clean_acc * (1 - clean_acc) * (1 / n_clean + 1 / n_contam)) END AS m FROM cells)", "cells", rnd="mde"))
def mde_power(spark, sf):
    c = C.gap(audit(spark, sf), CELL).withColumn("mde", S.mde(F.col("clean_acc"), F.col("n_clean"), F.col("n_contam")))
    return c.select(*CELL, "mde", (F.abs("gap") >= F.col("mde")).alias("reached"))


@query(sql(f"SELECT *, {t_tail_sql('t', 'n - 1')} AS p FROM (SELECT benchmark, count(*) AS n, avg(gap) AS mean, stddev_samp(gap) AS sd, avg(gap) / (stddev_samp(gap) / sqrt(count(*))) AS t FROM cells GROUP BY 1)", "cells", rnd="mean sd t p"))
def ttest_1samp(spark, sf):
    return inference.ttest_1samp(C.gap(audit(spark, sf), CELL), "gap", ["benchmark"])


@query(sql(f"SELECT *, {t_tail_sql('t', 'df')} AS p FROM (SELECT benchmark, (m1 - m0) / sqrt(v0 / n0 + v1 / n1) AS t, (v0 / n0 + v1 / n1) ** 2 / ((v0 / n0) ** 2 / (n0 - 1) + (v1 / n1) ** 2 / (n1 - 1)) AS df FROM (SELECT benchmark, count(*) FILTER (g = 0) AS n0, count(*) FILTER (g = 1) AS n1, avg(loss) FILTER (g = 0) AS m0, avg(loss) FILTER (g = 1) AS m1, var_samp(loss) FILTER (g = 0) AS v0, var_samp(loss) FILTER (g = 1) AS v1 FROM (SELECT *, (p > 0.5)::INT AS g FROM audit) GROUP BY 1))", "audit", rnd="t df p"))
def ttest_welch(spark, sf):
    a = audit(spark, sf).withColumn("g", (F.col("p") > 0.5).cast("int"))
    return inference.ttest_welch(a, "loss", "g", ["benchmark"])


@query(sql("SELECT item_id, 1 - 2 * atan(abs(delta) * 3) / pi() AS p1, 1 - abs(delta) * 3 / sqrt(2 + 9 * delta * delta) AS p2 FROM audit", "audit", rnd="p1 p2"))
def student_t_tail(spark, sf):
    """Against the closed forms for one and two degrees of freedom."""
    t = F.col("delta") * 3
    return audit(spark, sf).select("item_id", S.student_t_tail(t, F.lit(1.0)).alias("p1"), S.student_t_tail(t, F.lit(2.0)).alias("p2"))


RANKED = "SELECT *, rank() OVER (PARTITION BY {k} ORDER BY {v}) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2 AS r, count(*) OVER (PARTITION BY {k}, {v}) AS t FROM ({s})"


@query(sql(f"SELECT benchmark, u, z, 1 - {phi('z')} AS p FROM (SELECT benchmark, s - a * (a + 1) / 2 AS u, (s - a * (a + 1) / 2 - a * b / 2 - 0.5) / sqrt(a * b / 12.0::DOUBLE * (a + b + 1 - tie / ((a + b) * (a + b - 1)))) AS z FROM (SELECT benchmark, sum(r) FILTER (correct = 1) AS s, count(*) FILTER (correct = 1) AS a, count(*) FILTER (correct = 0) AS b, sum((t * t - 1)::DOUBLE) AS tie FROM ({RANKED.format(k='benchmark', v='loss', s='SELECT * FROM audit')}) GROUP BY 1))", "audit", rnd="u z p"))
def mann_whitney(spark, sf):
    return ranks.mann_whitney(audit(spark, sf), "loss", "correct", ["benchmark"])


@query(sql(f"SELECT benchmark, n, w_plus, z, 1 - {phi('z')} AS p FROM (SELECT benchmark, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, (coalesce(sum(r) FILTER (d > 0), 0) - count(*) * (count(*) + 1) / 4) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24.0::DOUBLE - sum((t * t - 1)::DOUBLE) / 48) AS z FROM ({RANKED.format(k='benchmark', v='abs(d)', s='SELECT benchmark, round(p - p1, 9) AS d FROM audit WHERE round(p - p1, 9) <> 0')}) GROUP BY 1)", "audit", rnd="w_plus z p"))
def wilcoxon_signed(spark, sf):
    return ranks.wilcoxon(audit(spark, sf).withColumn("d", F.round(F.col("p") - F.col("p1"), 9)), "d", ["benchmark"])


@query(sql("SELECT benchmark, wins, n, (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) FROM range(wins, n + 1) t(k)) AS p FROM (SELECT benchmark, count(*) FILTER (gap > 0) AS wins, count(*) FILTER (gap <> 0) AS n FROM cells GROUP BY 1)", "cells", rnd="p"))
def sign_test(spark, sf):
    """How many of a benchmark's gaps are positive, and the tail of so many heads."""
    g = C.gap(audit(spark, sf), CELL).groupBy("benchmark").agg(F.count_if(F.col("gap") > 0).alias("wins"), F.count_if(F.col("gap") != 0).alias("n"))
    return g.select("benchmark", "wins", "n", S.binomial_tail(F.col("wins"), F.col("n")).alias("p"))


@query(sql(f"SELECT benchmark, count(*) AS n, corr(p, loss) AS pearson, corr(r, r2) AS spearman FROM (SELECT *, rank() OVER (PARTITION BY benchmark ORDER BY loss) + (count(*) OVER (PARTITION BY benchmark, loss) - 1) / 2 AS r2 FROM ({RANKED.format(k='benchmark', v='p', s='SELECT * FROM audit')})) GROUP BY 1", "audit", rnd="pearson spearman"))
def correlations(spark, sf):
    return ranks.spearman(audit(spark, sf), "p", "loss", ["benchmark"])


@query(sql("SELECT m1, m2, count(*) AS n, corr(a.r, b.r) AS rho FROM x a JOIN x b USING (item_id) GROUP BY 1, 2", "matrix", rnd="rho").replace("a JOIN x b USING (item_id)", "a JOIN (SELECT item_id, model AS m2, r FROM x) b ON a.item_id = b.item_id AND a.model < m2").replace("SELECT m1, m2", "SELECT a.model AS m1, m2").replace(") SELECT * REPLACE", "), x AS (SELECT model, item_id, rank() OVER (PARTITION BY model ORDER BY loss) + (count(*) OVER (PARTITION BY model, loss) - 1) / 2 AS r FROM matrix WHERE item_id IN (SELECT item_id FROM matrix GROUP BY 1 HAVING count(*) = 10)) SELECT * REPLACE", 1))
def spearman_matrix(spark, sf):
    return peers.spearman_matrix(matrix(spark, sf))


@query(sql("SELECT count(rho) AS pairs, avg(rho) AS mean, median(rho) AS median, avg((rho > 0)::INT) AS positive, avg((rho > 0.3)::INT) AS above_03 FROM (SELECT a.model AS m1, m2, corr(a.r, b.r) AS rho FROM x a JOIN (SELECT item_id, model AS m2, r FROM x) b ON a.item_id = b.item_id AND a.model < m2 GROUP BY 1, 2)", "matrix", rnd="mean median positive above_03").replace(") SELECT * REPLACE", "), x AS (SELECT model, item_id, rank() OVER (PARTITION BY model ORDER BY loss) + (count(*) OVER (PARTITION BY model, loss) - 1) / 2 AS r FROM matrix WHERE item_id IN (SELECT item_id FROM matrix GROUP BY 1 HAVING count(*) = 10)) SELECT * REPLACE", 1))
def spearman_summary(spark, sf):
    """Mean and median of all pairs' correlations, and how many are above 0 and 0.3."""
    return peers.spearman_summary(peers.spearman_matrix(matrix(spark, sf)))


@query(sql("SELECT model, n, slope, intercept, r, se, 1.959964 * se AS band FROM (SELECT model, count(*) AS n, regr_slope(loss, p) AS slope, regr_intercept(loss, p) AS intercept, corr(p, loss) AS r, sqrt(greatest(0, (1 - corr(p, loss) ** 2) * regr_syy(loss, p) / (count(*) - 2)) / regr_sxx(loss, p)) AS se FROM audit GROUP BY 1)", "audit", rnd="slope intercept r se band"))
def linear_fit(spark, sf):
    return inference.linear_fit(audit(spark, sf), "p", "loss", ["model"])


OLS = "x AS (SELECT model, gap, 0 AS v FROM cells UNION ALL SELECT model, gap, 1 FROM cells1), s AS (SELECT count(*) AS n, sum(v) AS n1, avg(gap) FILTER (v = 0) AS m0, avg(gap) FILTER (v = 1) AS m1 FROM x), c AS (SELECT model, sum(CASE WHEN v = 1 THEN (gap - m1) / n1 ELSE -(gap - m0) / (n - n1) END) AS i FROM x, s GROUP BY 1), e AS (SELECT count(*) AS g, sum(i * i) AS v FROM c)"


@query(sql("SELECT n, g AS clusters, m0 AS intercept, m1 - m0 AS slope, sqrt(v * g / (g - 1) * (n - 1) / (n - 2)) AS se, (m1 - m0) / sqrt(v * g / (g - 1) * (n - 1) / (n - 2)) AS t FROM s, e WHERE n > 0", "cells", "cells1", rnd="intercept slope se t").replace(") SELECT * REPLACE", f"), {OLS} SELECT * REPLACE", 1))
def ols_cluster(spark, sf):
    a = audit(spark, sf)
    both = C.gap(a, CELL).withColumn("v", F.lit(0)).unionByName(C.gap(a.withColumn("p", F.col("p1")), CELL).withColumn("v", F.lit(1)))
    return inference.ols_cluster(both, "gap", "v", "model")


@query(sql(f"SELECT count(*) AS n_cells, count(*) FILTER (p < 0.05 AND gap < 0) AS n_right, count(*) FILTER (p < 0.05 AND gap > 0) AS n_wrong FROM (SELECT gap, 2 * (1 - {phi('abs(gap / se)')}) AS p FROM se_cells)", "se_cells"))
def sig_counts(spark, sf):
    c = _se_cells(spark, sf).withColumn("p", 2 * (1 - S.phi(F.abs(F.col("gap") / F.col("se")))))
    return c.agg(F.count(F.lit(1)).alias("n_cells"), F.count_if((F.col("p") < 0.05) & (F.col("gap") < 0)).alias("n_right"), F.count_if((F.col("p") < 0.05) & (F.col("gap") > 0)).alias("n_wrong"))


@query(sql("SELECT benchmark, count(*) FILTER (d < -0.01) AS win, count(*) FILTER (abs(d) <= 0.01) AS tie, count(*) FILTER (d > 0.01) AS loss FROM (SELECT a.benchmark, round(a.gap - b.gap, 9) AS d FROM cells a JOIN cells1 b USING (model, benchmark)) GROUP BY 1", "cells", "cells1"))
def win_tie_loss(spark, sf):
    a = audit(spark, sf)
    both = C.gap(a, CELL).join(C.gap(a.withColumn("p", F.col("p1")), CELL).select(*CELL, F.col("gap").alias("g1")), CELL).withColumn("d", F.round(F.col("gap") - F.col("g1"), 9))
    return both.groupBy("benchmark").agg(F.count_if(F.col("d") < -0.01).alias("win"), F.count_if(F.abs("d") <= 0.01).alias("tie"), F.count_if(F.col("d") > 0.01).alias("loss"))


@query(sql(f"SELECT model, count(*) FILTER (abs(z) > 1.0) AS n_strong, count(*) AS n_strat FROM ({IV.format(t='audit')} UNION ALL {IV.format(t='(SELECT model, correct, p, item_id % 3 AS stratum FROM audit)')}) GROUP BY 1", "audit"))
def robust_cells(spark, sf):
    """Under how many stratifiers a model's gap stands out."""
    a = audit(spark, sf)
    both = C.iv_weighted_gap(a, ["model"], "stratum").unionByName(C.iv_weighted_gap(a.withColumn("stratum", F.col("item_id") % 3), ["model"], "stratum"))
    return both.groupBy("model").agg(F.count_if(F.abs("z") > 1.0).alias("n_strong"), F.count(F.lit(1)).alias("n_strat"))


@query(sql("SELECT variant, detector, avg(score) FILTER (label = 1) AS pos, avg(score) FILTER (label = 0) AS neg FROM long_calib GROUP BY 1, 2", "long_calib", rnd="pos neg"))
def score_group_means(spark, sf):
    on = lambda v: F.avg(F.when(F.col("label") == v, F.col("score")))
    return long_calib(spark, sf).groupBy("variant", "detector").agg(on(1).alias("pos"), on(0).alias("neg"))


@query(sql(f"SELECT model, corr(r, correct) AS rho, (corr(r, correct) > 0)::BIGINT AS positive FROM ({RANKED.format(k='model', v='loss', s='SELECT * FROM matrix')}) GROUP BY 1", "matrix", rnd="rho"))
def correctness_rho(spark, sf):
    """Spearman with a 0/1 outcome: ranks of two values are an affine image of them."""
    s = ranks.spearman(matrix(spark, sf), "loss", "correct", ["model"])
    return s.select("model", F.col("spearman").alias("rho"), (F.col("spearman") > 0).cast("int").alias("positive"))


@query(sql("SELECT model, benchmark, avg(correct) AS raw, avg(correct) FILTER (p <= 0.5) - avg(correct) AS fixed, avg(correct) FILTER (p <= q) - avg(correct) AS matched FROM (SELECT *, quantile_cont(p, 0.7) OVER (PARTITION BY model, benchmark) AS q FROM audit) GROUP BY 1, 2", "audit", rnd="raw fixed matched"))
def accuracy_correction(spark, sf):
    a = audit(spark, sf)
    acc = lambda cond: F.avg(F.when(cond, F.col("correct")))
    raw = F.avg("correct")
    return with_quantiles(a, "p", CELL, {"q": 0.7}).groupBy(*CELL).agg(raw.alias("raw"), (acc(F.col("p") <= 0.5) - raw).alias("fixed"), (acc(F.col("p") <= F.col("q")) - raw).alias("matched"))


@query(sql("SELECT model, date '2023-01-01' + (substr(model, 2)::INT * 30) AS released, avg(p) AS p_mean FROM audit GROUP BY 1", "audit", rnd="p_mean"))
def release_trend(spark, sf):
    dates = audit(spark, sf).select("model").distinct().withColumn("released", F.date_add(F.lit("2023-01-01").cast("date"), F.substring("model", 2, 9).cast("int") * 30))
    return audit(spark, sf).groupBy("model").agg(F.avg("p").alias("p_mean")).join(dates, "model").select("model", "released", "p_mean")


@query(sql("SELECT benchmark, avg(gap) AS mean, median(gap) AS median, count(*) FILTER (gap < 0) AS n_negative FROM cells GROUP BY 1", "cells", rnd="mean median"))
def gap_summary(spark, sf):
    return C.gap(audit(spark, sf), CELL).groupBy("benchmark").agg(F.avg("gap").alias("mean"), F.median("gap").alias("median"), F.count_if(F.col("gap") < 0).alias("n_negative"))


@query(sql("SELECT model, benchmark, avg(gap) AS mean_gap, count(*) AS n FROM cells GROUP BY ROLLUP (model, benchmark) HAVING count(*) > 0", "cells", rnd="mean_gap"))
def group_rollup(spark, sf):
    return C.gap(audit(spark, sf), CELL).rollup(*CELL).agg(F.avg("gap").alias("mean_gap"), F.count(F.lit(1)).alias("n"))


@query(sql("SELECT item_id, avg(loss) AS mean_loss, count(*) FILTER (loss > 2.55) AS n_flag FROM matrix GROUP BY 1 ORDER BY round(avg(loss), 9) DESC, 1 LIMIT 10", "matrix", rnd="mean_loss"))
def top_flagged_items(spark, sf):
    g = matrix(spark, sf).groupBy("item_id").agg(F.avg("loss").alias("mean_loss"), F.count_if(F.col("loss") > 2.55).alias("n_flag"))
    return g.orderBy(F.round("mean_loss", 9).desc(), "item_id").limit(10)


@query(sql("SELECT model, benchmark, gap FROM cells WHERE gap < 0 ORDER BY round(gap, 9), model, benchmark LIMIT 10", "cells", rnd="gap"))
def worst_cells(spark, sf):
    return C.gap(audit(spark, sf), CELL).where("gap < 0").orderBy(F.round("gap", 9), *CELL).limit(10).select(*CELL, "gap")


@query(sql("SELECT benchmark, item_id FROM (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY item_id) AS r FROM audit) WHERE r <= 100", "audit"))
def first_n_per_group(spark, sf):
    from pyspark.sql import Window as W

    return audit(spark, sf).withColumn("r", F.row_number().over(W.partitionBy("benchmark").orderBy("item_id"))).where("r <= 100").select("benchmark", "item_id")


@query(sql("SELECT model, benchmark, gap FROM cells ORDER BY gap, model, benchmark", "cells", rnd="gap"))
def sorted_report(spark, sf):
    return C.gap(audit(spark, sf), CELL).select(*CELL, "gap").orderBy("gap", *CELL)


@query("SELECT 'documents' AS dataset, count(*) AS n_rows, abs(count(*) - 1000) <= 50 AS count_ok, 'missing_one' AS missing FROM documents")
def check_dataset(spark, sf):
    return checks.check_dataset(table(spark, sf, "documents"), "documents", 1000, ["doc_id", "text", "missing_one"])


@query(sql("SELECT metric, CASE WHEN metric = 'none' THEN 'missing' WHEN abs(got - v) / greatest(abs(v), 1e-12) > tol THEN 'off' ELSE 'ok' END AS status FROM (SELECT unnest(['rows', 'mean_p', 'none']) AS metric, unnest([15000, 0.9, 1.0]) AS v, unnest([0.01, 0.05, 0.1]) AS tol) LEFT JOIN (SELECT 'rows' AS metric, count(*)::DOUBLE AS got FROM audit UNION ALL SELECT 'mean_p', avg(p) FROM audit) USING (metric)", "audit"))
def check_metrics(spark, sf):
    a = audit(spark, sf).agg(F.count(F.lit(1)).cast("double").alias("rows"), F.avg("p").alias("mean_p"))
    actual = a.unpivot([], ["rows", "mean_p"], "metric", "value")
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(v).alias("value"), F.lit(t).alias("tolerance")) for m, v, t in (("rows", 15000.0, 0.01), ("mean_p", 0.9, 0.05), ("none", 1.0, 0.1))])
    return checks.check_metrics(actual, spark.range(1).select(F.inline(rows)))


@query("SELECT doc_id, source FROM documents ORDER BY md5('sample|' || doc_id), doc_id LIMIT 3")
def sample_rows(spark, sf):
    return checks.sample_rows(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
