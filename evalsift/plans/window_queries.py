"""Queries over windows, peers, splits, resampling and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import calibrate as K
from ..operators import cells as C
from ..operators import peers, ranks, resample, shuffle
from ..operators import inference as I
from ..operators.fits import fit_many
from ..operators.prefix import with_rank
from ..operators.quantiles import with_quantiles
from ..sources import io
from ..sources.io import table
from .agg_queries import AUC_SQL, CURVE, IV, _se_cells, long_calib, phi, t_tail_sql
from .base import FEATURES, audit, calib, matrix, models, query, sql
from .join_queries import DELTA, _delta

CELL = C.CELL


@query(sql("SELECT model, item_id, (row_number() OVER (PARTITION BY model ORDER BY loss, item_id) - 1) / greatest(count(*) OVER (PARTITION BY model) - 1, 1) AS difficulty FROM matrix", "matrix", rnd="difficulty"))
def difficulty_quantile(spark, sf):
    return peers.difficulty_quantile(matrix(spark, sf), "loss", ["model"]).select("model", "item_id", "difficulty")


Z = "(loss - avg(loss) OVER (PARTITION BY model)) / (stddev_pop(loss) OVER (PARTITION BY model) + 1e-6)"


@query(sql(f"SELECT model, item_id, {Z} AS z FROM matrix", "matrix", rnd="z"))
def within_z(spark, sf):
    return peers.within_z(matrix(spark, sf), "loss", ["model"]).select("model", "item_id", "z")


ROBUST = "SELECT model, item_id, (x - med) / (1.4826 * mad + 1e-6) AS {o} FROM (SELECT t.*, med FROM ({t}) t JOIN (SELECT item_id, median(x) AS med FROM ({t}) {w} GROUP BY 1) USING (item_id)) JOIN (SELECT item_id, median(abs(x - med)) AS mad FROM ({t}) t JOIN (SELECT item_id, median(x) AS med FROM ({t}) {w} GROUP BY 1) USING (item_id) {w} GROUP BY 1) USING (item_id)"


@query(sql(ROBUST.format(t="SELECT model, item_id, loss AS x FROM matrix", w="", o="peer_z"), "matrix", rnd="peer_z"))
def peer_z(spark, sf):
    return peers.robust_z(matrix(spark, sf), "loss", ["item_id"]).select("model", "item_id", "peer_z")


@query(sql(ROBUST.format(t=f"SELECT model, item_id, {Z} AS x FROM matrix", w="", o="peer_z"), "matrix", rnd="peer_z"))
def double_z(spark, sf):
    return peers.robust_z(peers.within_z(matrix(spark, sf), "loss", ["model"]), "z", ["item_id"]).select("model", "item_id", "peer_z")


@query(sql(ROBUST.format(t=f"SELECT model, item_id, {Z} AS x FROM matrix", w="WHERE model NOT IN ('m7', 'm8')", o="peer_z"), "matrix", rnd="peer_z"))
def peer_z_pool(spark, sf):
    z = peers.within_z(matrix(spark, sf), "loss", ["model"])
    return peers.robust_z(z, "z", ["item_id"], pool="model not in ('m7', 'm8')").select("model", "item_id", "peer_z")


PV = f"SELECT model, benchmark, 2 * (1 - {phi('abs(gap / se)')}) AS p FROM se_cells"
RN = f"(SELECT *, round(p, 12) AS q, row_number() OVER (PARTITION BY benchmark ORDER BY round(p, 12), model) AS i, count(*) OVER (PARTITION BY benchmark) AS m FROM ({PV}))"


def _pvalues(spark, sf):
    from ..functions.stats import phi as tail

    c = _se_cells(spark, sf)
    return c.select(*CELL, F.round(2 * (1 - tail(F.abs(F.col("gap") / F.col("se")))), 12).alias("p"))


@query(sql(f"SELECT model, benchmark, p, least(min(q * m / i) OVER (PARTITION BY benchmark ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS bh FROM {RN}", "se_cells", rnd="p bh"))
def bh_fdr(spark, sf):
    return ranks.adjusted(_pvalues(spark, sf), "p", ["benchmark"], "model").select(*CELL, "p", "bh")


@query(sql(f"SELECT model, benchmark, least(max(q * (m - i + 1)) OVER (PARTITION BY benchmark ORDER BY i), 1) AS holm FROM {RN}", "se_cells", rnd="holm"))
def holm(spark, sf):
    return ranks.adjusted(_pvalues(spark, sf), "p", ["benchmark"], "model").select(*CELL, "holm")


@query(sql(f"SELECT model, benchmark, least(q * m, 1) AS bonferroni FROM {RN}", "se_cells", rnd="bonferroni"))
def bonferroni(spark, sf):
    return ranks.adjusted(_pvalues(spark, sf), "p", ["benchmark"], "model").select(*CELL, "bonferroni")


def _versions(spark, sf):
    a = audit(spark, sf)
    return C.gap(a, CELL).select(*CELL, "gap", F.lit(1).alias("v")).unionByName(C.gap(a.withColumn("p", F.col("p1")), CELL).select(*CELL, "gap", F.lit(0).alias("v")))


LOO = """SELECT {k}, s - a * (a + 1) / 2 AS u FROM (SELECT {k}, sum(r) FILTER (v = 1) AS s, count(*) FILTER (v = 1) AS a FROM (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY g) + (count(*) OVER (PARTITION BY {k}, g) - 1) / 2 AS r FROM
    (SELECT d.{k}, x.g, x.v FROM (SELECT DISTINCT {e} AS {k} FROM v) d JOIN (SELECT {e} AS e, round(gap, 12) AS g, v FROM v) x ON x.e <> d.{k})) GROUP BY 1)"""
VERS = "v AS (SELECT model, benchmark, gap, 1 AS v FROM cells UNION ALL SELECT model, benchmark, gap, 0 FROM cells1)"


def _loo(spark, sf, key, name):
    """U over all versions but those of one cell, or model, at a time."""
    return ranks.u_without(_versions(spark, sf).withColumns({name: key, "g": F.round("gap", 12)}), "g", "v", name)


@query(sql(LOO.format(k="cell", e="model || '|' || benchmark"), "cells", "cells1", rnd="u").replace(") SELECT * REPLACE", f"), {VERS} SELECT * REPLACE", 1))
def loo_cell(spark, sf):
    return _loo(spark, sf, F.concat_ws("|", "model", "benchmark"), "cell")


@query(sql(LOO.format(k="dropped", e="model"), "cells", "cells1", rnd="u").replace(") SELECT * REPLACE", f"), {VERS} SELECT * REPLACE", 1))
def loo_model(spark, sf):
    return _loo(spark, sf, F.col("model"), "dropped")


@query(sql("SELECT model, item_id, rank() OVER (PARTITION BY model ORDER BY loss) + (count(*) OVER (PARTITION BY model, loss) - 1) / 2 AS r FROM matrix", "matrix", rnd="r"))
def avg_rank(spark, sf):
    return with_rank(matrix(spark, sf), "loss", ["model"], "r").select("model", "item_id", "r")


@query(sql("SELECT model, benchmark, gap - avg(gap) OVER (PARTITION BY model) AS residual FROM cells", "cells", rnd="residual"))
def group_residual(spark, sf):
    return C.gap(audit(spark, sf), CELL).select(*CELL, (F.col("gap") - F.avg("gap").over(W.partitionBy("model"))).alias("residual"))


def split_sql(t: str, k: str, score: str, lo: float, hi: float, a: str, b: str) -> str:
    return f"""SELECT {k}, count(*) FILTER (side = 'clean') AS n_clean, count(*) FILTER (side = 'contam') AS n_contam, avg(correct) FILTER (side = 'clean') AS clean_acc, avg(correct) FILTER (side = 'contam') AS contam_acc,
    avg(correct) FILTER (side = 'clean') - avg(correct) FILTER (side = 'contam') AS gap FROM (SELECT *, CASE WHEN {score} <= lo THEN '{a}' WHEN {score} >= hi THEN '{b}' END AS side FROM ({t}) JOIN (SELECT {k}, quantile_cont({score}, {lo}) AS lo, quantile_cont({score}, {hi}) AS hi FROM ({t}) GROUP BY {k}) USING ({k})) GROUP BY {k}"""


GAPS = "clean_acc contam_acc gap"


@query(sql(split_sql("SELECT * FROM audit", "model, benchmark", "p", 0.2, 0.8, "clean", "contam"), "audit", rnd=GAPS))
def quantile_split(spark, sf):
    return C.quantile_split(audit(spark, sf), "p", CELL, 0.2, 0.8)


@query(sql("SELECT model, benchmark, max(l) FILTER (i = f) + (max(l) FILTER (i = least(f + 1, n - 1)) - max(l) FILTER (i = f)) * (max(h) - max(f)) AS threshold, max(rate) AS flag_rate FROM (SELECT *, (n - 1) * (1 - rate) AS h, floor((n - 1) * (1 - rate)) AS f FROM (SELECT model, benchmark, loss AS l, row_number() OVER (PARTITION BY model, benchmark ORDER BY loss, item_id) - 1 AS i, count(*) OVER (PARTITION BY model, benchmark) AS n, avg((p > 0.5)::INT) OVER (PARTITION BY model, benchmark) AS rate FROM audit)) GROUP BY 1, 2", "audit", rnd="threshold flag_rate"))
def rate_matched_split(spark, sf):
    return C.rate_matched_split(audit(spark, sf), "loss", CELL)


@query(sql(f"SELECT lo, hi, model, avg(correct) FILTER (peer_z <= lo) - avg(correct) FILTER (peer_z >= hi) AS diff, count(*) AS n FROM (SELECT z.*, m.correct FROM ({ROBUST.format(t='SELECT model, item_id, loss AS x FROM matrix', w='', o='peer_z')}) z JOIN matrix m USING (model, item_id)), (SELECT unnest([-1.0, -1.5, -2.0]) AS lo, unnest([0.0, 0.0, 0.5]) AS hi) GROUP BY 1, 2, 3", "matrix", rnd="lo hi diff"))
def peer_threshold_gap(spark, sf):
    grid = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a, b in ((-1.0, 0.0), (-1.5, 0.0), (-2.0, 0.5))])))
    z = peers.robust_z(matrix(spark, sf), "loss", ["item_id"]).crossJoin(F.broadcast(grid))  # three settings
    acc = lambda cond: F.avg(F.when(cond, F.col("correct")))
    return z.groupBy("lo", "hi", "model").agg((acc(F.col("peer_z") <= F.col("lo")) - acc(F.col("peer_z") >= F.col("hi"))).alias("diff"), F.count(F.lit(1)).alias("n"))


COMB = "SELECT model, correct, round((loss - avg(loss) OVER (PARTITION BY model)) / (stddev_pop(loss) OVER (PARTITION BY model) + 1e-6) + 0.5 * abs(delta), 9) AS s FROM audit"


@query(sql(split_sql(COMB, "model", "s", 0.2, 0.8, "contam", "clean"), "audit", rnd=GAPS))
def combined_score(spark, sf):
    z = peers.within_z(audit(spark, sf), "loss", ["model"]).withColumn("s", F.round(F.col("z") + 0.5 * F.abs("delta"), 9))
    return C.quantile_split(z, "s", ["model"], 0.2, 0.8, True)


CONF = "SELECT model, correct, delta FROM audit JOIN (SELECT model, quantile_cont(loss, 0.5) AS q FROM audit GROUP BY 1) USING (model) WHERE loss <= q"


@query(sql(split_sql(CONF, "model", "delta", 0.3, 0.7, "contam", "clean"), "audit", rnd=GAPS))
def confident_split(spark, sf):
    a = audit(spark, sf)
    return C.quantile_split(with_quantiles(a, "loss", ["model"], {"q": 0.5}).where(F.col("loss") <= F.col("q")), "delta", ["model"], 0.3, 0.7, True)


@query(sql("SELECT variant, row_id, ((row_number() OVER (PARTITION BY variant ORDER BY md5('fold|' || row_id), row_id) - 1) % 5)::BIGINT AS fold FROM calib", "calib"))
def kfold(spark, sf):
    return resample.kfold(calib(spark, sf), 5, "fold", "row_id", ["variant"]).select("variant", "row_id", "fold")


def _sides(spark, sf):
    a = audit(spark, sf)
    return a.withColumn("side", F.when(F.col("p") < 0.1, "clean").when(F.col("p") > 0.5, "contam")).where("side is not null")


M32 = "('0x' || substr(md5({}), 1, 8))::BIGINT"
SIDES = "s AS (SELECT model, benchmark, item_id, correct, p < 0.1 AS clean FROM audit WHERE p < 0.1 OR p > 0.5)"


HYPER = "(SELECT sum(exp(lgamma(g + 1) - lgamma(x + 1) - lgamma(g - x + 1) + lgamma(t - g + 1) - lgamma(n_clean - x + 1) - lgamma(t - g - n_clean + x + 1) - lgamma(t + 1) + lgamma(n_clean + 1) + lgamma(t - n_clean + 1))) FROM range(greatest(0, n_clean + g - t), k_clean + 1) r(x))"


@query(sql(f"SELECT model, benchmark, {HYPER} AS p_exact FROM (SELECT model, benchmark, count(*) FILTER (p < 0.1) AS n_clean, coalesce(sum(correct) FILTER (p < 0.1), 0)::BIGINT AS k_clean, count(*) AS t, sum(correct)::BIGINT AS g FROM audit WHERE p < 0.1 OR p > 0.5 GROUP BY 1, 2)", "audit", rnd="p_exact"))
def exact_permutation(spark, sf):
    return resample.exact_permutation(resample.by_side(_sides(spark, sf), CELL)).select(*CELL, "p_exact")


def uniform_sql(key: str) -> str:
    """A uniform number from the md5 of a key, as ``resample.uniform`` has it."""
    return f"(({M32.format(key)} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


@query(sql(f"SELECT model, benchmark, avg(({uniform_sql("'1|' || rep || '|' || model || '|' || benchmark")} <= p_exact)::INT) AS p_perm FROM (SELECT model, benchmark, {HYPER} AS p_exact FROM (SELECT model, benchmark, count(*) FILTER (clean) AS n_clean, coalesce(sum(correct) FILTER (clean), 0)::BIGINT AS k_clean, count(*) AS t, sum(correct)::BIGINT AS g FROM s GROUP BY 1, 2) WHERE n_clean > 0 AND n_clean < t), range(5000) r(rep) GROUP BY 1, 2", "audit", rnd="p_perm").replace(") SELECT * REPLACE", f"), {SIDES} SELECT * REPLACE", 1))
def permutation_test(spark, sf):
    return resample.permutation_test(_sides(spark, sf), CELL, 5000)


BINOMIAL = f"""c AS (SELECT model, benchmark, CASE WHEN clean THEN 'clean' ELSE 'contam' END AS side, count(*) AS n, sum(correct)::BIGINT AS k FROM s GROUP BY 1, 2, 3),
    f AS (SELECT model, benchmark, side, x, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(k / n) + (n - x) * ln(1 - k / n))) OVER (PARTITION BY model, benchmark, side ORDER BY x) AS cdf FROM (SELECT *, unnest(range(n + 1)) AS x FROM c WHERE k > 0 AND k < n)),
    u AS (SELECT *, {uniform_sql("'2|' || side || '|' || rep || '|' || model || '|' || benchmark")} AS u FROM c, range(2000) r(rep)),
    d AS (SELECT u.model, u.benchmark, u.side, u.rep, coalesce(f.x, u.k) / u.n AS m FROM u ASOF LEFT JOIN f ON u.model = f.model AND u.benchmark = f.benchmark AND u.side = f.side AND u.u <= f.cdf),
    g AS (SELECT model, benchmark, rep, max(m) FILTER (side = 'clean') - max(m) FILTER (side = 'contam') AS g FROM d GROUP BY 1, 2, 3)"""


@query(sql("SELECT model, benchmark, quantile_cont(g, 0.025) AS ci_low, quantile_cont(g, 0.975) AS ci_high FROM g WHERE g IS NOT NULL GROUP BY 1, 2", "audit", rnd="ci_low ci_high").replace(") SELECT * REPLACE", f"), {SIDES}, {BINOMIAL} SELECT * REPLACE", 1))
def bootstrap_ci(spark, sf):
    return resample.bootstrap_ci(_sides(spark, sf), CELL, 2000)


def _pairs(spark, sf):
    v = _versions(spark, sf)
    a, b = v.where("v = 1").select(*CELL, F.col("gap").alias("g2")), v.where("v = 0").select(*CELL, F.col("gap").alias("g1"))
    return a.join(b, CELL).select("benchmark", "model", (F.col("g2") - F.col("g1")).alias("d"))


FLIP = M32.format("'3|' || rep || '|' || model")


@query(sql(f"SELECT benchmark, avg((f >= o - 1e-12)::INT) AS p_flip FROM (SELECT benchmark, rep, avg(CASE WHEN {FLIP} % 2 = 0 THEN d ELSE -d END) AS f, avg(d) AS o FROM (SELECT a.benchmark, a.model, a.gap - b.gap AS d FROM cells a JOIN cells1 b USING (model, benchmark)), range(10000) r(rep) GROUP BY 1, 2) GROUP BY 1", "cells", "cells1", rnd="p_flip"))
def sign_flip_test(spark, sf):
    return resample.sign_flip_test(_pairs(spark, sf), "d", "model", ["benchmark"], 10_000)


WILD = """c AS (SELECT model, sum(CASE WHEN v = 1 THEN gap ELSE 0 END) AS s1, sum(CASE WHEN v = 0 THEN gap ELSE 0 END) AS s0, sum(v)::DOUBLE AS n1, sum(1 - v)::DOUBLE AS n0 FROM v GROUP BY 1),
    e AS (SELECT model, n1, n0, s1 - n1 * m AS e1, s0 - n0 * m AS e0, tn1, tn0 FROM c, (SELECT sum(s1 + s0) / sum(n1 + n0) AS m, sum(n1) AS tn1, sum(n0) AS tn0 FROM c)),
    b AS (SELECT rep, n1, n0, tn1, tn0, sgn * e1 AS d1, sgn * e0 AS d0 FROM (SELECT *, CASE WHEN rep = 0 OR {h} % 2 = 0 THEN 1 ELSE -1 END AS sgn FROM e, range(501) r(rep))),
    m AS (SELECT rep, sum(d1) AS x1, sum(d0) AS x0 FROM b GROUP BY 1),
    t AS (SELECT rep, (max(x1) / max(tn1) - max(x0) / max(tn0)) / nullif(sqrt(sum(((d1 - n1 * x1 / tn1) / tn1 - (d0 - n0 * x0 / tn0) / tn0) ** 2)), 0) AS t FROM b JOIN m USING (rep) GROUP BY 1)"""


@query(sql("SELECT o.t AS t_obs, avg((abs(t.t) >= abs(o.t))::INT) AS p_wild FROM t, (SELECT t FROM t WHERE rep = 0) o WHERE rep > 0 GROUP BY 1", "cells", "cells1", rnd="t_obs p_wild").replace(") SELECT * REPLACE", f"), {VERS}, {WILD.format(h=M32.format(chr(39) + '4|' + chr(39) + ' || rep || ' + chr(39) + '|' + chr(39) + ' || model'))} SELECT * REPLACE", 1))
def wild_cluster_bootstrap(spark, sf):
    return resample.wild_cluster_bootstrap(_versions(spark, sf), "gap", "v", "model", 500)


RAND = """SELECT rep, model, correct, loss - l AS delta FROM matrix JOIN (SELECT rep, p.model, item_id, avg(loss) AS l FROM (SELECT rep, a.model, b.model AS peer, row_number() OVER (PARTITION BY rep, a.model ORDER BY md5('5|' || rep || '|' || a.model || '|' || b.model), b.model) AS r,
    count(*) OVER (PARTITION BY rep, a.model) AS c FROM models a, models b, range(100) g(rep) WHERE a.family <> b.family) p JOIN matrix x ON x.model = p.peer WHERE r <= 3 AND c >= 3 GROUP BY 1, 2, 3) USING (model, item_id)"""
NULL_GAPS = "SELECT model, rep, gap FROM (" + split_sql(f"SELECT rep, model, correct, round(delta, 9) AS delta FROM ({RAND})", "model, rep", "delta", 0.2, 0.8, "contam", "clean") + ") WHERE n_clean > 0 AND n_contam > 0"
REAL_GAPS = "SELECT model, gap FROM (" + split_sql(f"SELECT model, correct, round(delta, 9) AS delta FROM ({DELTA}) JOIN matrix USING (model, item_id)", "model", "delta", 0.2, 0.8, "contam", "clean") + ")"


def _null_gaps(spark, sf, outcomes):
    return resample.random_peer_null(outcomes, io.stored(models(spark, sf, outcomes)), 3, 100)


def _real_gaps(spark, sf, outcomes):
    d = _delta(spark, sf, outcomes).withColumn("delta", F.round("delta", 9))
    return C.quantile_split(io.stored(d.select("model", "delta", "correct")), "delta", ["model"], 0.2, 0.8, True)


@query(sql(NULL_GAPS, "matrix", "models", rnd="gap"))
def random_peer_null(spark, sf):
    """Gaps under random peers of other families, a hundred draws a model."""
    return _null_gaps(spark, sf, io.stored(matrix(spark, sf)))


@query(sql(f"SELECT model, g.gap AS real_gap, avg(n.gap) AS null_mean, stddev_pop(n.gap) AS null_sd, quantile_cont(n.gap, 0.05) AS null_p5, avg((round(n.gap, 9) <= round(g.gap, 9))::INT) AS at_or_below, count(n.gap) AS n_draws FROM ({NULL_GAPS}) n JOIN ({REAL_GAPS}) g USING (model) GROUP BY 1, 2", "matrix", "models", rnd="real_gap null_mean null_sd null_p5 at_or_below"))
def random_peer_summary(spark, sf):
    """Where the gap under capability peers lies among those under random ones."""
    m = io.stored(matrix(spark, sf))
    return resample.null_summary(io.stored(_null_gaps(spark, sf, m)), _real_gaps(spark, sf, m))


@query()
def loss_shuffle_test(spark, sf):
    """The gap in mean loss of a cell's sides and its p by 5000 shuffles of the labels."""
    return shuffle.shuffle_test(_sides(spark, sf), "loss", CELL, 5000)


POISSON_SQL = " + ".join(f"(h >= '{t}')::INT" for t in shuffle.POISSON_HEX)


@query(sql(f"""SELECT model, benchmark, quantile_cont(gap, 0.025) AS ci_low, quantile_cont(gap, 0.975) AS ci_high FROM (SELECT model, benchmark, rep, max(m) FILTER (clean) - max(m) FILTER (NOT clean) AS gap FROM (SELECT model, benchmark, rep, clean, sum(w * loss) / sum(w) AS m
    FROM (SELECT *, {POISSON_SQL} AS w FROM (SELECT model, benchmark, p < 0.1 AS clean, loss, rep, substr(md5('6|' || rep // 4 || '|' || item_id), rep % 4 * 8 + 1, 8) AS h FROM audit, range(400) r(rep) WHERE p < 0.1 OR p > 0.5)) WHERE w > 0 GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) WHERE gap IS NOT NULL GROUP BY 1, 2""", "audit", rnd="ci_low ci_high"))
def poisson_bootstrap(spark, sf):
    """An interval of the gap in mean loss by Poisson resamples."""
    return shuffle.poisson_bootstrap(_sides(spark, sf), "loss", CELL, "item_id", 400)


NOISE = f"(SELECT seed || '|' || model AS model, correct, p, {M32.format(chr(39) + chr(39) + ' || seed || ' + chr(39) + '|' + chr(39) + ' || item_id')} % 4 AS stratum FROM audit, range(5) g(seed))"


@query(sql(f"SELECT split_part(model, '|', 1)::BIGINT AS seed, split_part(model, '|', 2) AS model, n_strata, iv_gap, iv_se, z, 2 * (1 - {phi('abs(z)')}) AS p_two, {phi('z')} AS p_one FROM ({IV.format(t=NOISE)})", "audit", rnd="iv_gap iv_se z p_two p_one"))
def random_strata(spark, sf):
    """A stratifier of pure noise, five times: a negative control."""
    a = audit(spark, sf).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(4))))
    a = a.withColumn("noise", resample.md5_int(F.col("seed"), F.col("item_id")) % 4)
    return C.iv_weighted_gap(a, ["seed", "model"], "noise")


@query(sql("SELECT model, risk, item_id FROM (SELECT model, risk, item_id, row_number() OVER (PARTITION BY model, risk ORDER BY md5('judge|' || item_id), item_id) AS r FROM (SELECT *, CASE WHEN p < 0.1 THEN 'clean' WHEN p > 0.5 THEN 'contam' END AS risk FROM audit) WHERE risk IS NOT NULL) WHERE r <= 10", "audit"))
def balanced_sample(spark, sf):
    a = audit(spark, sf).withColumn("risk", F.when(F.col("p") < 0.1, "clean").when(F.col("p") > 0.5, "contam"))
    return resample.balanced_sample(a, ["model"], "risk", 10, "judge", "item_id").select("model", "risk", "item_id")


@query(sql("SELECT row_id, " + ", ".join(f"({f} - avg({f}) OVER ()) / CASE WHEN stddev_pop({f}) OVER () = 0 THEN 1 ELSE stddev_pop({f}) OVER () END AS z_{f}" for f in FEATURES) + " FROM calib", "calib", rnd=" ".join(f"z_{f}" for f in FEATURES)))
def standardize(spark, sf):
    return K.standardize(calib(spark, sf), FEATURES).select("row_id", *[f"z_{f}" for f in FEATURES])


def _fit(spark, sf, features=FEATURES, where="split = 'dev'"):
    return K.fit_ensemble(calib(spark, sf).where(where), list(features), "label")


@query()
def fit_ensemble(spark, sf):
    """Metrics of the ensemble on dev and val rows."""
    scored = calib(spark, sf).withColumn("score", K.score(_fit(spark, sf)))
    auc = ranks.roc_auc(scored, "score", "label", ["split"])
    return auc.join(K.max_f1(scored, "score", "label", ["split"]), "split")


FIXED = {"features": {"n_chars": (2500.0, 3000.0, 0.4), "n_words": (400.0, 500.0, -0.2), "distinct_ratio": (0.8, 0.1, 0.7)}, "intercept": 0.3}
FIXED_SQL = "1 / (1 + exp(-(0.3 + 0.4 * (n_chars - 2500) / 3000 - 0.2 * (n_words - 400) / 500 + 0.7 * (coalesce(distinct_ratio, 0.8) - 0.8) / 0.1)))"


@query("SELECT 'v2' AS version, unnest(['n_chars', 'n_words', 'distinct_ratio']) AS feature, unnest([0, 1, 2])::BIGINT AS ord, unnest([2500.0, 400.0, 0.8])::DOUBLE AS mean, unnest([3000.0, 500.0, 0.1])::DOUBLE AS std, unnest([0.4, -0.2, 0.7])::DOUBLE AS coef, 0.3::DOUBLE AS intercept, n AS n_rows FROM (SELECT count(*) AS n FROM documents JOIN labels USING (doc_id))")
def export_ensemble(spark, sf):
    """A stored model as a portable table, written as JSON and read again, beside the number of rows it is meant for."""
    table_ = io.roundtrip_json(K.ensemble_table(spark, FIXED, "v2"), io.scratch(spark, "ensemble"))
    return table_.crossJoin(F.broadcast(calib(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"))))  # one row


@query(sql(f"SELECT row_id, {FIXED_SQL} AS p FROM calib", "calib", rnd="p"))
def score_ensemble(spark, sf):
    """A stored coefficient table applied by a join, without unpickling anything."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(m).alias("mean"), F.lit(s).alias("std"), F.lit(c).alias("coef"), F.lit(FIXED["intercept"]).alias("intercept")) for f, (m, s, c) in FIXED["features"].items()])
    return K.score_with_table(calib(spark, sf), spark.range(1).select(F.inline(rows)), FEATURES, "row_id")


def _evaluated(c, sets: dict[str, list[str]], name: str, policy: str = "mean"):
    """(name, auc, f1, n_cells, mean_gap, correct_dir): an ensemble for each set of features, fitted together on dev rows,
    judged on val rows, and deployed."""
    models = fit_many(c, {k: (fs, F.col("split") == "dev") for k, fs in sets.items()}, "label")
    each = F.array(*[F.struct(F.lit(k).alias(name), K.score(m, policy).alias("score")) for k, m in models.items()])
    scored = io.stored(c.select("split", "variant", "label", (1 - F.col("toxic")).alias("correct"), F.inline(each)))
    val = scored.where("split = 'val'")
    auc, f1 = ranks.roc_auc(val, "score", "label", [name]), ranks.prf(val, "score", "label", F.lit(0.5), [name]).select(name, "f1")
    gap = K.deployment_gap(scored, ["variant"], by=[name])
    return auc.join(f1, name).join(gap, name, "left").select(name, "auc", "f1", F.coalesce("n_cells", F.lit(0)).alias("n_cells"), "mean_gap", "correct_dir")


@query()
def ablate_features(spark, sf):
    """Val AUC and F1 and the deployment gap after leaving out each feature."""
    return _evaluated(io.stored(calib(spark, sf)), {f: [x for x in FEATURES if x != f] for f in FEATURES}, "dropped")


@query()
def alt_ensembles(spark, sf):
    """The same for named subsets of the features, missing values as 0."""
    return _evaluated(io.stored(calib(spark, sf)), {"full": FEATURES, "length": FEATURES[:2], "ratio": FEATURES[2:]}, "ensemble", "zero")


@query()
def difficulty_matched_ensemble(spark, sf):
    """(n_dev, n_val, auc, f1): each variant's positives and, for each, the negative nearest in difficulty, repeats kept;
    the difficulty quantile is a further feature; fitted on dev variants, judged on val ones."""
    return K.difficulty_matched(io.stored(calib(spark, sf)), FEATURES, "n_chars", "label", "row_id", "variant")


@query()
def peer_ensemble(spark, sf):
    """(features, auc, f1): losses alone, and with the robust z-score of a model's loss among all models on the item."""
    z = io.stored(peers.robust_z(matrix(spark, sf), "loss", ["item_id"]).withColumns({"label": F.col("correct"), "split": F.when(F.col("item_id") % 5 < 3, "dev").otherwise("val")}))

    sets = {"loss": ["loss"], "loss and peer_z": ["loss", "peer_z"]}
    models = fit_many(z, {k: (fs, F.col("split") == "dev") for k, fs in sets.items()}, "label")
    val = io.stored(z.where("split = 'val'").select("label", F.inline(F.array(*[F.struct(F.lit(k).alias("features"), K.score(m).alias("score")) for k, m in models.items()]))))
    auc = ranks.roc_auc(val, "score", "label", ["features"])
    return auc.join(K.max_f1(val, "score", "label", ["features"]), "features").select("features", "auc", F.col("max_f1").alias("f1"))


@query()
def kfold_eval(spark, sf):
    """(k, fold, auc, f1) of cross-validation with 2, 3 and 5 folds: rows are dealt once, ten models fitted together."""
    c = io.stored(resample.kfold(calib(spark, sf), 30, "cv", "row_id", []))  # the place in the order modulo 30 tells all folds
    fold = lambda k: F.pmod("fold", F.lit(k)).cast("int")
    models = fit_many(c, {f"{k} {i}": (FEATURES, fold(k) != i) for k in (2, 3, 5) for i in range(k)}, "label")
    each = [F.struct(F.lit(k).alias("k"), fold(k).alias("fold"), F.array(*[K.score(models[f"{k} {i}"]) for i in range(k)])[fold(k)].alias("score")) for k in (2, 3, 5)]
    scored = io.stored(c.select("label", F.inline(F.array(*each))))
    by = ["k", "fold"]
    return ranks.roc_auc(scored, "score", "label", by).join(K.max_f1(scored, "score", "label", by), by).select(*by, "auc", F.col("max_f1").alias("f1"))


@query(sql(f"SELECT variant, greatest(a, 1 - a) AS auc FROM (SELECT variant, (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)) AS a FROM (SELECT *, rank() OVER (PARTITION BY variant ORDER BY s) + (count(*) OVER (PARTITION BY variant, s) - 1) / 2 AS r FROM (SELECT variant, label, round({FIXED_SQL}, 9) AS s FROM calib)) GROUP BY 1)", "calib", rnd="auc"))
def variant_eval(spark, sf):
    s = calib(spark, sf).withColumn("score", F.round(K.score(FIXED), 9))
    return ranks.roc_auc(s, "score", "label", ["variant"]).select("variant", "auc")


@query(sql(f"SELECT variant, detector, auc, max_f1 FROM ({AUC_SQL}) JOIN (SELECT variant, detector, max(2 * tp / (tp + fp + p)) AS max_f1 FROM ({CURVE}) GROUP BY 1, 2) USING (variant, detector)", "long_calib", rnd="auc max_f1"))
def exposure_curve(spark, sf):
    lf = long_calib(spark, sf)
    k = ["variant", "detector"]
    return ranks.roc_auc(lf, "score", "label", k).select(*k, "auc").join(K.max_f1(lf, "score", "label", k), k)


@query()
def kmeans_strata(spark, sf):
    """Four clusters of the embeddings as strata."""
    return K.kmeans_strata(table(spark, sf, "embeddings"), "vec_id", "embedding", 4)


@query(sql(f"SELECT variant, detector, auc, max_f1, auc - ref AS lift FROM ({AUC_SQL}) JOIN (SELECT variant, detector, max(2 * tp / (tp + fp + p)) AS max_f1 FROM ({CURVE}) GROUP BY 1, 2) USING (variant, detector) JOIN (SELECT variant, auc AS ref FROM ({AUC_SQL}) WHERE detector = 'distinct_ratio') USING (variant) WHERE detector <> 'distinct_ratio'", "long_calib", rnd="auc max_f1 lift"))
def blind_baseline(spark, sf):
    """What text length alone would detect in each variant, either way round, beside a reference detector."""
    lf = long_calib(spark, sf)
    auc = ranks.roc_auc(lf, "score", "label", ["variant", "detector"]).select("variant", "detector", "auc")
    f1 = K.max_f1(lf, "score", "label", ["variant", "detector"])
    ref = auc.where("detector = 'distinct_ratio'").select("variant", F.col("auc").alias("_ref"))
    blind = auc.where("detector <> 'distinct_ratio'").join(f1, ["variant", "detector"]).join(ref, "variant")
    return blind.select("variant", "detector", "auc", "max_f1", (F.col("auc") - F.col("_ref")).alias("lift"))


@query(sql("SELECT model, count(*) AS n, corr(loss - a, loss - b) AS pearson FROM (SELECT m.model, m.loss, x.loss AS a, y.loss AS b FROM matrix m JOIN matrix x ON x.item_id = m.item_id AND x.model = 'm0' JOIN matrix y ON y.item_id = m.item_id AND y.model = 'm9' WHERE m.model NOT IN ('m0', 'm9')) GROUP BY 1", "matrix", rnd="pearson"))
def refmodel_sensitivity(spark, sf):
    m = matrix(spark, sf)
    ref = lambda x, n: m.where(F.col("model") == x).select("item_id", F.col("loss").alias(n))
    j = m.where("model not in ('m0', 'm9')").join(ref("m0", "a"), "item_id").join(ref("m9", "b"), "item_id")
    return j.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.corr(F.col("loss") - F.col("a"), F.col("loss") - F.col("b")).alias("pearson"))


@query(sql(f"SELECT *, {t_tail_sql('t', 'n - 1')} AS p FROM (SELECT count(*) AS n, avg(gap) AS mean, stddev_samp(gap) AS sd, avg(gap) / (stddev_samp(gap) / sqrt(count(*))) AS t FROM (" + split_sql(f"SELECT model, correct, round(delta, 9) AS delta FROM ({DELTA}) JOIN matrix USING (model, item_id)", "model", "delta", 0.2, 0.8, "contam", "clean") + "))", "models", rnd="mean sd t p"))
def peer_delta_gap(spark, sf):
    """Gaps after splitting items by their delta to capability peers, and the test of their mean."""
    g = _real_gaps(spark, sf, io.stored(matrix(spark, sf)))
    return I.ttest_1samp(g, "gap", [])
