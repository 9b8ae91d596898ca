"""Permutation tests, bootstraps, sign flips and random controls, drawn by md5 of (seed, repetition, item), so that any engine repeats them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stats import binomial_draw, hypergeom_cdf
from .prefix import numbered


def md5_order(seed: str, *keys: Column) -> Column:
    """The order that Spark and any SQL engine share: md5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]))


def md5_int(*keys: Column, digits: int = 8) -> Column:
    """A whole number from the first hex digits of the keys' md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys])), 1, digits), 16, 10).cast("long")


def reps(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def exact_permutation(cells: DataFrame) -> DataFrame:
    """``cells`` (n_clean, n_contam, k_clean, k_contam: correct ones) with ``p_exact``: P(gap <= observed) under
    shuffled labels, a hypergeometric distribution function."""
    t, g = F.col("n_clean") + F.col("n_contam"), F.col("k_clean") + F.col("k_contam")
    return cells.withColumn("p_exact", hypergeom_cdf(F.col("k_clean"), t, g, F.col("n_clean")))


def by_side(items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_clean, n_contam, k_clean, k_contam): rows and correct ones of each side; all that 0/1 outcomes tell."""
    n = lambda s: F.count_if(F.col("side") == s)
    hit = lambda s: F.sum(F.when(F.col("side") == s, F.col("correct")).otherwise(0)).cast("long")
    return items.groupBy(*keys).agg(n("clean").alias("n_clean"), n("contam").alias("n_contam"), hit("clean").alias("k_clean"), hit("contam").alias("k_contam"))


def spread(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Few rows with much work each, dealt over all cores: by size alone they would be one partition."""
    return cells.repartition(cells.sparkSession.sparkContext.defaultParallelism, *keys)


def uniform(*keys: Column) -> Column:
    return (md5_int(*keys) + 0.5) / F.lit(float(1 << 32))


def permutation_test(items: DataFrame, keys: list[str], n: int, seed: int = 1) -> DataFrame:
    """(keys, p_perm): share of ``n`` label shuffles whose gap is at most the observed one. ``items``: side, correct.

    A shuffle decides how many correct rows fall on the clean side, a hypergeometric number, and sizes are fixed, so the
    gap orders as that number does. It is drawn by inversion: it is at most the observed number just where its uniform,
    from the md5 of (seed, repetition, cell), is at most the distribution function there. Rows are counted once.
    """
    cells = exact_permutation(spread(by_side(items, keys).where("n_clean > 0 and n_contam > 0"), keys))
    below = lambda p: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda rep: (uniform(F.lit(seed), rep, *[F.col(k) for k in keys]) <= p).cast("int"))
    # the distribution function is bound once a cell, not once a repetition
    share = F.transform(F.array("p_exact"), lambda p: F.aggregate(below(p), F.lit(0), lambda a, x: a + x) / n)[0]
    return cells.select(*keys, share.alias("p_perm"))


def bootstrap_ci(items: DataFrame, keys: list[str], n: int, seed: int = 2) -> DataFrame:
    """(keys, ci_low, ci_high): percentiles of the gap over ``n`` resamples of each side.

    A resample of a side with k of m correct has a binomial number of correct rows; both numbers are drawn by inversion
    from uniforms of (seed, side, repetition, cell). Rows are counted once, and a cell's repetitions stay in its row.
    """
    cells = spread(by_side(items, keys).where("n_clean > 0 and n_contam > 0"), keys)
    side = lambda s: binomial_draw(F.col(f"n_{s}"), F.col(f"k_{s}"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda rep: uniform(F.lit(seed), F.lit(s), rep, *[F.col(k) for k in keys])))
    gaps = F.zip_with(side("clean"), side("contam"), lambda a, b: a / F.col("n_clean") - b / F.col("n_contam"))
    at = lambda q: F.get("_g", F.lit(int(q * (n - 1)))) + (F.get("_g", F.lit(min(n - 1, int(q * (n - 1)) + 1))) - F.get("_g", F.lit(int(q * (n - 1))))) * (q * (n - 1) - int(q * (n - 1)))
    return cells.withColumn("_g", F.sort_array(gaps)).select(*keys, at(0.025).alias("ci_low"), at(0.975).alias("ci_high"))


def sign_flip_test(pairs: DataFrame, diff: str, row: str, keys: list[str], n: int, seed: int = 3) -> DataFrame:
    """(keys, p_flip): share of random sign flips whose mean reaches the observed one."""
    sign = F.when(md5_int(F.lit(seed), F.col("rep"), F.col(row)) % 2 == 0, 1).otherwise(-1)
    by = reps(pairs, n).groupBy(*keys, "rep").agg(F.avg(F.col(diff) * sign).alias("_f"), F.avg(diff).alias("_o"))
    return by.groupBy(*keys).agg(F.avg((F.col("_f") >= F.col("_o") - 1e-12).cast("double")).alias("p_flip"))


def wild_cluster_bootstrap(df: DataFrame, y: str, x: str, cluster: str, n: int, seed: int = 4) -> DataFrame:
    """(t_obs, p_wild): Rademacher signs by cluster on residuals under no effect; sums by cluster go in, not rows."""
    s = df.groupBy(cluster).agg(F.sum(F.when(F.col(x) == 1, F.col(y)).otherwise(0.0)).alias("s1"), F.sum(F.when(F.col(x) == 0, F.col(y)).otherwise(0.0)).alias("s0"), F.sum((F.col(x) == 1).cast("double")).alias("n1"), F.sum((F.col(x) == 0).cast("double")).alias("n0"))
    t = s.agg(F.sum("s1").alias("ts1"), F.sum("s0").alias("ts0"), F.sum("n1").alias("tn1"), F.sum("n0").alias("tn0"))
    r = s.crossJoin(F.broadcast(t))  # one row
    mean = (F.col("ts1") + F.col("ts0")) / (F.col("tn1") + F.col("tn0"))
    r = r.withColumns({"e1": F.col("s1") - F.col("n1") * mean, "e0": F.col("s0") - F.col("n0") * mean})
    sign = F.when(F.col("rep") == 0, 1).when(md5_int(F.lit(seed), F.col("rep"), F.col(cluster)) % 2 == 0, 1).otherwise(-1)
    b = reps(r, n + 1).withColumns({"d1": sign * F.col("e1"), "d0": sign * F.col("e0")})
    m = b.groupBy("rep", "tn1", "tn0").agg(F.sum("d1").alias("td1"), F.sum("d0").alias("td0"))
    slope = F.col("td1") / F.col("tn1") - F.col("td0") / F.col("tn0")
    c = b.join(m.select("rep", "td1", "td0"), "rep")
    infl = (F.col("d1") - F.col("n1") * F.col("td1") / F.col("tn1")) / F.col("tn1") - (F.col("d0") - F.col("n0") * F.col("td0") / F.col("tn0")) / F.col("tn0")
    v = c.groupBy("rep").agg(F.sqrt(F.sum(infl * infl)).alias("se"))
    t_ = m.join(v, "rep").select("rep", F.try_divide(slope, F.col("se")).alias("t"))
    obs = t_.where("rep = 0").select(F.col("t").alias("t_obs"))
    return t_.where("rep > 0").crossJoin(F.broadcast(obs)).groupBy("t_obs").agg(F.avg((F.abs("t") >= F.abs("t_obs")).cast("double")).alias("p_wild"))  # one row


def random_peer_null(outcomes: DataFrame, models: DataFrame, k: int, n: int, seed: int = 5) -> DataFrame:
    """(model, rep, gap): gaps after splitting items by their delta to k random peers of other families, drawn anew in each
    repetition. Models with fewer than k candidates have none. ``models``: model and family, a row a model; ``outcomes``:
    model, item_id, loss, correct. Repetitions that draw the same peers have the same gap, which is found once."""
    from ..sources.io import stored
    from .cells import quantile_split
    from .peers import set_deltas

    mine = reps(models.select("model", "family"), n)
    cand = mine.join(models.select(F.col("model").alias("peer"), F.col("family").alias("_pf")), F.col("family") != F.col("_pf"))
    w = W.partitionBy("model", "rep")
    rank = F.row_number().over(w.orderBy(md5_order(str(seed), F.col("rep"), F.col("model"), F.col("peer")), "peer"))
    peers = cand.withColumns({"_r": rank, "_n": F.count(F.lit(1)).over(w)}).where((F.col("_r") <= k) & (F.col("_n") >= k)).select("model", "rep", "peer")
    drawn = peers.groupBy("model", "rep").agg(F.sort_array(F.collect_list("peer")).alias("peers"))
    sets = stored(drawn.groupBy("model", "peers").agg(F.collect_list("rep").alias("reps")).withColumn("sid", F.xxhash64("model", "peers")))
    d = stored(set_deltas(outcomes, sets, False, 9).select("sid", "delta", "correct"))
    gaps = quantile_split(d, "delta", ["sid"], 0.2, 0.8, True).select("sid", "gap")
    return gaps.join(F.broadcast(sets), "sid").select("model", F.explode("reps").alias("rep"), "gap")  # at most n rows a model


def null_summary(null: DataFrame, real: DataFrame) -> DataFrame:
    """(model, real_gap, null_mean, null_sd, null_p5, at_or_below, n_draws): a model's real gap beside those of random peers;
    a real gap in the left tail says that the peers matter. ``null``: model, rep, gap; ``real``: model, gap."""
    from .quantiles import quantiles

    own = real.select("model", F.col("gap").alias("real_gap"))
    low = quantiles(null, "gap", ["model"], {"null_p5": 0.05})
    below = F.avg((F.round("gap", 9) <= F.round("real_gap", 9)).cast("double"))
    out = null.join(own, "model").groupBy("model", "real_gap").agg(F.avg("gap").alias("null_mean"), F.stddev_pop("gap").alias("null_sd"), below.alias("at_or_below"), F.count("gap").alias("n_draws"))
    return out.join(low, "model").select("model", "real_gap", "null_mean", "null_sd", "null_p5", "at_or_below", "n_draws")


def balanced_sample(df: DataFrame, keys: list[str], group: str, k: int, seed: str, row: str) -> DataFrame:
    """k rows of each group within ``keys``, in md5 order."""
    r = F.row_number().over(W.partitionBy(*keys, group).orderBy(md5_order(seed, F.col(row)), row))
    return df.where(F.col(group).isNotNull()).withColumn("_r", r).where(F.col("_r") <= k).drop("_r")


def kfold(df: DataFrame, k: int, seed: str, row: str, keys: list[str]) -> DataFrame:
    """``df`` with ``fold``: rows dealt in turn along the md5 order, whose first two digits are even parts of it."""
    order = md5_order(seed, F.col(row))
    part = F.conv(F.substring(order, 1, 2), 16, 10).cast("int")
    r = numbered(df.withColumn("_md5", order), keys, [F.col("_md5"), F.col(row)], part, "_i")
    return r.withColumn("fold", F.pmod("_i", F.lit(k))).drop("_md5", "_i")
