"""Unigram language models of corpus parts, token log-probabilities, and what detectors make of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def unigram_lm(docs: DataFrame, by: str = "source") -> DataFrame:
    """(by, tok, c, n, v): counts in each part, its total, and the vocabulary that all parts share."""
    counts = docs.select(by, F.explode("t").alias("tok")).groupBy(by, "tok").agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy(by).agg(F.sum("c").alias("n"))
    vocab = counts.select("tok").distinct().agg(F.count(F.lit(1)).alias("v"))
    return counts.join(totals, by).crossJoin(F.broadcast(vocab))  # one row


def logprob(c: Column, n: Column, v: Column) -> Column:
    """Add-one smoothing."""
    return F.log((c + 1) / (n + v))


def token_logprobs(items: DataFrame, lm: DataFrame, by: str = "source", key: str = "item_id") -> DataFrame:
    """(by, key, pos, lp) of every item token under every part; unseen tokens get the add-one floor."""
    totals = lm.select(by, "n", "v").distinct()
    toks = items.select(key, F.posexplode("t").alias("pos", "tok"))
    wanted = toks.select("tok").distinct()
    seen = lm.select(by, "tok", "c").join(wanted, "tok", "left_semi")
    grid = toks.crossJoin(F.broadcast(totals))  # a row a part; a score for each part is the result asked for
    return grid.join(seen, [by, "tok"], "left").select(by, key, "pos", logprob(F.coalesce("c", F.lit(0)), F.col("n"), F.col("v")).alias("lp"))


def vocab_moments(lm: DataFrame, by: str = "source") -> DataFrame:
    """(by, mu, sigma): mean and sample deviation of the log-probability over the shared vocabulary, unseen words in
    closed form."""
    lp = logprob(F.col("c"), F.col("n"), F.col("v"))
    sums = lm.groupBy(by, "n", "v").agg(F.count(F.lit(1)).alias("k"), F.sum(lp).alias("s"), F.sum(lp * lp).alias("q"))
    floor = logprob(F.lit(0), F.col("n"), F.col("v"))
    s, q = F.col("s") + (F.col("v") - F.col("k")) * floor, F.col("q") + (F.col("v") - F.col("k")) * floor * floor
    return sums.select(by, (s / F.col("v")).alias("mu"), F.sqrt(F.try_divide(q - s * s / F.col("v"), F.col("v") - 1)).alias("sigma"))


def item_loss(lps: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(keys, n, loss): the mean negative log-probability; null below ``least`` tokens."""
    agg = lps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("lp").alias("_a"))
    return agg.select(*keys, "n", F.when(F.col("n") >= least, -F.col("_a")).alias("loss"))


def min_k(lps: DataFrame, keys: list[str], percents: tuple[int, ...] = (5, 10, 20, 30, 50), value: str = "lp", least: int = 4, sign: int = -1) -> DataFrame:
    """(keys, mink_k...): the mean of the lowest k percent of values (one at least) times ``sign``; null below ``least``."""
    w = W.partitionBy(*keys)
    ranked = lps.withColumns({"_r": F.row_number().over(w.orderBy(value, "pos")), "_n": F.count(F.lit(1)).over(w)})
    aggs = [(sign * F.avg(F.when(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * p / 100)), F.col(value)))).alias(f"mink_{p}") for p in percents]
    out = ranked.groupBy(*keys, "_n").agg(*aggs)
    return out.select(*keys, *[F.when(F.col("_n") >= least, F.col(f"mink_{p}")).alias(f"mink_{p}") for p in percents])


def min_k_plus(lps: DataFrame, moments: DataFrame, keys: list[str], by: str = "source", percent: int = 20) -> DataFrame:
    """(keys, minkpp): mean of the lowest percent of z-scores against the vocabulary's moments."""
    z = lps.join(moments, by).withColumn("z", F.try_divide(F.col("lp") - F.col("mu"), F.col("sigma")))
    return min_k(z, keys, (percent,), "z", sign=1).withColumnRenamed(f"mink_{percent}", "minkpp")


def span_loss(lps: DataFrame, keys: list[str], last: int) -> DataFrame:
    """(keys, span_loss): mean loss on the last tokens of each item."""
    w = W.partitionBy(*keys)
    tail = lps.withColumn("_n", F.max("pos").over(w)).where(F.col("pos") > F.col("_n") - last)
    return tail.groupBy(*keys).agg((-F.avg("lp")).alias("span_loss"))
