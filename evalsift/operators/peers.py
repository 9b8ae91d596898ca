"""Peer models: capability windows, deltas to peers, robust z-scores, nearest matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.io import stored
from .prefix import numbered, part_of, with_rank


def capability_peers(models: DataFrame, k: int = 7, within: float | None = 0.15, least: int = 3) -> DataFrame:
    """(model, peer, diff, rank): up to ``k`` models of other families within the accuracy window, nearest first; models
    with fewer than ``least`` have none. ``models`` (model, family, acc) has a row a model: a range join on accuracy
    buckets as wide as the window keeps distant models apart."""
    width = within if within else 1.0
    a = models.withColumn("_b", F.floor(F.col("acc") / width))
    b = models.select(F.col("model").alias("peer"), F.col("family").alias("_pf"), F.col("acc").alias("_pa"), F.explode(F.array(*[F.floor(F.col("acc") / width) + d for d in (-1, 0, 1)])).alias("_b"))
    near = a.join(b, "_b").where((F.col("family") != F.col("_pf")) & (F.col("model") != F.col("peer"))).withColumn("diff", F.abs(F.col("acc") - F.col("_pa")))
    if within:
        near = near.where(F.round("diff", 9) <= within)
    w = W.partitionBy("model")
    r = near.withColumns({"rank": F.row_number().over(w.orderBy("diff", "peer")), "_n": F.count(F.lit(1)).over(w)})
    return r.where((F.col("rank") <= k) & (F.col("_n") >= least)).select("model", "peer", "diff", "rank")


def set_deltas(outcomes: DataFrame, sets: DataFrame, whole: bool, digits: int | None = None) -> DataFrame:
    """(sid, item_id, delta, correct): for each of ``sets`` (sid, model, peers) the model's loss of an item minus the mean of
    those peers that have one; with ``whole``, only where all have one. ``outcomes``: model, item_id, loss, correct.

    An item's outcomes meet once, a row an item with as many entries as there are models, and all sets are taken from that
    row: nothing is shuffled by set. The sets, which grow with the models alone, go to every task.
    """
    table = [(r["sid"], r["model"], list(r["peers"])) for r in sets.select("sid", "model", "peers").collect()]
    names = sorted({m for _, model, theirs in table for m in (model, *theirs)})
    place = {m: i for i, m in enumerate(names)}
    plan = [(sid, place[model], [place[m] for m in theirs]) for sid, model, theirs in table]
    one = F.struct("model", F.col("loss").cast("double").alias("loss"), F.col("correct").cast("double").alias("correct"))
    items = outcomes.where("item_id is not null").groupBy("item_id").agg(F.collect_list(one).alias("z")).select("item_id", "z.model", "z.loss", "z.correct")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            models, n = batch.column(1), len(batch)
            at = pc.fill_null(pc.index_in(models.flatten(), value_set=pa.array(names, pa.string())), -1).to_numpy()
            cell = at[at >= 0], np.repeat(np.arange(n), np.diff(models.offsets.to_numpy()))[at >= 0]
            loss, correct = np.full((len(names), n), np.nan), np.full((len(names), n), np.nan)
            loss[cell] = batch.column(2).flatten().to_numpy(zero_copy_only=False)[at >= 0]
            correct[cell] = batch.column(3).flatten().to_numpy(zero_copy_only=False)[at >= 0]
            there, value = ~np.isnan(loss), np.nan_to_num(loss)
            for sid, own, theirs in plan:
                have = there[theirs].sum(0)
                keep = np.flatnonzero(there[own] & (have == len(theirs) if whole else have > 0))
                delta = loss[own, keep] - value[theirs][:, keep].sum(0) / have[keep]
                delta = delta if digits is None else np.round(delta, digits)
                right = correct[own, keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), sid, np.int64)), batch.column(0).take(pa.array(keep)), pa.array(delta), pa.array(right, mask=np.isnan(right))], ["sid", "item_id", "delta", "correct"])

    return items.mapInArrow(batches, f"sid long, item_id {dict(outcomes.dtypes)['item_id']}, delta double, correct double")


def peer_delta(outcomes: DataFrame, peers: DataFrame) -> DataFrame:
    """(model, item_id, delta, correct): an item's loss minus its peers' mean; items that a peer lacks are dropped."""
    sets = stored(peers.groupBy("model").agg(F.sort_array(F.collect_list("peer")).alias("peers")).withColumn("sid", F.xxhash64("model")))
    return set_deltas(outcomes, sets, True).join(F.broadcast(sets), "sid").select("model", "item_id", "delta", "correct")  # a row a model


def within_z(df: DataFrame, value: str, keys: list[str], out: str = "z") -> DataFrame:
    """(x - mean) / (deviation + 1e-6) within ``keys``: one aggregate, joined back."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    return df.join(stats, keys).withColumn(out, (F.col(value) - F.col("_mean")) / (F.col("_sd") + 1e-6)).drop("_mean", "_sd")


def robust_z(df: DataFrame, value: str, keys: list[str], out: str = "peer_z", pool: str | None = None) -> DataFrame:
    """(x - median) / (1.4826 MAD + 1e-6) within ``keys``; with ``pool``, median and MAD come from rows where it holds."""
    base = df.where(pool) if pool else df
    med = base.groupBy(*keys).agg(F.median(value).alias("_med"))
    mad = base.join(med, keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_med"))).alias("_mad"))
    return df.join(med, keys).join(mad, keys).withColumn(out, (F.col(value) - F.col("_med")) / (1.4826 * F.col("_mad") + 1e-6)).drop("_med", "_mad")


def nearest_match(positives: DataFrame, negatives: DataFrame, value: str, row: str, keys: list[str]) -> DataFrame:
    """(keys, row, match, distance): for each positive the negative with the nearest value, the least row on ties; none
    where the value is null or the group has no negatives.

    An as-of join both ways over the distinct values, in ranges of them: windows look back and ahead within (keys, range),
    and each range hands its first and last negative to the ranges on either side, a row a range. A group fills as many
    tasks as there are ranges, and a value that many rows share is one row.
    """
    one = lambda df, neg, pos: df.select(*keys, F.col(value).alias("_v"), neg.cast("long").alias("_neg"), F.lit(pos).alias("_pos"))
    rows = one(positives, F.lit(None), True).unionByName(one(negatives, F.col(row), False)).where("_v is not null")
    values = stored(rows.groupBy(*keys, "_v").agg(F.min("_neg").alias("_neg"), F.max("_pos").alias("_pos")))
    cand = F.when(F.col("_neg").isNotNull(), F.struct(F.col("_v").alias("v"), F.col("_neg").alias("r")))
    cut = values.withColumns({"_part": part_of(values, "_v"), "_c": cand})
    # the way ahead is the way back in falling order: each window runs along its rows once
    along = lambda order: F.last("_c", True).over(W.partitionBy(*keys, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    near = cut.withColumns({"_a": along(F.asc("_v")), "_b": along(F.desc("_v"))}).where("_pos")
    names = [f"_far_{k}" for k in keys]
    ends = cut.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_part").alias("_far_part")).agg(F.max("_c").alias("_last"), F.min("_c").alias("_first"))
    beyond = lambda c, order: F.last(c, True).over(W.partitionBy(*names).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    far = ends.withColumns({"_before": beyond("_last", F.asc("_far_part")), "_after": beyond("_first", F.desc("_far_part"))})
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)] + [F.col("_part") == F.col("_far_part")]
    both = near.join(far, on).withColumns({"_a": F.coalesce("_a", "_before"), "_b": F.coalesce("_b", "_after")})
    away = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("_v") - F.col(f"{c}.v")).alias("d"), F.col(f"{c}.r").alias("r")))
    best = both.withColumn("_best", F.array_min(F.array_compact(F.array(away("_a"), away("_b"))))).select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_v").alias("_far_v"), "_best")
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)] + [F.col(value) == F.col("_far_v")]
    return positives.join(best, on, "left").select(*keys, row, F.col("_best.r").alias("match"), F.col("_best.d").alias("distance"))


def difficulty_quantile(df: DataFrame, value: str, keys: list[str], row: str = "item_id") -> DataFrame:
    """``df`` with ``difficulty``: the place of a row in the order of its value (and row), from 0 to 1."""
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    r = numbered(df, keys, [F.col(value), F.col(row)], F.when(F.col(value).isNull(), F.lit(-1)).otherwise(part_of(df, value)), "_i")
    return r.join(size, keys).withColumn("difficulty", F.col("_i") / F.greatest(F.col("_size") - 1, F.lit(1))).drop("_i", "_size")


def spearman_matrix(losses: DataFrame) -> DataFrame:
    """(m1, m2, n, rho) of every pair of models over the items that all models have."""
    n = losses.select("model").distinct().agg(F.count(F.lit(1)).alias("_m"))
    common = losses.where("loss is not null").groupBy("item_id").agg(F.count_distinct("model").alias("_c")).crossJoin(F.broadcast(n)).where("_c = _m").select("item_id")  # one row
    r = with_rank(losses.join(common, "item_id", "left_semi"), "loss", ["model"], "_r")
    a, b = r.select("item_id", F.col("model").alias("m1"), F.col("_r").alias("_r1")), r.select("item_id", F.col("model").alias("m2"), F.col("_r").alias("_r2"))
    return a.join(b, "item_id").where("m1 < m2").groupBy("m1", "m2").agg(F.count(F.lit(1)).alias("n"), F.corr("_r1", "_r2").alias("rho"))


def spearman_summary(pairs: DataFrame) -> DataFrame:
    """(pairs, mean, median, positive, above_03) of a matrix of correlations: one row."""
    share = lambda c: F.avg(c.cast("double"))
    return pairs.agg(F.count("rho").alias("pairs"), F.avg("rho").alias("mean"), F.median("rho").alias("median"), share(F.col("rho") > 0).alias("positive"), share(F.col("rho") > 0.3).alias("above_03"))
