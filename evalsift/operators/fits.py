"""Many logistic regressions at once: every step of Newton's method is one aggregate over the rows of all fits."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps at most, and the largest change of a coefficient at which a fit has converged.
STEPS, ENOUGH = 50, 1e-10


def fit_many(rows: DataFrame, fits: dict[str, tuple[list[str], Column]], label: str, c: float = 1.0) -> dict[str, dict]:
    """{fit: model} of balanced L2 logistic regressions on standardised features, in as many jobs as one of them takes.

    ``fits``: for each its features and which rows train it (a condition on ``rows``). A row counts for a fit if it has all
    of its features and a label. ``model``: {"features": {feature: (mean, deviation, coefficient)}, "intercept"}, as
    ``calibrate.score`` takes it. Minimised is the weighted log-loss plus |coefficients|^2 / (2 c); weights make both
    labels count alike; a fit without rows of both labels keeps the least regularised constant model.

    The driver holds coefficients and curvatures, a few numbers for each fit; rows stay where they are.
    """
    every = list(dict.fromkeys(f for features, _ in fits.values() for f in features))
    names = list(fits)
    used = {k: [f in fits[k][0] for f in every] for k in names}
    present = lambda features: reduce(lambda a, b: a & b, [F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")) for f in features], F.col(label).isNotNull())
    member = F.array_compact(F.array(*[F.when(where & present(features), F.lit(i)) for i, (features, where) in enumerate(fits.values())]))
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"x{j}") for j, f in enumerate(every)]
    long = rows.select((F.col(label) == 1).cast("double").alias("y"), *x, F.explode(member).alias("fit"))
    d = len(every)
    stats = {r["fit"]: r for r in long.groupBy("fit").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p"), *[f(f"x{j}").alias(f"{a}{j}") for j in range(d) for a, f in (("m", F.avg), ("s", F.stddev_pop))]).collect()}
    state = {}
    for i, k in enumerate(names):
        r = stats.get(i)
        n, p = (r["n"], r["p"]) if r else (0, 0)
        mean = np.array([r[f"m{j}"] if r and used[k][j] else 0.0 for j in range(d)])
        sd = np.array([(r[f"s{j}"] or 1.0) if r and used[k][j] else 1.0 for j in range(d)])
        state[i] = {"mean": mean, "sd": sd, "w": (n / (2 * max(1, n - p)), n / (2 * max(1, p))), "b": np.zeros(d + 1), "on": np.array([True, *used[k]]), "done": not n, "loss": np.inf, "step": np.zeros(d + 1)}

    spark = rows.sparkSession
    z = [F.lit(1.0), *[F.when(F.col("on")[j], (F.col(f"x{j}") - F.col("mean")[j]) / F.col("sd")[j]).otherwise(0.0) for j in range(d)]]
    for _ in range(STEPS):
        open_ = [i for i, s in state.items() if not s["done"]]
        if not open_:
            break
        table = spark.createDataFrame([(i, *[list(map(float, state[i][k])) for k in ("mean", "sd", "w", "b")], list(map(bool, state[i]["on"][1:]))) for i in open_], "id int, mean array<double>, sd array<double>, w array<double>, b array<double>, on array<boolean>")
        joined = long.join(F.broadcast(table), F.col("fit") == F.col("id"))  # a row for each fit
        joined = joined.select("fit", "y", F.when(F.col("y") == 1, F.col("w")[1]).otherwise(F.col("w")[0]).alias("w"), "b", *[v.alias(f"z{j}") for j, v in enumerate(z)])
        eta = reduce(lambda a, b: a + b, [F.col("b")[j] * F.col(f"z{j}") for j in range(d + 1)])
        joined = joined.withColumn("eta", eta).withColumn("p", 1 / (1 + F.exp(-F.col("eta"))))
        # log(1 + exp(eta)) - y * eta, without overflow
        loss = F.col("w") * (F.greatest("eta", F.lit(0.0)) + F.log1p(F.exp(-F.abs("eta"))) - F.col("y") * F.col("eta"))
        sums = [F.sum(loss).alias("loss"), *[F.sum(F.col("w") * (F.col("p") - F.col("y")) * F.col(f"z{j}")).alias(f"g{j}") for j in range(d + 1)]]
        sums += [F.sum(F.col("w") * F.col("p") * (1 - F.col("p")) * F.col(f"z{j}") * F.col(f"z{k}")).alias(f"h{j}_{k}") for j in range(d + 1) for k in range(j + 1)]
        for r in joined.groupBy("fit").agg(*sums).collect():
            s = state[r["fit"]]
            b, on = s["b"], s["on"]
            ridge = np.where(np.arange(d + 1) > 0, 1 / c, 0.0)
            loss_now = r["loss"] + 0.5 * float(ridge @ (b * b))
            if loss_now > s["loss"] + 1e-12 * abs(s["loss"]) and np.abs(s["step"]).max() > ENOUGH:  # too far: half the step
                s["step"] = s["step"] / 2
                s["b"] = b - s["step"]
                continue
            s["loss"] = loss_now
            g = np.array([r[f"g{j}"] for j in range(d + 1)]) + ridge * b
            h = np.array([[r[f"h{max(j, k)}_{min(j, k)}"] for k in range(d + 1)] for j in range(d + 1)]) + np.diag(ridge)
            step = np.zeros(d + 1)
            at = np.flatnonzero(on)
            step[at] = -np.linalg.lstsq(h[np.ix_(at, at)], g[at], rcond=None)[0]
            s["step"], s["b"] = step, b + step
            s["done"] = np.abs(step).max() <= ENOUGH
    return {k: {"features": {f: (float(state[i]["mean"][j]), float(state[i]["sd"][j]), float(state[i]["b"][j + 1])) for f in fits[k][0] for j in [every.index(f)]}, "intercept": float(state[i]["b"][0])} for i, k in enumerate(names)}
