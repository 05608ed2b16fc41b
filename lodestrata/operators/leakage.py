"""What neighbours give away: label rates over edges, and a logistic regression with out-of-fold scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.temporal import numbered_within
from lodestrata.session import written


def neighbour_rate(edges: DataFrame, labels: DataFrame, label: str, allowed: Column | None = None, prior: float = 0.0, weight: float = 0.0) -> DataFrame:
    """(src, score): the share of a row's neighbours with the label, smoothed towards ``prior`` by ``weight`` rows.

    labels: (dst, label, more columns); ``allowed`` may use columns of edges and labels to keep out neighbours
    whose label was not yet known to the source.
    """
    seen = edges.join(labels, "dst")
    if allowed is not None:
        seen = seen.where(F.coalesce(allowed, F.lit(False)))
    k, n = F.sum(F.col(label).cast("double")), F.count(label)
    return seen.groupBy("src").agg(((k + prior * weight) / (n + weight)).alias("score"))


def fit_logistic(rows: DataFrame, features: Sequence[str], label: str, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients (intercept first) by Newton steps with L2, until they move less than 1e-8; raises after ``rounds``."""
    return fit_folds(rows.withColumn("__fold", F.lit(-1)), [list(features)], label, "__fold", ridge, rounds)[0]


def fit_folds(rows: DataFrame, features: Sequence[Sequence[str]], label: str, fold: str, ridge: float = 1.0, rounds: int = 50) -> list[np.ndarray]:
    """One model per entry of ``features``: the i-th is fitted on the rows whose fold is not i, on its own columns.

    All models take each Newton step in one pass: a task sends a gradient, a Hessian and the loss per model, of the number
    of features squared, whatever the number of rows; the driver solves those systems. A step that does not lower a
    model's penalised loss is halved. Raises after ``rounds``.
    """
    d = len(features[0]) + 1
    betas = [np.zeros(d) for _ in features]
    every = sorted({c for f in features for c in f})
    lists = [list(f) for f in features]
    data = rows.select(*(F.col(c).cast("double").alias(c) for c in every), F.col(label).cast("double").alias("__y"), F.col(fold).alias("__f")).na.drop()

    penalty = ridge * np.eye(d)
    penalty[0, 0] *= 1e-3  # a training set of one class has its best intercept at infinity
    size = d * (d + 1) + 1

    def measure(now: list[np.ndarray]) -> np.ndarray:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(now), size))
            for b in batches:
                for i, (beta, mine) in enumerate(zip(now, lists, strict=True)):
                    train = b[b["__f"] != i]
                    x, y = np.column_stack((np.ones(len(train)), train[mine].to_numpy())), train["__y"].to_numpy()
                    z = x @ beta
                    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    total[i, : d * d] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
                    total[i, d * d : -1] += x.T @ (y - p)
                    total[i, -1] += (np.logaddexp(0, z) - y * z).sum()
            yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

        sums = data.mapInPandas(part, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # models x size rows
        out = np.zeros(len(now) * size)
        for r in sums:
            out[r["at"]] = r["v"]
        return out.reshape(len(now), size)

    moves, losses, scale = [np.zeros(d) for _ in betas], [np.inf] * len(betas), [1.0] * len(betas)
    for _ in range(rounds):
        at = [b + s * m for b, m, s in zip(betas, moves, scale, strict=True)]
        for i, (now, found) in enumerate(zip(at, measure(at), strict=True)):
            loss = found[-1] + now @ penalty @ now / 2
            if loss > losses[i] + 1e-9 * abs(losses[i]) and np.isfinite(losses[i]):
                scale[i] /= 2
                continue
            betas[i], losses[i], scale[i] = now, loss, 1.0
            moves[i] = np.linalg.solve(found[: d * d].reshape(d, d) + penalty + 1e-9 * np.eye(d), found[d * d : -1] - penalty @ now)
        if max(np.abs(s * m).max() for s, m in zip(scale, moves, strict=True)) < 1e-8:
            return betas
    raise RuntimeError(f"the regression did not settle in {rounds} steps")


def logistic_score(features: Sequence[str], beta: np.ndarray) -> Column:
    z = F.lit(float(beta[0]))
    for c, b in zip(features, beta[1:], strict=True):
        z = z + F.col(c).cast("double") * float(b)
    return 1 / (1 + F.exp(-z))


def stratified_folds(rows: DataFrame, key: str, label: str, folds: int, seed: int, name: str = "fold") -> DataFrame:
    """Rows with a fold 0..folds-1: within each label the rows are dealt out in the order of a hash of seed and key, so
    every fold has its share of each label, to one row. Ranges of hashes are numbered by different tasks."""
    mixed = F.xxhash64(F.lit(seed), key)
    dealt = numbered_within(rows.withColumn("__mix", mixed), label, F.shiftright("__mix", 52), [F.col("__mix"), F.col(key)], "__place")
    return dealt.withColumn(name, F.pmod(F.col("__place"), F.lit(folds)).cast("int")).drop("__mix", "__place")


def out_of_fold(rows: DataFrame, key: str, features: Sequence[str], label: str, folds: int = 5, seed: int = 1) -> DataFrame:
    """(key, label, fold, score): each row scored by a model that was fitted on the other folds."""
    marked = written(stratified_folds(rows, key, label, folds, seed), "folds")
    betas = fit_folds(marked, [features] * folds, label, "fold")
    return marked.select(key, label, "fold", _by_fold([logistic_score(features, b) for b in betas]).alias("score"))


def _by_fold(scores: Sequence[Column]) -> Column:
    out = None
    for f, s in enumerate(scores):
        out = F.when(F.col("fold") == f, s) if out is None else out.when(F.col("fold") == f, s)
    return out


def cross_validated(rows: DataFrame, key: str, features: Sequence[str], label: str, neighbours: dict[str, DataFrame | None], folds: int = 5, repeats: int = 3) -> DataFrame:
    """(variant, repeat, fold, key, label, score): held-out scores over ``repeats`` stratified splits into ``folds``.

    neighbours: variant -> edges (src, dst) whose label rate becomes one more feature, or None for none. The rate of a
    row counts neighbours of the training folds only, smoothed by one row of the training rate, so no label of a
    test fold is in any feature of its model: counts are taken per fold once and the test fold's are left out.
    """
    out = None
    for repeat in range(repeats):
        marked = written(stratified_folds(rows, key, label, folds, 1 + repeat), "folds")
        base = {r.fold: (r.n, r.k) for r in marked.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("k")).collect()}  # a row per fold
        all_n, all_k = (sum(v[i] for v in base.values()) for i in (0, 1))
        labels = marked.select(F.col(key).alias("dst"), F.col(label).cast("double").alias("__l"), F.col("fold").alias("__f"))
        for name, edges in neighbours.items():
            table, used = marked, [list(features)] * folds
            if edges is not None:
                sums = [x for f in range(folds) for x in (F.sum(F.when(F.col("__f") != f, F.col("__l"))).alias(f"__k{f}"), F.count(F.when(F.col("__f") != f, 1)).alias(f"__n{f}"))]
                counts = edges.join(labels, "dst").groupBy(F.col("src").alias(key)).agg(*sums)
                prior = [(all_k - base[f][1]) / max(1, all_n - base[f][0]) if f in base else 0.0 for f in range(folds)]
                rate = [((F.coalesce(f"__k{f}", F.lit(0.0)) + prior[f]) / (F.coalesce(f"__n{f}", F.lit(0)) + 1)).alias(f"__rate{f}") for f in range(folds)]
                table = written(marked.join(counts, key, "left").select(key, label, "fold", *features, *rate), "rates")
                used = [[*features, f"__rate{f}"] for f in range(folds)]
            betas = fit_folds(table, used, label, "fold")
            scored = table.select(F.lit(name).alias("variant"), F.lit(repeat).alias("repeat"), "fold", key, label, _by_fold([logistic_score(u, b) for u, b in zip(used, betas, strict=True)]).alias("score"))
            out = scored if out is None else out.unionByName(scored)
    return out
