"""Hidden Markov models over long sequences of observations, in blocks.

A sequence (a chromosome's bins) isn't one task. Each block of positions becomes one small matrix, the score of going from any state
before it to any state at its end; these matrices are chained for each sequence, and then every block is worked on by itself
between known ends. Two shuffles by (sequence, block); what is chained is states squared numbers a block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..lineage import written

BLOCK = 4096


@dataclass(frozen=True)
class Model:
    """start and trans hold probabilities; params is what emit needs; emit(x, params) is log likelihoods, rows by states."""

    start: np.ndarray
    trans: np.ndarray
    params: tuple
    emit: Callable[[np.ndarray, tuple], np.ndarray]


def gaussian(x: np.ndarray, params: tuple) -> np.ndarray:
    """params: a (mean, covariance) for each state."""
    out = []
    for mean, cov in params:
        cov = np.atleast_2d(np.asarray(cov, dtype=float))
        d = x - np.asarray(mean, dtype=float)
        out.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(2 * np.pi * cov)[1]))
    return np.stack(out, axis=1)


def poisson(x: np.ndarray, params: tuple) -> np.ndarray:
    """params: a rate for each column, for each state; terms that all states share are left out."""
    rate = np.maximum(np.asarray(params, dtype=float), 1e-9)
    return x @ np.log(rate).T - rate.sum(axis=1)


def negative_binomial(x: np.ndarray, params: tuple) -> np.ndarray:
    """params: (mean of each column, dispersion) for each state. The ratio of gamma functions is a table over the counts."""
    x = np.maximum(x.astype(np.int64), 0)
    seen, at = np.unique(x, return_inverse=True)
    out = []
    for mean, alpha in params:
        mean, r = np.maximum(np.asarray(mean, dtype=float), 1e-9), 1 / max(float(alpha), 1e-9)
        rise = np.array([_log_rising(r, int(v)) for v in seen])[at.reshape(x.shape)]
        out.append((rise + x * np.log(mean / (mean + r)) + r * np.log(r / (mean + r))).sum(axis=1))
    return np.stack(out, axis=1)


def binomial(x: np.ndarray, params: tuple) -> np.ndarray:
    """params: (trials of each column, chance of each column, sample of each column) for each state. Columns of one sample are its
    replicates and share its chance. Counts above the trials are as unlikely as any can be."""
    from math import lgamma

    seen, at = np.unique(x, return_inverse=True)
    out = []
    for trials, chance, _ in params:
        trials, chance = np.asarray(trials, dtype=float), np.clip(np.asarray(chance, dtype=float), 1e-12, 1 - 1e-12)
        ways = np.empty((len(seen), len(trials)))
        for c, n in enumerate(trials):
            ways[:, c] = [lgamma(n + 1) - lgamma(v + 1) - lgamma(n - v + 1) if 0 <= v <= n else -1e6 for v in seen]
        choose = ways[at.reshape(x.shape), np.arange(x.shape[1])]
        out.append((choose + x * np.log(chance) + (trials - x) * np.log1p(-chance)).sum(axis=1))
    return np.stack(out, axis=1)


def binomial_start(df: DataFrame, x: str, y: str, trials: int) -> tuple:
    """Parameters of three states of two samples: background, more in x, more in y. In a state with more the chance of its sample is the
    sample's most frequent count (the smallest of equal ones) over the trials; every other chance is one over the trials."""
    often = lambda c: float(df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("v", F.struct("n", -F.col("v")))).first()[0] or 0)
    low, both = 1 / trials, np.array([trials, trials], dtype=float)
    return tuple((both, np.array(p), np.array([0, 1])) for p in ((low, low), (often(x) / trials, low), (low, often(y) / trials)))


def _log_rising(r: float, k: int) -> float:
    from math import lgamma

    return lgamma(k + r) - lgamma(r)


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def _log(p) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(np.asarray(p, dtype=float))


def _blocks(df: DataFrame, key: str, order: str, values: list[str], block: int, label: str | None = None) -> DataFrame:
    """Rows by block; null values count as 0. _label is the column label, -1 where it is null or there is none."""
    known = F.lit(-1) if label is None else F.coalesce(F.col(label).cast("int"), F.lit(-1))
    rows = df.select(key, order, known.alias("_label"), F.array(*(F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values)).alias("_x"))
    return rows.withColumn("_block", F.floor(F.col(order) / block).cast("bigint"))


def _fields(df: DataFrame, key: str, *more: StructField) -> StructType:
    return StructType([df.schema[key], StructField("_block", LongType()), *more])


def _matrices(rows: DataFrame, key: str, order: str, model: Model, best: bool) -> DataFrame:
    """(key, _block, n, m): m is the log score from the state before the block to its last one, of the best path or of all."""
    join = (lambda a: a.max(axis=1)) if best else (lambda a: _logsum(a, 1))
    trans = _log(model.trans)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        like = model.emit(np.stack(pdf["_x"].to_numpy()), model.params)
        m = trans + like[0]
        for row in like[1:]:
            m = join(m[:, :, None] + trans[None]) + row
        first = _log(model.start) + like[0]  # in place of the step from before, should the block be the first
        for row in like[1:]:
            first = join((first[:, None] + trans)[None])[0] + row
        return pd.DataFrame({key: pdf[key].iloc[:1], "_block": pdf["_block"].iloc[:1], "m": [np.vstack([m, first]).ravel().tolist()]})

    return rows.groupBy(key, "_block").applyInPandas(work, _fields(rows, key, StructField("m", ArrayType(DoubleType()))))


def decode(df: DataFrame, key: str, order: str, values: list[str], model: Model, block: int = BLOCK) -> DataFrame:
    """(key, order, state): the likeliest path of each sequence. order is a whole number, unique inside key; rows that follow one
    another in it are neighbours, whatever gap lies between. An empty input gives no rows."""
    rows, s = _blocks(df, key, order, values, block), len(model.start)
    trans = _log(model.trans)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        ms = [np.asarray(m).reshape(s + 1, s) for m in pdf["m"]]
        score, back = ms[0][s], []
        for m in ms[1:]:
            step = score[:, None] + m[:s]
            back.append(step.argmax(axis=0))
            score = step.max(axis=0)
        last = [int(score.argmax())]
        for b in reversed(back):
            last.append(int(b[last[-1]]))
        last.reverse()
        return pd.DataFrame({key: pdf[key], "_block": pdf["_block"], "before": [-1, *last[:-1]], "last": last})

    ends = _matrices(rows, key, order, model, True).groupBy(key).applyInPandas(choose, _fields(rows, key, StructField("before", IntegerType()), StructField("last", IntegerType())))

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        like = model.emit(np.stack(pdf["_x"].to_numpy()), model.params)
        before = int(pdf["before"].iloc[0])
        score, back = (_log(model.start) if before < 0 else trans[before]) + like[0], []
        for row in like[1:]:
            step = score[:, None] + trans
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + row
        states = [int(pdf["last"].iloc[0])]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        return pd.DataFrame({key: pdf[key], order: pdf[order], "state": states[::-1]})

    fields = StructType([rows.schema[key], rows.schema[order], StructField("state", IntegerType())])
    return rows.join(ends, [key, "_block"]).groupBy(key, "_block").applyInPandas(path, fields)


def clamped(post: np.ndarray, label: np.ndarray, state: int) -> np.ndarray:
    """Chances of states at positions, those with label 1 all of the state, those with label 0 without it; other labels change nothing.
    A position that only the state explained and that is labelled 0 has no state at all."""
    post = post.copy()
    post[label == 0, state] = 0.0
    total = post.sum(axis=1, keepdims=True)
    post = np.where((label == 0)[:, None], post / np.where(total > 0, total, 1.0), post)
    post[label == 1] = np.eye(post.shape[1])[state]
    return post


def expectations(df: DataFrame, key: str, order: str, values: list[str], model: Model, block: int = BLOCK, clamp: tuple[str, int] | None = None) -> DataFrame:
    """(key, _block, like, stats): expected counts of a block under the model. like is the log likelihood of its sequence, on the
    first block only; stats is starts, transitions, occupancy, then sums of values and of their products by state.

    clamp: a column of labels and a state, see clamped(); starts, occupancy and sums take the clamped chances, transitions and the
    likelihood those of the model."""
    rows, s, d = _blocks(df, key, order, values, block, clamp and clamp[0]), len(model.start), len(values)
    trans = _log(model.trans)

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        ms = [np.asarray(m).reshape(s + 1, s) for m in pdf["m"]]
        ahead, behind = [ms[0][s]], [np.zeros(s)]
        for m in ms[1:]:
            ahead.append(_logsum(ahead[-1][:, None] + m[:s], 0))
        for m in reversed(ms[1:]):
            behind.append(_logsum(m[:s] + behind[-1], 1))
        total = float(_logsum(ahead[-1], 0))
        return pd.DataFrame({key: pdf[key], "_block": pdf["_block"], "before": [[], *(a.tolist() for a in ahead[:-1])], "after": [b.tolist() for b in reversed(behind)], "total": total})

    double = ArrayType(DoubleType())
    bounds = _matrices(rows, key, order, model, False).groupBy(key).applyInPandas(ends, _fields(rows, key, StructField("before", double), StructField("after", double), StructField("total", DoubleType())))

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = np.stack(pdf["_x"].to_numpy())
        like, n = model.emit(x, model.params), len(pdf)
        before, total = np.asarray(pdf["before"].iloc[0]), float(pdf["total"].iloc[0])
        ahead, behind = np.empty((n, s)), np.empty((n, s))
        ahead[0] = (_logsum(before[:, None] + trans, 0) if len(before) else _log(model.start)) + like[0]
        for i in range(1, n):
            ahead[i] = _logsum(ahead[i - 1][:, None] + trans, 0) + like[i]
        behind[-1] = np.asarray(pdf["after"].iloc[0])
        for i in range(n - 2, -1, -1):
            behind[i] = _logsum(trans + like[i + 1] + behind[i + 1], 1)
        post = np.exp(ahead + behind - total)
        steps = np.exp(ahead[:-1, :, None] + trans[None] + (like[1:] + behind[1:])[:, None, :] - total).sum(axis=0)
        if len(before):
            steps = steps + np.exp(before[:, None] + trans + (like[0] + behind[0])[None] - total)
        if clamp is not None:
            post = clamped(post, pdf["_label"].to_numpy(), clamp[1])
        stats = np.concatenate([np.zeros(s) if len(before) else post[0], steps.ravel(), post.sum(axis=0), (post.T @ x).ravel(), np.einsum("is,ij,ik->sjk", post, x, x).ravel()])
        return pd.DataFrame({key: pdf[key].iloc[:1], "_block": pdf["_block"].iloc[:1], "like": [0.0 if len(before) else total], "stats": [stats.tolist()]})

    return rows.join(bounds, [key, "_block"]).groupBy(key, "_block").applyInPandas(count, _fields(rows, key, StructField("like", DoubleType()), StructField("stats", double)))


def _by_sample(chance: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Each column's chance as the mean over the columns of its sample."""
    sample = np.asarray(sample)
    return np.array([chance[sample == g].mean() for g in sample])


def fit(df: DataFrame, key: str, order: str, values: list[str], model: Model, rounds: int = 10, mirror: tuple[np.ndarray, np.ndarray] | None = None, block: int = BLOCK, clamp: tuple[str, int] | None = None) -> tuple[Model, list[float]]:
    """(model, log likelihood before each round) by expectation maximisation; only sums of a fixed length reach the driver.

    Gaussian states get new means and covariances, count states new means (dispersions stay), binomial ones new chances, one for all
    replicates of a sample. clamp: labels that fix the chances of a state at some positions, see expectations(). mirror: an order of states and one
    of columns under which the model is symmetric, as gains and losses of two samples are; sums are averaged with their image."""
    s, d, likes = len(model.start), len(values), []
    df = written(df.select(key, order, *dict.fromkeys([*values, *([clamp[0]] if clamp else [])])))  # each round reads it again
    cuts = np.cumsum([s, s * s, s, s * d])
    for _ in range(rounds):
        each = expectations(df, key, order, values, model, block, clamp)
        sums = each.select("like", F.posexplode("stats").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("like").alias("like")).collect()
        if not sums:
            return model, likes
        likes.append(sums[0]["like"])
        stats = np.zeros(len(sums))
        for row in sums:
            stats[row["i"]] = row["v"]
        start, steps, n, x, xx = np.split(stats, cuts)
        steps, x, xx = steps.reshape(s, s), x.reshape(s, d), xx.reshape(s, d, d)
        if mirror is not None:
            p, q = mirror
            start, n, steps = (start + start[p]) / 2, (n + n[p]) / 2, (steps + steps[p][:, p]) / 2
            x, xx = (x + x[p][:, q]) / 2, (xx + xx[p][:, q][:, :, q]) / 2
        seen = np.maximum(n, 1e-12)
        mean = x / seen[:, None]
        if model.emit is gaussian:
            params = tuple((mean[k], xx[k] / seen[k] - np.outer(mean[k], mean[k]) + 1e-6 * np.eye(d)) for k in range(s))
        elif model.emit is poisson:
            params = tuple(mean)
        elif model.emit is binomial:
            params = tuple((trials, _by_sample(mean[k] / trials, sample), sample) for k, (trials, _, sample) in enumerate(model.params))
        else:
            params = tuple((mean[k], model.params[k][1]) for k in range(s))
        rows = steps.sum(axis=1, keepdims=True)
        model = replace(model, start=start / start.sum(), trans=np.where(rows > 0, steps / np.where(rows > 0, rows, 1), model.trans), params=params)
    return model, likes


def transitions(df: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """(state, next, n, p): steps between labels of positions one apart; an equi-join on the next position, no window."""
    rows = df.select(key, F.col(order).alias("_at"), F.col(label).alias("state"))
    after = rows.select(F.col(key), (F.col("_at") - 1).alias("_at"), F.col("state").alias("next"))
    n = rows.join(after, [key, "_at"]).groupBy("state", "next").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("state").agg(F.sum("n").alias("_t"))
    return n.join(total, "state").select("state", "next", "n", (F.col("n") / F.col("_t")).alias("p"))


def emissions(df: DataFrame, label: str, x: str, y: str) -> DataFrame:
    """(state, n, means, variances and covariance of two signals): what a labelled track says of each state; sample moments."""
    return df.groupBy(F.col(label).alias("state")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.var_samp(x).alias("var_x"), F.var_samp(y).alias("var_y"), F.covar_samp(x, y).alias("cov"))
