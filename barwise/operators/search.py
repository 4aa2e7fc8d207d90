"""Search over a fixed catalogue of models: every candidate scored on every fold's validation window in one job.

A candidate is a model (regularisation of a logistic fit, or rate, number and depth of boosted trees, on a set of
features) and a minimum holding period.  Candidates share most of their work: a regularisation path starts from one
set of sums, of which a feature set is a sub-matrix; all boosted models of a fold grow side by side, and a model with
fewer trees is a stage of the longer one; holding periods and thresholds only change the ledger.  So the number of jobs
does not depend on the catalogue, and a fold's scores leave a task as one row per candidate.

A task holds one (symbol, fold): a window of sessions, which the calendar bounds.  Test rows are not read before the
winners are known; ``chosen_ledger`` then refits these alone.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.functions.rolling import safe_div
from barwise.operators import backtest as bt

BINS = 32  # value ranges of a feature in a tree
LEAST_LEAF = 10  # rows of a leaf

# The grids of the catalogue, in its order.
LOGISTIC = ((0.05, 0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0), (1, 3, 5, 10, 15, 20))
BOOSTING = ((0.01, 0.02, 0.03, 0.05, 0.08, 0.12), (50, 100, 150, 200), (1, 2, 3), (3, 5, 10))
MORE_LOGISTIC = ((0.01, 0.02, 0.04, 0.08, 0.16, 0.32, 0.64, 1.28, 2.56, 5.12, 10.24, 20.48), (1, 2, 3, 5, 8, 13, 20, 30))
MORE_BOOSTING = ((0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.06, 0.08, 0.10, 0.15), (50, 75, 100, 150, 200), (1, 2, 3, 4), (1, 2, 3, 5, 8, 13, 20, 30))


@dataclass(frozen=True)
class Candidate:
    candidate: int
    family: str
    strength: float  # C of a logistic fit, rate of boosted trees
    trees: int
    depth: int
    hold: int
    features: tuple[int, ...] | None = None  # places in the feature list; None: all

    @property
    def fit(self) -> tuple:
        return self.family, self.features, self.strength, self.trees, self.depth


def catalogue(sets: Iterable[tuple[int, ...] | None] = (None,)) -> list[Candidate]:
    """The grids in order, for each feature set: 1,960 candidates a set."""
    out: list[Candidate] = []
    for chosen in sets:
        for grid in (LOGISTIC, BOOSTING, MORE_LOGISTIC, MORE_BOOSTING):
            for values in product(*grid):
                strength, trees, depth, hold = values if len(values) == 4 else (values[0], 0, 0, values[1])
                out.append(Candidate(len(out), "boosting" if trees else "logistic", strength, trees, depth, hold, chosen))
    return out


def catalogue_table(spark: SparkSession, candidates: list[Candidate]) -> DataFrame:
    rows = [(c.candidate, c.family, c.strength, c.trees, c.depth, c.hold) for c in candidates]
    return spark.createDataFrame(rows, "candidate int, family string, strength double, trees int, depth int, hold int")


# ---- models of one window -------------------------------------------------------------------

def scaled(train: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both filled with the training medians and standardised by the filled training rows."""
    with np.errstate(all="ignore"):
        middle = np.nan_to_num(np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in train.T]))
    a, b = (np.where(np.isnan(x), middle, x) for x in (train, other))
    mean, sd = a.mean(axis=0), a.std(axis=0)
    unit = np.where(sd > 0, sd, 1.0)
    return np.where(sd > 0, (a - mean) / unit, 0.0), np.where(sd > 0, (b - mean) / unit, 0.0)


def logistic_paths(x: np.ndarray, y: np.ndarray, strengths: list[float], sets: list[tuple[int, ...]], steps: int = 60, tol: float = 1e-10) -> dict[tuple, np.ndarray]:
    """Coefficients (intercept first) of every (feature set, C); the first Newton step of all is solved from the same sums."""
    z = np.column_stack([np.ones(len(x)), x])
    gram, slope = z.T @ z / 4.0, z.T @ (y - 0.5)
    out = {}
    for chosen in sets:
        at = np.array([0, *[i + 1 for i in chosen]])
        own = z[:, at]
        for c in strengths:
            ridge = np.full(len(at), 1.0 / c)
            ridge[0] = 0.0
            b = np.linalg.solve(gram[np.ix_(at, at)] + np.diag(ridge + 1e-12), slope[at])
            for _ in range(steps):
                p = 1.0 / (1.0 + np.exp(-(own @ b)))
                move = np.linalg.solve((own * (p * (1.0 - p))[:, None]).T @ own + np.diag(ridge + 1e-12), own.T @ (y - p) - ridge * b)
                b = b + move
                if np.abs(move).max() < tol:
                    break
            else:
                raise ValueError(f"the logistic fit with C = {c} did not converge")
            out[chosen, c] = b
    return out


def boosted_paths(x: np.ndarray, y: np.ndarray, new: np.ndarray, models: list[tuple[float, int]], stages: list[int]) -> dict[tuple, np.ndarray]:
    """Probability of each row of ``new`` after each stage, for models (rate, depth) grown side by side.

    Trees split value ranges of the features by the gain of the residuals' squares; a leaf takes a Newton step.
    """
    models = sorted(models, key=lambda m: (-m[1], m[0]))  # deeper ones first: a level works on a prefix
    rate, depth = np.array([m[0] for m in models]), np.array([m[1] for m in models])
    edges = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) for c in x.T]
    codes, new_codes = (np.stack([np.searchsorted(e, c, "right") for e, c in zip(edges, v.T)]) for v in (x, new))
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    f, g = (np.full((len(models), len(v)), np.log(share / (1 - share))) for v in (x, new))
    wide, out = 1 << int(depth.max()), {}
    for tree in range(1, max(stages) + 1):
        p = 1.0 / (1.0 + np.exp(-f))
        rest = y - p
        node, new_node = np.zeros(f.shape, np.int64), np.zeros(g.shape, np.int64)
        for level in range(depth.max()):
            live, k = int((depth > level).sum()), 1 << level
            place = np.arange(live)[:, None] * k + node[:live]
            best, feature, cut = np.full(live * k, -np.inf), np.zeros(live * k, np.int64), np.full(live * k, BINS)
            for j, code in enumerate(codes):
                at = (place * BINS + code).ravel()
                total = np.bincount(at, weights=rest[:live].ravel(), minlength=live * k * BINS).reshape(-1, BINS).cumsum(axis=1)
                count = np.bincount(at, minlength=live * k * BINS).reshape(-1, BINS).cumsum(axis=1)
                low, n_low, high, n_high = total[:, :-1], count[:, :-1], total[:, -1:] - total[:, :-1], count[:, -1:] - count[:, :-1]
                fits = (n_low >= LEAST_LEAF) & (n_high >= LEAST_LEAF)
                gain = np.where(fits, low ** 2 / np.maximum(n_low, 1) + high ** 2 / np.maximum(n_high, 1), -np.inf)
                top = gain.argmax(axis=1)
                value = gain[np.arange(len(top)), top]
                better = value > best
                best, feature, cut = np.where(better, value, best), np.where(better, j, feature), np.where(better, top, cut)
            node[:live] = 2 * node[:live] + (codes[feature[place], np.arange(len(x))] > cut[place])
            new_place = np.arange(live)[:, None] * k + new_node[:live]
            new_node[:live] = 2 * new_node[:live] + (new_codes[feature[new_place], np.arange(len(new))] > cut[new_place])
        leaf, new_leaf = (np.arange(len(models))[:, None] * wide + v for v in (node, new_node))
        step = np.bincount(leaf.ravel(), weights=rest.ravel(), minlength=len(models) * wide) / np.maximum(
            np.bincount(leaf.ravel(), weights=(p * (1.0 - p)).ravel(), minlength=len(models) * wide), 1e-12) * np.repeat(rate, wide)
        f, g = f + step[leaf], g + step[new_leaf]
        if tree in stages:
            done = 1.0 / (1.0 + np.exp(-g))
            out.update({(m[0], tree, m[1]): done[i] for i, m in enumerate(models)})
    return out


def probabilities(train: np.ndarray, y: np.ndarray, new: np.ndarray, candidates: list[Candidate]) -> dict[tuple, np.ndarray]:
    """Probabilities of ``new`` for every distinct model of the candidates."""
    a, b = scaled(train, new)
    every = tuple(range(train.shape[1]))
    sets = sorted({c.features or every for c in candidates})
    out = {}
    for chosen in sets:
        own = [c for c in candidates if (c.features or every) == chosen]
        strengths = sorted({c.strength for c in own if c.family == "logistic"})
        if strengths:
            told = logistic_paths(a, y, strengths, [chosen])
            z = np.column_stack([np.ones(len(b)), b[:, list(chosen)]])
            found = {("logistic", c): 1.0 / (1.0 + np.exp(-(z @ told[chosen, c]))) for c in strengths}
            out.update({c.fit: found["logistic", c.strength] for c in own if c.family == "logistic"})
        trees = [c for c in own if c.family == "boosting"]
        if trees:
            grown = boosted_paths(a[:, list(chosen)], y, b[:, list(chosen)], sorted({(c.strength, c.depth) for c in trees}), sorted({c.trees for c in trees}))
            out.update({c.fit: grown[c.strength, c.trees, c.depth] for c in trees})
    return out


# ---- ledgers of one window --------------------------------------------------------------------

def held(wish: np.ndarray, hold: int, lag: int) -> np.ndarray:
    """Wishes (bars, columns) as they are acted on: ``lag`` bars later, with a change every ``hold`` bars at most (the first one is free)."""
    staged = np.zeros_like(wish)
    staged[lag:] = wish[:-lag]
    now, since = np.zeros(wish.shape[1]), np.full(wish.shape[1], -hold)
    for t, row in enumerate(staged.copy()):
        change = (row != now) & (t - since >= hold)
        now, since = np.where(change, row, now), np.where(change, t, since)
        staged[t] = now
    return staged


def ledgers(wish: np.ndarray, hold: int, scale: np.ndarray, fwd: np.ndarray, cfg: bt.Execution) -> tuple[np.ndarray, np.ndarray]:
    """Net returns and turnover (bars, columns) of wishes."""
    position = np.clip(held(wish, hold, bt.EXECUTION_LAG + cfg.delay) * scale[:, None], -cfg.max_position, cfg.max_position)
    turnover = np.abs(np.diff(position, axis=0, prepend=np.zeros((1, wish.shape[1]))))
    return position * np.nan_to_num(fwd)[:, None] - turnover * (cfg.fee_bps + cfg.slippage_bps) / 10000.0, turnover


def _window(pdf: pd.DataFrame, features: list[str], split: str, ts: str, label: str) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
    fit = pdf[(pdf["split"] == "train") & pdf[label].notna()].sort_values(ts)
    rows = pdf[pdf["split"] == split].sort_values(ts)
    return fit[features].to_numpy(float), fit[label].to_numpy(float), rows


def _typed(df: DataFrame, columns) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def validation_scores(labelled: DataFrame, features: list[str], candidates: list[Candidate], thresholds: list[float], keys=("symbol", "fold"),
                      cfg: bt.Execution = bt.Execution(), label: str = "label", fwd: str = "fwd_ret", ts: str = "ts") -> DataFrame:
    """Per key and candidate: threshold, and Sharpe, drawdown, trades and sums of its net returns on the validation rows.

    ``labelled`` has split ("train", "val"), the features, label, forward return and a causal ``scale``.  The threshold
    of a candidate is the one of the best Sharpe, then drawdown, then the lower one; the middle one when none trades.
    """
    keys = list(keys)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        train, y, rows = _window(pdf, features, "val", ts, label)
        if not len(rows) or not len(y):
            return pd.DataFrame(columns=[*keys, "candidate", "threshold", "sharpe", "max_dd", "trades", "n", "total", "squares"])
        told = probabilities(train, y, rows[features].to_numpy(float), candidates)
        names = list(told)
        p = np.column_stack([told[k] for k in names])
        wish = (p[:, None, :] > np.array(thresholds)[None, :, None]).astype(float).reshape(len(rows), -1)  # threshold by threshold
        parts = {}
        for hold in {c.hold for c in candidates}:
            net, turnover = ledgers(wish, hold, rows["scale"].to_numpy(float), rows[fwd].to_numpy(float), cfg)
            with np.errstate(all="ignore"):
                sd = net.std(axis=0, ddof=1)
                sharpe = np.where(sd > 0, net.mean(axis=0) / sd * np.sqrt(252.0), np.nan)
            equity = np.cumprod(1.0 + net, axis=0)
            drawdown = (equity / np.maximum.accumulate(np.maximum(equity, 1.0), axis=0) - 1.0).min(axis=0)
            trades = (turnover > 1e-9).sum(axis=0)
            shaped = [v.reshape(len(thresholds), len(names)) for v in (sharpe, drawdown, trades, net.sum(axis=0), (net * net).sum(axis=0))]
            usable = ~np.isnan(shaped[0]) & (shaped[2] > 0)
            best = np.full(len(names), len(thresholds) // 2)
            found = np.full((2, len(names)), -np.inf)
            for i in range(len(thresholds)):  # ascending, and only a better one counts: ties go to the lower threshold
                s, d = np.round(shaped[0][i], 12), np.round(shaped[1][i], 12)
                better = usable[i] & ((s > found[0]) | ((s == found[0]) & (d > found[1])))
                best, found = np.where(better, i, best), np.where(better, np.stack([s, d]), found)
            parts[hold] = best, [v[best, np.arange(len(names))] for v in shaped]
        column = {k: i for i, k in enumerate(names)}
        at = [(parts[c.hold], column[c.fit]) for c in candidates]
        return pd.DataFrame({
            **{k: pdf[k].iat[0] for k in keys}, "candidate": [c.candidate for c in candidates], "threshold": [thresholds[b[i]] for (b, _), i in at],
            **{name: [v[j][i] for (_, v), i in at] for j, name in enumerate(("sharpe", "max_dd", "trades", "total", "squares"))}, "n": len(rows)})
    wanted = [*keys, "split", ts, *features, label, fwd, "scale"]
    rows = labelled.where("split IN ('train', 'val')").select(*wanted).withColumn(label, F.col(label).cast("double"))
    schema = f"{_typed(labelled, keys)}, candidate int, threshold double, sharpe double, max_dd double, trades long, n long, total double, squares double"
    return rows.groupBy(*keys).applyInPandas(score, schema).withColumn("sharpe", F.when(~F.isnan("sharpe"), F.col("sharpe")))


def chosen_ledger(labelled: DataFrame, chosen: DataFrame, features: list[str], candidates: list[Candidate], keys=("symbol", "fold"), split: str = "test",
                  cfg: bt.Execution = bt.Execution(), label: str = "label", fwd: str = "fwd_ret", ts: str = "ts") -> DataFrame:
    """Ledger on ``split`` of the candidates in ``chosen`` (keys, candidate, threshold), refitted; each path on its own window."""
    keys = list(keys)
    by_number = {c.candidate: c for c in candidates}

    def score(pdf: pd.DataFrame, picks: pd.DataFrame) -> pd.DataFrame:
        out = []
        train, y, rows = _window(pdf, features, split, ts, label)
        if len(rows) and len(y):
            for number, threshold in zip(picks["candidate"], picks["threshold"]):
                c = by_number[int(number)]
                p = probabilities(train, y, rows[features].to_numpy(float), [c])[c.fit]
                staged = held((p > threshold).astype(float)[:, None], c.hold, bt.EXECUTION_LAG + cfg.delay)[:, 0]
                out.append(rows[[*keys, ts, fwd, "scale"]].assign(candidate=c.candidate, p=p, staged=staged))
        return pd.concat(out) if out else pd.DataFrame(columns=[*keys, ts, fwd, "scale", "candidate", "p", "staged"])
    rows = labelled.where(F.col("split").isin("train", split)).select(*keys, "split", ts, *features, fwd, "scale", F.col(label).cast("double").alias(label))
    picked = chosen.select(*[F.col(k).alias(f"_{k}") for k in keys], "candidate", "threshold")  # own names: both may stem from one table
    told = rows.groupBy(*keys).cogroup(picked.groupBy(*[f"_{k}" for k in keys])).applyInPandas(
        score, f"{_typed(labelled, [*keys, ts, fwd, 'scale'])}, candidate int, p double, staged double")
    told = told.withColumn(fwd, F.when(~F.isnan(fwd), F.col(fwd)))
    return bt.price(told, cfg, (*keys, "candidate"), ts, fwd)


# ---- selection --------------------------------------------------------------------------------

def pooled_sharpe(scores: DataFrame, keys) -> DataFrame:
    """Sharpe of each candidate's validation returns of all folds together, from their sums."""
    sums = scores.groupBy(*keys, "candidate").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")])
    variance = (F.col("squares") - F.col("total") * F.col("total") / F.col("n")) / (F.col("n") - 1)
    sd = F.when(variance > 1e-18, F.sqrt(variance))
    return sums.withColumn("sharpe", safe_div(F.col("total") / F.col("n"), sd) * np.sqrt(252.0)).select(*keys, "candidate", "n", "sharpe")
