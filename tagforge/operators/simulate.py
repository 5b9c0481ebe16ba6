"""Simulated counts along a genome with a planted gradient, and the error of the estimators over a grid of conditions."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagforge.functions.seq import circular_distance
from tagforge.operators.mixture import truncated_rate
from tagforge.operators.vfit import around, fit_v


def log2_copy(position, ori, length, log2_ptr):
    """Column: log2 copy number above the terminus at a position."""
    return log2_ptr * (1 - circular_distance(position, ori, length) / (length / 2))


# The genome and the anchor counts of the reference's simulations.
LENGTH, ORI = 4_641_652, 3_923_883
SINGLE, SKETCH, UNION = 2_932, 18_600, 28_381


def anchors(n: int, length: int, even: bool, seed: int) -> np.ndarray:
    return (np.arange(n) * (length / n)).astype(np.int64) if even else np.sort(np.random.default_rng(seed).integers(0, length, n))


def counts(position: np.ndarray, length: float, ori: float, log2_ptr: float, depth: float, sigma: float, seed: int) -> np.ndarray:
    """Poisson counts around the origin's depth times copy number, with unit-mean log-normal efficiencies."""
    random = np.random.default_rng(seed)
    copy = 2 ** (-log2_ptr * around(position, ori, length) / (length / 2))
    return random.poisson(depth * copy * (random.lognormal(-sigma * sigma / 2, sigma, len(position)) if sigma > 0 else 1.0))


def binned(position: np.ndarray, count: np.ndarray, bin_bp: int = 25_000, least: int = 3):
    """Zero-truncated Poisson rate per bin of at least ``least`` positives: (mean position, log2 rate, error)."""
    bins = np.asarray(position // bin_bp, np.int64)
    got = count > 0
    total, n = np.bincount(bins, count), np.bincount(bins[got], minlength=bins.max() + 1)
    middle = np.bincount(bins, position) / np.maximum(np.bincount(bins), 1)
    rows = []
    for b in np.flatnonzero(n >= least):
        rate = truncated_rate(float(total[b] / n[b]))
        if rate > 0:
            rows.append((middle[b], np.log2(rate), 1 / (np.sqrt(max(rate, 1e-9) * n[b]) * np.log(2))))
    return np.array(rows).reshape(-1, 3)


def sorted_line(y: np.ndarray, trim: float = 0.05) -> float:
    """Slope of the sorted values on rank without the outer ``trim`` of each end, times the number of values."""
    cut = int(len(y) * trim)
    v = np.sort(y)[cut : len(y) - cut]
    return float(np.polyfit(np.arange(len(v), dtype=float), v, 1)[0]) * len(y)


def estimate(position, count, length: float, estimator: str) -> float | None:
    b = binned(position, count)
    if len(b) < 10:
        return None
    return fit_v(b[:, 0], b[:, 1], b[:, 2], length).get("log2_ptr") if estimator == "v" else sorted_line(b[:, 1])


def _runs(length: int, ori: int, estimator: str, frames):
    made_sets: dict = {}
    for frame in frames:
        made = []
        for r in frame.itertuples():
            key = (int(r.n_anchors), bool(r.even), int(r.set_seed))
            if key not in made_sets:
                made_sets[key] = anchors(key[0], length, key[1], key[2])
            p = made_sets[key]
            made.append(estimate(p, counts(p, length, ori, r.truth, r.depth, r.sigma, int(r.seed) + 1000 * int(r.rep)), length, estimator))
        yield frame.assign(estimate=pd.Series(made, dtype="float64", index=frame.index))


def run_grid(spark: SparkSession, arms: list[tuple[str, int, bool, int, float, float]], truths: list[float], reps: int = 150, estimator: str = "sorted", length: int = LENGTH, ori: int = ORI, seed: int = 0) -> DataFrame:
    """One row per condition and repeat, each simulated on its own; an arm is (set, anchors, evenly spaced, seed of the anchors, depth, sigma)."""
    grid = spark.createDataFrame([(*arm, float(t)) for arm in arms for t in truths], "set string, n_anchors int, even boolean, set_seed int, depth double, sigma double, truth double")
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"), F.lit(seed).alias("seed"))
    schema = "set string, n_anchors int, even boolean, set_seed int, depth double, sigma double, truth double, rep int, seed int, estimate double"
    return grid.repartition(32, "set", "depth", "sigma", "truth", "rep").mapInPandas(partial(_runs, length, ori, estimator), schema)


def route_a(coverages: tuple = (0.5, 1.0, 2.0, 5.0, 10.0), seed: int = 0) -> list[tuple]:
    """One enzyme, a random sketch and the union of enzymes at equal coverage; 0.8 of it reaches a site."""
    sets = [("single", SINGLE, False, seed + 1), ("random", SKETCH, False, seed + 2), ("union", UNION, True, seed + 3)]
    return [(*s, 0.8 * c, 0.15) for s in sets for c in coverages]


def route_b(sigmas: tuple = (0.3, 0.6), depth: float = 50.0, seed: int = 0) -> list[tuple]:
    """One enzyme deep, the union at the same number of reads, and the union at full depth."""
    single, union = (SINGLE, False, seed + 1), (UNION, True, seed + 3)
    return [arm for s in sigmas for arm in (("single", *single, depth, s), ("union_same_budget", *union, depth * SINGLE / UNION, s), ("union_full_budget", *union, depth, s))]


def errors(runs: DataFrame) -> DataFrame:
    """Bias, RMSE and population standard deviation per condition."""
    e = F.col("estimate") - F.col("truth")
    return runs.groupBy("set", "n_anchors", "depth", "sigma", "truth").agg(F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.stddev_pop("estimate").alias("sd"), F.count("estimate").alias("n"), F.count("*").alias("n_reps"))
