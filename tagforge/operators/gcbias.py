"""GC bias: smoothed log2 count against local GC per enzyme, and its removal from window rates."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_ANCHORS, MIN_DISTINCT = 100, 5


def lowess(x: np.ndarray, y: np.ndarray, weight: np.ndarray, frac: float = 0.4, robust: int = 2) -> np.ndarray:
    """Local lines with tricube weights over the nearest ``frac`` of the weight, reweighted by bisquare of the residuals; fitted values at x.

    ``weight`` is the number of equal points that a row stands for.  A point's tricube weight depends on its place alone, so the lines
    at all places follow from the moments of every place: one product of (places x places) weights with (places x moments) in each round.
    """
    places, at = np.unique(x, return_inverse=True)
    share, total = np.bincount(at, weight), weight.sum()
    d = np.abs(places[:, None] - places)
    order = np.argsort(d, axis=1, kind="stable")
    enough = np.minimum((share[order].cumsum(1) < np.floor(frac * total + 1e-10)).sum(1), len(places) - 1)
    reach = np.take_along_axis(np.take_along_axis(d, order, 1), enough[:, None], 1)
    near = np.where(reach > 0, np.clip(1 - (d / np.maximum(reach, 1e-9)) ** 3, 0, None) ** 3, d == 0)
    plain = np.bincount(at, weight * y) / share
    trust = np.ones(len(x))
    for turn in range(robust + 1):
        w, wy = np.bincount(at, weight * trust), np.bincount(at, weight * trust * y)
        sw = near @ w
        with np.errstate(divide="ignore", invalid="ignore"):
            mx, my = near @ (w * places) / sw, near @ wy / sw
            off = places - mx[:, None]
            sxx, sxy = (near * off * off) @ w, (near * off) @ wy
            line = np.where(sw > 0, my + np.where(sxx < 1e-12, 0.0, sxy / sxx * (places - mx)), plain)
        if turn < robust:
            r = np.abs(y - line[at])
            trust = np.clip(1 - (r / max(6 * _median(r, weight), 1e-12)) ** 2, 0, None) ** 2
    return line[at]


def _median(v: np.ndarray, times: np.ndarray) -> float:
    """Median of the values, each repeated as often as ``times`` says."""
    order = np.argsort(v)
    upto = np.cumsum(times[order])
    low, high = (v[order][np.searchsorted(upto, k, side="right")] for k in ((upto[-1] - 1) // 2, upto[-1] // 2))
    return float((low + high) / 2)


def _curve(frac: float, key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    """One enzyme's curve from its (gc, count, n) rows, shrunk by how much of the variance it explains."""
    g = g.sort_values(["gc", "count"])
    x, y, n = g["gc"].to_numpy(float), np.log2(g["count"].to_numpy(float) + 0.5), g["n"].to_numpy(float)
    places, first = np.unique(x, return_index=True)
    if n.sum() < MIN_ANCHORS or len(places) < MIN_DISTINCT:
        return pd.DataFrame({"enzyme": [], "gc": [], "log2_offset": [], "shrinkage": [], "r2": []}).astype({"enzyme": int})
    fit = lowess(x, y, n, frac)
    centre = (n * fit).sum() / n.sum()
    sse, sst = (n * (y - fit) ** 2).sum(), (n * (y - (n * y).sum() / n.sum()) ** 2).sum()
    r2 = float(1 - sse / sst) if sst > 0 else 0.0
    shrink = float(np.clip((r2 - min(n.sum(), 1.2 / frac) / n.sum()) / r2, 0, 1)) if r2 > 0 else 0.0
    return pd.DataFrame({"enzyme": key[0], "gc": places, "log2_offset": shrink * (fit[first] - centre), "shrinkage": shrink, "r2": r2})


def fit_curves(counts: DataFrame, frac: float = 0.4) -> DataFrame:
    """enzyme, gc, log2_offset, shrinkage, r2: pooled over all samples and genomes; enzymes with too few anchors or GC values have no curve.

    An enzyme's group holds one row per GC value, at most 201, and distinct count, whatever the number of anchors.
    """
    known = counts.where(F.col("usable") & F.col("gc").isNotNull() & F.col("count").isNotNull()).groupBy("enzyme", "gc", "count").agg(F.count("*").alias("n"))
    return known.groupBy("enzyme").applyInPandas(partial(_curve, frac), "enzyme int, gc double, log2_offset double, shrinkage double, r2 double")


def lookup(places: DataFrame, curves: DataFrame) -> DataFrame:
    """places (enzyme, gc) plus gc_offset: linear between the curve's points and flat beyond its ends; 0 for enzymes without a curve.

    A curve is one row with two sorted arrays of at most 201 points; its place is found by counting the points at or below.
    """
    points = F.array_sort(F.collect_list(F.struct("gc", "log2_offset")))
    one = curves.where(F.col("gc").isNotNull()).groupBy(F.col("enzyme").alias("__enzyme")).agg(points.alias("p")).select("__enzyme", F.col("p.gc").alias("__x"), F.col("p.log2_offset").alias("__y"))
    j = places.join(one, F.col("enzyme") == F.col("__enzyme"), "left")
    below = F.size(F.filter("__x", lambda g: g <= F.col("gc")))
    at = lambda c, i: F.get(F.col(c), i)
    low, high = F.greatest(below - 1, F.lit(0)), F.least(below, F.size("__x") - 1)
    step = F.try_divide(at("__y", high) - at("__y", low), at("__x", high) - at("__x", low))
    offset = at("__y", low) + F.coalesce(step * (F.col("gc") - at("__x", low)), F.lit(0.0))
    return j.select(*places.columns, F.coalesce(F.when(F.col("__x").isNotNull(), offset), F.lit(0.0)).alias("gc_offset"))


def offsets(counts: DataFrame, curves: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """counts plus gc_offset by :func:`lookup`; 0 for undefined GC.

    Curves are evaluated at each enzyme's distinct GC values, at most 201 from quantised GC, and joined back; they are read from ``source``
    where counts come from it by longer work.
    """
    places = (counts if source is None else source).where(F.col("gc").isNotNull()).select("enzyme", "gc").distinct()
    return counts.join(lookup(places, curves), ["enzyme", "gc"], "left").withColumn("gc_offset", F.coalesce("gc_offset", F.lit(0.0)))


def apply_offset(rates: DataFrame) -> DataFrame:
    """log2_rate less mean_gc_offset (none counts as 0); the raw value stays as log2_rate_raw.  gc_corrected says that the run corrects, enzyme curve or not."""
    raw = F.col("log2_rate")
    return rates.withColumn("log2_rate_raw", raw).withColumn("gc_corrected", F.lit(True)).withColumn("log2_rate", raw - F.coalesce("mean_gc_offset", F.lit(0.0)))
