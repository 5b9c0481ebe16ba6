"""Gradient fits that are sums: weighted lines, V-fits at known or searched origins, rank slopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagforge.functions.seq import circular_distance


def line(x: Column, y: Column, w: Column) -> list[Column]:
    """Sums of a weighted line; :func:`solve` turns them into the fit."""
    return [F.count(y).alias("n"), F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * x * y).alias("sxy"), F.sum(w * y * y).alias("syy")]


def solve(sums: DataFrame) -> DataFrame:
    """sums plus slope, intercept, sse, r2, reduced_chi2 and the slope's scaled standard error."""
    c = F.col
    sxx, sxy, syy = c("sxx") - c("sx") * c("sx") / c("sw"), c("sxy") - c("sx") * c("sy") / c("sw"), c("syy") - c("sy") * c("sy") / c("sw")
    slope = F.try_divide(sxy, sxx)
    out = sums.withColumn("slope", F.when(sxx > 1e-12, slope)).withColumn("intercept", (c("sy") - c("slope") * c("sx")) / c("sw"))
    out = out.withColumn("sse", F.greatest(syy - c("slope") * sxy, F.lit(0.0)))
    out = out.withColumn("r2", F.when(syy > 0, 1 - c("sse") / syy)).withColumn("reduced_chi2", F.when(c("n") > 2, c("sse") / (c("n") - 2)))
    return out.withColumn("slope_se", F.sqrt(c("reduced_chi2") / sxx))


def v_fit(rates: DataFrame, groups: list[str], x: str, y: str, se: str, ori: Column, length: Column) -> DataFrame:
    """Line of ``y`` on distance from ``ori``, weights 1/se^2; log2_ptr is minus the slope times half the genome."""
    d = circular_distance(F.col(x), ori, length)
    ok = rates.where(F.col(y).isNotNull() & (F.col(se) > 0)).withColumn("d", d.cast("double")).withColumn("w", 1 / (F.col(se) * F.col(se))).withColumn("half", length / 2.0)
    s = ok.groupBy(*groups).agg(*line(F.col("d"), F.col(y), F.col("w")), F.max("half").alias("half"))
    return solve(s).withColumn("log2_ptr", -F.col("slope") * F.col("half")).withColumn("se", F.col("slope_se") * F.col("half"))


def origin_grid(rates: DataFrame, groups: list[str], x: str, y: str, length: int, steps: int = 180) -> DataFrame:
    """groups, ori, slope, sse: unweighted line at every grid origin.  The grid is a constant array, exploded per row and summed map-side."""
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i * (length / steps)))
    c = rates.where(F.col(y).isNotNull()).select(*groups, F.col(x).alias("x"), F.col(y).alias("y"), grid.alias("ori"))
    c = c.withColumn("d", circular_distance(F.col("x"), F.col("ori"), F.lit(float(length))))
    return solve(c.groupBy(*groups, "ori").agg(*line(F.col("d"), F.col("y"), F.lit(1.0))))


def with_prior(grid: DataFrame, position: Column, sd: Column, length: int) -> DataFrame:
    """grid with a penalty on sse for origins away from an annotated one: half the squared distance in ``sd`` times the residual variance; none where position or sd is null."""
    far = circular_distance(F.col("ori"), position, F.lit(float(length))) / sd
    return grid.withColumn("sse", F.col("sse") * (1 + F.coalesce(F.when(sd > 0, far * far / (2 * F.col("n"))), F.lit(0.0))))


def best_origin(grid: DataFrame, groups: list[str], min_windows: int = 3) -> DataFrame:
    """The downhill origin of least squared error, the first on ties; log2_ptr not yet scaled."""
    down = grid.where((F.col("slope") < 0) & (F.col("n") >= min_windows))
    return down.groupBy(*groups).agg(F.min_by(F.struct("ori", "slope", "sse", "n"), F.struct(F.round("sse", 9), "ori")).alias("b")).select(*groups, "b.*")


def origin_confidence(grid: DataFrame, groups: list[str], length: int) -> DataFrame:
    """Mean resultant length of the origins, weighted by exp(-n/2 ln(sse / least sse))."""
    g = grid.where("slope < 0").withColumn("low", F.min("sse").over(W.partitionBy(*groups)))
    w = F.exp(-F.col("n") / 2.0 * F.log(F.col("sse") / F.col("low")))
    angle = F.col("ori") * (2 * 3.141592653589793 / length)
    s = g.withColumn("w", w).groupBy(*groups).agg(F.sum(F.col("w") * F.cos(angle)).alias("c"), F.sum(F.col("w") * F.sin(angle)).alias("s"), F.sum("w").alias("w"))
    return s.select(*groups, (F.sqrt(F.col("c") ** 2 + F.col("s") ** 2) / F.col("w")).alias("confidence"))


def sorted_slope(rates: DataFrame, groups: list[str], y: str, trim: float = 0.05) -> DataFrame:
    """Slope of sorted values on rank, the outer ``trim`` of each end left out, times the number of values."""
    part = W.partitionBy(*groups)
    r = rates.where(F.col(y).isNotNull()).withColumn("rank", F.row_number().over(part.orderBy(y)) - 1).withColumn("total", F.count("*").over(part))
    cut = F.floor(F.col("total") * trim)
    kept = r.where((F.col("rank") >= cut) & (F.col("rank") < F.col("total") - cut))
    s = solve(kept.groupBy(*groups).agg(*line(F.col("rank").cast("double"), F.col(y), F.lit(1.0)), F.max("total").alias("total")))
    return s.withColumn("log2_ptr", F.col("slope") * F.col("total"))


def centred(rates: DataFrame, groups: list[str], enzyme: str, y: str) -> DataFrame:
    """y minus its median within each enzyme of a group, for pooling."""
    m = rates.groupBy(*groups, enzyme).agg(F.median(y).alias("med"))
    return rates.join(m, [*groups, enzyme]).withColumn("centred", F.col(y) - F.col("med")).drop("med")
