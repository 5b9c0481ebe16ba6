"""Zero-truncated count rates of windows, as closed-form or fixed-step Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STEPS = 25


def ztp_lambda(mean: Column) -> Column:
    """The Poisson rate whose zero-truncated mean is ``mean``, by Newton steps; null for a mean of 1 or less."""
    start = F.when(mean > 2, mean).otherwise(2 * (mean - 1))

    def step(x, _):
        e = F.exp(-x)
        return x - (x / (1 - e) - mean) / (((1 - e) - x * e) / ((1 - e) * (1 - e)))

    return F.when(mean > 1, F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start.cast("double"), step))


def ztp_mean(x: Column) -> Column:
    return F.when(x < 1e-8, 1 + x / 2).otherwise(x / -F.expm1(-x))


def ztp_var(x: Column) -> Column:
    m = ztp_mean(x)
    return F.when(x < 1e-8, x / 2).otherwise(m * (1 + x - m))


def ztp_slope(x: Column) -> Column:
    """Derivative of the truncated mean by the rate."""
    e = F.exp(-x)
    return F.when(x < 1e-8, F.lit(0.5)).otherwise((-F.expm1(-x) - x * e) / F.pow(-F.expm1(-x), 2))


def ztnb_mean(mu: Column, alpha: Column) -> Column:
    """Mean of a zero-truncated negative binomial of mean ``mu`` and variance mu + alpha mu^2."""
    return mu / -F.expm1(-F.log1p(alpha * mu) / alpha)


def ztnb_var(mu: Column, alpha: Column) -> Column:
    m = ztnb_mean(mu, alpha)
    return m * (1 + mu * (1 + alpha)) - m * m


def window_rates(windowed: DataFrame) -> DataFrame:
    """One row per enzyme window: extent, counts, single-component rate with its standard error, dispersion, mean GC."""
    key = ["sample", "genome_id", "enzyme", "contig_id", "chunk"]
    pos = F.when(F.col("count") >= 1, F.col("count"))
    g = windowed.groupBy(*key).agg(
        F.min("position").alias("start"), F.max("position").alias("end"), F.avg("position").alias("mid"), F.max("window_size").alias("window_size"), F.count("*").alias("n_anchors"),
        F.count(pos).alias("n_positive"), F.avg(pos).alias("mean"), F.var_samp(pos).alias("var"), F.avg("gc").alias("mean_gc"),
    )
    lam = ztp_lambda(F.col("mean"))
    g = g.withColumn("rate", lam)
    se = F.sqrt(ztp_var(F.col("rate")) / F.col("n_positive")) / ztp_slope(F.col("rate"))
    g = g.withColumn("se", se).withColumn("dispersion", F.col("var") / F.col("mean")).withColumn("detected_fraction", F.col("n_positive") / F.col("n_anchors"))
    return g.withColumn("log2_rate", F.when(F.col("rate") > 0, F.log2("rate"))).withColumn("log2_se", F.when(F.col("rate") > 0, F.col("se") / (F.col("rate") * F.log(F.lit(2.0)))))


def tukey_keep(df: DataFrame, value: str, groups: list[str], k: float = 1.5) -> DataFrame:
    """df plus ``keep``: inside the fences of its group; a group of under 4 values or without spread keeps all it has."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
    f = df.groupBy(*groups).agg(q.alias("q"), F.count(value).alias("n")).select(*groups, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"), "n")
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(value).between(F.col("q1") - k * iqr, F.col("q3") + k * iqr)
    return df.join(f, groups).withColumn("keep", F.col(value).isNotNull() & F.when((F.col("n") < 4) | (iqr <= 0), True).otherwise(inside)).drop("q1", "q3", "n")


def enzyme_efficiency(counts: DataFrame) -> DataFrame:
    """Per sample, genome and enzyme: median, mean and number of usable counts; mean over the median of the group's means."""
    from pyspark.sql import Window as W

    g = counts.where("usable").groupBy("sample", "genome_id", "enzyme").agg(F.median("count").alias("median"), F.avg("count").alias("mean"), F.count("*").alias("n"))
    return g.withColumn("relative", F.try_divide("mean", F.median("mean").over(W.partitionBy("sample", "genome_id"))))


_L = "list_reduce(list_prepend(CASE WHEN mean > 2 THEN mean ELSE 2 * (mean - 1) END, list_transform(range(25), lambda i: i::DOUBLE)), lambda l, i: l - (l / (1 - exp(-l)) - mean) / (((1 - exp(-l)) - l * exp(-l)) / ((1 - exp(-l)) * (1 - exp(-l)))))"
RATES_SQL = f"""rates AS MATERIALIZED (SELECT *, sqrt(v / n_positive) / slope AS se, var / mean AS dispersion, n_positive / n_anchors::DOUBLE AS detected_fraction, CASE WHEN rate > 0 THEN log2(rate) END AS log2_rate,
    CASE WHEN rate > 0 THEN sqrt(v / n_positive) / slope / (rate * ln(2.0::DOUBLE)) END AS log2_se
  FROM (SELECT *, rate / (1 - exp(-rate)) * (1 + rate - rate / (1 - exp(-rate))) AS v, ((1 - exp(-rate)) - rate * exp(-rate)) / ((1 - exp(-rate)) ** 2) AS slope
    FROM (SELECT *, CASE WHEN mean > 1 THEN {_L} END AS rate FROM (
      SELECT sample, genome_id, enzyme, contig_id, chunk, min(position) AS start, max(position) AS "end", avg(position) AS mid, max(size) AS window_size, count(*) AS n_anchors,
        count(*) FILTER (count >= 1) AS n_positive, avg(count) FILTER (count >= 1) AS mean, var_samp(count) FILTER (count >= 1) AS var, avg(gc) AS mean_gc FROM ew GROUP BY ALL))))"""
