"""Comparisons over samples: matrices, deltas against a baseline, false discovery rates, trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagforge.operators.fit import line, solve
from tagforge.session import dealt, stored


def passing(out: DataFrame) -> DataFrame:
    """Rows whose pass_qc reads true or 1 in any case."""
    return out.where(F.lower(F.col("pass_qc").cast("string")).isin("true", "1"))


def ptr_matrix(out: DataFrame, samples: list, value: str = "log2_ptr") -> DataFrame:
    return out.groupBy("genome_id").pivot("sample", samples).agg(F.avg(value))


def anchor_matrix(counts: DataFrame, samples: list, usable_only: bool = True, genome: int | None = None) -> DataFrame:
    """Counts per anchor and sample, 0 where a sample has none; masked anchors only on request, one genome if named.

    Nearly every row has an anchor of its own, so rows are dealt out before they are summed: sums ahead of the shuffle would hold a task's whole input.
    """
    if usable_only:
        counts = counts.where("usable")
    if genome is not None:
        counts = counts.where(F.col("genome_id") == genome)
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in ("genome_id", "contig_id", "position", "enzyme")])
    rows = dealt(counts.select(key.alias("anchor"), "sample", "count"), "anchor")
    return rows.groupBy("anchor").agg(*[F.coalesce(F.sum(F.when(F.col("sample") == s, F.col("count"))), F.lit(0)).alias(s) for s in samples])


def in_baseline(name: str) -> Column:
    """Whether a row is of the baseline: in each genome the rows of that group if it has any, else those of that sample."""
    of_group = F.coalesce(F.col("group") == name, F.lit(False))
    return F.when(F.max(of_group).over(W.partitionBy("genome_id")), of_group).otherwise(F.col("sample") == name)


def baseline(out: DataFrame, is_baseline: Column | None) -> DataFrame:
    """Per genome: mean of the baseline rows (all rows without one) and the standard error of that mean."""
    rows = out if is_baseline is None else out.where(is_baseline)
    se2 = F.sum(F.when(F.col("se").isNotNull(), F.col("se") * F.col("se")))
    return rows.groupBy("genome_id").agg(F.avg("log2_ptr").alias("base"), F.coalesce(F.sqrt(se2) / F.count("se"), F.lit(0.0)).alias("base_se"))


def delta(out: DataFrame, is_baseline: Column | None) -> DataFrame:
    """delta, its error, z and fold of every other sample; genomes without a baseline are left out."""
    rows = out if is_baseline is None else out.where(~is_baseline)
    j = rows.join(baseline(out, is_baseline), "genome_id").withColumn("delta", F.col("log2_ptr") - F.col("base"))
    own = F.coalesce("se", F.lit(0.0))  # a missing error counts as none
    j = j.withColumn("delta_se", F.sqrt(own * own + F.col("base_se") * F.col("base_se")))
    return j.withColumn("z", F.try_divide("delta", "delta_se")).withColumn("fold", F.pow(F.lit(2.0), "delta"))


def benjamini_hochberg(df: DataFrame, p: str) -> DataFrame:
    """df plus q: p times n over its rank, made monotone from the largest down; null p stay null.

    q depends on p alone, so distinct values with their multiplicities are ranked, each within its range (a 64th of a doubling);
    only the totals of the ranges, of which there are under 70,000 whatever the table, are summed up in one task.
    """
    df = stored(df)
    some = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("n"))
    some = some.withColumn("range", F.coalesce(F.floor(F.log2("__p") * 64), F.lit(-(1 << 20))))
    totals = some.groupBy("range").agg(F.sum("n").alias("all"))
    totals = totals.select("range", (F.sum("all").over(W.orderBy("range")) - F.col("all")).alias("before"), F.sum("all").over(W.partitionBy()).alias("m"))
    inside = W.partitionBy("range").orderBy("__p")
    ranked = some.join(totals, "range").withColumn("raw", F.col("__p") * F.col("m") / (F.col("before") + F.sum("n").over(inside)))
    lows = ranked.groupBy("range").agg(F.min("raw").alias("low"))
    beyond = lows.select("range", F.min("low").over(W.orderBy("range").rowsBetween(1, W.unboundedFollowing)).alias("beyond"))
    least = F.least(F.min("raw").over(inside.rowsBetween(W.currentRow, W.unboundedFollowing)), "beyond", F.lit(1.0))
    q = ranked.join(beyond, "range").select("__p", F.greatest(F.lit(0.0), least).alias("q"))
    return df.join(q, F.col(p) == F.col("__p"), "left").select(*df.columns, "q")


def trend(out: DataFrame, time: str, groups: list[str]) -> DataFrame:
    """Weighted line over time points: slope, its scaled error and t, for groups of three rows or more."""
    ok = out.where(F.col("log2_ptr").isNotNull() & (F.col("se") > 0))
    s = solve(ok.groupBy(*groups).agg(*line(F.col(time).cast("double"), F.col("log2_ptr"), 1 / (F.col("se") * F.col("se"))))).where("n >= 3")
    return s.withColumn("t", F.try_divide("slope", "slope_se"))
