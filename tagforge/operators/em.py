"""Counts of tags that several genomes share, split by abundance.

Abundance is the mean count over a genome's usable anchors, which the split doesn't change, so expectation
maximisation stops at its first step and is one aggregate, one join and one window sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagforge.operators.anchors import SHARED, usable

PRIOR = 1e-9


def abundance(counts: DataFrame) -> DataFrame:
    """sample, genome_id, lambda, n_unique, n_detected, containment over usable anchors."""
    u = usable()
    g = counts.groupBy("sample", "genome_id").agg(F.avg(F.when(u, F.col("count"))).alias("mean"), F.count_if(u).alias("n_unique"), F.count_if(u & (F.col("count") > 0)).alias("n_detected"))
    return g.select("sample", "genome_id", F.coalesce("mean", F.lit(PRIOR)).alias("lambda"), "n_unique", "n_detected", F.try_divide("n_detected", "n_unique").alias("containment"))


def split_shared(counts: DataFrame) -> DataFrame:
    """counts (with canon) plus weight: shared tags' largest count is shared out by abundance, evenly without any; others keep theirs."""
    c = counts.join(abundance(counts).select("sample", "genome_id", "lambda"), ["sample", "genome_id"])
    group = W.partitionBy("sample", "canon")
    total, seen, n = F.sum("lambda").over(group), F.max("count").over(group), F.count("*").over(group)
    share = F.when(total > 0, F.col("lambda") / total).otherwise(1 / n)
    return c.withColumn("weight", F.when(F.col("flags").bitwiseAND(SHARED) > 0, seen * share).otherwise(F.col("count").cast("double"))).drop("lambda")


def summary(counts: DataFrame) -> DataFrame:
    """Abundance per sample and genome with the mass that the split assigns."""
    mass = split_shared(counts).groupBy("sample", "genome_id").agg(F.sum("weight").alias("assigned_mass"))
    return abundance(counts).join(mass, ["sample", "genome_id"])


COUNTED_SQL = """counted AS MATERIALIZED (SELECT s.sample, a.genome_id, a.contig_id, a.position, a.enzyme_idx, a.canon, a.flags, coalesce(n, 0) AS count
  FROM anchors a CROSS JOIN (SELECT DISTINCT sample FROM reads) s LEFT JOIN (SELECT sample, genome_id, contig_id, position, enzyme_idx, count(*) AS n FROM exact GROUP BY ALL) USING (sample, genome_id, contig_id, position, enzyme_idx)),
lam AS (SELECT sample, genome_id, coalesce(avg(count) FILTER ((flags & 28) = 0), 1e-9) AS "lambda", count(*) FILTER ((flags & 28) = 0) AS n_unique, count(*) FILTER ((flags & 28) = 0 AND count > 0) AS n_detected FROM counted GROUP BY ALL),
split AS (SELECT c.*, CASE WHEN (flags & 8) > 0 THEN max(count) OVER g * CASE WHEN sum("lambda") OVER g > 0 THEN "lambda" / sum("lambda") OVER g ELSE 1 / (count(*) OVER g) END ELSE count::DOUBLE END AS weight
  FROM counted c JOIN lam USING (sample, genome_id) WINDOW g AS (PARTITION BY sample, canon))"""
