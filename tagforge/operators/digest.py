"""In-silico digestion: windows of contigs and reads that carry an enzyme's recognition pattern.

Contigs are scanned in Arrow batches, in pieces with an overlap of the longest tag less one.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagforge.operators import scan
from tagforge.panel import ENZYMES, LONGEST, Enzyme


def sites(contigs: DataFrame, enzymes: tuple[Enzyme, ...] = ENZYMES, min_contig_len: int = 500, flank: int | None = None) -> DataFrame:
    """genome_id, contig_id, position, enzyme_idx, pattern, tag of every tag in contigs of ``min_contig_len`` or more; with ``flank`` also local_gc."""
    return scan.sites(contigs.where(F.length("seq") >= min_contig_len), ["genome_id", "contig_id"], enzymes, flank)


def gaps(sites_: DataFrame) -> DataFrame:
    """Distance to the tag before on the same contig; 0 for the first."""
    order = W.partitionBy("genome_id", "contig_id").orderBy("position", "enzyme_idx", "pattern")
    return sites_.withColumn("gap", F.coalesce(F.col("position") - F.lag("position").over(order), F.lit(0)))


def merged_loci(sites_: DataFrame, radius: int = 33) -> DataFrame:
    """genome_id, contig_id, position: positions kept by a greedy pass that skips those within ``radius`` of the last kept; a group is one contig's positions."""
    p = sites_.select("genome_id", "contig_id", "position").distinct()
    return p.groupBy("genome_id", "contig_id").applyInPandas(partial(_greedy, radius), p.schema)


def _greedy(radius: int, key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("position")
    at = g["position"].to_numpy()
    kept, i = [], 0
    while i < len(at):
        kept.append(i)
        i = int(np.searchsorted(at, at[i] + radius, side="right"))
    return g.iloc[kept]


def density(sites_: DataFrame, contigs: DataFrame) -> DataFrame:
    """Per genome and enzyme: tags, distinct windows and tags per Mb of genome."""
    size = contigs.groupBy("genome_id").agg(F.sum("length").alias("genome_len"))
    g = sites_.groupBy("genome_id", "enzyme_idx").agg(F.count("*").alias("n_tags"), F.countDistinct("contig_id", "position").alias("n_windows"))
    return g.join(size, "genome_id").select("genome_id", "enzyme_idx", "n_tags", "n_windows", F.round(F.col("n_tags") * 1e6 / F.col("genome_len"), 6).alias("per_mb"))


def union_density(sites_: DataFrame, contigs: DataFrame, radius: int = 33) -> DataFrame:
    """Per genome: merged loci, mean and largest gap between neighbours, loci per 25 kb."""
    pos = merged_loci(sites_, radius).withColumnRenamed("position", "p")
    gap = pos.withColumn("gap", F.col("p") - F.lag("p").over(W.partitionBy("genome_id", "contig_id").orderBy("p")))
    size = contigs.groupBy("genome_id").agg(F.sum("length").alias("genome_len"))
    g = gap.groupBy("genome_id").agg(F.count("*").alias("n_loci"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.max("gap").alias("max_gap"))
    return g.join(size, "genome_id").select("genome_id", "n_loci", "mean_gap", "max_gap", F.round(F.col("n_loci") * 25000.0 / F.col("genome_len"), 6).alias("per_25kb"))


def spacing(sites_: DataFrame, wide: int = 500) -> DataFrame:
    """Per genome: statistics of gaps between neighbouring rows (enzymes at one locus give gaps of 0)."""
    order = W.partitionBy("genome_id", "contig_id").orderBy("position", "enzyme_idx", "pattern")
    gap = sites_.withColumn("gap", F.col("position") - F.lag("position").over(order)).where("gap is not null")
    ranked = gap.withColumn("r", F.row_number().over(W.partitionBy("genome_id").orderBy("gap")) - 1).withColumn("n", F.count("*").over(W.partitionBy("genome_id")))
    p99 = F.least(F.floor(F.col("n") * 0.99), F.col("n") - 1)
    return ranked.groupBy("genome_id").agg(
        F.max("n").alias("n_gaps"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.max(F.when(F.col("r") == F.floor(F.col("n") / 2), F.col("gap"))).alias("median_gap"),
        F.max(F.when(F.col("r") == p99, F.col("gap"))).alias("p99_gap"), F.max("gap").alias("max_gap"), F.count_if(F.col("gap") > wide).alias("n_wide"),
    )


# -- the same in DuckDB -------------------------------------------------------


def hits_sql(source: str, keep: str, enzymes: tuple[Enzyme, ...] = ENZYMES) -> str:
    """SELECT of keep, enzyme_idx, pattern, tag over a relation with a column ``w``."""
    parts = []
    for e in enzymes:
        rx = [e.window_regex(p) for p in range(len(e.patterns))]
        case = f"CASE WHEN regexp_matches(w, '{rx[0]}') THEN 0 ELSE 1 END" if len(rx) > 1 else "0"
        test = " OR ".join(f"regexp_matches(w, '{r}')" for r in rx)
        parts.append(f"SELECT {keep}, {e.idx} AS enzyme_idx, {case} AS pattern, substr(w, 1, {e.length}) AS tag FROM {source} WHERE {test}")
    return "\n UNION ALL ".join(parts)


SITES_SQL = f"""wins AS MATERIALIZED (SELECT genome_id, contig_id, p::BIGINT AS position, substr(seq, p::INT + 1, {LONGEST}) AS w FROM contigs, range(4096) t(p) WHERE p < length AND length >= 500),
sites AS MATERIALIZED ({hits_sql("wins", "genome_id, contig_id, position")})"""
LOCI_SQL = """loci AS (SELECT genome_id, contig_id, list_reduce(list_transform(p, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[-1] <= 33 THEN acc ELSE list_concat(acc, x) END) AS loci
  FROM (SELECT genome_id, contig_id, list_sort(list(DISTINCT position)) AS p FROM sites GROUP BY ALL))"""
