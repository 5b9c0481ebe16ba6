"""Genome screen: a k-mer sketch, votes of reads, and the choice of genomes worth a full count.

A k-mer is kept if the hash of its canonical form lies below 1/scale of the range; the hash, two multiplications and a xor-shift over
the two halves, is one that any engine can repeat, and stands for the k-mer in joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagforge.operators import scan

K = 21
SCALE = 16


def kmers(seqs: DataFrame, keep: list[str], k: int = K, scale: int = SCALE) -> DataFrame:
    """keep, kmer: hashes of canonical k-mers of certain bases that the sketch keeps (repeats included)."""
    return scan.kmers(scan.dealt(seqs), keep, k, scale)


def sketch(contigs: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    return kmers(contigs, ["genome_id"], k, scale).distinct()


def sketch_sizes(sketch_: DataFrame) -> DataFrame:
    return sketch_.groupBy("genome_id").agg(F.count("*").alias("size"))


def votes(reads: DataFrame, sketch_: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """sample, genome_id, hits: reads that share a kept k-mer with the genome, each once.  A read is named by all its columns but seq."""
    names = [c for c in reads.columns if c != "seq"]
    seen = kmers(reads, names, k, scale).join(sketch_, "kmer").select("genome_id", *names).distinct()
    return seen.groupBy("sample", "genome_id").agg(F.count("*").alias("hits"))


def select(votes_: DataFrame, sizes: DataFrame, genomes: DataFrame, min_hits: int = 50, min_fraction: float = 5e-4) -> DataFrame:
    """Votes per sketch k-mer times genome length, its share of the sample, and whether the genome is kept."""
    from pyspark.sql import Window as W

    mass = votes_.join(sizes, "genome_id").join(genomes, "genome_id").withColumn("mass", F.col("hits") / F.col("size") * F.col("genome_len"))
    share = F.col("mass") / F.sum("mass").over(W.partitionBy("sample"))
    return mass.withColumn("share", share).withColumn("keep", (F.col("hits") >= min_hits) | (F.col("share") >= min_fraction))


# -- the same in DuckDB -------------------------------------------------------


def hashed_sql(w: str, k: int = K) -> str:
    """The hash of a k-mer's canonical form as UBIGINT."""
    c = f"translate(least({w}, reverse(translate({w}, 'ACGT', 'TGCA'))), 'ACGT', '0123')"
    half = lambda a, n: f"('0x' || substr({c}, {a}, {n}))::BIGINT::UHUGEINT"
    first = f"(({half(1, k // 2)} * {scan.MIX[0]}::UHUGEINT + {half(k // 2 + 1, k - k // 2)} * {scan.MIX[1]}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return f"(SELECT (xor(f, f >> 32)::UHUGEINT * {scan.MIX[2]}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT FROM (SELECT {first} AS f))"


SKETCH_SQL = f"""sketch AS MATERIALIZED (SELECT DISTINCT genome_id, kmer FROM (SELECT genome_id, {hashed_sql("w")} AS kmer FROM (
    SELECT genome_id, substr(seq, p::INT + 1, {K}) AS w FROM contigs, range(4000) t(p) WHERE p + {K} <= length) WHERE NOT regexp_matches(w, '[^ACGT]')) WHERE kmer < {(1 << 64) // SCALE}),
sizes AS (SELECT genome_id, count(*) AS size FROM sketch GROUP BY genome_id)"""
VOTES_SQL = f"""votes AS MATERIALIZED (SELECT sample, genome_id, count(DISTINCT (file, read_id)) AS hits FROM (
    SELECT DISTINCT sample, file, read_id, {hashed_sql("w")} AS kmer FROM (SELECT sample, file, read_id, substr(seq, p::INT + 1, {K}) AS w FROM reads, range(100) t(p) WHERE p + {K} <= length(seq))
    WHERE NOT regexp_matches(w, '[^ACGT]')) JOIN sketch USING (kmer) GROUP BY sample, genome_id),
screened AS (SELECT *, share >= 0.05 OR hits >= 400 AS keep FROM (SELECT *, mass / sum(mass) OVER (PARTITION BY sample) AS share FROM (
  SELECT sample, genome_id, hits, size, hits / size::DOUBLE * 4000 AS mass FROM votes JOIN sizes USING (genome_id))))"""
