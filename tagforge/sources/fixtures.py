"""Sequences, reads, counts and estimates derived from the relational tables, by expressions that any SQL engine repeats.

A genome per nation, two contigs each; nations k and k + 20 share a block, every genome repeats a block of
its own, and some hold a run of N.  One read per order; every third read carries one substitution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagforge.functions.seq import revcomp

CHUNK = 32
CHROMOSOME_CHUNKS, CHUNKS = 100, 125
GENOME_LEN = CHUNK * CHUNKS
READ_LEN = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """genome_id, genome, contig_id, name, kind, length, offset, seq: one row per contig."""
    n = F.col("n_nationkey")
    base = table(spark, sf_dir, "nation").select(n.cast("int").alias("genome_id"), F.col("n_name").alias("genome"), F.explode(F.array(F.lit(0), F.lit(1))).alias("contig_id"))
    first = F.when(F.col("contig_id") == 0, 0).otherwise(CHROMOSOME_CHUNKS)
    last = F.when(F.col("contig_id") == 0, CHROMOSOME_CHUNKS - 1).otherwise(CHUNKS - 1)

    def chunk(i):
        key = F.when(i.between(40, 69), F.col("genome_id") % 20).otherwise(F.col("genome_id"))
        idx = F.when(i.between(90, 99), i - 10).otherwise(i)
        bases = F.translate(F.md5(F.concat(key.cast("string"), F.lit(":"), idx.cast("string")).cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
        return F.when((i == 20) & (F.col("genome_id") % 5 == 0), F.lit("N" * CHUNK)).otherwise(bases)

    seq = F.array_join(F.transform(F.sequence(first, last), chunk), "")
    named = base.select("genome_id", "genome", "contig_id", F.when(F.col("contig_id") == 0, "chr1").otherwise(F.when(F.col("genome_id") % 2 == 0, "pA1").otherwise("contig_2")).alias("name"), seq.alias("seq"))
    length = F.length("seq").cast("bigint")
    kind = F.when(F.col("name") == "pA1", "plasmid").otherwise("chromosome")
    offset = F.when(F.col("contig_id") == 0, F.lit(0)).otherwise(CHROMOSOME_CHUNKS * CHUNK).cast("bigint")
    return named.select("genome_id", "genome", "contig_id", "name", kind.alias("kind"), length.alias("length"), offset.alias("offset"), "seq")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, file, read_id, seq: one read of 100 bases per order, from the chromosome of a genome; two files whose read numbers collide.

    Sequences join the orders by a broadcast of one row per nation (25 rows by the schema).
    """
    chrom = contigs(spark, sf_dir).where("contig_id = 0").select("genome_id", F.col("seq").alias("chromosome"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("sample"), (F.col("o_custkey") % 25).cast("int").alias("genome_id"), "o_custkey")
    o = o.repartition(spark.sparkContext.defaultParallelism)  # the file is one task otherwise
    start = (F.col("key") * 7919 + F.col("o_custkey") * 104729) % (CHROMOSOME_CHUNKS * CHUNK - READ_LEN)
    cut = o.join(F.broadcast(chrom), "genome_id").select("sample", "key", "o_custkey", F.substring(F.col("chromosome"), (start + 1).cast("int"), F.lit(READ_LEN)).alias("s"))
    p = (F.col("o_custkey") * 31 % READ_LEN).cast("int")
    changed = F.concat(F.substring(F.col("s"), F.lit(1), p), F.translate(F.substring(F.col("s"), p + 1, F.lit(1)), "ACGT", "CGTA"), F.substring(F.col("s"), p + 2, F.lit(READ_LEN)))
    s = F.when(F.col("key") % 3 == 0, changed).otherwise(F.col("s"))
    turned = F.when(F.col("key") % 2 == 0, revcomp("s")).otherwise(F.col("s"))
    file, number = F.format_string("part%d", (F.col("key") / 4).cast("bigint") % 2), F.floor(F.col("key") / 8) * 4 + F.col("key") % 4
    return cut.select("sample", "key", s.alias("s")).select("sample", file.alias("file"), number.alias("read_id"), turned.alias("seq"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count table: sample, genome_id, contig_id, position, enzyme, flags, local_gc, count, usable, gc."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    out = li.select(
        F.col("l_returnflag").alias("sample"),
        (F.col("l_suppkey") % 4).cast("int").alias("genome_id"),
        (F.col("l_partkey") % 2).cast("int").alias("contig_id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("position"),
        F.col("l_linenumber").cast("int").alias("enzyme"),
        F.when(F.col("l_partkey") % 11 == 0, 8).when(F.col("l_partkey") % 13 == 0, 4).otherwise(3).alias("flags"),
        F.when(F.col("l_partkey") % 50 == 0, 255).otherwise(60 + F.col("l_suppkey") % 80).cast("int").alias("local_gc"),
        (q % 9).alias("count"),
    )
    return out.withColumn("usable", F.col("flags").bitwiseAND(28) == 0).withColumn("gc", F.when(F.col("local_gc") != 255, F.col("local_gc") / 200.0))


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-enzyme estimates: sample, genome_id, enzyme, est, se, n, n_anchors, r2."""
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("sample"), (F.col("user_id") % 10).cast("int").alias("genome_id"), (F.col("user_id") % 16).cast("int").alias("enzyme"), (F.col("value") / 100).alias("v"), "event_id")
    g = ev.groupBy("sample", "genome_id", "enzyme").agg(F.avg("v").alias("est"), (F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("se"), F.count("*").alias("n"), F.min("event_id").alias("lo"))
    return g.select("sample", "genome_id", "enzyme", F.round("est", 6).alias("est"), F.round("se", 6).alias("se"), "n", (F.col("n") * 8).alias("n_anchors"), ((F.col("lo") % 100 - 10) / 90.0).alias("r2"))


# -- the same fixtures in DuckDB ----------------------------------------------

_CHUNK_SQL = "translate(md5((CASE WHEN i BETWEEN 40 AND 69 THEN n_nationkey % 20 ELSE n_nationkey END)::VARCHAR || ':' || (CASE WHEN i BETWEEN 90 AND 99 THEN i - 10 ELSE i END)::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT')"
CONTIGS_SQL = f"""contigs AS MATERIALIZED (
  SELECT n_nationkey::INT AS genome_id, n_name AS genome, c::INT AS contig_id,
    CASE WHEN c = 0 THEN 'chr1' WHEN n_nationkey % 2 = 0 THEN 'pA1' ELSE 'contig_2' END AS name,
    CASE WHEN c = 1 AND n_nationkey % 2 = 0 THEN 'plasmid' ELSE 'chromosome' END AS kind,
    length(seq)::BIGINT AS length, (c * {CHROMOSOME_CHUNKS * CHUNK})::BIGINT AS "offset", seq
  FROM (SELECT n_nationkey, n_name, (i >= {CHROMOSOME_CHUNKS})::INT AS c,
      string_agg(CASE WHEN i = 20 AND n_nationkey % 5 = 0 THEN repeat('N', {CHUNK}) ELSE {_CHUNK_SQL} END, '' ORDER BY i) AS seq
    FROM nation, range({CHUNKS}) t(i) GROUP BY ALL))"""
READS_SQL = f"""reads AS MATERIALIZED (
  SELECT sample, 'part' || (key // 4 % 2) AS file, key // 8 * 4 + key % 4 AS read_id, CASE WHEN key % 2 = 0 THEN reverse(translate(s2, 'ACGTN', 'TGCAN')) ELSE s2 END AS seq
  FROM (SELECT *, CASE WHEN key % 3 = 0 THEN substr(s, 1, p) || translate(substr(s, p + 1, 1), 'ACGT', 'CGTA') || substr(s, p + 2) ELSE s END AS s2
    FROM (SELECT o_orderkey AS key, o_orderstatus AS sample, (o_custkey * 31 % {READ_LEN})::INT AS p,
        substr(c.seq, ((o_orderkey * 7919 + o_custkey * 104729) % {CHROMOSOME_CHUNKS * CHUNK - READ_LEN} + 1)::INT, {READ_LEN}) AS s
      FROM orders JOIN contigs c ON c.contig_id = 0 AND c.genome_id = o_custkey % 25)))"""
COUNTS_SQL = """counts AS (
  SELECT *, (flags & 28) = 0 AS usable, CASE WHEN local_gc <> 255 THEN local_gc / 200.0::DOUBLE END AS gc FROM (
    SELECT l_returnflag AS sample, (l_suppkey % 4)::INT AS genome_id, (l_partkey % 2)::INT AS contig_id, l_orderkey * 8 + l_linenumber AS position,
      l_linenumber::INT AS enzyme, CASE WHEN l_partkey % 11 = 0 THEN 8 WHEN l_partkey % 13 = 0 THEN 4 ELSE 3 END AS flags,
      CASE WHEN l_partkey % 50 = 0 THEN 255 ELSE 60 + l_suppkey % 80 END::INT AS local_gc, (l_quantity::INT % 9) AS count FROM lineitem))"""
ESTIMATES_SQL = """estimates AS (
  SELECT sample, genome_id, enzyme, round(avg(v), 6) AS est, round(stddev_samp(v) / sqrt(count(*)), 6) AS se, count(*) AS n, count(*) * 8 AS n_anchors, (min(event_id) % 100 - 10) / 90.0::DOUBLE AS r2
  FROM (SELECT event_type AS sample, (user_id % 10)::INT AS genome_id, (user_id % 16)::INT AS enzyme, value / 100 AS v, event_id FROM events) GROUP BY ALL)"""
