"""Genomic windows over ordered anchors.

Two families with their own rules: windows of a whole database (fixed number of anchors, or fixed base pairs),
and windows per sample, genome and enzyme with a size chosen from the number of anchors.  In both a trailing
chunk of less than half a window joins the window before it on the same contig.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagforge.operators.anchors import usable
from tagforge.session import dealt, stored

ORDER = ("position", "enzyme_idx")
#: Bits of the bases of a stretch, within which rows are sorted.
STRETCH = 16


def _chunk(size, total, place):
    """Chunk number of a 0-based place among ``total`` rows, a short tail folded into the chunk before."""
    chunk = F.floor(place / size)
    tail = total % size
    last = F.floor((total - 1) / size)
    return F.when((tail > 0) & (tail * 2 < size) & (chunk == last) & (chunk > 0), chunk - 1).otherwise(chunk)


def equal_anchor_windows(anchors: DataFrame, n: int = 100) -> DataFrame:
    """anchors plus window_id (dense over the database) for windows of ``n`` anchors per contig, usable anchors only."""
    contig = W.partitionBy("genome_id", "contig_id")
    place = F.row_number().over(contig.orderBy(*ORDER)) - 1
    chunk = _chunk(F.lit(n), F.count("*").over(contig), place)
    return _numbered(anchors.where(usable()).withColumn("chunk", chunk))


def fixed_windows(anchors: DataFrame, bp: int = 25_000) -> DataFrame:
    """As :func:`equal_anchor_windows` with windows of ``bp`` base pairs; empty ones don't exist."""
    return _numbered(anchors.where(usable()).withColumn("chunk", F.floor(F.col("position") / bp)))


def _numbered(chunked: DataFrame) -> DataFrame:
    """Ids in order of (genome, contig, chunk): ranks on the list of windows, which is as small as the windows are few."""
    ids = chunked.select("genome_id", "contig_id", "chunk").distinct()
    ids = ids.withColumn("rank", F.row_number().over(W.partitionBy("genome_id").orderBy("contig_id", "chunk")))
    base = ids.groupBy("genome_id").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("genome_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    named = ids.join(base, "genome_id").select("genome_id", "contig_id", "chunk", (F.col("base") + F.col("rank") - 1).alias("window_id"))
    return chunked.join(named, ["genome_id", "contig_id", "chunk"]).drop("chunk")


def window_table(windowed: DataFrame, contigs: DataFrame) -> DataFrame:
    """window_id, genome_id, contig_id, start, end, span, n_anchors, global_mid."""
    g = windowed.groupBy("window_id", "genome_id", "contig_id").agg(F.min("position").alias("start"), F.max(F.col("position") + F.length("tag")).alias("end"), F.count("*").alias("n_anchors"))
    out = g.join(contigs.select("genome_id", "contig_id", "offset"), ["genome_id", "contig_id"])
    mid = F.col("offset") + F.floor((F.col("start") + F.col("end")) / 2)
    return out.select("window_id", "genome_id", "contig_id", "start", "end", (F.col("end") - F.col("start")).alias("span"), "n_anchors", mid.alias("global_mid"))


def auto_size(n, cap: int = 100):
    return F.least(F.greatest(F.floor(n / 25), F.lit(25)), F.lit(cap))


def enzyme_windows(counts: DataFrame, cap: int = 100) -> DataFrame:
    """Usable counts plus window_size and chunk, per sample, genome and enzyme; contigs are never spanned.

    Rows are sorted within stretches of 2 ** ``STRETCH`` bases, and a stretch's first place follows from the number of rows in those before it:
    the list of stretches is the largest thing that is ordered by contig.  A stretch is one struct, so that nulls in a group are equal.
    The list is made at once and stored, as the number of rows says over how many tasks the sort is dealt.
    """
    group = ["sample", "genome_id", "enzyme"]
    named, rest = [*group, "contig_id"], [c for c in counts.columns if c not in (*group, "contig_id")]
    rows = counts.where("usable").select(F.struct(*named, F.shiftright(F.col("position").cast("bigint"), STRETCH).alias("stretch")).alias("__in"), *rest)
    of = lambda *names: W.partitionBy(*[F.col(f"__in.{c}") for c in names])
    before = F.sum("__n").over(of(*named).orderBy("__in.stretch").rowsBetween(W.unboundedPreceding, -1))
    held = stored(rows.groupBy("__in").agg(F.count("*").alias("__n")))
    total = held.agg(F.sum("__n")).head()[0] or 0
    held = held.select("__in", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(of(*named)).alias("__total"), auto_size(F.sum("__n").over(of(*group)), cap).alias("window_size"))
    place = F.col("__before") + F.row_number().over(W.partitionBy("__in").orderBy("position", "count", "local_gc", "flags")) - 1
    placed = dealt(rows, "__in", rows=total).join(held.hint("shuffle_hash"), "__in").withColumn("chunk", _chunk(F.col("window_size"), F.col("__total"), place))
    return placed.select(*[F.col(f"__in.{c}").alias(c) if c in named else F.col(c) for c in counts.columns], "window_size", "chunk")


def given_windows(counts: DataFrame) -> DataFrame:
    """Usable counts that carry a window_id, grouped by it per sample, genome and enzyme: the windows of the database instead of an enzyme's own."""
    some = counts.where(F.col("usable") & F.col("window_id").isNotNull())
    return some.withColumn("window_size", F.count("*").over(W.partitionBy("sample", "genome_id", "enzyme", "window_id"))).withColumn("chunk", F.col("window_id").cast("bigint"))


CHUNK_SQL = "CASE WHEN total % size > 0 AND (total % size) * 2 < size AND place // size = (total - 1) // size AND place >= size THEN place // size - 1 ELSE place // size END"
ENZYME_WINDOWS_SQL = f"""ew AS MATERIALIZED (SELECT *, {CHUNK_SQL} AS chunk FROM (SELECT *, count(*) OVER c AS total, row_number() OVER (c ORDER BY position, count, local_gc, flags) - 1 AS place
  FROM (SELECT *, least(greatest(count(*) OVER (PARTITION BY sample, genome_id, enzyme) // 25, 25), 100) AS size FROM counts WHERE usable) WINDOW c AS (PARTITION BY sample, genome_id, enzyme, contig_id)))"""
