"""Anchor counts over a stream of reads.

Counts are sums over reads in any order, so a stream-static join and an update-mode aggregate are exact without a watermark; the
state holds one row per sample and anchor seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagforge.operators import scan
from tagforge.operators.match import READ_KEYS, exact_hits
from tagforge.panel import ENZYMES

SCHEMA = "sample string, file string, read_id bigint, seq string"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of reads that arrive in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_counts(reads: DataFrame, anchors: DataFrame) -> DataFrame:
    """Running count per sample and anchor of exact hits."""
    hits = exact_hits(scan.read_windows(reads, ENZYMES, READ_KEYS), anchors)
    return hits.groupBy("sample", "genome_id", "contig_id", "position", "enzyme_idx").agg(F.count("*").alias("count"))


def start(counts: DataFrame, sink, checkpoint: str, **trigger):
    """Run ``sink(batch, number)`` for each update; ``checkpoint`` must be a folder that the whole cluster shares."""
    return counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
