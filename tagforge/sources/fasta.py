"""FASTA and FASTQ readers, plain or gzip, and sample names."""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagforge.functions.seq import classify_contig, normalize, sample_name
from tagforge.session import ship
from tagforge.sources import splits

GENOME_SUFFIXES = ("fa", "fna", "fasta", "fa.gz", "fna.gz", "fasta.gz")
READ_SUFFIXES = ("fq", "fastq", "fa", "fasta", "fq.gz", "fastq.gz", "fa.gz", "fasta.gz")


def expand(spark: SparkSession, paths: list[str], suffixes: tuple[str, ...]) -> list[str]:
    """Files as given, directories as their files of a known suffix, sorted; nothing found is an error.  Any Hadoop path works."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        status = fs.getFileStatus(p)
        if status.isFile():
            out.append(path)
            continue
        found = sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile() and s.getPath().getName().endswith(tuple("." + x for x in suffixes)))
        if not found:
            raise FileNotFoundError(f"{path} holds no file of {', '.join(suffixes)}")
        out += found
    return out


def read_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """genome, contig_id, name, seq, length, kind: one row per record, in file order.

    A file is read as one task: compressed files can't be split, and contig numbers follow the file.
    A file with text before its first record, or without one, raises.
    """
    files = expand(spark, paths, GENOME_SUFFIXES)
    rows = _records(spark, files)
    out = rows.select("file", sample_name("file").alias("genome"), F.col("number").cast("int").alias("contig_id"), "name", normalize("seq").alias("seq"))
    return out.select("genome", "contig_id", "name", "seq", F.length("seq").cast("bigint").alias("length"), classify_contig("name").alias("kind"))


def read_reads(spark: SparkSession, paths: list[str], per_file: bool = False, split_bytes: int = splits.SPLIT_BYTES) -> DataFrame:
    """sample, file, read_id, seq.  The format follows from the first byte; an empty file has no reads; a truncated record raises.

    Plain and BGZF files are read in ranges of ``split_bytes``, other gzip files whole (:mod:`tagforge.sources.splits`); a read's number is the place of its record.
    """
    ship(spark)
    spark.dataSource.register(splits.ReadSource)
    files = json.dumps([(f, file_size(spark, f)) for f in expand(spark, paths, READ_SUFFIXES)])
    rows = spark.read.format(splits.ReadSource.name()).option("files", files).option("splitBytes", split_bytes).load()
    sample = F.regexp_replace("file", "^.*/", "") if per_file else sample_name("file")
    return rows.select(sample.alias("sample"), "file", F.col("number").alias("read_id"), normalize("seq").alias("seq"))


def file_size(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getLen()


def _records(spark: SparkSession, files: list[str]) -> DataFrame:
    """file, number, name, seq of every record of FASTA files.  Each file is one row of paths and one task, which reads it in pieces through Arrow's file systems."""
    ship(spark)
    named = spark.createDataFrame([(f,) for f in files], "file string").repartitionByRange(max(1, len(files)), "file")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                held: list[tuple[int, str, str]] = []
                size = 0
                with opened(path) as stream:
                    for number, (name, seq) in enumerate(parse(stream)):
                        held.append((number, name, seq))
                        size += len(seq)
                        if size > 1 << 24:
                            yield _batch(pa, path, held)
                            held, size = [], 0
                if held:
                    yield _batch(pa, path, held)

    return named.mapInArrow(run, "file string, number bigint, name string, seq string")


def opened(path: str):
    """A file of any file system that Arrow knows, as a buffered stream of its text's bytes; gzip by its first bytes."""
    system, inner = splits.located(path)
    raw = io.BufferedReader(system.open_input_stream(inner, compression=None, buffer_size=1 << 20), 1 << 20)
    return gzip.GzipFile(fileobj=raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def _batch(pa, path, held):
    return pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held]), pa.array([h[2] for h in held])], names=["file", "number", "name", "seq"])


def parse(source: bytes | io.BufferedIOBase) -> Iterator[tuple[str, str]]:
    """(name up to white space, sequence) of each FASTA record of a stream or of bytes, line by line."""
    found = False
    for _, name, seq in splits.fasta_records(splits.Text(io.BytesIO(source) if isinstance(source, bytes) else source), True):
        found = True
        yield name, seq
    if not found:
        raise ValueError("no record in the file")


def with_genome_ids(contigs: DataFrame) -> DataFrame:
    """contigs plus genome_id (order of genome names) and offset (running length); over 65,535 contigs in a genome raise."""
    ids = contigs.select("genome").distinct().withColumn("genome_id", F.row_number().over(W.orderBy("genome")) - 1)
    before = F.coalesce(F.sum("length").over(W.partitionBy("genome").orderBy("contig_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    checked = F.when(F.col("contig_id") <= 65535, F.col("contig_id")).otherwise(F.raise_error(F.lit("more than 65,535 contigs in a genome")))
    return contigs.withColumn("offset", before).withColumn("contig_id", checked.cast("int")).join(ids, "genome")
