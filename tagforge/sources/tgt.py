"""The tag table of one genome as text and as fixed-width binary records."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagforge.functions.seq import canonical
from tagforge.operators.digest import gaps
from tagforge.panel import BY_NAME, ENZYMES
from tagforge.session import ship

# File magic, format version, bytes of a record.
MAGIC, VERSION, RECORD = b"TGT2", 2, 48


def _or(df: DataFrame, name: str, other: int):
    return F.col(name) if name in df.columns else F.lit(other)


def to_text(sites: DataFrame, contigs: DataFrame, genome: str) -> DataFrame:
    """value: header lines, then one line per tag, grouped by enzyme in panel order: tag, contig, position, strand (+ for an enzyme's first pattern), gap, flags, GC.

    Sites without flags or local_gc give 0 and 255.
    """
    names = F.element_at(F.create_map(*[F.lit(x) for e in ENZYMES for x in (e.idx, e.name)]), F.col("enzyme_idx"))
    strand = F.when(F.col("pattern") == 0, "+").otherwise("-")
    line = F.concat_ws("\t", F.concat_ws(":", names, "tag"), "contig_id", "position", strand, "gap", _or(sites, "flags", 0), _or(sites, "local_gc", 255))
    rows = gaps(sites).select(F.lit(3).alias("part"), "enzyme_idx", "contig_id", "position", line.alias("value"))
    head = contigs.select(F.lit(1).alias("part"), F.lit(-1).alias("enzyme_idx"), "contig_id", F.lit(0).cast("bigint").alias("position"), F.concat_ws("\t", F.lit("#contig"), "contig_id", "name", "length", "offset", F.initcap("kind")).alias("value"))
    lines = [(0, -1, -1, 0, f"#TGT2\t{genome}"), (2, -1, -1, 0, "#columns\ttag\tcontig_id\tposition\tpattern\tgap\tflags\tlocal_gc")]
    title = contigs.sparkSession.createDataFrame(lines, "part int, enzyme_idx int, contig_id int, position bigint, value string")
    return title.unionByName(head).unionByName(rows).orderBy("part", "enzyme_idx", "contig_id", "position").select("value")


def write_all(anchors: DataFrame, contigs: DataFrame, path: str) -> None:
    """The binary tag table of every genome as a file of its own; a task writes whole genomes, in the order of enzyme, contig and position."""
    from tagforge.sources.tagfiles import TagFiles

    spark = anchors.sparkSession
    ship(spark)
    spark.dataSource.register(TagFiles)
    fields = ("contig_id", "name", "length", "offset", "kind")
    listed = F.array_sort(F.collect_list(F.struct(*fields)))
    heads = contigs.groupBy("genome_id", "genome").agg(F.to_json(F.struct(F.col("genome"), listed.alias("contigs"))).alias("meta"))
    rows = gaps(anchors).select("genome_id", "enzyme_idx", "pattern", "tag", "contig_id", F.col("position").cast("bigint").alias("position"), F.col("gap").cast("bigint").alias("gap"), _or(anchors, "flags", 0).cast("int").alias("flags"), _or(anchors, "local_gc", 255).cast("int").alias("local_gc"))
    names = contigs.select("genome_id", "genome").distinct()
    rows = rows.join(names, "genome_id").withColumn("meta", F.lit(None).cast("string")).unionByName(heads.withColumn("enzyme_idx", F.lit(-1)), allowMissingColumns=True)
    ordered = rows.repartition("genome").sortWithinPartitions("genome", "enzyme_idx", "contig_id", "position", "pattern")
    ordered.select("genome", "meta", "enzyme_idx", "pattern", "tag", "contig_id", "position", "gap", "flags", "local_gc").write.format(TagFiles.name()).mode("overwrite").option("path", path).save()


def read_all(spark: SparkSession, path: str, split_records: int | None = None) -> DataFrame:
    """genome, enzyme_idx, pattern, tag, contig_id, position, gap, flags, local_gc of a tag file or a folder of them, read in ranges of records."""
    from tagforge.sources.tagfiles import TagFiles

    ship(spark)
    spark.dataSource.register(TagFiles)
    reader = spark.read.format(TagFiles.name()).option("path", path)
    return (reader.option("splitRecords", split_records) if split_records else reader).load()


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """enzyme_idx, tag, contig_id, position, strand, gap, flags, local_gc, canon of the tag lines; absent flags are 0, absent GC 255."""
    p = F.split("value", "\t")
    idx = F.element_at(F.create_map(*[F.lit(x) for e in ENZYMES for x in (e.name, e.idx)]), F.split(p[0], ":")[0])
    get = lambda i, default: F.coalesce(F.get(p, F.lit(i)).try_cast("int"), F.lit(default))
    rows = spark.read.text(path).where("value <> '' and not startswith(value, '#')")
    out = rows.select(idx.alias("enzyme_idx"), F.split(p[0], ":")[1].alias("tag"), p[1].cast("int").alias("contig_id"), p[2].cast("bigint").alias("position"), p[3].alias("strand"), get(4, 0).alias("gap"), get(5, 0).alias("flags"), get(6, 255).alias("local_gc"))
    return out.withColumn("canon", canonical("tag"))


def keys_of_tags(tags: list[str]) -> list[int]:
    """The 64-bit key of each tag on either strand: the first bytes of the digest of its canonical form."""
    turn = str.maketrans("ACGT", "TGCA")
    return [int.from_bytes(hashlib.blake2b(min(t, t[::-1].translate(turn)).encode(), digest_size=8).digest(), "little") for t in tags]


def anchors_from_text(spark: SparkSession, path: str, enzymes: str = "all") -> DataFrame:
    """Coordinates of a tag table's rows, of some enzymes."""
    rows = read_text(spark, path)
    if enzymes.lower() != "all":
        rows = rows.where(F.col("enzyme_idx").isin([BY_NAME[e.strip().lower()].idx for e in enzymes.split(",")]))
    return rows.select("contig_id", "position", "enzyme_idx")
