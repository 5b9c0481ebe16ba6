"""The anchor table: local GC, uniqueness flags, shared groups, global positions, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagforge.functions.seq import canonical
from tagforge.operators import digest
from tagforge.panel import ENZYMES

# The bits of an anchor's flags.
UNIQUE_IN_GENOME, UNIQUE_ACROSS, MULTICOPY, SHARED, NON_CHROMOSOMAL, GC_UNDEFINED = 1, 2, 4, 8, 16, 32
UNUSABLE = MULTICOPY | SHARED | NON_CHROMOSOMAL


def local_gc(sites: DataFrame, contigs: DataFrame, flank: int = 250) -> DataFrame:
    """sites plus local_gc: quantised GC of the bases within ``flank`` around the tag's start, cut at the contig's ends.

    Sites made with that flank have it already; for others one more scan of the contigs is joined to them by place.
    """
    if "local_gc" in sites.columns:
        return sites
    place = ["genome_id", "contig_id", "position", "enzyme_idx"]
    return sites.join(digest.sites(contigs, min_contig_len=0, flank=flank).select(*place, "local_gc"), place).select(*sites.columns, "local_gc")


def with_flags(sites: DataFrame, contigs: DataFrame) -> DataFrame:
    """sites plus canon, kind and flags.

    A tag is multicopy if it stands at several distinct loci of its genome, and shared if several genomes have it;
    two aggregates on (canon) and (canon, genome) are joined back, with no distinct window.
    """
    kinds = contigs.select("genome_id", "contig_id", "kind")
    s = sites.withColumn("canon", canonical("tag")).join(kinds, ["genome_id", "contig_id"])
    per = s.groupBy("canon", "genome_id").agg(F.countDistinct("contig_id", "position").alias("loci"))
    per = per.withColumn("genomes", F.count("*").over(W.partitionBy("canon")))
    out = s.join(per, ["canon", "genome_id"])
    flags = (
        F.when(F.col("loci") == 1, UNIQUE_IN_GENOME).otherwise(MULTICOPY)
        + F.when(F.col("genomes") == 1, UNIQUE_ACROSS).otherwise(SHARED)
        + F.when(F.col("kind") == "plasmid", NON_CHROMOSOMAL).otherwise(0)
    )
    return out.select(*sites.columns, "canon", "kind", "loci", "genomes", flags.alias("flags"))


def usable(flags: str = "flags"):
    return F.col(flags).bitwiseAND(UNUSABLE) == 0


def shared_groups(anchors: DataFrame) -> DataFrame:
    """canon, n_genomes, n_rows of the tags that several genomes have."""
    return anchors.groupBy("canon").agg(F.countDistinct("genome_id").alias("n_genomes"), F.count("*").alias("n_rows")).where("n_genomes > 1")


def global_position(sites: DataFrame, contigs: DataFrame) -> DataFrame:
    at = contigs.select("genome_id", "contig_id", "offset")
    return sites.join(at, ["genome_id", "contig_id"]).withColumn("global_position", F.col("offset") + F.col("position")).drop("offset")


def contig_offsets(contigs: DataFrame) -> DataFrame:
    before = W.partitionBy("genome_id").orderBy("contig_id").rowsBetween(W.unboundedPreceding, -1)
    return contigs.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


RULES = ("unknown_contig", "out_of_bounds", "wrong_key", "wrong_length", "unknown_enzyme", "duplicate_row", "unsorted_row", "wrong_offset", "duplicate_contig", "repeated_genome_name", "wrong_genome_length", "wrong_global_position")


def validate(anchors: DataFrame, contigs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """check, n_bad: one row per rule of a sound anchor table.

    ``order`` names columns by which rows must ascend along ``row`` (their place in the file), where anchors have that column; genome_len in
    contigs must be the sum of the genome's contigs, global_position in anchors that of its contig's offset, where the columns exist.
    """
    bounds = contigs.groupBy("genome_id", "contig_id").agg(F.max("length").alias("contig_length"), F.min("offset").alias("contig_offset"))
    known = anchors.join(bounds, ["genome_id", "contig_id"], "left")
    offsets = contig_offsets(contigs.select("genome_id", "contig_id", "length", F.col("offset").alias("stored")))
    lengths = F.element_at(F.create_map(*[F.lit(x) for e in ENZYMES for x in (e.idx, e.length)]), F.col("enzyme_idx"))
    found = {
        "unknown_contig": known.where("contig_length is null"),
        "out_of_bounds": known.where((F.col("position") < 0) | (F.col("position") + F.length("tag") > F.col("contig_length"))),
        "wrong_key": anchors.where(F.col("canon") != canonical("tag")),
        "wrong_length": anchors.where(F.length("tag") != lengths),
        "unknown_enzyme": anchors.where(lengths.isNull()),
        "duplicate_row": anchors.groupBy("genome_id", "contig_id", "position", "enzyme_idx").count().where("count > 1"),
        "wrong_offset": offsets.where("offset <> stored"),
        "duplicate_contig": contigs.groupBy("genome_id", "contig_id").count().where("count > 1"),
    }
    if "row" in anchors.columns:
        key = F.struct(*(order or ["contig_id", "position", "enzyme_idx"]))
        found["unsorted_row"] = anchors.withColumn("before", F.lag(key).over(W.partitionBy("genome_id").orderBy("row", key))).where(F.col("before") >= key)
    if "genome" in contigs.columns:
        found["repeated_genome_name"] = contigs.groupBy("genome").agg(F.countDistinct("genome_id").alias("n")).where("n > 1")
    if "genome_len" in contigs.columns:
        found["wrong_genome_length"] = contigs.groupBy("genome_id").agg(F.sum("length").alias("n"), F.max("genome_len").alias("genome_len")).where("n <> genome_len")
    if "global_position" in anchors.columns:
        found["wrong_global_position"] = known.where("global_position <> contig_offset + position")
    bad = None
    for name in RULES:
        if name in found:
            one = found[name].select(F.lit(name).alias("check"))
            bad = one if bad is None else bad.unionByName(one)
    names = anchors.sparkSession.createDataFrame([(n,) for n in RULES], "check string")
    return names.join(bad.groupBy("check").agg(F.count("*").alias("n")), "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n_bad"))


def assemble(contigs: DataFrame, sites: DataFrame, flank: int = 250) -> DataFrame:
    """The anchor table: sites with global position, local GC, key and flags."""
    out = global_position(with_flags(local_gc(sites, contigs, flank), contigs), contigs)
    return out.withColumn("flags", F.col("flags") + F.when(F.col("local_gc") == 255, GC_UNDEFINED).otherwise(0))


#: The manifest's schema but for its parameters, which may grow.
MANIFEST_GENOMES = "array<struct<id int, name string, taxonomy string, genome_len bigint, ori bigint, ori_confidence double, contigs array<struct<id int, name string, length bigint, offset bigint, kind string>>>>"


def save(anchors: DataFrame, contigs: DataFrame, path: str, params: dict, genomes: DataFrame | None = None) -> None:
    """Parquet by genome, sorted within; the manifest beside it."""
    anchors.repartition("genome_id").sortWithinPartitions("genome_id", "contig_id", "position", "enzyme_idx").write.mode("overwrite").partitionBy("genome_id").parquet(f"{path}/anchors")
    contigs.drop("seq").write.mode("overwrite").parquet(f"{path}/contigs")
    contigs = anchors.sparkSession.read.parquet(f"{path}/contigs")
    if genomes is None:
        genomes = contigs.groupBy("genome_id", "genome").agg(F.sum("length").alias("genome_len"))
    write_manifest(genomes, contigs, params, f"{path}/manifest")


def write_manifest(genomes: DataFrame, contigs: DataFrame, params: dict, path: str) -> None:
    """One JSON document: format version, parameters, and an array with one line a genome, its contigs nested (at most 65,536).

    The lines of genomes are made by Spark and written in order; nothing holds the document as a whole.
    """
    import json

    has = lambda c, kind: (F.col(c) if c in genomes.columns else F.lit(None)).cast(kind).alias(c)
    parts = contigs.groupBy(F.col("genome_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col("contig_id").cast("int").alias("id"), "name", F.col("length").cast("bigint").alias("length"), F.col("offset").cast("bigint").alias("offset"), "kind"))).alias("contigs"))
    rows = genomes.select(F.col("genome_id").cast("int").alias("id"), F.col("genome").alias("name"), has("taxonomy", "string"), F.col("genome_len").cast("bigint").alias("genome_len"), has("ori", "bigint"), has("ori_confidence", "double")).join(parts, "id", "left")
    first = genomes.agg(F.min("genome_id")).first()[0]
    line = F.concat(F.when(F.col("id") == first, "").otherwise(","), F.to_json(F.struct("id", "name", "taxonomy", "genome_len", "ori", "ori_confidence", "contigs")))
    ends = [(0, json.dumps({"format_version": 1, "params": params})[:-1] + ', "genomes": ['), (2, "]}")]
    frame = genomes.sparkSession.createDataFrame(ends, "part int, value string").select("part", F.lit(0).alias("id"), "value")
    rows.select(F.lit(1).alias("part"), "id", line.alias("value")).unionByName(frame).orderBy("part", "id").select("value").coalesce(1).write.mode("overwrite").text(path)


def load(spark, path: str) -> tuple[DataFrame, DataFrame, dict]:
    """(anchors, contigs, params); another format version raises."""
    manifest = spark.read.json(f"{path}/manifest", multiLine=True).head()
    if manifest.format_version != 1:
        raise ValueError(f"format_version {manifest.format_version} isn't supported")
    return spark.read.parquet(f"{path}/anchors"), spark.read.parquet(f"{path}/contigs"), manifest.params.asDict()


# -- the same in DuckDB -------------------------------------------------------

CANON = "least(tag, reverse(translate(tag, 'ACGT', 'TGCA')))"
FLAGGED_SQL = f"""per AS (SELECT canon, genome_id, count(DISTINCT (contig_id, position)) AS loci FROM (SELECT *, {CANON} AS canon FROM sites) GROUP BY ALL),
anchors AS MATERIALIZED (SELECT s.*, p.canon, c.kind, p.loci, g.genomes,
    (CASE WHEN loci = 1 THEN 1 ELSE 4 END + CASE WHEN genomes = 1 THEN 2 ELSE 8 END + CASE WHEN kind = 'plasmid' THEN 16 ELSE 0 END)::INT AS flags
  FROM (SELECT *, {CANON} AS canon FROM sites) s JOIN per p USING (canon, genome_id) JOIN (SELECT canon, count(*) AS genomes FROM per GROUP BY canon) g USING (canon)
  JOIN contigs c USING (genome_id, contig_id))"""
