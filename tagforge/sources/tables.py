"""Readers and writers of the tab-separated and JSON tables, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagforge.functions.seq import dequantize_gc
from tagforge.operators.anchors import MANIFEST_GENOMES, usable
from tagforge.panel import ENZYMES

# Columns of the tables, in file order.
COUNT_COLUMNS = "sample string, genome_id int, genome string, contig_id int, position bigint, global_position bigint, enzyme string, strand string, flags int, local_gc int, window_id bigint, count int"
WINDOW_COLUMNS = "window_id bigint, genome_id int, genome string, contig_id int, start bigint, end bigint, global_mid bigint, span bigint, n_anchors int"
OUTPUT_COLUMNS = (
    "sample genome taxonomy coverage dispersion fraction containment PTR log2(PTR) enzyme_consistency n_anchors ori_confidence se ci_low ci_high n_enzymes n_enzymes_attempted "
    "enzyme_fit_rate enzymes_used enzyme_i2 fusion_model ori method n_windows pass_qc qc_reason excluded note"
).split()
NO_WINDOW = 4294967295


def write_tsv(df: DataFrame, path: str, null: str = "NA") -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue=null, emptyValue="", quote="")


def _require(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by its header: columns in any order, extra ones kept as text, missing ones an error."""
    from pyspark.sql import types as T

    raw = spark.read.csv(path, sep="\t", header=True, nullValue="NA", quote="")
    kinds = T._parse_datatype_string(schema)
    _require(raw, kinds.names)
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in kinds], *[F.col(f"`{c}`") for c in raw.columns if c not in kinds.names])


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    c = read_tsv(spark, path, COUNT_COLUMNS)
    return c.withColumn("window_id", F.nullif("window_id", F.lit(NO_WINDOW))).withColumn("gc", dequantize_gc("local_gc")).withColumn("usable", usable())


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, WINDOW_COLUMNS)


def write_counts(counts: DataFrame, path: str, masked: bool = True) -> None:
    names = [c.split()[0] for c in COUNT_COLUMNS.split(", ")]
    rows = counts if masked else counts.where(usable())
    write_tsv(rows.withColumn("window_id", F.coalesce("window_id", F.lit(NO_WINDOW))).select(*names), path)


def concat_counts(tables: list[DataFrame]) -> DataFrame:
    """All samples' counts; samples counted against different databases raise."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    sign = out.groupBy("sample").agg(F.countDistinct("genome_id").alias("g"), F.count("*").alias("n"), F.sum("position").alias("p"))
    if sign.select("g", "n", "p").distinct().limit(2).count() > 1:
        raise ValueError("samples were counted against different databases")
    return out


def significant(c: str, digits: int = 10):
    """A double as text of so many significant digits."""
    return F.when(F.col(f"`{c}`").isNotNull(), F.format_string(f"%.{digits - 1}e", F.col(f"`{c}`").cast("double")).cast("double").cast("string"))


def write_output(out: DataFrame, path: str) -> None:
    """The 28 columns, sorted by sample and genome; absent ones are NA."""
    kinds = dict(out.dtypes)
    columns = [F.lit(None).cast("string").alias(c) if c not in kinds else (significant(c).alias(c) if kinds[c] == "double" else F.col(f"`{c}`").cast("string").alias(c)) for c in OUTPUT_COLUMNS]
    write_tsv(out.select(*columns).orderBy("sample", "genome"), path)


def read_outputs(spark: SparkSession, paths: list[str]) -> DataFrame:
    raw = spark.read.csv(paths, sep="\t", header=True, nullValue="NA", quote="")
    _require(raw, ["log2(PTR)"])
    return raw.withColumn("source", F.input_file_name()).withColumn("log2_ptr", F.col("`log2(PTR)`").cast("double")).withColumn("se", F.col("se").cast("double"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per genome of a manifest: id, name, taxonomy, genome_len, ori, ori_confidence, contigs, n_contigs, and of the database its enzymes by name, gc_flank and format version."""
    schema = f"format_version int, params struct<enzymes int, gc_flank int, min_contig_len int, engine_version string>, genomes {MANIFEST_GENOMES}"
    m = spark.read.schema(schema).json(path, multiLine=True)
    names = F.array_compact(F.array(*[F.when(F.col("params.enzymes").bitwiseAND(1 << e.idx) != 0, F.lit(e.name)) for e in ENZYMES]))
    rows = m.select(F.explode("genomes").alias("g"), names.alias("enzymes"), F.coalesce("params.gc_flank", F.lit(250)).alias("gc_flank"), "format_version")
    return rows.select("g.*", F.size(F.coalesce("g.contigs", F.array())).alias("n_contigs"), "enzymes", "gc_flank", "format_version")


def named_counts(counts: DataFrame, genomes: DataFrame, window_ids: DataFrame) -> DataFrame:
    """Counts with names of genome and enzyme, strand and window, as :func:`write_counts` takes them."""
    key = ["genome_id", "contig_id", "position", "enzyme_idx", "pattern"]
    names = F.array(*[F.lit(e.name) for e in ENZYMES])
    out = counts.join(window_ids, [k for k in key if k in counts.columns and k in window_ids.columns], "left").join(genomes.select("genome_id", "genome"), "genome_id", "left")
    return out.withColumn("enzyme", F.get(names, F.col("enzyme_idx"))).withColumn("strand", F.when(F.col("pattern") == 0, "+").otherwise("-"))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """The counters of samples that :func:`write_stats` wrote."""
    return spark.read.json(path)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """genome, taxonomy: comments and blank lines skipped, the last line of a genome wins."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line")).where("trim(line) <> '' and not startswith(trim(line), '#')")
    cut = lines.select("at", F.trim(F.split("line", "\t")[0]).alias("genome"), F.trim(F.get(F.split("line", "\t"), 1)).alias("taxonomy"))
    return cut.groupBy("genome").agg(F.max_by("taxonomy", "at").alias("taxonomy"))


def read_origins(spark: SparkSession, path: str) -> DataFrame:
    """genome, ori, ori_confidence, ori_source from two to four columns."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')")
    get = lambda i: F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit(""))
    return lines.select(get(0).alias("genome"), get(1).try_cast("bigint").alias("ori"), F.coalesce(get(2).try_cast("double"), F.lit(1.0)).alias("ori_confidence"), F.coalesce(get(3), F.lit("annotation")).alias("ori_source"))


def attach_taxonomy(genomes: DataFrame, taxonomy: DataFrame) -> DataFrame:
    return genomes.join(taxonomy, "genome", "left")


def attach_origins(genomes: DataFrame, origins: DataFrame) -> DataFrame:
    """Origins by genome name; positions beyond the genome are ignored."""
    o = origins.withColumnRenamed("genome", "__g")
    return genomes.join(o, (F.col("__g") == F.col("genome")) & (F.col("ori") < F.col("genome_len")), "left").drop("__g")
