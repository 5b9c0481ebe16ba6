"""Command line: index, profile, stats, manifest, dynamics, audit, digest, scaffold, simulate.

    python -m tagforge.cli index GENOME... -o DB [-e all] [-a taxonomy.tsv] [--ori ori.tsv]
    python -m tagforge.cli profile READS... -d DB -o OUT [--mode wms|2brad] [--max-mismatch 2]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagforge.functions.seq import dequantize_gc
from tagforge.operators import anchors as A
from tagforge.operators import digest as D
from tagforge.operators import dynamics as Y
from tagforge.operators import em, match, report, scaffold, screen, simulate
from tagforge.operators import windows as N
from tagforge.panel import bitset, selection
from tagforge.session import stored
from tagforge.sources import fasta, staged, tables, tgt

VERSION = "0.3"


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    contigs = fasta.with_genome_ids(fasta.read_fasta(spark, a.genomes))
    enzymes = selection(a.enzymes)
    built = A.assemble(contigs, D.sites(contigs, enzymes, a.min_contig_len, a.gc_flank), a.gc_flank)
    genomes = contigs.groupBy("genome_id", "genome").agg(F.sum("length").alias("genome_len"), F.count("*").alias("n_contigs"))
    if a.taxonomy:
        genomes = tables.attach_taxonomy(genomes, tables.read_taxonomy(spark, a.taxonomy))
    if a.ori:
        genomes = tables.attach_origins(genomes, tables.read_origins(spark, a.ori))
    genomes.write.mode("overwrite").parquet(f"{a.out}/genomes")
    params = {"enzymes": bitset(enzymes), "gc_flank": a.gc_flank, "min_contig_len": a.min_contig_len, "reject_ambiguous_tags": True, "engine_version": VERSION}
    A.save(built, contigs, a.out, params, spark.read.parquet(f"{a.out}/genomes"))
    if a.screen_scale:
        screen.sketch(contigs, scale=a.screen_scale).withColumn("scale", F.lit(a.screen_scale)).write.mode("overwrite").parquet(f"{a.out}/sketch")
    if a.write_tgt:
        tgt.write_all(spark.read.parquet(f"{a.out}/anchors"), contigs, f"{a.out}/tgt")


KEY = match.ANCHOR_KEYS


def screened(spark: SparkSession, a: argparse.Namespace, reads: DataFrame) -> DataFrame:
    """genome_id of the genomes that any sample's reads select."""
    sketch = spark.read.parquet(f"{a.db}/sketch")
    scale = sketch.select("scale").head()[0]
    genomes = spark.read.parquet(f"{a.db}/genomes").select("genome_id", "genome_len")
    sketch = sketch.drop("scale")
    chosen = screen.select(screen.votes(reads, sketch, scale=scale), screen.sketch_sizes(sketch), genomes, a.screen_min_hits, a.screen_min_frac)
    return chosen.where("keep").select("genome_id").distinct()


def profile(spark: SparkSession, a: argparse.Namespace) -> None:
    anchors, contigs, params = A.load(spark, a.db)
    enzymes = selection(a.enzymes)
    if bitset(enzymes) & ~params["enzymes"] and a.enzymes.lower() != "all":
        raise SystemExit("the database lacks some of these enzymes")
    anchors = anchors.where(F.col("enzyme_idx").isin([e.idx for e in enzymes]))
    reads = stored(fasta.read_reads(spark, a.reads, a.per_file))  # files are parsed once
    if a.screen:
        anchors = anchors.join(stored(screened(spark, a, reads)), "genome_id", "left_semi")
    wins = stored(match.read_windows(reads, enzymes))
    found = stored(match.matched_tags(match.tags(wins), anchors, a.max_mismatch))
    samples = stored(reads.groupBy("sample").agg(F.count("*").alias("reads_total")))
    if a.mode == "2brad":
        hits = match.single_tag_reads(match.of_windows(wins, found))
        counts = match.anchor_counts(hits, anchors, samples)
    else:
        hits = match.of_windows(wins, found)
        counts = match.count_tags(match.tag_counts(wins), found, anchors, samples)
    counts = counts.join(anchors.select(*KEY, "pattern", "canon", "flags", "local_gc", "global_position", "tag"), KEY)
    counts.write.mode("overwrite").parquet(f"{a.out}/counts")
    counts = spark.read.parquet(f"{a.out}/counts")
    cut = N.fixed_windows(anchors, a.window_bp) if a.windowing == "bp" else N.equal_anchor_windows(anchors, a.window_anchors)
    tables.write_counts(tables.named_counts(counts, spark.read.parquet(f"{a.db}/genomes"), cut.select(*KEY, "window_id")), f"{a.out}/counts_tsv", not a.usable_only)
    em.split_shared(counts).select("sample", *KEY, F.col("count").alias("raw_count"), F.format_string("%.9f", "weight").alias("assigned_weight")).write.mode("overwrite").csv(f"{a.out}/em", sep="\t", header=True)
    em.summary(counts).write.mode("overwrite").parquet(f"{a.out}/abundance")
    cut.select(*KEY, "window_id").write.mode("overwrite").parquet(f"{a.out}/window_ids")
    tables.write_tsv(N.window_table(cut, contigs), f"{a.out}/windows")
    tables.write_stats(match.sample_stats(samples, match.window_summary(wins, hits)), f"{a.out}/stats")
    if not a.no_stats:
        statistics(spark, a)


def statistics(spark: SparkSession, a: argparse.Namespace) -> None:
    """From the counts of a profile to the output table; all genomes in one plan."""
    genomes = spark.read.parquet(f"{a.db}/genomes")
    counts = spark.read.parquet(f"{a.out}/counts")
    if a.use_windows:
        counts = counts.join(spark.read.parquet(f"{a.out}/window_ids"), KEY, "left")
    table = counts.withColumn("enzyme", F.col("enzyme_idx")).withColumn("usable", A.usable()).withColumn("gc", dequantize_gc("local_gc"))
    gates = {"min_coverage": a.min_coverage, "min_fraction": a.min_fraction, "max_dispersion": a.max_dispersion, "min_fit_rate": a.min_enzyme_fit_rate, "min_containment": a.min_containment}
    rates, fits, out = report.estimate(
        table, genomes, count_model={"nb": "ztnb"}.get(a.count_model, a.count_model), method=a.method, gc_correct=not a.no_gc_correct, min_windows=a.min_windows, window_cap=a.window_cap, shared_ori=not a.per_enzyme_ori,
        loess_frac=a.loess_frac, alpha=a.alpha, min_anchors=a.min_anchors_per_enzyme, given_windows=a.use_windows, containment=spark.read.parquet(f"{a.out}/abundance"), gates=gates, ori_prior=a.ori_prior,
    )
    tables.write_output(out, f"{a.out}/output")
    if a.figures:
        for name, points in report.figures(rates, fits).items():
            tables.write_tsv(points, f"{a.out}/figures/{name}")
        staged.write_named(report.svg_figures(rates, fits, out, genomes), f"{a.out}/svg", ".svg")


def manifest(spark: SparkSession, a: argparse.Namespace) -> None:
    """Writes the database's manifest: one JSON document with parameters and an array of genomes and their contigs."""
    _, contigs, params = A.load(spark, a.db)
    A.write_manifest(spark.read.parquet(f"{a.db}/genomes"), contigs, params, a.out)


def dynamics(spark: SparkSession, a: argparse.Namespace) -> None:
    out = tables.read_outputs(spark, a.inputs)
    rows = out if a.include_failed else Y.passing(out)
    is_base = None
    if a.metadata:
        rows = rows.join(spark.read.csv(a.metadata, sep="\t", header=True), "sample", "left")
    rows = rows.select("*", *[F.lit(other).cast("string").alias(c) for c, other in (("group", "-"), ("timepoint", None)) if c not in rows.columns]).withColumnRenamed("genome", "genome_id")
    if a.baseline:
        rows, is_base = rows.withColumn("is_baseline", Y.in_baseline(a.baseline)), F.col("is_baseline")
    from tagforge.functions.stats import t_pvalue, z_pvalue

    d = Y.benjamini_hochberg(Y.delta(rows, is_base).withColumn("p", z_pvalue("z")), "p")
    named = {"genome_id": "genome", "base": "baseline_log2_ptr", "delta": "delta_log2_ptr", "delta_se": "se", "fold": "fold_change"}
    table = d.drop("se").select(*[F.col(c).alias(named.get(c, c)) for c in ("genome_id", "sample", "group", "timepoint", "log2_ptr", "base", "delta", "delta_se", "z", "p", "fold", "q")])
    tables.write_tsv(table.orderBy("genome", "sample"), f"{a.out}/delta")
    if a.metadata and rows.where(F.col("timepoint").isNotNull()).head(1):
        t = Y.trend(d.drop("se").withColumnRenamed("delta_se", "se").withColumn("timepoint", F.col("timepoint").cast("double")), "timepoint", ["genome_id"])
        t = t.withColumn("p", t_pvalue("t", (F.col("n") - 2).cast("double")))
        tables.write_tsv(t.select(F.col("genome_id").alias("genome"), "slope", F.col("slope_se").alias("se"), "t", "p", "n").orderBy("genome"), f"{a.out}/trend")


def audit(spark: SparkSession, a: argparse.Namespace) -> None:
    anchors, contigs, _ = A.load(spark, a.db)
    table = report.audit(anchors, contigs, a.min_anchors_per_enzyme, a.wide_gap)
    tables.write_tsv(table, f"{a.out}/audit")
    report.html_lines(table, "Database audit", ["genome_id"]).coalesce(1).write.mode("overwrite").text(f"{a.out}/audit_html")


def digest(spark: SparkSession, a: argparse.Namespace) -> None:
    contigs = fasta.with_genome_ids(fasta.read_fasta(spark, a.genomes))
    sites = D.sites(contigs, selection(a.enzymes), a.min_contig_len)
    tables.write_tsv(D.density(sites, contigs), f"{a.out}/density")
    tables.write_tsv(D.union_density(sites, contigs, a.merge_window), f"{a.out}/union")


def scaffold_draft(spark: SparkSession, a: argparse.Namespace) -> None:
    anchors, contigs, _ = A.load(spark, a.db)
    draft = fasta.with_genome_ids(fasta.read_fasta(spark, [a.draft]))
    ref = contigs.where(F.col("genome") == a.reference).select("genome_id").distinct()
    sites = D.sites(draft, selection(a.enzymes), 0)
    placed = scaffold.place(scaffold.shared_tags(sites, anchors.join(ref, "genome_id", "left_semi")), draft, a.min_tags, a.min_concordance)
    tables.write_tsv(placed.orderBy("ref_start", "contig_id"), f"{a.out}/placements")
    if a.index_fasta:
        scaffold.fasta(draft, placed).orderBy("ord").select("record").coalesce(1).write.mode("overwrite").text(f"{a.out}/fasta")


def simulate_grid(spark: SparkSession, a: argparse.Namespace) -> None:
    arms = simulate.route_a(tuple(d / 0.8 for d in (0.5, 1.0, 2.0, 8.0)), a.seed)
    tables.write_tsv(simulate.errors(simulate.run_grid(spark, arms, [0.5, 1.0, 2.0], a.reps, a.estimator, seed=a.seed)), a.out)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tagforge")
    p.add_argument("--version", action="version", version=f"tagforge {VERSION}")
    p.add_argument("-t", "--threads", type=int, help="cores of a local session")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-q", "--quiet", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *positional):
        c = sub.add_parser(name)
        for x, many in positional:
            c.add_argument(x, nargs="+" if many else None)
        c.add_argument("-o", "--out", required=True)
        c.set_defaults(run=run)
        return c

    def statistics_options(c):
        c.add_argument("--method", choices=("auto", "v_shape", "sorted"), default="auto")
        c.add_argument("--count-model", choices=("auto", "ztp", "nb"), default="auto")
        c.add_argument("--window-cap", type=int, default=100)
        c.add_argument("--use-windows", action="store_true", help="take the profile's windows instead of each enzyme's own")
        c.add_argument("--per-enzyme-ori", action="store_true")
        c.add_argument("--ori-prior", action="store_true", help="known origins of confidence below 1 draw the search instead of fixing it")
        c.add_argument("--min-windows", type=int, default=5)
        c.add_argument("--no-gc-correct", action="store_true")
        c.add_argument("--loess-frac", type=float, default=0.4)
        c.add_argument("--alpha", type=float, default=0.05)
        c.add_argument("--min-anchors-per-enzyme", type=int, default=30)
        c.add_argument("--min-coverage", type=float, default=1.0)
        c.add_argument("--min-fraction", type=float, default=0.75)
        c.add_argument("--max-dispersion", type=float, default=5.0)
        c.add_argument("--min-containment", type=float, default=0.5)
        c.add_argument("--min-enzyme-fit-rate", type=float, default=0.8)
        c.add_argument("--figures", action="store_true")

    c = command("index", index, ("genomes", True))
    c.add_argument("-e", "--enzymes", default="all")
    c.add_argument("-a", "--taxonomy")
    c.add_argument("--ori")
    c.add_argument("--min-contig-len", type=int, default=500)
    c.add_argument("--gc-flank", type=int, default=250)
    c.add_argument("--screen-scale", type=int)
    c.add_argument("--write-tgt", action="store_true")
    c = command("profile", profile, ("reads", True))
    c.add_argument("-d", "--db", required=True)
    c.add_argument("--mode", choices=("wms", "2brad"), default="wms")
    c.add_argument("-e", "--enzymes", default="all")
    c.add_argument("--max-mismatch", type=int, default=2)
    c.add_argument("--per-file", action="store_true")
    c.add_argument("--windowing", choices=("anchors", "bp"), default="anchors")
    c.add_argument("--window-anchors", type=int, default=100)
    c.add_argument("--window-bp", type=int, default=25_000)
    c.add_argument("--screen", action="store_true", help="count only on genomes that the sketch selects")
    c.add_argument("--screen-min-frac", type=float, default=5e-4)
    c.add_argument("--screen-min-hits", type=int, default=50)
    c.add_argument("--no-stats", action="store_true")
    c.add_argument("--usable-only", action="store_true", help="leave masked anchors out of the table of counts")
    statistics_options(c)
    c = command("stats", statistics)
    c.add_argument("-d", "--db", required=True)
    statistics_options(c)
    c = command("manifest", manifest)
    c.add_argument("-d", "--db", required=True)
    c = command("dynamics", dynamics, ("inputs", True))
    c.add_argument("-m", "--metadata")
    c.add_argument("--baseline")
    c.add_argument("--include-failed", action="store_true")
    c = command("audit", audit, ("db", False))
    c.add_argument("--wide-gap", type=int, default=5000)
    c.add_argument("--min-anchors-per-enzyme", type=int, default=50)
    c = command("digest", digest, ("genomes", True))
    c.add_argument("-e", "--enzymes", default="all")
    c.add_argument("--merge-window", type=int, default=33)
    c.add_argument("--min-contig-len", type=int, default=500)
    c = command("scaffold", scaffold_draft, ("draft", False))
    c.add_argument("-d", "--db", required=True)
    c.add_argument("-r", "--reference", required=True)
    c.add_argument("-e", "--enzymes", default="all")
    c.add_argument("--index-fasta", action="store_true")
    c.add_argument("--min-tags", type=int, default=3)
    c.add_argument("--min-concordance", type=float, default=0.8)
    c = command("simulate", simulate_grid)
    c.add_argument("--reps", type=int, default=150)
    c.add_argument("--estimator", choices=("v", "sorted"), default="v")
    c.add_argument("--seed", type=int, default=1)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if spark is None:
        builder = SparkSession.builder.appName("tagforge")
        spark = (builder.master(f"local[{a.threads}]") if a.threads else builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR" if a.quiet else ("WARN", "INFO", "DEBUG")[min(a.verbose, 2)])
    a.run(spark, a)


if __name__ == "__main__":
    main()
