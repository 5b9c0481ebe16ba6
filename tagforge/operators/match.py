"""Reads against anchors: exact and mismatch-tolerant joins, best hits, counts and per-sample figures.

A read window is one physical observation however many enzymes it satisfies, so windows are made per tag length.  What a window
hits depends on its canonical tag alone, so tags are matched, not windows: exact hits are an equi-join on (tag length, canonical tag), and
only the distinct tags without one go to the fuzzy branch: a tag within m mismatches shares at least one of m + 1 contiguous seeds with
the window, so an equi-join on (tag length, slot, seed) finds all candidates and the Hamming distance of 2-bit words settles them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagforge.functions.seq import canonical, hamming_words, pack_words, revcomp, seed_ranges
from tagforge.operators import scan
from tagforge.panel import ENZYMES, LENGTHS, Enzyme

#: A read is named by its sample, its file and its number in that file.
READ_KEYS = ["sample", "file", "read_id"]
ANCHOR_KEYS = ["genome_id", "contig_id", "position", "enzyme_idx"]


def read_windows(reads: DataFrame, enzymes: tuple[Enzyme, ...] = ENZYMES, keys: list[str] = READ_KEYS, partitions: int | None = None) -> DataFrame:
    """keys, start, tag_len, q, ambiguous, canon: windows of reads that carry a pattern of that length.

    The pattern itself must match exactly; another code in a free position makes the window ambiguous.  Reads are dealt over
    ``partitions`` before the scan, by default over the session's parallelism where the input has fewer files.
    """
    return scan.read_windows(scan.dealt(reads, partitions), enzymes, keys)


def anchor_keys(anchors: DataFrame) -> DataFrame:
    """anchor columns for joins: genome_id, contig_id, position, enzyme_idx, tag_len, tag, canon."""
    return anchors.select(*ANCHOR_KEYS, F.length("tag").alias("tag_len"), "tag", canonical("tag").alias("canon"))


def tags(wins: DataFrame) -> DataFrame:
    """tag_len, canon of the windows without doubtful bases, each once."""
    return wins.where(~F.col("ambiguous")).select("tag_len", "canon").distinct()


def exact_tags(seen: DataFrame, anchors: DataFrame) -> DataFrame:
    """tag_len, canon, anchor key, dist 0 of tags that equal an anchor's."""
    return seen.join(anchor_keys(anchors).drop("tag"), ["tag_len", "canon"]).select("tag_len", "canon", *ANCHOR_KEYS, F.lit(0).alias("dist"))


def fuzzy_tags(seen: DataFrame, anchors: DataFrame, budget: int = 2) -> DataFrame:
    """As :func:`exact_tags` for tags within 1 to ``budget`` mismatches of an anchor's, on either strand; the nearest distance, ties all kept."""

    def seeds(s, n_col):
        per = [F.when(F.col(n_col) == n, F.array(*[F.struct(F.lit(i).alias("slot"), F.substring(s, a + 1, k).alias("seed")) for i, (a, k) in enumerate(seed_ranges(n, budget + 1))])) for n in LENGTHS]
        return F.explode(F.coalesce(*per)).alias("s")

    a = anchor_keys(anchors).select(*ANCHOR_KEYS, "tag_len", pack_words("tag").alias("anchor_words"), seeds(F.col("tag"), "tag_len")).select("*", "s.slot", "s.seed").drop("s")
    w = seen.select("tag_len", "canon", F.explode(F.array("canon", revcomp("canon"))).alias("oriented"))
    w = w.select("tag_len", "canon", pack_words("oriented").alias("words"), seeds(F.col("oriented"), "tag_len")).select("tag_len", "canon", "words", "s.slot", "s.seed")
    near = w.join(a, ["tag_len", "slot", "seed"]).withColumn("dist", hamming_words("words", "anchor_words")).where(F.col("dist") <= budget)
    best = near.groupBy("tag_len", "canon", *ANCHOR_KEYS).agg(F.min("dist").alias("dist"))
    return best.withColumn("least", F.min("dist").over(W.partitionBy("tag_len", "canon"))).where("dist = least").drop("least")


def matched_tags(seen: DataFrame, anchors: DataFrame, budget: int = 2) -> DataFrame:
    """tag_len, canon, anchor key, dist: best hits of every tag, exact ones, else those of least distance, ties all kept."""
    exact = exact_tags(seen, anchors)
    if not budget:
        return exact
    missed = seen.join(anchor_keys(anchors).select("tag_len", "canon").distinct(), ["tag_len", "canon"], "left_anti")
    return exact.unionByName(fuzzy_tags(missed, anchors, budget))


def of_windows(wins: DataFrame, found: DataFrame, keys: list[str] = READ_KEYS) -> DataFrame:
    """keys, start, tag_len, anchor key, dist: the hits of tags as hits of windows."""
    return wins.where(~F.col("ambiguous")).select(*keys, "start", "tag_len", "canon").join(found, ["tag_len", "canon"]).select(*keys, "start", "tag_len", *ANCHOR_KEYS, "dist")


def exact_hits(wins: DataFrame, anchors: DataFrame, keys: list[str] = READ_KEYS) -> DataFrame:
    """Windows joined with every anchor of the same canonical tag; dist 0.  One pass over the windows."""
    a = anchor_keys(anchors).drop("tag").withColumn("dist", F.lit(0))
    return of_windows(wins, a, keys)


def matches(wins: DataFrame, anchors: DataFrame, budget: int = 2, keys: list[str] = READ_KEYS) -> DataFrame:
    """Best hits of every window; windows are read twice, so hand in a stored table where making them costs."""
    return of_windows(wins, matched_tags(tags(wins), anchors, budget), keys)


def tag_counts(wins: DataFrame) -> DataFrame:
    """sample, tag_len, canon, n: windows per sample and tag, summed before anything is joined."""
    return wins.where(~F.col("ambiguous")).groupBy("sample", "tag_len", "canon").agg(F.count("*").alias("n"))


def count_tags(counted: DataFrame, found: DataFrame, anchors: DataFrame, samples: DataFrame) -> DataFrame:
    """As :func:`anchor_counts` from :func:`tag_counts` and the hits of tags: what is joined grows with tags, not with windows."""
    n = counted.join(found, ["tag_len", "canon"]).groupBy("sample", *ANCHOR_KEYS).agg(F.sum("n").alias("n"))
    return _with_zeros(n, anchors, samples)


def _with_zeros(n: DataFrame, anchors: DataFrame, samples: DataFrame) -> DataFrame:
    every = anchors.select(*ANCHOR_KEYS).crossJoin(samples.select("sample"))
    return every.join(n, ["sample", *ANCHOR_KEYS], "left").select("sample", *ANCHOR_KEYS, F.coalesce("n", F.lit(0)).alias("count"))


def anchor_counts(hits: DataFrame, anchors: DataFrame, samples: DataFrame) -> DataFrame:
    """sample, anchor key, count: windows per anchor and sample, zeros kept (the table is defined over all anchors of all samples).  ``samples`` has one row per sample."""
    return _with_zeros(hits.groupBy("sample", *ANCHOR_KEYS).agg(F.count("*").alias("n")), anchors, samples)


def window_summary(wins: DataFrame, hits: DataFrame, keys: list[str] = READ_KEYS) -> DataFrame:
    """Per window: number of anchors and of loci hit, and the distance (null where nothing was hit)."""
    per = hits.groupBy(*keys, "start", "tag_len").agg(F.count("*").alias("n_anchors"), F.countDistinct("genome_id", "contig_id", "position").alias("n_loci"), F.min("dist").alias("dist"))
    return wins.select(*keys, "start", "tag_len", "ambiguous").join(per, [*keys, "start", "tag_len"], "left")


def sample_stats(reads: DataFrame, summary: DataFrame, keys: list[str] = READ_KEYS) -> DataFrame:
    """The counters of each sample, and the shares derived from them; a read is counted once by all of ``keys``.  ``reads`` may hold its totals already (sample, reads_total)."""
    hit = F.col("n_anchors").isNotNull()
    s = summary.groupBy("sample").agg(
        F.count("*").alias("motif_hits"), F.count_if("ambiguous").alias("tag_ambiguous"), F.count_if(~F.col("ambiguous") & ~hit).alias("tag_unmatched"), F.count_if(hit).alias("tag_matched"),
        F.count_if(F.col("n_loci") > 1).alias("tag_multi_locus"), F.count_if((F.col("n_loci") == 1) & (F.col("n_anchors") > 1)).alias("tag_multi_enzyme"),
        F.count_if(F.col("dist") == 0).alias("mismatch_0"), F.count_if(F.col("dist") == 1).alias("mismatch_1"), F.count_if(F.col("dist") == 2).alias("mismatch_2"), F.count_if(F.col("dist") >= 3).alias("mismatch_3"),
        F.countDistinct(F.when(hit, F.struct(*[k for k in keys if k != "sample"]))).alias("reads_with_anchor"),
    )
    total = reads if "reads_total" in reads.columns else reads.groupBy("sample").agg(F.count("*").alias("reads_total"))
    out = total.join(s, "sample", "left")
    clean = F.col("motif_hits") - F.col("tag_ambiguous")
    return out.select("*", clean.alias("tags_extracted"), F.round(F.try_divide("tag_matched", clean), 6).alias("match_rate"), F.round(F.try_divide(F.col("tag_matched") - F.col("tag_multi_locus"), clean), 6).alias("resolved_rate"))


def single_tag_reads(hits: DataFrame, keys: list[str] = READ_KEYS) -> DataFrame:
    """For reads that are one tag: the first matched window, by panel order of lengths, then start; all its anchors."""
    order = F.array_position(F.array(*[F.lit(n) for n in LENGTHS]), F.col("tag_len"))
    rank = F.dense_rank().over(W.partitionBy(*keys).orderBy(order, "start"))
    return hits.withColumn("rank", rank).where("rank = 1").drop("rank")


def without_multimappers(hits: DataFrame, keys: list[str] = READ_KEYS) -> DataFrame:
    """Hits of windows that lie at one locus only."""
    loci = hits.groupBy(*keys, "start", "tag_len").agg(F.countDistinct("genome_id", "contig_id", "position").alias("n")).where("n = 1").drop("n")
    return hits.join(loci, [*keys, "start", "tag_len"], "left_semi")


# -- the same in DuckDB -------------------------------------------------------


def read_windows_sql(enzymes: tuple[Enzyme, ...] = ENZYMES) -> str:
    parts = []
    for n in LENGTHS:
        rx = [e.loose_regex(p) for e in enzymes if e.length == n for p in range(len(e.patterns))]
        if rx:
            parts.append(f"SELECT sample, file, read_id, start, {n} AS tag_len, substr(w, 1, {n}) AS q FROM rw WHERE " + " OR ".join(f"regexp_matches(w, '{r}')" for r in rx))
    return "rw AS MATERIALIZED (SELECT sample, file, read_id, p AS start, substr(seq, p::INT + 1, 33) AS w FROM reads, range(100) t(p) WHERE p < length(seq)),\nqs AS MATERIALIZED (SELECT *, regexp_matches(q, '[^ACGT]') AS ambiguous FROM (" + "\nUNION ALL ".join(parts) + "))"


CANON_Q = "least(q, reverse(translate(q, 'ACGT', 'TGCA')))"
EXACT_SQL = f"""exact AS MATERIALIZED (SELECT sample, file, read_id, start, tag_len, genome_id, contig_id, position, enzyme_idx, 0 AS dist
  FROM qs JOIN (SELECT *, least(tag, reverse(translate(tag, 'ACGT', 'TGCA'))) AS canon FROM sites) s ON s.canon = {CANON_Q} AND length(s.tag) = tag_len WHERE NOT ambiguous)"""


def fuzzy_sql(budget: int = 2) -> str:
    """The fuzzy branch by seeds, then best hits."""
    seed = lambda s: "CASE tag_len " + " ".join(f"WHEN {n} THEN [" + ", ".join(f"{{'slot': {i}, 'seed': substr({s}, {a + 1}, {k})}}" for i, (a, k) in enumerate(seed_ranges(n, budget + 1))) + "]" for n in LENGTHS) + " END"
    return f"""missed AS (SELECT * FROM qs ANTI JOIN exact USING (sample, file, read_id, start, tag_len) WHERE NOT ambiguous),
oriented AS (SELECT sample, file, read_id, start, tag_len, unnest([q, reverse(translate(q, 'ACGT', 'TGCA'))]) AS o FROM missed),
oseed AS (SELECT *, unnest({seed("o")}) AS s FROM oriented),
aseed AS (SELECT *, unnest({seed("tag")}) AS s FROM (SELECT *, length(tag) AS tag_len FROM sites)),
near AS (SELECT o.sample, o.file, o.read_id, o.start, o.tag_len, a.genome_id, a.contig_id, a.position, a.enzyme_idx, min(hamming(o.o, a.tag))::INT AS dist
  FROM oseed o JOIN aseed a ON o.tag_len = a.tag_len AND o.s.slot = a.s.slot AND o.s.seed = a.s.seed WHERE hamming(o.o, a.tag) <= {budget} GROUP BY ALL),
hits AS MATERIALIZED (SELECT * FROM exact UNION ALL SELECT * FROM near QUALIFY rank() OVER (PARTITION BY sample, file, read_id, start, tag_len ORDER BY dist) = 1),
summary AS (SELECT q.sample, q.file, q.read_id, q.start, q.tag_len, q.ambiguous, h.n_anchors, h.n_loci, h.dist FROM qs q LEFT JOIN (
  SELECT sample, file, read_id, start, tag_len, count(*) AS n_anchors, count(DISTINCT (genome_id, contig_id, position)) AS n_loci, min(dist) AS dist FROM hits GROUP BY ALL) h USING (sample, file, read_id, start, tag_len))"""
