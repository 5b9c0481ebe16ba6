"""Queries on reads: matching, counting, screening and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagforge.operators import anchors as A
from tagforge.operators import digest as D
from tagforge.operators import em as E
from tagforge.operators import match as M
from tagforge.operators import screen as K
from tagforge.panel import selection
from tagforge.plans.registry import query
from tagforge.session import stored
from tagforge.sources import fixtures as X

SUBSET = selection("BcgI,CjePI,HaeIV")
BASE = (X.CONTIGS_SQL, X.READS_SQL, D.SITES_SQL)
EXACT = (*BASE, M.read_windows_sql(), M.EXACT_SQL)
FUZZY = (*EXACT, M.fuzzy_sql())
EM = (*EXACT, A.FLAGGED_SQL, E.COUNTED_SQL)
SUB = (*BASE, M.read_windows_sql(SUBSET), M.EXACT_SQL.replace("FROM sites)", f"FROM sites WHERE enzyme_idx IN ({', '.join(str(e.idx) for e in SUBSET)}))"))
SCREEN = (X.CONTIGS_SQL, X.READS_SQL, K.SKETCH_SQL, K.VOTES_SQL)
KEY = ["genome_id", "contig_id", "position", "enzyme_idx"]


def setting(spark, d, enzymes=None, keep=False):
    """(reads, their windows, sites) of the fixture; ``keep`` stores the windows for plans that read them twice."""
    r = X.reads(spark, d)
    e = enzymes or selection("all")
    w = M.read_windows(r, e)
    return r, stored(w) if keep else w, D.sites(X.contigs(spark, d), e)


def samples(reads):
    return reads.select("sample").distinct()


def counted(spark, d):
    """sample, anchor, canon, flags, count of exact hits."""
    _, w, s = setting(spark, d)
    c, a = X.contigs(spark, d), M.anchor_keys(s)
    flagged = stored(A.with_flags(s, c).select(*KEY, "canon", "flags"))
    tags = stored(M.tag_counts(w))
    return M.count_tags(tags, a.drop("tag"), flagged, samples(X.reads(spark, d))).join(flagged, KEY)


def tag_count(spark, d, budget, enzymes=None):
    """Counts per anchor and sample from windows summed by tag, in one scan of the reads."""
    r, w, s = setting(spark, d, enzymes)
    s = stored(s)
    n = stored(M.tag_counts(w))
    return M.count_tags(n, M.matched_tags(n.select("tag_len", "canon").distinct(), s, budget), s, samples(r))


COUNT_SQL = "SELECT s.sample, a.genome_id, a.contig_id, a.position, a.enzyme_idx, coalesce(n, 0) AS count FROM {anchors} a CROSS JOIN (SELECT DISTINCT sample FROM reads) s LEFT JOIN (SELECT sample, genome_id, contig_id, position, enzyme_idx, count(*) AS n FROM {hits} GROUP BY ALL) USING (sample, genome_id, contig_id, position, enzyme_idx)"


@query(COUNT_SQL.format(anchors="sites", hits="exact"), EXACT)
def count_exact(spark, d):
    return tag_count(spark, d, 0)


@query(COUNT_SQL.format(anchors="sites", hits="hits"), FUZZY)
def count_fuzzy(spark, d):
    return tag_count(spark, d, 2)


@query("SELECT sample, dist, count(*) AS n_hits, count(DISTINCT (file, read_id, start, tag_len)) AS n_windows FROM hits GROUP BY ALL", FUZZY)
def best_hit_ties(spark, d):
    _, w, s = setting(spark, d, keep=True)
    return M.matches(w, s).groupBy("sample", "dist").agg(F.count("*").alias("n_hits"), F.countDistinct("file", "read_id", "start", "tag_len").alias("n_windows"))


STATS_SQL = """SELECT r.sample, reads_total, motif_hits, tag_ambiguous, tag_unmatched, tag_matched, tag_multi_locus, tag_multi_enzyme, mismatch_0, mismatch_1, mismatch_2, mismatch_3, reads_with_anchor,
  motif_hits - tag_ambiguous AS tags_extracted, round(tag_matched / nullif(motif_hits - tag_ambiguous, 0)::DOUBLE, 6) AS match_rate, round((tag_matched - tag_multi_locus) / nullif(motif_hits - tag_ambiguous, 0)::DOUBLE, 6) AS resolved_rate
FROM (SELECT sample, count(*) AS reads_total FROM reads GROUP BY sample) r LEFT JOIN (SELECT sample, count(*) AS motif_hits, count(*) FILTER (ambiguous) AS tag_ambiguous,
  count(*) FILTER (NOT ambiguous AND n_anchors IS NULL) AS tag_unmatched, count(*) FILTER (n_anchors IS NOT NULL) AS tag_matched, count(*) FILTER (n_loci > 1) AS tag_multi_locus,
  count(*) FILTER (n_loci = 1 AND n_anchors > 1) AS tag_multi_enzyme, count(*) FILTER (dist = 0) AS mismatch_0, count(*) FILTER (dist = 1) AS mismatch_1, count(*) FILTER (dist = 2) AS mismatch_2,
  count(*) FILTER (dist >= 3) AS mismatch_3, count(DISTINCT (file, read_id)) FILTER (n_anchors IS NOT NULL) AS reads_with_anchor FROM summary GROUP BY sample) s USING (sample)"""


@query(STATS_SQL, FUZZY)
def count_stats(spark, d):
    r, w, s = setting(spark, d, keep=True)
    return M.sample_stats(r, M.window_summary(w, M.matches(w, s)))


@query("SELECT coalesce(dist, -1) AS dist, tag_len, count(*) AS n FROM summary GROUP BY ALL", FUZZY)
def mismatch_hist(spark, d):
    _, w, s = setting(spark, d, keep=True)
    return M.window_summary(w, M.matches(w, s)).groupBy(F.coalesce("dist", F.lit(-1)).alias("dist"), "tag_len").agg(F.count("*").alias("n"))


@query("SELECT sample, file, read_id, start, tag_len, genome_id, contig_id, position, enzyme_idx, dist FROM exact QUALIFY dense_rank() OVER (PARTITION BY sample, file, read_id ORDER BY list_position([32, 27, 28, 25, 33], tag_len), start) = 1", EXACT)
def two_brad_first_hit(spark, d):
    _, w, s = setting(spark, d)
    return M.single_tag_reads(M.exact_hits(w, s))


@query(COUNT_SQL.format(anchors="(SELECT * FROM sites WHERE enzyme_idx IN (" + ", ".join(str(e.idx) for e in SUBSET) + "))", hits="exact"), SUB)
def enzyme_restricted_counts(spark, d):
    return tag_count(spark, d, 0, SUBSET)


@query("SELECT e.* FROM exact e SEMI JOIN (SELECT sample, file, read_id, start, tag_len FROM exact GROUP BY ALL HAVING count(DISTINCT (genome_id, contig_id, position)) = 1) USING (sample, file, read_id, start, tag_len)", EXACT)
def multimapper_drop(spark, d):
    _, w, s = setting(spark, d, keep=True)
    return M.without_multimappers(M.exact_hits(w, s))


@query("SELECT sample, genome_id, contig_id, position, enzyme_idx, count, round(weight, 6) AS weight FROM split", EM)
def em_split(spark, d):
    return E.split_shared(counted(spark, d)).select("sample", *KEY, "count", F.round("weight", 6).alias("weight"))


@query(
    """SELECT sample, genome_id, round("lambda", 6) AS "lambda", n_unique, n_detected, round(n_detected / nullif(n_unique, 0)::DOUBLE, 6) AS containment, round(mass, 6) AS assigned_mass
FROM lam JOIN (SELECT sample, genome_id, sum(weight) AS mass FROM split GROUP BY ALL) USING (sample, genome_id)""",
    EM,
)
def em_abundance(spark, d):
    s = E.summary(counted(spark, d))
    return s.select("sample", "genome_id", F.round("lambda", 6).alias("lambda"), "n_unique", "n_detected", F.round("containment", 6).alias("containment"), F.round("assigned_mass", 6).alias("assigned_mass"))


@query(
    "SELECT sample, genome_id, contig_id, position, enzyme_idx, count, round(weight, 6) AS weight FROM split",
    (*SUB, A.FLAGGED_SQL, E.COUNTED_SQL.replace("FROM anchors a", f"FROM (SELECT * FROM anchors WHERE enzyme_idx IN ({', '.join(str(e.idx) for e in SUBSET)})) a")),
)
def em_enzyme_restricted(spark, d):
    flagged = A.with_flags(setting(spark, d)[2], X.contigs(spark, d)).select(*KEY, "canon", "flags")
    return E.split_shared(tag_count(spark, d, 0, SUBSET).join(flagged, KEY)).select("sample", *KEY, "count", F.round("weight", 6).alias("weight"))


@query("SELECT genome_id, size FROM sizes", (X.CONTIGS_SQL, K.SKETCH_SQL))
def screen_sketch_sizes(spark, d):
    return K.sketch_sizes(K.sketch(X.contigs(spark, d)))


@query("SELECT sample, genome_id, hits FROM votes", SCREEN)
def screen_votes(spark, d):
    return K.votes(X.reads(spark, d), K.sketch(X.contigs(spark, d)))


def screened(spark, d):
    c = X.contigs(spark, d)
    sk = stored(K.sketch(c))
    size = c.groupBy("genome_id").agg(F.sum("length").alias("genome_len"))
    return stored(K.select(K.votes(X.reads(spark, d), sk), K.sketch_sizes(sk), size, min_hits=400, min_fraction=0.05))


@query("SELECT sample, genome_id, hits, round(share, 6) AS share, keep FROM screened", SCREEN)
def screen_select(spark, d):
    return screened(spark, d).select("sample", "genome_id", "hits", F.round("share", 6).alias("share"), "keep")


@query("SELECT e.sample, e.genome_id, count(*) AS n FROM exact e SEMI JOIN (SELECT * FROM screened WHERE keep) USING (sample, genome_id) GROUP BY ALL", (*EXACT, K.SKETCH_SQL, K.VOTES_SQL))
def screened_counts(spark, d):
    r, w, s = setting(spark, d)
    kept = screened(spark, d).where("keep").select("sample", "genome_id")
    few = s.join(kept.select("genome_id").distinct(), "genome_id", "left_semi")
    hits = M.tag_counts(w).join(M.anchor_keys(few).drop("tag"), ["tag_len", "canon"])
    return hits.join(kept, ["sample", "genome_id"], "left_semi").groupBy("sample", "genome_id").agg(F.sum("n").alias("n"))
