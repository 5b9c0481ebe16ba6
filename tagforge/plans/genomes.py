"""Queries on sequences, digestion and anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagforge.functions import seq as S
from tagforge.operators import anchors as A
from tagforge.operators import digest as D
from tagforge.panel import BY_NAME, CONTAINED, ENZYMES, IUPAC
from tagforge.plans.registry import query
from tagforge.sources import fixtures as X

G = (X.CONTIGS_SQL,)
GS = (*G, D.SITES_SQL)
GA = (*GS, A.FLAGGED_SQL)


def sites(spark, d):
    return D.sites(X.contigs(spark, d))


def flagged(spark, d):
    c = X.contigs(spark, d)
    return A.with_flags(D.sites(c), c)


@query("SELECT genome_id, enzyme_idx, count(*) AS n_tags, count(DISTINCT (contig_id, position)) AS n_windows, round(count(*) * 1e6 / 4000, 6) AS per_mb FROM sites GROUP BY ALL", GS)
def digest_density(spark, d):
    c = X.contigs(spark, d)
    return D.density(D.sites(c), c)


@query("SELECT genome_id, contig_id, position, enzyme_idx, pattern, tag FROM sites", GS)
def digest_sites(spark, d):
    return sites(spark, d)


@query("SELECT genome_id, contig_id, position, count(*) AS n_enzymes, sum(1 << enzyme_idx)::BIGINT AS enzyme_set FROM sites GROUP BY ALL", GS)
def union_windows(spark, d):
    g = sites(spark, d).groupBy("genome_id", "contig_id", "position")
    return g.agg(F.count("*").alias("n_enzymes"), F.sum(F.call_function("shiftleft", F.lit(1), F.col("enzyme_idx"))).alias("enzyme_set"))


@query("SELECT genome_id, contig_id, unnest(loci) AS position FROM loci", (*GS, D.LOCI_SQL))
def merge_union_loci(spark, d):
    return D.merged_loci(sites(spark, d))


@query(
    """SELECT genome_id, count(*) AS n_loci, round(avg(gap), 6) AS mean_gap, max(gap) AS max_gap, round(count(*) * 25000.0::DOUBLE / 4000, 6) AS per_25kb
FROM (SELECT genome_id, p - lag(p) OVER (PARTITION BY genome_id, contig_id ORDER BY p) AS gap FROM (SELECT genome_id, contig_id, unnest(loci) AS p FROM loci)) GROUP BY genome_id""",
    (*GS, D.LOCI_SQL),
)
def density_summary(spark, d):
    c = X.contigs(spark, d)
    return D.union_density(D.sites(c), c)


@query("SELECT genome_id, contig_id, position, enzyme_idx, pattern, coalesce(position - lag(position) OVER (PARTITION BY genome_id, contig_id ORDER BY position, enzyme_idx, pattern), 0) AS gap FROM sites", GS)
def tag_gaps(spark, d):
    return D.gaps(sites(spark, d)).drop("tag")


@query(
    """SELECT genome_id, count(*) AS n_gaps, round(avg(gap), 6) AS mean_gap, max(gap) FILTER (r = n // 2) AS median_gap, max(gap) FILTER (r = least(floor(n * 0.99), n - 1)) AS p99_gap,
  max(gap) AS max_gap, count(*) FILTER (gap > 500) AS n_wide
FROM (SELECT *, row_number() OVER (PARTITION BY genome_id ORDER BY gap) - 1 AS r, count(*) OVER (PARTITION BY genome_id) AS n FROM (
  SELECT genome_id, position - lag(position) OVER (PARTITION BY genome_id, contig_id ORDER BY position, enzyme_idx, pattern) AS gap FROM sites) WHERE gap IS NOT NULL) GROUP BY genome_id""",
    GS,
)
def spacing_stats(spark, d):
    return D.spacing(sites(spark, d))


@query("SELECT genome_id, count(*) FILTER (n < 5) AS n_thin, string_agg(enzyme_idx::VARCHAR, ',' ORDER BY enzyme_idx) FILTER (n < 5) AS thin FROM (SELECT genome_id, enzyme_idx, count(*) AS n FROM sites GROUP BY ALL) GROUP BY genome_id", GS)
def audit_thin_enzymes(spark, d):
    n = sites(spark, d).groupBy("genome_id", "enzyme_idx").agg(F.count("*").alias("n"))
    thin = F.sort_array(F.collect_list(F.when(F.col("n") < 5, F.col("enzyme_idx"))))
    return n.groupBy("genome_id").agg(F.count_if(F.col("n") < 5).alias("n_thin"), F.when(F.size(thin) > 0, F.array_join(thin.cast("array<string>"), ",")).alias("thin"))


@query(
    """SELECT genome_id, contig_id, position, enzyme_idx, coalesce(round(length(regexp_replace(w, '[^GC]', '', 'g')) / nullif(length(regexp_replace(w, '[^ACGT]', '', 'g')), 0)::DOUBLE * 200)::INT, 255) AS local_gc
FROM (SELECT s.*, substr(c.seq, greatest(position - 250, 0)::INT + 1, (position + 250 - greatest(position - 250, 0))::INT) AS w FROM sites s JOIN contigs c USING (genome_id, contig_id))""",
    GS,
)
def local_gc(spark, d):
    return D.sites(X.contigs(spark, d), flank=250).select("genome_id", "contig_id", "position", "enzyme_idx", "local_gc")


@query("SELECT genome_id, contig_id, position, enzyme_idx, loci, genomes, flags FROM anchors", GA)
def uniqueness_flags(spark, d):
    return flagged(spark, d).select("genome_id", "contig_id", "position", "enzyme_idx", "loci", "genomes", "flags")


@query("SELECT genome_id, count(*) AS n, count(*) FILTER ((flags & 28) = 0) AS n_usable, round(count(*) FILTER ((flags & 28) = 0) * 100.0::DOUBLE / count(*), 6) AS usable_percent FROM anchors GROUP BY genome_id", GA)
def usable_fraction(spark, d):
    n = F.count_if(A.usable())
    return flagged(spark, d).groupBy("genome_id").agg(F.count("*").alias("n"), n.alias("n_usable"), F.round(n * 100.0 / F.count("*"), 6).alias("usable_percent"))


@query("SELECT canon, count(DISTINCT genome_id) AS n_genomes, count(*) AS n_rows FROM anchors GROUP BY canon HAVING count(DISTINCT genome_id) > 1", GA)
def shared_groups(spark, d):
    return A.shared_groups(flagged(spark, d))


@query("SELECT genome_id, " + ", ".join(f"count(*) FILTER (enzyme_idx = {e.idx}) AS \"{e.name}\"" for e in ENZYMES) + " FROM anchors WHERE (flags & 28) = 0 GROUP BY genome_id", GA)
def per_enzyme_pivot(spark, d):
    p = flagged(spark, d).where(A.usable()).groupBy("genome_id").pivot("enzyme_idx", [e.idx for e in ENZYMES]).count().na.fill(0)
    return p.select("genome_id", *[F.col(str(e.idx)).alias(e.name) for e in ENZYMES])


@query('SELECT genome_id, contig_id, position, enzyme_idx, pattern, tag, "offset" + position AS global_position FROM sites JOIN contigs USING (genome_id, contig_id)', GS)
def global_position(spark, d):
    c = X.contigs(spark, d)
    return A.global_position(D.sites(c), c)


@query('SELECT genome_id, contig_id, coalesce(sum(length) OVER (PARTITION BY genome_id ORDER BY contig_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM contigs', G)
def contig_offsets(spark, d):
    return A.contig_offsets(X.contigs(spark, d)).select("genome_id", "contig_id", "offset")


@query("SELECT p_partkey, p_name AS name, CASE WHEN lower(p_name) LIKE '%plasmid%' OR (lower(p_name) LIKE 'p%' AND length(p_name) <= 4) THEN 'plasmid' ELSE 'chromosome' END AS kind FROM part UNION ALL SELECT genome_id, name, kind FROM contigs", G)
def classify_contig(spark, d):
    p = X.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))
    c = X.contigs(spark, d).select(F.col("genome_id").cast("bigint").alias("p_partkey"), "name")
    return p.unionByName(c).withColumn("kind", S.classify_contig("name"))


def faulty(spark, d):
    """(anchors, contigs) with at least one row against every rule."""
    c = X.contigs(spark, d)
    a = A.global_position(A.with_flags(D.sites(c), c), c).withColumn("row", F.col("contig_id") * 1_000_000 + F.col("position") * 20 + F.col("enzyme_idx"))
    n, i = F.col("position") % 97, lambda k, then, other: F.when(F.col("position") % 97 == k, then).otherwise(other)
    a = a.withColumn("contig_id", i(1, F.lit(9), F.col("contig_id"))).withColumn("enzyme_idx", i(2, F.lit(99), i(3, (F.col("enzyme_idx") + 1) % 16, F.col("enzyme_idx"))))
    a = a.withColumn("canon", i(4, F.lower("canon"), F.col("canon"))).withColumn("row", i(5, F.lit(-1), F.col("row"))).withColumn("global_position", i(6, F.col("global_position") + 1, F.col("global_position")))
    a = a.withColumn("position", F.when(n == 7, F.col("position") + 5000).otherwise(F.col("position")))
    a = a.unionByName(a.where("position % 97 = 8"))
    c = c.withColumn("offset", F.when((F.col("genome_id") == 3) & (F.col("contig_id") == 1), 1).otherwise(F.col("offset"))).withColumn("genome", F.when(F.col("genome_id").isin(5, 6), "TWICE").otherwise(F.col("genome")))
    c = c.withColumn("genome_len", F.when(F.col("genome_id") == 4, 1).otherwise(4000).cast("bigint"))
    return a, c.unionByName(c.where("genome_id = 7 AND contig_id = 0"))


FAULTY_SQL = """fa0 AS (SELECT a.genome_id, CASE WHEN position % 97 = 1 THEN 9 ELSE a.contig_id END AS contig_id, CASE WHEN position % 97 = 7 THEN position + 5000 ELSE position END AS position,
    CASE position % 97 WHEN 2 THEN 99 WHEN 3 THEN (enzyme_idx + 1) % 16 ELSE enzyme_idx END AS enzyme_idx, tag, CASE WHEN position % 97 = 4 THEN lower(canon) ELSE canon END AS canon,
    CASE WHEN position % 97 = 5 THEN -1 ELSE a.contig_id * 1000000 + position * 20 + enzyme_idx END AS row, "offset" + position + CASE WHEN position % 97 = 6 THEN 1 ELSE 0 END AS global_position
  FROM anchors a JOIN contigs c ON c.genome_id = a.genome_id AND c.contig_id = a.contig_id),
fa AS MATERIALIZED (SELECT * FROM fa0 UNION ALL SELECT * FROM fa0 WHERE position % 97 = 8),
fc0 AS (SELECT genome_id, contig_id, length, CASE WHEN genome_id = 3 AND contig_id = 1 THEN 1 ELSE "offset" END AS "offset", CASE WHEN genome_id IN (5, 6) THEN 'TWICE' ELSE genome END AS genome, CASE WHEN genome_id = 4 THEN 1 ELSE 4000 END AS genome_len FROM contigs),
fc AS MATERIALIZED (SELECT * FROM fc0 UNION ALL SELECT * FROM fc0 WHERE genome_id = 7 AND contig_id = 0),
fb AS (SELECT genome_id, contig_id, max(length) AS length, min("offset") AS "offset" FROM fc GROUP BY ALL)"""
LENGTH_SQL = "[" + ", ".join(str(e.length) for e in ENZYMES) + "]"


@query(
    f"""SELECT unnest(['unknown_contig', 'out_of_bounds', 'wrong_key', 'wrong_length', 'unknown_enzyme', 'duplicate_row', 'unsorted_row', 'wrong_offset', 'duplicate_contig', 'repeated_genome_name', 'wrong_genome_length', 'wrong_global_position']) AS "check", unnest([
  (SELECT count(*) FROM fa ANTI JOIN fb USING (genome_id, contig_id)),
  (SELECT count(*) FROM fa JOIN fb USING (genome_id, contig_id) WHERE position + length(tag) > length),
  (SELECT count(*) FROM fa WHERE canon <> least(tag, reverse(translate(tag, 'ACGT', 'TGCA')))),
  (SELECT count(*) FROM fa WHERE enzyme_idx < 16 AND length(tag) <> {LENGTH_SQL}[enzyme_idx + 1]),
  (SELECT count(*) FROM fa WHERE enzyme_idx NOT BETWEEN 0 AND 15),
  (SELECT count(*) FROM (SELECT 1 FROM fa GROUP BY genome_id, contig_id, position, enzyme_idx HAVING count(*) > 1)),
  (SELECT count(*) FROM (SELECT (contig_id, position, enzyme_idx) AS k, lag((contig_id, position, enzyme_idx)) OVER (PARTITION BY genome_id ORDER BY row, contig_id, position, enzyme_idx) AS b FROM fa) WHERE b >= k),
  (SELECT count(*) FROM (SELECT "offset" AS o, coalesce(sum(length) OVER (PARTITION BY genome_id ORDER BY contig_id, "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS want FROM fc) WHERE o <> want),
  (SELECT count(*) FROM (SELECT 1 FROM fc GROUP BY genome_id, contig_id HAVING count(*) > 1)),
  (SELECT count(*) FROM (SELECT genome FROM fc GROUP BY genome HAVING count(DISTINCT genome_id) > 1)),
  (SELECT count(*) FROM (SELECT genome_id FROM fc GROUP BY genome_id HAVING sum(length) <> max(genome_len))),
  (SELECT count(*) FROM fa JOIN fb USING (genome_id, contig_id) WHERE global_position <> "offset" + position)]) AS n_bad""",
    (*GA, FAULTY_SQL),
)
def db_validate(spark, d):
    return A.validate(*faulty(spark, d))


@query("SELECT genome_id, contig_id, position, tag, reverse(translate(tag, 'ACGT', 'TGCA')) AS rc, least(tag, reverse(translate(tag, 'ACGT', 'TGCA'))) AS canon, tag = reverse(translate(tag, 'ACGT', 'TGCA')) AS palindrome, enzyme_idx FROM sites", GS)
def tag_strands(spark, d):
    return sites(spark, d).select("genome_id", "contig_id", "position", "tag", S.revcomp("tag").alias("rc"), S.canonical("tag").alias("canon"), S.is_palindromic("tag").alias("palindrome"), "enzyme_idx")


@query(
    """SELECT doc_id, length(s)::BIGINT AS n, round(length(regexp_replace(s, '[^GC]', '', 'g')) / nullif(length(regexp_replace(s, '[^ACGT]', '', 'g')), 0)::DOUBLE, 6) AS gc,
  coalesce(round(length(regexp_replace(s, '[^GC]', '', 'g')) / nullif(length(regexp_replace(s, '[^ACGT]', '', 'g')), 0)::DOUBLE * 200)::INT, 255) AS q, md5(s) AS digest
FROM (SELECT doc_id, regexp_replace(translate(text, 'acgtuU', 'ACGTTT'), '[^ACGT]', 'N', 'g') AS s FROM documents)"""
)
def normalized_gc(spark, d):
    s = X.table(spark, d, "documents").select("doc_id", S.normalize("text").alias("s"))
    gc = S.gc_fraction("s")
    return s.select("doc_id", F.length("s").cast("bigint").alias("n"), F.round(gc, 6).alias("gc"), S.quantize_gc(gc).alias("q"), F.md5(F.col("s").cast("binary")).alias("digest"))


@query("SELECT a.position AS position, a.genome_id, a.enzyme_idx, hamming(a.tag, b.tag)::INT AS distance, CASE WHEN hamming(a.tag, b.tag) <= 18 THEN hamming(a.tag, b.tag) END::INT AS within FROM sites a JOIN sites b ON a.genome_id = b.genome_id AND a.contig_id = b.contig_id AND a.enzyme_idx = b.enzyme_idx AND b.position = (SELECT min(position) FROM sites c WHERE c.genome_id = a.genome_id AND c.contig_id = a.contig_id AND c.enzyme_idx = a.enzyme_idx)", GS)
def hamming_distance(spark, d):
    s = sites(spark, d)
    first = s.groupBy("genome_id", "contig_id", "enzyme_idx").agg(F.min_by("tag", "position").alias("other"))
    j = s.join(first, ["genome_id", "contig_id", "enzyme_idx"])
    return j.select("position", "genome_id", "enzyme_idx", S.hamming("tag", "other").alias("distance"), S.hamming_within("tag", "other", 18).alias("within"))


@query("SELECT l_orderkey AS x, l_partkey AS ori, l_linenumber, least((l_orderkey - l_partkey) % 4000 + CASE WHEN (l_orderkey - l_partkey) % 4000 < 0 THEN 4000 ELSE 0 END, 4000 - ((l_orderkey - l_partkey) % 4000 + CASE WHEN (l_orderkey - l_partkey) % 4000 < 0 THEN 4000 ELSE 0 END)) AS distance FROM lineitem")
def circular_distance(spark, d):
    li = X.table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("x"), F.col("l_partkey").alias("ori"), "l_linenumber", S.circular_distance(F.col("l_orderkey"), F.col("l_partkey"), F.lit(4000).cast("bigint")).alias("distance"))


@query("SELECT page_id, regexp_replace(CASE WHEN regexp_matches(n, '_R1$|_R2$') THEN n[:-4] WHEN regexp_matches(n, '_1$|_2$') THEN n[:-3] ELSE n END, '', '') AS sample FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url || '_R' || (page_id % 3) || CASE WHEN page_id % 2 = 0 THEN '.fastq.gz' ELSE '.fna' END, '^.*/', ''), '\\.gz$', ''), '\\.fastq$', ''), '\\.fq$', ''), '\\.fasta$', ''), '\\.fa$', ''), '\\.fna$', '') AS n FROM pages)")
def sample_name(spark, d):
    p = X.table(spark, d, "pages")
    path = F.concat("url", F.lit("_R"), (F.col("page_id") % 3).cast("string"), F.when(F.col("page_id") % 2 == 0, ".fastq.gz").otherwise(".fna"))
    return p.select("page_id", S.sample_name(path).alias("sample"))


CODE_MASKS = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {sum({'A': 1, 'C': 2, 'G': 4, 'T': 8}[b] for b in v)}" for k, v in IUPAC.items()) + " ELSE 0 END"


@query(f"SELECT p_partkey, code, {CODE_MASKS.format('code')} AS mask FROM (SELECT p_partkey, upper(substr(p_name, 1, 1)) AS code FROM part)")
def iupac_masks(spark, d):
    return X.table(spark, d, "part").select("p_partkey", F.upper(F.substring("p_name", 1, 1)).alias("code")).withColumn("mask", S.iupac_mask("code"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, code, base, {CODE_MASKS.format('code')} & {CODE_MASKS.format('base')} > 0 AND base <> 'N' AS matches FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS code, substr('ACGTN', (l_partkey % 5 + 1)::INT, 1) AS base FROM lineitem)")
def iupac_match(spark, d):
    base = F.substring(F.lit("ACGTN"), (F.col("l_partkey") % 5 + 1).cast("int"), F.lit(1))
    codes = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("code"), base.alias("base"))
    return codes.withColumn("matches", S.iupac_matches("code", "base"))


@query(
    "SELECT inner_name, outer_name, total, (SELECT count(*) FROM sites WHERE enzyme_idx = i.idx) AS n_inner, (SELECT count(*) FROM sites WHERE enzyme_idx = o.idx) AS n_outer FROM (VALUES "
    + ", ".join(f"('{a}', '{b}', {t})" for a, b, t in CONTAINED) + ") c(inner_name, outer_name, total) JOIN (VALUES " + ", ".join(f"('{e.name}', {e.idx})" for e in ENZYMES) + ") i(name, idx) ON i.name = inner_name JOIN (VALUES " + ", ".join(f"('{e.name}', {e.idx})" for e in ENZYMES) + ") o(name, idx) ON o.name = outer_name",
    (X.CONTIGS_SQL, D.SITES_SQL),
)
def enzyme_containment(spark, d):
    """Tags that the digested genomes have of enzymes whose windows another enzyme's contain."""
    n = D.sites(X.contigs(spark, d)).groupBy("enzyme_idx").agg(F.count("*").alias("n"))
    rows = spark.createDataFrame([(a, b, t, BY_NAME[a.lower()].idx, BY_NAME[b.lower()].idx) for a, b, t in CONTAINED], "inner_name string, outer_name string, total boolean, i int, o int")
    found = lambda at, name: n.select(F.col("enzyme_idx").alias(at), F.col("n").alias(name))
    out = rows.join(found("i", "n_inner"), "i", "left").join(found("o", "n_outer"), "o", "left")
    return out.select("inner_name", "outer_name", "total", F.coalesce("n_inner", F.lit(0)).alias("n_inner"), F.coalesce("n_outer", F.lit(0)).alias("n_outer"))
