"""Queries on windows, rates, fits, fusion, dynamics and scaffolds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagforge.operators import anchors as A
from tagforge.operators import digest as D
from tagforge.operators import dynamics as Y
from tagforge.operators import fit as T
from tagforge.operators import fusion as U
from tagforge.operators import rates as R
from tagforge.operators import scaffold as P
from tagforge.operators import windows as N
from tagforge.panel import ENZYMES
from tagforge.plans.registry import query
from tagforge.sources import fixtures as X

SITES = (X.CONTIGS_SQL, D.SITES_SQL)
COUNTS = (X.COUNTS_SQL,)
EW = (*COUNTS, N.ENZYME_WINDOWS_SQL)
RATES = (*EW, R.RATES_SQL)
EST = (X.ESTIMATES_SQL,)
FUSED = (*EST, U.FUSE_SQL)
GROUP = ["sample", "genome_id", "enzyme"]
GENOME = 500_000


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def fixture_sites(spark, d):
    c = X.contigs(spark, d)
    return D.sites(c), c


WINDOW_IDS_SQL = 'SELECT *, dense_rank() OVER (ORDER BY genome_id, contig_id, chunk) - 1 AS window_id FROM ({})'
WINDOW_TABLE_SQL = 'SELECT window_id, w.genome_id, w.contig_id, start, "end", "end" - start AS span, n_anchors, "offset" + (start + "end") // 2 AS global_mid FROM (SELECT window_id, genome_id, contig_id, min(position) AS start, max(position + length(tag)) AS "end", count(*) AS n_anchors FROM wid GROUP BY ALL) w JOIN contigs c USING (genome_id, contig_id)'


@query(WINDOW_TABLE_SQL, (*SITES, A.FLAGGED_SQL, "wid AS (" + WINDOW_IDS_SQL.format(f"SELECT *, {N.CHUNK_SQL} AS chunk FROM (SELECT *, 10 AS size, count(*) OVER (PARTITION BY genome_id, contig_id) AS total, row_number() OVER (PARTITION BY genome_id, contig_id ORDER BY position, enzyme_idx) - 1 AS place FROM anchors WHERE (flags & 28) = 0)") + ")"))
def windows_equal(spark, d):
    s, c = fixture_sites(spark, d)
    return N.window_table(N.equal_anchor_windows(A.with_flags(s, c), 10), c)


@query(WINDOW_TABLE_SQL, (*SITES, A.FLAGGED_SQL, "wid AS (" + WINDOW_IDS_SQL.format("SELECT *, position // 500 AS chunk FROM anchors WHERE (flags & 28) = 0") + ")"))
def windows_bp(spark, d):
    s, c = fixture_sites(spark, d)
    return N.window_table(N.fixed_windows(A.with_flags(s, c), 500), c)


@query('SELECT sample, genome_id, enzyme, contig_id, chunk, max(size) AS window_size, count(*) AS n_anchors, min(position) AS start, max(position) AS "end" FROM ew GROUP BY ALL', EW)
def windows_per_enzyme_auto(spark, d):
    w = N.enzyme_windows(X.counts(spark, d))
    return w.groupBy(*GROUP, "contig_id", "chunk").agg(F.max("window_size").alias("window_size"), F.count("*").alias("n_anchors"), F.min("position").alias("start"), F.max("position").alias("end"))


def rates(spark, d):
    return R.window_rates(N.enzyme_windows(X.counts(spark, d)))


KEY = [*GROUP, "contig_id", "chunk"]


@query("SELECT sample, genome_id, enzyme, contig_id, chunk, n_anchors, n_positive, round(dispersion, 6) AS dispersion, round(detected_fraction, 6) AS detected_fraction FROM rates", RATES)
def window_dispersion(spark, d):
    return rates(spark, d).select(*KEY, "n_anchors", "n_positive", *r6("dispersion", "detected_fraction"))


@query("SELECT sample, genome_id, enzyme, contig_id, chunk, round(rate, 6) AS rate, round(se, 6) AS se, round(log2_rate, 6) AS log2_rate, round(log2_se, 6) AS log2_se FROM rates", RATES)
def ztp_lambda(spark, d):
    return rates(spark, d).select(*KEY, *r6("rate", "se", "log2_rate", "log2_se"))


@query("SELECT *, round(x / (1 - exp(-x)), 6) AS ztp_mean, round(x / (1 - exp(-x)) * (1 + x - x / (1 - exp(-x))), 6) AS ztp_var, round(((1 - exp(-x)) - x * exp(-x)) / (1 - exp(-x)) ** 2, 6) AS ztp_slope, round(x / (1 - exp(-ln(1 + a * x) / a)), 6) AS nb_mean, round(x / (1 - exp(-ln(1 + a * x) / a)) * (1 + x * (1 + a)) - (x / (1 - exp(-ln(1 + a * x) / a))) ** 2, 6) AS nb_var FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity / 7 AS x, 0.1 + l_discount AS a FROM lineitem)")
def ztp_moments(spark, d):
    li = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_quantity") / 7).alias("x"), (0.1 + F.col("l_discount")).alias("a"))
    x, a = F.col("x"), F.col("a")
    made = {"ztp_mean": R.ztp_mean(x), "ztp_var": R.ztp_var(x), "ztp_slope": R.ztp_slope(x), "nb_mean": R.ztnb_mean(x, a), "nb_var": R.ztnb_var(x, a)}
    return li.select("*", *[F.round(v, 6).alias(k) for k, v in made.items()])


TUKEY_SQL = "kept AS (SELECT r.*, log2_rate IS NOT NULL AND (n < 4 OR q3 - q1 <= 0 OR log2_rate BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS keep FROM rates r JOIN (SELECT sample, genome_id, enzyme, quantile_cont(log2_rate, 0.25) AS q1, quantile_cont(log2_rate, 0.75) AS q3, count(log2_rate) AS n FROM rates GROUP BY ALL) USING (sample, genome_id, enzyme))"


@query("SELECT sample, genome_id, enzyme, contig_id, chunk, keep FROM kept", (*RATES, TUKEY_SQL))
def tukey_mask(spark, d):
    return R.tukey_keep(rates(spark, d), "log2_rate", GROUP).select(*KEY, "keep")


@query("SELECT *, round(mean / median(mean) OVER (PARTITION BY sample, genome_id), 6) AS relative FROM (SELECT sample, genome_id, enzyme, median(count) AS median, round(avg(count), 9) AS mean, count(*) AS n FROM counts WHERE usable GROUP BY ALL)", COUNTS)
def enzyme_efficiency(spark, d):
    e = R.enzyme_efficiency(X.counts(spark, d))
    return e.select(*GROUP, "median", F.round("mean", 9).alias("mean"), "n", F.round("relative", 6).alias("relative"))


@query("SELECT sample, genome_id, enzyme, contig_id, chunk, round(log2_rate - coalesce((mean_gc - 0.5) * 0.8, 0), 6) AS log2_rate, round(log2_rate, 6) AS log2_rate_raw, true AS gc_corrected FROM rates", RATES)
def gc_apply(spark, d):
    from tagforge.operators.gcbias import apply_offset

    out = apply_offset(rates(spark, d).withColumn("mean_gc_offset", (F.col("mean_gc") - 0.5) * 0.8))
    return out.select(*KEY, *r6("log2_rate", "log2_rate_raw"), "gc_corrected")


def pmod_sql(x):
    return f"(({x}) - {GENOME} * floor(({x}) / {GENOME}::DOUBLE))"


def dist_sql(x):
    return f"least({pmod_sql(x)}, {GENOME} - {pmod_sql(x)})"


def fit_sql(x, y, w, groups, source, extra=""):
    return f"""SELECT *, CASE WHEN sxx > 1e-12 THEN sxy / sxx END AS slope, syy - sxy * sxy / sxx AS sse FROM (SELECT {groups}, n, total, sxx - sx * sx / sw AS sxx, sxy - sx * sy / sw AS sxy, syy - sy * sy / sw AS syy FROM (
  SELECT {groups}, count({y}) AS n, {extra or "0"} AS total, sum({w}) AS sw, sum({w} * {x}) AS sx, sum({w} * {y}) AS sy, sum({w} * {x} * {x}) AS sxx, sum({w} * {x} * {y}) AS sxy, sum({w} * {y} * {y}) AS syy FROM {source} GROUP BY ALL))"""


@query(
    f"SELECT sample, genome_id, enzyme, n, round(-slope * {GENOME} / 2, 5) AS log2_ptr, round(sqrt(greatest(sse, 0) / (n - 2) / sxx) * {GENOME} / 2, 5) AS se, round(1 - sse / syy, 5) AS r2 FROM ("
    + fit_sql(dist_sql("mid - 1000"), "log2_rate", "(1 / (log2_se * log2_se))", "sample, genome_id, enzyme", "(SELECT * FROM rates WHERE log2_rate IS NOT NULL AND log2_se > 0)")
    + ") WHERE n > 2",
    RATES,
)
def wls_vfit(spark, d):
    f = T.v_fit(rates(spark, d), GROUP, "mid", "log2_rate", "log2_se", F.lit(1000.0), F.lit(float(GENOME))).where("n > 2")
    return f.select(*GROUP, "n", *[F.round(c, 5).alias(c) for c in ("log2_ptr", "se", "r2")])


GRID_SQL = "grid AS MATERIALIZED (" + fit_sql(dist_sql("mid - ori"), "log2_rate", "1.0::DOUBLE", "sample, genome_id, ori", f"(SELECT *, i * ({GENOME} / 180.0::DOUBLE) AS ori FROM rates, range(180) t(i) WHERE log2_rate IS NOT NULL)") + ")"
BY = ["sample", "genome_id"]


def grid(spark, d):
    return T.origin_grid(rates(spark, d), BY, "mid", "log2_rate", GENOME)


@query(f"SELECT sample, genome_id, round(ori, 3) AS ori, round(-slope * {GENOME} / 2, 5) AS log2_ptr FROM grid WHERE slope < 0 AND n >= 3 QUALIFY row_number() OVER (PARTITION BY sample, genome_id ORDER BY round(sse, 9), ori) = 1", (*RATES, GRID_SQL))
def ori_grid(spark, d):
    b = T.best_origin(grid(spark, d), BY)
    return b.select(*BY, F.round("ori", 3).alias("ori"), F.round(-F.col("slope") * GENOME / 2, 5).alias("log2_ptr"))


@query(f"SELECT sample, genome_id, round(sqrt(sum(w * cos(a)) ** 2 + sum(w * sin(a)) ** 2) / sum(w), 5) AS confidence FROM (SELECT *, exp(-n / 2.0 * ln(sse / min(sse) OVER (PARTITION BY sample, genome_id))) AS w, ori * (2 * pi() / {GENOME}) AS a FROM grid WHERE slope < 0) GROUP BY ALL", (*RATES, GRID_SQL))
def ori_confidence(spark, d):
    return T.origin_confidence(grid(spark, d), BY, GENOME).select(*BY, F.round("confidence", 5).alias("confidence"))


PRIOR_SQL = f"""penalised AS (SELECT *, sse * (1 + ({dist_sql("ori - genome_id * 20000")} / (15000 + 5000 * genome_id)) ** 2 / (2 * n)) AS cost FROM grid)"""


@query(f"SELECT sample, genome_id, round(ori, 3) AS ori, round(-slope * {GENOME} / 2, 5) AS log2_ptr FROM penalised WHERE slope < 0 AND n >= 3 QUALIFY row_number() OVER (PARTITION BY sample, genome_id ORDER BY round(cost, 9), ori) = 1", (*RATES, GRID_SQL, PRIOR_SQL))
def ori_prior(spark, d):
    """The grid's origin with an annotated position, of another certainty in each genome, drawing the search."""
    drawn = T.with_prior(grid(spark, d), F.col("genome_id") * 20000.0, 15000.0 + 5000.0 * F.col("genome_id"), GENOME)
    b = T.best_origin(drawn, BY)
    return b.select(*BY, F.round("ori", 3).alias("ori"), F.round(-F.col("slope") * GENOME / 2, 5).alias("log2_ptr"))


@query("SELECT sample, genome_id, enzyme, contig_id, chunk, round(log2_rate - median(log2_rate) OVER (PARTITION BY sample, genome_id, enzyme), 6) AS centred FROM rates", RATES)
def shared_ori_centre(spark, d):
    return T.centred(rates(spark, d), BY, "enzyme", "log2_rate").select(*KEY, F.round("centred", 6).alias("centred"))


@query(
    "SELECT sample, genome_id, enzyme, n, round(slope * total, 5) AS log2_ptr FROM ("
    + fit_sql("rk", "log2_rate", "1.0::DOUBLE", "sample, genome_id, enzyme", "(SELECT * FROM (SELECT *, row_number() OVER g - 1 AS rk0, (row_number() OVER g - 1)::DOUBLE AS rk, count(*) OVER (PARTITION BY sample, genome_id, enzyme) AS tot FROM rates WHERE log2_rate IS NOT NULL WINDOW g AS (PARTITION BY sample, genome_id, enzyme ORDER BY log2_rate)) WHERE rk0 >= floor(tot * 0.05) AND rk0 < tot - floor(tot * 0.05))", "max(tot)")
    + ")",
    RATES,
)
def sorted_rank_slope(spark, d):
    return T.sorted_slope(rates(spark, d), GROUP, "log2_rate").select(*GROUP, "n", F.round("log2_ptr", 5).alias("log2_ptr"))


def estimates(spark, d):
    return U.exclusions(X.estimates(spark, d))


def fused(spark, d):
    return U.fuse(estimates(spark, d))


@query("SELECT sample, genome_id, k, round(fixed, 6) AS fixed, round(fixed_se, 6) AS fixed_se FROM fused", FUSED)
def fuse_fixed(spark, d):
    return fused(spark, d).select(*BY, "k", *r6("fixed", "fixed_se"))


@query("SELECT sample, genome_id, k - 1 AS df, round(q, 5) AS q, round(i2, 5) AS i2 FROM fused", FUSED)
def cochran_q(spark, d):
    return fused(spark, d).select(*BY, (F.col("k") - 1).alias("df"), F.round("q", 5).alias("q"), F.round("i2", 5).alias("i2"))


@query("SELECT sample, genome_id, fusion_model, round(tau2, 6) AS tau2, round(random, 6) AS random, round(log2_ptr, 6) AS log2_ptr, round(se, 6) AS se, round(2 ** log2_ptr, 6) AS ptr, round(log2_ptr - 1.959963984540054 * se, 6) AS ci_low, round(log2_ptr + 1.959963984540054 * se, 6) AS ci_high FROM fused", FUSED)
def dersimonian_laird(spark, d):
    return fused(spark, d).select(*BY, "fusion_model", *r6("tau2", "random", "log2_ptr", "se", "ptr", "ci_low", "ci_high"))


@query("SELECT sample, genome_id, enzyme, reason, round((est - log2_ptr) / r.se, 5) AS residual FROM reasoned r LEFT JOIN (SELECT sample, genome_id, log2_ptr FROM fused) f ON r.sample = f.sample AND r.genome_id = f.genome_id AND reason IS NULL".replace("SELECT sample, genome_id, enzyme", "SELECT r.sample, r.genome_id, enzyme", 1), FUSED)
def fuse_exclusions(spark, d):
    e = estimates(spark, d)
    res = U.residuals(e, fused(spark, d)).select(*GROUP, F.round("residual", 5).alias("residual"))
    return e.select(*GROUP, "reason").join(res, GROUP, "left")


NAMES = str([e.name for e in ENZYMES])
TABLE_SQL = f"""named AS (SELECT *, {NAMES}[enzyme + 1] AS name FROM reasoned),
tab AS (SELECT sample, genome_id, coalesce(string_agg(name, ',' ORDER BY name) FILTER (reason IS NULL), '-') AS enzymes_used, coalesce(string_agg(name || ':' || reason, ';' ORDER BY name) FILTER (reason IS NOT NULL), '-') AS excluded,
  min(r2) FILTER (reason IS NULL) AS min_r2, count(*) FILTER (reason IS NULL AND r2 < 0) AS n_negative_r2, count(*) AS n_attempted FROM named GROUP BY ALL),
worst AS (SELECT r.sample, r.genome_id, enzyme AS worst_enzyme, name AS worst_name FROM named r JOIN fused f USING (sample, genome_id) WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY r.sample, r.genome_id ORDER BY round(abs((est - log2_ptr) / r.se), 6) DESC, enzyme) = 1)"""


@query("SELECT sample, genome_id, enzymes_used, excluded, round(min_r2, 6) AS min_r2, n_negative_r2, n_attempted, worst_enzyme FROM tab LEFT JOIN worst USING (sample, genome_id)", (*FUSED, TABLE_SQL))
def fuse_table(spark, d):
    return U.fuse_table(estimates(spark, d), fused(spark, d)).select(*BY, "enzymes_used", "excluded", F.round("min_r2", 6).alias("min_r2"), "n_negative_r2", "n_attempted", "worst_enzyme")


@query(
    """SELECT sample, genome_id, round(fit_rate, 6) AS enzyme_fit_rate, qc_reason, qc_reason = '' AS pass_qc FROM (SELECT *, concat_ws('; ', CASE WHEN coverage < 1 THEN 'coverage ' || format('{:.2f}', round(coverage, 2)) || ' < 1.0' END,
  CASE WHEN fit_rate < 0.8 THEN 'only ' || coalesce(k, 0) || '/' || n_attempted || ' enzymes produced a fit' END, CASE WHEN log2_ptr IS NULL THEN 'no PTR estimate' END) AS qc_reason
  FROM (SELECT t.*, k, log2_ptr, coalesce(k, 0) / n_attempted::DOUBLE AS fit_rate, n_attempted / 7.0::DOUBLE AS coverage FROM tab t LEFT JOIN fused USING (sample, genome_id)))""",
    (*FUSED, TABLE_SQL),
)
def qc_flags(spark, d):
    e = estimates(spark, d)
    f = U.fuse(e)
    j = U.fuse_table(e, f).drop("coverage").join(f, BY, "left").withColumn("enzyme_fit_rate", F.coalesce("k", F.lit(0)) / F.col("n_attempted")).withColumn("coverage", F.col("n_attempted") / 7.0)
    return U.with_qc(j).select(*BY, F.round("enzyme_fit_rate", 6).alias("enzyme_fit_rate"), "qc_reason", "pass_qc")


TYPES = ["click", "purchase", "scroll", "signup", "view"]


def ptr(spark, d):
    return fused(spark, d).select(*BY, "log2_ptr", "se")


@query("SELECT genome_id, " + ", ".join(f"round(avg(log2_ptr) FILTER (sample = '{s}'), 6) AS \"{s}\"" for s in TYPES) + " FROM fused GROUP BY genome_id", FUSED)
def ptr_matrix(spark, d):
    return Y.ptr_matrix(ptr(spark, d), TYPES).select("genome_id", *r6(*TYPES))


DELTA_SQL = """SELECT f.sample, f.genome_id, round(log2_ptr - base, 6) AS delta, round(sqrt(coalesce(se, 0) ** 2 + base_se * base_se), 6) AS delta_se, round((log2_ptr - base) / nullif(sqrt(coalesce(se, 0) ** 2 + base_se * base_se), 0), 5) AS z, round(2 ** (log2_ptr - base), 6) AS fold
FROM fused f JOIN (SELECT genome_id, avg(log2_ptr) AS base, coalesce(sqrt(sum(se * se)) / count(se), 0) AS base_se FROM fused {where} GROUP BY genome_id) USING (genome_id) {other}"""


def deltas(df):
    return df.select(*BY, *r6("delta", "delta_se"), F.round("z", 5).alias("z"), F.round("fold", 6).alias("fold"))


@query(DELTA_SQL.format(where="WHERE sample = 'click'", other="WHERE f.sample <> 'click'"), FUSED)
def delta_ptr_baseline(spark, d):
    return deltas(Y.delta(ptr(spark, d), F.col("sample") == "click"))


@query(DELTA_SQL.format(where="", other=""), FUSED)
def delta_ptr_mean(spark, d):
    return deltas(Y.delta(ptr(spark, d), None))


@query("SELECT sample, genome_id, enzyme, p, round(least(1, greatest(0, min(p * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))), 6) AS q FROM (SELECT *, row_number() OVER (ORDER BY p, sample, genome_id, enzyme) AS rk, count(*) OVER () AS m FROM (SELECT sample, genome_id, enzyme, round(abs(r2), 6) AS p FROM estimates) WHERE p IS NOT NULL)", EST)
def bh_fdr(spark, d):
    e = X.estimates(spark, d).select(*GROUP, F.round(F.abs("r2"), 6).alias("p"))
    return Y.benjamini_hochberg(e, "p").select(*GROUP, "p", F.round("q", 6).alias("q"))


@query("SELECT sample, genome_id, n, round(slope, 6) AS slope, round(sqrt(greatest(sse, 0) / (n - 2) / sxx), 6) AS slope_se FROM (" + fit_sql("enzyme", "est", "(1 / (se * se))", "sample, genome_id", "(SELECT * FROM estimates WHERE est IS NOT NULL AND se > 0)") + ") WHERE n >= 3", EST)
def trend_slope(spark, d):
    t = Y.trend(X.estimates(spark, d).withColumnRenamed("est", "log2_ptr").withColumnRenamed("n", "m"), "enzyme", BY)
    return t.select(*BY, "n", *r6("slope", "slope_se"))


@query("SELECT genome_id || ':' || contig_id || ':' || position || ':' || enzyme AS anchor, " + ", ".join(f"coalesce(sum(count) FILTER (sample = '{s}'), 0)::BIGINT AS \"{s}\"" for s in "ANR") + " FROM counts WHERE usable GROUP BY anchor", COUNTS)
def anchor_matrix(spark, d):
    return Y.anchor_matrix(X.counts(spark, d), ["A", "N", "R"])


@query("SELECT sample, count(DISTINCT genome_id) AS n_genomes, count(*) AS n_rows, sum(position)::BIGINT AS positions FROM counts GROUP BY sample", COUNTS)
def db_signature(spark, d):
    return X.counts(spark, d).groupBy("sample").agg(F.countDistinct("genome_id").alias("n_genomes"), F.count("*").alias("n_rows"), F.sum("position").alias("positions"))


@query("SELECT genome_id, genome, r_name AS taxonomy FROM contigs LEFT JOIN (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2) ON n_name = genome WHERE contig_id = 0", (X.CONTIGS_SQL,))
def taxonomy_attach(spark, d):
    n, r = X.table(spark, d, "nation"), X.table(spark, d, "region").where("r_regionkey <> 2")
    t = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("genome"), F.col("r_name").alias("taxonomy"))
    return X.contigs(spark, d).where("contig_id = 0").select("genome_id", "genome").join(t, "genome", "left")


@query("SELECT g.genome_id, genome_len, o.position AS ori FROM (SELECT genome_id, any_value(genome) AS genome, sum(length)::BIGINT AS genome_len FROM contigs GROUP BY genome_id) g LEFT JOIN (SELECT n_name, n_nationkey * 250 AS position FROM nation) o ON o.n_name = genome AND o.position < genome_len", (X.CONTIGS_SQL,))
def ori_attach(spark, d):
    g = X.contigs(spark, d).groupBy("genome_id", "genome").agg(F.sum("length").alias("genome_len"))
    o = X.table(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 250).alias("ori"))
    return g.join(o, (F.col("name") == F.col("genome")) & (F.col("ori") < F.col("genome_len")), "left").select("genome_id", "genome_len", "ori")


def draft(spark, d):
    """The chromosome of nation 1 cut into contigs of 400 bases, every second one turned, against the whole as reference."""
    c = X.contigs(spark, d).where("genome_id = 1 AND contig_id = 0")
    cut = c.select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("contig_id"), "seq").select("contig_id", F.substring(F.col("seq"), F.col("contig_id") * 400 + 1, F.lit(400)).alias("s"))
    from tagforge.functions.seq import revcomp

    turned = cut.select(F.lit(1).alias("genome_id"), "contig_id", F.format_string("d%d", "contig_id").alias("name"), F.when(F.col("contig_id") % 2 == 1, revcomp("s")).otherwise(F.col("s")).alias("seq"))
    turned = turned.withColumn("length", F.length("seq").cast("bigint"))
    return D.sites(turned, min_contig_len=100), turned, D.sites(c)


DRAFT_SQL = (
    """draft AS MATERIALIZED (SELECT i::INT AS contig_id, 400::BIGINT AS length, CASE WHEN i % 2 = 1 THEN reverse(translate(substr(seq, i::INT * 400 + 1, 400), 'ACGTN', 'TGCAN')) ELSE substr(seq, i::INT * 400 + 1, 400) END AS seq FROM contigs, range(8) t(i) WHERE genome_id = 1 AND contig_id = 0),
dw AS MATERIALIZED (SELECT contig_id, p::BIGINT AS position, substr(seq, p::INT + 1, 33) AS w FROM draft, range(400) t(p)),
ds AS MATERIALIZED ("""
    + D.hits_sql("dw", "contig_id, position")
    + f"""),
dt AS (SELECT {A.CANON} AS canon, min(contig_id) AS contig_id, min(position) AS pos FROM ds GROUP BY canon HAVING count(DISTINCT (contig_id, position)) = 1),
rt AS (SELECT {A.CANON} AS canon, min(position) AS ref FROM sites WHERE genome_id = 1 AND contig_id = 0 GROUP BY canon HAVING count(DISTINCT (contig_id, position)) = 1),
sh AS (SELECT contig_id, pos, ref FROM dt JOIN rt USING (canon)),
votes AS (SELECT contig_id, n AS n_tags, coalesce(up, 0) AS up, coalesce(down, 0) AS down FROM (SELECT contig_id, count(*) AS n FROM sh GROUP BY ALL) LEFT JOIN (SELECT a.contig_id, count(*) FILTER (a.ref < b.ref) AS up, count(*) FILTER (a.ref > b.ref) AS down FROM sh a JOIN sh b ON a.contig_id = b.contig_id AND a.pos < b.pos GROUP BY ALL) USING (contig_id)),
orient AS (SELECT contig_id, n_tags, CASE WHEN up + down > 0 THEN greatest(up, down) / (up + down)::DOUBLE ELSE 0 END AS concordance, CASE WHEN up >= down THEN 'Forward' ELSE 'Reverse' END AS orientation FROM votes),
placed AS (SELECT contig_id, orientation, n_tags, concordance, length, greatest(0, list_sort(list(CASE orientation WHEN 'Forward' THEN ref - pos ELSE ref - (length - 1 - pos) END))[count(*) // 2 + 1]) AS ref_start FROM sh JOIN orient USING (contig_id) JOIN draft USING (contig_id) WHERE n_tags >= 3 AND concordance >= 0.8 GROUP BY contig_id, orientation, n_tags, concordance, length)""",
)


@query("SELECT contig_id, n_tags, round(concordance, 6) AS concordance, orientation FROM orient", (*SITES, *DRAFT_SQL))
def scaffold_orientation(spark, d):
    s, _, r = draft(spark, d)
    return P.orientation(P.shared_tags(s, r)).withColumn("concordance", F.round("concordance", 6))


@query("SELECT contig_id, orientation, n_tags, round(concordance, 6) AS concordance, length, ref_start FROM placed", (*SITES, *DRAFT_SQL))
def scaffold_place(spark, d):
    s, c, r = draft(spark, d)
    return P.place(P.shared_tags(s, r), c).withColumn("concordance", F.round("concordance", 6))


@query(
    """SELECT contig_id, position, enzyme_idx, orientation, ref_start + CASE orientation WHEN 'Reverse' THEN length - 1 - position ELSE position END AS global_position FROM ds JOIN (
  SELECT contig_id, length, orientation, ref_start FROM placed UNION ALL SELECT contig_id, length, 'Unplaced', (SELECT coalesce(max(ref_start + length), 0) FROM placed) + coalesce(sum(length) OVER (ORDER BY contig_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
  FROM draft ANTI JOIN placed USING (contig_id)) USING (contig_id)""",
    (*SITES, *DRAFT_SQL),
)
def scaffold_apply(spark, d):
    s, c, r = draft(spark, d)
    return P.apply(s, c, P.place(P.shared_tags(s, r), c)).select("contig_id", "position", "enzyme_idx", "orientation", "global_position")


@query("SELECT count(*) AS n_contigs, count(ref_start) AS n_placed, round(coalesce(sum(length) FILTER (ref_start IS NOT NULL), 0)::DOUBLE / sum(length), 6) AS placed_fraction FROM (SELECT d.length, p.ref_start FROM draft d LEFT JOIN placed p USING (contig_id))", (*SITES, *DRAFT_SQL))
def scaffold_fraction(spark, d):
    s, c, r = draft(spark, d)
    return P.placed_fraction(P.place(P.shared_tags(s, r), c), c)
