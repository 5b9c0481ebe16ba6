"""Per-enzyme estimates fused per sample and genome, quality flags, and the assembled output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagforge.functions.stats import chi2_pvalue
from tagforge.panel import ENZYMES

Z95 = 1.959963984540054
GROUP = ["sample", "genome_id"]


def enzyme_name(enzyme) -> Column:
    """The panel's name of an enzyme number; another value is its own name."""
    c = F.col(enzyme) if isinstance(enzyme, str) else enzyme
    return F.coalesce(F.get(F.array(*[F.lit(e.name) for e in ENZYMES]), c.try_cast("int")), c.cast("string"))


def short(c: Column, digits: int) -> Column:
    """A number as text of so many significant digits without trailing zeros, with an exponent below 1e-4."""
    power = F.floor(F.log10(F.abs(c)))
    scaled = F.round(c / F.pow(F.lit(10.0), power), digits - 1)
    power, scaled = F.when(F.abs(scaled) >= 10, power + 1).otherwise(power), F.when(F.abs(scaled) >= 10, scaled / 10).otherwise(scaled)
    bare = lambda text: F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    small = F.concat(bare(F.format_string(f"%.{digits - 1}f", scaled)), F.lit("e-"), F.format_string("%02d", (-power).cast("bigint")))
    return F.when(c == 0, "0").when(power < -4, small).otherwise(bare(F.format_string(f"%.{digits + 3}f", scaled * F.pow(F.lit(10.0), power))))


def exclusions(est: DataFrame, min_anchors: int = 30, max_se: float | None = None) -> DataFrame:
    """est plus ``reason``: why an enzyme can't take part, null where it can; ``n_anchors`` are those behind an enzyme's estimate.

    Fits that failed (``ok`` is false, where est has it) give their own note.
    """
    few = F.format_string(f"only %d anchors (< {min_anchors})", F.col("n_anchors").cast("bigint"))
    failed = F.lit(False) if "ok" not in est.columns else ~F.coalesce("ok", F.lit(False))
    note = F.lit(None).cast("string") if "note" not in est.columns else F.nullif("note", F.lit(""))
    r = F.when(failed, F.coalesce(note, F.lit("fit failed"))).when(F.col("est").isNull(), "no estimate").when(F.col("se").isNull() | (F.col("se") <= 0), "no usable standard error").when(F.col("n_anchors") < min_anchors, few)
    return est.withColumn("reason", r if max_se is None else r.when(F.col("se") > max_se, "standard error too large"))


def fuse(est: DataFrame, model: str = "auto", alpha: float = 0.05) -> DataFrame:
    """Inverse-variance fusion in two passes: fixed mean, then Cochran's Q around it, its p-value, I2, tau2 and the random-effects mean.

    ``auto`` takes random effects where Q rejects agreement at ``alpha``, ``always`` wherever it can, ``never`` nowhere; without variance
    between the enzymes (tau2 0) the two are the same and the model is fixed.  One enzyme has no p-value and no I2.
    """
    c = F.col
    u = est.where("reason is null").withColumn("w", 1 / (c("se") * c("se")))
    part = W.partitionBy(*GROUP)
    u = u.withColumn("fixed", F.sum(c("w") * c("est")).over(part) / F.sum("w").over(part))
    g = u.groupBy(*GROUP).agg(F.count("*").alias("k"), F.first("fixed").alias("fixed"), F.sqrt(1 / F.sum("w")).alias("fixed_se"), F.sum(c("w") * (c("est") - c("fixed")) ** 2).alias("q"), (F.sum("w") - F.sum(c("w") ** 2) / F.sum("w")).alias("spread"))
    several, excess = c("k") > 1, c("q") - (c("k") - 1)
    g = g.withColumn("i2", F.when(several, F.when(c("q") > 0, F.greatest(F.lit(0.0), excess / c("q"))).otherwise(0.0)))
    g = g.withColumn("tau2", F.when(several, F.greatest(F.lit(0.0), excess / c("spread"))).otherwise(0.0)).withColumn("q_pvalue", F.when(several, chi2_pvalue("q", (c("k") - 1).cast("double"))))
    r = u.join(g.select(*GROUP, "tau2"), GROUP).withColumn("rw", 1 / (c("se") * c("se") + c("tau2")))
    r = r.groupBy(*GROUP).agg((F.sum(c("rw") * c("est")) / F.sum("rw")).alias("random"), F.sqrt(1 / F.sum("rw")).alias("random_se"))
    wanted = {"auto": F.coalesce(c("q_pvalue") < alpha, F.lit(False)), "always": F.lit(True), "never": F.lit(False)}[model]
    use = wanted & (c("tau2") > 0)
    out = g.join(r, GROUP).withColumn("fusion_model", F.when(use, "random").otherwise("fixed"))
    out = out.withColumn("log2_ptr", F.when(use, c("random")).otherwise(c("fixed"))).withColumn("se", F.when(use, c("random_se")).otherwise(c("fixed_se")))
    return out.withColumn("ptr", F.pow(F.lit(2.0), "log2_ptr")).withColumn("ci_low", c("log2_ptr") - Z95 * c("se")).withColumn("ci_high", c("log2_ptr") + Z95 * c("se"))


def note(alpha: float = 0.05) -> Column:
    """What a reader of a fused row with its worst enzyme should know."""
    disagree = F.concat(F.format_string("enzymes disagree (Q=%.1f, p=", F.round("q", 1)), short(F.col("q_pvalue"), 3), F.lit("); largest deviation from "), enzyme_name("worst_enzyme"))
    return F.when(F.coalesce(F.col("k"), F.lit(0)) == 0, "no enzyme produced a usable estimate").when(F.col("k") == 1, "single enzyme: no cross-enzyme consistency check available").when(F.col("q_pvalue") < alpha, disagree).otherwise("")


def residuals(est: DataFrame, fused: DataFrame) -> DataFrame:
    """Standardised residual of each enzyme that took part."""
    return est.where("reason is null").join(fused.select(*GROUP, F.col("log2_ptr").alias("mid")), GROUP).withColumn("residual", (F.col("est") - F.col("mid")) / F.col("se")).drop("mid")


#: Figures of the output over the enzymes used: name, column of the fits, aggregate.
USED_FIGURES = (
    ("coverage", "mean_rate", F.avg), ("dispersion", "mean_dispersion", F.avg), ("fraction", "mean_fraction", F.avg), ("ori", "ori", F.median), ("ori_confidence", "ori_confidence", F.median),
    ("n_anchors", "n_anchors", lambda c: F.coalesce(F.sum(c), F.lit(0))), ("n_windows", "n_windows_used", lambda c: F.coalesce(F.sum(c), F.lit(0))),
    ("method", "method", lambda c: F.coalesce(F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ","), F.lit("")), F.lit("none"))),
)


def fuse_table(est: DataFrame, fused: DataFrame) -> DataFrame:
    """Per sample and genome: names of the enzymes used and of those excluded with the reason, worst enzyme, least r2 and number of negative r2 of those used, and their figures as far as est has them."""
    used = F.col("reason").isNull()
    named = F.array_sort(F.collect_list(F.struct(enzyme_name("enzyme").alias("name"), "reason")))
    of = lambda keep, text, sep: F.coalesce(F.nullif(F.array_join(F.transform(F.filter("names", keep), text), sep), F.lit("")), F.lit("-"))
    figures = [f(F.when(used, F.col(c))).alias(name) for name, c, f in USED_FIGURES if c in est.columns]
    g = est.groupBy(*GROUP).agg(named.alias("names"), F.min(F.when(used, F.col("r2"))).alias("min_r2"), F.count_if(used & (F.col("r2") < 0)).alias("n_negative_r2"), F.count("*").alias("n_attempted"), *figures)
    g = g.withColumn("enzymes_used", of(lambda n: n["reason"].isNull(), lambda n: n["name"], ",")).withColumn("excluded", of(lambda n: n["reason"].isNotNull(), lambda n: F.concat(n["name"], F.lit(":"), n["reason"]), ";"))
    worst = residuals(est, fused).groupBy(*GROUP).agg(F.max_by("enzyme", F.struct(F.round(F.abs("residual"), 6), -F.col("enzyme"))).alias("worst_enzyme"))
    return g.drop("names").join(worst, GROUP, "left")


def qc_reason(gates: list[tuple[Column, Column]]) -> Column:
    """Texts of the gates that a row fails, joined; a null figure skips its gate."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), text) for bad, text in gates])), "; ")


def with_qc(out: DataFrame, min_coverage: float = 1.0, min_fraction: float = 0.75, max_dispersion: float = 5.0, min_fit_rate: float = 0.8, alpha: float = 0.05, min_containment: float = 0.5, min_ori_confidence: float = 0.0) -> DataFrame:
    """out plus qc_reason, with the figures that fail, and pass_qc; rows are flagged, never dropped.  Gates whose column is absent don't apply."""

    def two(column, sign, limit):
        return F.concat(F.format_string(f"{column} %.2f {sign} ", F.round(column, 2)), F.lit(str(limit)))

    gates = {
        "coverage": lambda c: (c < min_coverage, two("coverage", "<", min_coverage)),
        "fraction": lambda c: (c < min_fraction, two("fraction", "<", min_fraction)),
        "dispersion": lambda c: (c > max_dispersion, two("dispersion", ">", max_dispersion)),
        "containment": lambda c: (c < min_containment, two("containment", "<", min_containment)),
        "enzyme_consistency": lambda c: (c < alpha, F.concat(F.lit("enzymes disagree (p="), short(c, 2), F.lit(")"))),
        "enzyme_fit_rate": lambda c: (c < min_fit_rate, F.format_string("only %d/%d enzymes produced a fit", F.coalesce("k", F.lit(0)).cast("int"), F.col("n_attempted").cast("int"))),
        "ori_confidence": lambda c: (F.lit(min_ori_confidence > 0) & (c < min_ori_confidence), two("ori_confidence", "<", min_ori_confidence)),
        "log2_ptr": lambda c: (c.isNull(), F.lit("no PTR estimate")),
    }
    return out.withColumn("qc_reason", qc_reason([make(F.col(c)) for c, make in gates.items() if c in out.columns])).withColumn("pass_qc", F.col("qc_reason") == "")


# 95 % points of the chi-square distribution of 1 to 15 degrees of freedom.
CHI2_95 = (3.841, 5.991, 7.815, 9.488, 11.070, 12.592, 14.067, 15.507, 16.919, 18.307, 19.675, 21.026, 22.362, 23.685, 24.996)
FUSE_SQL = f"""reasoned AS (SELECT *, CASE WHEN est IS NULL THEN 'no estimate' WHEN se IS NULL OR se <= 0 THEN 'no usable standard error' WHEN n_anchors < 30 THEN 'only ' || n_anchors || ' anchors (< 30)' END AS reason FROM estimates),
usedw AS (SELECT *, 1 / (se * se) AS w, sum(est / (se * se)) OVER g / sum(1 / (se * se)) OVER g AS fixed FROM reasoned WHERE reason IS NULL WINDOW g AS (PARTITION BY sample, genome_id)),
f1 AS (SELECT sample, genome_id, count(*) AS k, first(fixed) AS fixed, sqrt(1 / sum(w)) AS fixed_se, sum(w * (est - fixed) ** 2) AS q, sum(w) - sum(w * w) / sum(w) AS spread FROM usedw GROUP BY ALL),
f2 AS (SELECT *, CASE WHEN k > 1 THEN CASE WHEN q > 0 THEN greatest(0, (q - (k - 1)) / q) ELSE 0 END END AS i2, CASE WHEN k > 1 THEN greatest(0, (q - (k - 1)) / spread) ELSE 0 END AS tau2,
  k > 1 AND q > {list(CHI2_95)}[k - 1] AND q > k - 1 AS rejects FROM f1),
f3 AS (SELECT sample, genome_id, sum(est / (se * se + tau2)) / sum(1 / (se * se + tau2)) AS random, sqrt(1 / sum(1 / (se * se + tau2))) AS random_se FROM usedw JOIN f2 USING (sample, genome_id) GROUP BY ALL),
fused AS (SELECT *, CASE WHEN rejects THEN 'random' ELSE 'fixed' END AS fusion_model, CASE WHEN rejects THEN random ELSE fixed END AS log2_ptr, CASE WHEN rejects THEN random_se ELSE fixed_se END AS se FROM f2 JOIN f3 USING (sample, genome_id))"""
