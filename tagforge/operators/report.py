"""From counts to the output table, and the small reports."""

from __future__ import annotations

import html
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagforge.operators import fusion, gcbias, mixture, vfit, windows
from tagforge.operators.rates import tukey_keep


def estimate(
    counts: DataFrame, genomes: DataFrame, count_model: str = "auto", method: str = "auto", gc_correct: bool = True, min_windows: int = 5, window_cap: int = 100, shared_ori: bool = True,
    loess_frac: float = 0.4, alpha: float = 0.05, min_anchors: int = 30, given_windows: bool = False, containment: DataFrame | None = None, gates: dict | None = None, ori_prior: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(window rates, per-enzyme fits, output) of a count table with global positions, for all its genomes in one plan.

    ``genomes`` has genome_id, genome, genome_len, n_contigs, and where known taxonomy, ori and ori_confidence; ``containment`` has sample,
    genome_id, containment; ``gates`` are arguments of :func:`fusion.with_qc`; ``given_windows`` takes the counts' window_id for windows.
    """
    both = ["sample", "genome_id"]
    w = windows.given_windows(counts) if given_windows else windows.enzyme_windows(counts, window_cap)
    if gc_correct:
        w = gcbias.offsets(w, gcbias.fit_curves(counts, loess_frac), counts)
    else:
        w = w.withColumn("gc_offset", F.lit(None).cast("double"))
    key = mixture.KEY
    place = w.groupBy(*key).agg(F.avg("global_position").alias("mid"), F.avg("gc_offset").alias("mean_gc_offset"), F.var_samp(F.when(F.col("count") > 0, F.col("count"))).alias("var"), F.avg(F.when(F.col("count") > 0, F.col("count"))).alias("mean"))
    rates = mixture.model_rates(w, count_model).join(place, key)
    ln2 = F.log(F.lit(2.0))
    rates = rates.withColumn("log2_rate", F.when(F.col("rate") > 0, F.log2("rate"))).withColumn("log2_se", F.when(F.col("rate") > 0, F.col("se") / (F.col("rate") * ln2)))
    rates = rates.withColumn("dispersion", F.try_divide("var", "mean")).withColumn("detected_fraction", F.col("n_positive") / F.col("n_anchors"))
    rates = gcbias.apply_offset(rates) if gc_correct else rates
    fits = vfit.fit_windows(rates, genomes, method=method, min_windows=min_windows, shared_ori=shared_ori, ori_prior=ori_prior)
    kept = tukey_keep(rates, "log2_rate", [*both, "enzyme"]).where("keep")
    means = kept.groupBy(*both, "enzyme").agg(F.avg("rate").alias("mean_rate"), F.avg("detected_fraction").alias("mean_fraction"), F.avg("dispersion").alias("mean_dispersion"), F.sum("n_anchors").alias("n_anchors"))
    fits = fits.join(means, [*both, "enzyme"], "left").withColumn("n_anchors", F.coalesce("n_anchors", F.lit(0)))
    return rates, fits, assemble(fits, genomes, containment, alpha, min_anchors, gates)


def assemble(fits: DataFrame, genomes: DataFrame, containment: DataFrame | None = None, alpha: float = 0.05, min_anchors: int = 30, gates: dict | None = None) -> DataFrame:
    """The output table from per-enzyme fits: one row per sample and genome, figures over the enzymes used, flags; its file has the columns of :data:`tables.OUTPUT_COLUMNS`.

    ``fits`` has sample, genome_id, enzyme, log2_ptr, se, ok, note, method, ori, ori_confidence, n_windows_used, r2, n_anchors, mean_rate, mean_fraction and mean_dispersion.
    """
    both = ["sample", "genome_id"]
    est = fusion.exclusions(fits.withColumn("est", F.when(F.col("ok"), F.col("log2_ptr"))), min_anchors)
    fused = fusion.fuse(est, alpha=alpha)
    out = fusion.fuse_table(est, fused).join(fused, both, "left")
    known = genomes.select("genome_id", "genome", (F.col("taxonomy") if "taxonomy" in genomes.columns else F.lit(None).cast("string")).alias("taxonomy"))
    out = out.join(known, "genome_id", "left").withColumn("taxonomy", F.coalesce("taxonomy", F.lit("-")))
    if containment is not None:
        out = out.join(containment.select(*both, "containment"), both, "left")
    out = out.withColumn("enzyme_consistency", F.col("q_pvalue")).withColumn("enzyme_fit_rate", F.coalesce(F.col("k"), F.lit(0)) / F.col("n_attempted")).withColumn("note", fusion.note(alpha))
    out = fusion.with_qc(out, **{"alpha": alpha} | (gates or {})).withColumn("log2(PTR)", F.col("log2_ptr")).withColumn("n_enzymes", F.coalesce(F.col("k"), F.lit(0))).withColumn("enzyme_i2", F.col("i2"))
    return out.withColumn("fusion_model", F.coalesce("fusion_model", F.lit("none"))).withColumnRenamed("n_attempted", "n_enzymes_attempted").withColumnRenamed("ptr", "PTR")  # names ignore case


def audit(sites: DataFrame, contigs: DataFrame, min_anchors: int = 50, wide_gap: int = 5000) -> DataFrame:
    """Per genome: tags, enzymes with fewer than ``min_anchors``, largest gap, gaps beyond ``wide_gap``."""
    n = sites.groupBy("genome_id", "enzyme_idx").agg(F.count("*").alias("n"))
    thin = n.groupBy("genome_id").agg(F.sum("n").alias("n_tags"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("n") < min_anchors, F.col("enzyme_idx")))).cast("array<string>"), ",").alias("thin_enzymes"))
    gap = sites.withColumn("gap", F.col("position") - F.lag("position").over(W.partitionBy("genome_id", "contig_id").orderBy("position", "enzyme_idx", "pattern")))
    g = gap.groupBy("genome_id").agg(F.max("gap").alias("max_gap"), F.count_if(F.col("gap") > wide_gap).alias("n_wide_gaps"))
    names = contigs.select("genome_id", "genome").distinct()
    return names.join(thin, "genome_id", "left").join(g, "genome_id", "left")


def html_lines(table: DataFrame, title: str, order: list[str]) -> DataFrame:
    """value: the lines of a page with every row of a report table, in order; made row by row, so that a table of any size can be written as text."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("NA")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cells = F.concat(*[F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>")) for c in table.columns])
    rows = table.select(F.lit(1).alias("part"), F.struct(*order).alias("at"), F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("value"))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in table.columns)
    ends = [(0, f"<!DOCTYPE html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>"), (2, "</table>")]
    frame = table.sparkSession.createDataFrame(ends, "part int, value string").select("part", F.lit(None).cast(rows.schema["at"].dataType).alias("at"), "value")
    return rows.unionByName(frame).orderBy("part", "at").select("value")


def profile_points(rates: DataFrame) -> DataFrame:
    """Plot-ready points: rate against position."""
    return rates.where(F.col("log2_rate").isNotNull()).select("sample", "genome_id", "enzyme", "mid", "log2_rate", "log2_se")


def forest_points(fits: DataFrame) -> DataFrame:
    """Plot-ready intervals: one per enzyme."""
    return fits.where("ok").select("sample", "genome_id", "enzyme", "log2_ptr", (F.col("log2_ptr") - fusion.Z95 * F.col("se")).alias("low"), (F.col("log2_ptr") + fusion.Z95 * F.col("se")).alias("high"))


def figures(rates: DataFrame, fits: DataFrame) -> dict[str, DataFrame]:
    """The tables behind the quality figures, by name."""
    return {"rate_by_position": profile_points(rates), "enzyme_forest": forest_points(fits)}


#: Size of a figure and the space around its axes.
WIDTH, HEIGHT, EDGE = 900, 450, 60


def _svg(title: str, x_label: str, marks: list[str], x: tuple[float, float], ticks: list[tuple[float, str]], height: int = HEIGHT) -> str:
    """A figure with a title, a labelled axis and marks; every text is escaped."""
    place = lambda v: EDGE + (v - x[0]) / ((x[1] - x[0]) or 1) * (WIDTH - 2 * EDGE)
    axis = [f'<line class="axis" x1="{EDGE}" y1="{height - EDGE}" x2="{WIDTH - EDGE}" y2="{height - EDGE}" stroke="#444"/>']
    axis += [f'<text x="{place(v):.1f}" y="{height - EDGE + 16}" text-anchor="middle">{html.escape(t)}</text>' for v, t in ticks]
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{height}" font-family="sans-serif" font-size="11"><title>{html.escape(title)}</title>'
    texts = [f'<text x="{WIDTH / 2}" y="24" text-anchor="middle" font-size="14">{html.escape(title)}</text>', f'<text x="{WIDTH / 2}" y="{height - 12}" text-anchor="middle">{html.escape(x_label)}</text>']
    return "\n".join([head, *texts, *axis, *marks, "</svg>"]) + "\n"


def _ticks(low: float, high: float, scale: float = 1.0) -> list[tuple[float, str]]:
    return [(low + (high - low) * k / 4, f"{(low + (high - low) * k / 4) / scale:.2f}") for k in range(5)]


def _profile_svg(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    """log2 rate against position, a colour an enzyme, with the origin."""
    low, high, length = float(g["log2_rate"].min()), float(g["log2_rate"].max()), float(g["genome_len"].iloc[0])
    across = lambda v: EDGE + v / length * (WIDTH - 2 * EDGE)
    down = lambda v: HEIGHT - EDGE - (v - low) / ((high - low) or 1) * (HEIGHT - 2 * EDGE)
    marks = []
    for n, (enzyme, e) in enumerate(g.sort_values(["name", "mid"]).groupby("name", sort=True)):
        colour = f"hsl({n * 137 % 360},65%,45%)"
        marks += [f'<circle cx="{across(m):.1f}" cy="{down(v):.1f}" r="2.5" fill="{colour}" fill-opacity="0.6"/>' for m, v in zip(e["mid"], e["log2_rate"], strict=True)]
        marks.append(f'<text x="{WIDTH - EDGE + 4}" y="{EDGE + 14 * n}" fill="{colour}">{html.escape(str(enzyme))}</text>')
    if pd.notna(g["ori"].iloc[0]):
        marks.append(f'<line class="ori" x1="{across(g["ori"].iloc[0]):.1f}" y1="{EDGE}" x2="{across(g["ori"].iloc[0]):.1f}" y2="{HEIGHT - EDGE}" stroke="crimson" stroke-dasharray="5 3"/>')
    marks += [f'<text x="{EDGE - 6}" y="{down(v):.1f}" text-anchor="end">{t}</text>' for v, t in _ticks(low, high)]
    text = _svg(f"{key[0]} / {g['genome'].iloc[0]}", "genome coordinate (Mb)", marks, (0, length), _ticks(0, length, 1e6))
    return pd.DataFrame({"name": [f"{_plain(key[0])}__{_plain(g['genome'].iloc[0])}.profile.svg"], "text": [text]})


def _forest_svg(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    """One line an enzyme: estimate and error; the fused estimate and its interval across."""
    g = g.sort_values("name")
    fused, ci_low, ci_high, p = (g[c].iloc[0] for c in ("fused", "ci_low", "ci_high", "p"))
    seen = [v for v in [*(g["log2_ptr"] - g["se"].fillna(0)), *(g["log2_ptr"] + g["se"].fillna(0)), fused, ci_low, ci_high] if pd.notna(v)]
    low, high, height = min(seen), max(seen), 2 * EDGE + 22 * len(g)
    across = lambda v: EDGE + (v - low) / ((high - low) or 1) * (WIDTH - 2 * EDGE)
    marks = []
    if pd.notna(ci_low):
        marks.append(f'<rect class="interval" x="{across(ci_low):.1f}" y="{EDGE}" width="{across(ci_high) - across(ci_low):.1f}" height="{height - 2 * EDGE}" fill="crimson" fill-opacity="0.12"/>')
    if pd.notna(fused):
        marks.append(f'<line class="fused" x1="{across(fused):.1f}" y1="{EDGE}" x2="{across(fused):.1f}" y2="{height - EDGE}" stroke="crimson"/>')
    for n, (name, value, se) in enumerate(zip(g["name"], g["log2_ptr"], g["se"].fillna(0), strict=True)):
        y = EDGE + 11 + 22 * n
        marks.append(f'<line x1="{across(value - se):.1f}" y1="{y}" x2="{across(value + se):.1f}" y2="{y}" stroke="#236"/><circle cx="{across(value):.1f}" cy="{y}" r="4" fill="#236"/><text x="{EDGE - 6}" y="{y + 4}" text-anchor="end">{html.escape(str(name))}</text>')
    title = f"{key[0]} / {g['genome'].iloc[0]}" + (f"  (Q p={p:.3g})" if pd.notna(p) else "")
    return pd.DataFrame({"name": [f"{_plain(key[0])}__{_plain(g['genome'].iloc[0])}.forest.svg"], "text": [_svg(title, "log2(PTR)", marks, (low, high), _ticks(low, high), height)]})


def _plain(name) -> str:
    """A name as a part of a file's name."""
    return quote(str(name), safe=" ")


def svg_figures(rates: DataFrame, fits: DataFrame, out: DataFrame, genomes: DataFrame) -> DataFrame:
    """(name, text) of a profile and a forest figure per sample and genome that has points; a group is one genome's windows or enzymes in one sample."""
    both = ["sample", "genome_id"]
    known = genomes.select("genome_id", "genome", F.col("genome_len").cast("double").alias("genome_len"))
    row = out.select(*both, F.col("ori"), F.col("`log2(PTR)`").alias("fused"), "ci_low", "ci_high", F.col("enzyme_consistency").alias("p"))
    points = profile_points(rates).select(*both, fusion.enzyme_name("enzyme").alias("name"), F.col("mid").cast("double").alias("mid"), "log2_rate").join(known, "genome_id").join(row.select(*both, "ori"), both, "left")
    bars = fits.where("ok").select(*both, fusion.enzyme_name("enzyme").alias("name"), "log2_ptr", "se").join(known, "genome_id").join(row, both, "left")
    made = points.groupBy(*both).applyInPandas(_profile_svg, "name string, text string")
    return made.unionByName(bars.groupBy(*both).applyInPandas(_forest_svg, "name string, text string"))
