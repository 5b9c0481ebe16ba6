"""Draft contigs placed on a reference by the tags that both have once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagforge.functions.seq import canonical, revcomp


def unique_tags(sites: DataFrame) -> DataFrame:
    """canon, contig_id, position of tags at exactly one locus."""
    g = sites.groupBy(canonical("tag").alias("canon")).agg(F.countDistinct("contig_id", "position").alias("loci"), F.min("contig_id").alias("contig_id"), F.min("position").alias("position"))
    return g.where("loci = 1").drop("loci")


def shared_tags(draft: DataFrame, reference: DataFrame) -> DataFrame:
    """contig_id, pos, ref: draft tags with the reference position of the same unique tag."""
    d = unique_tags(draft).withColumnRenamed("position", "pos")
    r = unique_tags(reference).select("canon", F.col("position").alias("ref"))
    return d.join(r, "canon").select("contig_id", "pos", "ref")


def orientation(shared: DataFrame) -> DataFrame:
    """contig_id, n_tags, concordance, orientation: the vote of all tag pairs that differ on both axes, ties forward.

    Per contig the discordant pairs are the inversions of its reference positions in draft order, counted while merging sorted runs; no pair
    is ever made.  Without a comparable pair the concordance is 0.
    """
    schema = f"contig_id {shared.schema['contig_id'].dataType.simpleString()}, n_tags bigint, up bigint, down bigint"
    o = shared.select("contig_id", "pos", "ref").groupBy("contig_id").applyInPandas(_votes, schema)
    share = F.try_divide(F.greatest("up", "down"), F.col("up") + F.col("down"))
    return o.select("contig_id", "n_tags", F.coalesce(share, F.lit(0.0)).alias("concordance"), F.when(F.col("up") >= F.col("down"), "Forward").otherwise("Reverse").alias("orientation"))


def _votes(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    n = len(g)
    down = _inversions(g.sort_values(["pos", "ref"])["ref"].to_numpy())
    several = lambda k: int((k * (k - 1) // 2).sum())
    ties = several(g.groupby("pos").size()) + several(g.groupby("ref").size()) - several(g.groupby(["pos", "ref"]).size())
    return pd.DataFrame({"contig_id": [key[0]], "n_tags": n, "up": n * (n - 1) // 2 - ties - down, "down": down})


def _inversions(v: np.ndarray) -> int:
    """Pairs i < j with v[i] > v[j]: sorted halves are merged, each element of the right one passing what is greater on its left."""
    runs, total = [v[i : i + 1] for i in range(len(v))], 0
    while len(runs) > 1:
        merged = []
        for a, b in zip(runs[::2], runs[1::2], strict=False):
            total += int((len(a) - np.searchsorted(a, b, side="right")).sum())
            merged.append(np.sort(np.concatenate((a, b)), kind="stable"))
        runs = merged + runs[len(merged) * 2 :]
    return total


def place(shared: DataFrame, contigs: DataFrame, min_tags: int = 3, min_concordance: float = 0.8) -> DataFrame:
    """Placed contigs: orientation and the upper median of the projected starts, not below 0."""
    o = orientation(shared).where((F.col("n_tags") >= min_tags) & (F.col("concordance") >= min_concordance))
    j = shared.join(o, "contig_id").join(contigs.select("contig_id", "length"), "contig_id")
    start = F.when(F.col("orientation") == "Forward", F.col("ref") - F.col("pos")).otherwise(F.col("ref") - (F.col("length") - 1 - F.col("pos")))
    s = j.groupBy("contig_id", "orientation", "n_tags", "concordance", "length").agg(F.sort_array(F.collect_list(start)).alias("s"))
    return s.select("contig_id", "orientation", "n_tags", "concordance", "length", F.greatest(F.lit(0), F.element_at("s", (F.floor(F.size("s") / 2) + 1).cast("int"))).alias("ref_start"))


def apply(sites: DataFrame, contigs: DataFrame, placed: DataFrame) -> DataFrame:
    """sites plus global_position: placed contigs at their start (mirrored when reversed), others parked behind the last end in contig order."""
    end = placed.agg(F.coalesce(F.max(F.col("ref_start") + F.col("length")), F.lit(0)).alias("end"))
    rest = contigs.select("contig_id", "length").join(placed.select("contig_id"), "contig_id", "left_anti").crossJoin(F.broadcast(end))
    before = F.coalesce(F.sum("length").over(W.orderBy("contig_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parked = rest.select("contig_id", "length", F.lit("Unplaced").alias("orientation"), (F.col("end") + before).alias("ref_start"))
    every = placed.select("contig_id", "length", "orientation", "ref_start").unionByName(parked)
    j = sites.join(every, "contig_id")
    at = F.when(F.col("orientation") == "Reverse", F.col("length") - 1 - F.col("position")).otherwise(F.col("position"))
    return j.select(*sites.columns, "orientation", (F.col("ref_start") + at).alias("global_position"))


def placed_fraction(placed: DataFrame, contigs: DataFrame) -> DataFrame:
    ok = contigs.join(placed.select("contig_id", "ref_start"), "contig_id", "left")
    bp = F.sum(F.when(F.col("ref_start").isNotNull(), F.col("length")))
    return ok.agg(F.count("*").alias("n_contigs"), F.count("ref_start").alias("n_placed"), F.round(F.coalesce(bp, F.lit(0)) / F.sum("length"), 6).alias("placed_fraction"))


def fasta(contigs: DataFrame, placed: DataFrame, width: int = 70) -> DataFrame:
    """contig_id, ord, record: FASTA text in placed order, reversed contigs turned, unplaced ones last."""
    at = contigs.select("contig_id").join(placed.select("contig_id", "orientation", "ref_start"), "contig_id", "left")
    # One task ranks ids and starts; the sequences stay where they are dealt.
    rank = F.row_number().over(W.orderBy(F.col("ref_start").isNull(), "ref_start", "contig_id"))
    j = contigs.join(at.select("contig_id", "orientation", rank.alias("ord")), "contig_id")
    s = F.when(F.col("orientation") == "Reverse", revcomp("seq")).otherwise(F.col("seq"))
    wrapped = F.regexp_replace(F.regexp_replace(s, f"(.{{{width}}})", "$1\n"), "\n$", "")
    name = F.concat_ws(" ", "name", F.coalesce("orientation", F.lit("Unplaced")))
    return j.select("contig_id", "ord", F.concat(F.lit(">"), name, F.lit("\n"), wrapped).alias("record"))
