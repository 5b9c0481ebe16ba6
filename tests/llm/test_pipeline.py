"""The pipeline stage by stage against brute force on its own inputs."""

from __future__ import annotations

import pandas as pd

import corpus_pipeline as P
from tagforge.llm import mixing, quality, rules
from tagforge.llm.common import load

from .test_operators import brute_components, check_bins, words


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = load(spark, sf, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        frame = out.toPandas()
        seen[name] = (docs.toPandas(), frame)
        if name != "best_fit_packing":
            assert out.columns == columns
            docs = spark.createDataFrame(frame, docs.schema)
    before, after = seen["quality_rules"]
    model = rules.train(load(spark, sf, "documents"), load(spark, sf, "labels"))
    want = [i for i, t in zip(before.doc_id, before.text, strict=True) if bool(rules.judge(model, rules.THRESHOLD, [t])[-1][0])]
    assert sorted(after.doc_id) == sorted(want) and len(after) < len(before)
    before, after = seen["quality_classifier"]
    model = quality.train(load(spark, sf, "documents"), load(spark, sf, "labels"))
    assert sorted(after.doc_id) == sorted(before.doc_id[quality.score(model, before.text.tolist()) >= 0.3])
    before, after = seen["near_dedup"]
    label, _ = brute_components(list(zip(before.doc_id, before.text, strict=True)), 5, 80)
    assert sorted(after.doc_id) == sorted(i for i, c in label.items() if i == c)
    before, after = seen["source_mix"]
    plan = mixing.plan(spark.createDataFrame(before)).toPandas()
    times = (plan.taken / plan["size"].clip(lower=1)).astype(int)
    assert sorted(after.doc_id) == sorted(i for i, n in zip(plan.doc_id, times, strict=True) for _ in range(n))
    before, after = seen["best_fit_packing"]
    size = pd.Series([len(words(t)) for t in before.text]).groupby(before.doc_id.to_numpy()).sum()
    assert after.groupby("doc_id").piece_words.sum().to_dict() == size.to_dict()
    check_bins(after, [], (256, 512, 1024, 2048, 4096))


def test_run_equals_brute_force(spark):
    """run() on the smallest tables against every stage redone without Spark: models on single texts, all pairs, the plan of the mix."""
    sf = "/root/testdata/sf0.001"
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    frame = docs.toPandas()
    rule, model = rules.train(docs, labels), quality.train(docs, labels)
    frame = frame[[bool(rules.judge(rule, rules.THRESHOLD, [t])[-1][0]) and quality.score(model, [t])[0] >= 0.3 for t in frame.text]]
    label, _ = brute_components(list(zip(frame.doc_id, frame.text, strict=True)), 5, 80)
    frame = frame[[label[i] == i for i in frame.doc_id]]
    plan = mixing.plan(spark.createDataFrame(frame)).toPandas().set_index("doc_id")
    want = {i: len(words(t)) * n for i, t in zip(frame.doc_id, frame.text, strict=True) if (n := int(plan.taken[i] / max(plan["size"][i], 1)))}
    got = P.run(spark, sf).toPandas()
    assert got.groupby("doc_id").piece_words.sum().to_dict() == want
    check_bins(got, [], (256, 512, 1024, 2048, 4096))


def odd_tables(spark, folder, rows):
    """Tables for run() with nulls, empty and long texts, repeated rows and columns whose names clash with those of the operators."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    d.withColumns({c: F.lit(1) for c in ("y", "at", "id", "size", "__row", "score", "kept")}).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    labels.write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    good, junk = "plain words of text number {} that go on and on for long enough to pass the rules " * 1, "### $$$ %%% {} &&& *** "
    unique = lambda i: " ".join(f"w{i}x{k}" for k in range(70))
    rows = [(i, (unique(i) if i % 2 else junk.format(i) * 20), "en", "a" if i < 30 else None, 1) for i in range(40)]
    rows += [(None, unique(500), "en", "b", 1), (None, unique(501), None, "b", None), (7, unique(7), "en", "a", 1), (50, None, "en", "a", 1), (51, "", "en", None, 0), (52, unique(52) + " long" * 20_000, "en", "b", 1)]
    out = P.run(spark, odd_tables(spark, tmp_path / "odd", rows))
    found = out.toPandas()
    assert not found.empty and set(found.doc_id.dropna()) <= {r[0] for r in rows} and (found.piece_words > 0).all()
    empty = P.run(spark, odd_tables(spark, tmp_path / "none", []))
    assert empty.count() == 0 and empty.columns == out.columns


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = load(spark, sf, "documents"), load(spark, sf, "labels")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").where("n_chars > 600")
    kept = P.quality_classifier(spark, P.quality_rules(spark, good, sf), sf).count()
    assert kept >= 0.97 * good.count()
