from __future__ import annotations

import random

import pytest

from tagforge.cli import main
from tagforge.functions.seq import COMPLEMENTS, CODES
from tagforge.panel import ENZYMES
from tagforge.sources import tables, tgt

TURN = str.maketrans(CODES, COMPLEMENTS)


def test_index_profile_dynamics_audit_scaffold(spark, tmp_path):
    rng = random.Random(7)
    genome = "".join(rng.choice("ACGT") for _ in range(60_000))
    (tmp_path / "g.fna").write_text(">chr1\n" + "\n".join(genome[i : i + 70] for i in range(0, len(genome), 70)) + "\n")
    (tmp_path / "tax.tsv").write_text("g\tSome lineage\n")
    reads = []
    for i in range(6000):
        p = rng.randrange(len(genome) - 100)
        d = min(p, len(genome) - p) / (len(genome) / 2)
        if rng.random() < 2 ** (1 - d) / 2:
            s = genome[p : p + 100]
            reads.append(s if i % 2 else s.translate(TURN)[::-1])
    for name in ("a", "b"):
        (tmp_path / f"{name}.fastq").write_text("".join(f"@r{i}\n{s}\n+\n{'I' * 100}\n" for i, s in enumerate(reads)))
    db, out = str(tmp_path / "db"), str(tmp_path / "out")
    main(["index", str(tmp_path / "g.fna"), "-o", db, "-a", str(tmp_path / "tax.tsv"), "--screen-scale", "16", "--write-tgt"], spark)
    assert tgt.read_all(spark, f"{db}/tgt").count() == spark.read.parquet(f"{db}/anchors").count()
    assert spark.read.parquet(f"{db}/anchors").count() > 500 and spark.read.parquet(f"{db}/genomes").head().taxonomy == "Some lineage"
    main(["profile", str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq"), "-d", db, "-o", out], spark)
    stats = spark.read.json(f"{out}/stats").collect()
    assert {r["sample"] for r in stats} == {"a", "b"} and all(r.match_rate > 0.9 for r in stats)
    table = spark.read.csv(f"{out}/output", sep="\t", header=True, nullValue="NA").collect()
    assert len(table) == 2 and all(r.taxonomy == "Some lineage" for r in table) and len(table[0]) == 28
    for r in table:
        assert float(r.PTR) == pytest.approx(2 ** float(r["log2(PTR)"]), rel=1e-6) and float(r.ci_low) < float(r["log2(PTR)"]) < float(r.ci_high)
        used, excluded = r.enzymes_used.split(","), dict(x.split(":", 1) for x in r.excluded.split(";")) if r.excluded != "-" else {}
        assert set(used) | set(excluded) <= {e.name for e in ENZYMES} and len(used) == int(r.n_enzymes) and len(used) + len(excluded) == int(r.n_enzymes_attempted)
        assert set(r.method.split(",")) <= {"v_shape", "v_shape_segmented"} and 0 < float(r.fraction) <= 1 and float(r.coverage) > 0 and float(r.enzyme_fit_rate) == pytest.approx(len(used) / int(r.n_enzymes_attempted), rel=1e-6)
        assert (r.pass_qc == "true") == (not r.qc_reason)
    main(["profile", str(tmp_path / "a.fastq"), "-d", db, "-o", f"{out}2", "--screen", "--use-windows", "--figures", "--count-model", "ztp", "--min-coverage", "0.5"], spark)
    full = {tuple(r[k] for k in ("contig_id", "position", "enzyme_idx", "count")) for r in spark.read.parquet(f"{out}/counts").where("sample = 'a'").collect()}
    assert full == {tuple(r[k] for k in ("contig_id", "position", "enzyme_idx", "count")) for r in spark.read.parquet(f"{out}2/counts").collect()}
    assert spark.read.csv(f"{out}2/figures/rate_by_position", sep="\t", header=True).count() > 0
    main(["profile", str(tmp_path / "a.fastq"), "-d", db, "-o", f"{out}3", "--screen", "--screen-min-hits", "1000000", "--screen-min-frac", "2", "--no-stats"], spark)
    assert spark.read.parquet(f"{out}3/counts").count() == 0
    main(["manifest", "-d", db, "-o", str(tmp_path / "man")], spark)
    for path in (f"{db}/manifest", str(tmp_path / "man")):
        row = tables.read_manifest(spark, path).head()
        assert (row.id, row["name"], row.taxonomy, row.genome_len, row.n_contigs, row.contigs[0]["name"], row.gc_flank, row.format_version, len(row.enzymes)) == (0, "g", "Some lineage", 60_000, 1, "chr1", 250, 1, 16)
    back = tables.read_counts(spark, f"{out}/counts_tsv")
    assert back.count() == spark.read.parquet(f"{out}/counts").count() and back.where("genome <> 'g' OR strand NOT IN ('+', '-')").count() == 0
    assert {r.enzyme for r in back.select("enzyme").distinct().collect()} <= {e.name for e in ENZYMES} and back.where("window_id IS NOT NULL").count() == back.where("usable").count()
    main(["dynamics", f"{out}/output", "-o", str(tmp_path / "dyn"), "--baseline", "a", "--include-failed"], spark)
    delta = spark.read.csv(str(tmp_path / "dyn/delta"), sep="\t", header=True, nullValue="NA")
    assert delta.columns == "genome sample group timepoint log2_ptr baseline_log2_ptr delta_log2_ptr se z p fold_change q".split() and delta.count() == 1
    assert delta.head().genome == "g" and abs(float(delta.head().delta_log2_ptr)) < 1e-6
    main(["audit", db, "-o", str(tmp_path / "aud")], spark)
    assert "Database audit" in spark.read.text(str(tmp_path / "aud/audit_html")).head().value
    main(["digest", str(tmp_path / "g.fna"), "-o", str(tmp_path / "dig")], spark)
    parts = [genome[:15_000], genome[15_000:30_000].translate(TURN)[::-1], genome[30_000:]]
    (tmp_path / "draft.fna").write_text("".join(f">d{i}\n{s}\n" for i, s in enumerate(parts)))
    main(["scaffold", str(tmp_path / "draft.fna"), "-d", db, "-r", "g", "-o", str(tmp_path / "sc"), "--index-fasta"], spark)
    got = {int(r.contig_id): (r.orientation, int(r.ref_start)) for r in spark.read.csv(str(tmp_path / "sc/placements"), sep="\t", header=True).collect()}
    assert got[0] == ("Forward", 0) and got[1][0] == "Reverse" and abs(got[1][1] - 15_000) < 40 and got[2] == ("Forward", 30_000)
