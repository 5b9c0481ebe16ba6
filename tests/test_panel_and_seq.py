from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tagforge.functions import seq as S
from tagforge.operators import digest as D
from tagforge.panel import ENZYMES, IUPAC, LENGTHS, bitset, selection

TURN = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(TURN)[::-1]


def test_panel_is_closed_under_reverse_complement():
    for e in ENZYMES:
        for p, pattern in enumerate(e.patterns):
            window = ["A"] * e.length
            for offset, motif in pattern:
                for i, m in enumerate(motif):
                    window[offset + i] = IUPAC[m][0]
            turned = rc("".join(window))
            assert any(re.match(e.window_regex(q), turned) for q in range(len(e.patterns))), (e.name, p)


def test_selection():
    assert LENGTHS == (32, 27, 28, 25, 33)
    assert [e.name for e in selection("cjepi, BcgI,bcgi")] == ["BcgI", "CjePI"]
    assert bitset(selection("all")) == 65535
    for bad in ("", "nope"):
        with pytest.raises(ValueError, match="unknown"):
            selection(bad)


def test_scalar_functions(spark):
    row = spark.createDataFrame([("AACGTN", "acgu-x", "ACGT", "AGGT")], "s string, raw string, a string, b string").select(
        S.revcomp("s").alias("rc"), S.normalize("raw").alias("n"), S.is_palindromic("a").alias("pal"), S.gc_fraction("s").alias("gc"), S.quantize_gc(S.gc_fraction("s")).alias("q"),
        S.quantize_gc(S.gc_fraction(F.lit("NN"))).alias("none"), S.hamming("a", "b").alias("h"), S.hamming("a", "s").alias("other"), S.hamming_within("a", "b", 0).alias("over"), S.pack_2bit("a").alias("bits"),
    ).head()
    assert row.asDict() == {"rc": "NACGTT", "n": "ACGTNN", "pal": True, "gc": 0.4, "q": 80, "none": 255, "h": 1, "other": None, "over": None, "bits": 27}


def test_seeds_cover_every_tag():
    for n in LENGTHS:
        for k in (1, 2, 3, 4):
            r = S.seed_ranges(n, k)
            assert r[0][0] == 0 and sum(x for _, x in r) == n and all(a + x == b for (a, x), (b, _) in zip(r, r[1:], strict=False))
    assert [x for _, x in S.seed_ranges(25, 3)] == [8, 8, 9]


def test_sample_names(spark):
    paths = ["/d/a_R1.fastq.gz", "b_2.fq", "c.fna", "x/_1.fa", "plain"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select(S.sample_name("p").alias("s"))
    assert [r.s for r in got.collect()] == ["a", "b", "c", "", "plain"]


def contig(spark, seq, contig_id=0):
    return spark.createDataFrame([(0, contig_id, seq)], "genome_id int, contig_id int, seq string")


def found(spark, seq, spec="all"):
    return sorted((r.position, ENZYMES[r.enzyme_idx].name, r.pattern) for r in D.sites(contig(spark, seq), selection(spec), 0).collect())


def test_planted_tags(spark):
    tag = "AAAAAAAAAACGAACGTACTGCTTTTTTTTTT"
    assert found(spark, tag, "BcgI") == [(0, "BcgI", 0)]
    assert found(spark, rc(tag), "BcgI") == [(0, "BcgI", 1)]
    shared = "TTTTTTTTGACTTTTTTTGGTTTTTTT"
    assert {n for _, n, _ in found(spark, shared, "Bsp24I,CjePI")} == {"Bsp24I", "CjePI"}
    assert found(spark, tag[:5] + "N" + tag[6:], "BcgI") == []
    assert found(spark, "A" * 40 + "GATCCCCCATC" + "A" * 40, "HaeIV") == [(31, "HaeIV", 1), (33, "HaeIV", 0)]
    assert len(found(spark, "T" * 40 + "GGGACGGGAC" + "T" * 40, "BslFI")) == 2


def test_tags_across_tile_borders(spark):
    tag = "AAAAAAAAAACGAACGTACTGCTTTTTTTTTT"
    for start in (480, 500, 511, 512, 1000):
        assert [p for p, _, _ in found(spark, "T" * start + tag + "T" * 50, "BcgI")] == [start]


def test_greedy_merge_keeps_the_last_kept(spark):
    rows = [(0, 0, p, 0, 0, "") for p in (0, 30, 60)] + [(0, 1, p, 0, 0, "") for p in (100, 110, 600)]
    s = spark.createDataFrame(rows, "genome_id int, contig_id int, position bigint, enzyme_idx int, pattern int, tag string")
    got = sorted((r.contig_id, r.position) for r in D.merged_loci(s, 33).collect())
    assert got == [(0, 0), (0, 60), (1, 100), (1, 600)]


def test_packing_and_codes(spark):
    tag = "TTTT" + "ACGT" * 7
    got = spark.createDataFrame([(tag, tag[:-1] + "A", "ACGN")], "a string, b string, n string").select(S.pack_2bit("a").alias("bits"), S.pack_2bit("n").alias("none"), S.hamming("a", "b").alias("d"), S.pack_words("a").alias("w")).head()
    value = sum("ACGT".index(c) << 2 * (31 - i) for i, c in enumerate(tag))
    assert got.bits == value - (1 << 64) and got.none is None and got.d == 1 and len(got.w) == 2
    codes = spark.createDataFrame([("R", "a"), ("R", "C"), ("N", "N"), ("X", "A")], "code string, base string")
    assert [r.m for r in codes.select(S.iupac_matches("code", "base").alias("m")).collect()] == [True, False, False, False]


def brute_windows(seq, enzymes):
    out = set()
    for e in enzymes:
        for p in range(len(e.patterns)):
            rx = re.compile(e.loose_regex(p))
            for i in range(len(seq) - e.length + 1):
                if rx.match(seq[i : i + e.length]):
                    out.add((i, e.length))
    return out


def test_read_scan_by_brute_force(spark):
    import random

    from tagforge.operators import match as M
    from tagforge.operators import scan

    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGTACGTACGTN") for _ in range(rng.choice((0, 5, 24, 25, 33, 100, 400)))) for _ in range(300)] + ["", None]
    reads = spark.createDataFrame([("s", f"f{i % 2}", i // 2, s) for i, s in enumerate(seqs)], "sample string, file string, read_id bigint, seq string")
    got = M.read_windows(reads).collect()
    want = {(f"f{i % 2}", i // 2, a, n) for i, s in enumerate(seqs) for a, n in brute_windows(s or "", ENZYMES)}
    assert {(r.file, r.read_id, r.start, r.tag_len) for r in got} == want and len(got) == len(want)
    for r in got:
        q = (seqs[r.read_id * 2 + int(r.file[1])])[r.start : r.start + r.tag_len]
        assert (r.q, r.ambiguous) == (q, "N" in q) and (r.ambiguous or r.canon == min(q, rc(q)))
    old, scan.PIECE = scan.PIECE, 64  # pieces shorter than the sequences
    try:
        contigs = spark.createDataFrame([(0, i, s) for i, s in enumerate(seqs[:40])], "genome_id int, contig_id int, seq string")
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"contig_id": list(range(40)), "seq": seqs[:40]})
        cut = sorted((x["contig_id"], x["position"], x["enzyme_idx"], x["pattern"], x["tag"], x["local_gc"]) for b in scan._site_rows(ENZYMES, 1, 250, ["contig_id", "position", "enzyme_idx", "pattern", "tag", "local_gc"], [batch]) for x in b.to_pylist())
        sketch = sorted((x["contig_id"], x["kmer"]) for b in scan._kmer_rows(21, 1 << 62, 1, ["contig_id", "kmer"], [batch]) for x in b.to_pylist())
    finally:
        scan.PIECE = old
    whole = sorted((r.contig_id, r.position, r.enzyme_idx, r.pattern, r.tag, r.local_gc) for r in D.sites(contigs, min_contig_len=0, flank=250).collect())
    assert cut == whole and whole
    assert set(sketch) == {(r.contig_id, r.kmer) for r in scan.kmers(contigs, ["contig_id"], 21, 4).collect()}


def test_two_files_of_a_sample_keep_their_reads(spark, sf):
    from tagforge.operators import match as M
    from tagforge.sources import fixtures as X

    sites = D.sites(X.contigs(spark, sf)).where("genome_id = 3 AND contig_id = 0").limit(1)
    tag = sites.head().tag
    reads = spark.createDataFrame([("s", "R1", 0, tag), ("s", "R2", 0, rc(tag))], "sample string, file string, read_id bigint, seq string")
    wins = M.read_windows(reads)
    hits = M.matches(wins, sites, 2)
    assert M.single_tag_reads(hits).count() == 2
    stats = M.sample_stats(reads, M.window_summary(wins, hits)).head()
    assert stats.reads_total == 2 and stats.reads_with_anchor == 2


def test_orientation_votes_by_brute_force(spark):
    import random

    from tagforge.operators import scaffold as P

    rng = random.Random(1)
    rows = [(c, rng.randrange(40), rng.randrange(40)) for c in range(6) for _ in range(30)] + [(7, 1, 1), (8, 2, 5), (8, 2, 9)]
    got = {r.contig_id: r for r in P.orientation(spark.createDataFrame(rows, "contig_id int, pos bigint, ref bigint")).collect()}
    for c in {r[0] for r in rows}:
        t = [(a, b) for k, a, b in rows if k == c]
        up = sum(a < x and b < y for a, b in t for x, y in t)
        down = sum(a < x and b > y for a, b in t for x, y in t)
        assert got[c].concordance == pytest.approx(max(up, down) / (up + down) if up + down else 0) and got[c].orientation == ("Forward" if up >= down else "Reverse") and got[c].n_tags == len(t)


def test_sample_names_by_steps(spark):
    def steps(path):
        name = path.rsplit("/", 1)[-1]
        for ext in (".gz", ".fastq", ".fq", ".fasta", ".fa", ".fna"):
            name = name.removesuffix(ext)
        return next((name.removesuffix(t) for t in ("_R1", "_R2", "_1", "_2") if name.endswith(t)), name)

    paths = [f"{d}{stem}{tail}{ext}" for d in ("", "/a.fq/b_1/") for stem in ("x", "x_1", "x.gz", "x_R1_2", "") for tail in ("", "_R1", "_2", "_R3", "_1_R2") for ext in ("", ".gz", ".fastq.gz", ".fna", ".fa.fastq", ".fastq.fa", ".fq.fasta.gz", ".gz.gz", ".txt")]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", S.sample_name("p").alias("s")).collect()
    assert [(r.p, r.s) for r in got] == [(p, steps(p)) for p in paths]
