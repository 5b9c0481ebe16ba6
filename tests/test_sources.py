from __future__ import annotations

import gzip
import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tagforge.operators import anchors as A
from tagforge.operators import digest as D
from tagforge.sources import fasta, tables, tgt
from tagforge.sources import fixtures as X


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g/one.fna").write_text(">chr1 note\nACGT\nacgu\n>plasmidX\nNNXA\n")
    with gzip.open(tmp_path / "g/two.fa.gz", "wb") as f:
        f.write(b">c\nAC\n")
    with gzip.open(tmp_path / "g/two.fa.gz", "ab") as f:
        f.write(b">d\nGT\n")
    got = sorted((r.genome, r.contig_id, r["name"], r.seq, r.kind) for r in fasta.read_fasta(spark, [str(tmp_path / "g")]).collect())
    assert got == [("one", 0, "chr1", "ACGTACGT", "chromosome"), ("one", 1, "plasmidX", "NNNA", "plasmid"), ("two", 0, "c", "AC", "chromosome"), ("two", 1, "d", "GT", "chromosome")]
    (tmp_path / "s_R1.fastq").write_text("@r1 x\nACGN\n+\nIIII\n@r2\nTT\n+r2\nII\n")
    (tmp_path / "s_R2.fastq").write_text("")
    reads = fasta.read_reads(spark, [str(tmp_path / "s_R1.fastq"), str(tmp_path / "s_R2.fastq")]).collect()
    assert sorted((r.sample, r.read_id, r.seq) for r in reads) == [("s", 0, "ACGN"), ("s", 18, "TT")]
    with pytest.raises(ValueError, match="before"):
        list(fasta.parse(b"ACGT\n>x\nA"))
    with pytest.raises(ValueError, match="no record"):
        list(fasta.parse(b"\n"))
    with pytest.raises(FileNotFoundError):
        fasta.expand(spark, [str(tmp_path / "none")], fasta.READ_SUFFIXES)


def test_anchor_table_round_trip(spark, sf, tmp_path):
    c = X.contigs(spark, sf).where("genome_id < 3")
    a = A.assemble(c, D.sites(c))
    A.save(a, c, str(tmp_path / "db"), {"enzymes": 65535})
    b, _, params = A.load(spark, str(tmp_path / "db"))
    assert params == {"enzymes": 65535} and b.count() == a.count()
    assert A.validate(b, c).agg({"n_bad": "sum"}).head()[0] == 0


def test_tag_table(spark, sf, tmp_path):
    c = X.contigs(spark, sf).where("genome_id = 0")
    s = D.sites(c)
    tgt.to_text(s, c, "g").coalesce(1).write.text(str(tmp_path / "t"))
    back = tgt.read_text(spark, str(tmp_path / "t"))
    assert {(r.position, r.enzyme_idx, r.tag) for r in back.collect()} == {(r.position, r.enzyme_idx, r.tag) for r in s.collect()}


def test_small_tables(spark, tmp_path):
    (tmp_path / "tax").write_text("# c\ng1\tA\n\ng1\tB \ng2\tC\n")
    assert {r.genome: r.taxonomy for r in tables.read_taxonomy(spark, str(tmp_path / "tax")).collect()} == {"g1": "B", "g2": "C"}
    (tmp_path / "ori").write_text("g1\t100\ng2\t5\t0.5\tlab\n")
    got = {r.genome: (r.ori, r.ori_confidence, r.ori_source) for r in tables.read_origins(spark, str(tmp_path / "ori")).collect()}
    assert got == {"g1": (100, 1.0, "annotation"), "g2": (5, 0.5, "lab")}
    (tmp_path / "m.json").write_text(json.dumps({"format_version": 1, "params": {"enzymes": 3}, "genomes": [{"id": 0, "name": "g1"}]}))
    assert tables.read_manifest(spark, str(tmp_path / "m.json")).head().enzymes == ["BcgI", "AlfI"]
    out = spark.createDataFrame([("s", "g", 1.5, None)], "sample string, genome string, `log2(PTR)` double, se double")
    tables.write_output(out, str(tmp_path / "out"))
    back = tables.read_outputs(spark, [str(tmp_path / "out")]).head()
    assert back.log2_ptr == 1.5 and back.se is None


def test_streamed_counts_equal_batch(spark, sf, tmp_path):
    from tagforge.operators.match import exact_hits, read_windows
    from tagforge.streaming import counts as C

    reads, s = X.reads(spark, sf), D.sites(X.contigs(spark, sf))
    reads.select("sample", "read_id", "seq").repartition(3).write.parquet(str(tmp_path / "in"))
    s.write.parquet(str(tmp_path / "sites"))
    s = spark.read.parquet(str(tmp_path / "sites"))
    state = {}

    def sink(batch, _):
        for r in batch.collect():
            state[r.sample, r.genome_id, r.contig_id, r.position, r.enzyme_idx] = r["count"]

    C.start(C.stream_counts(C.read_stream(spark, str(tmp_path / "in"), 1), s), sink, str(tmp_path / "ck")).awaitTermination()
    want = exact_hits(read_windows(reads), s).groupBy("sample", "genome_id", "contig_id", "position", "enzyme_idx").count().collect()
    assert state == {tuple(r)[:5]: r["count"] for r in want}


def test_tag_table_keeps_strand_flags_and_gc(spark, sf, tmp_path):
    c = X.contigs(spark, sf).where("genome_id = 0")
    a = A.assemble(c, D.sites(c, flank=250))
    tgt.to_text(a, c, "g").coalesce(1).write.text(str(tmp_path / "t"))
    back = {(r.contig_id, r.position, r.enzyme_idx): (r.strand, r.flags, r.local_gc) for r in tgt.read_text(spark, str(tmp_path / "t")).collect()}
    assert back == {(r.contig_id, r.position, r.enzyme_idx): ("+" if r.pattern == 0 else "-", r.flags, r.local_gc) for r in a.collect()}
    assert len({v[0] for v in back.values()}) == 2 and len({v[2] for v in back.values()}) > 5
    tgt.write_all(a, c, str(tmp_path / "all"))
    got = tgt.read_all(spark, str(tmp_path / "all"))
    assert {(r["contig_id"], r["position"], r["enzyme_idx"], r["tag"], r["flags"], r["local_gc"]) for r in got.collect()} == {(r.contig_id, r.position, r.enzyme_idx, r.tag, r.flags, r.local_gc) for r in a.collect()}
    assert tgt.keys_of_tags(["AACC"]) == tgt.keys_of_tags(["GGTT"]) != tgt.keys_of_tags(["AACG"])


def test_tag_files_one_a_genome_read_in_ranges(spark, sf, tmp_path):
    from tagforge.sources import tagfiles

    c = X.contigs(spark, sf).where("genome_id < 5")
    c = c.withColumn("genome", F.when(F.col("genome_id") == 1, "odd / name:é").otherwise(F.col("genome")))
    a = A.assemble(c, D.sites(c, flank=250))
    path = str(tmp_path / "all")
    for _ in range(2):  # writing again replaces
        tgt.write_all(a, c, path)
    assert len(list((tmp_path / "all").iterdir())) == 5 and all(f.suffix == ".tgt" for f in (tmp_path / "all").iterdir())
    fields = ["genome", "enzyme_idx", "pattern", "tag", "contig_id", "position", "gap", "flags", "local_gc"]
    want = sorted(map(tuple, D.gaps(a).join(c.select("genome_id", "genome").distinct(), "genome_id").select(fields).collect()))
    for split in (None, 7, 100):
        back = tgt.read_all(spark, path, split)
        assert back.columns == fields and sorted(map(tuple, back.collect())) == want
    assert tgt.read_all(spark, path, 7).rdd.getNumPartitions() > 20
    one = next(f for f in sorted((tmp_path / "all").iterdir()) if "odd" in f.name)
    with one.open("rb") as f:
        meta, before, rows = tagfiles.head_of(f)
    assert meta["genome"] == "odd / name:é" and [x["contig_id"] for x in meta["contigs"]] == [0, 1] and one.stat().st_size == before + 48 * rows
    alone = tgt.read_all(spark, str(one)).select("enzyme_idx", "contig_id", "position").collect()
    assert alone == sorted(alone) and len(alone) == rows
    one.write_bytes(one.read_bytes()[:-5])
    with pytest.raises(Exception, match="another number of records"):
        tgt.read_all(spark, path).count()
    (tmp_path / "bad.tgt").write_bytes(b"nope" + bytes(20))
    with pytest.raises(Exception, match="no tag table"):
        tgt.read_all(spark, str(tmp_path / "bad.tgt")).count()


def test_report_pages_hold_every_row(spark):
    from tagforge.operators import report

    lines = [r.value for r in report.html_lines(spark.range(12_000).selectExpr("id AS genome_id", "'a<b' AS name"), "Title", ["genome_id"]).collect()]
    assert len(lines) == 12_002 and lines[0].startswith("<!DOCTYPE") and lines[-1] == "</table>" and lines[7] == "<tr><td>6</td><td>a&lt;b</td></tr>"


def block_gzip(data: bytes, size: int) -> bytes:
    """The data in BGZF blocks of ``size`` bytes, with an empty block in the middle and one at the end."""
    def block(part):
        squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = squeeze.compress(part) + squeeze.flush()
        return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))

    parts = [data[i : i + size] for i in range(0, len(data), size)]
    parts.insert(len(parts) // 2, b"")
    return b"".join(map(block, [*parts, b""]))


# Names and qualities that start with the marks of records, empty sequences and blank lines between records.
READS = "".join(f"@r{i} x\n{'ACGT' * (i % 5)}\n+@{i}\n{'@+>I' * (i % 5)}\n" + "\n" * (i % 11 == 3) for i in range(60)).encode()
CONTIGS = b"".join(b">c%d @x\nACGT\n+\n@AC\n" % i for i in range(40)).replace(b"+\n@AC\n", b"AC\n\nGT\n")


def of_ranges(path, cuts):
    from tagforge.sources import splits

    kind = splits.kind_of(path)
    lines = splits.lines_of(path, kind)
    make = splits.fastq_records if splits.first_mark(lines) == b"@" else splits.fasta_records
    edges = [0, *cuts]
    return [r for s, e in zip(edges, [*cuts, None], strict=True) for r in make(splits.lines_of(path, kind, s, e), s == 0)]


@pytest.mark.parametrize("data", [READS, READS.replace(b"\n", b"\r\n"), CONTIGS, READS.rstrip(b"\n")])
def test_ranges_cut_anywhere_give_the_same_records(tmp_path, data):
    (tmp_path / "plain").write_bytes(data)
    (tmp_path / "blocks").write_bytes(block_gzip(data, 97))
    whole = of_ranges(str(tmp_path / "plain"), [])
    assert len(whole) in (60, 40) and whole[7][1] in ("r7", "c7")
    for cut in range(1, len(data)):
        assert of_ranges(str(tmp_path / "plain"), [cut]) == whole, cut
    assert of_ranges(str(tmp_path / "plain"), list(range(3, len(data), 3))) == whole
    blocks = of_ranges(str(tmp_path / "blocks"), [])
    assert [r[1:] for r in blocks] == [r[1:] for r in whole] and len({r[0] for r in blocks}) == len(whole)
    size = (tmp_path / "blocks").stat().st_size
    for cut in range(1, size):
        assert of_ranges(str(tmp_path / "blocks"), [cut]) == blocks, cut
    assert of_ranges(str(tmp_path / "blocks"), list(range(40, size, 40))) == blocks


@pytest.mark.parametrize("tail", [b"@t\n", b"@t\nACGT\n", b"@t\nACGT\n+\n", b"@t\nACGT\n+\nII\n", b"ACGT\n"])
def test_truncated_records_raise_at_every_cut(tmp_path, tail):
    data = b"@a\nAC\n+\nII\n@b\nACG\n+\n@II\n" + tail
    (tmp_path / "x").write_bytes(data)
    for cut in [None, *range(1, len(data))]:
        with pytest.raises(ValueError, match="truncated"):
            of_ranges(str(tmp_path / "x"), [cut] if cut else [])


def test_read_files_in_ranges(spark, tmp_path):
    """A plain file, one of blocks and one of gzip, cut into many tasks."""
    text = "".join(f"@r{i}\n{'ACGT' * (i % 40)}\n+\n{'I' * (4 * (i % 40))}\n" for i in range(3000))
    (tmp_path / "x.fastq").write_text(text)
    with gzip.open(tmp_path / "y.fastq.gz", "wt") as f:
        f.write(text)
    (tmp_path / "w.fastq.gz").write_bytes(block_gzip(text.encode(), 5000))
    (tmp_path / "z.fasta").write_text("".join(f">r{i} note\nAC\nGT\n" for i in range(500)))
    whole, cut = fasta.read_reads(spark, [str(tmp_path)]), fasta.read_reads(spark, [str(tmp_path)], split_bytes=20_000)
    assert whole.rdd.getNumPartitions() == 4 and cut.rdd.getNumPartitions() > 20
    rows = sorted(map(tuple, cut.collect()))
    assert rows == sorted(map(tuple, whole.collect())) and len({r[1:3] for r in rows}) == 9500
    assert {s: sum(r[0] == s for r in rows) for s in "xywz"} == {"x": 3000, "y": 3000, "w": 3000, "z": 500}
    (tmp_path / "bad.fastq").write_text("xyz")
    with pytest.raises(Exception, match="neither"):
        fasta.read_reads(spark, [str(tmp_path / "bad.fastq")]).count()
    (tmp_path / "none.fastq").write_text("\n")
    assert fasta.read_reads(spark, [str(tmp_path / "none.fastq")]).count() == 0
