"""Sequence functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODES, COMPLEMENTS = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def revcomp(s: Column | str) -> Column:
    """Reverse complement; degenerate codes stay degenerate."""
    return F.reverse(F.translate(col(s), CODES, COMPLEMENTS))


def normalize(s: Column | str) -> Column:
    """Upper case, U to T, anything but A, C, G, T to N."""
    return F.regexp_replace(F.translate(col(s), "acgtuU", "ACGTTT"), "[^ACGT]", "N")


def is_palindromic(s: Column | str) -> Column:
    return F.upper(col(s)) == revcomp(F.upper(col(s)))


def canonical(s: Column | str) -> Column:
    """The lesser of a tag and its reverse complement: one key for both strands, without hash collisions."""
    return F.least(col(s), revcomp(s))


def gc_fraction(s: Column | str) -> Column:
    """Share of G and C among the certain bases; null without any."""
    gc = F.length(F.regexp_replace(col(s), "[^GC]", ""))
    return gc / F.nullif(F.length(F.regexp_replace(col(s), "[^ACGT]", "")), F.lit(0))


def quantize_gc(gc: Column | str) -> Column:
    """Half-percent steps 0..200; 255 for undefined."""
    return F.coalesce(F.round(col(gc) * 200).cast("int"), F.lit(255))


def dequantize_gc(q: Column | str) -> Column:
    return F.when(col(q) != 255, col(q) / 200.0)


def _word(s: Column) -> Column:
    return F.coalesce(F.conv(F.translate(s, "ACGT", "0123"), 4, 10).cast("bigint"), F.lit(0).cast("bigint"))


def pack_words(s: Column | str) -> Column:
    """Up to 62 certain bases as an array of two bigints of 31 bases each, two bits a base."""
    c = col(s)
    return F.array(_word(F.substring(c, 1, 31)), _word(F.substring(c, 32, 31)))


def hamming_words(a: Column | str, b: Column | str) -> Column:
    """Number of differing bases of two :func:`pack_words` of equal length."""
    out = F.lit(0)
    for k in (0, 1):
        x = F.element_at(col(a), k + 1).bitwiseXOR(F.element_at(col(b), k + 1))
        out = out + F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x1555555555555555)))
    return out


def hamming(a: Column | str, b: Column | str) -> Column:
    """Number of differing positions of certain bases, up to 62 of them; null for unequal lengths."""
    return F.when(F.length(col(a)) == F.length(col(b)), hamming_words(pack_words(a), pack_words(b)))


def hamming_within(a: Column | str, b: Column | str, budget: int) -> Column:
    return F.when(hamming(a, b) <= budget, hamming(a, b))


def circular_distance(x: Column, ori: Column, length: Column) -> Column:
    """Shorter way round a circle; 0 for a circle without length."""
    ahead = F.pmod(x - ori, F.nullif(length, F.lit(0)))
    return F.coalesce(F.least(ahead, length - ahead), F.lit(0))


def classify_contig(name: Column | str) -> Column:
    low = F.lower(col(name))
    return F.when(low.contains("plasmid") | (low.startswith("p") & (F.length(low) <= 4)), "plasmid").otherwise("chromosome")


def sample_name(path: Column | str) -> Column:
    """File name without directories, read suffixes and compression or sequence extensions."""
    return F.regexp_replace(col(path), r"^.*/|(?:_R?[12])?(?:\.fna)?(?:\.fa)?(?:\.fasta)?(?:\.fq)?(?:\.fastq)?(?:\.gz)?$", "")


def seed_ranges(length: int, seeds: int) -> list[tuple[int, int]]:
    """(start, length) of contiguous seeds that cover a tag; the trailing ones take the remainder."""
    base, extra = divmod(length, seeds)
    sizes = [base + (i >= seeds - extra) for i in range(seeds)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def pack_2bit(s: Column | str) -> Column:
    """Bases as base-4 digits of a bigint, up to 32 of them (the top bit of the 32nd is the sign); null with another code in it."""
    c = col(s)
    high = F.coalesce(F.conv(F.translate(F.substring(c, F.lit(1), F.length(c) - 16), "ACGT", "0123"), 4, 10).cast("bigint"), F.lit(0).cast("bigint"))
    low = F.conv(F.translate(F.right(c, F.lit(16)), "ACGT", "0123"), 4, 10).cast("bigint")
    return F.when(c.rlike("^[ACGT]{1,32}$"), F.shiftleft(high, 32).bitwiseOR(low))


def iupac_matches(code: Column | str, base: Column | str) -> Column:
    """True if the code's set holds the certain base; false for an uncertain base or an unknown code."""
    b = F.upper(col(base))
    return b.isin("A", "C", "G", "T") & (iupac_mask(code).bitwiseAND(iupac_mask(b)) > 0)


def iupac_mask(code: Column | str) -> Column:
    """4-bit set of bases A=1, C=2, G=4, T=8; 0 for an unknown code."""
    from tagforge.panel import IUPAC

    bit = {"A": 1, "C": 2, "G": 4, "T": 8}
    table = F.create_map(*[F.lit(x) for k, v in IUPAC.items() for x in (k, sum(bit[b] for b in v))])
    return F.coalesce(F.element_at(table, F.upper(col(code))), F.lit(0))
