"""The enzyme panel and the regular expressions that its recognition patterns give."""

from __future__ import annotations

from dataclasses import dataclass

# Index order, tag length, and patterns as (offset, motif) pairs of each enzyme.
PANEL = (
    ("BcgI", 32, (((10, "CGA"), (19, "TGC")), ((10, "GCA"), (19, "TCG")))),
    ("AlfI", 32, (((10, "GCA"), (19, "TGC")),)),
    ("AloI", 27, (((7, "GAAC"), (17, "TCC")), ((7, "GGA"), (16, "GTTC")))),
    ("BaeI", 28, (((10, "AC"), (16, "GTAYC")), ((7, "GRTAC"), (16, "GT")))),
    ("BplI", 27, (((8, "GAG"), (16, "CTC")),)),
    ("BsaXI", 27, (((9, "AC"), (16, "CTCC")), ((7, "GGAG"), (16, "GT")))),
    ("BslFI", 25, (((6, "GGGAC"),), ((14, "GTCCC"),))),
    ("Bsp24I", 27, (((8, "GAC"), (17, "TGG")), ((7, "CCA"), (16, "GTC")))),
    ("CjeI", 28, (((8, "CCA"), (17, "GT")), ((9, "AC"), (17, "TGG")))),
    ("CjePI", 27, (((7, "CCA"), (17, "TC")), ((8, "GA"), (17, "TGG")))),
    ("CspCI", 33, (((11, "CAA"), (19, "GTGG")), ((10, "CCAC"), (19, "TTG")))),
    ("FalI", 27, (((8, "AAG"), (16, "CTT")),)),
    ("HaeIV", 27, (((7, "GAY"), (15, "RTC")), ((9, "GAY"), (17, "RTC")))),
    ("Hin4I", 27, (((8, "GAY"), (16, "VTC")), ((8, "GAB"), (16, "RTC")))),
    ("PpiI", 27, (((7, "GAAC"), (16, "CTC")), ((8, "GAG"), (16, "GTTC")))),
    ("PsrI", 27, (((7, "GAAC"), (17, "TAC")), ((7, "GTA"), (16, "GTTC")))),
)
# The IUPAC nucleotide codes as sets of bases.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
# Enzymes whose windows another enzyme's contain.
CONTAINED = (("Bsp24I", "CjePI", True), ("Bsp24I", "CjeI", False))


@dataclass(frozen=True)
class Enzyme:
    idx: int
    name: str
    length: int
    patterns: tuple[tuple[tuple[int, str], ...], ...]

    def window_regex(self, pattern: int) -> str:
        """Matches at the start of a window; every base must be A, C, G or T."""
        out, at = "", 0
        for offset, motif in self.patterns[pattern]:
            out += f"[ACGT]{{{offset - at}}}" if offset > at else ""
            out += "".join(m if len(IUPAC[m]) == 1 else f"[{IUPAC[m]}]" for m in motif)
            at = offset + len(motif)
        return "^" + out + (f"[ACGT]{{{self.length - at}}}" if self.length > at else "")

    def loose_regex(self, pattern: int) -> str:
        """As :meth:`window_regex`, but any base code may stand in the free positions."""
        return self.window_regex(pattern).replace("[ACGT]{", ".{")


ENZYMES = tuple(Enzyme(i, *row) for i, row in enumerate(PANEL))
BY_NAME = {e.name.lower(): e for e in ENZYMES}
#: Tag lengths in the order in which the panel first has them.
LENGTHS = tuple(dict.fromkeys(e.length for e in ENZYMES))
LONGEST = max(LENGTHS)


def selection(spec: str) -> tuple[Enzyme, ...]:
    """Enzymes of a comma-separated list, any case, or of ``all``, in panel order."""
    if spec.strip().lower() == "all":
        return ENZYMES
    names = [n.strip().lower() for n in spec.split(",") if n.strip()]
    unknown = [n for n in names if n not in BY_NAME]
    if unknown or not names:
        raise ValueError(f"unknown or no enzyme in {spec!r}")
    return tuple(sorted({BY_NAME[n] for n in names}, key=lambda e: e.idx))


def bitset(enzymes) -> int:
    return sum(1 << e.idx for e in enzymes)
