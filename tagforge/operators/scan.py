"""Arrow batch scans of sequences: recognition motifs and sketch k-mers, for many sequences laid end to end at once.

A batch's sequences become one byte array.  Every base is a bit set (A 1, C 2, G 4, T 8, anything else 0), so that a motif
base is one comparison of a shifted array for all positions, and a pattern the conjunction of its motif bases.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tagforge.panel import IUPAC, LONGEST, Enzyme
from tagforge.session import ship

#: Bases that one pass over arrays holds; longer sequences are cut with an overlap.
PIECE = 1 << 20
BIT = {"A": 1, "C": 2, "G": 4, "T": 8}
_SETS = np.zeros(256, np.uint8)
_OTHER = np.arange(256, dtype=np.uint8)
_DIGIT = np.zeros(256, np.uint64)
for _i, (_base, _pair) in enumerate(zip("ACGT", "TGCA", strict=True)):
    _SETS[ord(_base)], _OTHER[ord(_base)], _DIGIT[ord(_base)] = BIT[_base], ord(_pair), _i


def dealt(seqs: DataFrame, partitions: int | None = None) -> DataFrame:
    """seqs over ``partitions``, by default over the session's parallelism where it comes from fewer files, since a file may be one task."""
    wanted = partitions or seqs.sparkSession.sparkContext.defaultParallelism
    return seqs.repartition(wanted) if partitions or len(seqs.inputFiles()) < wanted else seqs


def motif_starts(sets: np.ndarray, left: np.ndarray, enzymes: tuple[Enzyme, ...]) -> Iterator[tuple[Enzyme, int, np.ndarray]]:
    """(enzyme, pattern, true where a window of its length starts) over bit sets; ``left`` counts the bases to the end of each sequence."""
    held: dict[int, np.ndarray] = {}

    def among(code: str) -> np.ndarray:
        wanted = sum(BIT[b] for b in IUPAC[code])
        if wanted not in held:
            held[wanted] = (sets & np.uint8(wanted)) > 0
        return held[wanted]

    for e in enzymes:
        for number, pattern in enumerate(e.patterns):
            hit = left >= e.length
            for offset, motif in pattern:
                for k, code in enumerate(motif, offset):
                    if k < len(sets):
                        hit[: len(sets) - k] &= among(code)[k:]
            yield e, number, hit


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)))


def _left(ends: np.ndarray) -> np.ndarray:
    return np.repeat(ends[1:], np.diff(ends)) - np.arange(ends[-1])


def _strings(raw: np.ndarray) -> pa.Array:
    """One string per row of a byte matrix."""
    n, width = raw.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * width, max(width, 1), dtype=np.int32)[: n + 1]), pa.py_buffer(np.ascontiguousarray(raw)))


def least_strand(raw: np.ndarray) -> np.ndarray:
    """The lesser of each row and its reverse complement."""
    turned = np.ascontiguousarray(_OTHER[raw][:, ::-1])
    width = raw.shape[1]
    first = np.ascontiguousarray(raw).view(f"S{width}")[:, 0] <= turned.view(f"S{width}")[:, 0]
    return np.where(first[:, None], raw, turned)


def _parts(column, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes end to end, lengths) of consecutive rows of together about ``size`` bytes."""
    held, start, total = [], 0, 0
    for i, s in enumerate(column.to_pylist()):
        held.append((s or "").encode())
        total += len(held[-1])
        if total >= size or len(held) >= 65536:
            yield start, np.frombuffer(b"".join(held), np.uint8), np.array([len(x) for x in held])
            held, start, total = [], i + 1, 0
    if held:
        yield start, np.frombuffer(b"".join(held), np.uint8), np.array([len(x) for x in held])


def _read_rows(enzymes, n, names, batches):
    for batch in batches:
        for first, raw, lengths in _parts(batch.column(n), PIECE):
            if not len(raw):
                continue
            sets, ends = _SETS[raw], _ends(lengths)
            left = _left(ends)
            bad = _ends(sets == 0)
            found: dict[int, np.ndarray] = {}
            for e, _, hit in motif_starts(sets, left, enzymes):
                found[e.length] = found[e.length] | hit if e.length in found else hit
            for length, hit in found.items():
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                q = raw[at[:, None] + np.arange(length)]
                row = np.searchsorted(ends, at, side="right") - 1
                taken = pa.array(first + row, pa.int64())
                columns = [c.take(taken) for c in batch.columns[:n]]
                columns += [pa.array(at - ends[row], pa.int32()), pa.array(np.full(len(at), length), pa.int32()), _strings(q), pa.array(bad[at + length] > bad[at]), _strings(least_strand(q))]
                yield pa.RecordBatch.from_arrays(columns, names=names)


def read_windows(reads: DataFrame, enzymes: tuple[Enzyme, ...], keys: list[str]) -> DataFrame:
    """keys, start, tag_len, q, ambiguous, canon: see :func:`tagforge.operators.match.read_windows`."""
    ship(reads.sparkSession)
    source = reads.select(*keys, "seq")
    fields = [T.StructField("start", T.IntegerType()), T.StructField("tag_len", T.IntegerType()), T.StructField("q", T.StringType()), T.StructField("ambiguous", T.BooleanType()), T.StructField("canon", T.StringType())]
    schema = T.StructType([*source.schema.fields[:-1], *fields])
    return source.mapInArrow(partial(_read_rows, enzymes, len(keys), schema.names), schema)


def _site_rows(enzymes, n, flank, names, batches):
    for batch in batches:
        for i, s in enumerate(batch.column(n)):
            whole = np.frombuffer(s.as_buffer() or b"", np.uint8)
            for start in range(0, len(whole), PIECE):
                a, b = max(0, start - flank), min(len(whole), start + PIECE + max(flank, LONGEST - 1))
                raw = whole[a:b]
                sets = _SETS[raw]
                left = np.arange(len(raw), 0, -1)
                bad, gc, sure = _ends(sets == 0), _ends((sets & 6) > 0), _ends(sets > 0)
                own = slice(start - a, min(start + PIECE, len(whole)) - a)
                taken: dict[int, np.ndarray] = {}
                for e, number, hit in motif_starts(sets, left, enzymes):
                    before = taken.get(e.idx)
                    at = np.flatnonzero((hit if before is None else hit & ~before)[own]) + own.start
                    taken[e.idx] = hit if before is None else hit | before
                    at = at[bad[at + e.length] == bad[at]]
                    if not len(at):
                        continue
                    lo, hi = np.maximum(at + a - flank, 0) - a, np.minimum(at + flank, len(raw))
                    known = sure[hi] - sure[lo]
                    share = np.where(known > 0, np.floor((gc[hi] - gc[lo]) / np.maximum(known, 1) * 200 + 0.5), 255)
                    keys = [c.take(pa.array(np.full(len(at), i), pa.int64())) for c in batch.columns[:n]]
                    columns = [*keys, pa.array(at + a, pa.int64()), pa.array(np.full(len(at), e.idx), pa.int32()), pa.array(np.full(len(at), number), pa.int32()), _strings(raw[at[:, None] + np.arange(e.length)])]
                    columns += [pa.array(share.astype(np.int32))] if "local_gc" in names else []
                    yield pa.RecordBatch.from_arrays(columns, names=names)


def sites(contigs: DataFrame, keys: list[str], enzymes: tuple[Enzyme, ...], flank: int | None = None) -> DataFrame:
    """keys, position, enzyme_idx, pattern, tag (and local_gc around it with ``flank``): one row per window and enzyme, credited to its first matching pattern."""
    ship(contigs.sparkSession)
    source = contigs.select(*keys, "seq")
    fields = [T.StructField("position", T.LongType()), T.StructField("enzyme_idx", T.IntegerType()), T.StructField("pattern", T.IntegerType()), T.StructField("tag", T.StringType())]
    fields += [T.StructField("local_gc", T.IntegerType())] if flank is not None else []
    schema = T.StructType([*source.schema.fields[:-1], *fields])
    return source.mapInArrow(partial(_site_rows, enzymes, len(keys), flank or 0, schema.names), schema)


#: Odd multipliers of the k-mer hash.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def kmer_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """The hash of the canonical k-mer at every start but the last k - 1: base-16 digits of its two halves times MIX, xor-shifted and mixed once more."""
    n, cut = len(raw) - k + 1, k // 2
    digit = _DIGIT[raw]
    other = np.uint64(3) - digit

    def number(digits: np.ndarray, places) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        for p in places:
            out = out * np.uint64(16) + digits[p : p + n]
        return out

    hi, lo = number(digit, range(cut)), number(digit, range(cut, k))
    rhi, rlo = number(other, range(k - 1, k - 1 - cut, -1)), number(other, range(k - 1 - cut, -1, -1))
    forward = (hi < rhi) | ((hi == rhi) & (lo <= rlo))
    h = np.where(forward, hi, rhi) * np.uint64(MIX[0]) + np.where(forward, lo, rlo) * np.uint64(MIX[1])
    return (h ^ (h >> np.uint64(32))) * np.uint64(MIX[2])


def _kmer_rows(k, limit, n, names, batches):
    for batch in batches:
        for first, raw, lengths in _parts(batch.column(n), PIECE):
            ends = _ends(lengths)
            for start in range(0, len(raw), PIECE):
                piece = raw[start : start + PIECE + k - 1]
                if len(piece) < k:
                    continue
                h = kmer_hashes(piece, k)
                bad = _ends(_SETS[piece] == 0)
                at = np.flatnonzero((h < np.uint64(limit)) & (bad[k:] == bad[:-k])[: len(h)])
                row = np.searchsorted(ends, at + start, side="right") - 1
                inside = ends[row + 1] - (at + start) >= k
                at, row = at[inside], row[inside]
                pairs = np.unique(np.stack([row, h[at].view(np.int64)], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
                keys = [c.take(pa.array(first + pairs[:, 0], pa.int64())) for c in batch.columns[:n]]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(pairs[:, 1], pa.int64())], names=names)


def kmers(seqs: DataFrame, keys: list[str], k: int, scale: int) -> DataFrame:
    """keys, kmer: hashes of the canonical k-mers of certain bases below 1/scale of the range; repeats inside a piece of a sequence once."""
    ship(seqs.sparkSession)
    source = seqs.select(*keys, "seq")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("kmer", T.LongType())])
    return source.mapInArrow(partial(_kmer_rows, k, (1 << 64) // scale, len(keys), schema.names), schema)
