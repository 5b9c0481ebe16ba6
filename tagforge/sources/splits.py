"""FASTA and FASTQ files as a Spark data source whose partitions are byte ranges.

Plain files are cut at any byte and BGZF files at any compressed byte; other gzip files are one partition.  A partition drops its
first line, whole or not, unless it starts the file, finds the next record by its marks, and yields every record whose header
starts at or before its end, so that each record belongs to one partition wherever the cuts fall.  A record's number is the place of its header: the byte
in the text, or in a BGZF file the block's place times 65,536 plus the byte in the block.  It doesn't depend on the cuts.

A header line of FASTQ is one that starts with ``@`` and has ``+`` at the start of the second line after it: a quality line may start with ``@``,
but the second line after it is a sequence.  The partition with the last record before a cut also looks at what follows, so a truncated last record raises wherever the cuts fall.
"""

from __future__ import annotations

import gzip
import io
import json
import os
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a partition, as they lie in the file.
SPLIT_BYTES = 64 << 20
#: Bases that a batch of rows holds.
BATCH_BASES = 1 << 24
#: A BGZF block is smaller.
MOST_BLOCK = 1 << 16
FASTQ, FASTA = b"@", b">"


def located(path: str):
    """(file system, path in it) of any path that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else os.path.abspath(path))


class Text:
    """Lines of a text from a byte on, with the place of the next line."""

    def __init__(self, raw: io.BufferedIOBase, start: int = 0, end: int | None = None):
        self.raw, self.place, self.end = raw, start, end

    def readline(self) -> bytes:
        line = self.raw.readline()
        self.place += len(line)
        return line

    def mark(self) -> int:
        return self.place

    def passed(self) -> bool:
        """The next line starts beyond the range."""
        return self.end is not None and self.place > self.end

    def close(self) -> None:
        self.raw.close()


class Blocks:
    """Lines of a BGZF file from the first block at or after a byte of it."""

    def __init__(self, raw, size: int, start: int = 0, end: int | None = None):
        self.raw, self.size, self.end = raw, size, end
        self.next = 0 if not start else self._block_from(start)
        self.at, self.block, self.off, self.before, self.limit = self.next, b"", 0, 0, None

    def _length(self, head: bytes) -> int:
        """Bytes of the block that starts with ``head``, 0 if none does."""
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            return 0
        extra = head[12 : 12 + int.from_bytes(head[10:12], "little")]
        while len(extra) >= 6:
            n = int.from_bytes(extra[2:4], "little")
            if extra[:2] == b"BC" and n == 2:
                return int.from_bytes(extra[4:6], "little") + 1
            extra = extra[4 + n :]
        return 0

    def _at(self, place: int, n: int) -> bytes:
        self.raw.seek(place)
        return self.raw.read(n)

    def _block_from(self, start: int) -> int:
        """The first place from ``start`` on where a block starts and is followed by another or by the end."""
        window = self._at(start, 2 * MOST_BLOCK)
        found = window.find(b"\x1f\x8b\x08\x04")
        while found >= 0:
            n = self._length(window[found : found + 512])
            after = start + found + n
            if n and (after == self.size or self._length(self._at(after, 512))):
                return start + found
            found = window.find(b"\x1f\x8b\x08\x04", found + 1)
        return self.size

    def _load(self) -> bool:
        """The next block that isn't empty; false at the end of the file."""
        while self.next < self.size:
            if self.end is not None and self.limit is None and self.next >= self.end:
                self.limit = self.before + len(self.block)
            data = self._at(self.next, MOST_BLOCK)
            n = self._length(data[:512])
            if not n or len(data) < n:
                raise ValueError("truncated or malformed BGZF block")
            self.before, self.at = self.before + len(self.block), self.next
            self.block, self.off = zlib.decompress(data[12 + int.from_bytes(data[10:12], "little") : n - 8], -15), 0
            self.next += n
            if self.block:
                return True
        return False

    def readline(self) -> bytes:
        parts = []
        while self.off < len(self.block) or self._load():
            found = self.block.find(b"\n", self.off)
            stop = len(self.block) if found < 0 else found + 1
            parts.append(self.block[self.off : stop])
            self.off = stop
            if found >= 0:
                break
        return b"".join(parts)

    def mark(self) -> int:
        if self.off == len(self.block):
            self._load()
        return self.at << 16 | self.off

    def passed(self) -> bool:
        self.mark()
        return self.limit is not None and self.before + self.off > self.limit

    def close(self) -> None:
        self.raw.close()


def kind_of(path: str) -> str:
    """``plain``, ``gzip`` or ``bgzf`` by the first bytes."""
    system, inner = located(path)
    with system.open_input_stream(inner, compression=None) as f:
        head = f.read(512)
    if head[:2] != b"\x1f\x8b":
        return "plain"
    return "bgzf" if Blocks(io.BytesIO(), 0)._length(head) else "gzip"


def lines_of(path: str, kind: str, start: int = 0, end: int | None = None) -> Text | Blocks:
    system, inner = located(path)
    if kind == "bgzf":
        return Blocks(system.open_input_file(inner), system.get_file_info(inner).size, start, end)
    if kind == "gzip":
        raw = system.open_input_stream(inner, compression=None, buffer_size=1 << 20)
        return Text(io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20))
    raw = system.open_input_file(inner)
    raw.seek(start)
    return Text(io.BufferedReader(raw, 1 << 20), start, end)


def first_mark(lines: Text | Blocks) -> bytes:
    """The first byte that isn't white space, empty if there is none."""
    line = lines.readline()
    while line and not line.strip():
        line = lines.readline()
    return line.strip()[:1]


class Held:
    """Lines with their places, of which some have been looked at already."""

    def __init__(self, lines):
        self.lines, self.ahead = lines, deque()

    def look(self, n: int) -> list[bytes]:
        """The next ``n`` lines, fewer at the end."""
        while len(self.ahead) < n:
            passed, place = self.lines.passed(), self.lines.mark()
            line = self.lines.readline()
            if not line:
                break
            self.ahead.append((line, place, passed))
        return [line for line, _, _ in list(self.ahead)[:n]]

    def take(self) -> tuple[bytes, int, bool]:
        return self.ahead.popleft() if self.look(1) else (b"", -1, True)

    def skip_blank(self) -> None:
        while (seen := self.look(1)) and not seen[0].strip():
            self.take()


def _name(line: bytes) -> str:
    return (line[1:].split() or [b""])[0].decode()


def _whole(head: bytes, seq: bytes, plus: bytes, quality: bytes) -> None:
    if not head.startswith(b"@") or not plus.startswith(b"+") or len(quality.strip()) != len(seq.strip()):
        raise ValueError("truncated or malformed FASTQ record")


def fastq_records(lines, first: bool) -> Iterator[tuple[int, str, str]]:
    """(place, name, sequence) of the records of a range."""
    held = Held(lines)
    if not first:
        held.take()
        skipped = 0
        while len(seen := held.look(3)) == 3 and not (seen[0].startswith(b"@") and seen[2].startswith(b"+")):
            skipped += bool(held.take()[0].strip())
            if skipped > 4:
                raise ValueError("malformed FASTQ record")
        if len(seen) < 3:
            return
    while True:
        held.skip_blank()
        if not held.look(1):
            return
        if held.ahead[0][2]:
            # The next range has what follows; what is too short for its first lines is looked at here.
            rest = held.look(4)
            if len(rest) < 4:
                _whole(*[*rest, b"", b"", b""][:4])
            return
        head, place, _ = held.take()
        seq, plus, quality = held.take()[0], held.take()[0], held.take()[0]
        _whole(head, seq, plus, quality)
        yield place, _name(head), seq.strip().decode()


def fasta_records(lines, first: bool) -> Iterator[tuple[int, str, str]]:
    """(place, name, sequence) of the records of a range; a sequence may run beyond it."""
    if not first:
        lines.readline()
    head, place, mine, parts = b"", 0, False, []
    while True:
        passed, here = lines.passed(), lines.mark()
        line = lines.readline()
        if not line or line.startswith(b">"):
            if mine:
                yield place, _name(head), b"".join(parts).decode()
            if not line or passed:
                return
            head, place, mine, parts = line, here, True, []
        elif mine:
            parts += line.split()
        elif first and line.strip():
            raise ValueError("text before the first record")
        elif passed and not first:
            return


@dataclass
class Range(InputPartition):
    path: str
    kind: str
    mark: bytes
    start: int
    end: int | None


class ReadRanges(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.split = int(options.get("splitbytes") or SPLIT_BYTES)

    def partitions(self) -> list[Range]:
        out = []
        for path, size in self.files:
            kind = kind_of(path)
            lines = lines_of(path, kind)
            mark = first_mark(lines)
            lines.close()
            if not mark:
                continue
            if mark not in (FASTQ, FASTA):
                raise ValueError(f"{path} is neither FASTA nor FASTQ")
            cuts = [0] if kind == "gzip" else list(range(0, max(size, 1), self.split))
            out += [Range(path, kind, mark, s, e) for s, e in zip(cuts, [*cuts[1:], None], strict=True)]
        return out or [Range("", "plain", b"", 0, None)]

    def read(self, partition: Range):
        import pyarrow as pa

        if not partition.path:
            return

        def batch(rows):
            places, names, seqs = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows)), pa.array(places, pa.int64()), pa.array(names), pa.array(seqs)], names=["file", "number", "name", "seq"])

        lines = lines_of(partition.path, partition.kind, partition.start, partition.end)
        rows, bases = [], 0
        for row in (fastq_records if partition.mark == FASTQ else fasta_records)(lines, partition.start == 0):
            rows.append(row)
            bases += len(row[2])
            if bases > BATCH_BASES or len(rows) >= 1 << 16:
                yield batch(rows)
                rows, bases = [], 0
        if rows:
            yield batch(rows)
        lines.close()


class ReadSource(DataSource):
    """``spark.read.format("tagforge_reads")`` with options ``files`` (JSON pairs of path and size) and ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "tagforge_reads"

    def schema(self) -> str:
        return "file string, number bigint, name string, seq string"

    def reader(self, schema) -> ReadRanges:
        return ReadRanges({k.lower(): v for k, v in self.options.items()})
