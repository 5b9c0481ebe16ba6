"""Binary tag tables as a Spark data source: one file a genome, read in ranges of fixed-width records.

A writing task gets whole genomes in file order and writes each as a staged file (:mod:`tagforge.sources.staged`), so a task that is lost or repeated leaves nothing.  A file's head holds the genome's name and contigs.
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tagforge.sources.splits import located
from tagforge.sources.staged import StagedWriter, Written
from tagforge.sources.tgt import MAGIC, RECORD, VERSION, keys_of_tags

SPLIT_RECORDS = 1 << 20
BATCH_RECORDS = 1 << 16
#: The fields of a record, little-endian.
LAYOUT = np.dtype([("position", "<u8"), ("key", "<u8"), ("gap", "<u4"), ("contig_id", "<u2"), ("enzyme_idx", "u1"), ("pattern", "u1"), ("length", "u1"), ("spare", "u1"), ("flags", "u1"), ("local_gc", "u1"), ("bases", "u1", 12), ("rest", "V8")])
COLUMNS = ("genome", "enzyme_idx", "pattern", "tag", "contig_id", "position", "gap", "flags", "local_gc")
SCHEMA = "genome string, enzyme_idx int, pattern int, tag string, contig_id int, position bigint, gap bigint, flags int, local_gc int"
LETTERS = np.frombuffer(b"ACGT", np.uint8)


def packed(tags: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two bits a base, the first base highest, in 12 bytes a tag; and the tags' lengths."""
    sizes = np.array([len(t) for t in tags], np.int64)
    grid = np.frombuffer("".join(t.ljust(48, "A") for t in tags).encode(), np.uint8).reshape(-1, 12, 4)
    code = np.searchsorted(LETTERS, grid).astype(np.uint8)
    return code[:, :, 0] << 6 | code[:, :, 1] << 4 | code[:, :, 2] << 2 | code[:, :, 3], sizes


def unpacked(bases: np.ndarray, sizes: np.ndarray):
    """The tags as an Arrow string array."""
    import pyarrow as pa

    grid = LETTERS[(bases[:, :, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3].reshape(len(bases), 48)
    text = grid[np.arange(48) < sizes[:, None]]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(bases), pa.py_buffer(offsets.tobytes()), pa.py_buffer(text.tobytes()))


def head_of(stream) -> tuple[dict, int, int]:
    """(genome and contigs, bytes before the records, records) of an open file."""
    fixed = stream.read(16)
    if fixed[:4] != MAGIC or len(fixed) < 16:
        raise ValueError("no tag table")
    version, n, rows = struct.unpack_from("<III", fixed, 4)
    if version != VERSION:
        raise ValueError(f"version {version} isn't supported")
    return json.loads(stream.read(n)), 16 + n, rows


@dataclass
class Records(InputPartition):
    path: str
    genome: str
    start: int
    count: int


class TagReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitrecords") or SPLIT_RECORDS)

    def partitions(self) -> list[Records]:
        from pyarrow import fs

        system, inner = located(self.path)
        info = system.get_file_info(inner)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(inner)) if f.path.endswith(".tgt")]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            with system.open_input_stream(f.path) as stream:
                meta, before, rows = head_of(stream)
            if f.size != before + rows * RECORD:
                raise ValueError(f"{f.path} holds another number of records than its head says")
            out += [Records(f.path, meta["genome"], before + k * RECORD, min(self.split, rows - k)) for k in range(0, rows, self.split)]
        return out or [Records("", "", 0, 0)]

    def read(self, partition: Records):
        import pyarrow as pa

        if not partition.count:
            return
        system, _ = located(self.path)
        with system.open_input_file(partition.path) as stream:
            stream.seek(partition.start)
            for done in range(0, partition.count, BATCH_RECORDS):
                n = min(BATCH_RECORDS, partition.count - done)
                r = np.frombuffer(stream.read(n * RECORD), LAYOUT)
                whole = lambda name, kind: pa.array(r[name].astype(kind))  # noqa: B023, E731
                columns = [pa.array([partition.genome] * n), whole("enzyme_idx", np.int32), whole("pattern", np.int32), unpacked(r["bases"], r["length"].astype(np.int64)), whole("contig_id", np.int32), whole("position", np.int64), whole("gap", np.int64), whole("flags", np.int32), whole("local_gc", np.int32)]
                yield pa.RecordBatch.from_arrays(columns, names=list(COLUMNS))


class TagWriter(StagedWriter):
    """Takes (genome, meta, enzyme_idx, pattern, tag, contig_id, position, gap, flags, local_gc), genome by genome; a genome's first row holds its head as ``meta``."""

    suffix = ".tgt"

    def write(self, batches) -> Written:
        folder, files = self.attempt(), []
        genome, meta, parts, seen = None, "", [], set()

        def finish():
            if genome is not None:
                text = meta.encode()
                head = MAGIC + struct.pack("<III", VERSION, len(text), sum(map(len, parts)) // RECORD) + text
                files.append(self.put(folder, quote(genome, safe="") + ".tgt", [head, *parts]))

        for batch in batches:
            names = batch.column("genome").to_pylist()
            start = 0
            while start < len(names):
                stop = start
                while stop < len(names) and names[stop] == names[start]:
                    stop += 1
                part = batch.slice(start, stop - start)
                if names[start] != genome:
                    finish()
                    genome, meta, parts = names[start], part.column("meta")[0].as_py(), []
                    if genome in seen or meta is None:
                        raise ValueError("rows must come genome by genome, each with its head first")
                    seen.add(genome)
                    part = part.slice(1)
                if part.num_rows:
                    parts.append(self._records(part))
                start = stop
        finish()
        return Written(files)

    @staticmethod
    def _records(part) -> bytes:
        tags = part.column("tag").to_pylist()
        r = np.zeros(len(tags), LAYOUT)
        for name in ("position", "gap", "contig_id", "enzyme_idx", "pattern", "flags", "local_gc"):
            r[name] = part.column(name).to_numpy(zero_copy_only=False)
        r["bases"], r["length"] = packed(tags)
        r["key"] = keys_of_tags(tags)
        return r.tobytes()


class TagFiles(DataSource):
    """``format("tagforge_tags")`` with the option ``path`` (a file or a folder of ``.tgt`` files), and for reading ``splitRecords``."""

    @classmethod
    def name(cls) -> str:
        return "tagforge_tags"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TagReader:
        return TagReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> TagWriter:
        return TagWriter(self.options["path"], overwrite)
