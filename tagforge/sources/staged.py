"""Files written by Spark tasks under names of their own, moved into place when the job commits."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tagforge.session import ship
from tagforge.sources.splits import located


@dataclass
class Written(WriterCommitMessage):
    files: list


class StagedWriter(DataSourceArrowWriter):
    """Every task writes below a folder of its own attempt in the target; files of committed tasks are moved, all else goes.

    With ``overwrite`` files of the same suffix that were there before go first.
    """

    suffix = ""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.moving = path, overwrite, f"_moving-{uuid.uuid4().hex}"

    def attempt(self) -> str:
        return f"{located(self.path)[1]}/{self.moving}/{uuid.uuid4().hex}"

    def put(self, folder: str, name: str, parts: list[bytes]) -> tuple[str, str]:
        """Writes a file into an attempt's folder; (place, name)."""
        system, _ = located(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/{name}") as out:
            for part in parts:
                out.write(part)
        return f"{folder}/{name}", name

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, inner = located(self.path)
        system.create_dir(inner, recursive=True)
        for f in system.get_file_info(fs.FileSelector(inner)) if self.overwrite else []:
            if f.type == fs.FileType.File and f.path.endswith(self.suffix):
                system.delete_file(f.path)
        for message in messages:
            for place, name in message.files if message else []:
                system.move(place, f"{inner}/{name}")
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        system, inner = located(self.path)
        if system.get_file_info(f"{inner}/{self.moving}").type == fs.FileType.Directory:
            system.delete_dir(f"{inner}/{self.moving}")


class NamedWriter(StagedWriter):
    """Takes rows (name, text); each is a file."""

    def __init__(self, path: str, overwrite: bool, suffix: str):
        super().__init__(path, overwrite)
        self.suffix = suffix

    def write(self, batches) -> Written:
        folder = self.attempt()
        return Written([self.put(folder, name, [text.encode()]) for b in batches for name, text in zip(b.column("name").to_pylist(), b.column("text").to_pylist(), strict=True)])


class NamedFiles(DataSource):
    """``format("tagforge_files")`` with the options ``path`` and ``suffix``, for writing."""

    @classmethod
    def name(cls) -> str:
        return "tagforge_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options["path"], overwrite, self.options["suffix"])


def write_named(files: DataFrame, path: str, suffix: str) -> None:
    """Each row (name, text) as the file ``name`` of a folder, in place of the folder's files of that suffix."""
    spark = files.sparkSession
    ship(spark)
    spark.dataSource.register(NamedFiles)
    files.select("name", "text").write.format(NamedFiles.name()).mode("overwrite").option("path", path).option("suffix", suffix).save()
