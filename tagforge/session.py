"""Session helpers shared by all parts of the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task is dealt where their number is known.
ROWS = 1 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let executors import this package: once per application, unless PYTHONPATH has it already.

    Spark's own file server carries the archive from the driver to the executors, as --py-files does.
    """
    root = Path(__file__).resolve().parent
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    if str(root.parent) in [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        return
    archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent).as_posix())
    context.addPyFile(str(archive))


def dealt(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """df dealt by its keys over all shuffle partitions, or more where its number of rows is known and a task would get over ``ROWS``.

    A number that is given isn't coalesced, so what a task sorts or sums shrinks with the partitions, and with ``rows`` doesn't grow with the table.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS)), *keys)


def stored(df: DataFrame) -> DataFrame:
    """df as a table below spark.checkpoint.dir, for results that a plan reads several times; a folder of its own only on a local master without that setting."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = f"{(base or spark.conf.get('spark.sql.warehouse.dir') + '/_shared').rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
