"""Shared plumbing: Arrow batch kernels over texts, label samples, models fitted on one executor, shared tables."""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagforge.session import ship

#: One white-space separated word, as every operator here counts words.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one kernel call sees at most, unless a single text is longer.
BLOCK_BYTES = 1 << 20
#: Texts that one kernel call sees at most.
BLOCK_ROWS = 8192

def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus, F.lit(-1))


def blocks(batch: pa.RecordBatch, text_at: int) -> Iterator[pa.RecordBatch]:
    """The batch in order, cut so that a kernel call holds a bounded number of bytes."""
    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_at)), 0), np.int64)
    start, held = 0, 0
    for i, n in enumerate(size):
        if i > start and (held + n > BLOCK_BYTES or i - start >= BLOCK_ROWS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    yield batch.slice(start)


def fresh(columns: list[str], name: str) -> str:
    """A column name that isn't among the columns."""
    taken, name = {c.lower() for c in columns}, f"__{name}"
    while name in taken:
        name += "_"
    return name


def map_texts(df: DataFrame, keep: list[str], text_col: str, fields: list[T.StructField], kernel: Callable[[list], list]) -> DataFrame:
    """Columns ``keep`` of df plus what ``kernel`` returns for the texts, a list of columns in the order of ``fields``.

    Only ``keep`` and the text are read, so other columns of df can't clash with the results.
    """
    ship(df.sparkSession)
    source = df.select(*keep, F.col(text_col).cast("string").alias(fresh(keep, "text")))
    schema = T.StructType([*source.schema.fields[:-1], *fields])
    n = len(keep)

    def run(batches):
        out = None
        for batch in batches:
            for part in blocks(batch, n):
                made = kernel(part.column(n).to_pylist())
                out = out or pa.schema([*list(part.schema)[:n], *_arrow(fields)])
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *(pa.array(x, f.type) for x, f in zip(made, list(out)[n:], strict=True))], schema=out)

    return source.mapInArrow(run, schema)


def filter_texts(df: DataFrame, text_col: str, kernel: Callable[[list], np.ndarray]) -> DataFrame:
    """Rows of df, all columns as they are, whose text the kernel's boolean array keeps."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in blocks(batch, at):
                yield part.filter(pa.array(kernel(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _arrow(fields: list[T.StructField]) -> list[pa.Field]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return [pa.field(f.name, kinds[f.dataType.simpleString()]) for f in fields]


#: Text bytes that a training sample holds at most, unless a caller's ``size`` says otherwise.
TRAIN_BYTES = 64 << 20


def bounded_sample(candidates: DataFrame, rows: int, size: int = TRAIN_BYTES) -> DataFrame:
    """(y, at, text): of (y, id, text) at most ``rows`` different ones per class y, of together at most ``size`` bytes a class (one row at least).

    Rows that repeat an id and a text count once.  ``at``, a hash of both, chooses and orders them.  Up to a quarter more than
    enough is first taken from each of 64 salts, on the map side where it can, so that no task sorts a whole class.
    """
    once = candidates.select("y", F.xxhash64("id", "text").alias("at"), "text").dropDuplicates(["y", "at"])
    few = once.withColumn("k", F.row_number().over(W.partitionBy("y", F.pmod("at", F.lit(64))).orderBy("at"))).where(F.col("k") <= max(32, rows // 16))
    order = W.partitionBy("y").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    held = few.withColumn("k", F.row_number().over(W.partitionBy("y").orderBy("at"))).withColumn("held", F.sum(F.octet_length("text")).over(order))
    return held.where((F.col("k") <= rows) & ((F.col("k") == 1) | (F.col("held") <= size))).select("y", "at", "text")


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, where, rows: int, id_col: str = "doc_id", text_col: str = "text", size: int = TRAIN_BYTES) -> DataFrame:
    """(y, at, text) of at most ``rows`` labelled documents and ``size`` bytes of text, half per class, chosen by hashes of id and text.

    ``where`` is a condition on the id; labels other than 0 and 1 and null ids don't count.  The
    sample's ids, at most ``rows``, are broadcast against one scan of the documents.  Repeated rows count once, however many there are.
    """
    known = labels.where(where & F.col(id_col).isNotNull() & F.col(target).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(target).cast("int").alias("y")).distinct()
    picked = [known.where(F.col("y") == k).orderBy(F.xxhash64("id"), "id").limit(rows // 2) for k in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return bounded_sample(texts.join(ids, "id"), rows // 2, size // 2)


def fit_on_executor(sample: DataFrame, fit: Callable[[list[dict]], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """``fit`` over the rows of a bounded sample, run in one task so that the driver holds only the model; rows come in order of ``at``."""

    def run(batches):
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["at"], str(r["y"])))
        yield pa.RecordBatch.from_arrays([pa.array([pack(fit(rows))], pa.binary())], names=["model"])

    got = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return unpack(got[0].model) if got else fit([])


def pack(model: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **model)
    return out.getvalue()


def unpack(model: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(bytes(model)), allow_pickle=False) as z:
        return {k: z[k] for k in z.files}


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names in spark.checkpoint.dir; one of our own only on a local master without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    _made.append(f"{base.rstrip('/')}/tagforge-{uuid.uuid4().hex}")
    return _made[-1]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what :func:`shared_dir` names inside; results must have been written elsewhere by then."""
    before = len(_made)
    yield
    for path in _made[before:]:
        drop_path(spark, path)
    del _made[before:]


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, and survives the loss of any executor."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0)))
