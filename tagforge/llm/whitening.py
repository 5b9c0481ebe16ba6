"""Whitening of embeddings with eigenvectors from LOBPCG over distributed covariance products.

Every entry c counts as the whole number floor(64 c) + 1000000.  The fit list, each distinct vector once, lies in the shared folder;
its n and its sums S are exact.  A covariance product is one pass over it: a task adds up x (x' V) / n of its centred rows for a
whole block V of directions, Spark sums the blocks, and only matrices of (dimensions x block) come to the driver.  Rows are centred by
the whole and the broken part of S / n, so that no digits are lost to the offset.

LOBPCG: the trial space is spanned by the iterate, the residuals and the previous directions; the product with its orthonormal basis
is taken afresh in each round, and Rayleigh-Ritz gives the next iterate.  Residuals are certified on a product with the final
vectors, or an error is raised.  Components are numbered by falling eigenvalue and have their largest entry positive; those
beyond the rank of the covariance (eigenvalue under ``RANK`` of the trace) are left out.

Rows whose vector is null, empty, or holds a null or non-finite entry are dropped, as are those of another length than most
distinct vectors have (the longer one on ties); 64 c is cut at +-2**40.  Repeated rows and ids are whitened each; a null id passes
through.  A fit list of one vector, or an empty table, gives no rows.  Equal eigenvalues give some basis of their space, the
same for all rows.  ``deviation`` is null where it would pass 64 bits.  There are no texts.  Columns other than id and vector are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagforge.llm.common import shared_dir, written
from tagforge.session import ship

COMPONENTS = 16
#: Directions beside the wanted ones in a block: they speed up the last of those.
GUARD = 8
#: Largest residual, as a share of the largest eigenvalue, that is certified.
TOLERANCE = 1e-11
RANK = 1e-12
ROUNDS = 500


def whole_numbers(vector: Column) -> Column:
    """The vector as whole numbers, null if it can't take part."""
    v = vector.cast("array<double>")
    good = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    cut = lambda c: F.greatest(F.least(c * 64.0, F.lit(2.0**40)), F.lit(-(2.0**40)))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(v, lambda c: F.floor(cut(c)).cast("bigint") + 1000000))


def _rows(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(d: int, batches):
    total, n = np.zeros(d, np.int64), 0
    for batch in batches:
        x = _rows(batch.column(0), d)
        total, n = total + x.sum(0), n + len(x)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1), pa.int32()), pa.array(np.append(total, n), pa.int64())], names=["i", "v"])


def centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    return (x - sums // n).astype(float) - (sums % n) / n


def _products(sums: np.ndarray, n: int, block: np.ndarray, batches):
    """(i, j, v): sums of x (x' V) over the rows of a task, and in row -1 of x' x."""
    d, k = block.shape
    total, trace = np.zeros((d, k)), 0.0
    for batch in batches:
        x = centred(_rows(batch.column(0), d), sums, n)
        total += x.T @ (x @ block)
        trace += float((x * x).sum())
    i, j = np.divmod(np.arange(d * k), k)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, 0), pa.int32()), pa.array(np.append(total.ravel(), trace), pa.float64())], names=["i", "j", "v"])


def _grams(sums: np.ndarray, n: int, scaled: np.ndarray, batches):
    """(i, j, v): sums of the products of every two whitened components over the rows of a task."""
    d, k = scaled.shape
    total = np.zeros((k, k))
    for batch in batches:
        w = centred(_rows(batch.column(0), d), sums, n) @ scaled
        total += w.T @ w
    i, j = np.divmod(np.arange(k * k), k)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel(), pa.float64())], names=["i", "j", "v"])


def _summed(fit: DataFrame, kernel, shape: tuple[int, int]) -> tuple[np.ndarray, float]:
    got = fit.select("x").mapInArrow(kernel, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (got.column(c).to_numpy() for c in ("i", "j", "v"))
    out = np.zeros(shape)
    out[i[i >= 0], j[i >= 0]] = v[i >= 0]
    return out, float(v[i < 0].sum())


def _basis(*parts: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns together: each part less the ones before it, twice, without directions that vanish."""
    out = np.zeros((len(parts[0]), 0))
    for part in parts:
        part = part / np.maximum(np.linalg.norm(part, axis=0), 1e-300)
        for _ in range(2):
            part = part - out @ (out.T @ part)
            u, s, _ = np.linalg.svd(part, full_matrices=False)
            part = u[:, s > 1e-8]
        out = np.hstack([out, part])[:, : len(out)]
    return out


def lobpcg(product, d: int, wanted: int, guard: int = GUARD, tolerance: float = TOLERANCE, rounds: int = ROUNDS, seed: int = 12) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues falling, eigenvectors, products taken) of the ``wanted`` largest; ``product(V)`` is the matrix times a block V."""
    width = min(d, wanted + guard)
    trial = _basis(np.random.default_rng(seed).standard_normal((d, width)))
    before, taken = np.zeros((d, 0)), 0
    for _ in range(rounds):
        images = product(trial)
        taken += 1
        small = trial.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:width], turn[:, ::-1][:, :width]
        x, ax = trial @ turn, images @ turn
        off = ax - x * values
        if (np.linalg.norm(off[:, :wanted], axis=0) <= tolerance / 10 * abs(values[0])).all():
            check = product(x)
            taken += 1
            off = check - x * values
            if (np.linalg.norm(off[:, :wanted], axis=0) <= tolerance * abs(values[0])).all():
                return values[:wanted], x[:, :wanted], taken
        step = trial[:, width:] @ turn[width:] if trial.shape[1] > width else before
        trial = _basis(x, off, step)
    raise ArithmeticError(f"residuals not below {tolerance} after {rounds} rounds")


def _whitened(sums: np.ndarray, n: int, scaled: np.ndarray, explained: np.ndarray, error: float, batches):
    d, k = scaled.shape
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            x, m = _rows(part.column(1), d), part.num_rows
            w = centred(x, sums, n) @ scaled
            rough = ((float(n) * (x - sums // n) - sums % n) ** 2).sum(1)
            exact = ((n * (x - sums // n) - sums % n) ** 2).sum(1)
            at = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()), pa.array(exact[at], pa.int64(), mask=rough[at] > 9.2e18),
                 pa.array(w.ravel(), pa.float64()), pa.array(np.tile(explained, m), pa.float64()), pa.array(np.full(m * k, error), pa.float64())],
                names=[part.schema.names[0], "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    ship(spark)
    taken = vectors.select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col)).alias("x")).where("x is not null")
    kind = taken.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit = written(taken.select("x").distinct(), f"{shared_dir(spark)}/fit")
    length = fit.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    none = taken.where("false").selectExpr("id", "0 component", "0L n", "0L deviation", "0d whitened", "0d explained", "0d identity_error").withColumnRenamed("id", id_col)
    if length is None or length.n < 2:
        return none
    d, same = length.d, F.size("x") == length.d
    fit = fit.where(same)
    got = fit.mapInArrow(partial(_sums, d), "i int, v bigint").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow().column("v").to_numpy()
    sums, n = got[:d], int(got[d])
    traces = []

    def product(block):
        out, trace = _summed(fit, partial(_products, sums, n, block), block.shape)
        traces.append(trace / n)
        return out / n

    values, directions, _ = lobpcg(product, d, min(d, components))
    trace = traces[-1]
    good = values > RANK * trace
    if not good.any():
        return none
    values, directions = values[good], directions[:, good]
    directions = directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(len(values))])
    scaled = directions / np.sqrt(values)
    gram, _ = _summed(fit, partial(_grams, sums, n, scaled), (len(values),) * 2)
    error = float(np.abs(gram / n - np.eye(len(values))).max())
    return taken.where(same).mapInArrow(partial(_whitened, sums, n, scaled, values / trace, error), schema).withColumnRenamed("id", id_col)
