"""Whitening against numpy's full decomposition, LOBPCG on known spectra, and odd tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from tagforge.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def expected(frame, k=16):
    good = [v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) for v in frame.embedding]
    frame = frame[good]
    x = np.array([[math.floor(64 * float(c)) + 1000000 for c in v] for v in frame.embedding])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return frame.vec_id.tolist(), n, deviation, (x - s / n) @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


def compare(got, frame, k=16):
    ids, n, deviation, whitened, explained = expected(frame, k)
    got = got.assign(copy=got.groupby(["vec_id", "component"]).cumcount()).sort_values(["vec_id", "copy", "component"], ignore_index=True)
    order = np.argsort(ids, kind="stable")
    assert len(got) == len(ids) * k and (got.n == n).all()
    assert got.vec_id.tolist() == np.repeat(np.array(ids)[order], k).tolist() and got.component.tolist() == list(range(1, k + 1)) * len(ids)
    assert got.deviation.tolist() == np.repeat(np.array(deviation, object)[order], k).tolist()
    w, want = got.whitened.to_numpy().reshape(-1, k), whitened[order]
    sign = np.sign((w * want).sum(0))
    np.testing.assert_allclose(w * sign, want, atol=1e-7)
    np.testing.assert_allclose(got.explained.to_numpy().reshape(-1, k)[0], explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-8


def test_whole_table(spark, sf):
    compare(queries.QUERIES["op12_embedding_whitening"](spark, sf).toPandas(), pd.read_parquet(f"{sf}/embeddings.parquet"))


def test_nulls_repeats_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(c) for c in rng.normal(0, [1, 2, 3, 4, 5], 5)], 0) for i in range(60)]
    odd = [(100, None, 1), (101, [1.0, None, 0.0, 0.0, 0.0], 1), (102, [math.inf, 0.0, 0.0, 0.0, 0.0], 1), (103, [math.nan, 0.0, 0.0, 0.0, 0.0], 1), (104, [], 1)]
    repeats = [(7, rows[7][1], 0)] * 3 + [(105, rows[8][1], 0)]
    table = spark.createDataFrame(rows + odd + repeats, SCHEMA)
    for c in ("x", "n", "component", "i", "id"):
        table = table.selectExpr("*", f"'y' AS {c}")
    compare(whitening.whiten(table, components=5).toPandas(), pd.DataFrame(rows + repeats, columns=["vec_id", "embedding", "label"]), 5)
    short = whitening.whiten(table.unionByName(spark.createDataFrame([(200, [1.0, 2.0], 0)], SCHEMA), allowMissingColumns=True), components=5)
    assert short.where("vec_id = 200").count() == 0


def test_small_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(none).collect() == [] and whitening.whiten(none).columns[0] == "vec_id"
    one = spark.createDataFrame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (None, [1.0, 2.0], 0)], SCHEMA)
    assert whitening.whiten(one).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 0) for i in range(5)] + [(None, [0.0, 0.0, 0.0], 0)], SCHEMA)
    got = whitening.whiten(line).toPandas()
    assert set(got.component) == {1} and len(got) == 6 and got.vec_id.isna().sum() == 1 and got.explained[0] == pytest.approx(1)


@pytest.mark.parametrize(("d", "ratio"), [(10, 0.5), (300, 0.97), (200, 0.9)])
def test_lobpcg(d, ratio):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    spectrum = 5.0 * ratio ** np.arange(d)
    a = (q * spectrum) @ q.T
    values, vectors, taken = whitening.lobpcg(lambda v: a @ v, d, 8)
    np.testing.assert_allclose(values, spectrum[:8], rtol=1e-10)
    np.testing.assert_allclose(np.abs(vectors.T @ q[:, :8]), np.eye(8), atol=1e-8)
    assert taken < 200


def test_lobpcg_gives_up():
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(lambda v: np.arange(100.0)[:, None] * v, 100, 4, guard=0, rounds=2)


def test_ties_span_their_space():
    values, vectors, _ = whitening.lobpcg(lambda v: np.array([3.0, 3, 3, 1, 1, 0])[:, None] * v, 6, 4)
    np.testing.assert_allclose(values, [3, 3, 3, 1], atol=1e-9)
    np.testing.assert_allclose(np.abs(vectors[:3, :3] @ vectors[:3, :3].T), np.eye(3), atol=1e-9)
