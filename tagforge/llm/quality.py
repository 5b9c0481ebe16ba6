"""Quality: supervised subword embeddings, averaged per document, with a softmax output.

Words, pairs of neighbouring words, a token for "same word as before" and character n-grams of
3 to 5 code points are hashed into 2**BITS buckets.  Each bucket has a learned vector; a document is
the mean of its features' vectors; a softmax layer gives the class.  Both layers are trained by
minibatch stochastic gradient descent in numpy (AdaGrad steps, fixed seed) on at most ``train_rows``
labelled rows, half per class.  The output layer is linear in the mean, so scoring first multiplies
each vector with the output weights and then averages single numbers; the result is the same.

Null and empty texts score the output bias; rows with a null id are scored and not held out.  Without labels of both
classes every score is the share of label 1 (1 without labels: nothing is rejected unlearned).  An empty table gives an empty
result.  Repeated rows are scored alike and learned from once; the sample is also bounded to ``size`` bytes of text (64 MB); scoring cuts
blocks of texts at a megabyte, or at one longer text.  Columns other than id and text are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagforge.llm.common import TRAIN_BYTES, filter_texts, fit_on_executor, fold, labelled_sample, map_texts, sigmoid
from tagforge.llm.features import char_ngrams, codepoints, sparse_counts, word_ngrams

ORDERS = (3, 4, 5)
BITS = 17
DIM = 8
THRESHOLD = 0.3


def fit(rows: list[dict], epochs: int = 8, batch: int = 32, rate: float = 2.0, decay: float = 1e-6) -> dict[str, np.ndarray]:
    """Vectors times output weights (one number per bucket: class 1 minus class 0) and the bias difference."""
    size = 1 << BITS
    y = np.array([r["y"] for r in rows], int)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return {"value": np.zeros(size, np.float32), "bias": np.array(np.log((share + 1e-9) / (1 - share + 1e-9)))}
    random = np.random.default_rng(17)
    vectors = (random.random((size, DIM), np.float32) - 0.5) / DIM
    output = (random.random((DIM, 2)) - 0.5).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen, out_seen, bias_seen = np.full(size, 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    made = []
    for row in rows:
        _, h, c, _ = sparse_counts([row["text"]], ORDERS, BITS, words=True)
        made.append((h.astype(np.int32), (c / max(c.sum(), 1)).astype(np.float32)))
    balance = len(y) / (2.0 * np.bincount(y, minlength=2))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = random.permutation(len(y))
        for start in range(0, len(y), batch):
            take = order[start : start + batch]
            h = np.concatenate([made[i][0] for i in take])
            if not len(h):
                continue
            share = np.concatenate([made[i][1] for i in take])
            lengths = np.array([len(made[i][0]) for i in take])
            doc = np.repeat(np.arange(len(take)), lengths)
            rows_of = vectors[h]
            mean = np.stack([np.bincount(doc, share * rows_of[:, d], len(take)) for d in range(DIM)], 1).astype(np.float32)
            z = mean @ output + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(take)), y[take]] -= 1
            error = (p * balance[y[take]][:, None]).astype(np.float32)
            to_mean = error @ output.T
            g_out = mean.T @ error / len(take) + decay * output
            g_bias = error.mean(0)
            found, back = np.unique(h, return_inverse=True)
            grad = np.stack([np.bincount(back, share * to_mean[doc, d], len(found)) for d in range(DIM)], 1).astype(np.float32) + decay * vectors[found]
            seen[found] += (grad * grad).mean(1)
            vectors[found] -= step * grad / np.sqrt(seen[found])[:, None]
            out_seen += g_out * g_out
            output -= step * g_out / np.sqrt(out_seen)
            bias_seen += g_bias * g_bias
            bias -= step * 0.1 * g_bias / np.sqrt(bias_seen)
    turn = output[:, 1] - output[:, 0]
    return {"value": (vectors @ turn).astype(np.float32), "bias": np.array(float(bias[1] - bias[0]))}


def score(model: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    """Softmax probability of quality 1 for each whole text."""
    points, ends = codepoints(texts)
    n, value = len(texts), model["value"]
    total, count = np.zeros(n), np.zeros(n)
    doc = np.repeat(np.arange(n), np.diff(ends))
    found = [(h[ok], doc[ok]) for h, ok in char_ngrams(points, ends, ORDERS, BITS)]
    for h, at in [*found, *word_ngrams(points, ends, BITS)]:
        total += np.bincount(at, value[h], n)
        count += np.bincount(at, minlength=n)
    return sigmoid(total / np.maximum(count, 1) + float(model["bias"]))


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text_col: str = "text", train_rows: int = 4000, size: int = TRAIN_BYTES) -> dict[str, np.ndarray]:
    """Fit on labelled rows outside the held-out fold (crc32 of the id modulo 5 is 0)."""
    return fit_on_executor(labelled_sample(docs, labels, target, fold(id_col, 5) != 0, train_rows, id_col, text_col, size), fit)


def classify(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    made = map_texts(docs, [id_col], text_col, [T.StructField("score", T.DoubleType())], partial(_columns, model))
    return made.select(id_col, (fold(id_col, 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    return filter_texts(docs, text_col, partial(_mask, model, threshold))


def _columns(model, texts):
    return [score(model, texts)]


def _mask(model, threshold, texts):
    return score(model, texts) >= threshold
