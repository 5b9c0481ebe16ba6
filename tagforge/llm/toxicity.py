"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training takes at most ``train_rows`` labelled rows, half per class.  A feature's value is the root
of its share of the text, times log(P(feature | toxic) / P(feature | clean)), the add-``smoothing``
estimate over the sample, which draws features of few texts towards 0.  Scores are
those of the ridge logistic regression over these values.  The sample is also bounded to ``size`` bytes of text (64 MB).

Null and empty texts score the model's bias; rows with a null id are scored and not held out.  Without labels of
both classes there is nothing to learn: every score is then the share of label 1 (0 without labels).
Repeated rows are scored alike and learned from once; very long texts are scored whole, in blocks of a megabyte or of one longer
text; a score of exactly the threshold counts as toxic.  An empty table gives an empty result.  Columns other than id and text are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagforge.llm.common import TRAIN_BYTES, fit_on_executor, fold, labelled_sample, map_texts, sigmoid
from tagforge.llm.features import logistic, sparse_counts

ORDERS = (3, 5, 7)
BITS = 18


def fit(rows: list[dict], smoothing: float = 5.0, ridge: float = 0.05) -> dict[str, np.ndarray]:
    """Weights per hashed n-gram (log-count ratio times coefficient) and the bias."""
    size = 1 << BITS
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return {"weight": np.zeros(size, np.float32), "bias": np.array(np.log((share + 1e-9) / (1 - share + 1e-9)))}
    made, toxic, seen = [], np.zeros(size), np.zeros(size)
    for row, label in zip(rows, y, strict=True):
        _, h, c, n = sparse_counts([row["text"]], ORDERS, BITS, fold=True)
        toxic[h] += label
        seen[h] += 1
        made.append((h.astype(np.int32), np.sqrt(c / max(int(n[0]), 1)).astype(np.float32)))
    clean = len(y) - y.sum()
    ratio = np.log((toxic + smoothing) / y.sum()) - np.log((seen - toxic + smoothing * clean / y.sum()) / clean)
    ratio = ratio.astype(np.float32)
    for i, (h, value) in enumerate(made):
        made[i] = (h, value * ratio[h])
    w, bias = logistic(made, y, size, ridge)
    return {"weight": (w * ratio).astype(np.float32), "bias": np.array(bias)}


def score(model: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 for each whole text."""
    doc, h, c, n = sparse_counts(texts, ORDERS, BITS, fold=True)
    part = model["weight"][h] * np.sqrt(c / np.maximum(n, 1)[doc])
    return sigmoid(np.bincount(doc, part, len(texts)) + float(model["bias"]))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text", train_rows: int = 4000, size: int = TRAIN_BYTES) -> dict[str, np.ndarray]:
    """Fit on labelled rows outside the held-out fold (crc32 of the id modulo 5 is 0)."""
    return fit_on_executor(labelled_sample(docs, labels, target, fold(id_col, 5) != 0, train_rows, id_col, text_col, size), fit)


def classify(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    made = map_texts(docs, [id_col], text_col, [T.StructField("score", T.DoubleType())], partial(_columns, model))
    return made.select(id_col, (fold(id_col, 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _columns(model, texts):
    return [score(model, texts)]
