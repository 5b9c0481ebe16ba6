"""Language identification with a string kernel.

Kernel: blended spectrum of orders 1 to 4 over n-gram presence, k(x, z) = |G(x) & G(z)| / sqrt(|G(x)| |G(z)|), G(x) the
distinct n-grams (case folded) of the whole text x, hashed into 2**20 buckets and held as sparse rows.  ``landmarks`` training texts,
spread over the languages, give the Nystroem approximation; one ridge regression per language (targets +1 and -1) on the
approximate features gives the classifier.  Scoring is batched matrix products: presence rows P, landmark rows M and
coefficients C give (P M') C, and as products associate, M' C is multiplied once, so that a batch costs one product of sparse P
with one column per language.  The score is the softmax share of the best output.

Training reads text and non-null language of at most ``train_rows`` documents outside the held-out fold, in equal parts per language as
far as they go, and at most ``size`` bytes of text (64 MB), the same for every language; rows that repeat id, language and text count once.
Null texts and texts without a letter are ``und`` with score 0.  Without training rows all are ``und``.  A null id is never held
out and never trained on.  Repeated rows are predicted alike; very long texts are predicted whole; of languages with equal outputs the
first by name wins.  An empty table gives an empty result.  Columns other than id, text and language are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagforge.llm.common import TRAIN_BYTES, bounded_sample, fit_on_executor, fold, map_texts
from tagforge.llm.features import sparse_counts

ORDERS = (1, 2, 3, 4)
BITS = 20
LANDMARKS = 192
SHARPNESS = 6.0
#: Texts of one product; the keys of :func:`sparse_counts` leave 12 bits for them.
BATCH = 128


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (text, bucket) of every distinct n-gram, and 1 / sqrt(|G|) per text."""
    doc, bucket, _, _ = sparse_counts(texts, ORDERS, BITS, fold=True)
    return doc, bucket, 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=len(texts)), 1))


def _places(found: np.ndarray) -> np.ndarray:
    """Each bucket's place among ``found``, -1 for the others."""
    where = np.full(1 << BITS, -1, np.int32)
    where[found] = np.arange(len(found))
    return where


def kernel(texts: list[str | None], marks: list[str | None]) -> np.ndarray:
    """k(x, z) of every text and landmark."""
    doc, bucket, norm = presence(marks)
    found, at = np.unique(bucket, return_inverse=True)
    where = _places(found)
    dense = np.zeros((len(found) + 1, len(marks)), np.uint8)  # the last row is that of unseen n-grams
    dense[at, doc] = 1
    out = np.empty((len(texts), len(marks)))
    for i, text in enumerate(texts):
        _, own, scale = presence([text])
        out[i] = dense[where[own]].sum(0, dtype=np.int64) * scale[0] * norm
    return out


def fit(rows: list[dict], landmarks: int = LANDMARKS, ridge: float = 1e-2) -> dict[str, np.ndarray]:
    """The landmarks' buckets, the output per bucket and language (last of all 0, for other buckets), the bias per language, and the languages in order."""
    rows = [r for r in rows if r["text"] and any(map(str.isalpha, r["text"]))]
    names = sorted({r["y"] for r in rows})
    if not names:
        return {"found": np.zeros(0, np.int32), "value": np.zeros((1, 0), np.float32), "bias": np.zeros(0), "names": np.zeros(0, "U1")}
    each = max(1, landmarks // len(names))
    marks = [r["text"] for n in names for r in [r for r in rows if r["y"] == n][:each]]
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    x = np.hstack([kernel([r["text"] for r in rows], marks) @ root, np.ones((len(rows), 1))])
    y = np.array([r["y"] for r in rows])
    goal = np.where(y[:, None] == np.array(names)[None, :], 1.0, -1.0)
    weight = 1.0 / np.array([np.count_nonzero(y == v) for v in y]) * len(rows) / len(names)
    xw = x * weight[:, None]
    w = np.linalg.solve(xw.T @ x + ridge * np.eye(x.shape[1]), xw.T @ goal)
    doc, bucket, norm = presence(marks)
    coef = (root @ w[:-1]) * norm[:, None]
    found, at = np.unique(bucket, return_inverse=True)
    value = np.stack([np.bincount(at, coef[doc, k], len(found) + 1) for k in range(len(names))], 1)
    return {"found": found.astype(np.int32), "value": value.astype(np.float32), "bias": w[-1], "names": np.array(names)}


def outputs(model: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    """One regression output per text and language."""
    doc, bucket, norm = presence(texts)
    value, at = model["value"], _places(model["found"])[bucket]
    return np.stack([np.bincount(doc, value[at, k], len(texts)) for k in range(value.shape[1])], 1) * norm[:, None] + model["bias"]


def predict(model: dict[str, np.ndarray], texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each whole text."""
    names = model["names"]
    found, score = ["und"] * len(texts), np.zeros(len(texts))
    some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if len(names) else []
    for start in range(0, len(some), BATCH):
        take = some[start : start + BATCH]
        z = outputs(model, [texts[i] for i in take])
        p = np.exp(SHARPNESS * (z - z.max(1, keepdims=True)))
        best = z.argmax(1)
        score[take] = (p / p.sum(1, keepdims=True))[np.arange(len(take)), best]
        for i, k in zip(take, best, strict=True):
            found[i] = str(names[k])
    return found, np.clip(score, 0.0, 1.0)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = 3000, size: int = TRAIN_BYTES) -> dict[str, np.ndarray]:
    """Fit on a bounded sample: the first rows of each language by a hash of the id; only ids are sorted, texts are joined to them."""
    known = docs.where((fold(id_col, 4) != 2) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("y")).distinct()
    # A few of each language from each of many salts: no task sorts a whole language; the last window sees at most 4 * train_rows ids a language.
    salted = known.withColumn("h", F.xxhash64("id"))
    few = salted.withColumn("k", F.row_number().over(W.partitionBy("y", F.pmod("h", F.lit(64))).orderBy("h", "id"))).where(F.col("k") <= max(1, train_rows // 16))
    ranked = few.withColumn("k", F.row_number().over(W.partitionBy("y").orderBy("h", "id")))
    picked = F.broadcast(ranked.orderBy("k", "y").limit(train_rows).select("id", "y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("y"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    languages = max(1, picked.select("y").distinct().count())
    return fit_on_executor(bounded_sample(texts.join(picked, ["id", "y"]), train_rows, size // languages), fit)


def identify(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    made = map_texts(docs, [id_col], text_col, fields, partial(_columns, model))
    return made.select(id_col, (fold(id_col, 4) == 2).alias("held_out"), "lang_pred", "score")


def _columns(model, texts):
    return list(predict(model, texts))
