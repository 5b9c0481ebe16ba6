"""Quality rules: exact base rules, then a calibrated n-gram logistic regression with fixed thresholds.

Base figures per whole text (words are white-space separated, ASCII white space only):
n_words, word_chars, n_symbols (of ``#*$%&|<>``), n_dup_lines (lines with a word that equal an earlier
line) and n_repeat_words (words inside three-word windows that stand in the text twice or more, the
first one included).  A text fails the base rules with fewer than 50 words, or if more than half of
its words are repeated ones.

The method's verdict on the rest: logistic regression on hashed words, word pairs and character
n-grams (roots of their shares), fitted on at most ``train_rows`` labelled rows; its log-odds are
calibrated to probabilities by Platt scaling on a fifth of the sample that the fit didn't see.  A
document is kept if the probability of quality 1 reaches ``threshold``.

Null texts count as empty and fail the base rules.  Without labels of both classes the method
keeps all that pass the base rules.  An empty table gives an empty result.  Repeated rows get equal results and are learned from once; the sample is also bounded to ``size`` bytes of text (64 MB).
Very long texts are judged whole, in blocks of a megabyte or of one longer text; there are no ties.  Columns other than id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagforge.llm.common import TRAIN_BYTES, filter_texts, fit_on_executor, labelled_sample, map_texts, sigmoid
from tagforge.llm.features import logistic, sparse_counts

ORDERS = (3, 4)
BITS = 17
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.3
_NO_SYMBOL = bytes(range(256)).translate(None, b"#*$%&|<>")
_CONTINUES = bytes(range(0x80, 0xC0))


def base_figures(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(b"".join(words).translate(None, _CONTINUES))
    symbols = len(raw.translate(None, _NO_SYMBOL))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + 3 - max(at, end)
            end = at + 3
    return covered


def base_fails(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


def fit(rows: list[dict], ridge: float = 0.02) -> dict[str, np.ndarray]:
    """Feature weights and bias of the calibrated log-odds."""
    size = 1 << BITS
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return {"weight": np.zeros(size, np.float32), "bias": np.array(60.0)}
    made = []
    for row in rows:
        _, h, c, _ = sparse_counts([row["text"]], ORDERS, BITS, words=True)
        made.append((h.astype(np.int32), np.sqrt(c / max(c.sum(), 1)).astype(np.float32)))
    held = np.arange(len(y)) % 5 == 4
    if min(y[held].sum(), (1 - y[held]).sum(), y[~held].sum(), (1 - y[~held]).sum()) == 0:
        held[:] = False
    w, bias = logistic([made[i] for i in np.flatnonzero(~held)], y[~held], size, ridge)
    odds = np.array([(made[i][1] * w[made[i][0]]).sum() + bias for i in np.flatnonzero(held)])
    slope, shift = platt(odds, y[held]) if held.any() else (1.0, 0.0)
    return {"weight": (slope * w).astype(np.float32), "bias": np.array(slope * bias + shift)}


def platt(odds: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the probability sigmoid(slope * odds + shift), by Newton steps on smoothed targets."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(slope * odds + shift)
        g = np.array([((p - target) * odds).sum() + 1e-3 * (slope - 1), (p - target).sum()])
        k = p * (1 - p) + 1e-9
        h = np.array([[(k * odds * odds).sum() + 1e-3, (k * odds).sum()], [(k * odds).sum(), k.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
        slope, shift = slope - move[0], shift - move[1]
    return max(float(slope), 0.05), float(shift)


def score(model: dict[str, np.ndarray], texts: list[str | None]) -> np.ndarray:
    """Calibrated probability of quality 1."""
    doc, h, c, _ = sparse_counts(texts, ORDERS, BITS, words=True)
    total = np.bincount(doc, c, len(texts))
    part = model["weight"][h] * np.sqrt(c / np.maximum(total, 1)[doc])
    return sigmoid(np.bincount(doc, part, len(texts)) + float(model["bias"]))


def judge(model: dict[str, np.ndarray], threshold: float, texts: list[str | None]) -> list:
    """The columns of :func:`apply` for one block of texts."""
    base = np.array([base_figures(t) for t in texts], np.int64).reshape(-1, 5)
    failed = np.array([base_fails(int(b[0]), int(b[4])) for b in base], bool)
    p = score(model, texts)
    return [*base.T, failed, p, ~failed & (p >= threshold)]


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text_col: str = "text", train_rows: int = 4000, size: int = TRAIN_BYTES) -> dict[str, np.ndarray]:
    return fit_on_executor(labelled_sample(docs, labels, target, F.lit(True), train_rows, id_col, text_col, size), fit)


def apply(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, the base figures, base_failed, kept, quality (the calibrated probability)."""
    fields = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("quality", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return map_texts(docs, [id_col], text_col, fields, partial(judge, model, threshold))


def accepted(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that pass base rules and classifier."""
    return filter_texts(docs, text_col, partial(_mask, model, threshold))


def _mask(model, threshold, texts):
    return judge(model, threshold, texts)[-1]
