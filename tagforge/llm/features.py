"""Hashed character and word n-gram features over blocks of whole texts.

Every function works on a block of texts at once: code points are laid end to
end in one numpy array, n-gram hashes are rolled over it, and windows that would
cross from one text into the next are dropped.  Null texts count as empty.
"""

from __future__ import annotations

import numpy as np

#: Multiplier of the rolling hash and of the final mix (both odd 32-bit numbers).
ROLL = np.uint32(0x01000193)
MIX = np.uint32(0x9E3779B1)
#: Hash of the feature "this word equals the word before it".
SAME_WORD = np.uint32(0x5EED5A3E)


def codepoints(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and the len(texts) + 1 offsets between them."""
    whole = [t or "" for t in texts]
    ends = np.zeros(len(whole) + 1, np.int64)
    np.cumsum([len(t) for t in whole], out=ends[1:])
    points = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, ends


def fold_case(points: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and the Latin-1 capitals; other code points stay."""
    up = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    return points + np.where(up, np.uint32(32), np.uint32(0))


def char_ngrams(points: np.ndarray, ends: np.ndarray, orders: tuple[int, ...], bits: int):
    """Per order, (hash in [0, 2**bits) at each start, true where the window stays within one text)."""
    left = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(points))
    rolled, n = np.zeros(len(points), np.uint32), 0
    for order in sorted(orders):
        while n < order:
            if n < len(points):
                rolled = rolled * ROLL
                rolled[: len(points) - n] += points[n:] + np.uint32(1)
            n += 1
        mixed = (rolled ^ (rolled >> np.uint32(15))) * MIX + np.uint32(order * 0x632BE5AB & 0xFFFFFFFF)
        mixed = (mixed ^ (mixed >> np.uint32(13))) * MIX
        yield mixed >> np.uint32(32 - bits), left >= order


def word_hashes(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hash of each white-space separated word, and the text it stands in."""
    space = (points == 32) | ((points >= 9) & (points <= 13))
    first = ~space
    first[1:] &= space[:-1]
    inner = ends[1:-1][ends[1:-1] < len(points)]
    first[inner] = ~space[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    at = np.cumsum(first) - 1
    place = np.arange(len(points)) - starts[np.maximum(at, 0)]
    power = np.ones(int(place.max()) + 2, np.uint32)
    power[1:] = ROLL
    power = np.cumprod(power, dtype=np.uint32)
    spread = (points + np.uint32(0x51)) * MIX
    spread = (spread ^ (spread >> np.uint32(16))) * power[np.maximum(place, 0)]
    spread[space] = 0
    hashed = np.add.reduceat(spread, starts, dtype=np.uint32)
    hashed = (hashed ^ (hashed >> np.uint32(15))) * MIX
    return hashed, np.searchsorted(ends, starts, side="right") - 1


def word_ngrams(points: np.ndarray, ends: np.ndarray, bits: int):
    """(hash, text) of each word, of each pair of neighbours, and of each repetition of the word before."""
    words, doc = word_hashes(points, ends)
    cut = lambda h: ((h ^ (h >> np.uint32(13))) * MIX) >> np.uint32(32 - bits)
    yield cut(words), doc
    if len(words) > 1:
        near = doc[1:] == doc[:-1]
        yield cut((words[:-1] * ROLL + words[1:]) ^ np.uint32(0x77777777))[near], doc[1:][near]
        same = near & (words[1:] == words[:-1])
        yield cut(np.full(int(same.sum()), SAME_WORD, np.uint32)), doc[1:][same]


def sparse_counts(texts: list[str | None], orders: tuple[int, ...], bits: int, fold: bool = False, words: bool = False):
    """(text, hash, count) of every distinct feature of each text, sorted, and each text's length in code points.

    ``words`` adds the word features of :func:`word_ngrams` to the character n-grams.
    """
    points, ends = codepoints(texts)
    if fold:
        points = fold_case(points)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint32), np.diff(ends))
    keys = [(doc[ok] << np.uint32(bits)) | h[ok] for h, ok in char_ngrams(points, ends, orders, bits)]
    if words:
        keys += [(d.astype(np.uint32) << np.uint32(bits)) | h for h, d in word_ngrams(points, ends, bits)]
    key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint32)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    found = key[first]
    count = np.diff(np.append(first, len(key)))
    return (found >> np.uint32(bits)).astype(np.int64), (found & np.uint32((1 << bits) - 1)).astype(np.int64), count, np.diff(ends)


def logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, ridge: float, steps: int = 60, rate: float = 0.3):
    """Ridge logistic regression over sparse rows (features, values), both classes weighing alike; (weights, bias).

    Full-batch adaptive gradient steps; rows are laid end to end in blocks, so temporary arrays stay small.
    """
    n = len(y)
    blocks, start = [], 0
    while start < n:
        stop, held = start, 0
        while stop < n and (held < 1 << 20 or stop == start):
            held += len(rows[stop][0])
            stop += 1
        blocks.append((start, [len(rows[i][0]) for i in range(start, stop)], np.concatenate([rows[i][0] for i in range(start, stop)]).astype(np.int32), np.concatenate([rows[i][1] for i in range(start, stop)]).astype(np.float32)))
        for i in range(start, stop):
            rows[i] = None  # type: ignore[call-overload]
        start = stop
    balance = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * n
    w, m, v, bias = np.zeros(size), np.zeros(size + 1), np.zeros(size + 1), 0.0
    for step in range(1, steps + 1):
        grad, shift = np.zeros(size + 1), 0.0
        for first, lengths, feature, value in blocks:
            last = first + len(lengths)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            z = np.bincount(doc, value * w[feature], len(lengths)) + bias
            error = (1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))) - y[first:last]) * balance[first:last]
            grad[:size] += np.bincount(feature, value * error[doc], size)
            shift += float(error.sum())
        grad[:size] = grad[:size] / n + ridge * w / n
        grad[size] = shift / n
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= move[:size]
        bias -= float(move[size])
    return w, bias
