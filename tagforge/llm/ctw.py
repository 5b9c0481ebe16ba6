"""Language-model scoring by context-tree weighting, and a smoothed unigram base beside it.

Model: a text is its words, A-Z lower-cased, with one space between, and one end mark, the events that the base counts too.  Every
byte is eight binary decisions, most significant bit first.  Each of the 255 bit positions of the byte has a tree over contexts of
the last 0 to ``depth`` bytes, with a Krichevsky-Trofimov estimate at every node.  The weighted probability of a node is half its own
estimate plus half the product of its children's, so that the code of a bit mixes the estimates of all depths by their posterior
weights; the trees are frozen after training, and a text costs the sum of its bits.

With a ``size`` the tree holds that many of the most frequent contexts, whatever the corpus; all rarer continuations of a context together
are one more child of it, a leaf.  Counts cover all training texts: a task counts the (depth + 1)-grams of its texts, Spark sums them, and a
table of (node, byte) sums is what the weights are made of.  The model has a dense row a node, one column for each byte that training
has shown and one for all others, which share their probability in equal parts.

``size=None`` is the exact way, a tree of all contexts, and what the query takes.  Grams are dealt to BUCKETS buckets by the last ROOT bytes
of their context, so that a bucket has whole subtrees; a task holds one bucket at a time.  What the subtrees' roots add to contexts of
fewer bytes is summed by Spark; the contexts above the roots, bounded by the bytes there are, go through one task and are broadcast.  A block
of texts asks the buckets for the different grams it has and gets a log for each, so that no table of grams is held by a task or the
driver.  Logs are sent in steps of 2**-33.

Base: the sum of log10((c + 1) / (N + V + 1)) over the lower-cased words and one end.  Words with one in ``head`` of the training words are
looked up in the same pass over the texts; all others are joined by their bytes to the table of counts.

Null texts are empty: one end, whose probability starts a text.  A null id is not held out and not learned from.  Without training
texts every bit costs one, N and V are 0.  An empty table gives an empty result.  Repeated rows are learned from as often as they
stand there and each gets its score; very long texts are scored whole, in blocks of a megabyte or of one longer text.  There are no ties to break.  Columns other than id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagforge.llm.common import blocks, drop_path, fold, shared_dir, written
from tagforge.llm.words import SPACE, bounds, counted, keys, mix, runs
from tagforge.session import ship

DEPTH = 6
#: Contexts of the tree: a kilobyte each in the model at most.
SIZE = 1 << 16
HEAD = 1 << 20
#: The end mark: a byte that UTF-8 doesn't use.
END = 255
#: Distinct keys that a task holds before it sends its sums.
HELD = 1 << 21
#: Rows of one batch of sums.
SENT = 1 << 17
#: Distinct words that a task holds before it sends its sums.
HELD_WORDS = 1 << 18
#: Bytes of context at the roots of the subtrees that the whole tree is dealt by, and the buckets they are dealt to.
ROOT = 3
BUCKETS = 1 << 10
#: Bytes of text that ask for their grams together.
ASKED_BYTES = 16 << 20
#: Steps of a log of 1 as it is sent.
STEPS = float(1 << 33)
#: Bytes of the longest word that the head has; the join has longer ones too.
HEAD_BYTES = 64


# -- blocks of texts


def plain(text: bytes | None) -> bytes:
    """The words of a text, A-Z lower-cased, with one space between."""
    return b" ".join((text or b"").lower().split())


def lay(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with ``depth`` end marks before each and after the last, the places to predict, and how many each text has."""
    gap = bytes([END]) * depth
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    start = depth + np.concatenate(([0], np.cumsum(sizes + depth)[:-1]))
    keep = np.ones(len(data), bool)
    for k in range(depth):
        keep[start - 1 - k] = False
    keep[len(data) - depth :] = False
    keep[start + sizes] = True
    return data, np.flatnonzero(keep), sizes + 1


def grams(data: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The byte at each place in the low byte, the bytes before it above, the nearest lowest."""
    out = np.zeros(len(data) - depth, np.uint64)
    for k in range(depth, -1, -1):
        out = (out << np.uint64(8)) | data[depth - k : len(data) - k]
    return out[at - depth]


# -- the tree


def grow(contexts: np.ndarray, depths: np.ndarray) -> dict[str, np.ndarray]:
    """Nodes of the contexts: ``child`` (a row per node with children and a dead row, a column per byte that contexts have and one for others), ``near`` (each byte's column), ``parent``, ``level``.

    Nodes with children come first, the root before all, so that a node's number tells its row; a missing child is the number of nodes.
    """
    order = np.lexsort((contexts, depths))
    contexts, depths = np.concatenate(([0], contexts[order])).astype(np.int64), np.concatenate(([0], depths[order])).astype(np.int64)
    code = (depths << 56) | contexts
    up = np.maximum(depths - 1, 0)
    parent = np.searchsorted(code, (up << 56) | (contexts & ((np.int64(1) << (8 * up)) - 1)))
    inner = np.zeros(len(code), bool)
    inner[parent[1:]] = True
    inner[0] = True
    number = np.empty(len(code), np.int64)
    number[np.argsort(~inner, kind="stable")] = np.arange(len(code))
    byte = contexts[1:] >> (8 * up[1:])
    near, width = columns(byte)
    child = np.full((int(inner.sum()) + 1, width), len(code), np.int32)
    child[number[parent[1:]], near[byte]] = number[1:]
    back = np.argsort(number)
    return {"child": child.ravel(), "near": near, "parent": number[parent][back].astype(np.int32), "level": depths[back].astype(np.int8)}


def columns(byte: np.ndarray) -> tuple[np.ndarray, int]:
    """A column for each byte that occurs and a last one for all others, and the number of columns."""
    seen = np.unique(byte)
    near = np.full(256, len(seen), np.int32)
    near[seen] = np.arange(len(seen))
    return near, len(seen) + 1


def largest(contexts: np.ndarray, depths: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of the largest counts, at most ``size`` of them; those that tie at the edge all stay out, so that a context's own shorter ones are always in."""
    if len(n) > size:
        least = np.sort(n)[-size - 1]
        contexts, depths = contexts[n > least], depths[n > least]
    return contexts, depths


def nodes(tree: dict[str, np.ndarray], near: list[np.ndarray]) -> np.ndarray:
    """The deepest node of each context; ``near`` has the last byte of every context, the one before it, and so on."""
    child, n, column = tree["child"], len(tree["parent"]), tree["near"]
    width = np.int32(column.max() + 1)  # some byte never stands in a context
    dead = len(child) // width - 1
    at = row = np.zeros(len(near[0]), np.int32)
    for b in near:
        step = child[row * width + column[b]]
        at = np.where(step < n, step, at)
        row = np.minimum(step, np.int32(dead))
    return at


_SMALL = {add: np.array([math.lgamma(k + add) for k in range(64)]) for add in (0.5, 1.0)}


def _gamma(n: np.ndarray, add: float) -> np.ndarray:
    """ln Gamma(n + add) of whole n: exact below 64, Stirling's series above."""
    small = _SMALL[add]
    x = np.maximum(n, 64) + add
    large = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < 64, small[np.minimum(n, 63).astype(np.int64)], large)


def bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones of the 255 bit positions, in heap order, of rows of 256 byte counts."""
    n = len(counts)
    pairs = [counts.reshape(n, 1 << k, 2, 128 >> k).sum(3) for k in range(8)]
    return np.concatenate([p[:, :, 0] for p in pairs], 1), np.concatenate([p[:, :, 1] for p in pairs], 1)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence of so many zeros and ones."""
    out, some = np.zeros(zeros.shape), zeros + ones > 0
    a, b = zeros[some], ones[some]
    out[some] = _gamma(a, 0.5) + _gamma(b, 0.5) - _gamma(a + b, 1.0) - math.log(math.pi)
    return out


def weigh(tree: dict[str, np.ndarray], node: np.ndarray, byte: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities of the bytes at every node, and each byte's column, from how often each byte ended at each node."""
    parent, level = tree["parent"], tree["level"]
    n, inner = len(parent), int(parent.max()) + 1
    deepest = int(level.max(initial=0))
    chunks = [np.array_split(np.flatnonzero(level == d), np.count_nonzero(level == d) // 4096 + 1) for d in range(deepest + 1)]
    below, total = np.zeros((inner, 255)), np.zeros((inner, 256))
    weight = np.ones((inner, 255), np.float32)

    def ended(own):
        place = np.full(n, -1)
        place[own] = np.arange(len(own))
        at = place[node]
        out = np.zeros((len(own), 256))
        out[at[at >= 0], byte[at >= 0]] = count[at >= 0]
        return out

    def everything(own, rest):
        some = own < inner
        out = rest.copy()
        out[some] += total[own[some]]
        return out

    for d in range(deepest, -1, -1):
        for own in chunks[d]:
            rest = ended(own)
            whole = everything(own, rest)
            estimate, some = log_kt(*bits(whole)), own < inner
            if some.any():
                has = own[some]
                split = math.log(0.5) + below[has] + log_kt(*bits(rest[some]))
                alone = math.log(0.5) + estimate[some]
                estimate[some] = np.logaddexp(alone, split)
                weight[has] = np.exp(alone - estimate[some])
            if d:
                order = np.argsort(parent[own], kind="stable")
                first = runs(parent[own][order])
                into = parent[own][order][first]
                below[into] += np.add.reduceat(estimate[order], first)
                total[into] += np.add.reduceat(whole[order], first)
    del below
    column, width = columns(byte)
    others = column == width - 1
    table = np.empty((n, width), np.float32)
    mixed, left = np.zeros((inner, 255), np.float32), np.ones((inner, 255), np.float32)
    for d in range(deepest + 1):
        for own in chunks[d]:
            rest = ended(own)
            zeros, ones = bits(everything(own, rest))
            before = parent[own]
            sure, free = (np.zeros((len(own), 255)), np.ones((len(own), 255))) if d == 0 else (mixed[before].astype(float), left[before].astype(float))
            w = np.ones((len(own), 255))
            some = own < inner
            w[some] = weight[own[some]]
            sure = sure + free * w * (ones + 0.5) / (zeros + ones + 1.0)
            free = free * (1 - w)
            mixed[own[some]], left[own[some]] = sure[some], free[some]
            zeros, ones = bits(rest)
            logs = _byte_logs(sure + free * (ones + 0.5) / (zeros + ones + 1.0))
            table[np.ix_(own, column[~others])] = logs[:, ~others]
            table[own, width - 1] = np.log10((10.0 ** logs[:, others]).mean(1)) if others.any() else 0.0
    return table.ravel(), column


def _byte_logs(one: np.ndarray) -> np.ndarray:
    """log10 probabilities of the 256 bytes from the 255 probabilities of a 1."""
    out = np.zeros((len(one), 1))
    for k in range(8):
        p = one[:, (1 << k) - 1 : (2 << k) - 1]
        out = np.stack([out + np.log10(1 - p), out + np.log10(p)], 2).reshape(len(one), 2 << k)
    return out


def text_scores(model: dict[str, np.ndarray], texts: list[bytes | None], depth: int = DEPTH) -> np.ndarray:
    """log10 probability of each text's words with its end."""
    return _scores(model, *lay([plain(t) for t in texts], depth), depth)


def _scores(model: dict[str, np.ndarray], data: np.ndarray, at: np.ndarray, sizes: np.ndarray, depth: int) -> np.ndarray:
    node = nodes(model, [data[at - k] for k in range(1, depth + 1)])
    width = len(model["table"]) // len(model["parent"])
    logs = model["table"][node.astype(np.int64) * width + model["column"][data[at]]]
    return np.add.reduceat(logs.astype(float), np.concatenate(([0], np.cumsum(sizes)[:-1]))) if len(sizes) else np.zeros(0)


# -- words


_BREAK = SPACE.copy()
_BREAK[END] = True


def words(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and keys of the words of a block laid out by :func:`lay`, and each text's first word (and the number of words)."""
    starts, ends = bounds(_BREAK[data])
    first = np.append(at[np.concatenate(([0], np.cumsum(sizes)[:-1]))], len(data)) if len(sizes) else np.zeros(1, np.int64)
    return starts, ends, keys(data, starts, ends), np.searchsorted(starts, first)


# -- Spark


@dataclass
class Model:
    """What scoring needs: the tree, its table and the head (keys, counts) as broadcasts, N, V, the end's count, and the table of all words' counts; the whole tree has ``whole``, its grams' counts by bucket, and the contexts above its roots as ``table``."""

    tree: Broadcast | None
    table: Broadcast | None
    head: Broadcast
    tokens: int
    distinct: int
    texts: int
    counts: DataFrame
    whole: DataFrame | None = None


def _gathered(depth: int, whole: bool, batches):
    """(gram, word, n): sums of the (depth + 1)-grams and of the words of the texts of a task; the empty word stands for the ends.  For the whole tree the grams go by bucket, as (bucket, part, counts, word, n)."""
    gram, held, word = [], 0, {}

    def grams_out(parts):
        k, n = counted(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        return k, n

    def batch(k, n, w=None):
        some = pa.array(w, pa.binary()) if w is not None else pa.nulls(len(n), pa.binary())
        if whole:
            return pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary()), pa.nulls(len(n), pa.binary()), some, pa.array(n, pa.int64())], schema=_GATHERED)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()) if k is not None else pa.nulls(len(n), pa.int64()), some, pa.array(n, pa.int64())], names=["gram", "word", "n"])

    def sent(k, n):
        if whole:
            for bucket, part, sums in dealt(k, n, depth):
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(part, pa.binary()), pa.array(sums, pa.binary()), pa.nulls(len(bucket), pa.binary()), pa.nulls(len(bucket), pa.int64())], schema=_GATHERED)
            return
        for start in range(0, len(k), SENT):
            yield batch(k[start : start + SENT].astype(np.int64), n[start : start + SENT])

    for given in batches:
        for part in blocks(given, 0):
            texts = [plain(t) for t in part.column(0).to_pylist()]
            data, at, sizes = lay(texts, depth)
            gram.append(counted((turned if whole else grams)(data, at, depth)))
            held += len(gram[-1][0])
            starts, ends, key, _ = words(data, at, sizes)
            order = np.argsort(key)
            sums = counted(key)[1]
            first = order[np.concatenate(([0], np.cumsum(sums)[:-1]))] if len(sums) else order
            lower = data.tobytes()
            for s, e, n in zip(starts[first].tolist(), ends[first].tolist(), sums.tolist(), strict=True):
                w = lower[s:e]
                word[w] = word.get(w, 0) + n
            word[b""] = word.get(b"", 0) + len(texts)
            if held > HELD:
                k, n = grams_out(gram)
                gram, held = [(k, n)], len(k)
                if held > HELD // 2:
                    yield from sent(k, n)
                    gram, held = [], 0
                del k, n
            if len(word) > HELD_WORDS:
                yield batch(None, list(word.values()), list(word))
                word = {}
    if gram:
        yield from sent(*grams_out(gram))
    if word:
        yield batch(None, list(word.values()), list(word))


def _arrays(df: DataFrame) -> list[np.ndarray]:
    table = df.toArrow()
    return [table.column(c).to_numpy() for c in table.column_names]


def _placed(tree: Broadcast, depth: int, batches):
    """(at, n): sums by node * 256 + byte of the grams of a task."""
    for batch in batches:
        gram = batch.column(0).to_numpy(zero_copy_only=False)
        node = nodes(tree.value, [(gram >> (8 * k)) & 255 for k in range(1, depth + 1)]).astype(np.int64)
        at, n = counted(node * 256 + (gram & 255), batch.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["at", "n"])


def _weighed(tree: Broadcast, batches):
    got = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    at = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int64)
    n = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.int64)
    table, column = weigh(tree.value, at >> 8, at & 255, n.astype(float))
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([column.tobytes()], pa.binary())], names=["start", "part"])
    for start in range(0, len(table), 1 << 20):
        yield pa.RecordBatch.from_arrays([pa.array([start], pa.int64()), pa.array([table[start : start + (1 << 20)].tobytes()], pa.binary())], names=["start", "part"])


def _head_keys(batches):
    for batch in batches:
        w = batch.column(0).to_pylist()
        data = np.frombuffer(b" " + b" ".join(w) + b" ", np.uint8)
        ends = np.cumsum([len(x) + 1 for x in w])
        yield pa.RecordBatch.from_arrays([pa.array(keys(data, ends - np.array([len(x) for x in w]), ends).view(np.int64), pa.int64()), batch.column(1)], names=["key", "n"])


# -- the whole tree

_GATHERED = pa.schema([("bucket", pa.int32()), ("part", pa.binary()), ("counts", pa.binary()), ("word", pa.binary()), ("n", pa.int64())])


def turned(data: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """As :func:`grams` with the nearest byte highest, so that grams of a context of any length stand together when sorted."""
    out = np.zeros(len(data) - depth, np.uint64)
    for k in [*range(1, depth + 1), 0]:
        out = (out << np.uint64(8)) | data[depth - k : len(data) - k]
    return out[at - depth]


def zipped(part: bytes) -> bytes:
    return len(part).to_bytes(8, "little") + pa.compress(part, "zstd", asbytes=True)


def unzipped(part: bytes) -> bytes:
    return pa.decompress(part[8:], int.from_bytes(part[:8], "little"), "zstd", asbytes=True)


def planes(values: np.ndarray, width: int) -> bytes:
    """Numbers of ``width`` bytes, all lowest bytes first, then the next ones, compressed."""
    return zipped(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unplanes(part: bytes, width: int) -> np.ndarray:
    part = unzipped(part)
    out = np.zeros((len(part) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(part, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def packed_texts(texts: list[bytes]) -> bytes:
    return zipped(np.array([len(texts), *map(len, texts)], np.int64).tobytes() + b"".join(texts))


def unpacked_texts(part: bytes) -> list[bytes]:
    whole = unzipped(part)
    sizes = np.frombuffer(whole, np.int64, int.from_bytes(whole[:8], "little"), 8)
    ends = 8 + 8 * len(sizes) + np.cumsum(sizes)
    return [whole[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def bucket_order(key: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of sorted turned grams by bucket, and where each bucket starts and the last ends."""
    bucket = (mix(key >> np.uint64(8 * (depth - min(ROOT, depth) + 1))) % np.uint64(BUCKETS)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(BUCKETS + 1))


def dealt(key: np.ndarray, n: np.ndarray | None, depth: int) -> Iterator[tuple[list[int], list[bytes], list[bytes]]]:
    """Buckets, their packed grams (sorted, as differences) and packed counts, some buckets at a time."""
    order, cut = bucket_order(key, depth)
    some = [b for b in range(BUCKETS) if cut[b + 1] > cut[b]]
    for start in range(0, len(some), 64):
        now = some[start : start + 64]
        places = [order[cut[b] : cut[b + 1]] for b in now]
        yield now, [planes(np.diff(key[o], prepend=np.uint64(0)), depth + 1) for o in places], [planes(n[o], 5) for o in places] if n is not None else []


def _grams(part: bytes, depth: int) -> np.ndarray:
    return np.cumsum(unplanes(part, depth + 1), dtype=np.uint64)


def _nodes(key: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the eight bits of a byte the nodes (context, bits before), sorted, with their zeros and ones; of sorted (context, byte) with counts."""
    out = []
    for k in range(8):
        node = key >> np.uint64(8 - k)
        first = runs(node)
        ones = np.where((key >> np.uint64(7 - k)) & np.uint64(1) == 1, n, 0.0)
        total, ones = (np.add.reduceat(v, first) if len(first) else v for v in (n, ones))
        out.append((node[first], total - ones, ones))
    return out


def _shorter(node: np.ndarray, k: int) -> np.ndarray:
    """Nodes of the contexts without their farthest byte."""
    return (node >> np.uint64(k + 8) << np.uint64(k)) | (node & np.uint64((1 << k) - 1))


def _levels(key: np.ndarray, n: np.ndarray, longest: int, shortest: int) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Nodes of all context lengths, the longest first."""
    out = [_nodes(key, n)]
    for _ in range(longest - shortest):
        key, n = counted((key >> np.uint64(16) << np.uint64(8)) | (key & np.uint64(255)), n)
        out.append(_nodes(key, n))
    return out


def _upward(levels, below=None) -> tuple[list, list, list]:
    """Each level's weights of the nodes' own estimates, where each node's shorter one is in the next level, and the logs of the last level.

    ``below`` has the sums of the children's logs of the first level, which has none without it.
    """
    weights, places, logs = [], [], []
    for d, level in enumerate(levels):
        estimate = [log_kt(zeros, ones) for _, zeros, ones in level]
        if below is None:
            weights.append([np.ones(len(e)) for e in estimate])
            logs = estimate
        else:
            alone = [math.log(0.5) + e for e in estimate]
            logs = [np.logaddexp(a, math.log(0.5) + b) for a, b in zip(alone, below, strict=True)]
            weights.append([np.exp(a - g) for a, g in zip(alone, logs, strict=True)])
        if d + 1 < len(levels):
            places.append([np.searchsorted(up[0], _shorter(own[0], k)) for k, (own, up) in enumerate(zip(level, levels[d + 1], strict=True))])
            below = [np.bincount(p, g, len(up[0])) for p, g, up in zip(places[-1], logs, levels[d + 1], strict=True)]
    return weights, places, logs


def _downward(levels, weights, places, sure, free) -> Iterator[tuple[list, list]]:
    """The levels' certain part of the probability of a 1 and the share that is left to longer contexts, shortest contexts first."""
    for d in range(len(levels) - 1, -1, -1):
        if d + 1 < len(levels):
            sure, free = ([v[p] for v, p in zip(values, places[d], strict=True)] for values in (sure, free))
        value = [(ones + 0.5) / (zeros + ones + 1.0) for _, zeros, ones in levels[d]]
        sure = [s + f * w * v for s, f, w, v in zip(sure, free, weights[d], value, strict=True)]
        free = [f * (1 - w) for f, w in zip(free, weights[d], strict=True)]
        yield sure, free


def _above(top: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]], roots) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What the contexts above the roots say of the roots' nodes; of nodes that training hasn't, what the longest context with them says."""
    sure, free = [], []
    for k, (node, _, _) in enumerate(roots):
        s, f, open_ = np.zeros(len(node)), np.ones(len(node)), np.ones(len(node), bool)
        for level in reversed(top):
            node = _shorter(node, k)
            have, surely, freely = level[k]
            if len(have):
                at = np.minimum(np.searchsorted(have, node), len(have) - 1)
                hit = open_ & (have[at] == node)
                s[hit], f[hit] = surely[at[hit]], freely[at[hit]]
                open_ &= ~hit
        sure.append(s)
        free.append(f)
    return sure, free


def gram_logs(key: np.ndarray, n: np.ndarray, top: list, depth: int) -> np.ndarray:
    """log10 probability of each gram's byte after its context, of sorted turned grams of whole buckets; grams that are only asked for have count 0, which changes no estimate."""
    levels = _levels(key, n, depth, min(ROOT, depth))
    weights, places, _ = _upward(levels)
    for one, free in _downward(levels, weights, places, *_above(top, levels[-1])):
        last = [s + f / 2 for s, f in zip(one, free, strict=True)]
    out = np.zeros(len(key))
    for k, (node, _, _) in enumerate(levels[0]):
        p = last[k][np.searchsorted(node, key >> np.uint64(8 - k))]
        out += np.log10(np.where((key >> np.uint64(7 - k)) & np.uint64(1) == 1, p, 1 - p))
    return out


def _groups(batches, columns: int) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of the same first column, which stand together: its value and the others'."""
    now, held = None, []
    for batch in batches:
        for first, *rest in zip(*[batch.column(c).to_pylist() for c in range(columns)], strict=True):
            if held and first != now:
                yield now, held
                held = []
            now = first
            held.append(rest)
    if held:
        yield now, held


_MERGED = "bucket int, part binary, counts binary, k int, node bigint, zeros double, ones double, below double"


def _merged(depth: int, batches):
    """The sums of each bucket's grams, and what its roots add to the nodes of contexts a byte shorter."""
    names = [c.split()[0] for c in _MERGED.split(", ")]
    for bucket, rows in _groups(batches, 3):
        key, n = counted(np.concatenate([_grams(part, depth) for part, _ in rows]), np.concatenate([unplanes(sums, 5) for _, sums in rows]).astype(float))
        levels = _levels(key, n, depth, min(ROOT, depth))
        logs = _upward(levels)[2]
        for k, ((node, zeros, ones), log) in enumerate(zip(levels[-1], logs, strict=True)):
            up, at = np.unique(_shorter(node, k), return_inverse=True)
            sums = [np.bincount(at, v, len(up)) for v in (zeros, ones, log)]
            m = len(up)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), pa.array(np.full(m, k), pa.int32()), pa.array(up.astype(np.int64)), *map(pa.array, sums)], names=names)
        packed = [planes(np.diff(key, prepend=np.uint64(0)), depth + 1), planes(n, 5)]
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([p], pa.binary()) for p in packed], pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.float64())] * 3], names=names)


def _topped(longest: int, batches):
    """(length, k, nodes, sure, free) of the contexts of at most ``longest`` bytes."""
    got = [[b.column(c).to_numpy(zero_copy_only=False) for c in range(5)] for b in batches]
    if not got:
        return
    k, node, zeros, ones, below = (np.concatenate(c) for c in zip(*got, strict=True))
    order = np.argsort(node)
    first, under = [], []
    for j in range(8):
        own = order[k[order] == j]
        first.append((node[own].astype(np.uint64), zeros[own], ones[own]))
        under.append(below[own])
    levels = [first]
    for _ in range(longest):
        level = []
        for j, (own, a, b) in enumerate(levels[-1]):
            up, at = np.unique(_shorter(own, j), return_inverse=True)
            level.append((up, np.bincount(at, a, len(up)), np.bincount(at, b, len(up))))
        levels.append(level)
    weights, places, _ = _upward(levels, under)
    start = [[f(len(own[0])) for own in levels[-1]] for f in (np.zeros, np.ones)]
    for length, (sure, free) in enumerate(_downward(levels, weights, places, *start)):
        for j, (own, s, f) in enumerate(zip(levels[longest - length], sure, free, strict=True)):
            yield pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), pa.array([j], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (own[0], s, f)]], names=["length", "k", "nodes", "sure", "free"])


def _by(df: DataFrame, first: str, *then: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), first).sortWithinPartitions(first, *then)


def _whole(first: DataFrame, depth: int, folder: str) -> tuple[DataFrame, Broadcast]:
    """The grams' sums by bucket, and the contexts above the roots: a list a length of (nodes, sure, free) for each of the eight bits."""
    spark, above = first.sparkSession, min(ROOT, depth) - 1
    merged = written(_by(first.where("bucket is not null").select("bucket", "part", "counts"), "bucket").mapInArrow(partial(_merged, depth), _MERGED), f"{folder}/merged")
    nodes_ = merged.where("bucket is null").groupBy("k", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    table = written(nodes_.repartition(1).mapInArrow(partial(_topped, above), "length int, k int, nodes binary, sure binary, free binary"), f"{folder}/top")
    none = (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    top = [[none] * 8 for _ in range(above + 1)]
    for row in table.toLocalIterator():
        top[row.length][row.k] = (np.frombuffer(row.nodes, np.uint64), np.frombuffer(row.sure), np.frombuffer(row.free))
    return merged.where("bucket is not null").select("bucket", "part", "counts"), spark.sparkContext.broadcast(top)


def _answered(top: Broadcast, depth: int, batches):
    """(block, bucket, logs): the logs of the grams that each block asked of a bucket; a bucket's sums, without a block, and its questions stand together."""
    for bucket, rows in _groups(batches, 4):
        key, n = np.zeros(0, np.uint64), np.zeros(0)
        asked = np.zeros(0, np.uint64)
        parts, held = [], 0
        for block, part, sums in rows:
            if block is None:
                key, n = _grams(part, depth), unplanes(sums, 5).astype(float)
                continue
            parts.append(_grams(part, depth))
            held += len(parts[-1])
            if held > HELD:
                asked = counted(np.concatenate([asked, *parts]))[0]
                parts, held = [], 0
        asked = counted(np.concatenate([asked, *parts]))[0]
        key, n = counted(np.concatenate([key, asked]), np.concatenate([n, np.zeros(len(asked))]))
        sent = np.minimum(np.rint(gram_logs(key, n, top.value, depth) * -STEPS), float((1 << 40) - 1)).astype(np.uint64)
        for block, part, _ in rows:
            if block is not None:
                out = planes(sent[np.searchsorted(key, _grams(part, depth))], 5)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([out], pa.binary())], names=["block", "bucket", "logs"])


def _summed(depth: int, batches):
    """(row, whole): the logs of each text, from a block's texts (without a bucket) and the logs of its grams by bucket."""
    for _, rows in _groups(batches, 4):
        logs, parts = [], []
        for bucket, part, row in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
            logs.append(unplanes(part, 5))
        for bucket, part, row in rows:
            if bucket is None:
                data, at, sizes = lay(unpacked_texts(part), depth)
                key = turned(data, at, depth)
                order = np.argsort(key)
                first = runs(key[order])
                place = np.empty(len(key), np.int32)
                place[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(key))))
                parts.append((row, key[order[first]], place, sizes))
        if not parts:
            continue
        key = counted(np.concatenate([p[1] for p in parts]))[0]
        log = np.empty(len(key))
        log[bucket_order(key, depth)[0]] = np.concatenate(logs) / -STEPS
        for row, own, place, sizes in parts:
            each = log[np.searchsorted(key, own)][place]
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(sizes)), pa.int64()), pa.array(np.add.reduceat(each, np.concatenate(([0], np.cumsum(sizes)[:-1]))))], names=["row", "whole"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, size: int | None = SIZE, head: int = HEAD) -> Model:
    """The model of the texts outside the held-out fold (crc32 of the id modulo 7 is 2).

    One pass over the texts gives the table of gram and word counts in the shared folder.  To the driver come contexts with one
    in 4 * ``size`` of the training bytes, at most that many a depth, of which the tree takes ``size``; its table; and at most ``head`` word keys with their counts.
    Without a ``size`` the tree has all contexts, and only the word keys and the contexts of under ROOT bytes come to the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark)
    learned = docs.where(F.col(id_col).isNotNull() & (fold(id_col, 7) != 2)).select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    if size is None:
        first = written(learned.mapInArrow(partial(_gathered, depth, True), "bucket int, part binary, counts binary, word binary, n bigint"), f"{folder}/first")
        word = written(first.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), f"{folder}/counts")
        tree, (whole, table) = None, _whole(first, depth, folder)
        drop_path(spark, f"{folder}/first")
    else:
        sums = learned.mapInArrow(partial(_gathered, depth, False), "gram bigint, word binary, n bigint")
        counts = written(sums.groupBy("gram", "word").agg(F.sum("n").alias("n")), f"{folder}/counts")
        gram, word = counts.where("gram is not null").select("gram", "n"), counts.where("word is not null").select("word", "n")
        whole, (tree, table) = None, _bounded(gram, depth, size, folder)
    tokens, distinct, texts = word.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.octet_length("word") == 0, F.col("n"))), F.lit(0))).first()
    often = word.where((F.octet_length("word").between(1, HEAD_BYTES)) & (F.col("n") >= F.lit(tokens / head))).mapInArrow(_head_keys, "key bigint, n bigint")
    key, n = _arrays(often)
    order = np.argsort(key.view(np.uint64))
    return Model(tree, table, spark.sparkContext.broadcast((key.view(np.uint64)[order], n[order])), tokens, distinct, texts, word, whole)


def _bounded(gram: DataFrame, depth: int, size: int, folder: str) -> tuple[Broadcast, Broadcast]:
    """The tree of the most frequent contexts and its table."""
    spark = gram.sparkSession
    longest = written(gram.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("n")), f"{folder}/contexts")
    least = (longest.agg(F.sum("n")).first()[0] or 0) / (4 * size)
    found = None
    for d in range(1, depth + 1):
        cut = longest.groupBy(F.col("context").bitwiseAND(F.lit((1 << (8 * d)) - 1)).alias("context")).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("context", F.lit(d).cast("bigint").alias("depth"), "n")
        found = cut if found is None else found.unionByName(cut)
    tree = spark.sparkContext.broadcast(grow(*largest(*_arrays(found), size)))
    placed = gram.mapInArrow(partial(_placed, tree, depth), "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    table = written(placed.repartition(1).mapInArrow(partial(_weighed, tree), "start bigint, part binary"), f"{folder}/table")
    parts = sorted(table.toLocalIterator()) or [(-1, np.zeros(256, np.int32)), (0, np.full(len(tree.value["parent"]), np.log10(1 / 256), np.float32))]
    table = spark.sparkContext.broadcast(b"".join(bytes(part) for _, part in parts))
    return tree, table


_FIELDS = "held_out boolean, row bigint, n_tokens bigint, known bigint, logs double, score double, rest array<binary>, block bigint, bucket int, part binary"


def _scored(tree: Broadcast | None, table: Broadcast, often: Broadcast, end: float, depth: int, batches):
    """A row a text; for the whole tree also a block's texts (without a bucket) and the grams that it asks of each bucket, which have a block."""
    model, (head, n) = tree and tree.value | {"column": np.frombuffer(table.value, np.int32, 256), "table": np.frombuffer(table.value, np.float32, offset=1024)}, often.value
    seen, mark, schema = 0, TaskContext.get().partitionId() << 40, None
    heads, logs = np.append(head, np.uint64(0)), np.append(np.log10(n + 1.0), 0.0)
    block, asked, held = mark, [], 0

    def extra(bucket, part, row):
        rows = len(part)
        some = [pa.nulls(rows, f.type) for f in schema]
        some[2], some[8], some[9], some[10] = pa.array(row, pa.int64()), pa.array([block] * rows, pa.int64()), pa.array(bucket, pa.int32()), pa.array(part, pa.binary())
        return pa.RecordBatch.from_arrays(some, schema=schema)

    def questions():
        for bucket, part, _ in dealt(counted(np.concatenate(asked))[0], None, depth):
            yield extra(bucket, part, [None] * len(part))

    for given in batches:
        for part in blocks(given, 2):
            texts = [plain(t) for t in part.column(2).to_pylist()]
            data, at, sizes = lay(texts, depth)
            score = _scores(model, data, at, sizes, depth) if model else np.zeros(len(sizes))
            starts, ends, key, first = words(data, at, sizes)
            place = np.searchsorted(head, key)
            hit = (heads[place] == key) & (place < len(head))
            upto = np.concatenate(([0.0], np.cumsum(np.where(hit, logs[place], 0.0))))
            tail = np.flatnonzero(~hit)
            lower = data.tobytes()
            tail_words = [lower[s:e] for s, e in zip(starts[tail].tolist(), ends[tail].tolist(), strict=True)]
            offsets = np.searchsorted(tail, first)
            rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tail_words, pa.binary()))
            known = np.diff(np.concatenate(([0], np.cumsum(hit)))[first]) + (end > 0)
            rows = len(texts)
            made = [pa.array(mark + seen + np.arange(rows), pa.int64()), pa.array(np.diff(first) + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(np.diff(upto[first]) + end, pa.float64()), pa.array(score, pa.float64()), rest, pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())]
            names = ("row", "n_tokens", "known", "logs", "score", "rest", "block", "bucket", "part")
            schema = schema or pa.schema([part.schema[0], part.schema[1], *[pa.field(n, a.type) for n, a in zip(names, made, strict=True)]])
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *made], schema=schema)
            if not model:
                yield extra([None], [packed_texts(texts)], [mark + seen])
                asked.append(counted(turned(data, at, depth))[0])
                held += len(data)
                if held >= ASKED_BYTES:
                    yield from questions()
                    block, asked, held = block + 1, [], 0
            seen += rows
    if asked:
        yield from questions()


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score, and bits_per_byte (of the text and its end).

    The texts are read once; what that pass gives is written to the shared folder, and words outside the head are joined to their counts from there.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(id_col).alias("__id"), (fold(id_col, 7) == 2).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = source.schema["__id"].dataType.simpleString()
    kernel = partial(_scored, model.tree, model.table, model.head, math.log10(model.texts + 1), depth)
    once = written(source.mapInArrow(kernel, f"__id {kind}, {_FIELDS}"), f"{shared_dir(spark)}/scored")
    asked, once = once.where("block is not null").select("block", "bucket", "part", "row"), once.where("block is null").drop("block", "bucket", "part")
    rest = once.select("row", F.explode("rest").alias("word")).join(model.counts.select("word", "n"), "word")
    rest = rest.groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("more_logs"))
    out = once.drop("rest").join(rest, "row", "left")
    if model.whole is not None:
        both = model.whole.select("bucket", F.lit(None).cast("bigint").alias("block"), "part", "counts").unionByName(asked.where("bucket is not null").select("bucket", "block", "part", F.lit(None).cast("binary").alias("counts")))
        answers = _by(both, "bucket").mapInArrow(partial(_answered, model.table, depth), "block bigint, bucket int, logs binary")
        texts = asked.where("bucket is null").select("block", "bucket", "part", "row")
        both = answers.select("block", "bucket", F.col("logs").alias("part"), F.lit(None).cast("bigint").alias("row")).unionByName(texts)
        whole = _by(both, "block").mapInArrow(partial(_summed, depth), "row bigint, whole double")
        out = out.drop("score").join(whole, "row").withColumnRenamed("whole", "score")
    each = math.log10(model.tokens + model.distinct + 1)
    return out.select(
        F.col("__id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score",
    )
