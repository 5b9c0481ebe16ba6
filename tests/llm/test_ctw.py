"""Context-tree weighting against a recursive brute force, the base against dictionaries, and odd tables."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from tagforge.llm import ctw, queries, words
from tests.llm.test_operators import ODD, SCHEMA


def brute_force(train, depth):
    """log10 probability of a text by recursion over contexts, one bit position at a time."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)
    pad = bytes([255]) * depth
    for t in train:
        seq = pad + t + b"\xff"
        for i in range(depth, len(seq)):
            for d in range(depth + 1):
                context, bit = seq[i - d : i], 1
                for k in range(7, -1, -1):
                    counts[context, bit][seq[i] >> k & 1] += 1
                    bit = bit * 2 + (seq[i] >> k & 1)
                if d < depth:
                    children[context].add(seq[i - d - 1 : i])

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) if a + b else 0.0

    def weighted(context, bit, memo):
        if context not in memo:
            own = kt(*counts[context, bit])
            if len(context) < depth and children[context]:
                own = np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(weighted(c, bit, memo) for c in children[context]))
            memo[context] = own
        return memo[context]

    memos = defaultdict(dict)

    def one(seq, i, bit, d=0):
        context = seq[i - d : i]
        a, b = counts[context, bit] if (context, bit) in counts else (0, 0)
        own = (b + 0.5) / (a + b + 1)
        if d == depth or not children[context]:
            return own
        w = math.exp(math.log(0.5) + kt(a, b) - weighted(context, bit, memos[bit]))
        deeper = seq[i - d - 1 : i]
        return w * own + (1 - w) * (one(seq, i, bit, d + 1) if deeper in children[context] else 0.5)

    def score(text):
        seq, total = pad + text + b"\xff", 0.0
        for i in range(depth, len(seq)):
            bit = 1
            for k in range(7, -1, -1):
                x = seq[i] >> k & 1
                p = one(seq, i, bit)
                total += math.log10(p if x else 1 - p)
                bit = bit * 2 + x
        return total

    return score


def model(train, depth, size=1 << 16):
    k, n = words.counted(np.concatenate([ctw.grams(*ctw.lay([t], depth)[:2], depth) for t in train]))
    context = (k >> np.uint64(8)).astype(np.int64)
    found = [words.counted(context & ((1 << 8 * d) - 1), n) for d in range(1, depth + 1)]
    found = [(f[0][f[1] >= n.sum() / (4 * max(size, 1))], f[1][f[1] >= n.sum() / (4 * max(size, 1))]) for f in found]
    tree = ctw.grow(*ctw.largest(np.concatenate([f[0] for f in found]), np.repeat(np.arange(1, depth + 1), [len(f[0]) for f in found]), np.concatenate([f[1] for f in found]), size))
    node = ctw.nodes(tree, [(context >> (8 * j)) & 255 for j in range(depth)])
    at, n = words.counted(node.astype(int) * 256 + (k & np.uint64(255)).astype(int), n)
    table, column = ctw.weigh(tree, at >> 8, at & 255, n.astype(float))
    return tree | {"table": table, "column": column}


TRAIN = [b"the cat sat on the mat", b"the dog sat on the log", "café au lait".encode(), b"", b"the cat sat"]


@pytest.mark.parametrize("depth", [1, 3])
def test_scores_by_recursion(depth):
    score, got = brute_force(TRAIN, depth), model(TRAIN, depth)
    for text in (b"the cat", b"a goat", b"", "café".encode(), b"on the mat the log"):
        assert ctw.text_scores(got, [text], depth)[0] == pytest.approx(score(text), rel=1e-5)


@pytest.mark.parametrize("size", [0, 5, 40, 1 << 16])
def test_probabilities_sum_to_one_in_trees_of_any_size(size):
    got = model(TRAIN, 4, size)
    assert len(got["parent"]) <= size + 1
    p = 10.0 ** got["table"].reshape(len(got["parent"]), -1).astype(float)
    others = (got["column"] == got["column"].max()).sum()
    np.testing.assert_allclose(p[:, :-1].sum(1) + others * p[:, -1], 1, rtol=1e-5)


def test_blocks_do_not_change_scores():
    got, texts = model(TRAIN, 3), [b"The  cat\n", None, b"", b"dog " * 3000, b"sat"]
    whole = ctw.text_scores(got, texts, 3)
    np.testing.assert_allclose(whole, [ctw.text_scores(got, [t], 3)[0] for t in texts], rtol=1e-9)
    assert whole[0] == pytest.approx(ctw.text_scores(got, [b"the cat"], 3)[0]) and whole[1] == whole[2]


def base(docs):
    docs = docs.assign(w=[(t or "").encode().lower().split() for t in docs.text.where(docs.text.notna(), None)])
    held = docs.doc_id.map(lambda i: not pd.isna(i) and zlib.crc32(str(int(i)).encode()) % 7 == 2)
    c = Counter()
    for w in docs.w[~held & docs.doc_id.notna()]:
        c.update([*w, b""])
    n, v = sum(c.values()), len(c)
    rows = [(len(w) + 1, sum(c[x] > 0 for x in [*w, b""]), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, b""])) for w in docs.w]
    return docs.assign(held_out=held, **dict(zip(("n_tokens", "n_known", "train_tokens", "base_score"), zip(*rows, strict=True), strict=True)))


@pytest.mark.parametrize("head", [1 << 20, 50])
def test_base_and_held_out_gain(spark, sf, head):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = ctw.score(docs, ctw.train(docs, head=head)).toPandas().sort_values("doc_id", ignore_index=True)
    want = base(pd.read_parquet(f"{sf}/documents.parquet")).sort_values("doc_id", ignore_index=True)
    for c in ("held_out", "n_tokens", "n_known", "train_tokens"):
        assert (got[c] == want[c]).all(), c
    np.testing.assert_allclose(got.base_score, want.base_score, rtol=1e-9)
    per_byte = -got.score / math.log10(2) / [len(ctw.plain(t.encode())) + 1 for t in want.text]
    assert per_byte[got.held_out].median() < 2.6


def test_query_equals_local_model(spark, sf):
    got = queries.QUERIES["op11_context_tree_lm"](spark, sf).toPandas().sort_values("doc_id", ignore_index=True)
    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id", ignore_index=True)
    train = [ctw.plain(t.encode()) for i, t in zip(docs.doc_id, docs.text, strict=True) if zlib.crc32(str(i).encode()) % 7 != 2]
    np.testing.assert_allclose(got.score, ctw.text_scores(model(train, ctw.DEPTH), [t.encode() for t in docs.text]), rtol=1e-9)


def test_odd_tables(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    for c in ("row", "word", "score", "n", "known"):
        odd = odd.selectExpr("*", f"'x' AS {c}")
    got = ctw.score(odd, ctw.train(odd)).toPandas()
    want = base(odd.select("doc_id", "text").toPandas())
    assert len(got) == len(ODD) and sorted(got.n_tokens) == sorted(want.n_tokens) and sorted(got.n_known) == sorted(want.n_known)
    np.testing.assert_allclose(np.sort(got.base_score), np.sort(want.base_score))
    empty = ctw.score(odd.where("false"), ctw.train(odd.where("false")))
    assert empty.count() == 0
    alone = ctw.score(odd, ctw.train(odd.where("false"))).where("doc_id = 2").first()
    assert (alone.n_known, alone.train_tokens, alone.base_score) == (0, 0, 0.0) and alone.score == pytest.approx(-8 * math.log10(2), rel=1e-6)


def test_whole_tree_drops_no_context(spark):
    """Without a size the scores are those of the recursion over all contexts, which a bounded tree's are not."""
    texts = [t.decode() for t in TRAIN] + ["The cat", "a goat", None, "zebra  on the log", "the cat sat on the mat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    score = brute_force([ctw.plain((t or "").encode()) for i, t in enumerate(texts) if not held(i)], 3)
    want = [score(ctw.plain((t or "").encode())) for t in texts]
    got, some = (ctw.score(docs, ctw.train(docs, depth=3, size=size), depth=3).toPandas().sort_values("doc_id") for size in (None, 20))
    assert got.held_out.any() and list(got.columns) == list(some.columns)
    np.testing.assert_allclose(got.score, want, rtol=1e-9)
    assert not np.allclose(some.score, want, rtol=1e-3)
    np.testing.assert_allclose(got.base_score, some.base_score)
    odd = spark.createDataFrame(ODD, SCHEMA)
    assert ctw.score(odd, ctw.train(odd, size=None)).count() == len(ODD)
    untrained = ctw.score(docs, ctw.train(docs.where("false"), size=None)).where("doc_id = 3").first()
    assert untrained.score == pytest.approx(-8 * math.log10(2))


@pytest.mark.parametrize("depth", [1, 2, 5])
def test_whole_tree_of_other_depths(spark, depth):
    """Subtrees below their roots, trees of roots alone, and grams that only held-out texts have."""
    texts = [t.decode() for t in TRAIN] + ["The cat", "a goat", None, "zebra  on the log", "the cat sat on the mat", "\x00 \U0001f600", "the the the the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    score = brute_force([ctw.plain((t or "").encode()) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2], depth)
    got = ctw.score(docs, ctw.train(docs, depth=depth, size=None), depth=depth).toPandas().sort_values("doc_id")
    np.testing.assert_allclose(got.score, [score(ctw.plain((t or "").encode())) for t in texts], rtol=1e-9)


def test_query_drops_no_context(spark, sf, tmp_path):
    """The query's tree has all contexts, more than the bounded tree's 65,536."""
    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id").head(40)
    docs.to_parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_context_tree_lm"](spark, str(tmp_path)).toPandas().set_index("doc_id").score
    train = [ctw.plain((t or "").encode()) for i, t in zip(docs.doc_id, docs.text, strict=True) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert sum(len({t[max(0, i - d) : i] for t in train for i in range(len(t))}) for d in range(1, ctw.DEPTH + 1)) > ctw.SIZE
    score = brute_force(train, ctw.DEPTH)
    some = docs[docs.text.str.len().between(1, 1500)].head(6)
    np.testing.assert_allclose(got[some.doc_id], [score(ctw.plain(t.encode())) for t in some.text], rtol=1e-9)
