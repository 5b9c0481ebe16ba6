"""Phrase mining against a dictionary brute force, the registered SQL, and odd tables."""

from __future__ import annotations

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tagforge.llm import phrases, queries
from tests.llm.test_operators import ODD, SCHEMA


def brute_force(rows, support, top, longest=4):
    counts = {}
    for lang, text in rows:
        c = counts.setdefault(lang or "und", Counter())
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            c.update(tuple(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    out = []
    for lang, c in counts.items():
        n = sum(f for w, f in c.items() if len(w) == 1)
        found = {w: a for w, a in c.items() if len(w) > 1 and a >= support}
        inside = {}
        for w, a in found.items():
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    inside[w[i : i + m]] = max(a, inside.get(w[i : i + m], 0))
        kept = []
        for w, a in found.items():
            if 100 * inside.get(w, 0) >= 80 * a:
                continue
            score, k = min((2_000_000 * a // (c[w[:k]] + c[w[k:]]), k) for k in range(1, len(w)))
            kept.append((-score, -a, " ".join(w).encode(), c[w[:k]], c[w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    words = ["Alpha", "beta", "été", "x", "the", "of", "\U0001f600"]
    glue = [" ", " ", " ", "  ", "\t", ", ", ".\n", "!?", "\r"]
    made = [("en" if k % 3 else None, "".join(str(rng.choice(words)) + str(rng.choice(glue)) for _ in range(400))) for k in range(12)]
    return [*made, ("fr", "a a a a a a a a " * 20), ("fr", "b c\x0bb c d b c d e"), ("de", None), ("de", ""), ("de", "z\x00z q\xa0q " * 40), *[("es", "same thing again")] * 40]


@pytest.mark.parametrize("slots", [1 << 16, 1 << 20])
def test_brute_force_also_in_a_full_sketch(spark, texts, slots):
    docs = spark.createDataFrame([(t, lang) for lang, t in texts], "text string, lang string")
    got = phrases.mine(docs, slots=slots, top=50).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == brute_force(texts, 30, 50)


@pytest.mark.parametrize("support", [2, 300])
def test_other_supports(spark, texts, support):
    docs = spark.createDataFrame([(t, lang) for lang, t in texts], "text string, lang string").repartition(3)
    assert sorted(map(tuple, phrases.mine(docs, support=support, slots=1 << 17).select(COLUMNS).collect())) == brute_force(texts, support, 2000)


def test_query_equals_sql(spark, sf):
    got = queries.QUERIES["op13_phrase_mining"](spark, sf)
    assert got.columns == COLUMNS and {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(queries.ORACLE_SQL["op13_phrase_mining"]).fetchall())


def test_odd_tables(spark):
    odd = spark.createDataFrame(ODD, SCHEMA)
    for c in ("phrase", "n", "slot", "a", "words"):
        odd = odd.selectExpr("*", f"'x' AS {c}")
    got = phrases.mine(odd, slots=1 << 16).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == brute_force([(r[2], r[1]) for r in ODD], 30, 2000)
    assert phrases.mine(odd.where("false"), slots=1 << 16).collect() == []


def test_shards_hold_a_bounded_size(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "SHARD_BYTES", 100)
    batch = pa.RecordBatch.from_arrays([pa.array([f"l{k % 40}" for k in range(4000)]), pa.array([b"x" * 30] * 4000)], names=["lang", "text"])
    got = list(phrases._shards([batch]))
    assert sum(len(t) for _, t in got) == 4000 and max(sum(map(len, t)) for _, t in got) <= 300


def test_rare_phrases_beyond_the_old_sketch_do_not_pass():
    """Four counters' worth of rare phrases for each of 2 x 2^16 counters let nearly all of them through; blocks hold them apart, and only the keys that pass are in the filter."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    often = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    batches = []
    for _ in range(6):
        key = np.concatenate((rng.integers(0, 1 << 63, 300_000, dtype=np.uint64), np.repeat(often, 5)))
        packed = list(phrases._packed(*[a.astype(t) for a, t in zip(np.unique(phrases._short(key), return_counts=True), (np.uint64, np.uint8), strict=True)]))
        assert sum(n for _, n, _ in packed) == len(np.unique(phrases._short(key)))
        batches += packed
    batches.sort(key=lambda p: p[0])
    rows = pa.RecordBatch.from_arrays([pa.array([p[0] for p in batches], pa.int32()), pa.array([p[2] for p in batches], pa.binary())], names=["slot", "part"])
    passes = lambda slots: {k for b in phrases._passed(slots, 30, [rows.slice(i, 97) for i in range(0, rows.num_rows, 97)]) for part in b.column(2).to_pylist() for k in np.frombuffer(part, np.uint64).tolist()}
    assert passes(1 << 26) == set(phrases._short(often).tolist())
    assert len(passes(1 << 16)) > 100_000
    assert all(8 * n <= phrases._room(n) <= 16 * n and phrases._room(n) % 8 == 0 for n in (1, 50, 1 << 20, (1 << 20) + 1))


def test_default_sketch_is_held_by_no_task(spark, texts):
    """2^32 counters a row: a task that held them, or a broadcast of their bits, would not fit."""
    docs = spark.createDataFrame([(t, lang) for lang, t in texts], "text string, lang string").repartition(3)
    assert sorted(map(tuple, phrases.mine(docs, slots=1 << 32, top=50).select(COLUMNS).collect())) == brute_force(texts, 30, 50)
