"""Phrase collocations per language: candidates from a count-min sketch, exact counts by Aho-Corasick automata over shards.

Text is lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs.  A phrase is 2 to
``longest`` words in a row within a piece.

1. One pass counts the words of every language exactly and sends the counts of all phrases' 41-bit keys, sorted and by differences, to
   BLOCKS blocks.  A block is a sketch of its own, of two rows of counters, 8 to 16 a key sent up to ``slots`` / BLOCKS, which bounds every
   count from above; a task holds one block at a time, so the sketch can be as large as billions of different phrases ask for.
2. What is left is a filter of the keys whose counters reach the support, two rows of 8 to 16 bits a key.  That is all that is broadcast.
3. A second pass works on shards of a few megabytes of one language.  The phrases of a shard that the sketch, and so each of their
   parts, lets through are compiled, with a space at each end as guard, into an automaton; it scans the shard and counts
   overlapping matches.  Sums over all shards are exact for every phrase whose total reaches the support, as such a phrase
   is a candidate wherever it stands.  So no task holds the candidates of the whole corpus.
4. Phrases below the support go; cuts, containment and ranks are joins on the table that is left.

The sketch has a fixed size.  In a corpus that fills it, some hundred GB, more candidates are counted than are needed; results stay exact.

Null texts are empty, a null language is ``und``.  Repeated rows count as often as they stand there.  Very long texts are whole pieces of a
shard of their own size.  Ties are ranked by count and then phrase.  An empty table gives an empty result.  Columns other than text and language are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagforge.llm.common import shared_dir, written
from tagforge.llm.words import bounds, counted, keys, mix
from tagforge.session import ship

LONGEST = 4
SUPPORT = 30
SLOTS = 1 << 32
#: Parts of the key space and of the sketch.
BLOCKS = 1 << 9
#: Phrases that a task holds before it sends the counts of their keys.
HELD_KEYS = 1 << 21
#: Bytes of text of one language that are counted together.
SHARD_BYTES = 2 << 20
#: Distinct words or phrases that a task holds before it sends its sums.
HELD = 1 << 18
TOP = 2000
SCALE = 2_000_000
#: A phrase goes if a longer one that contains it has this percentage of its count.
CONTAINED = 80

_TABLE = bytearray(range(256))
_TABLE[65:91] = range(97, 123)
_TABLE[9] = 32
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = 10
_TABLE = bytes(_TABLE)


def plain(texts: list[bytes]) -> bytes:
    """The texts with one space between words, and a line break between spaces between pieces; a space at each end."""
    out = (b"\n" + b"\n".join(texts) + b"\n").translate(_TABLE).replace(b"\n", b" \n ")
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


def phrase_keys(data: np.ndarray, language: str, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Starts and ends of the words, and for each length the keys of the phrases and the words that they start at."""
    starts, ends = bounds((data == 32) | (data == 10))
    word = keys(data, starts, ends)
    near = starts[1:] - ends[:-1] == 1
    key, at = [word + np.uint64(zlib.crc32(language.encode()))], [np.arange(len(word))]
    for _ in range(1, longest):
        last, first = key[-1], at[-1]
        tail = first + len(key)
        ok = tail < len(word)
        ok[ok] = near[tail[ok] - 1]
        at.append(first[ok])
        key.append(mix(last[ok] * np.uint64(0x9E3779B97F4A7C15) + word[tail[ok]]))
    return starts, ends, key, at


def _short(key: np.ndarray) -> np.ndarray:
    """The 41 bits of a key that the sketch tells phrases apart by: the block's number above, 32 bits below."""
    return ((key % np.uint64(BLOCKS)) << np.uint64(32)) | (key >> np.uint64(32))


def _slots(short: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
    """A phrase's places in its block's two rows of ``each``."""
    rest = short & np.uint64(0xFFFFFFFF)
    return (rest % np.uint64(each)).astype(np.int64), ((rest * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(each)).astype(np.int64)


def _room(n: int) -> int:
    """8 to 16 places a key, a power of two."""
    return 1 << max(8 * n - 1, 7).bit_length()


def _packed(key: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(block, keys, part) of different sorted keys with their counts: differences of the keys by byte planes, which compress, and the counts."""
    rest, cut = key.astype(np.uint32), np.searchsorted(key, np.arange(BLOCKS + 1, dtype=np.uint64) << np.uint64(32))
    for block, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
        if b > a:
            step = np.diff(rest[a:b], prepend=np.uint32(0))
            yield block, b - a, step.view(np.uint8).reshape(-1, 4).T.tobytes() + n[a:b].tobytes()


def _unpacked(part: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys without their block, and counts."""
    size = len(part) // 5
    step = np.ascontiguousarray(np.frombuffer(part, np.uint8, 4 * size).reshape(4, size).T).view(np.uint32).ravel()
    return np.cumsum(step, dtype=np.uint32).astype(np.uint64), np.frombuffer(part, np.uint8, size, 4 * size)


def _shards(batches) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of a task by language, about SHARD_BYTES at a time; no more than sixteen times that is held."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            for language, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                held.setdefault(language, []).append(text)
                size[language] = size.get(language, 0) + len(text)
                if size[language] >= SHARD_BYTES:
                    yield language, held.pop(language)
                    del size[language]
            while sum(size.values()) > 16 * SHARD_BYTES:
                most = max(size, key=size.get)
                del size[most]
                yield most, held.pop(most)
    yield from held.items()


_COUNTS = "lang string, phrase binary, words int, n bigint, slot int, part binary"
_ARROW = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("words", pa.int32()), ("n", pa.int64()), ("slot", pa.int32()), ("part", pa.binary())])


def _flush(held: dict[tuple[str, bytes], int], words: int) -> pa.RecordBatch:
    nothing = len(held)
    batch = pa.RecordBatch.from_arrays([
        pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.binary()), pa.array([words or k[1].count(b" ") + 1 for k in held], pa.int32()),
        pa.array(list(held.values()), pa.int64()), pa.nulls(nothing, pa.int32()), pa.nulls(nothing, pa.binary()),
    ], schema=_ARROW)
    held.clear()
    return batch


def _keys_out(held: list[np.ndarray], top: int) -> Iterator[pa.RecordBatch]:
    """Packed counts of the keys held, which are dropped, a few blocks a batch."""
    key = np.concatenate(held)
    held.clear()
    key, n = counted(key)
    packed = list(_packed(key, np.minimum(n, top).astype(np.uint8)))
    del key, n
    for start in range(0, len(packed), BLOCKS // 8):
        block, _, part = zip(*packed[start : start + BLOCKS // 8], strict=True)
        rows = len(block)
        yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.string()), pa.nulls(rows, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64()), pa.array(block, pa.int32()), pa.array(part, pa.binary())], schema=_ARROW)


def _sketched(top: int, longest: int, batches):
    """Word counts, and counts of the keys of phrases by block."""
    some: list[np.ndarray] = []
    held: dict[tuple[str, bytes], int] = {}
    for language, texts in _shards(batches):
        whole = plain(texts)
        starts, ends, key, _ = phrase_keys(np.frombuffer(whole, np.uint8), language, longest)
        order = np.argsort(key[0])
        n = counted(key[0])[1]
        first = order[np.concatenate(([0], np.cumsum(n)[:-1]))] if len(n) else order
        for s, e, k in zip(starts[first].tolist(), ends[first].tolist(), n.tolist(), strict=True):
            at = (language, whole[s:e])
            held[at] = held.get(at, 0) + k
        some += [_short(k) for k in key[1:]]
        if sum(map(len, some)) > HELD_KEYS:
            yield from _keys_out(some, top)
        if len(held) > HELD:
            yield _flush(held, 1)
    if some:
        yield from _keys_out(some, top)
    if held:
        yield _flush(held, 1)


def _passed(slots: int, top: int, batches):
    """(block, n, keys): the keys of each block whose counters in both rows reach the top; a block's rows come one after another."""

    def out(block, parts):
        each = min(max(slots // BLOCKS, 1), _room(sum(map(len, parts)) // 5))
        first, sketch, found = np.uint64(block << 32), np.zeros((2, each), np.uint32), []
        for part in parts:
            key, n = _unpacked(part)
            for row, slot in zip(sketch, _slots(key, each), strict=True):
                np.add.at(row, slot, n)
        for part in parts:
            key, _ = _unpacked(part)
            one, two = _slots(key, each)
            found.append(key[(sketch[0][one] >= top) & (sketch[1][two] >= top)])
        key = counted(np.concatenate(found))[0] | first
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([len(key)], pa.int64()), pa.array([key.tobytes()], pa.binary())], names=["block", "n", "keys"])

    held: list[bytes] = []
    now = None
    for batch in batches:
        for block, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and block != now:
                yield out(now, held)
                held = []
            now = block
            held.append(part)
    if held:
        yield out(now, held)


def _filtered(each: int, batches):
    """(block, bits): the blocks' parts of the filter, both rows."""
    for batch in batches:
        for block, keys_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            bits = np.zeros((2, each), bool)
            for row, slot in zip(bits, _slots(np.frombuffer(keys_, np.uint64), each), strict=True):
                row[slot] = True
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary())], names=["block", "bits"])


def candidates(data: np.ndarray, language: str, bits: np.ndarray, each: int, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Where one occurrence of each candidate of a shard starts and ends: phrases that the filter lets through, as it does their parts."""
    starts, ends, key, at = phrase_keys(data, language, longest)
    passed, begin, end = np.ones(len(starts) + 1, bool), [], []
    for n in range(1, longest):
        some = passed[at[n]] & passed[at[n] + 1]
        k, first = key[n][some], at[n][some]
        ok = np.ones(len(k), bool)
        short = _short(k)
        block = (short >> np.uint64(32)).astype(np.int64) * each
        for row, slot in enumerate(_slots(short, each)):
            slot = slot + block + row * BLOCKS * each
            ok &= (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
        first = first[ok]
        passed = np.zeros(len(starts) + 1, bool)
        passed[first] = True
        one = first[np.unique(k[ok], return_index=True)[1]]
        begin.append(starts[one])
        end.append(ends[one + n])
    return np.concatenate(begin), np.concatenate(end)


def matches(whole: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The phrases at the places and how often each stands in the shard: overlapping matches of an automaton whose patterns have a space at each end."""
    import ahocorasick

    if not len(begin):
        return [], np.zeros(0, np.int64)
    text = whole.decode("latin-1")
    automaton = ahocorasick.Automaton()
    for k, (s, e) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
        automaton.add_word(text[s - 1 : e + 1], k)
    automaton.make_automaton()
    found = np.fromiter((k for _, k in automaton.iter(text)), np.int64)
    return [whole[s:e] for s, e in zip(begin.tolist(), end.tolist(), strict=True)], np.bincount(found, minlength=len(begin))


def _matched(bits: Broadcast, each: int, longest: int, batches):
    """Counts of the candidates of each shard, summed over the shards of a task as far as they are held."""
    held: dict[tuple[str, bytes], int] = {}
    for language, texts in _shards(batches):
        whole = plain(texts)
        phrase, n = matches(whole, *candidates(np.frombuffer(whole, np.uint8), language, np.frombuffer(bits.value, np.uint8), each, longest))
        for p, k in zip(phrase, n.tolist(), strict=True):
            at = (language, p)
            held[at] = held.get(at, 0) + k
        if len(held) > HELD:
            yield _flush(held, 0)
    if held:
        yield _flush(held, 0)


def supported(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, support: int = SUPPORT, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all words and phrases with at least ``support`` occurrences, and (lang, n) of all words; both as tables in the shared folder."""
    spark = docs.sparkSession
    ship(spark)
    folder, top = shared_dir(spark), min(support, 255)
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    first = written(source.mapInArrow(partial(_sketched, top, longest), _COUNTS), f"{folder}/first")
    words = first.where("slot is null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    words = written(words, f"{folder}/words")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = first.where("slot is not null").select("slot", "part").repartition(min(tasks, BLOCKS), "slot").sortWithinPartitions("slot")
    passed = written(blocks.mapInArrow(partial(_passed, slots, top), "block int, n bigint, keys binary"), f"{folder}/passed")
    each = _room((passed.agg(F.sum("n")).first()[0] or 0) // BLOCKS)
    bits = np.zeros((2, BLOCKS, each // 8), np.uint8)
    for row in passed.select("block", "keys").mapInArrow(partial(_filtered, each), "block int, bits binary").toLocalIterator():
        bits[:, row.block] = np.frombuffer(bytes(row.bits), np.uint8).reshape(2, -1)
    counts = source.mapInArrow(partial(_matched, spark.sparkContext.broadcast(bits.tobytes()), each, longest), _COUNTS)
    counts = counts.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("n").alias("f"))
    both = counts.unionByName(words.select("lang", "phrase", F.lit(1).alias("words"), "f")).where(F.col("f") >= support)
    both = written(both.withColumn("phrase", F.col("phrase").cast("string")), f"{folder}/counts")
    return both, words.groupBy("lang").agg(F.sum("f").alias("n"))


def _decimal(column):
    return F.col(column).cast("decimal(20,0)")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, support: int = SUPPORT, top: int = TOP, slots: int = SLOTS) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    counts, totals = supported(docs, text_col, lang_col, longest, support, slots)
    phrases = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    word = F.split("phrase", " ")
    piece = lambda start, n: F.array_join(F.slice(word, start, n), " ")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    part = lambda side, as_: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(as_))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("score", F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    best = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("b")).select("lang", "phrase", "b.*")
    inner = phrases.where("words > 2").select("lang", "a", "words", word.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("i"))
    inner = inner.groupBy("lang", F.array_join(F.expr("slice(w, i, m)"), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.coalesce(_decimal("longer") * 100 < _decimal("a") * CONTAINED, F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    few = kept.withColumn("k", F.row_number().over(W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))).where(F.col("k") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = rf"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, row_number() OVER () AS piece, p FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts)),
words AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM (SELECT lang, piece, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces)),
windows AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM words WINDOW o AS (PARTITION BY piece ORDER BY i)),
counts AS MATERIALIZED (SELECT lang, m AS words, CASE m WHEN 1 THEN w1 WHEN 2 THEN w1 || ' ' || w2 WHEN 3 THEN w1 || ' ' || w2 || ' ' || w3 ELSE w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 END AS phrase, count(*) AS f
  FROM windows, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE CASE m WHEN 1 THEN w1 WHEN 2 THEN w2 WHEN 3 THEN w3 ELSE w4 END IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE words = 1 GROUP BY lang),
phrases AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE words > 1 AND f >= {SUPPORT}),
halves AS MATERIALIZED (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM phrases, (SELECT unnest([1, 2, 3]) AS k) WHERE k < words),
cuts AS MATERIALIZED (SELECT h.lang, h.phrase, a, k, p.f AS l, q.f AS r, ({SCALE}::HUGEINT * a) // (p.f + q.f) AS score
  FROM halves h JOIN counts p ON p.lang = h.lang AND p.phrase = x JOIN counts q ON q.lang = h.lang AND q.phrase = y),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM phrases, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < words AND i + m - 1 <= words GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT b.*, t.n, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM best b LEFT JOIN inside USING (lang, phrase) JOIN totals t USING (lang) WHERE longer IS NULL OR 100::HUGEINT * longer < {CONTAINED}::HUGEINT * a)
WHERE rank <= {TOP}
"""
