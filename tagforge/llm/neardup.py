"""Near-duplicates by one-permutation MinHash with optimal densification.

A document's set holds the 64-bit hashes of its distinct ``width``-word shingles (A-Z lower-cased; with fewer words the whole
sequence is one shingle; without words the set is empty and linked with nothing).  Documents link when
100 * |intersection| >= ``percent`` * |union|, confirmed on whole sets.

1. Equal sets form a class; the smallest id represents it.  Only representatives go on.
2. One hash pass fills ``BANDS * ROWS`` bins with minima; empty bins borrow from a bin chosen by a second hash
   (optimal densification).  Each band of ROWS bins is a bucket key: sets at the threshold miss each other in
   every band with probability (1 - 0.85**7)**36, below 1e-6.
3. In every bucket of two or more, one centre gets an edge to each other member (a star), never all pairs; the member
   whose buckets are the most crowded is the centre.  Pairs that may come near the threshold are compared on
   their texts, and linked ones are edges.
4. Stars alone would lose a link between two members x, y of which one, x, isn't linked with the centre c.  If x and y
   are linked, then their differences from c overlap: with D(x) = (x \\ c) + (c \\ x), |D(x)| > k (|x| + |c|) and
   |D(x) ^ D(y)| <= k (|x| + |y|), k = (1 - s) / (1 + s), can't both hold for disjoint D.  So an equi-join on (centre, shingle in
   which both differ from it) finds every such pair; prefixes of the difference sets in hash order suffice, as at
   most (1 - s) |x| of x's shingles may miss y.  Size, and an upper bound of the intersection from the difference counts, prune exactly.
5. Members too far from their centre to have been compared (by size, exactly, or for sets of 64 shingles or more by a
   256-bit sketch at over five standard deviations) go round again within their bucket, with the members not close to the centre:
   further centres, far members of small components first, eight times as many each round, until every pair
   with a far member in different components was compared or excluded by size or sketch.
6. Components come from alternating large-star and small-star steps on the confirmed edges.

Hubs: in step 6 the at most 64 nodes that hold more than a 64th of the edges each are joined by broadcast, all others by
shuffle; in steps 3 and 5 a text that takes part in more than ``PAIRS`` pairs is repeated once for that many, and its pairs dealt over the repeats.
The sketch of step 5 is a filter by evidence, not by size alone: small sets, whose 252 bins repeat few minima, are all compared on texts.

All intermediate tables are written to the shared folder, and all but the result deleted.  Rows with a null id have a null component and are kept; they take part in nothing.
Null and empty texts: n_shingles 0, own component.  Repeated rows (same id and text) get the same
component and are all kept or dropped alike; rows that share an id but not the set are documents of their own.  Of equal sets the smallest id stays, of several
equally good centres the smallest.  Very long texts are hashed and compared whole.  An empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import uuid
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagforge.llm.common import drop_path, fresh, map_texts, shared_dir, written

BANDS, ROWS = 36, 7
BINS = BANDS * ROWS
SKETCH_WORDS = 4
SKETCH_SHINGLES = 64
#: Pairs that one repeat of a text serves.
PAIRS = 1000
#: Nodes of more than total / HUBS edges are hubs, so there are at most HUBS of them.
HUBS = 64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _series(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = _series(256, 11)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() + b"\n" for t in texts]
    ends = np.cumsum([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    empty = np.zeros(0, np.uint64)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [empty] * len(texts)
    place = np.arange(len(data)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    place[space] = 0
    spread = _BYTE[data] * (_series(int(place.max()) + 1, 29) | np.uint64(1))[np.maximum(place, 0)]
    spread[space] = 0
    words = _mix(np.add.reduceat(spread, starts))
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    odd = _series(width, 47) | np.uint64(1)
    n = len(words) - width + 1
    joined = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        joined += words[k : k + n] * odd[k] if n > 0 else np.uint64(0)
    joined = _mix(joined)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            out.append(_mix((words[a:b] * odd[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(empty)
    return out


def _detours(bins: int = BINS, tries: int = 1 << 12) -> np.ndarray:
    """For each try and empty bin, the bin to borrow from: a hash of (bin, try), the same for all sets."""
    return (_series(tries * bins, 71).reshape(tries, bins) % np.uint64(bins)).astype(np.int64)


_DETOURS = _detours(tries=64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """BINS densified minima per set (rows of empty sets are zero)."""
    out = np.full((len(sets), BINS), np.iinfo(np.uint64).max, np.uint64)
    for row, s in zip(out, sets, strict=True):
        if len(s):
            at = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))  # s is sorted, and bins ascend with it
            row[at[first]] = s[first]
    hollow = out == np.iinfo(np.uint64).max
    some = ~hollow.all(1)
    doc, bin_ = np.nonzero(hollow & some[:, None])
    source, table, step = hollow.copy(), _DETOURS, 0
    while len(doc):
        if step == len(table):
            table = _detours(tries=2 * step)
        target = table[step, bin_]
        found = ~source[doc, target]
        out[doc[found], bin_[found]] = _mix(out[doc[found], target[found]] + np.uint64(step + 1))
        doc, bin_, step = doc[~found], bin_[~found], step + 1
    out[~some] = 0
    return out


_FIELDS = [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))]


def _signed(width, texts):
    import hashlib

    sets = shingle_sets(texts, width)
    sig = signatures(sets)
    odd = _series(ROWS, 97) | np.uint64(1)
    bands = _mix((sig.reshape(len(sets), BANDS, ROWS) * odd).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
    bits = np.zeros((len(sets), 64 * SKETCH_WORDS), np.uint8)
    bits[:, :BINS] = (_mix(sig) >> np.uint64(63)).astype(np.uint8)
    sketch = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
    keys = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
    return [[len(s) for s in sets], keys, list(bands), list(sketch)]


def _keys(width, texts):
    return [_signed(width, texts)[1]]


def _sets(width, batches):
    """Each batch of (a, b, text of a, text of b) with the shingle sets of its rows; sets are remembered within a batch's neighbourhood."""
    cache: dict = {}

    def of(key, text):
        if key not in cache:
            if len(cache) > 256:
                cache.clear()
            cache[key] = shingle_sets([text.as_py()], width)[0]
        return cache[key]

    for batch in batches:
        a, b, ta, tb = batch.columns
        keys = [list(zip(*(part.to_pylist() for part in node.flatten()), strict=True)) for node in (a, b)]
        yield batch, [(of(x, ta[i]), of(y, tb[i])) for i, (x, y) in enumerate(zip(*keys, strict=True))]


def _confirm(width, percent, batches):
    """The pairs that link."""
    for batch, pairs in _sets(width, batches):
        kept = []
        for x, y in pairs:
            common = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.select([0, 1]).filter(pa.array(kept, pa.bool_()))


def _compare(width, percent, close, batches):
    """Of each (centre, member): linked, close, the member's size, what it adds and lacks, and prefixes of both difference sets."""
    for batch, pairs in _sets(width, batches):
        rows = []
        for c, m in pairs:
            added, missing = np.setdiff1d(m, c, assume_unique=True), np.setdiff1d(c, m, assume_unique=True)
            common = len(m) - len(added)
            union = len(c) + len(added)
            few = (100 - percent) * len(m)
            rows.append((100 * common >= percent * union, 100 * common >= close * union, len(m), len(added), len(missing), added[: few // 100 + 1].view(np.int64), missing[: few // percent + 1].view(np.int64)))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
        kinds = [pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        made = [pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["c", "m", "linked", "close", "n", "added", "removed", "novel", "missing"])


def _with_least(edges: DataFrame, low: DataFrame, key: str) -> DataFrame:
    """edges joined with ``low`` (key, m, n: rows of that key): hubs by broadcast, so that no task takes all rows of one."""
    hub = F.col("n") > max(256, edges.count() // HUBS)
    hubs = low.where(hub).drop("n")
    rest = edges.join(F.broadcast(hubs.select(key)), key, "left_anti").join(low.where(~hub).drop("n"), key)
    return rest.unionByName(edges.join(F.broadcast(hubs), key))


def components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, component): each node of ``edges`` (a, b) and the smallest node reachable, by alternating stars."""
    tidy = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, step = written(tidy(edges), f"{folder}/0"), 0
    while True:
        # Done when every edge leads to a top: no end of an edge starts another, and no node has two edges.
        deep = now.select("b").distinct().join(now.select(F.col("a").alias("b")), "b", "left_semi").select(F.col("b").alias("a"))
        if not deep.unionByName(now.groupBy("a").count().where("count > 1").select("a")).head(1):
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = written(tidy(_with_least(both, low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))), f"{folder}/{step + 1}")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, low, "a")
        moved = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now = written(tidy(moved), f"{folder}/{step + 2}")
        drop_path(edges.sparkSession, f"{folder}/{step + 1}")
        drop_path(edges.sparkSession, f"{folder}/{step}")
        step += 2
    tops = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))


def _least_agreement(similarity: float, deviations: float) -> int:
    """Sketch bits that sets of this similarity agree in at least, ``deviations`` below what is expected of them."""
    p = (1 + similarity) / 2
    return int(64 * SKETCH_WORDS - BINS + BINS * p - deviations * (BINS * p * (1 - p)) ** 0.5)


def _similar(x: str, y: str, percent: int, deviations: float = 6.0, sketch: bool = True):
    """False only where sizes (exactly) or, unless ``sketch`` is off, sketches (beyond doubt) put the structs x and y below ``percent``."""
    small, large = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    if not sketch:
        return 100 * small >= percent * large
    agree = F.lit(64 * SKETCH_WORDS)
    for k in range(SKETCH_WORDS):
        agree = agree - F.bit_count(F.col(f"{x}.sketch")[k].bitwiseXOR(F.col(f"{y}.sketch")[k]))
    return (100 * small >= percent * large) & ((small < SKETCH_SHINGLES) | (agree >= _least_agreement(percent / 100, deviations)))


def _difference_pairs(star: DataFrame, percent: int) -> DataFrame:
    """(a, b) that may link although one isn't linked with their common centre; step 4 of the module's docstring."""
    groups = star.groupBy("c").agg(F.count_if(~F.col("linked")).alias("bad"), F.count("*").alias("k")).where("bad > 0 and k > 1")
    hub = F.col("k") > max(256, star.count() // HUBS)
    hubs = F.broadcast(groups.where(hub).select("c"))
    s = star.join(hubs, "c", "left_anti").join(groups.where(~hub).select("c"), "c", "left_semi").unionByName(star.join(hubs, "c", "left_semi"))
    tokens = lambda name: s.select("c", F.explode(name).alias("t"), F.struct("m", "n", "added", "removed", "linked").alias("v"))
    x, y = (lambda k: F.col(f"x.{k}")), (lambda k: F.col(f"y.{k}"))
    both = x("n") + y("n")
    most = x("n") - x("added") + x("removed") - F.greatest(x("removed"), y("removed")) + F.least(x("added"), y("added"))
    may = (100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))) & (100 * most >= percent * (both - most)) & (x("m") != y("m")) & (y("linked") | (x("m") < y("m")))
    # Pairs whose additions need not overlap, and only those, are found by what both lack.
    apart = (x("added") + y("added") + F.abs(x("removed") - y("removed"))) * (100 + percent) <= (100 - percent) * both
    found = None
    for name, condition in (("novel", may), ("missing", may & apart)):
        left = tokens(name).where(~F.col("v.linked")).withColumnRenamed("v", "x")
        got = left.join(tokens(name).withColumnRenamed("v", "y"), ["c", "t"]).where(condition).select(F.least("x.m", "y.m").alias("a"), F.greatest("x.m", "y.m").alias("b")).distinct()
        found = got if found is None else found.unionByName(got)
    return found.distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", sketch: bool = True) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable), kept (it represents its component).

    Without ``sketch`` only exact tests exclude a pair of a bucket: slower, and the same result unless a sketch errs.
    """
    return _labelled(docs, width, percent, id_col, text_col, sketch).select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _labelled(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, sketch: bool = True) -> DataFrame:
    """id, n_shingles, set_key, component_id, kept.  Inside, a node is an id and the turn of one of its sets, so that sets that share an id stay apart."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    signed = map_texts(docs, [id_col], text_col, _FIELDS, partial(_signed, width)).withColumnRenamed(id_col, "id")
    signed = written(signed, f"{folder}/signed")
    part = signed.where(F.col("set_key").isNotNull() & F.col("id").isNotNull())
    firsts = part.groupBy("set_key").agg(F.min("id").alias("id"))
    reps = written(firsts.select("set_key", F.struct("id", F.row_number().over(W.partitionBy("id").orderBy("set_key")).alias("turn")).alias("rep")), f"{folder}/reps")
    ids = reps.select(F.col("rep.id").alias("id"), "set_key", "rep")
    member = signed.join(ids, ["id", "set_key"]).dropDuplicates(["id", "set_key"])
    member = member.select(F.struct(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "sketch").alias("m"), F.posexplode("bands").alias("band", "key"))
    member = member.select(F.xxhash64("band", "key").alias("bucket"), "m")
    crowds = written(member.groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1"), f"{folder}/crowds")
    member = written(member.join(crowds, "bucket"), f"{folder}/member")
    # A text that many others resemble shares crowded buckets with them in most bands.
    weight = member.groupBy(F.col("m.id").alias("id")).agg(F.sum("crowd").alias("weight"))
    heavy = written(member.join(weight, F.col("m.id") == F.col("id")).select("bucket", "m", (-F.col("weight")).alias("rank")), f"{folder}/weighted")
    drop_path(spark, f"{folder}/member")
    best = heavy.groupBy("bucket").agg(F.min(F.struct("rank", "m")).alias("c")).select("bucket", F.col("c.m").alias("c"))
    best = written(best, f"{folder}/centres0")
    needed = heavy.select(F.col("m.id").alias("rep")).distinct()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    per_id = signed.where("id IS NOT NULL").groupBy("id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi"), F.count("set_key").alias("some"), F.count("*").alias("all"))
    mixed = written(per_id.where("lo <> hi OR some BETWEEN 1 AND all - 1").select("id"), f"{folder}/mixed")
    keyed = None
    if mixed.head(1):  # these ids stand for several sets; each text goes to its own
        keyed = map_texts(plain.join(mixed, "id", "left_semi"), ["id", "text"], "text", _FIELDS[1:2], partial(_keys, width))
        keyed = keyed.join(ids, ["id", "set_key"]).join(needed, "rep", "left_semi").select("rep", "text").dropDuplicates(["rep"])
        plain = plain.join(mixed, "id", "left_anti")
    texts = plain.join(needed.select("rep.id").distinct(), "id", "left_semi").dropDuplicates(["id"]).select(F.struct("id", F.lit(1).alias("turn")).alias("id"), "text")
    texts = written(texts if keyed is None else texts.unionByName(keyed.withColumnRenamed("rep", "id")), f"{folder}/texts")
    kind = texts.schema["id"].dataType.simpleString()

    def beside(pairs: DataFrame, key: str, other: str, name: str) -> DataFrame:
        """pairs with the text of their ``key``; a text of many pairs is repeated, and its pairs dealt over the repeats."""
        n = pairs.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > PAIRS).select(key, F.ceil(F.col("n") / PAIRS).alias("turns"))
        many = written(n, f"{folder}/many{uuid.uuid4().hex}")
        dealt = pairs.join(many, key, "left").withColumn("at", F.pmod(F.xxhash64(other), F.coalesce("turns", F.lit(1)))).drop("turns")
        own = texts.select(F.col("id").alias(key), F.col("text").alias(name)).join(many, key, "left")
        own = own.select(key, name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("turns", F.lit(1)) - 1)).alias("at"))
        return dealt.join(own, [key, "at"]).drop("at")

    def with_texts(pairs: DataFrame, a: str, b: str) -> DataFrame:
        return beside(beside(pairs.select(a, b), a, b, "ta"), b, a, "tb").select(a, b, "ta", "tb")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        return written(with_texts(pairs, "a", "b").mapInArrow(partial(_confirm, width, percent), f"a {kind}, b {kind}"), f"{folder}/{name}")

    loose, close = percent - 13, 87
    member = heavy.select("bucket", "m").join(best, "bucket").where(F.col("m.id") != F.col("c.id")).withColumn("far", ~_similar("m", "c", loose, 5.2, sketch))
    member = written(member.select("bucket", "m", F.col("c.id").alias("c"), "far"), f"{folder}/stars")
    pairs = written(member.where("not far").select("c", F.col("m.id").alias("m")).distinct(), f"{folder}/pairs")
    fields = f"c {kind}, m {kind}, linked boolean, close boolean, n bigint, added bigint, removed bigint, novel array<bigint>, missing array<bigint>"
    star = written(with_texts(pairs, "c", "m").mapInArrow(partial(_compare, width, percent, close), fields), f"{folder}/compared")
    found = confirmed(written(_difference_pairs(star, percent), f"{folder}/differing"), "edges")
    edges = star.where("linked").select(F.col("c").alias("a"), F.col("m").alias("b")).unionByName(found)
    group = written(components(edges, f"{folder}/turns"), f"{folder}/groups")
    some = member.groupBy("bucket").agg(F.max("far").alias("any_far"), F.count("*").alias("k")).where("any_far and k > 1").select("bucket")
    near = star.where("close").select("c", F.col("m").alias("id"))
    rest = member.join(some, "bucket", "left_semi")
    rest = rest.join(near, (rest.c == near.c) & (F.col("m.id") == near.id), "left_anti").select("bucket", "m", "far")
    seen, step, taken = [], 0, 4
    while True:
        names = group.select(F.col("node").alias("id"), F.col("component").alias("g"))
        named = rest.join(names, F.col("m.id") == F.col("id"), "left").select("bucket", "m", "far", F.coalesce("g", "m.id").alias("g"))
        named = written(named, f"{folder}/rest{step}")
        mixed = named.groupBy("bucket").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.max("far").alias("any_far")).where("lo <> hi and any_far").select("bucket")
        todo = written(named.join(mixed, "bucket", "left_semi"), f"{folder}/todo{step}")
        drop_path(spark, f"{folder}/rest{step}")
        if not todo.head(1):
            break
        share = todo.groupBy("bucket", "g").agg(F.count("*").alias("size"))
        order = W.partitionBy("bucket").orderBy(F.col("far").desc(), "size", "g", "m.id")
        picked = todo.join(share, ["bucket", "g"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= taken)
        centres = written(picked.select("bucket", F.col("m").alias("c"), F.col("g").alias("cg"), F.col("far").alias("cfar")), f"{folder}/centres{step}")
        apart = todo.join(centres, "bucket").where((F.col("g") != F.col("cg")) & (F.col("far") | F.col("cfar")) & _similar("m", "c", percent, sketch=sketch))
        pairs = apart.select(F.least("m.id", "c.id").alias("a"), F.greatest("m.id", "c.id").alias("b")).distinct()
        for old in seen:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = written(pairs, f"{folder}/pairs{step}")
        seen.append(pairs)
        found = confirmed(pairs, f"edges{step}")
        if found.head(1):
            edges = edges.unionByName(found)
            group = written(components(edges, f"{folder}/turns{step}"), f"{folder}/groups{step}")
        rest = todo.join(centres.select("bucket", F.col("c.id").alias("id")), [todo.bucket == centres.bucket, F.col("m.id") == F.col("id")], "left_anti").select("bucket", "m", "far")
        step, taken = step + 1, min(taken * 8, 1 << 20)
    every = signed.select("id", "n_shingles", "set_key")
    out = every.join(reps, "set_key", "left").join(group.withColumnRenamed("node", "rep"), "rep", "left")
    top, linked = F.coalesce("component", "rep"), F.col("id").isNotNull() & (F.col("n_shingles") > 0)
    kept = F.when(linked, (F.col("id") == F.col("rep.id")) & (top == F.col("rep"))).otherwise(True)
    out = out.select("id", "n_shingles", "set_key", F.when(linked, top["id"]).otherwise(F.col("id")).alias("component_id"), kept.alias("kept"))
    out = written(out, shared_dir(spark))
    drop_path(spark, folder)
    return out


def survivors(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component and every row with a null id, all columns; rows of one id are the same document only if their sets are equal."""
    found = _labelled(docs, width, percent, id_col, text_col).where("id IS NOT NULL")
    own, set_of, key = (fresh(docs.columns, name) for name in ("kept", "set", "key"))
    ids = found.groupBy(F.col("id").alias(own)).agg(F.count("*").alias("rows"), F.max("kept").alias("any")).where("any")
    within = lambda some: docs.join(some.select(own), F.col(id_col) == F.col(own), "left_semi")
    out = within(ids.where("rows = 1")).unionByName(docs.where(F.col(id_col).isNull()))
    again = ids.where("rows > 1")
    if not again.head(1):
        return out
    keyed = map_texts(within(again), docs.columns, text_col, [T.StructField(set_of, T.StringType())], partial(_keys, width))
    pairs = found.where("kept").select(F.col("id").alias(own), F.col("set_key").alias(key)).distinct()
    keyed = keyed.join(pairs, (F.col(id_col) == F.col(own)) & F.col(set_of).eqNullSafe(F.col(key)), "left_semi")
    return out.unionByName(keyed.dropDuplicates([id_col, set_of]).drop(set_of))
