"""Token ids in binary: canonical length-limited Huffman coding from global counts.

Texts are tokenised once; ids and their global counts give one code for all shards.  The shard table is written in
ascending id order.  Each row is one independent block, a self-describing byte string:

    magic "HUF2", then little-endian unsigned 64-bit: symbols, segment length, number of checkpoints;
    the bit offset of every ``segment``-th symbol (unsigned 64-bit); the code bits, most significant first.

The code itself is stored once, as the lengths of all symbols (the canonical code follows from them).  Decoding is driven by
one table of 2**limit entries and runs all segments of a block side by side, each from its checkpoint.

Null and empty texts have no ids but the end id.  Rows with equal ids stand in the order of a hash of their
texts; null ids come first.  Rows that tie in both keep any order, as they encode alike.
Repeated rows are encoded as often as they stand there; very long texts are one block each.  Rows of an empty table write an empty shard table.  Columns other than id and text are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagforge.llm.common import blocks, drop_path, shared_dir, written
from tagforge.session import ship

MAGIC = b"HUF2"
SEGMENT = 128
LIMIT = 16
#: Ids after which a block is closed (a single longer document makes a longer block).
BLOCK_IDS = 1 << 18
#: Words that a worker's cache of token ids holds before it starts anew.
CACHE_WORDS = 800_000

_cache: dict[tuple, "_Words | None"] = {}
_tokenizers: dict[str, object] = {}


# -- tokenising ---------------------------------------------------------------


def tokenizer(path: str):
    """The tokenizer of a file, one per worker process."""
    if path not in _tokenizers:
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: b for b in plain}
    return table | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in table)}


BYTE_LETTERS = _byte_letters()
#: A run of Latin-1 letters, then punctuation: pieces that the pre-tokenizer always parts here.
SIMPLE = re.compile("([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:|*$%&#()<>=+-]*)")


#: The pre-tokenizer's pattern and the normalizer's steps under which words between white space can be encoded one by one.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def _word_by_word(tok) -> bool:
    """True if the tokenizer lower-cases, drops white space and splits there first; any other is given whole texts."""
    import json

    form = json.loads(tok.to_str())
    steps, cuts = form.get("normalizer") or {}, form.get("pre_tokenizer") or {}
    first = (cuts.get("pretokenizers") or [cuts])[0]
    return steps.get("normalizers") == STEPS and first.get("type") == "Split" and first.get("pattern") == {"Regex": PIECES} and first.get("behavior") == "Removed" and first.get("invert") is True


def _simple_form(tok) -> bool:
    """True if the tokenizer splits, lower-cases and maps words as :data:`SIMPLE` takes for granted (checked by example)."""
    samples = ["thebleing", "\u00e9t\u00e9nement", "\u00c9aux***", "stra\u00dfe,", "word!!", "a|", "\u00fcber.&&&"]
    make = _Words(tok, "<u4", True)
    return all(make(s.encode().lower()) == np.array(tok.encode(s, add_special_tokens=False).ids, "<u4").tobytes() for s in samples)


class _Words:
    """Words to bytes of their ids, remembered."""

    def __init__(self, tok, dtype: str, simple: bool):
        self.tok, self.model, self.dtype, self.simple = tok, tok.model, dtype, simple
        self.known: dict[bytes, bytes] = {}

    def piped(self, word: str) -> bytes:
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def __call__(self, raw: bytes) -> bytes:
        word = raw.decode()
        plain = SIMPLE.fullmatch(word) if self.simple else None
        if not plain:
            made = self.piped(word)
        elif plain[2]:
            head, tail = plain[1].encode(), plain[2].encode()
            made = (self.known.get(head) or self(head)) + (self.known.get(tail) or self._keep(tail, self.piped(plain[2])))
        else:
            letters = word.lower().encode().decode("latin-1").translate(BYTE_LETTERS)
            made = np.array([t.id for t in self.model.tokenize(letters)], self.dtype).tobytes()
        return self._keep(raw, made)

    def _keep(self, raw: bytes, made: bytes) -> bytes:
        self.known[raw] = made
        return made

    def text(self, raw: bytes) -> bytes:
        words = raw.lower().split()
        parts = list(map(self.known.get, words))
        if None in parts:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            parts = [self.known.get(w) or self(w) if p is None else p for w, p in zip(words, parts, strict=True)]
        return b"".join(parts)


def encode(path: str, texts: list[str | None], dtype: str = "<u2") -> list[bytes]:
    """Token ids of each whole text as bytes, the same as the library gives for the text at once.

    Where the tokenizer splits at white space before anything else, each word between ASCII white space is encoded on its
    own and remembered; another kind of tokenizer gets whole texts.  Words of Latin-1 letters go straight to the tokenizer's BPE model, all others through its whole
    pipeline; texts in which one of its special tokens stands go to it whole.
    """
    tok = tokenizer(path)
    if (path, dtype) not in _cache:
        apart = _word_by_word(tok)
        _cache[path, dtype] = _Words(tok, dtype, apart and _simple_form(tok)) if apart else None
    words = _cache[path, dtype]
    if words is None:
        return [np.array(tok.encode((t or "").encode("utf-8", "replace").decode(), add_special_tokens=False).ids, dtype).tobytes() for t in texts]
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    return [words.piped(t) if any(s in t for s in special) else words.text(t.encode("utf-8", "replace")) for t in (x or "" for x in texts)]


# -- the code -----------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths, at most ``limit``, of the symbols with positive counts, by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, int(np.ceil(np.log2(len(used)))))
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    levels, row = [], weights
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate((weights, pairs))
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        row = merged[rank]
    take = 2 * n - 2
    total = np.zeros(n, np.int64)
    for single in reversed(levels):
        leaves = int(single[:take].sum())
        total[:leaves] += 1
        take = 2 * (take - leaves)
    total[:take] += 1
    lengths[order] = total
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each symbol: by length, then by symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    code, last = 0, 0
    for s in order.tolist():
        n = int(lengths[s])
        code <<= n - last
        codes[s], last = code, n
        code += 1
    return codes


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for every window of ``limit`` bits, and limit."""
    limit = max(1, int(lengths.max(initial=1)))
    symbol, size = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.argsort(codes[used].astype(np.uint64) << (limit - lengths[used]).astype(np.uint64))]
    spans = np.int64(1) << (limit - lengths[order].astype(np.int64))
    filled = int(spans.sum())
    symbol[:filled], size[:filled] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return symbol, size, limit


def encode_block(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, segment: int = SEGMENT) -> bytes:
    """One independent block of ids."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    bits = int(ends[-1]) if len(ends) else 0
    marks = at[::segment].astype("<u8")
    head = MAGIC + struct.pack("<QQQ", len(ids), segment, len(marks)) + marks.tobytes()
    if not bits:
        return head
    words = np.zeros((bits + 31) // 32 + 1, np.uint64)
    window = codes[ids].astype(np.uint64) << (np.uint64(64) - (at & 31).astype(np.uint64) - size.astype(np.uint64))
    cell = at >> 5
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    joined = np.bitwise_or.reduceat(window, first)
    words[cell[first]] |= joined >> np.uint64(32)
    words[cell[first] + 1] |= joined & np.uint64(0xFFFFFFFF)
    return head + words.astype(">u4").tobytes()[: (bits + 7) // 8]


def decode_block(block: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The ids of a block, all segments in step."""
    if block[:4] != MAGIC:
        raise ValueError("no block")
    n, segment, marks = struct.unpack_from("<QQQ", block, 4)
    symbol, size, limit = table
    if not n:
        return np.zeros(0, np.uint32)
    at = np.frombuffer(block, "<u8", marks, 28).astype(np.int64)
    raw = np.frombuffer(block, np.uint8, -1, 28 + 8 * marks)
    raw = np.concatenate((raw, np.zeros(8, np.uint8))).astype(np.uint32)
    joined = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    out = np.zeros((segment, marks), np.uint32)
    last = joined.size - 1
    down, mask = np.uint32(32 - limit), np.uint32((1 << limit) - 1)
    for step in range(min(segment, n)):
        window = (joined[np.minimum(at >> 3, last)] >> (down - (at & 7).astype(np.uint32))) & mask
        out[step] = symbol[window]
        at += size[window]
    return out.T.reshape(-1)[:n]


# -- tables -------------------------------------------------------------------


def _token_rows(path, end_id, dtype, batches):
    for batch in batches:
        for part in blocks(batch, 2):
            ids = [x + np.array([end_id], dtype).tobytes() for x in encode(path, part.column(2).to_pylist(), dtype)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary())], names=["id", "tie", "ids"])


def _count_rows(dtype, size, batches):
    counts = np.zeros(size, np.int64)
    for batch in batches:
        for x in batch.column(0):
            counts += np.bincount(np.frombuffer(x.as_buffer() or b"", dtype), minlength=size)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["symbol", "n"])


def _encode_rows(dtype, lengths, batches):
    """Documents in order to blocks: one row per block, with its documents' ids and numbers of tokens."""
    codes = canonical(lengths)
    held, kept, n, number = [], [], 0, 0

    def close():
        ids = np.frombuffer(b"".join(held), dtype)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([[i for i, _ in kept]], pa.list_(kind)), pa.array([[c for _, c in kept]], pa.list_(pa.int64())), pa.array([encode_block(ids, lengths, codes)], pa.binary())],
            names=["block", "n_ids", "doc_ids", "doc_tokens", "bytes"],
        )

    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field(0).type
        for i, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = ids.as_py()
            held.append(raw)
            kept.append((i, len(raw) // np.dtype(dtype).itemsize))
            n += kept[-1][1]
            if n >= BLOCK_IDS:
                yield close()
                held, kept, n, number = [], [], 0, number + 1
    if kept:
        yield close()


def _decode_rows(lengths, batches):
    table = decode_table(lengths, canonical(lengths))
    for batch in batches:
        for shard, block, docs, tokens, data in zip(*(batch.column(k) for k in ("shard", "block", "doc_ids", "doc_tokens", "bytes")), strict=True):
            ids = decode_block(data.as_buffer().to_pybytes(), table).astype("<u4")
            n = np.array(tokens.as_py(), np.int64)
            ends = np.cumsum(n)
            if int(ends[-1]) != len(ids):
                raise ValueError("block and its documents differ in length")
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for k, e in zip(n.tolist(), ends.tolist(), strict=True)]
            at = [pa.array([x.as_py()] * len(n), pa.int64()) for x in (shard, block)]
            yield pa.RecordBatch.from_arrays([*at, docs.values, pa.array(ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["shard", "block", "id", "within", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Tokenise, count, and write the shard table and its code below ``folder``; returns the code lengths.

    Sorted ranges of ids are shards; shard numbers ascend with the ids.
    """
    spark = docs.sparkSession
    ship(spark)
    size = tokenizer(path).get_vocab_size(with_added_tokens=True)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    tokens = written(source.mapInArrow(partial(_token_rows, path, end_id, dtype), f"id {kind}, tie bigint, ids binary"), f"{folder}/ids")
    rows = tokens.select("ids").mapInArrow(partial(_count_rows, dtype, size), "symbol bigint, n bigint").groupBy("symbol").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for row in rows:  # at most one row per symbol of the vocabulary
        counts[row.symbol] = row.n
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.mode("overwrite").parquet(f"{folder}/code")
    ordered = tokens.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "ids")
    made = ordered.mapInArrow(partial(_encode_rows, dtype, lengths), f"block bigint, n_ids bigint, doc_ids array<{kind}>, doc_tokens array<bigint>, bytes binary")
    made.select(F.spark_partition_id().cast("bigint").alias("shard"), "*").write.mode("overwrite").option("compression", "uncompressed").parquet(f"{folder}/shards")
    drop_path(spark, f"{folder}/ids")
    return lengths


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document, decoded from the files.

    A document's start is its place in its block, plus that of the block in its shard, plus that of the shard: the totals of the shards,
    one row each, and the blocks inside each shard are running totals of a table that is joined to the decoded rows.
    """
    shards = spark.read.parquet(f"{folder}/shards")
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{folder}/code").head().lengths), np.uint8)
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    upto = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = shards.select("shard", "block", "n_ids")
    whole = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).select("shard", upto(W.orderBy("shard")).alias("shard_start"))
    starts = sizes.select("shard", "block", upto(W.partitionBy("shard").orderBy("block")).alias("block_start")).join(whole, "shard")
    made = shards.mapInArrow(partial(_decode_rows, lengths), T._parse_datatype_string(f"shard bigint, block bigint, id {kind}, within bigint, n_tokens bigint, ids_crc32 bigint"))
    return made.join(starts, ["shard", "block"]).select(F.col("id").alias(id_col), (F.col("shard_start") + F.col("block_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as token files in the shared folder and read them back."""
    folder = shared_dir(docs.sparkSession)
    write_tokens(docs, path, folder, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, folder, id_col)
