"""Best-fit packing of documents into sequences of several permitted lengths.

A document's size is its number of words.  Documents longer than the longest permitted length are cut into
whole bins of that length and a rest.  Pieces are placed largest first into the open bin with the least room that still
holds them; when none does, a bin opens.  When all are placed, each bin shrinks to the shortest permitted length that holds its contents.

Which length opens is optimised jointly for all lengths: a table names an opening length for each class of pieces (those that
the same shortest permitted length holds), and the table is chosen by the total cost of the shard's final, downsized bins,
cost(L) = L + overhead + L * L / attention.  From each of two tables, that of the least cost per unit and that of the shortest lengths,
one entry at a time is changed to whatever lowers the total most, until no change of one entry does.

Documents are dealt into shards by a hash of id, text and the number of the copy, about ``shard_rows`` each, and every shard is packed alone:
no task sees more than one shard however large a source, a group of equal sizes or of repeated rows is, and the number of shards grows with
the rows.  Which documents can share a sequence so depends on the size of the table; a shard's last bins are all that this can cost.

Null and empty texts have size 0: one piece of length 0 in bin null.  Ties are placed by id, then by a hash of the text; repeated rows are
packed as often as they stand there.  Very long texts are cut at the longest permitted length.  An empty table gives an empty result.  Columns other than id and text are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagforge.llm.mixing import n_words
from tagforge.session import ship

LENGTHS = (256, 512, 1024, 2048, 4096)
OVERHEAD = 32.0
ATTENTION = 8192.0
SHARD_ROWS = 2000
#: Copies of a row that one array counts out.
COPIES = 1024


def cost(length: float, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    return length + overhead + length * length / attention


def unit_table(lengths: tuple[int, ...]) -> dict[int, int]:
    """For each class of pieces the length of the least cost per unit among those that hold it."""
    return {n: min((k for k in lengths if k >= n), key=lambda k: (cost(k) / k, k)) for n in lengths}


def place(sizes: list[int], classes: list[int], opening: dict[int, int]) -> tuple[list[int], list[int], list[int]]:
    """(bin and offset of each piece, units in each bin) of best-fit placing, bins opening by ``opening``.

    Open bins are kept by the room they have left; a bit set of the rooms in use finds the tightest fit.
    """
    rooms: dict[int, list[int]] = {}
    used, filled = 0, []
    bins, offsets = [], []
    for size, kind in zip(sizes, classes, strict=True):
        free = used >> size
        if free:
            room = size + (free & -free).bit_length() - 1
            stack = rooms[room]
            at = stack.pop()
            if not stack:
                used &= ~(1 << room)
        else:
            room = opening[kind]
            at = len(filled)
            filled.append(0)
        bins.append(at)
        offsets.append(filled[at])
        filled[at] += size
        if left := room - size:
            rooms.setdefault(left, []).append(at)
            used |= 1 << left
    return bins, offsets, filled


def total_cost(filled: list[int], lengths: tuple[int, ...]) -> float:
    """Cost of all bins after downsizing."""
    steps = np.array(lengths)
    costs = np.array([cost(n) for n in lengths])
    return float(costs[np.searchsorted(steps, np.array(filled, np.int64))].sum()) if filled else 0.0


def joint_table(sizes: list[int], classes: list[int], lengths: tuple[int, ...]) -> dict[int, int]:
    """The opening table of the least total cost that single changes reach from two starts."""
    seen: dict[tuple, float] = {}

    def of(table):
        key = tuple(table[n] for n in lengths)
        if key not in seen:
            seen[key] = total_cost(place(sizes, classes, table)[2], lengths)
        return seen[key]

    present = set(classes)
    for start in (unit_table(lengths), {n: n for n in lengths}):
        table = start
        while True:
            near = [table | {n: k} for n in lengths if n in present for k in lengths if k >= n and k != table[n]]
            best = min(near, key=of, default=table)
            if of(best) >= of(table):
                break
            table = best
    return dict(zip(lengths, min(seen, key=lambda k: (seen[k], k)), strict=True)) if seen else start


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, opening: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in bin, final bin length) of each piece; sizes are positive, at most max(lengths), in placing order."""
    lengths = tuple(sorted(lengths))
    steps = np.array(lengths)
    classes = steps[np.searchsorted(steps, sizes)].tolist()
    plain = sizes.tolist()
    bins, offsets, filled = place(plain, classes, opening or joint_table(plain, classes, lengths))
    final = steps[np.searchsorted(steps, np.array(filled, np.int64))]
    at = np.array(bins, np.int64)
    return at, np.array(offsets, np.int64), final[at]


def _pack_shard(lengths: tuple[int, ...], key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
    longest = max(lengths)
    shard = shard.sort_values(["id", "tie", "size"], na_position="last", kind="stable").reset_index(drop=True)
    pieces = np.maximum(1, -(-shard["size"].to_numpy() // longest))
    row = np.repeat(np.arange(len(shard)), pieces)
    number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = number * longest
    length = np.minimum(shard["size"].to_numpy()[row] - start, longest)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    bins, offsets, final = best_fit(length[order], lengths)
    bin_no, offset, size = np.full(len(row), -1), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    bin_no[order], offset[order], size[order] = bins, offsets, final
    out = pd.DataFrame({"id": shard["id"].to_numpy()[row], "piece": number, "piece_start": start, "piece_words": length, "shard": int(key[0]), "bin": pd.array(bin_no, "Int64"), "bin_offset": offset, "bin_length": size})
    out.loc[out["bin"] < 0, "bin"] = pd.NA
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: id, piece, piece_start, piece_words, shard, bin, bin_offset, bin_length.

    (shard, bin) names a sequence; bin_length is its final permitted length.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shards = max(1, -(-docs.count() // shard_rows))
    sized = docs.select(F.col(id_col).cast("string").alias("id"), n_words(text_col).alias("size"), F.xxhash64(F.col(text_col)).alias("tie"))
    # Repeated rows are counted, then counted out again in two steps, so that neither a task nor an array grows with them.
    several = sized.groupBy("id", "size", "tie").agg(F.count("*").alias("n"))
    chunks = several.select("id", "size", "tie", "n", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {COPIES}"))).alias("chunk"))
    first = F.col("chunk") * COPIES
    copies = chunks.repartition("id", "tie", "chunk").select("id", "size", "tie", F.explode(F.sequence(first, F.least(first + COPIES, F.col("n")) - 1)).alias("copy"))
    dealt = copies.withColumn("shard", F.pmod(F.xxhash64("id", "tie", "copy", F.lit(5)), F.lit(shards)).cast("int"))
    schema = "id string, piece bigint, piece_start bigint, piece_words bigint, shard int, bin bigint, bin_offset bigint, bin_length bigint"
    made = dealt.groupBy("shard").applyInPandas(partial(_pack_shard, lengths), schema)
    return made.select(F.col("id").cast(kind).alias(id_col), *made.columns[1:])
