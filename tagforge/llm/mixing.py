"""Mixing sources to target weights with DataFrame operations only.

A document's size is its number of words.  Sources in code-point order, null last, weigh
``weights`` in turn and share the whole budget; a target stops at ``max_epochs`` times its source's
size, and the excess goes to the others by weight until none is above.

Within a source, complete epochs come first: every document floor(target / source size) times.
The rest of the budget is an Efraimidis-Spirakis sample: each document draws an exponential key
-ln(u) / w, u from a hash of its id and text, w its quality weight, and documents are taken in key order while
their running total of words fits the budget; the document at the edge is taken when that comes nearer to the target.

No source is ever sorted as a whole: keys fall into ``buckets`` ranges that keep their order, the
totals of (source, range) give the running totals, in two levels of :data:`GROUPED` ranges so that no task sees all ranges of a source,
and only the one range per source that crosses the budget is sorted.  The number of ranges grows with the number of rows.
Sources themselves are ordered in one task: one row each.

The weight is a Column or the name of a column, such as the score of a quality classifier joined to the documents; nulls weigh
``LEAST_WEIGHT``, as do lower ones.  Without one it is :func:`quality_weight`, so that the operator needs only DataFrame functions.

Null and empty texts have size 0 and take 0 words; very long texts count whole; an empty table gives an empty result.  Repeated rows are
ordered among themselves by a hash of their text, and equal ones share one draw and one fate up to the edge.
Columns other than id, text and source pass through :func:`mixed` untouched and are not read by :func:`plan`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tagforge.llm.common import WORD, shared_dir, written

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: The least weight of a document in the draw.
LEAST_WEIGHT = 0.05
#: Rows that one key range of one source holds on average.
RANGE_ROWS = 4000
#: Ranges whose totals are added up together before their sum is.
GROUPED = 2048


def n_words(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_weight(text_col: str):
    """The default weight, near 1 for plain prose and down to ``LEAST_WEIGHT``: the product of four shares.

    Symbols (of ``#*$%&|<>``) and digits lower it by their share of the text, eight and two times; a mean word length outside 3 to 12
    by how far it is outside; repeated lines by the share of lines that are different.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda marks, times: F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(times) * (F.length(text) - F.length(F.translate(text, marks, ""))) / size)
    mean = F.length(F.translate(text, " \t\n\x0b\x0c\r", "")) / F.greatest(n_words(text_col), F.lit(1))
    lines = F.split(text, "\n")
    words = F.least(F.lit(1.0), mean / F.lit(3.0), F.lit(12.0) / F.greatest(mean, F.lit(1.0)))
    return F.round(F.greatest(F.lit(LEAST_WEIGHT), share("#*$%&|<>", 8.0) * share("0123456789", 2.0) * words * F.size(F.array_distinct(lines)) / F.size(lines)), 6)


def uniform(id_col: str, text_col: str):
    """A number in (0, 1) from the md5 of the id and the text's md5: the same in every run and engine, and another for each text of a null or repeated id."""
    own = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    digits = F.substring(F.md5(own.cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def targets(sizes: DataFrame, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source of ``sizes`` (source, source_size): its target.  One row per source, so plain windows do.

    Sources ordered by size per weight reach their ceiling first: the water level before each is
    (budget - ceilings so far) / (weights left), and a source is at its ceiling while the level is above its own ratio.
    """
    ranked = sizes.withColumn("__rank", F.row_number().over(W.orderBy(F.col(source_col).isNull(), F.col(source_col).cast("binary"))) - 1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int"))
    ceil = ranked.select(source_col, "source_size", "__rank", pick.alias("__w"), (F.lit(float(max_epochs)) * F.col("source_size")).alias("__ceil"))
    before = W.orderBy(F.col("__ceil") / F.col("__w"), "__rank").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("__ceil").over(before), F.lit(0.0))) / (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    at = ceil.withColumn("__level", level).withColumn("__full", F.col("__level") * F.col("__w") >= F.col("__ceil"))
    open_level = F.min(F.when(~F.col("__full"), F.struct(F.col("__ceil") / F.col("__w"), "__rank", "__level"))).over(every)["__level"]
    return at.select(source_col, "source_size", F.when(F.col("__full"), F.col("__ceil")).otherwise(open_level * F.col("__w")).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, weight=None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (and the columns ``keep``).

    The texts are read once: sizes and keys are written to the shared folder and all else works on them.
    """
    spark = docs.sparkSession
    given = F.col(weight) if isinstance(weight, str) else weight
    w = quality_weight(text_col) if given is None else F.greatest(F.coalesce(given.cast("double"), F.lit(LEAST_WEIGHT)), F.lit(LEAST_WEIGHT))
    sized = docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), n_words(text_col).alias("size"), (-F.log(uniform(id_col, text_col)) / w).alias("__key"), F.xxhash64(F.col(text_col)).alias("__tie"), *keep)
    sized = written(sized, f"{shared_dir(spark)}/sized")
    rows = sized.count()
    buckets = max(64, rows // RANGE_ROWS)
    keyed = sized.withColumn("__range", F.floor(F.lit(float(buckets)) * (F.lit(1.0) - F.exp(-F.col("__key")))).cast("int"))
    totals = keyed.groupBy("__source", "__range").agg(F.sum("size").alias("__sum"))
    sizes = totals.groupBy("__source").agg(F.sum("__sum").alias("source_size"))
    goal = targets(sizes, "__source", weights, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(F.lit(0)).cast("bigint")
    goal = goal.select("__source", "source_size", "target", epochs.alias("__epochs"), (F.col("target") - epochs * F.col("source_size")).alias("__rest"))
    before = lambda *keys: W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("__group", F.floor(F.col("__range") / GROUPED))
    groups = totals.groupBy("__source", "__group").agg(F.sum("__sum").alias("__all"))
    groups = groups.select(F.col("__source").alias("__gs"), F.col("__group").alias("__g"), F.coalesce(F.sum("__all").over(before("__source", "__group")), F.lit(0)).alias("__base"))
    ranges = totals.withColumn("__inside", F.coalesce(F.sum("__sum").over(before("__source", "__group", "__range")), F.lit(0)))
    ranges = ranges.join(groups, F.col("__source").eqNullSafe(F.col("__gs")) & (F.col("__group") == F.col("__g")))
    ranges = ranges.select(F.col("__source").alias("__s"), "__range", "__sum", (F.col("__base") + F.col("__inside")).alias("__before"))
    ranges = ranges.join(goal, F.col("__s").eqNullSafe(F.col("__source"))).drop("__source").withColumnRenamed("__range", "__r")
    placed = keyed.join(ranges, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__range") == F.col("__r")))
    inside, crossing = F.col("__before") + F.col("__sum") <= F.col("__rest"), (F.col("__before") < F.col("__rest")) & (F.col("__before") + F.col("__sum") > F.col("__rest"))
    taken = lambda extra: (F.col("__epochs") * F.col("size") + F.when(extra, F.col("size")).otherwise(F.lit(0))).cast("bigint").alias("taken")
    out = lambda df, extra: df.select(F.col("__id").alias(id_col), "size", "source_size", "target", taken(extra), *keep)
    order = W.partitionBy("__source").orderBy("__key", "__id", "__tie").rowsBetween(W.unboundedPreceding, -1)
    edge = placed.where(crossing).withColumn("__upto", F.col("__before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    fits = F.col("__upto") + F.col("size") / 2 <= F.col("__rest")
    return out(placed.where(~crossing), inside).unionByName(out(edge, fits))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each document, all its columns, as often as it is taken."""
    copies = plan(docs.withColumn("__row", F.struct(*[F.col(c) for c in docs.columns])), id_col, text_col, source_col, keep=("__row",), **options)
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0))
    return copies.where(times > 0).select(F.explode(F.array_repeat("__row", times)).alias("__row")).select("__row.*")
