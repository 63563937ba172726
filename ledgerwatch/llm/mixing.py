"""Mixing sources to target weights by hash thresholds, in DataFrame and SQL functions only.

Every document has a hash. A budget of a source is a threshold: the documents whose hash is
below it. So the documents of a smaller budget are among those of a larger one. The threshold
comes from a histogram: sizes are summed by source and leading bits of the hash, the running
sum tells the bucket in which the budget ends, and only the documents of that bucket are summed
by the next bits, until the whole hash is used. No document is sorted; the last step is a filter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerwatch.llm.common import SPACE, text_of
from ledgerwatch.session import materialise, require_columns

_BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
#: Bits of the hash that each histogram takes; a histogram has at most 2 to that many buckets a source.
LEVELS = (12, 16, 16, 16)
BITS = sum(LEVELS)
#: Copies of a source's row, so that the rows of one source meet it in as many tasks.
SALTS = 64


def n_words(text: str) -> Column:
    """Words between ASCII white space: each becomes one character, blanks go."""
    return F.length(F.translate(F.regexp_replace(text, f"[^{SPACE}]+", "x"), _BLANKS, "")).cast("long")


def document_hash() -> Column:
    """The first 60 bits of a digest of id and text: equal on every run."""
    digest = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("text")))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def sizes(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id, source, size, hash`` of every document, stored: the whole texts are read once."""
    require_columns(df, id_col, text_col, source_col)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text"),
                     F.col(f"`{source_col}`").cast("string").alias("source"))
    return materialise(rows.select("id", "source", n_words("text").alias("size"), document_hash().alias("hash")), "mix-sizes")


def targets(per_source: DataFrame, weights: Sequence[int], shares: Sequence[float], most: int) -> DataFrame:
    """One row per source and share (numbered): ``source, share_no, source_size, target``.

    Sources in code point order, null last, take the weights in turn. A target is the weight's
    part of the share of all sizes, but at most ``most`` times the source's size; what is over
    goes to the others by weight. That ends at one level for all: the target is the smaller of
    the bound and level times weight. With the sources by bound over weight, the level is the
    greatest of (budget - bounds before) / (weights from here on).

    The rows here are the sources, not the documents: one task numbers them.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    listed = per_source.withColumn("_w", F.element_at(F.lit(list(weights)), (F.row_number().over(order) - 1) % len(weights) + 1))
    listed = listed.withColumn("_cap", most * F.col("source_size"))
    by_bound = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before = F.coalesce(F.sum("_cap").over(by_bound.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("_w").over(by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    listed = listed.withColumns({"_before": before, "_onward": onward, "_all": F.sum("source_size").over(Window.partitionBy())})
    listed = listed.select("*", F.posexplode(F.lit([float(s) for s in shares])).alias("share_no", "_share"))
    level = F.max((F.col("_share") * F.col("_all") - F.col("_before")) / F.col("_onward")).over(Window.partitionBy("share_no"))
    return listed.withColumn("_level", level).select(
        "source", "share_no", "source_size", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")).alias("target"))


def _crossing(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """With ``before``, the sizes of the earlier buckets of the same keys, and ``upto``."""
    upto = F.sum("size").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return histogram.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("size"))


def thresholds(sized: DataFrame, budgets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For each row of ``budgets(sizes per source)``, in which ``rest`` is a budget below the source's
    size, ``below``: documents of the source with a smaller hash come nearest to it in sum.

    Documents of one hash (the same id and text) stand or fall together.
    """
    bucket = F.shiftright("hash", BITS - LEVELS[0])
    first = materialise(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size")), "mix-histogram")
    wanted = budgets(first.groupBy("source").agg(F.sum("size").alias("source_size")))
    cut = _crossing(first, ["source"]).withColumnRenamed("source", "_source")
    inside = (F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("upto"))
    state = wanted.join(cut, F.col("source").eqNullSafe(F.col("_source")) & inside, "left").select(
        *wanted.columns, "bucket", (F.col("rest") - F.col("before")).alias("left"))
    state = materialise(state, "mix-boundaries")

    def bounds(frame: DataFrame) -> DataFrame:
        return frame.select(F.col("source").alias("_source"), F.col("share_no"), F.col("bucket").alias("_bucket"), "left")

    at = bounds(state.where("bucket is not null"))
    edge = materialise(sized.join(at, F.col("source").eqNullSafe(F.col("_source")) & (bucket == F.col("_bucket"))).select(
        "source", "share_no", "size", "hash"), "mix-boundary-rows")
    used, found = LEVELS[0], state
    for bits in LEVELS[1:]:
        below = edge.withColumnRenamed("share_no", "_no").join(
            at, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_no") == F.col("share_no"))
            & (F.shiftright("hash", BITS - used) == F.col("_bucket")))
        used += bits
        histogram = below.groupBy("source", "share_no", "left", F.shiftright("hash", BITS - used).alias("bucket")).agg(F.sum("size").alias("size"))
        found = _crossing(histogram, ["source", "share_no"]).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("upto")))
        found = found.select("source", "share_no", "bucket", "size", (F.col("left") - F.col("before")).alias("left"))
        at = bounds(found)
    last = found.select(F.col("source").alias("_source"), F.col("share_no").alias("_no"),
                        (F.col("bucket") + F.when(2 * F.col("left") > F.col("size"), 1).otherwise(0)).alias("below"))
    joined = state.join(last, F.col("source").eqNullSafe(F.col("_source")) & (F.col("share_no") == F.col("_no")), "left")
    return joined.select(*wanted.columns, F.coalesce("below", F.lit(0)).cast("long").alias("below"))


def mix(df: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int] = (3, 1, 2),
        shares: Sequence[float] = (1.5,), most: int = 2) -> DataFrame:
    """How often each document goes into mixes of the given shares of all sizes: ``id, source,
    size, source_size, target, taken``; ``target`` and ``taken`` are arrays with an entry a share.

    The size of a text is its number of words between ASCII white space. ``target`` is the
    source's (see ``targets``). A document is taken whole, 0 to ``most`` times; ``taken`` is its
    size times that. What a source gives is as near to its target as whole documents in the
    order of their hashes allow: within half the size of the document at the threshold. A
    document in a smaller share's mix is in that of a larger share as often at least.

    Null texts are empty and count 0; null sources are one source, the last; null ids are
    ids like others; rows repeated with id and text are taken alike; other columns are
    ignored; an empty table gives no rows. Runs on the same rows agree.
    """
    if not weights or not shares or min(weights) < 1 or min(shares) < 0 or most < 1:
        raise ValueError("weights must be positive, shares not negative and most at least 1")
    sized = sizes(df, id_col, text_col, source_col)

    def budgets(per_source: DataFrame) -> DataFrame:
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
        wanted = targets(per_source, weights, shares, most).withColumn("whole", whole)
        return wanted.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))

    per_source = thresholds(sized, budgets).groupBy(F.col("source").alias("_source")).agg(
        F.sort_array(F.collect_list(F.struct("share_no", "target", "whole", "below"))).alias("_plan"), F.max("source_size").alias("source_size"))
    copies = per_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod("hash", F.lit(SALTS)).cast("int")
    joined = sized.join(copies, F.col("source").eqNullSafe(F.col("_source")) & (salt == F.col("_salt")))
    times = F.transform("_plan", lambda p: F.col("size") * (p["whole"] + F.when(F.col("hash") < p["below"], 1).otherwise(0)))
    return joined.select("id", "source", "size", "source_size", F.col("_plan.target").alias("target"), times.alias("taken"))
