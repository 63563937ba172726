"""Ordered per-key operators that survive a key holding a third of all rows.

A window over a whole key puts that key into one task. Keys with more than ``hot_rows`` rows
are therefore cut into slices of about that many rows; the window runs per (key, slice), and
what a slice needs from the slices before it travels as a few summary rows: the last rows,
the running total, or the touching island. All other keys keep one plain window.

Slices are cut at quantiles of the order itself, so a burst of rows at one time is cut by the
columns behind the time. No join is hinted: sizes decide.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.functions.hashing import unit_hash

HOT_ROWS = 1_000_000
#: Slices of one key at most, and rows drawn for each to find the cuts.
MOST_SLICES = 4096
DRAWN = 50
_STEP = 64


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def join_nullsafe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def with_row_slices(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``_slice`` for rows of hot keys, null for all others.

    A slice holds about ``hot_rows`` rows in the order (more only in a key of over
    ``MOST_SLICES`` times that). The cuts come from a draw of some ``DRAWN`` rows for each
    slice by a hash of the order, so an array of cuts is bounded and every use of the same
    rows finds the same cuts. Rows that are equal in all of the order stay together.
    """
    if hot_rows < 1:
        raise ValueError("hot_rows must be positive")
    keys, order = list(keys), list(order)
    slices = F.least(F.ceil(F.col("_n") / F.lit(hot_rows)), F.lit(MOST_SLICES)).cast("int")
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = counted.select(*keys, slices.alias("_slices"), (F.lit(DRAWN) * slices / F.col("_n")).alias("_share"))
    if not hot.take(1):  # nothing is cut, so no row is drawn and none is carried over
        return df.withColumn("_slice", F.lit(None).cast("bigint"))
    narrow = df.select(*dict.fromkeys([*keys, *order]))
    if keys:
        drawn = join_nullsafe(narrow, hot, keys, "inner")
    else:
        whole = hot.agg(F.max(F.struct("_slices", "_share")).alias("h")).scalar()
        drawn = narrow.withColumn("_whole", whole).select(*narrow.columns, "_whole.*").where("_share is not null")
    place = F.struct(*order)
    drawn = drawn.where(unit_hash(*[F.col(c) for c in order]) < F.col("_share"))
    sorted_rows = drawn.groupBy(*keys).agg(
        F.array_sort(F.collect_list(place)).alias("_s"), F.max("_slices").alias("_slices")
    )
    fine = F.filter(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.col("_slices") - 1, F.lit(1))),
            lambda i: F.get("_s", F.floor(i * F.size("_s") / F.col("_slices")).cast("int")),
        ), lambda c: c.isNotNull(),
    )
    # Every 64th cut is searched first, then those up to the next.
    cuts = sorted_rows.select(*keys, fine.alias("_cuts")).select(
        *keys, "_cuts", F.filter("_cuts", lambda c, i: (i + 1) % _STEP == 0).alias("_coarse")
    )
    if keys:
        # A hot key without a drawn row is one slice.
        flags = join_nullsafe(hot.select(*keys), cuts, keys)
        rows = join_nullsafe(df, flags.withColumn("_hot", F.lit(True)), keys)
    else:
        table = cuts.agg(F.max(F.struct("_cuts", "_coarse")).alias("c")).scalar()
        rows = df.withColumn("_table", table).withColumns({
            "_cuts": F.col("_table._cuts"), "_coarse": F.col("_table._coarse"), "_hot": whole.isNotNull(),
        }).drop("_table")

    def reached(among: Column) -> Column:
        return F.coalesce(F.size(F.filter(among, lambda c: c <= place)), F.lit(0))

    at = F.when(F.col("_coarse").isNull(), 0).otherwise(reached(F.col("_coarse")) * _STEP)
    rows = rows.withColumn("_at", at)
    inner = F.when(F.col("_cuts").isNull(), 0).otherwise(
        reached(F.slice("_cuts", F.col("_at") + 1, F.lit(_STEP - 1)))
    )
    found = (F.col("_at") + inner).cast("bigint")
    return rows.withColumn("_slice", F.when(F.col("_hot"), found)).drop("_cuts", "_coarse", "_hot", "_at")


def with_preceding_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int,
    columns: Sequence[str], hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Rows with their ``_slice``, and for every slice copies of the ``rows`` rows before it.

    The copies are marked ``_halo`` and carry the order and the named columns only. A window
    of up to ``rows`` preceding rows per (keys, _slice) is then exact; drop the copies after.
    """
    keys, order = list(keys), list(order)
    sliced = with_row_slices(df, keys, order, hot_rows)
    carried = list(dict.fromkeys([*order, *columns]))
    last_first = Window.partitionBy(*keys, "_slice").orderBy(*[F.desc(c) for c in order])
    # Rank filters of this form cut the rows per group before the shuffle.
    tails = (
        sliced.where(F.col("_slice").isNotNull())
        .select(*dict.fromkeys([*keys, "_slice", *carried]))
        .withColumn("_rank", F.row_number().over(last_first)).where(F.col("_rank") <= rows)
        .groupBy(*keys, "_slice")
        .agg(F.array_sort(F.collect_list(F.struct(*carried))).alias("_tail"))
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(-rows, -1)
    joined = F.flatten(F.collect_list("_tail").over(earlier))
    halo = tails.select(*keys, "_slice", joined.alias("_all")).select(
        *keys, "_slice",
        F.explode(F.when(
            F.size("_all") > rows, F.slice("_all", F.size("_all") - rows + 1, rows)
        ).otherwise(F.col("_all"))).alias("_row"),
    ).select(*keys, "_slice", *[F.col(f"_row.{c}").alias(c) for c in carried if c not in keys])
    return sliced.withColumn("_halo", F.lit(False)).unionByName(
        halo.withColumn("_halo", F.lit(True)), allowMissingColumns=True
    )


def previous_values(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``prev_<column>`` from the row before, across slices."""
    rows = with_preceding_rows(df, keys, order, 1, columns, hot_rows)
    window = Window.partitionBy(*keys, "_slice").orderBy(*order)
    lagged = rows.withColumns({f"prev_{c}": F.lag(c).over(window) for c in columns})
    return lagged.where(~F.col("_halo")).drop("_halo", "_slice")


def count_within(
    df: DataFrame, keys: Sequence[str], ts: str, seconds: float, name: str,
    condition: Column | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the number of (matching) rows of the key in the ``seconds`` up to each row.

    Rows shrink to one per key and time first. The count is the running total at a time less
    the one just before the range begins; both come from one running total over the times
    and the range beginnings together, so nothing is repeated however long the range is.
    """
    keys, span = list(keys), int(seconds * 1_000_000)
    hit = F.lit(1) if condition is None else F.coalesce(condition, F.lit(False)).cast("int")
    timed = df.withColumn("_micros", _micros(ts))
    moments = timed.where(F.col("_micros").isNotNull()).groupBy(*keys, "_micros").agg(
        F.sum(hit.cast("bigint")).alias("_hits")
    )
    ends = F.array(
        F.struct(F.col("_micros").alias("_when"), F.lit(0).alias("_probe"), F.col("_hits").alias("_hit")),
        F.struct((F.col("_micros") - span - 1).alias("_when"), F.lit(1).alias("_probe"), F.lit(0).cast("bigint").alias("_hit")),
    )
    events = moments.select(*keys, "_micros", F.inline(ends))
    summed = running_total(events, keys, ["_when", "_probe"], F.col("_hit"), "_upto", hot_rows)
    found = summed.groupBy(*keys, "_micros").agg(
        (F.max(F.when(F.col("_probe") == 0, F.col("_upto"))) - F.max(F.when(F.col("_probe") == 1, F.col("_upto"))))
        .alias(name)
    )
    return join_nullsafe(timed, found, [*keys, "_micros"]).drop("_micros").withColumn(
        name, F.coalesce(name, F.lit(0)).cast("bigint")
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the sum of ``value`` over the rows of the key up to and including each row.

    The sum before a slice enters it as one extra first row, so rows are not joined.
    """
    keys = list(keys)
    rows = with_row_slices(df.withColumn("_v", value), keys, order, hot_rows)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = (
        rows.where(F.col("_slice").isNotNull()).groupBy(*keys, "_slice").agg(F.sum("_v").alias("_sum"))
        .select(*keys, "_slice", F.sum("_sum").over(before).alias("_v"))
        .where(F.col("_v").isNotNull())
    )
    every = rows.withColumn("_head", F.lit(0)).unionByName(
        heads.withColumn("_head", F.lit(1)), allowMissingColumns=True
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(F.desc("_head"), *order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return every.withColumn(name, F.sum("_v").over(inside)).where("_head = 0").drop(
        "_slice", "_v", "_head"
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the position of each row within its key, from 1."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), name, hot_rows)


def hashed_row_numbers(df: DataFrame, at: Column, tie: str, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the position of each row, from 1, in the order of a hash in [0, 1) and then ``tie``.

    As ``row_numbers``, but the even spread of a hash tells the slices, so none is searched for. The
    rows are read twice: give it stored ones. One count for each slice comes to the driver.
    """
    slices = min(MOST_SLICES, -(-max(1, df.count()) // hot_rows))
    rows = df.withColumn("_h", at).withColumn("_slice", F.floor(F.col("_h") * slices).cast("int"))
    sizes = {r["_slice"]: r["count"] for r in rows.groupBy("_slice").count().collect()}
    starts = [0]
    for i in range(slices - 1):
        starts.append(starts[-1] + sizes.get(i, 0))
    inside = Window.partitionBy("_slice").orderBy("_h", tie)
    placed = F.row_number().over(inside) + F.get(F.lit(starts).cast("array<bigint>"), F.col("_slice"))
    return rows.withColumn(name, placed).drop("_h", "_slice")


def newest_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int, salt: Column,
    salts: int = 64,
) -> DataFrame:
    """The first ``limit`` rows per group in an order, for groups of any size.

    Each group is spread over salted parts; the second step sees ``limit`` rows of each.
    """
    rows = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= limit)
        .withColumn("_rank", F.row_number().over(whole)).where(F.col("_rank") <= limit)
        .drop("_rank", "_salt")
    )


def islands(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, condition: Column,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Stretches of consecutive rows of a key that meet the condition.

    Islands inside a slice are final. Only the first and the last island of each slice can
    go on in a neighbour, so at most two rows per slice enter the second step.
    """
    keys = list(keys)
    rows = with_row_slices(
        df.select(*keys, *dict.fromkeys([*order, ts]), F.coalesce(condition, F.lit(False)).alias("_on")),
        keys, order, hot_rows,
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    changed = (F.lag("_on").over(inside) != F.col("_on")).cast("int")
    numbered = rows.withColumn("_change", F.coalesce(changed, F.lit(0))).withColumn(
        "_island", F.sum("_change").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    local = numbered.groupBy(*keys, "_slice", "_island").agg(
        F.first("_on").alias("_on"), F.min(ts).alias("start"), F.max(ts).alias("end"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("_last", F.max("_island").over(Window.partitionBy(*keys, "_slice")))
    on_border = F.col("_slice").isNotNull() & (
        (F.col("_island") == 0) | (F.col("_island") == F.col("_last"))
    )
    final = local.where(~on_border & F.col("_on")).select(*keys, "start", "end", "n")

    across = Window.partitionBy(*keys).orderBy("_slice", "_island")
    starts = (
        (F.lag("_on").over(across) != F.col("_on")) | (F.lag("_slice").over(across) == F.col("_slice"))
    ).cast("int")
    merged = local.where(on_border).withColumn("_new", F.coalesce(starts, F.lit(0))).withColumn(
        "_group", F.sum("_new").over(across.rowsBetween(Window.unboundedPreceding, 0))
    ).groupBy(*keys, "_group").agg(
        F.first("_on").alias("_on"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.sum("n").alias("n"),
    ).where("_on").select(*keys, "start", "end", "n")
    return final.unionByName(merged)
