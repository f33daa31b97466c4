"""Running sums, carried values and the row before, within keys of any size.

A window over a whole account runs in one task. Here an account of more than `most` rows is cut into blocks
along its order (at quantiles of the first order column), each block is scanned apart from the others, and
what a block needs from those before it, a sum, a last value or a last row, is worked out on one row per block.
Accounts of fewer rows are blocks of their own. Rows that tie in the first order column stay in one block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.rounds import written

#: Rows of one key that a task may scan.
MOST = 1_000_000
BLOCK = "_block"
#: Cuts that a row is compared with at a time; a power of it holds all cuts of a key.
FAN_OUT = 32


def _blocks(df: DataFrame, keys: list[str], order: str, most: int, sized_by: DataFrame | None) -> tuple[DataFrame, bool]:
    """df with _block, and whether any key is cut: null in keys of at most `most` rows, else the number of quantiles of order below the row's.

    sized_by: what is counted instead of df, if that costs less and has no fewer rows of any key.
    """
    large = (df if sized_by is None else sized_by).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    top = large.agg(F.max("_n")).first()[0]
    if top is None:
        return df.withColumn(BLOCK, F.lit(None).cast("int")), False
    pieces = math.ceil(top / most)
    cuts = F.percentile_approx(order, [k / pieces for k in range(1, pieces)], 20 * pieces).alias("_cuts")
    cuts = written(df.join(large.select(*keys), keys, "left_semi").groupBy(*keys).agg(cuts), "scan-cuts")
    return _placed(df, keys, order, cuts, pieces), True


def _placed(df: DataFrame, keys: list[str], order: str, cuts: DataFrame, pieces: int) -> DataFrame:
    """df with _block: how many of its key's sorted _cuts, fewer than pieces, are less than order; null for keys without cuts.

    A tree of the cuts is walked, a level per join: a row meets FAN_OUT - 1 cuts at a time, never all of them.
    """
    each = cuts.select(*keys, F.posexplode("_cuts").alias("_at", "_cut")).withColumn("_at", F.col("_at") + 1)
    stride = 1
    while stride * FAN_OUT < pieces:
        stride *= FAN_OUT
    # the uppermost node of a key is there if the key has cuts, a lower one only if cuts fall into it
    rows, missing = df.withColumn(BLOCK, F.lit(0)), F.lit(None).cast("int")
    while stride:
        own = each.where((F.col("_at") % stride == 0) & (F.col("_at") % (stride * FAN_OUT) != 0))
        nodes = own.groupBy(*keys, F.expr(f"_at div {stride * FAN_OUT}").cast("int").alias(BLOCK)).agg(F.sort_array(F.collect_list("_cut")).alias("_cuts"))
        below = F.when(F.col("_cuts").isNotNull(), F.size(F.filter("_cuts", lambda c: c < F.col(order)))).otherwise(missing)
        rows = rows.join(F.broadcast(nodes), [*keys, BLOCK], "left").withColumn(BLOCK, F.col(BLOCK) * FAN_OUT + below).drop("_cuts")
        stride, missing = stride // FAN_OUT, F.lit(0)
    return rows


def _within(keys: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def _with_earlier(df: DataFrame, keys: list[str], of_block: dict[str, Column], earlier) -> DataFrame:
    """df with what the blocks before the row's one leave of each value; earlier folds the blocks' values in a window."""
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.where(F.col(BLOCK).isNotNull()).groupBy(*keys, BLOCK).agg(*[v.alias(name) for name, v in of_block.items()])
    left = blocks.withColumns({name: earlier(F.col(name)).over(before) for name in of_block}).where(f"{BLOCK} > 0")
    return df.join(left, [*keys, BLOCK], "left")


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], most: int = MOST, sized_by: DataFrame | None = None) -> DataFrame:
    """df with the sums of values over the key's rows up to this one, by order (which must tell rows apart), in one pass."""
    rows, cut = _blocks(df, keys, order[0], most, sized_by)
    window = _within(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    upto = {out: F.sum(value).over(window) for out, value in values.items()}
    if not cut:
        return rows.withColumns(upto).drop(BLOCK)
    rows = _with_earlier(rows, keys, {f"_earlier_{out}": F.sum(value) for out, value in values.items()}, F.sum)
    earlier = {out: F.col(f"_earlier_{out}") for out in values}
    return rows.withColumns({out: F.coalesce(upto[out] + earlier[out], upto[out], earlier[out]) for out in values}).drop(BLOCK, *[f"_earlier_{out}" for out in values])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, most: int = MOST, sized_by: DataFrame | None = None) -> DataFrame:
    """running_sums() of one value."""
    return running_sums(df, keys, order, {out: value}, most, sized_by)


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, most: int = MOST, sized_by: DataFrame | None = None) -> DataFrame:
    """df with out: the last value that isn't null among the key's rows up to this one."""
    rows, cut = _blocks(df, keys, order[0], most, sized_by)
    last = F.last(value, ignorenulls=True).over(_within(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    if not cut:
        return rows.withColumn(out, last).drop(BLOCK)
    rows = _with_earlier(rows, keys, {"_earlier": F.max_by(value, F.when(value.isNotNull(), F.struct(*order)))}, lambda c: F.last(c, ignorenulls=True))
    return rows.withColumn(out, F.coalesce(last, "_earlier")).drop(BLOCK, "_earlier")


def row_before(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, most: int = MOST, sized_by: DataFrame | None = None) -> DataFrame:
    """df with out: value in the key's row before this one; null in the first row."""
    rows, cut = _blocks(df, keys, order[0], most, sized_by)
    if not cut:
        return rows.withColumn(out, F.lag(value).over(_within(keys, order))).drop(BLOCK)
    kept = F.struct(value.alias("v"))
    rows = _with_earlier(rows, keys, {"_earlier": F.max_by(kept, F.struct(*order))}, F.last)
    return rows.withColumn(out, F.coalesce(F.lag(kept).over(_within(keys, order)), "_earlier")["v"]).drop(BLOCK, "_earlier")
