"""Ranks and first rows of groups, without a task that holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.operators.components import stage_table


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)))


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], out: str, *, weight: str | None = None) -> DataFrame:
    """df with `out`: the number of a row (from 1) within its keys in the given order, which should be total.

    With `weight` it is the sum of that column over the rows before, 0 at first. Two levels: rows are dealt by ranges of
    (keys, order) and numbered within a range; the ranges' totals, one row a range and key, give each its start. No task
    gets more than a range, also where one key has all rows. The ranges are written once when this is called, as a
    second look must find the same.
    """
    dealt = stage_table(df.repartitionByRange(*keys, *order).withColumn("_cw_range", F.spark_partition_id()), "ranges")
    mine = Window.partitionBy(*keys, "_cw_range").orderBy(*order)
    value = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    totals = dealt.groupBy(*keys, "_cw_range").agg(F.sum(value).alias("_cw_n"))
    before = F.sum("_cw_n").over(Window.partitionBy(*keys).orderBy("_cw_range").rowsBetween(Window.unboundedPreceding, -1))
    named = [f"_cw_{i}" for i in range(len(keys))]
    start = totals.select(*(F.col(k).alias(n) for k, n in zip(keys, named)), F.col("_cw_range").alias("_cw_r"), F.coalesce(before, F.lit(0)).alias("_cw_start"))
    local = F.row_number().over(mine) if weight is None else F.coalesce(F.sum(value).over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = dealt.withColumn("_cw_local", local).join(start, _same([*keys, "_cw_range"], [*named, "_cw_r"]))
    return joined.select(*(c for c in df.columns if c != out), (F.col("_cw_start") + F.col("_cw_local")).cast("long").alias(out))


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str], most: int, out: str, *, salts: int = 64) -> DataFrame:
    """The first `most` rows of each key with their rank `out`: first those of each of `salts` parts of a key, which the
    planner cuts before the shuffle, then of the at most `salts * most` rows that are left of it."""
    part = df.withColumn("_cw_salt", F.pmod(F.xxhash64(*(c for c, t in df.dtypes if not t.startswith(("map", "variant")))), F.lit(salts)))
    some = part.withColumn("_cw_n", F.row_number().over(Window.partitionBy(*keys, "_cw_salt").orderBy(*order))).filter(F.col("_cw_n") <= most).drop("_cw_salt", "_cw_n")
    return some.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= most)
