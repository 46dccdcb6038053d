"""What the operators of this subpackage share: stage tables, components, salted running sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.operators.components import checkpoint_dir, components, cut, stage_step, stage_table

__all__ = ["checkpoint_dir", "components", "crc_bucket", "cut", "finite", "lookup", "running_total", "scaled", "stage_step", "stage_table"]


def crc_bucket(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text, modulo: the split into learning rows and held-out rows; null keys give null."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def running_total(df: DataFrame, value: str, out: str, salt: Column, order: list[str]) -> DataFrame:
    """df with `out`: the sum of `value` over all rows before this one, in the order (salt, order).

    Two levels: a window within each salt and one over the salts' sums, so that no task gets all rows.
    """
    salted = df.withColumn("_salt", salt)
    within = Window.partitionBy("_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy("_salt").agg(F.sum(value).alias("_sum"))
    bases = sums.select("_salt", F.coalesce(F.sum("_sum").over(over), F.lit(0)).cast("long").alias("_base"))
    local = salted.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)).cast("long"))
    return local.join(bases, "_salt").withColumn(out, F.col("_base") + F.col("_in")).drop("_salt", "_base", "_in")


def lookup(rows: DataFrame, table: DataFrame, key: str, total: int, unique: Column, *, hot: int = 1000) -> DataFrame:
    """rows left-joined with table (one row a key, with `n`: the rows that have the key), which adds its columns but `n`.

    total: the number of rows. Keys with more than a `hot`-th of them, fewer than `hot` keys, are looked up in a
    broadcast; the others by a join that Spark broadcasts or shuffles by the table's size. Rows settled or without a
    key go to the latter by `unique`, a string of their own, so they don't meet in one task.
    """
    added = [c for c in table.columns if c not in (key, "n")]
    named = lambda df, p: df.select(F.col(key).alias(f"{p}key"), *(F.col(c).alias(f"{p}{c}") for c in added))
    often = named(table.filter(F.col("n") * hot > total), "_hot_")
    seldom = named(table.filter(F.col("n") * hot <= total), "_cold_")
    first = rows.join(F.broadcast(often), F.col(key) == F.col("_hot_key"), "left")
    probe = F.when(F.col("_hot_key").isNull() & F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(F.concat(F.lit("#"), unique))
    both = first.withColumn("_probe", probe).join(seldom, F.col("_probe") == F.col("_cold_key").cast("string"), "left")
    return both.select(*rows.columns, *(F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in added))


def finite(vector: Column) -> Column:
    """True for a vector whose components are all there, no NaN and not infinite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def scaled(raw: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale x) as 64-bit integers; beyond +-sqrt(2**61 / dimensions), where sums of products could overflow, cut."""
    most = np.floor(np.sqrt(2.0**61 / max(1, raw.shape[1])))
    return np.clip(np.floor(np.clip(raw, -most, most) * scale), -most, most).astype(np.int64)
