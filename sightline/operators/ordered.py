"""Last value before a row within a key, computed in blocks so that no key has to fit one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_before(df: DataFrame, keys: list[str], order: list[str], block: Column, value: Column, out: str, inclusive: bool = False) -> DataFrame:
    """Adds `out`: the last non-null `value` in rows of the same keys before the row (or up to it), by `order`.

    `block` must not decrease along `order`; rows of a key are windowed block by block, and one summary row for
    each block carries its last value on, so a key that holds a third of all rows is spread over its blocks.
    Rows tied in `order` have no defined order between them. Null keys form a group of their own.
    """
    rows = df.withColumn("_block", block).withColumn("_value", value)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    blocks = rows.groupBy(*keys, "_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_last"))
    outer = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.withColumn("_carry", F.last("_last", ignorenulls=True).over(outer)).select(*[F.col(c).alias(f"_k_{c}") for c in keys], F.col("_block").alias("_k_block"), "_carry")
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keys] + [F.col("_block").eqNullSafe(F.col("_k_block"))]
    filled = rows.withColumn("_inner", F.last("_value", ignorenulls=True).over(inner)).join(carried, on, "left")
    return filled.withColumn(out, F.coalesce("_inner", "_carry")).drop("_block", "_value", "_inner", "_carry", "_k_block", *[f"_k_{c}" for c in keys])
