"""Cutting one long source into blocks that are worked on apart.

A source (a flight, an aircraft) may hold a third of all rows, so no operator
here partitions by the source alone. Rows go to blocks of consecutive numbers
or of time, and the rows near an edge also go to the neighbouring block as
context ("halo"), so that every look-back stays inside one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def block_of(pos: Column, size: float) -> Column:
    """The block of a position. Zero lies mid-block, so a short source that starts there has no edge."""
    return F.floor((pos + F.lit(size / 2.0)) / F.lit(float(size))).cast("bigint")


def with_halo(df: DataFrame, pos: Column, size: float, before: float, after: float, block: str = "blk") -> DataFrame:
    """Each row once per block that needs it.

    A block (see `block_of`) also gets the rows up to `before` below its start and
    up to `after` above its end. Rows with a null position are left out. The column
    `<block>_home` tells whether the row is the block's own.
    """
    home = block_of(pos, size)
    first, last = block_of(pos - F.lit(float(after)), size), block_of(pos + F.lit(float(before)), size)
    return (
        df.where(pos.isNotNull())
        .withColumn(f"{block}_own", home)
        .withColumn(block, F.explode(F.sequence(first, last)))
        .withColumn(f"{block}_home", F.col(block) == F.col(f"{block}_own"))
        .drop(f"{block}_own")
    )


def previous_row(df: DataFrame, key: str, order: list[str], bucket: Column, carry: list[str], prefix: str = "prev_") -> DataFrame:
    """Each row with its predecessor's columns within `key`, without one task per key.

    `bucket` must grow with the order. Inside a bucket it is a plain lag; for the first row
    of a bucket it is the last row of the nearest earlier bucket that has rows, taken from a
    table with one row per (key, bucket). No predecessor gives nulls.
    """
    cols = df.columns
    rec = F.struct(*[F.col(c) for c in carry])
    b = df.withColumn("_bucket", bucket)
    inside = W.partitionBy(key, "_bucket").orderBy(*order)
    lagged = b.withColumn("_prev", F.lag(rec).over(inside)).withColumn("_rn", F.row_number().over(inside))
    tails = (
        b.withColumn("_last", F.struct(*[F.col(c) for c in order], rec.alias("_rec")))
        .groupBy(key, "_bucket")
        .agg(F.max_by("_last", F.struct(*[F.col(c) for c in order])).alias("_last"))
    )
    heads = tails.select(
        F.col(key).alias("_k"),
        F.col("_bucket").alias("_b"),
        F.lag("_last._rec").over(W.partitionBy(key).orderBy("_bucket")).alias("_before"),
    )
    out = lagged.join(heads, (F.col(key) == F.col("_k")) & (F.col("_bucket") == F.col("_b")), "left")
    prev = F.when(F.col("_rn") == 1, F.col("_before")).otherwise(F.col("_prev"))
    return out.select(*cols, *[prev[c].alias(prefix + c) for c in carry])


def meet_salted(big: DataFrame, small: DataFrame, keys: list[str], by: Column, salts: int = 16, how: str = "inner") -> DataFrame:
    """`big` joined to `small`, which has a row or few per key, where one key may hold a third of `big`.

    The rows of `small` are repeated once per salt and those of `big` are spread over the salts by
    `by`, so the hot key is `salts` tasks and nothing has to fit into memory whole.
    """
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(spread, [*keys, "_salt"], how).drop("_salt")
