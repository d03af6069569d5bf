"""Ranking within groups that stays spread out when one group is huge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from relweave.session import materialize


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int | Column, rank: str) -> DataFrame:
    """First ``k`` rows per key with their rank.

    Spark puts a group limit under the shuffle for a constant ``k``, so a hot key sends ``k`` rows
    per map task instead of all of them.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def ranged(df: DataFrame, keys: Sequence[str], order: str, parts: int | None = None) -> DataFrame:
    """The rows, stored, with the number of the range partition of (keys, order) they are in.

    Spark samples the bounds, so the ranges are of about equal size whatever the values look like, and a
    large group is cut into several.  They are stored because another sample would number them anew.
    """
    number = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(number, *keys, order).withColumn("_part", F.spark_partition_id()), "ranged")


def running_sum(df: DataFrame, keys: Sequence[str], order: str, weight: Column, total: str, parts: int | None = None) -> DataFrame:
    """Exact running sum of ``weight`` in the order of a column within ``keys``; no group is sorted as a whole.

    It is the sum of the range partitions before a row's own (few rows for each group) plus the running sum within it.
    """
    rows = ranged(df.withColumn("_weight", weight), keys, order, parts)
    sizes = rows.groupBy(*keys, "_part").agg(F.sum("_weight").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.sum("_weight").over(Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    same = rows["_part"] == offsets["_part"]
    for key in keys:
        same = same & rows[key].eqNullSafe(offsets[key])
    numbered = rows.withColumn("_inside", inside).alias("r").join(offsets.alias("o"), same)
    return numbered.select("r.*", (F.col("o._before") + F.col("r._inside")).alias(total)).drop("_part", "_weight", "_inside")


def grouped_row_number(df: DataFrame, keys: Sequence[str], id_column: str, rank: str, parts: int | None = None) -> DataFrame:
    """Exact row number by ``id_column`` within ``keys``."""
    return running_sum(df, keys, id_column, F.lit(1).cast("long"), rank, parts)


def nearest_rank_percentile(df: DataFrame, keys: Sequence[str], value: str, percent: int, accuracy: int = 10000) -> DataFrame:
    """The value at rank ``ceil(n * percent / 100)`` per group, or of all rows without keys, exactly.

    Equal values are counted first.  A quantile sketch, which merges map-side, then brackets the
    wanted rank, so only about one value in a thousand of a group is ordered.  Should a bracket miss
    its rank, the whole group is ordered instead.
    """
    keys = list(keys)
    filled = df.where(F.col(value).isNotNull())
    margin = 3 / accuracy
    points = [max(0.0, percent / 100 - margin), min(1.0, percent / 100 + margin)]
    bounds = filled.groupBy(*keys).agg(
        F.percentile_approx(value, points, accuracy).alias("_bounds"),
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * percent / 100)).alias("_rank"),
    )
    counted = filled.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = _attach(counted, bounds, keys)
    below = F.col(value) < F.col("_bounds")[0]
    inside = ~below & (F.col(value) <= F.col("_bounds")[1])
    sums = placed.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(below, F.col("_n"))), F.lit(0)).alias("_below"),
        F.coalesce(F.sum(F.when(inside, F.col("_n"))), F.lit(0)).alias("_inside"),
    )
    hit = (F.col("_below") < F.col("_rank")) & (F.col("_rank") <= F.col("_below") + F.col("_inside"))
    wanted = _attach(placed, sums, keys).where(inside | ~hit)
    start = F.when(hit, F.col("_below")).otherwise(F.lit(0))
    placed = running_sum(wanted.withColumn("_start", start), keys, value, F.col("_n"), "_sum")
    found = placed.where(F.col("_start") + F.col("_sum") >= F.col("_rank"))
    return found.groupBy(*keys).agg(F.min(value).alias("percentile_value"))


def _attach(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of each group on its rows; without keys there is one row of totals, read as scalars."""
    if keys:
        return df.join(totals, keys)
    return df.withColumns({c: totals.select(c).scalar() for c in totals.columns})
