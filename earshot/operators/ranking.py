"""Row numbers that hold when one group has most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.session import materialize


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str,
           max_rank: int | None = None) -> DataFrame:
    """Number the rows of each group (or of the whole table when `group` is empty) from 1.

    With `max_rank`, every map task drops all but its best rows per group before the shuffle,
    so a hot group costs at most max_rank rows per task. Without it, rows are range-partitioned
    by (group, order), numbered within each slice, and shifted by the rows of the same group in
    earlier slices: a hot group spreads over many tasks. `order` must be free of ties.
    """
    group = list(group)
    if max_rank is not None:
        if not group:
            top = df.orderBy(*order).limit(max_rank)
            return top.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
        spec = Window.partitionBy(*group).orderBy(*order)
        return (df.withColumn(name, F.row_number().over(spec))
                .filter(F.col(name) <= max_rank)
                .withColumn(name, F.col(name).cast("long")))

    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(
        df.repartitionByRange(slices, *[F.col(g).asc() for g in group], *order)
        .withColumn("_slice", F.spark_partition_id()))
    # Only a group that continues from an earlier slice has an offset, and a slice has at most
    # one such group, so `offsets` never exceeds the number of slices.
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (cut.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_offset", F.sum("_n").over(earlier))
               .filter(F.col("_offset") > 0)
               .select(*[F.col(g).alias(f"_g_{g}") for g in group],
                       F.col("_slice").alias("_s"), "_offset"))
    same = F.col("_slice") == F.col("_s")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    spec = Window.partitionBy("_slice", *group).orderBy(*order)
    return (cut.withColumn("_local", F.row_number().over(spec))
            .join(F.broadcast(offsets), same, "left")
            .withColumn(name, F.col("_local").cast("long") + F.coalesce("_offset", F.lit(0).cast("long")))
            .select(*df.columns, name))


def positions(df: DataFrame, need: Column, name: str) -> DataFrame:
    """One row per position 1..need, to be equi-joined with a ranked list."""
    return df.filter(need >= 1).withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), need.cast("long"))))
