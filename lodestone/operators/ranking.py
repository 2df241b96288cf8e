"""Places in a global order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources import staging


def placed(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """df with each row's place from 0 on. ``order`` should end in something that tells rows apart.

    Spark's sampled ranges put the rows in order between partitions; a row's place is its place in its partition
    and the sizes of the partitions ahead, one number each.
    """
    parts = staging.staged(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    # One row for each partition: the window over all of them is as small as their number.
    ahead = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return parts.join(F.broadcast(ahead), "part").withColumn(name, (F.col("ahead") + own - 1).cast("long")).drop("part", "ahead")
