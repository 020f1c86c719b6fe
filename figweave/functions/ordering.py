"""Places in a total order without a one-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figweave.functions.lineage import cut


def ranked(df: DataFrame, order: list[str], within: str | None = None) -> DataFrame:
    """df with `rank`, from 0: its place in the order of `order`, or among the rows of its `within` value.

    Range partitions are sorted and cut; a row's place is its place in the partition plus the rows in the partitions before. These counts are one row per partition (and value of
    `within` in it), so a value that holds most rows is spread over partitions like any other. The cut is written when this is called, not when its result is read.
    """
    keys = [within] if within else []
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = cut(df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    own = own.withColumn("_part", F.shiftright("_at", 33))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = own.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return own.join(starts.drop("_n"), [*keys, "_part"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_start")).drop("_at", "_part", "_first", "_start")
