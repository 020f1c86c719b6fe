"""Small Spark helpers that several training-data operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A key with at least 1/HEAVY of all rows is heavy, so there are at most HEAVY such keys.
HEAVY = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the word rule, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset on a local master: a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_dir.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="spark-figweave-"))


def _tables_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/figweave-{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Deletes all tables and archives that this application has put into the shared folder; call it when results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_tables_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{_tables_root(spark)}/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes what write_table wrote for df; nothing that is still to run may read it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def width(spark: SparkSession) -> int:
    """How many partitions an explicit repartition uses: the session's shuffle setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the fast built-in path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ runs in text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_counted(facts: DataFrame, dims: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of facts with one row per key in dims, safe against hot keys.

    `count` is a dims column: how many fact rows the key has; its sum is at most `total`. Keys with at least
    total/HEAVY rows are HEAVY at most, a proven bound, so they are broadcast and their facts stay where they are.
    All other keys are too small to skew a shuffle join. Without heavy keys it is a plain join. Keys must not be null; dims is best a written table, as it is read several times.
    """
    heavy = F.col(count) * F.lit(HEAVY) >= F.lit(total)
    if dims.filter(heavy).isEmpty():
        return facts.join(dims, keys)
    hot = F.broadcast(dims.filter(heavy))
    rest = dims.filter(~heavy)
    here = facts.join(hot, keys)
    there = facts.join(F.broadcast(dims.filter(heavy).select(*keys)), keys, "left_anti").join(rest, keys)
    return here.unionByName(there)


def ranked(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """df with `_rank`, its 0-based place in the total order of `order`, without a global one-task sort.

    Range partitions are sorted and written once; each row's place is its place in the partition plus the
    rows of the partitions before, of which there are as many as shuffle partitions (broadcast, so bounded).
    """
    n = width(df.sparkSession)
    runs = write_table(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id()), label
    )
    runs = runs.withColumn("_part", F.shiftright("_pos", 33))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        runs.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    at = F.col("_start") + F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    return runs.join(F.broadcast(starts), "_part").withColumn("_rank", at).drop("_part", "_pos", "_start")
