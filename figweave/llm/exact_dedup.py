"""Exact dedup: a tree merge of sorted digest runs, in binomial rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figweave.llm.shared import ascii_lower, join_counted, width, write_table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
                radix: int = 4) -> DataFrame:
    """One row per row of docs: `id`, `keep_id`, `group_size`, `kept`, `digest`.

    Rows are dealt to radix**rounds runs, at least as many as the session has shuffle partitions, by a hash of the id, so a hot text is spread over all runs. In round k
    the `radix` runs that differ only in their k-th digit exchange rows: each takes the digests whose own k-th digit
    is its own, sorts them, and merges equal ones, retaining the best identifier and the sum of counts. After
    the last round a run holds all of its digest range. A run never has more than one row per digest, so a text that a third
    of all rows share costs `radix` rows per merge. Equality is verified beyond SHA-256 by byte length and a
    second 64-bit hash, which are part of the merge key at every level.

    keep: "smallest" or "largest" identifier stays. Null text counts as empty; a null id loses against any
    other, and a group of null ids only keeps all its rows. Rows that repeat an id all stay if that id stays. Other columns are ignored. No rows give no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(keep)
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rounds = 2
    while radix**rounds < width(docs.sparkSession):
        rounds += 1
    n_runs = radix**rounds
    key = ["digest", "n_bytes", "check"]
    digests = write_table(
        docs.select(F.col(id_col).alias("id"), text.alias("t"))
        .select("id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").alias("n_bytes"), F.xxhash64("t").alias("check")),
        "digests",
    )
    home = F.pmod(F.col("check"), F.lit(n_runs))
    best = F.min if keep == "smallest" else F.max

    def digit(x, k):
        return F.floor(x / F.lit(radix**k)) % radix

    def after(x, k):
        return (x + (digit(home, k) - digit(x, k)) * radix**k).cast("long")

    # round 0 exchanges leaf runs; the map side collapses equal digests of a leaf first
    runs = (
        digests.withColumn("run", after(F.pmod(F.xxhash64("id"), F.lit(n_runs)), 0))
        .groupBy("run", *key).agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    order = F.col("keep_id").asc_nulls_last() if keep == "smallest" else F.col("keep_id").desc_nulls_last()
    for k in range(1, rounds):
        merge = W.partitionBy("run", *key)
        runs = (
            runs.withColumn("run", after(F.col("run"), k)).repartition(n_runs, "run")
            .withColumn("place", F.row_number().over(merge.orderBy(order)))
            .withColumn("group_size", F.sum("group_size").over(merge))
            .filter("place = 1").drop("place")
        )
    merged = write_table(runs.drop("run"), "digest-runs")
    total = digests.count()
    out = join_counted(digests, merged, key, "group_size", total)
    return out.select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("digest")
    )
