"""Packing into token-budget batches inside optimal length buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figweave.llm.shared import ranked, words, write_table


def length_cell(length: Column, fine: int = 512, steps: int = 64) -> Column:
    """Top of the length's histogram cell: the length itself up to `fine`, above it `steps` cells for each doubling.

    So there are at most fine + 64 * steps cells whatever the lengths.
    """
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.col("length").cast("double") - 0.5) + 1e-12)) / steps
    return F.when(length <= fine, length).otherwise((F.ceil(length / step) * step).cast("long"))


def optimal_bounds(tops: list[int], counts: list[int], sums: list[int], buckets: int) -> list[int]:
    """At most `buckets` of `tops` (ascending), the last one included, such that padding each length to the next
    bound costs least: dynamic programming over the histogram, O(buckets * cells**2)."""
    tops_, n = np.asarray(tops, dtype=float), len(tops)
    if not n:
        return []
    c, s = np.concatenate([[0], np.cumsum(counts)]).astype(float), np.concatenate([[0], np.cumsum(sums)]).astype(float)
    cost = np.concatenate([[0.0], np.full(n, np.inf)])
    back = []
    for _ in range(min(buckets, n)):
        new, frm = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        for j in range(1, n + 1):
            each = cost[:j] + (c[j] - c[:j]) * tops_[j - 1] - (s[j] - s[:j])
            frm[j] = int(np.argmin(each))
            new[j] = each[frm[j]]
        new[0] = 0.0  # fewer buckets than allowed
        back.append(frm)
        cost = new
    bounds, j = [], n
    for frm in reversed(back):
        if j <= 0:
            break
        bounds.append(int(tops_[j - 1]))
        j = frm[j]
    return bounds[::-1]


def pack_buckets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = 16, budget: int = 16384, seed: int = 1,
                 length: Column | None = None) -> DataFrame:
    """One row per row of docs: `id`, `length`, `bucket`, `padded_length`, `batch`, `slot`, `batch_rows`.

    The histogram of all lengths (words unless `length` is given) goes to the driver; its cells are bounded by length_cell. Dynamic programming over
    it chooses the bucket bounds that waste least padding. Inside a bucket, rows in hashed order fill batches: as many rows as
    fit `budget` tokens at the bucket's padded length, one row where it alone is longer. Batches are numbered
    through all buckets. A bucket with a third of all rows is spread over as many tasks as its rows need.

    Null or empty text: length 0, padded like the shortest bucket. Null ids and repeated rows are packed like others. No rows give no rows.
    """
    size = words(F.col(text_col)) if length is None else length
    rows = write_table(
        docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("mix"), F.coalesce(size, F.lit(0)).cast("long").alias("length"))
        .withColumn("cell", length_cell(F.col("length"))), "pack-rows")
    hist = rows.groupBy("cell").agg(F.count("*").alias("n"), F.sum("length").alias("s")).orderBy("cell").collect()
    bounds = optimal_bounds([r.cell for r in hist], [r.n for r in hist], [r.s for r in hist], buckets)
    if not bounds:
        return rows.select("id", "length", *[F.lit(0).cast(t).alias(c) for c, t in (("bucket", "int"), ("padded_length", "long"), ("batch", "long"), ("slot", "int"), ("batch_rows", "int"))])
    bucket = sum((F.when(F.col("cell") > b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0)).cast("int")
    spark = docs.sparkSession
    start, batch, table = 0, 0, []
    for k, top in enumerate(bounds):
        n = sum(r.n for r in hist if r.cell <= top and (not k or r.cell > bounds[k - 1]))
        fit = max(1, budget // max(1, top))
        table.append((k, top, start, n, fit, batch))
        start, batch = start + n, batch + -(-n // fit)
    facts = spark.createDataFrame(table, "bucket int, padded_length long, start long, n long, fit int, first long")
    order = ranked(rows.withColumn("bucket", bucket), ["bucket", "mix", "id", "length"], "pack-runs")
    at = F.col("_rank") - F.col("start")
    inside = F.expr("(_rank - start) div fit")
    return order.join(F.broadcast(facts), "bucket").select(
        "id", "length", "bucket", "padded_length", (F.col("first") + inside).alias("batch"), (at % F.col("fit")).cast("int").alias("slot"),
        F.least(F.col("fit"), F.col("n") - inside * F.col("fit")).cast("int").alias("batch_rows"))
