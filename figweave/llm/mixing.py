"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figweave.llm.shared import join_counted, words, write_table


def cycled_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, weight): sources by code point, null last, weigh by the cycle. One row per source, so one task is enough."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.select("source", F.element_at(F.array(*map(F.lit, cycle)), place % len(cycle) + 1).cast("double").alias("weight"))


def capped_targets(sources: DataFrame, cap: float = 3.0) -> DataFrame:
    """sources(source, weight, source_size) with `target`: shares of the sum of sizes by weight, none above cap times its size.

    Resharing the excess by weight until none is above is min(cap * size, level * weight) with one level for all;
    each round is one aggregate over the sources and sends three numbers to the driver.
    """
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / weight if weight else 0.0
    full = F.col("source_size") * cap < F.col("weight") * F.lit(level)
    while total:
        taken, left, n = sources.agg(F.sum(F.when(full, F.col("source_size") * cap)), F.sum(F.when(~full, F.col("weight"))), F.count("*")).first()
        higher = (total - (taken or 0.0)) / left if left else float("inf")
        if higher <= level * (1 + 1e-12):
            break
        level = higher
        full = F.col("source_size") * cap < F.col("weight") * F.lit(level)
        if level == float("inf"):
            break
    target = F.when(full, F.col("source_size") * cap).otherwise(F.col("weight") * F.lit(level)) if level != float("inf") else F.col("source_size") * cap
    return sources.withColumn("target", target.cast("double"))


def expected_copies(rows: DataFrame, plans: DataFrame, cap: float = 3.0, tilt: float = 0.5) -> DataFrame:
    """plans(key, target, source_size, ..) with `scale`: a document's expected copies are min(cap, scale * size**tilt), and these times the sizes make the target.

    Documents at the cap are found over a histogram of sizes, sixteen cells to a doubling, so one row per source and cell is ordered and no document. The scale is exact but
    for the one cell in which the cap begins.
    """
    measure = F.pow(F.col("size").cast("double"), F.lit(tilt))
    hist = rows.filter("size > 0").groupBy("key", F.floor(F.log2("size") * 16).alias("step")).agg(
        F.sum("size").alias("words"), F.sum(F.col("size") * measure).alias("moment"), F.max(measure).alias("top"))
    upto, behind = W.partitionBy("key").orderBy("step"), W.partitionBy("key").orderBy(F.desc("step")).rowsBetween(W.unboundedPreceding, -1)
    tried = hist.join(plans.select("key", "target", "source_size"), "key")
    free = (F.col("target") - cap * F.coalesce(F.sum("words").over(behind), F.lit(0))) / F.sum("moment").over(upto)
    tried = tried.withColumn("free", free).withColumn("fits", (F.col("free") > 0) & (F.col("free") * F.col("top") <= cap * (1 + 1e-12)))
    found = tried.groupBy("key").agg(F.max_by("free", F.when(F.col("fits"), F.col("step"))).alias("free"), F.min("top").alias("least"))
    # nothing below the cap but part of the lowest cell
    found = found.select("key", F.coalesce("free", cap / F.col("least")).alias("scale"))
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    return plans.join(found, "key", "left").withColumn("scale", F.when(full, float("inf")).otherwise(F.coalesce("scale", F.lit(0.0))))


def pareto_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: DataFrame | None = None, cap: float = 3.0, tilt: float = 0.5, seed: int = 1, cells: int = 4096) -> DataFrame:
    """One row per row of docs: `id`, `source`, `size`, `source_size`, `target`, `copies`, `taken`, `expected`, `th`.

    Each document has its own expected copies, min(cap, scale * size**tilt), with the scale of its source such that the expected words are the source's
    target (see expected_copies; tilt 0 makes all documents of a source alike). floor(expected) whole copies are certain. The rest p is the inclusion probability of a
    fixed-size Pareto sample: documents in ascending order of random odds u/(1-u) over inclusion odds p/(1-p), with u a hash of (seed, id, text), while
    their words fit the words left. The size is fixed in words: of the documents after the cut, the one whose size comes nearest to the gap fills it, if that is better than
    leaving it.

    The cut is found without sorting a source: word sums per (source, cell of the order) give the cell of the cut, and only
    that cell, about 1/cells of a source, is ordered row by row. A hot source therefore shuffles like any other.

    Size is in words. Null text: 0 words, taken 0. Null source: a source of its own. Rows that repeat an id draw alike and are ordered
    arbitrarily but equally. Null id draws by its text. Extra columns are ignored. No rows give no rows. Reruns agree.
    """
    key = F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col)))
    rows = write_table(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), key.alias("key"), words(F.col(text_col)).alias("size"),
                    F.xxhash64(F.col(text_col)).alias("th"), F.monotonically_increasing_id().alias("row")), "mix-rows",
    )
    sources = write_table(
        rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), "mix-sources")
    weights = cycled_weights(sources.select("source")) if weights is None else weights.select("source", F.col("weight").cast("double"))
    weighed = sources.join(weights, sources["source"].eqNullSafe(weights["source"]), "left").select(
        "key", "source_size", "n_docs", F.coalesce(weights["weight"], F.lit(0.0)).alias("weight"))
    plans = write_table(capped_targets(write_table(weighed, "mix-weights"), cap).drop("weight"), "mix-targets")
    plans = write_table(expected_copies(rows, plans, cap, tilt), "mix-plans")
    total = rows.count()
    expected = F.when(F.col("size") > 0, F.least(F.lit(cap), F.col("scale") * F.pow(F.col("size").cast("double"), F.lit(tilt)))).otherwise(0.0)
    u = (F.pmod(F.xxhash64(F.lit(seed), "id", "th"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # the Pareto rank Q = u/(1-u) / (p/(1-p)) as Q/(1+Q), which keeps its order and lies in 0 to 1
    rank = u * (1 - F.col("p")) / (u * (1 - F.col("p")) + (1 - u) * F.col("p"))
    dealt = (
        join_counted(rows, plans, ["key"], "n_docs", total)
        .withColumn("expected", expected).drop("scale").withColumn("whole", F.floor(F.col("expected") + 1e-12)).withColumn("p", F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0)))
        .withColumn("rank", F.when(F.col("p") > 0, rank).otherwise(1.0))
        .withColumn("cell", F.when(F.col("p") > 0, F.least(F.floor(F.col("rank") * cells), F.lit(cells - 1))).otherwise(cells).cast("int"))
    )
    sums = dealt.groupBy("key", "cell").agg(
        F.sum(F.when(F.col("p") > 0, F.col("size")).otherwise(0)).alias("cell_size"), F.sum(F.col("whole") * F.col("size")).alias("certain"), F.first("target").alias("target"), F.first("n_docs").alias("n_docs"))
    per_key = W.partitionBy("key")
    cuts = (
        sums.withColumn("left", F.greatest(F.col("target") - F.sum("certain").over(per_key), F.lit(0.0)))
        .withColumn("end", F.sum("cell_size").over(per_key.orderBy("cell"))).withColumn("begin", F.col("end") - F.col("cell_size"))
        .withColumn("cuts", (F.col("begin") < F.col("left")) & (F.col("left") <= F.col("end")))
        .groupBy("key").agg(F.min(F.when(F.col("cuts"), F.struct("cell", "begin"))).alias("c"), F.first("left").alias("left"), F.first("n_docs").alias("n_docs"))
    )
    # without a cut nothing is left to sample, or, by rounding, all of it fits
    cuts = write_table(cuts.select("key", "n_docs", "left", F.coalesce("c.cell", F.when(F.col("left") > 0, cells).otherwise(-1)).alias("cut_cell"), F.coalesce("c.begin", F.lit(0)).alias("begin")), "mix-cuts")
    placed = join_counted(dealt.drop("n_docs"), cuts, ["key"], "n_docs", total)
    outside = placed.filter("cell <> cut_cell").withColumn("drawn", F.col("cell") < F.col("cut_cell"))
    run = per_key.orderBy("rank", "id", "row").rowsBetween(W.unboundedPreceding, 0)
    inside = placed.filter("cell = cut_cell").withColumn("drawn", (F.col("p") > 0) & (F.col("begin") + F.sum("size").over(run) <= F.col("left")))
    drawn = write_table(outside.unionByName(inside).drop("n_docs", "begin", "cell", "cut_cell"), "mix-drawn")
    gaps = drawn.groupBy("key").agg(
        (F.first("left") - F.sum(F.when(F.col("drawn"), F.col("size")).otherwise(0))).alias("gap"), F.count("*").alias("n_docs"))
    gaps = write_table(gaps, "mix-gaps")
    off = F.abs(F.col("size") - F.col("gap"))
    fillers = (
        join_counted(drawn.filter("not drawn and p > 0"), gaps.filter("gap > 0"), ["key"], "n_docs", total).filter(off < F.col("gap"))
        .groupBy("key").agg(F.min_by("row", F.struct(off, "rank", "row")).alias("filler")))
    fillers = write_table(gaps.select("key", "n_docs").join(fillers, "key", "left"), "mix-fillers")
    out = join_counted(drawn, fillers, ["key"], "n_docs", total)
    copies = (F.col("whole") + (F.col("drawn") | F.col("row").eqNullSafe(F.col("filler"))).cast("int")).cast("long")
    return out.select("id", "source", "size", "source_size", "target", "th", "expected", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
