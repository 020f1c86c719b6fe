"""Similarity search over bit sets (vec_id, bits), and record sets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Metrics by name: common bits, bits of a, bits of b.
METRICS = {"tanimoto": lambda c, a, b: F.when(a + b - c > 0, c / (a + b - c)).otherwise(0.0)}

#: An index is used while its candidates are under this share of all pairs and a query asks for at most so many values; a pair made by a join costs some 300 times one compared inside a block.
SELECTIVE, PROBES = 0.01, 4096
#: Sets in a block that is compared whole.
BLOCK = 16384


def compare(pairs: DataFrame, metric: str = "tanimoto") -> DataFrame:
    """pairs(.., a, b) of bit arrays with `common`, `n_a`, `n_b` and `similarity`."""
    if metric not in METRICS:
        raise ValueError(metric)
    rows = pairs.withColumn("common", F.size(F.array_intersect("a", "b"))).withColumn("n_a", F.size("a")).withColumn("n_b", F.size("b"))
    return rows.withColumn("similarity", METRICS[metric](F.col("common"), F.col("n_a"), F.col("n_b")))


def packed_bits(sets: DataFrame, n_words: int) -> DataFrame:
    """(vec_id, n, words): the number of bits and the bits as longs."""
    word = lambda w: F.aggregate(F.filter("bits", lambda b: F.floor(b / 64) == w), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))))
    return sets.select("vec_id", F.size("bits").alias("n"), F.array(*map(word, range(n_words))).alias("words"))


def radii(bits: int, segments: int) -> list[int]:
    """How far each segment may differ at least in one place if two sets differ in at most `bits`: the sum of (radius + 1) is bits + 1, so not all segments can differ by more."""
    even, more = divmod(bits + 1 - segments, segments)
    return [even + (k < more) for k in range(segments)]


def ball(width: int, radius: int) -> int:
    """Values of `width` bits within `radius` bits of one."""
    return sum(comb(width, k) for k in range(radius + 1)) if radius >= 0 else 0


def best_segments(width: int, bits: int) -> tuple[int, float, int]:
    """(segments, share, probes): the cut into segments of at most 16 bits with the least share of random dense sets that are candidates, and the values that a query asks for."""
    found = []
    for segments in range(-(-width // 16), width // 4 + 1):
        sizes = [(width * (k + 1)) // segments - width * k // segments for k in range(segments)]
        asked = [ball(w, r) for w, r in zip(sizes, radii(bits, segments))]
        found.append((sum(b / 2**w for b, w in zip(asked, sizes)), segments, sum(asked)))
    share, segments, probes = min(found)
    return segments, share, probes


def _segment(words: Column, at: int, size: int) -> Column:
    """Bits at .. at + size of the longs, as an int."""
    low = F.shiftrightunsigned(F.get(words, F.lit(at // 64)), at % 64)
    both = low.bitwiseOR(F.shiftleft(F.get(words, F.lit(at // 64 + 1)), 64 - at % 64)) if at % 64 + size > 64 else low
    return both.bitwiseAND(F.lit((1 << size) - 1)).cast("int")


def _tanimoto(c: Column, m: Column, n: Column) -> Column:
    return METRICS["tanimoto"](c, m, n)


def _hits(pairs: DataFrame, least: float, most: float) -> DataFrame:
    """Pairs (query_id, vec_id, m, n, qw, rw) compared by the bits that their longs share."""
    common = F.aggregate(F.zip_with("qw", "rw", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda a, b: a + b)
    rows = pairs.filter("query_id <> vec_id").withColumn("similarity", _tanimoto(common, F.col("m"), F.col("n")))
    return rows.filter(F.col("similarity").between(least, most)).select("query_id", "vec_id", "similarity")


def pigeonhole_candidates(records: DataFrame, queries: DataFrame, least: float, width: int) -> DataFrame:
    """(query_id, vec_id): packed sets that agree, up to a radius, in one of the segments that their bits are cut into; no pair with Tanimoto >= least is missed.

    Such sets of m and n bits differ in at most (m + n) * (1 - least) / (1 + least). Sizes are known before, so records are classed by size, and a query asks each class within the ratio with the radii of that class alone.
    The key is class, segment and value: an equi-join on about as many values as the segments have.
    """
    sizes = [r.n for r in records.select("n").distinct().collect()]  # at most width + 1
    most_bits = lambda m, n: int((m + n) * (1 - least) / (1 + least) + 1e-9)
    asked = [r.n for r in queries.select("n").distinct().collect()]
    pairs = [(m, n) for m in asked for n in sizes if n >= m * least - 1e-9 and m >= n * least - 1e-9]
    segments = best_segments(width, max((most_bits(m, n) for m, n in pairs), default=0))[0]
    bounds = [width * k // segments for k in range(segments + 1)]
    keys = F.array(*(F.struct(F.lit(k).alias("k"), _segment(F.col("words"), a, b - a).alias("value")) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))))
    own = records.select("vec_id", F.col("n").alias("cls"), F.explode(keys).alias("s")).select("vec_id", "cls", "s.k", "s.value")
    spark = records.sparkSession
    plan = [(m, n, k, r) for m, n in pairs for k, r in enumerate(radii(most_bits(m, n), segments)) if r >= 0]
    asks = spark.createDataFrame(plan, "m int, cls int, k int, r int")
    flips = spark.createDataFrame([(b - a, sum(1 << i for i in c), len(c)) for a, b in {(0, y - x): 1 for x, y in zip(bounds, bounds[1:])} for top in [max((r for *_, r in plan), default=0)] for k in range(min(top, b - a) + 1) for c in combinations(range(b - a), k)], "size int, flip int, off int")
    size = F.element_at(F.array(*(F.lit(b - a) for a, b in zip(bounds, bounds[1:]))), F.col("k") + 1)
    want = queries.select(F.col("vec_id").alias("query_id"), F.col("n").alias("m"), F.explode(keys).alias("s")).select("query_id", "m", "s.k", "s.value")
    want = want.join(F.broadcast(asks), ["m", "k"]).withColumn("size", size).join(F.broadcast(flips), "size").filter("off <= r").select("query_id", "cls", "k", F.col("value").bitwiseXOR(F.col("flip")).alias("value"))
    return want.join(own, ["cls", "k", "value"]).select("query_id", "vec_id").distinct()


def _prefixes(sets: DataFrame, freq: DataFrame, least: float) -> DataFrame:
    """(vec_id, n, bit) for the rarest n - ceil(least * n) + 1 bits of each set: two sets that are similar enough share one of them."""
    rows = sets.select("vec_id", F.size("bits").alias("n"), F.explode("bits").alias("bit")).join(F.broadcast(freq), "bit")
    place = F.row_number().over(W.partitionBy("vec_id").orderBy("f", "bit"))
    return rows.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("vec_id", "n", "bit")


def blocked(records: DataFrame, queries: DataFrame, least: float, most: float, best: int | None = None) -> DataFrame:
    """(query_id, vec_id, similarity) of packed sets by comparing blocks of records, BLOCK sets each, with all queries: counts of common bits by numpy, and only hits leave. best: of each query and block only the hits that
    can be among its first so many, ties to the lowest id.

    For sets so dense and thresholds so low that every exact index meets most pairs anyway. Records are dealt to blocks by hash; queries are copied to each block as plain rows, behind its records, so a task holds one block and one batch of queries.
    """
    n_r = max(1, -(-records.count() // BLOCK))
    cast = lambda x: x.select(F.col("block").cast("long"), F.col("asks"), F.col("vec_id").cast("long"), F.col("n").cast("int"), "words")
    own = cast(records.select(F.pmod(F.xxhash64("vec_id"), F.lit(n_r)).alias("block"), F.lit(False).alias("asks"), "vec_id", "n", "words"))
    asked = cast(queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))).alias("block"), F.lit(True).alias("asks"), "vec_id", "n", "words"))
    parts = max(1, min(n_r, 4 * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = own.unionByName(asked).repartitionByRange(parts, "block").sortWithinPartitions("block", "asks")

    def compare_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            for block, rows in batch.groupby("block", sort=True):
                if block != at:
                    at, held = block, []
                mine, asks = rows[~rows["asks"]], rows[rows["asks"]]
                if len(mine):
                    held.append(_arrays(mine))
                if not len(asks) or not held:
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(x) for x in zip(*held))]
                yield from _compared(_arrays(asks), held[0], least, most, best)

    return rows.mapInPandas(compare_blocks, "query_id long, vec_id long, similarity double")


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, numbers of bits and words of sets, in the order of their ids."""
    rows = rows.sort_values("vec_id")
    return rows["vec_id"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), np.stack([np.asarray(w, np.int64) for w in rows["words"]]).view(np.uint64)


def _compared(asks: tuple, own: tuple, least: float, most: float, best: int | None) -> Iterator[pd.DataFrame]:
    """Hits of some queries in a block, some hundred thousand pairs at a time."""
    (qi, qn, qw), (ri, rn, rw) = asks, own
    step = max(1, 500_000 // len(ri))
    for at in range(0, len(qi), step):
        cut = slice(at, at + step)
        c = sum(np.bitwise_count(qw[cut, None, w] & rw[None, :, w]).astype(np.int64) for w in range(qw.shape[1]))
        union = qn[cut, None] + rn[None, :] - c
        sim = np.divide(c, union, out=np.zeros(c.shape), where=union > 0)
        fits = (sim >= least) & (sim <= most) & (qi[cut, None] != ri[None, :])
        if best is not None and best < len(ri):
            kept = np.where(fits, sim, -1.0)
            floor = np.partition(kept, len(ri) - best, axis=1)[:, len(ri) - best, None]  # the best-th similarity of each query
            fits &= kept >= floor
        i, j = np.nonzero(fits)
        found = pd.DataFrame({"query_id": qi[cut][i], "vec_id": ri[j], "similarity": sim[i, j]})
        if best is not None:
            found = found.sort_values(["query_id", "similarity", "vec_id"], ascending=[True, False, True]).groupby(["query_id"]).head(best)
        yield found


def method_for(records: DataFrame, queries: DataFrame, least: float, width: int) -> str:
    """`prefix`, `segments` or `blocks`: the way whose candidates are the least share of all pairs, `blocks` if none is under SELECTIVE. Counts of bits in prefixes and of sizes decide, a few numbers of the fingerprint's width; all ways give the same rows."""
    freq = records.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count("*").alias("f"))
    often = lambda sets: _prefixes(sets, freq, least).groupBy("bit").agg(F.count("*").alias("n"))
    met = often(records).join(often(queries).withColumnRenamed("n", "m"), "bit").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
    n_r, mean = records.agg(F.count("*"), F.avg(F.size("bits"))).first()
    prefix = met / max(1, n_r * queries.count())
    share, probes = best_segments(width, int(2 * (mean or 0) * (1 - least) / (1 + least)))[1:] if width <= 1024 and (mean or 0) >= width / 8 else (1.0, 0)
    way, name = min((prefix, "prefix"), (share, "segments"))
    return name if way < SELECTIVE and (name == "prefix" or probes <= PROBES) else "blocks"


def search(records: DataFrame, queries: DataFrame, least: float, most: float = 1.0, max_bits: int = 4096, method: str | None = None, best: int | None = None) -> DataFrame:
    """(query_id, vec_id, similarity) with least <= Tanimoto <= most, a record with itself left out.

    Three exact ways, see method_for: `prefix` joins on a rare bit (sparse sets), `segments` on equal or near segments of the packed bits (dense sets, high thresholds), `blocks` compares packed blocks (dense sets, low thresholds, where an index
    meets most pairs). Bits are 0 .. max_bits - 1; a fingerprint has a fixed width, checked against max_bits. With `least` 0, sets without a common bit count too, by `blocks`. best: only so many of a query are wanted, see top_n; others of it may be missing.
    """
    last = records.select(F.array_max("bits").alias("b")).unionByName(queries.select(F.array_max("bits").alias("b"))).agg(F.max("b"), F.min("b")).first()
    width = (last[0] if last[0] is not None else 0) + 1
    if width > max_bits:
        raise ValueError(f"more than {max_bits} different bits")
    method = "blocks" if least <= 0 else method or method_for(records, queries, least, width)
    n_words = -(-width // 64)
    own, asked = packed_bits(records, n_words), packed_bits(queries, n_words)
    if method == "blocks":
        return blocked(own, asked, least, most, best)
    if method == "segments":
        pairs = pigeonhole_candidates(own, asked, least, width)
    else:
        freq = records.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count("*").alias("f"))
        left = _prefixes(queries, freq, least).select(F.col("vec_id").alias("query_id"), F.col("n").alias("m"), "bit")
        ratio = (F.col("n") >= F.col("m") * least - 1e-9) & (F.col("m") >= F.col("n") * least - 1e-9)
        pairs = left.join(_prefixes(records, freq, least), "bit").filter(ratio).select("query_id", "vec_id").distinct()
    full = pairs.join(asked.select(F.col("vec_id").alias("query_id"), F.col("n").alias("m"), F.col("words").alias("qw")), "query_id").join(own.select("vec_id", "n", F.col("words").alias("rw")), "vec_id")
    return _hits(full, least, most)


def top_n(found: DataFrame, n: int) -> DataFrame:
    """The n most similar records of each query, ties to the lowest id, with `place`."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("place", place).filter(F.col("place") <= n)


def upsert(records: DataFrame, changes: DataFrame, key: str, version: str, deleted: Column) -> DataFrame:
    """records with changes applied: per key the highest version wins; rows marked deleted go."""
    columns = records.columns
    rows = records.withColumn("_gone", F.lit(False)).unionByName(changes.withColumn("_gone", deleted).select(*columns, "_gone"))
    last = rows.groupBy(key).agg(F.max_by(F.struct(*columns, "_gone"), version).alias("r"))
    return last.filter("not r._gone").select(*[F.col(f"r.{c}").alias(c) for c in columns])
