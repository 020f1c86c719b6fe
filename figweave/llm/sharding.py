"""Sharding along a Hilbert curve over metadata dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figweave.llm.shared import ranked, write_table


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _point(values: list[Column]) -> Column:
    return F.struct(*[v.cast("int").alias(f"x{i}") for i, v in enumerate(values)])


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of the cell with these coordinates, each 0 to 2**bits - 1, as long.

    Transposed-axes form: undo the excess rotations from the highest bit down, Gray encode, interleave the bits.
    """
    n = len(cells)

    def axes(p):
        return [p.getField(f"x{i}") for i in range(n)]

    def turn_axis(i):
        """One axis at a time keeps the expression small: later axes read what earlier ones made of x0."""
        def step(p, q):
            xs, low = axes(p), q - 1
            on = xs[i].bitwiseAND(q) != 0
            t = xs[0].bitwiseXOR(xs[i]).bitwiseAND(low)
            new0 = F.when(on, xs[0].bitwiseXOR(low)).otherwise(xs[0].bitwiseXOR(t))
            if not i:
                return _point([F.when(on, xs[0].bitwiseXOR(low)).otherwise(xs[0]), *xs[1:]])
            newi = F.when(on, xs[i]).otherwise(xs[i].bitwiseXOR(t))
            return _point([new0, *xs[1:i], newi, *xs[i + 1:]])
        return step

    def bound(step, q):
        return lambda p: step(p, q)

    def all_axes(p, q):
        for i in range(n):
            p = _let(p, bound(turn_axis(i), q))
        return p

    def finish(p):
        xs = axes(p)
        gray = [reduce(lambda a, b: a.bitwiseXOR(b), xs[: i + 1]) for i in range(n)]

        def spread(g):
            ys = axes(g)
            t = reduce(lambda a, b: a.bitwiseXOR(b), [F.when(ys[-1].bitwiseAND(F.lit(1 << j)) != 0, F.lit((1 << j) - 1)).otherwise(F.lit(0)) for j in range(bits - 1, 0, -1)])
            return _let(_point([y.bitwiseXOR(t) for y in ys]), interleave)

        def interleave(z):
            return sum((F.when(x.bitwiseAND(F.lit(1 << j)) != 0, F.lit(1 << (j * n + n - 1 - i))).otherwise(F.lit(0)).cast("long") for i, x in enumerate(axes(z)) for j in range(bits)), F.lit(0).cast("long"))

        return _let(_point(gray), spread)

    steps = F.array(*[F.lit(1 << j) for j in range(bits - 1, 0, -1)])
    return F.aggregate(steps, _point(cells), all_axes, finish)


def log_cell(value: Column, bits: int) -> Column:
    """floor(log2(value + 1)), at most 2**bits - 1: a cell that keeps the order of sizes."""
    return F.least(F.floor(F.log2(F.coalesce(value, F.lit(0)).cast("double") + 1)), F.lit((1 << bits) - 1)).cast("int")


def name_cell(value: Column, bits: int) -> Column:
    """A hashed cell of a category; null has a cell of its own value's hash too."""
    return F.pmod(F.xxhash64(F.coalesce(value.cast("string"), F.lit("\x00"))), F.lit(1 << bits)).cast("int")


def hilbert_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, ...] = ("source", "lang"),
                   shards: int = 40, bits: int = 5) -> DataFrame:
    """One row per row of docs: `id`, `size`, `text_crc32`, `curve`, `shard`, `slot`.

    The size in bytes (log scale) and each column of `names` (hashed cells) are quantised to 2**bits cells; rows
    in order of (Hilbert index, checksum, id) are cut into `shards` runs whose row counts differ by one at most (law `rows`).
    Runs are short stretches of the curve, so a filter on source, language or size meets few shards, and equal texts of
    one source lie side by side. A hot source is a long stretch over many shards. Only metadata is shuffled.

    Null text: none, so 16 bytes and checksum 0. Null names and ids are ordinary values. Repeated rows each get
    a slot. Columns of `names` that are missing raise; others are ignored. No rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 16
    meta = docs.select(
        F.col(id_col).alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        hilbert_index([*[name_cell(F.col(c), bits) for c in names], log_cell(size, bits)], bits).alias("curve"),
    )
    rows = ranked(write_table(meta, "shard-meta"), ["curve", "text_crc32", "id"], "shard-runs")
    total = max(1, rows.count())
    shard = F.expr(f"(_rank * {shards}) div {total}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return rows.withColumn("shard", shard).withColumn("slot", F.col("_rank") - first).select(
        "id", "size", "text_crc32", "curve", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
