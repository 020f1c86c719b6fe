"""Vector code compression: product codes whose codebooks are fitted by active-entry Lloyd rounds in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from figweave.llm.shared import drop_table, join_counted, write_table

#: Components are floor(SCALE * x).
SCALE = 4096
#: Integer components of at least this size are out of range: squared distances of longer vectors could pass 64 bits.
RANGE = 1 << 26
#: Distances computed at a time in a task: rows are taken in blocks so that rows * entries * part length stays under this.
BLOCK = 1 << 21
STATE = "part_codes binary, part_errors array<long>"


@dataclass(frozen=True)
class Codebooks:
    """values[part, entry, position]; `dim` components a vector."""

    values: np.ndarray

    @property
    def dim(self) -> int:
        return self.values.shape[0] * self.values.shape[2]

    def digest(self) -> str:
        """Hex SHA-256 of all integers by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.values.reshape(-1).tolist())).encode()).hexdigest()


def nearest(parts: np.ndarray, entries: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least squared distance of each row of `parts` to the entries numbered `among` (ascending), and that entry's number; ties to the lower number."""
    best, code = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    step = max(1, BLOCK // max(1, len(among) * parts.shape[1]))
    for at in range(0, len(parts), step):
        gap = parts[at : at + step, None, :] - entries[None, among, :]
        far = np.einsum("nkd,nkd->nk", gap, gap)
        k = far.argmin(axis=1)
        best[at : at + step], code[at : at + step] = far[np.arange(len(k)), k], among[k]
    return best, code


def reassign(vectors: np.ndarray, codes: np.ndarray, errors: np.ndarray, books: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and exact squared distances under `books`, from those under the codebooks before.

    moved[part, entry] says which entries differ from before. A part whose entry stayed fixed keeps its stored distance, which is still exact and still least among the fixed
    entries, so only moved entries are compared with it. A part whose entry moved (all, in the first round) is compared with every entry.
    """
    codes, errors = codes.copy(), errors.copy()
    cut = np.split(vectors, len(books), axis=1)
    for p, entries in enumerate(books):
        active = np.flatnonzero(moved[p])
        rescan = moved[p][codes[:, p]]
        if rescan.any():
            errors[rescan, p], codes[rescan, p] = nearest(cut[p][rescan], entries, np.arange(len(entries)))
        if len(active) and not rescan.all():
            rest = np.flatnonzero(~rescan)
            far, k = nearest(cut[p][rest], entries, active)
            old, own = errors[rest, p], codes[rest, p]
            better = (far < old) | (far == old) & (k < own)
            errors[rest[better], p], codes[rest[better], p] = far[better], k[better]
    return codes, errors


def _matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: type) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(-1, width)


def _assign(rows: DataFrame, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """rows with part_codes and part_errors under `books`; without these columns, every part is scanned."""
    fresh = "part_codes" not in rows.columns
    n, dim = len(books), books.shape[0] * books.shape[2]
    kept = [c for c in rows.columns if c not in ("part_codes", "part_errors")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = _matrix(b.column("ints"), dim, np.int64)
            if fresh:
                codes, errors, changed = np.zeros((len(vectors), n), np.int64), np.zeros((len(vectors), n), np.int64), np.ones_like(moved)
            else:
                codes = np.frombuffer(b"".join(b.column("part_codes").to_pylist()), np.uint8).reshape(-1, n).astype(np.int64)
                errors, changed = _matrix(b.column("part_errors"), n, np.int64), moved
            codes, errors = reassign(vectors, codes, errors, books, changed)
            packed = pa.array([x.tobytes() for x in codes.astype(np.uint8)], pa.binary())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(errors) + 1, dtype=np.int32) * n), pa.array(errors.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), packed, lists], names=[*kept, "part_codes", "part_errors"])

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*kept).dtypes)
    return rows.mapInArrow(run, f"{schema}, {STATE}")


def _sums(rows: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Component sums and counts by part and entry: one row per part, entry and position reaches the driver, whatever the data."""
    parts, entries, width = shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(shape, np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            vectors = _matrix(b.column("ints"), parts * width, np.int64).reshape(-1, parts, width)
            codes = np.frombuffer(b"".join(b.column("part_codes").to_pylist()), np.uint8).reshape(-1, parts)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], vectors[:, p])
                count[p] += np.bincount(codes[:, p], minlength=entries)
        cell = np.flatnonzero(np.repeat(count.reshape(-1) > 0, width))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.reshape(-1)[cell]), pa.array(np.repeat(count.reshape(-1), width)[cell])], names=["cell", "total", "n"])

    found = rows.select("ints", "part_codes").mapInArrow(partial, "cell long, total long, n long").groupBy("cell").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    total, count = np.zeros(parts * entries * width, np.int64), np.zeros(parts * entries * width, np.int64)
    for r in found:
        total[r.cell], count[r.cell] = r.total, r.n
    return total.reshape(shape), count.reshape(shape)[:, :, 0]


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, Codebooks]:
    """Rows (vec_id, label, code, error, part_errors) for all vectors but unusable ones, and the fitted codebooks.

    A vector that is null or holds a null or non-finite component is unusable and left out. Components become floor(4096 * x). Codebooks start from the `entries` smallest ids
    (ties: by the vector; null ids last); each round assigns every part to the nearest entry, ties to the lower number, and moves each used entry to the floored mean of its parts; at the end parts are assigned again.
    Codes, distances and vectors are a written table each round, which cuts lineage; the round before it is deleted. Only codebooks and their sums, of fixed size, pass the driver.

    The length is the most frequent one that `parts` divides (ties: the shorter). Rows of another length, or with integer components of 2**26 or more, cannot be coded: they stay,
    with null code and error. Repeated ids are rows of their own. Fewer rows than `entries` give smaller codebooks; no rows give no rows. `entries` is at most 256. Other columns are ignored.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be 1 to 256: a part's code is one byte")
    x = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), x.alias("x"))
    rows = rows.filter(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    # a component whose floor passes 64 bits saturates in the cast and is out of range in any case
    rows = rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(v.cast("double") * F.lit(float(SCALE)))).cast("array<long>").alias("ints"))
    rows = rows.withColumn("small", F.forall("ints", lambda v: (v < RANGE) & (v > -RANGE)) & (F.size("ints") > 0) & (F.size("ints") % parts == 0))
    rows = write_table(rows, "vectors")
    common = rows.filter("small").groupBy(F.size("ints").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        odd = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("array<long>").alias("part_errors"))
        return odd, Codebooks(np.zeros((parts, 0, 0), np.int64))
    fits = F.col("small") & (F.size("ints") == common.n)
    whole = rows.filter(fits).select("vec_id", "label", "ints")
    seeds = whole.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select("ints").collect()
    books = np.array([r.ints for r in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    moved = np.ones(books.shape[:2], bool)
    state = whole
    for k in range(rounds + 1):
        done = write_table(_assign(state, books, moved), f"codes-{k}")
        if k:
            drop_table(state)
        state = done
        if k < rounds:
            total, count = _sums(state, books.shape)
            new = np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], books)
            books, moved = new, (new != books).any(axis=2)
    error = F.aggregate("part_errors", F.lit(0).cast("long"), lambda a, v: a + v)
    code = F.lower(F.hex("part_codes"))
    coded = state.select("vec_id", "label", code.alias("code"), error.alias("error"), "part_errors")
    odd = rows.filter(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("array<long>").alias("part_errors"))
    return coded.unionByName(odd), Codebooks(books)


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with `label_error`, the sum of `error` over rows of an equal label; null labels count as equal. A label may hold any share of the rows: it is pre-aggregated, and frequent labels are joined without a shuffle."""
    keyed = coded.withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    keyed = keyed.withColumn("_null", F.col("label").isNull())
    sums = write_table(keyed.groupBy("_label", "_null").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")), "label-errors")
    total = sums.agg(F.sum("_n")).first()[0] or 0
    return join_counted(keyed, sums, ["_label", "_null"], "_n", total).drop("_label", "_null", "_n")


def decode(coded: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """coded with `approx` (array<double>), the vector that the code stands for; a null code gives null. The codebooks travel as a literal of fixed size."""
    values = books.values
    table = F.array(*(F.array(*(F.array(*(F.lit(float(v) / SCALE) for v in e)) for e in p)) for p in values))
    part = lambda i: F.conv(F.substring(code_col, 2 * i + 1, 2), 16, 10).cast("int")
    return coded.withColumn("approx", F.when(F.col(code_col).isNotNull(), F.concat(*(table[i][part(i)] for i in range(len(values))))))
