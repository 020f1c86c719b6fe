"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figweave.llm.shared import BLANKS, ascii_lower, join_counted, write_table

KEYS = ["h1", "h2"]
NO_ID = -(1 << 63)


class LineRuns:
    """Levelled sorted runs of (h1, h2, n, holder), one row per line key and run, kept as shared tables.

    `add` merge-anti-joins a batch with the runs: a key that no run has enters with its holder, a known key only adds its count.
    So each key has one row with a holder. When a level has `fanout` runs they are compacted into one run of the next.
    """

    def __init__(self, fanout: int = 2):
        self.fanout, self.levels = fanout, [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        batch = batch.select(*KEYS, "n", "holder")
        if self.runs():
            known = self._all().filter("holder is not null").select(*KEYS, F.lit(True).alias("known"))
            fresh = F.when(F.col("known").isNull(), F.col("holder"))
            batch = batch.join(known, KEYS, "left").select(*KEYS, "n", fresh.alias("holder"))
        self._put(0, batch)

    def _all(self) -> DataFrame:
        first, *more = self.runs()
        for run in more:
            first = first.unionByName(run)
        return first

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(write_table(run.sortWithinPartitions(*KEYS), f"line-run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            first, *more = self.levels[level]
            for other in more:
                first = first.unionByName(other)
            self.levels[level] = []
            self._put(level + 1, self._merge(first))

    @staticmethod
    def _merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.max("holder").alias("holder"))

    def merged(self) -> DataFrame:
        """One row per key over all runs."""
        return self.runs()[0] if len(self.runs()) == 1 else self._merge(self._all())


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
               min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """One row per row of docs: `doc` (struct of all its columns, text cleaned), `n_lines`, `n_dropped`.

    Lines are split at newline. A key (see line_key) of at least min_chars code points in at least min_docs documents loses its
    lines in every document but the one with the largest id. Batches come in descending id, cut at approximate
    quantiles, so the first batch that brings a key has its holder. Keys are 128-bit hashes. Texts move in one shuffle.

    Null or empty text: one empty line, result text empty. Null ids count as one document below all others. Rows that repeat
    an id are one document. Other columns pass through, whatever their names. No rows give no rows.
    """
    did = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    # all columns but the text, which moves once, as its lines
    rest = F.struct(*[F.lit(None).cast("string").alias(c) if c == text_col else F.col(c) for c in docs.columns])
    base = docs.select(rest.alias("doc"), did.alias("did"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base.withColumn("th", F.xxhash64("t"))
    cuts = base.agg(F.percentile_approx("did", [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"] or []
    batch = sum((F.when(F.col("did") <= F.lit(q), 1).otherwise(0) for q in cuts), F.lit(0))
    keyed = F.transform(F.transform(F.split("t", "\n", -1), line_key),
                        lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"), (F.length(k) >= min_chars).alias("long")))
    lines = write_table(
        base.select("did", "th", F.posexplode(keyed).alias("pos", "k")).filter("k.long")
        .select("did", "th", "pos", "k.h1", "k.h2", batch.alias("batch")), "lines", "batch",
    )
    runs = LineRuns(fanout)
    for b in range(len(cuts) + 1):
        mine = lines.filter(F.col("batch") == b)
        runs.add(mine.groupBy(*KEYS).agg(F.countDistinct("did").alias("n"), F.max("did").alias("holder")))
    shared = write_table(
        runs.merged().filter(F.col("n") >= min_docs)
        .join(lines.groupBy(*KEYS).agg(F.count("*").alias("n_rows")), KEYS), "shared-lines",
    )
    drops = (
        join_counted(lines.select("did", "th", "pos", *KEYS), shared, KEYS, "n_rows", lines.count())
        .filter("did <> holder").groupBy("did", "th").agg(F.collect_set(F.col("pos") + 1).alias("gone"))
    )
    # split below the join, so that the lambda above it reads a made array
    split = base.select("doc", "did", "th", F.split("t", "\n", -1).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(1), F.size("lines")), "gone")
    text = F.array_join(F.transform("kept", lambda i: F.element_at("lines", i)), "\n")
    out = split.join(drops, ["did", "th"], "left").withColumn(
        "kept", F.when(F.col("gone").isNotNull(), kept).otherwise(F.sequence(F.lit(1), F.size("lines"))))
    whole = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(text)
    columns = [whole.alias(c) if c == text_col else F.col("doc").getField(c).alias(c) for c in docs.columns]
    return out.select(F.struct(*columns).alias("doc"), F.size("lines").cast("long").alias("n_lines"),
                      (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))
