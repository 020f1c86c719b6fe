"""MinHash near-dedup with sequential Bayesian verification of banded candidates."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figweave.llm.shared import join_counted, write_table

WORDS = 5
#: 32 bands of 4 hashes: a pair with similarity 0.75 shares none with probability (1 - 0.75**4)**32, about 5e-6.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: Signature hashes compared at a time, and the chance at which a pair that is similar enough may be pruned.
BATCH, MISS = 32, 1e-7
#: A bucket with several components and at most so many members makes its pairs at once; larger ones by way of the prefix filter.
SMALL = 64
#: Cells of the table of shingle counts that orders the prefix filter: 4 MB.
CELLS = 1 << 20
#: Up to so many rows of three numbers are broadcast to pick texts; beyond that the join shuffles.
BROADCAST_IDS = 1_000_000
#: Most holders of a shingle that meet in one group of the prefix filter's join.
PART = 1000

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_PLACE = _rng.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(256, dtype=np.uint64) + np.uint64(1)
_FOLD[65:91] += np.uint64(32)  # A-Z as a-z
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: two multiply and shift rounds."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the 5-word shingles of a whole text; of all words where there are fewer; none without words."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    letters = _FOLD[raw[inside]]
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    powers = np.cumprod(np.full(int(sizes.max()), _BASE))
    sums = np.add.reduceat(letters * powers[np.arange(len(letters)) - np.repeat(first, sizes)], first)
    word = _mix(sums + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    n = len(word)
    if n < WORDS:
        return _mix(np.array([np.sum(word * _PLACE[:n], dtype=np.uint64) + np.uint64(n)], dtype=np.uint64))
    run = word[: n - WORDS + 1] * _PLACE[0]
    for k in range(1, WORDS):
        run += word[k : n - WORDS + 1 + k] * _PLACE[k]
    return np.unique(_mix(run))


def _cell(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(44)).astype(np.int64)


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values of a set of 64-bit hashes: the least of each of HASHES permutations of its upper halves."""
    least, x = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (_A[:, None] * x[None, at : at + 2048] + _B[:, None]).min(axis=1), out=least)
    return least


def signature_bytes(least: np.ndarray) -> np.ndarray:
    """One byte of each minimum, uniform whatever the set's size: the minimum of a large set is small, so its own upper bytes are mostly 0."""
    return _mix(least.astype(np.uint64)).astype(np.uint8)


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """For each number of compared hashes, the fewest matches that keep a pair: below it, the posterior chance that the similarity is at least `threshold` is under `miss`.

    With a uniform prior the posterior after m of n matches is Beta(m + 1, n - m + 1), whose tail is a binomial sum. Compared hashes are
    single bytes, which also agree by chance.
    """
    t, out = threshold + (1 - threshold) / 256, {}
    for n in range(BATCH, HASHES + 1, BATCH):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                out[n] = m
                break
    return out


def _sketch(rows: DataFrame) -> DataFrame:
    """Per (row, id, th, text): set size, 128-bit hash of the set, one-byte signature and band keys."""
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row, i, th, text in zip(batch["row"], batch["id"], batch["th"], batch["text"]):
                found = shingles(text)
                least = signature(found)
                sums = [int(np.sum(_mix(found ^ np.uint64(s)), dtype=np.uint64).astype(np.int64)) for s in (0x5BD1E995, 0xC2B2AE3D27D4EB4F)]
                bands = _mix(np.sum(least.reshape(BANDS, ROWS).astype(np.uint64) * _BAND, axis=1, dtype=np.uint64)).astype(np.int64)
                out.append((row, i, th, len(found), *sums, signature_bytes(least).tobytes(), bands if len(found) else bands[:0]))
            yield pd.DataFrame(out, columns=["row", "id", "th", "n", "s1", "s2", "sig", "bands"])

    return rows.select("row", "id", "th", "text").mapInPandas(sketch, "row long, id long, th long, n long, s1 long, s2 long, sig binary, bands array<long>")


def _bayes(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) with `m` matching hashes that no batch of the signature comparison prunes."""
    least = least_matches(threshold)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch[c]), dtype=np.uint8).reshape(-1, HASHES) for c in ("sa", "sb"))
                left, m = np.arange(len(batch)), np.zeros(len(batch), dtype=np.int64)
                for n in range(BATCH, HASHES + 1, BATCH):
                    m[left] += (x[left, n - BATCH : n] == y[left, n - BATCH : n]).sum(axis=1)
                    left = left[m[left] >= least[n]]
                yield pd.DataFrame({"a": batch["a"].to_numpy()[left], "b": batch["b"].to_numpy()[left], "m": m[left]})

    one = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
    both = one.join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInPandas(compare, "a long, b long, m long")


def _longs(sig: Column) -> Column:
    """A signature as longs of eight bytes."""
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES // 8 - 1)), lambda i: F.conv(F.hex(F.substring(sig, i * 8 + 1, F.lit(8))), 16, -10).cast("long"))


def _survives(x: Column, y: Column, threshold: float) -> Column:
    """Whether no batch of the comparison prunes two signatures in _longs() form: what _bayes does, as a join's condition, so that pruned pairs are never made.

    Array functions keep the condition short: written out long by long it has thousands of terms, which the driver holds many times over in plans and their texts.
    """
    def differing(z):  # the lowest bit of each byte becomes whether the byte has any
        for by in (4, 2, 1):
            z = z.bitwiseOR(F.shiftrightunsigned(z, by))
        return F.bit_count(z.bitwiseAND(F.lit(0x0101010101010101)))

    def kept(counts):
        out, least = F.lit(True), least_matches(threshold)
        for n in least:
            out = out & (F.aggregate(F.slice(counts, 1, n // 8), F.lit(0), lambda s, c: s + c) <= n - least[n])
        return out

    counts = F.transform(F.zip_with(x, y, lambda a, b: a.bitwiseXOR(b)), differing)
    return F.element_at(F.transform(F.array(counts), kept), 1)


def _exact(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mine = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch["a"], batch["ta"], batch["tb"]):
                if a != last:
                    last, mine = a, shingles(ta)
                other = shingles(tb)
                both = len(np.intersect1d(mine, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(mine) + len(other) - both))
            yield batch.loc[keep, ["a", "b"]]

    one = pairs.select("a", "b").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    both = one.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInPandas(verify, "a long, b long")


def scrambled(x: Column) -> Column:
    """A one-to-one map of the longs that leaves no order behind: shifts and exclusive ors."""
    for shift, by in ((F.shiftleft, 13), (F.shiftrightunsigned, 7), (F.shiftleft, 17)):
        x = x.bitwiseXOR(shift(x, by))
    return x


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of edges(a, b): nodes have one label if edges connect them.

    Contraction: every node takes the least of itself and its neighbours as its name, edges then run between names, and those within a name go. Node numbers must be in no order
    (see scrambled()), so each round at least halves what is left, on average, and most edges take part in one round only. Each round is a written
    table, so an executor loss costs one round. Edges meet names in counted joins, so the center of a large star is no hot key.
    """
    live = write_table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "cc-edges")
    labels = None
    while n_edges := live.count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        names = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("name"), F.count("*").alias("degree"))
        names = write_table(names, "cc-names")
        if labels is None:
            labels = names.select("node", F.col("name").alias("label"))
        else:
            onto = names.select(F.col("node").alias("label"), "name")
            labels = write_table(labels.join(onto, "label", "left").select("node", F.coalesce("name", "label").alias("label")), "cc-labels")
        for end in ("a", "b"):
            live = join_counted(live, names.select(F.col("node").alias(end), F.col("name").alias(f"n{end}"), "degree"), [end], "degree", 2 * n_edges).drop("degree")
        live = write_table(live.filter("na <> nb").select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b")).distinct(), "cc-edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0) if labels is None else labels


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per row of docs: `id`, `n_shingles`, `component_id`, `kept`.

    Documents whose sets of 5-word shingles have 100 * intersection >= percent * union are linked; a component is named by its smallest id,
    which stays. Steps:

    1. Sketch every whole text; rows with equal sets collapse to a class, so copies cost nothing below. A class is named by the place of one of
       its rows, not by a document's id, so an id with several texts has several classes.
    2. Band the signatures. Each bucket has one center, the member whose buckets are the largest together, so copies meet at the text that they come from. A class
       gets two candidates of its buckets' centers (never all pairs): the one with most bands in common and the most central one.
    3. Compare their signatures batch by batch and prune by the posterior bound, verify the rest on full sets, and unite, along with the
       classes of one id. Edges inside a component need no check.
    4. Candidates that still cross components: in each bucket that holds several components every member outside its largest one against the rest, by the same
       comparison and verification. Among buckets of more than SMALL members the pairs come from an exact prefix filter instead. So no candidate pair of a bucket is left
       undecided, and pairs are only made where they could matter.

    Misses are those of banding (about 5e-6 at similarity 0.75) and of the Bayesian bound (MISS). Null or empty texts, or texts
    without words, are linked with nothing. A null id cannot name a component: the row comes back with a null component and kept. Rows that repeat
    an id are one document: what any of them with words is linked to, all of those are. Other columns are ignored. No rows give no rows.
    """
    threshold = percent / 100
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("th"))
    sketches = write_table(_sketch(rows.withColumn("row", scrambled(F.monotonically_increasing_id()))), "nd-sketch")
    facts = sketches.select("id", "n", "s1", "s2")
    whole = facts.filter("n > 0 and id is not null")
    total = whole.count()
    sets = write_table(sketches.filter("n > 0 and id is not null").groupBy("s1", "s2").agg(F.min("row").alias("node"), F.min("id").alias("least_id"), F.count("*").alias("members")), "nd-sets")
    # from here on `id` is a class
    reps = write_table(sketches.join(sets.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), F.col("id").alias("doc"), "th", "n", "sig", "bands"), "nd-reps")
    banded = reps.select("id", F.posexplode("bands").alias("band", "key"))
    buckets = write_table(banded.groupBy("band", "key").agg(F.count("*").alias("n_rows")).filter("n_rows > 1"), "nd-buckets")
    n_rows = buckets.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
    members = write_table(join_counted(banded, buckets, ["band", "key"], "n_rows", n_rows), "nd-members")
    central = write_table(members.groupBy("id").agg(F.sum("n_rows").alias("reach")), "nd-reach")
    centers = members.join(central, "id").groupBy("band", "key").agg(F.max(F.struct("reach", F.bitwise_not("id").alias("c"))).alias("m"), F.count("*").alias("n_rows"))
    centers = write_table(centers.select("band", "key", "n_rows", F.col("m.reach").alias("reach"), F.bitwise_not("m.c").alias("center")), "nd-centers")
    starred = join_counted(members.drop("n_rows"), centers, ["band", "key"], "n_rows", n_rows).filter("id <> center")
    starred = starred.groupBy("id", "center").agg(F.count("*").alias("shared"), F.first("reach").alias("reach"))
    # to the center of most shared bands, the likeliest to be alike, and to the one of widest reach, where the copies of a text meet
    best = starred.groupBy("id").agg(F.max_by("center", F.struct("shared", "reach", F.bitwise_not("center"))).alias("p"), F.max_by("center", F.struct("reach", "shared", F.bitwise_not("center"))).alias("q"))
    picked = best.select("id", F.explode(F.array("p", "q")).alias("center"))
    tried = write_table(picked.select(F.least("id", "center").alias("a"), F.greatest("id", "center").alias("b")).distinct(), "nd-first")
    texts = _texts_of(rows, reps.join(central, "id", "left_semi").select("id", "doc", "th"))
    likely = write_table(_bayes(tried, reps, threshold), "nd-likely")
    verified, same = _exact(likely, texts, percent), _one_document(whole, sets, total)
    links = write_table(verified if same is None else verified.unionByName(same), "nd-links")
    labels = components(links)
    known = write_table(reps.select("id").join(labels.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label")), "nd-known")
    mixed = join_counted(members.select("band", "key", "id"), _several(members, known), ["band", "key"], "n_here", n_rows)
    mixed = write_table(mixed.join(known, "id"), "nd-mixed")
    longs = reps.select("id", _longs(F.col("sig")).alias("s"))
    few = mixed.filter(F.col("n_here") <= SMALL).join(longs, "id")
    minor = few.filter("label <> main").select("band", "key", F.col("id").alias("x"), F.col("label").alias("lx"), F.col("s").alias("sx"))
    sides = few.select("band", "key", F.col("id").alias("y"), F.col("label").alias("ly"), F.col("s").alias("sy")).join(minor, ["band", "key"])
    cross = sides.filter((F.col("lx") != F.col("ly")) & _survives(F.col("sx"), F.col("sy"), threshold)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    many = mixed.filter(F.col("n_here") > SMALL)
    if not many.isEmpty():
        cross = cross.unionByName(_prefix_pairs(many, reps, longs, texts, percent, n_rows))
    cross = cross.distinct().join(tried, ["a", "b"], "left_anti")
    late = write_table(_exact(write_table(cross, "nd-cross"), texts, percent), "nd-late")
    # components of components: edges between first labels
    names = known.select(F.col("id").alias("a"), F.col("label").alias("la")), known.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    joined = components(late.join(names[0], "a").join(names[1], "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    named = _named(sets.join(known.withColumnRenamed("id", "node"), "node"), joined)
    found = join_counted(whole, named, ["s1", "s2"], "members", total).select("id", F.col("n").alias("n_shingles"), "component_id")
    alone = facts.filter("n = 0 or id is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def _one_document(whole: DataFrame, sets: DataFrame, total: int) -> DataFrame | None:
    """Edges (a, b) between the classes of an id that has several; None where no id has."""
    first = F.struct("s1", "s2")
    repeated = whole.groupBy("id").agg(F.min(first).alias("x"), F.max(first).alias("y"), F.count("*").alias("c")).filter("x <> y").select("id", "c")
    repeated = write_table(repeated, "nd-repeated")
    if repeated.isEmpty():
        return None
    rows = join_counted(whole, repeated, ["id"], "c", total).select("id", "s1", "s2").distinct()
    rows = write_table(rows.join(sets.select("s1", "s2", "node"), ["s1", "s2"]).select("id", "node"), "nd-one-doc")
    hubs = write_table(rows.groupBy("id").agg(F.min("node").alias("a"), F.count("*").alias("c")), "nd-hubs")
    return join_counted(rows, hubs, ["id"], "c", total).filter("node <> a").select("a", F.col("node").alias("b"))


def _named(sets: DataFrame, joined: DataFrame) -> DataFrame:
    """(s1, s2, members, component_id) of sets(node, s1, s2, least_id, members, label), where joined(node, label) unites labels: the least id under one label."""
    sets = write_table(sets, "nd-labelled")
    labels = sets.groupBy("label").agg(F.min("least_id").alias("least"), F.count("*").alias("n_sets"))
    ends = joined.select(F.col("node").alias("label"), F.col("label").alias("end"))
    labels = write_table(labels.join(ends, "label", "left").withColumn("end", F.coalesce("end", "label")), "nd-labels")
    last = write_table(labels.groupBy("end").agg(F.min("least").alias("component_id"), F.count("*").alias("n_labels")), "nd-ends")
    labels = write_table(join_counted(labels, last, ["end"], "n_labels", labels.count()).select("label", "n_sets", "component_id"), "nd-named")
    return write_table(join_counted(sets, labels, ["label"], "n_sets", sets.count()).select("s1", "s2", "members", "component_id"), "nd-classes")


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of wanted(id, doc, th), the classes that candidates need; a class's text is that of a row with its document's id and text hash. Written once."""
    wanted = write_table(wanted.withColumnsRenamed({"id": "class", "th": "hash"}), "nd-ids")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    found = rows.filter("text is not null").join(wanted, (F.col("id") == F.col("doc")) & (F.col("th") == F.col("hash")))
    return write_table(found.select(F.col("class").alias("id"), "text").dropDuplicates(["id"]), "nd-texts")


def _prefix_pairs(mixed: DataFrame, reps: DataFrame, longs: DataFrame, texts: DataFrame, percent: int, n_rows: int) -> DataFrame:
    """Pairs (a, b) across components among the documents of large mixed buckets (band, key, id, label, main), by an exact prefix filter, that the signature comparison does not prune.

    Two sets that are similar enough share at least percent / (100 + percent) of both sizes together. So, with shingles in order of
    how many documents have them, rarest first, they share one within the first n - that + 1. A heavily changed copy has only shingles of its own there and makes no pair.
    The filter is exact in any one order of all shingles, so the counts may be rough: they are sums over CELLS hashed cells, whose table is of that size whatever the input.
    """
    sized = write_table(mixed.join(reps.select("id", "n"), "id"), "nd-sized")
    least = write_table(sized.groupBy("band", "key").agg(F.min("n").alias("least"), F.count("*").alias("c")), "nd-least")
    docs = join_counted(sized, least, ["band", "key"], "c", n_rows).groupBy("id").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.min(F.greatest("least", F.ceil(F.col("n") * percent / 100.0 - 1e-9))).alias("least"), F.max((F.col("label") != F.col("main")).cast("int")).alias("minor"))
    need = F.ceil((F.col("n") + F.col("least")) * percent / (100.0 + percent) - 1e-9)
    docs = write_table(docs.withColumn("first", F.col("n") - need + 1), "nd-hot")

    found = texts.join(docs, "id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(CELLS, dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                np.add.at(held, _cell(shingles(text)), 1)
        cells = np.flatnonzero(held)
        yield pd.DataFrame({"cell": cells, "n": held[cells]})

    sums = found.select("text").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, dtype=np.float32)
    counts[sums["cell"].to_numpy()] = sums["n"].to_numpy()

    def head(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                h = shingles(row.text)
                n_docs = counts[_cell(h)]
                order = np.lexsort((h, n_docs))[: row.first]
                place = np.flatnonzero(n_docs[order] > 1)
                yield pd.DataFrame({"id": row.id, "h": h[order[place]].astype(np.int64), "label": row.label, "minor": row.minor, "n": row.n, "place": place + 1})

    schema = "id long, h long, label long, minor int, n long, place long"
    heads = write_table(found.select("id", "text", "label", "minor", "n", "first").mapInPandas(head, schema), "nd-hot-heads")
    # shingles that several heads hold; of a common one, the holders are dealt to parts of at most PART and each minor one meets every part
    counts_ = heads.groupBy("h").agg(F.count("*").alias("c"), F.max("minor").alias("m")).filter("c > 1 and m = 1").drop("m")
    heads = join_counted(heads, write_table(counts_, "nd-common"), ["h"], "c", heads.count()).withColumn("parts", F.ceil(F.col("c") / PART).cast("int")).join(longs, "id")
    one = heads.filter("minor = 1").select(F.col("id").alias("x"), "h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("place").alias("px"), F.col("s").alias("sx"))
    other = heads.select(F.col("id").alias("y"), "h", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("place").alias("py"), F.col("s").alias("sy"))
    # with both sizes known, the first shared shingle must stand early enough in both
    shared = F.ceil((F.col("nx") + F.col("ny")) * percent / (100.0 + percent) - 1e-9)
    early = (F.col("px") <= F.col("nx") - shared + 1) & (F.col("py") <= F.col("ny") - shared + 1)
    both = other.join(one, (other["h"] == one["h"]) & (other["part"] == one["part"]) & (F.col("lx") != F.col("ly")) & early & _survives(F.col("sx"), F.col("sy"), percent / 100))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _several(members: DataFrame, known: DataFrame) -> DataFrame:
    """Buckets with several labels: band, key, `main` (the label with most members) and `n_here`."""
    counts = members.select("band", "key", "id").join(known, "id").groupBy("band", "key", "label").agg(F.count("*").alias("c"))
    found = counts.groupBy("band", "key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("n_labels"), F.sum("c").alias("n_here"))
    return write_table(found.filter("n_labels > 1").drop("n_labels"), "nd-several")
