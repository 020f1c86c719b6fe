"""Phrase collocation mining with counting quotient filters over packed word numbers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figweave.llm.shared import ranked, width, write_table

#: A text is read in chunks of about so many characters that end between pieces, and counted in blocks of about so many.
CHUNK, BLOCK = 1 << 18, 8 << 20
#: Filter entries that one merging task is planned for.
SHARD = 1 << 21
#: Parts that a language's phrases are ranked in before the last ranking.
SALTS = 16
ROUNDS = 6
_FOLD = {**{c: c + 32 for c in range(65, 91)}, **{ord(c): "\n" for c in ".,;:!?\x0b\x0c\r"}, 9: " "}
_TOKEN = re.compile("[^ \n]+|\n+")
_ASCII = bytes(_FOLD[c] if isinstance(_FOLD.get(c), int) else ord(_FOLD.get(c, chr(c))) for c in range(128)) + bytes(range(128, 256))


def tokens(text: str) -> list[str]:
    """Words of a text in lower case (A-Z only), with tokens of line ends between pieces."""
    return _TOKEN.findall(text.encode().translate(_ASCII).decode())


class Permutation:
    """An invertible mix of keys of 2 * half bits, each a pair (high, low) of `half`-bit numbers: a Feistel network, so any round function can be undone."""

    def __init__(self, bits: int):
        self.half = max(8, (bits + 1) // 2)
        if self.half > 62:
            raise ValueError("keys are longer than 124 bits")
        self.mask = np.uint64((1 << self.half) - 1)

    def _turn(self, x: np.ndarray, k: int) -> np.ndarray:
        x = (x + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) & self.mask

    def mix(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in range(ROUNDS):
            high, low = low, high ^ self._turn(low, k)
        return high, low

    def undo(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for k in reversed(range(ROUNDS)):
            high, low = low ^ self._turn(high, k), high
        return high, low


def _put(values: np.ndarray, size: int) -> bytes:
    """The low `size` bytes of each number."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _get(raw: memoryview, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size).reshape(n, size)
    return out.reshape(-1).view("<u8").astype(np.uint64)


class QuotientFilter:
    """Ascending distinct mixed keys (high, low) with counts, stored without loss as a counting quotient filter.

    The upper `q` bits of `high` are the quotient. One bit a quotient says whether it occurs, one bit an entry whether its run of equal quotients ends there; then come the full remainders (the rest
    of `high`, and `low`) and a byte a count, 255 standing for a longer one behind. Filters of any `q` hold keys in the same order, so they merge as sorted runs.
    """

    def __init__(self, half: int, high: np.ndarray, low: np.ndarray, counts: np.ndarray):
        self.half, self.high, self.low, self.counts = half, high, low, counts

    @classmethod
    def of(cls, half: int, high: np.ndarray, low: np.ndarray, counts: np.ndarray) -> QuotientFilter:
        """Of keys in any order; counts of equal keys are added up."""
        order = np.lexsort((low, high)) if 2 * half > 64 else np.argsort(high << np.uint64(half) | low, kind="stable")
        high, low, counts = high[order], low[order], counts[order]
        if not len(high):
            return cls(half, high, low, counts)
        first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
        return cls(half, high[first], low[first], np.add.reduceat(counts, first))

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """The sum of filters: runs of half the filters are merged at a time; the stable sort underneath finds the two sorted runs and merges them."""
        while len(filters) > 1:
            filters = [cls._pair(*filters[i : i + 2]) if i + 1 < len(filters) else filters[i] for i in range(0, len(filters), 2)]
        return filters[0]

    @classmethod
    def _pair(cls, a: QuotientFilter, b: QuotientFilter) -> QuotientFilter:
        return cls.of(a.half, np.concatenate([a.high, b.high]), np.concatenate([a.low, b.low]), np.concatenate([a.counts, b.counts]))

    def pack(self) -> bytes:
        """With as many quotient bits as give the range of its keys about as many quotients as it has entries."""
        n, half = len(self.high), self.half
        q = half - max(0, (int(self.high[-1] - self.high[0]) // n).bit_length() - 1) if n else 1
        quotient = (self.high >> np.uint64(half - q)).astype(np.int64)
        base = int(quotient[0]) if n else 0  # a shard's quotients lie close together: bits start at its first
        used = np.zeros(int(quotient[-1]) - base + 1 if n else 0, bool)
        used[quotient - base] = True
        ends = np.concatenate([quotient[1:] != quotient[:-1], [True]]) if n else used
        rest, own = half - q + 7 >> 3, half + 7 >> 3
        long = self.counts >= 255
        head = np.array([n, q, base, len(used), int(long.sum())], "<i8").tobytes()
        return b"".join((head, np.packbits(used).tobytes(), np.packbits(ends).tobytes(), _put(self.high & np.uint64((1 << half - q) - 1), rest), _put(self.low, own),
                         np.where(long, 255, self.counts).astype(np.uint8).tobytes(), self.counts[long].astype("<i8").tobytes()))

    @classmethod
    def unpack(cls, half: int, raw: bytes) -> QuotientFilter:
        n, q, base, span, more = map(int, np.frombuffer(raw, "<i8", 5))
        view, at = memoryview(raw), 40

        def take(size: int) -> memoryview:
            nonlocal at
            at += size
            return view[at - size : at]

        used = np.unpackbits(np.frombuffer(take(span + 7 >> 3), np.uint8), count=span)
        ends = np.unpackbits(np.frombuffer(take(n + 7 >> 3), np.uint8), count=n)
        rest, own = half - q + 7 >> 3, half + 7 >> 3
        run = np.cumsum(ends) - ends  # how many runs end before the entry
        quotient = (np.flatnonzero(used) + base).astype(np.uint64)[run] if n else np.zeros(0, np.uint64)
        high = quotient << np.uint64(half - q) | _get(take(n * rest), n, rest)
        low = _get(take(n * own), n, own)
        counts = np.frombuffer(take(n), np.uint8).astype(np.int64)
        counts[counts == 255] = np.frombuffer(take(8 * more), "<i8")
        return cls(half, high, low, counts)


class Packing:
    """Phrases of up to `longest` words as one key: word numbers plus one, `bits` bits each, first word first, 0 where there is no word."""

    def __init__(self, words: int, longest: int):
        self.bits, self.longest = max(1, int(words).bit_length()), longest
        self.permutation = Permutation(self.bits * longest)
        self.half = self.permutation.half

    def pack(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """numbers[phrase, place], already plus one."""
        high, low = np.zeros(len(numbers), np.uint64), np.zeros(len(numbers), np.uint64)
        for p in range(self.longest):
            x, shift = numbers[:, p].astype(np.uint64), self.bits * (self.longest - 1 - p)
            if shift >= self.half:
                high |= x << np.uint64(shift - self.half)
            else:
                low |= x << np.uint64(shift) & self.permutation.mask
                if shift + self.bits > self.half:
                    high |= x >> np.uint64(self.half - shift)
        return high, low

    def unpack(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        out, one = np.zeros((len(high), self.longest), np.int64), np.uint64((1 << self.bits) - 1)
        for p in range(self.longest):
            shift = self.bits * (self.longest - 1 - p)
            if shift >= self.half:
                x = high >> np.uint64(shift - self.half)
            else:
                x = low >> np.uint64(shift)
                if shift + self.bits > self.half:
                    x |= high << np.uint64(self.half - shift)
            out[:, p] = (x & one).astype(np.int64)
        return out


@dataclass
class _Block:
    """A block that a task is filling: its number, characters so far, words, and texts (with their characters) that have not left yet."""

    number: int
    chars: int = 0
    words: Counter = field(default_factory=Counter)
    texts: list[str] = field(default_factory=list)
    held: int = 0


def _blocks(docs: DataFrame) -> DataFrame:
    """Rows of blocks of one language: chunks of text (block, lang, text), and at each block's end its words with their counts (block, lang, words, counts)."""
    names, types = ["block", "lang", "text", "words", "counts"], [pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]

    def pieces(text: str) -> Iterator[str]:
        """Chunks that end between pieces; a piece longer than a chunk stays whole."""
        at = 0
        while len(text) - at > CHUNK:
            cut = max(text.rfind(c, at, at + CHUNK) for c in ".,;:!?\n\x0b\x0c\r")
            if cut < at:
                found = re.compile("[.,;:!?\n\x0b\x0c\r]").search(text, at + CHUNK)
                cut = found.start() if found else len(text) - 1
            yield text[at : cut + 1]
            at = cut + 1
        yield text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, open_blocks = TaskContext.get().partitionId() << 32, {}

        def frame(*row) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

        def texts(own: _Block, lang: str) -> pa.RecordBatch:
            out, own.texts, own.held = frame(own.number, lang, "\n".join(own.texts), None, None), [], 0
            return out

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            own = open_blocks.pop(lang)
            if own.texts:
                yield texts(own, lang)
            yield frame(own.number, lang, None, list(own.words), list(own.words.values()))

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                for chunk in pieces(text.as_py()):
                    if lang not in open_blocks:
                        open_blocks[lang], number = _Block(number), number + 1
                    own = open_blocks[lang]
                    own.words.update(t for t in tokens(chunk) if t[0] != "\n")
                    own.texts.append(chunk)
                    own.chars, own.held = own.chars + len(chunk), own.held + len(chunk)
                    if own.held >= CHUNK:
                        yield texts(own, lang)
                    if own.chars >= BLOCK:
                        yield from close(lang)
                    elif sum(x.chars for x in open_blocks.values()) >= 4 * BLOCK:  # many languages at once: the fullest block ends early
                        yield from close(max(open_blocks, key=lambda k: open_blocks[k].chars))
        for lang in list(open_blocks):
            yield from close(lang)

    return docs.mapInArrow(run, "block long, lang string, text string, words array<string>, counts array<long>")


def _count_block(numbers: dict[str, int], texts: list[str], packing: Packing, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, filter) of a block: its phrases of up to `longest` numbered words, counted, permuted and cut by shard. A word without a number is rarer than any phrase that is asked for."""
    streams = []
    for text in texts:
        found = tokens(text)
        streams.append(np.fromiter((numbers.get(t, 0) for t in found), np.int64, len(found)))
        streams.append(np.zeros(1, np.int64))
    stream = np.concatenate(streams) if streams else np.zeros(0, np.int64)
    # numbers of the block's own words are dense, so phrases fit 64 bits for counting here
    own, local = np.unique(stream, return_inverse=True)
    if not len(own) or own[0] != 0:
        own, local = np.concatenate([[0], own]), local + 1
    size, longest = len(own), packing.longest
    ends = np.concatenate([local, np.zeros(longest, local.dtype)]).astype(np.int64)
    keys, counts = [], []
    for n in range(1, longest + 1):
        columns = [ends[p : p + len(local)] for p in range(n)]
        whole = columns[0] > 0
        for c in columns[1:]:
            whole = whole & (c > 0)
        if size**n < 1 << 62:
            key = np.zeros(int(whole.sum()), np.int64)
            for c in columns:
                key = key * size + c[whole]
            key, count = np.unique(key, return_counts=True)
            places = np.stack([key // size ** (n - 1 - p) % size for p in range(n)], axis=1) if len(key) else np.zeros((0, n), np.int64)
        else:
            places, count = np.unique(np.stack([c[whole] for c in columns], axis=1), axis=0, return_counts=True)
        keys.append(np.concatenate([own[places], np.zeros((len(places), longest - n), np.int64)], axis=1))
        counts.append(count)
    high, low = packing.permutation.mix(*packing.pack(np.concatenate(keys)))
    held = QuotientFilter.of(packing.half, high, low, np.concatenate(counts).astype(np.int64))
    shard = _shard(held.high, packing.half, shards)
    bounds = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.unique(shard).tolist():
        cut = slice(int(bounds[s]), int(bounds[s + 1]))
        yield s, QuotientFilter(packing.half, held.high[cut], held.low[cut], held.counts[cut]).pack()


def _shard(high: np.ndarray, half: int, shards: int) -> np.ndarray:
    """Equal ranges of quotients, in order; by the upper 24 bits, so that the product stays exact."""
    top = high >> np.uint64(max(0, half - 24))
    return (top * np.uint64(shards) >> np.uint64(min(half, 24))).astype(np.int64)


def phrase_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, words, totals): how often phrases of 1 to `longest` words occur in each language, for those that occur at least `least` times.

    counts(ids, f): ids are word numbers. words(lang, word, id). totals(lang, n): all word occurrences. Null text counts as empty, null lang as `und`; other columns are ignored.

    Texts are written in blocks; each block's distinct words are counted and the words that occur `least` times get dense numbers, which go back to the blocks that hold them. A phrase that occurs `least` times has only
    such words, so leaving the others out loses nothing. Each block then gives one filter a shard of quotients; a shard's filters, whose size is planned, are merged as sorted runs. No dictionary is broadcast, no phrase's occurrences meet in one task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    blocks = write_table(_blocks(rows), "phrase-blocks")
    own = blocks.filter("words is not null").select("block", "lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("block", "lang", F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    vocabulary = own.groupBy("lang", "word").agg(F.sum("c").alias("f"))
    words = ranked(vocabulary.filter(F.col("f") >= least).select("lang", "word"), ["lang", "word"], "phrase-words").withColumnRenamed("_rank", "id")
    words = write_table(words, "phrase-numbers")
    totals = own.groupBy("lang").agg(F.sum("c").alias("n"))
    known, occurrences, n_blocks = words.count(), own.agg(F.sum("c")).first()[0] or 0, blocks.filter("words is not null").count()
    packing = Packing(known, longest)
    shards = min(1 << 20, max(width(spark), -(-occurrences * longest // SHARD)))

    def count(texts, numbered):
        numbers = {w: i + 1 for w, i in zip(numbered.column("word").to_pylist(), numbered.column("id").to_pylist())}
        found = list(_count_block(numbers, texts.column("text").to_pylist(), packing, shards))
        return pa.table({"shard": pa.array([s for s, _ in found], pa.int64()), "filter": pa.array([f for _, f in found], pa.binary())})

    def merge(table):
        held = QuotientFilter.merged([QuotientFilter.unpack(packing.half, x.as_py()) for x in table.column("filter")])
        often = held.counts >= least
        ids = packing.unpack(*packing.permutation.undo(held.high[often], held.low[often]))
        sizes = (ids > 0).sum(axis=1)
        flat = ids.reshape(-1)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.table({"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[flat > 0] - 1)), "f": pa.array(held.counts[often])})

    n = max(width(spark), n_blocks)
    texts = blocks.filter("text is not null").select("block", "text").repartition(n, "block")
    numbered = own.join(words, ["lang", "word"]).select(F.col("block").alias("of"), "word", "id").repartition(n, "of")
    filters = texts.groupBy("block").cogroup(numbered.groupBy("of")).applyInArrow(count, "shard long, filter binary")
    counts = filters.repartition(shards, "shard").groupBy("shard").applyInArrow(merge, "ids array<long>, f long")
    return write_table(counts, "phrase-counts"), words, totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = 3, least: int = 10, top: int = 2000, inside_percent: int = 50) -> DataFrame:
    """The `top` phrases of 2 to `longest` words of each language: lang, rank, phrase, a, l, r, n, score.

    a, l and r are the counts of the phrase, its first and its other words at the cut with the lowest score floor(1000000 * a * a / (l * r)), the first of equal cuts. Phrases inside a longer one that occurs at least
    `inside_percent` % as often go. Order: score, a, then phrase by its bytes. Ties, repeated rows and hot words need no special case; no rows give no rows. Pieces and words are those of `tokens`.
    """
    counts, words, totals = phrase_counts(docs, lang_col, text_col, longest, least)
    phrases = counts.filter(F.size("ids") > 1)
    cuts = phrases.select("ids", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", 1, F.col("k")).alias("head"), F.slice("ids", F.col("k") + 1, F.size("ids")).alias("tail"))
    cuts = cuts.join(counts.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head").join(counts.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    cuts = cuts.withColumn("score", F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"))
    scored = cuts.groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = phrases.filter(F.size("ids") > 2).select(F.col("f"), F.explode(_inner("ids")).alias("ids")).groupBy("ids").agg(F.max("f").alias("over"))
    kept = scored.join(inner, "ids", "left").filter(F.col("over").isNull() | (F.col("over") * 100 < F.col("a") * inside_percent))
    named = kept.select("ids", "a", "cut", F.posexplode("ids").alias("at", "id")).join(words, "id")
    named = named.groupBy("ids", "lang", "a", "cut").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = named.select("lang", "a", "cut.l", "cut.r", "cut.score", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"))
    # a language may hold most phrases: the first of each of SALTS parts of it, then the first of these
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    best = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", place("lang", "salt")).filter(F.col("rank") <= top)
    best = best.withColumn("rank", place("lang")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _inner(ids: str) -> Column:
    """All shorter phrases of two words or more inside a phrase."""
    size = F.size(ids)
    spans = F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.slice(F.col(ids), at, n)))
    return F.array_distinct(F.flatten(spans))
