"""Merkle fingerprints over pieces, paragraphs and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figweave.llm.shared import width

NO_ID = -(1 << 63)

#: A word with the blanks after it and, at the start of a line, before it.
WORD = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
#: One word in so many ends its piece, by the word's own hash.
ENDS = 8
#: A piece is a run of words up to a line break, which cuts() puts behind each word that ends one; 64 words at most, for runs without such a word.
PIECE = r"[\x20\x09\x0B-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){1,64}"
BLANKS = " \t\n\x0b\f\r"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def cuts(line: Column) -> Column:
    """Pieces of a line (no line break in it). They end after words chosen by their own hashes, so an edit changes the pieces that it touches and
    no later ones."""
    ends = lambda w: F.pmod(F.xxhash64(F.btrim(w, F.lit(BLANKS))), F.lit(ENDS)) == 0
    marked = F.transform(F.regexp_extract_all(line, F.lit(WORD), 0), lambda w: F.when(ends(w), F.concat(w, F.lit("\n"))).otherwise(w))
    return F.regexp_extract_all(F.array_join(marked, ""), F.lit(PIECE), 0)


def merkle_fingerprint(text: Column, section: int = 8) -> Column:
    """Text form of the Merkle tree of a text (null: empty): `root|section|section...`, a section `hash:paragraph;paragraph...`, a
    paragraph `hash,piece,piece...`.

    Paragraphs are the lines; `section` lines make a section. A paragraph's hash is the MD5 of all of it, a section's
    the SHA-256 of its paragraphs' hashes, the root the SHA-256 of the sections' hashes: equal roots mean
    equal texts. The string holds the whole root, 8 digits of each section and paragraph and 6 of each piece (eight words on average, see cuts()), so that two strings
    locate an edit by the branches that differ, and likeness() compares their leaves.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def paragraph(line):
        pieces = F.transform(cuts(line), lambda p: F.lpad(F.right(F.hex(F.xxhash64(p)), F.lit(6)), 6, "0"))
        return F.struct(F.md5(line).alias("h"), F.array_join(pieces, ",").alias("p"))

    def branch(paragraphs):
        digest = F.sha2(F.array_join(F.transform(paragraphs, lambda x: x["h"]), ""), 256)
        body = F.array_join(F.transform(paragraphs, lambda x: F.concat(F.left(x["h"], F.lit(8)), F.lit(","), x["p"])), ";")
        return F.struct(digest.alias("h"), F.concat(F.left(digest, F.lit(8)), F.lit(":"), body).alias("s"))

    def tree(ps):
        starts = F.sequence(F.lit(1), F.size(ps), F.lit(section))
        return _let(F.transform(starts, lambda i: branch(F.slice(ps, i, F.lit(section)))), root)

    def root(sections):
        top = F.sha2(F.array_join(F.transform(sections, lambda x: x["h"]), ""), 256)
        return F.concat(top, F.lit("|"), F.array_join(F.transform(sections, lambda x: x["s"]), "|"))

    return _let(F.transform(lines, paragraph), tree)


def leaves(fingerprint: Column) -> Column:
    """Distinct piece codes of a fingerprint."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(fingerprint, "^[0-9a-f]{64}|[|;]?[0-9a-f]{8}[:,]", ","), ",+"), lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two fingerprints: 1 for equal roots, else twice the shared piece codes over both counts, below 1."""
    pair = F.struct(leaves(a).alias("a"), leaves(b).alias("b"))
    dice = _let(pair, lambda p: 2.0 * F.size(F.array_intersect(p["a"], p["b"])) / F.greatest(F.size(p["a"]) + F.size(p["b"]), F.lit(1)))
    return F.when(F.left(a, F.lit(64)) == F.left(b, F.lit(64)), F.lit(1.0)).otherwise(F.least(dice, F.lit(0.999999)))


def edited_sections(a: Column, b: Column) -> Column:
    """1-based numbers of the sections whose branches differ between two fingerprints."""
    parts = F.arrays_zip(F.slice(F.split(a, "\\|"), 2, 1 << 30).alias("a"), F.slice(F.split(b, "\\|"), 2, 1 << 30).alias("b"))
    marked = F.transform(parts, lambda x, i: F.when(~x["a"].eqNullSafe(x["b"]), i + 1))
    return F.filter(marked, lambda x: x.isNotNull())


def with_next_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`id`, `text`, `fp` and `next_text`, `next_fp` of the document before it in id (descending order; after the last, the first).

    Rows are dealt by id into ranges that begin at ids of the table; the row that begins a range also goes to
    the range before it, so each range finds all its neighbours. Texts are shuffled once and no task holds more than a range.
    A null id comes last; rows that repeat an id follow each other by a hash of their texts. A single row follows itself.
    """
    n = 4 * width(docs.sparkSession)
    rid = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    rows = docs.select(F.col(id_col).alias("id"), rid.alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.agg(F.percentile_approx("rid", [(i + 1) / n for i in range(n)], 10 * n).alias("q"), F.max("rid").alias("m")).first()
    heads = sorted({*(found["q"] or []), *([] if found["m"] is None else [found["m"]])}) or [0]
    k, bits = len(heads), max(1, (len(heads) - 1).bit_length())
    padded = F.array(*map(F.lit, heads + [(1 << 63) - 1] * ((1 << bits) - len(heads))))

    def halve(low, half):
        return F.when(F.element_at(padded, low + half) < F.col("rid"), low + half).otherwise(low)

    # how many heads lie below the id, by binary search; range j holds the ids above head j-1 up to head j
    own = F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)]), F.lit(0), halve)
    rows = rows.withColumn("range", own)
    before = F.when(F.col("range") == k - 1, 0).otherwise(F.col("range") + 1)  # of the range after it; the first follows the last
    is_head = F.element_at(padded, F.col("range") + 1) == F.col("rid")
    here = F.struct(F.col("range").alias("to"), F.lit(0).alias("halo"))
    there = F.struct(before.alias("to"), F.lit(1).alias("halo"))
    rows = rows.withColumn("fp", merkle_fingerprint(F.col("text")))
    rows = rows.withColumn("at", F.explode(F.when(is_head, F.array(here, there)).otherwise(F.array(here))))
    rows = rows.select("id", "rid", "text", "fp", F.col("at.to").alias("to"), F.col("at.halo").alias("halo"))
    order = W.partitionBy("to").orderBy("halo", F.col("rid").desc(), F.xxhash64("text"))
    rows = rows.select("id", "text", "fp", "halo", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp"))
    return rows.filter("halo = 0").drop("halo")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: `id`, `text`, `fp`. Null text: the empty text. Other columns are ignored; no rows give no rows."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("fp", merkle_fingerprint(F.col("text")))
