"""Token sequences: vocabularies, ids, padding, and sequences of reactions, boxes and coreferences.

A box is five tokens: four bins (BINS_AT and up) and a category (-1 less the category's number, or NOISE where it is unknown). In a reaction sequence a role token closes
the boxes of its role: reactants RCT conditions CND products PRD, then RXN, or NOISE for a reaction that is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figweave.functions.ordering import ranked
from figweave.operators.boxes import coref_links
from figweave.operators.graphs import spread

PAD, SOS, EOS, UNK = 0, 1, 2, 3
RXN, RCT, CND, PRD, NOISE, END, BINS_AT = 4, 5, 6, 7, 8, 2, 10
#: Role by the token that closes it, in the order of a sequence.
CLOSES = {"reactants": RCT, "conditions": CND, "products": PRD}


def fit_vocabulary(tokens: DataFrame, special: int = 4) -> DataFrame:
    """(token, id): distinct tokens in order behind the special ids. Ranked in ranges, never in one task and in no group that grows with a prefix."""
    distinct = tokens.select("token").filter("token <> ''").distinct()
    return ranked(distinct, ["token"]).select("token", (F.col("rank") + special).alias("id"))


def in_blocks(rows: DataFrame) -> DataFrame:
    """rows(doc_id, ..) with `block`, a share of the documents by their id, and partitioned by it; as they are where they have one."""
    if "block" in rows.columns:
        return rows
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return spread(rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(max(4, n)))), "block")


def _looked_up(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """rows(block, .., key) with `value` from table(key, value), null where it is not in there. A block asks once for each distinct key, so that is what is shuffled; answers and rows of a block meet in a window."""
    asked = rows.select("block", key).filter(F.col(key).isNotNull()).distinct()
    found = spread(asked.join(table.select(key, value), key), "block").select("block", key, value, F.lit(True).alias("_answer"))
    both = rows.withColumn("_answer", F.lit(False)).unionByName(found, allowMissingColumns=True)
    # the key first: the sort compares it by prefixes, the block is the same for most rows of a task
    return both.withColumn(value, F.max(value).over(W.partitionBy(key, "block"))).filter("not _answer").drop("_answer")


def to_ids(tokens: DataFrame, vocabulary: DataFrame, limit: int | None = None) -> DataFrame:
    """tokens(doc_id, tok_idx, token) as (doc_id, ids): start, known ids or UNK, end; at most `limit` tokens of a document. Tokens with a block (in_blocks) are not shuffled, and the result has it too."""
    rows = tokens if limit is None else tokens.filter(F.col("tok_idx") < limit)
    rows = in_blocks(rows).select("block", "doc_id", "tok_idx", "token")
    found = _looked_up(rows, vocabulary, "token", "id").select("block", "doc_id", "tok_idx", F.coalesce("id", F.lit(UNK)).cast("long").alias("id"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("tok_idx", "id"))), lambda x: x["id"])
    out = found.groupBy("block", "doc_id").agg(F.concat(F.array(F.lit(SOS).cast("long")), ids, F.array(F.lit(EOS).cast("long"))).alias("ids"))
    return out if "block" in tokens.columns else out.drop("block")


def to_text(ids: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): specials dropped, stopped at the first end or pad. Ids with a block are not shuffled."""
    at = lambda v: F.nullif(F.array_position("ids", F.lit(v).cast("long")), F.lit(0).cast("long"))
    upto = F.coalesce(F.least(at(EOS), at(PAD)) - 1, F.size("ids")).cast("int")
    rows = in_blocks(ids).select("block", "doc_id", F.posexplode(F.slice("ids", F.lit(1), upto)).alias("k", "id")).filter(F.col("id") != SOS)
    rows = _looked_up(rows, vocabulary, "id", "token")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("token", F.lit("<unk>")).alias("t")))), lambda x: x["t"]), " ")
    return rows.groupBy("block", "doc_id").agg(text.alias("text")).drop("block")


def pad_batches(rows: DataFrame, batch: str, values: str, fill: int = PAD) -> DataFrame:
    """rows with `values` filled up to the longest of its batch."""
    widest = F.max(F.size(values)).over(W.partitionBy(batch))
    return rows.withColumn("_w", widest).withColumn(values, F.concat(values, F.array_repeat(F.lit(fill).cast("long"), F.col("_w") - F.size(values)))).drop("_w")


def box_tokens(q: Column, category: Column) -> Column:
    """Five tokens of a box: its bins `q` and its category, NOISE for an unknown one. A box without area in bins writes none."""
    kind = F.when(category.between(1, 4), F.lit(-1) - category).otherwise(NOISE)
    five = F.concat(F.transform(q, lambda v: (v + BINS_AT).cast("int")), F.array(kind.cast("int")))
    return F.when((q[0] < q[2]) & (q[1] < q[3]), five).otherwise(F.array().cast("array<int>"))


def _in_order(order: str, value: Column) -> Column:
    """Arrays of a group, one behind the other."""
    return F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("k"), value.alias("v")))), lambda x: x["v"]))


def box_sequence(rows: DataFrame, order: str = "box_idx") -> DataFrame:
    """(image_id, tokens) of rows(image_id, q: array of 4 bins, category_id, order): the boxes in order between start and end."""
    boxes = rows.groupBy("image_id").agg(_in_order(order, box_tokens(F.col("q"), F.col("category_id"))).alias("t"))
    return boxes.select("image_id", F.concat(F.array(F.lit(SOS)), "t", F.array(F.lit(END))).alias("tokens"))


def reaction_sequence(rows: DataFrame) -> DataFrame:
    """(image_id, tokens) of rows(image_id, rxn_idx, role, box_idx, q: array of 4 bins, category_id): start, the reactions in order, end. Each role's boxes come before the token that
    closes the role, which is there without conditions too. A reaction whose reactants or products are missing or have no area writes nothing."""
    side = lambda r: F.concat(F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == r, F.struct("box_idx", F.col("b"))))), lambda x: x["b"])), F.array(F.lit(CLOSES[r])))
    rows = rows.withColumn("b", box_tokens(F.col("q"), F.col("category_id")))
    shown = lambda r: F.max((F.col("role") == r) & (F.size("b") > 0))
    whole = shown("reactants") & shown("products")
    each = rows.groupBy("image_id", "rxn_idx").agg(F.when(whole, F.concat(*[side(r) for r in CLOSES], F.array(F.lit(RXN)))).otherwise(F.array().cast("array<int>")).alias("t"))
    return each.groupBy("image_id").agg(_in_order("rxn_idx", F.col("t")).alias("t")).select("image_id", F.concat(F.array(F.lit(SOS)), "t", F.array(F.lit(END))).alias("tokens"))


def _found(sequences: DataFrame) -> DataFrame:
    """Tokens (image_id, k, t, b0..b3, is_box) before the first end. A box stands where four bins in corner order are followed by a category; no two can overlap, as a category is
    no bin, so reading on by one token after a broken box finds the same boxes."""
    tokens = sequences.select("image_id", F.posexplode("tokens").alias("k", "t"))
    order = W.partitionBy("image_id").orderBy("k")
    ended = F.max((F.col("t") == END).cast("int")).over(order)
    rows = tokens.select("image_id", "k", "t", ended.alias("ended"), *[F.lag("t", 4 - i).over(order).alias(f"b{i}") for i in range(4)]).filter("ended = 0").drop("ended")
    bins = " and ".join(f"b{i} >= {BINS_AT}" for i in range(4))
    return rows.withColumn("is_box", F.coalesce(F.expr(f"t between -5 and -2 and {bins} and b0 < b2 and b1 < b3"), F.lit(False)))


def _corners() -> list[Column]:
    return [*[(F.col(f"b{i}") - BINS_AT).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], (-1 - F.col("t")).alias("category_id")]


def parse_boxes(sequences: DataFrame) -> DataFrame:
    """(image_id, box_idx, x1, y1, x2, y2, category_id) of box sequences, corners as bins; other tokens are skipped."""
    place = F.row_number().over(W.partitionBy("image_id").orderBy("k")) - 1
    return _found(sequences).filter("is_box").select("image_id", place.alias("box_idx"), *_corners())


def parse_corefs(sequences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(boxes, links) of coreference sequences: the identifiers right behind a molecule or text box link to it."""
    boxes = parse_boxes(sequences)
    return boxes, coref_links(boxes)


def parse_reactions(sequences: DataFrame) -> DataFrame:
    """(image_id, rxn, label, role, k, x1, y1, x2, y2, category_id) of reaction sequences. Boxes are reactants up to RCT, conditions up to CND, products up to PRD and nothing behind it; RXN or
    NOISE (the label) closes a reaction, which needs a reactant and a product; END stops. What is not closed by then goes. `rxn` counts the closing tokens before."""
    rows, order = _found(sequences), W.partitionBy("image_id").orderBy("k")
    closing = F.col("t").isin(RXN, NOISE)
    rows = rows.withColumn("rxn", F.coalesce(F.sum(closing.cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("state", F.last(F.when(F.col("t").isin(RCT, CND, PRD, RXN, NOISE), F.col("t")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    role = F.when(F.col("state").isNull() | F.col("state").isin(RXN, NOISE), "reactants").when(F.col("state") == RCT, "conditions").when(F.col("state") == CND, "products")
    whole = W.partitionBy("image_id", "rxn")
    # only boxes and closing tokens are sorted by reaction
    rows = rows.filter(F.col("is_box") | closing).withColumn("role", role).withColumn("label", F.max(F.when(F.col("t") == RXN, "[Rxn]").when(F.col("t") == NOISE, "[Noise]")).over(whole))
    boxes = rows.filter("is_box and role is not null and label is not null").select("image_id", "rxn", "label", "role", "k", *_corners())
    has = lambda r: F.max((F.col("role") == r).cast("int")).over(whole)
    return boxes.withColumn("a", has("reactants")).withColumn("b", has("products")).filter("a = 1 and b = 1").drop("a", "b")
