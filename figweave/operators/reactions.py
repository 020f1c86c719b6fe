"""Reactions as rows (image_id, rxn_idx, role, box_idx): equality, scores, validity and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figweave.operators.boxes import dedup_greedy, greedy_keep

ROLES = ("reactants", "conditions", "products")


def valid(rows: DataFrame) -> DataFrame:
    """Rows of reactions with at least one reactant and one product."""
    w = W.partitionBy("image_id", "rxn_idx")
    n = lambda role: F.count_if(F.col("role") == role).over(w)
    return rows.withColumn("nr", n("reactants")).withColumn("np", n("products")).filter("nr > 0 and np > 0").drop("nr", "np")


def mol_only(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows whose box is a molecule; if that empties reactants or products, that role keeps all its rows. Conditions may become empty."""
    rows = rows.join(boxes.select("image_id", "box_idx", "category_id"), ["image_id", "box_idx"])
    left = F.count_if(F.col("category_id") == 1).over(W.partitionBy("image_id", "rxn_idx", "role"))
    return rows.withColumn("left", left).filter("category_id = 1 or (left = 0 and role <> 'conditions')").drop("left", "category_id")


def role_key(indices: Column, pooled: bool = False) -> Column:
    """Text of a reaction's sorted indices by role; pooled: reactants and conditions count as one role."""
    role = F.when(F.col("role") == "conditions", "reactants").otherwise(F.col("role")) if pooled else F.col("role")
    return F.array_join(F.sort_array(F.collect_list(F.concat(role, F.lit(":"), F.lpad(indices.cast("string"), 6, "0")))), ",")


def equal_pairs(gold: DataFrame, pred: DataFrame, match: DataFrame, pooled: bool = False) -> DataFrame:
    """(image_id, gold_rxn, pred_rxn): equal reactions. `match` (image_id, i, match) maps gold boxes to predicted ones; every box
    must have one, and the mapped indices must be the same by role. Both sides become keys, so this is an equi-join."""
    mapped = gold.join(match.select("image_id", F.col("i").alias("box_idx"), "match"), ["image_id", "box_idx"], "left")
    left = mapped.groupBy("image_id", F.col("rxn_idx").alias("gold_rxn")).agg(role_key(F.col("match"), pooled).alias("key"), F.count_if(F.col("match").isNull()).alias("open"))
    right = pred.groupBy("image_id", F.col("rxn_idx").alias("pred_rxn")).agg(role_key(F.col("box_idx"), pooled).alias("key"))
    return left.filter("open = 0").drop("open").join(right, ["image_id", "key"]).select("image_id", "gold_rxn", "pred_rxn")


def hits(gold: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per image: gold and predicted reactions and how many of each are in a pair; images of either side appear."""
    n = lambda df, c: df.groupBy("image_id").agg(F.countDistinct("rxn_idx").alias(c))
    found = pairs.groupBy("image_id").agg(F.countDistinct("gold_rxn").alias("gold_hits"), F.countDistinct("pred_rxn").alias("pred_hits"))
    out = n(gold, "gold").join(n(pred, "pred"), "image_id", "full").join(found, "image_id", "left")
    return out.na.fill(0, ["gold", "pred", "gold_hits", "pred_hits"])


def dedup(rows: DataFrame, same: DataFrame) -> DataFrame:
    """Valid reactions without those equal to an earlier one that stayed. same: (image_id, gold_rxn, pred_rxn) of the set with itself."""
    keep = valid(rows)
    conflicts = same.filter("pred_rxn < gold_rxn").select("image_id", F.col("gold_rxn").alias("rxn_idx"), F.col("pred_rxn").alias("earlier"))
    return greedy_keep(keep, conflicts, ["image_id"], "rxn_idx")


def dedup_boxes(rows: DataFrame, boxes: DataFrame, limit: float = 0.6) -> DataFrame:
    """Rows of reactions without empty boxes and without those that overlap an earlier kept box of the same reaction by more than `limit`; reactants come first, then products, then conditions.
    A box that a reaction names twice stays once. Other reactions do not matter."""
    rank = F.when(F.col("role") == "reactants", 0).when(F.col("role") == "products", 1).otherwise(2)
    members = rows.select("image_id", "rxn_idx", "role", "box_idx").join(boxes, ["image_id", "box_idx"])
    members = members.withColumn("ord", F.row_number().over(W.partitionBy("image_id", "rxn_idx").orderBy(rank, "box_idx")).cast("long"))
    return dedup_greedy(members, limit, ("image_id", "rxn_idx")).select("image_id", "rxn_idx", "role", "box_idx")


def of_sentences(sentences: DataFrame, found: DataFrame, keys: tuple[str, ...] = ("doc_id", "para_idx", "sent_idx")) -> DataFrame:
    """Sentences in which at least one reaction was found."""
    return sentences.join(found.select(*keys).distinct(), [*keys], "left_semi")


def with_ids(rows: DataFrame) -> DataFrame:
    """(image_id, rxn_idx, reaction_id): `r_s` with r the place of the reaction in its image, template first, and s its step, 1."""
    place = F.dense_rank().over(W.partitionBy("image_id").orderBy("rxn_idx")) - 1
    return rows.select("image_id", "rxn_idx").distinct().withColumn("reaction_id", F.concat(place.cast("string"), F.lit("_1")))


def role_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("image_id", "rxn_idx").agg(*[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ROLES])


def rebased_union(boxes: DataFrame, rows: DataFrame, width: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Images paired two by two in id order: the second one's boxes shifted by `width` in x and its indices by the first's box count. (boxes, reactions)."""
    ids = boxes.groupBy("image_id").agg(F.count("*").alias("n"))
    pairs = ids.withColumn("pair_id", F.floor(F.col("image_id") / 2)).withColumn("second", (F.col("image_id") % 2).cast("int"))
    first = pairs.filter("second = 0").select("pair_id", F.col("n").alias("offset"))
    facts = pairs.join(first, "pair_id", "left").select("image_id", "pair_id", "second", F.when(F.col("second") == 1, F.coalesce("offset", F.lit(0))).otherwise(0).alias("offset"))
    shift = F.col("second") * F.lit(width)
    moved = boxes.join(facts, "image_id").select("pair_id", (F.col("box_idx") + F.col("offset")).alias("box_idx"), "category_id", (F.col("x1") + shift).alias("x1"), "y1", (F.col("x2") + shift).alias("x2"), "y2")
    linked = rows.join(facts, "image_id").select("pair_id", "second", "rxn_idx", "role", (F.col("box_idx") + F.col("offset")).alias("box_idx"))
    return moved, linked


def drop_flat(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows without single boxes of zero area, and without reactions whose reactants, or whose products, all have zero area."""
    flat = boxes.select("image_id", "box_idx", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) <= 0).alias("flat"))
    sides = W.partitionBy("image_id", "rxn_idx")
    gone = lambda role: F.coalesce(F.min(F.when(F.col("role") == role, F.col("flat"))).over(sides), F.lit(False))
    marked = rows.join(flat, ["image_id", "box_idx"]).withColumn("r", gone("reactants")).withColumn("p", gone("products"))
    return marked.filter("not flat and not r and not p").drop("flat", "r", "p")


def answers(rows: DataFrame, smiles: DataFrame, texts: DataFrame) -> DataFrame:
    """(image_id, rxn_idx, reactants, products, conditions): smiles of both sides and texts of conditions in box order, with empty text where one is absent."""
    joined = rows.join(smiles, ["image_id", "box_idx"], "left").join(texts, ["image_id", "box_idx"], "left")
    value = F.when(F.col("role") == "conditions", F.coalesce("text", F.lit(""))).otherwise(F.coalesce("smiles", F.lit("")))
    side = lambda r: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == r, F.struct("box_idx", value.alias("v"))))), lambda x: x["v"]), "|").alias(r)
    return joined.groupBy("image_id", "rxn_idx").agg(*[side(r) for r in ROLES])
