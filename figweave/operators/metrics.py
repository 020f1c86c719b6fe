"""Evaluation metrics over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figweave.functions.chemistry import normal_smiles
from figweave.functions.lineage import cut
from figweave.functions.ordering import ranked

THRESHOLDS = tuple(round(0.5 + 0.05 * k, 2) for k in range(10))
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}


def smiles_scores(pairs: DataFrame) -> DataFrame:
    """One row of scores of pairs(gold, pred), both canonical text: shares of valid golds and predictions, of exact predictions, without chirality, without geometry, and on chiral golds (-1 without
    any). A null or empty gold is not valid and counts as `<empty>`, so that no prediction equals it."""
    pairs = pairs.withColumn("gold", F.when(F.col("gold") != "", F.col("gold")).otherwise("<empty>"))
    share = lambda c: F.avg(c.cast("int"))
    same = F.col("gold") == F.col("pred")
    plain = lambda c, **k: normal_smiles(F.col(c), **k)
    chiral = F.contains("gold", F.lit("@"))
    return pairs.agg(
        F.count("*").alias("n"), share(F.col("gold") != "<empty>").alias("gold_valid"), share(F.col("pred") != "").alias("valid"), share(same).alias("exact"), share(plain("gold", stereo=True) == plain("pred", stereo=True)).alias("no_chirality"),
        share(plain("gold", chiral=True) == plain("pred", chiral=True)).alias("no_geometry"), share(chiral).alias("chiral_share"), F.coalesce(F.avg(F.when(chiral, same.cast("int"))), F.lit(-1.0)).alias("chiral_exact"))


def topk_accuracy(rows: DataFrame, key: str, ks: tuple[int, ...]) -> DataFrame:
    """(k, accuracy in percent) of rows(key, target, scores): whether the target is among the k best classes, ties to the lowest class."""
    own = F.col("scores")[F.col("target")]
    better = F.size(F.filter(F.transform("scores", lambda s, i: (s > own) | ((s == own) & (i < F.col("target")))), lambda x: x))
    placed = rows.withColumn("place", better).withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return placed.groupBy("k").agg((F.avg((F.col("place") < F.col("k")).cast("int")) * 100).alias("accuracy"))


def rolling(rows: DataFrame, key: str, order: list[str], value: str, size: int, chunk: int = 100_000) -> DataFrame:
    """rows with the lower median, mean, maximum and last value of the last `size` rows of a key, and the key's mean over all.

    Keys of at most `chunk` rows, by a count when this is called, are one window each, and the mean over all is a window on the same partitions. The rows of larger keys are ranked and windowed in chunks of their order; the last size - 1 rows of a chunk also go to the next one
    as its halo, so a key with most rows is many tasks. `chunk` only says which way.
    """
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    large = n.filter(F.col("_n") > chunk).select(key)

    def finished(df: DataFrame) -> DataFrame:
        out = df.withColumn("median", F.element_at("_h", F.floor((F.size("_h") + 1) / 2).cast("int"))).withColumn("max", F.array_max("_h")).withColumn("last", F.col(value))
        return out.select(*rows.columns, "mean", "median", "max", "last", "total_mean")

    def plain(df: DataFrame) -> DataFrame:
        w = W.partitionBy(key).orderBy(*order).rowsBetween(1 - size, 0)
        return finished(df.withColumn("_h", F.sort_array(F.collect_list(value).over(w))).withColumn("mean", F.avg(value).over(w)).withColumn("total_mean", F.avg(value).over(W.partitionBy(key))))

    if large.isEmpty():
        return plain(rows)
    large = cut(large)
    placed = ranked(rows.join(large, key, "left_semi"), order, key).withColumn("_chunk", F.floor(F.col("rank") / chunk))
    late = F.col("rank") % chunk >= chunk - size + 1
    mine, more = F.struct(F.col("_chunk").alias("c"), F.lit(False).alias("halo")), F.struct((F.col("_chunk") + 1).alias("c"), F.lit(True).alias("halo"))
    dealt = placed.withColumn("_to", F.explode(F.when(late, F.array(mine, more)).otherwise(F.array(mine))))
    w = W.partitionBy(key, "_to.c").orderBy("rank").rowsBetween(1 - size, 0)
    dealt = dealt.withColumn("_h", F.sort_array(F.collect_list(value).over(w))).withColumn("mean", F.avg(value).over(w)).filter("not _to.halo")
    total = rows.join(large, key, "left_semi").groupBy(key).agg(F.avg(value).alias("total_mean"))
    return plain(rows.join(large, key, "left_anti")).unionByName(finished(dealt.join(total, key)))


def weighted_mean(rows: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col(n)) / F.sum(n)).alias("mean"), F.sum(n).alias("n"))


def merge_fill(rows: DataFrame, ok: Column, first: Column, second: Column) -> DataFrame:
    """Counts of a merge that takes `first` where ok and `second` elsewhere."""
    return rows.agg(F.count("*").alias("n"), F.count_if(~ok).alias("n_failed"), F.count_if(~ok & (second == 1)).alias("n_filled"), F.avg(ok.cast("int")).alias("success"), F.sum(F.when(ok, first).otherwise(second)).alias("merged")).withColumn("success", F.round("success", 6))


def _alike(gold: np.ndarray, preds: np.ndarray, scale: float) -> tuple[list[tuple], np.ndarray]:
    """Greedy matches of images with equally many boxes, corners gold[image, box, 4] and preds[image, place by score, 4]: predictions by score take the free gold box with the highest IoU that reaches
    the threshold. Gives (image, area, threshold, place, hit) as arrays, and gold boxes by area."""
    size = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    thresholds = np.array(THRESHOLDS)
    low, high = (np.array([AREAS[n][k] for n in AREAS])[None, :, None] for k in (0, 1))
    within = lambda b: (size(b)[:, None] * scale >= low) & (size(b)[:, None] * scale < high)
    skip, inside = ~within(gold)[:, :, None], within(preds)  # gold boxes by area range
    taken = np.zeros((len(gold), len(AREAS), len(thresholds), gold.shape[1]), dtype=bool)  # all area ranges and thresholds at once
    found = []
    for k in range(preds.shape[1]):
        p = preds[:, k, None]
        over = [np.clip(np.minimum(p[..., c + 2], gold[..., c + 2]) - np.maximum(p[..., c], gold[..., c]), 0, None) for c in (0, 1)]
        iou = over[0] * over[1]
        iou = (iou / (size(p) + size(gold) - iou))[:, None, None]
        fit = (iou >= np.minimum(thresholds, 1 - 1e-10)[:, None]) & ~taken
        own, ignored = fit & ~skip, fit & skip  # an ignored gold box is taken only where no other fits
        hit, lost = own.any(axis=3), ignored.any(axis=3)
        if gold.shape[1]:
            best = np.where(np.where(hit[..., None], own, ignored), iou, -1.0).argmax(axis=3)
            at = np.nonzero(hit | lost)
            taken[(*at, best[at])] = True
        at = np.nonzero(hit | (~lost & inside[:, :, k, None]))
        found.append((*at, np.full(len(at[0]), k), hit[at]))
    return found, (~skip).sum(axis=(0, 2, 3))


def _steps(image: np.ndarray, is_gold: np.ndarray, score: np.ndarray, index: np.ndarray, boxes: np.ndarray, scale: float, most: tuple[int, ...]) -> pd.DataFrame:
    """The boxes of a batch of images, numbered from 0, as sums by (area, threshold, most, score). Images with equally many boxes are matched together, in parts of a bounded size."""
    order = np.lexsort((index, np.where(is_gold, 0.0, -score), image))
    image, is_gold, score, boxes = image[order], is_gold[order], score[order], boxes[order]
    n = np.stack([np.bincount(image[g], minlength=image[-1] + 1) for g in (is_gold, ~is_gold)], axis=1)
    start, gold, preds, score = np.cumsum(n, axis=0) - n, boxes[is_gold], boxes[~is_gold], score[~is_gold]
    hits, golds = [], np.zeros(len(AREAS), dtype=np.int64)
    for n_gold, n_preds in np.unique(n, axis=0):
        alike = np.flatnonzero((n == (n_gold, n_preds)).all(axis=1))
        part = max(1, 1_000_000 // (len(AREAS) * len(THRESHOLDS) * max(1, n_gold)))
        for some in (alike[k : k + part] for k in range(0, len(alike), part)):
            found, more = _alike(gold[start[some, 0, None] + np.arange(n_gold)], preds[start[some, 1, None] + np.arange(n_preds)], scale)
            golds += more
            hits += [(a, t, place, score[start[some[i], 1] + place], hit) for i, a, t, place, hit in found]
    a, t, place, scores, hit = (np.concatenate(x) for x in zip(*hits))
    values, at = np.unique(scores, return_inverse=True)
    areas, thresholds, out = np.array(list(AREAS), dtype=object), np.array(THRESHOLDS), []
    for m in most:
        few = place < m
        cell, inverse = np.unique((a[few] * len(thresholds) + t[few]) * max(1, len(values)) + at[few], return_inverse=True)
        curve, v = np.divmod(cell, max(1, len(values)))
        out.append(pd.DataFrame({"area": areas[curve // len(thresholds)], "threshold": thresholds[curve % len(thresholds)], "most": m, "score": values[v], "tp": np.bincount(inverse, hit[few], len(cell)).astype(np.int64), "n": np.bincount(inverse, minlength=len(cell)), "gold": 0}))
        a_, t_ = (x.ravel() for x in np.indices((len(areas), len(thresholds))))
        out.append(pd.DataFrame({"area": areas[a_], "threshold": thresholds[t_], "most": m, "score": 0.0, "tp": 0, "n": 0, "gold": golds[a_]}))
    return pd.concat(out)


def detection_steps(gold: DataFrame, pred: DataFrame, scale: float, most: tuple[int, ...]) -> DataFrame:
    """(area, threshold, most, score, tp, n, gold): sums over batches of images, predictions by score (n > 0) and gold boxes (n = 0); images without a prediction are left out. One row per image goes
    to Python, many in a batch, and a row comes back for each distinct score of a batch."""
    columns = ["gold", "score", "box_idx", "x1", "y1", "x2", "y2"]
    rows = gold.filter("image_id is not null").withColumn("gold", F.lit(True)).unionByName(pred.withColumn("gold", F.lit(False)))
    images = rows.groupBy("image_id").agg(F.collect_list(F.struct(*columns)).alias("b"), F.bool_and("gold").alias("unseen")).filter("not unseen")
    images = images.select(*[F.col(f"b.{c}").alias(c) for c in columns])

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                flat = {c: np.concatenate([np.asarray(x) for x in batch[c]]) for c in columns}
                image = np.repeat(np.arange(len(batch)), batch["gold"].map(len).to_numpy())
                boxes = np.stack([flat[c].astype(float) for c in columns[3:]], axis=-1)
                yield _steps(image, flat["gold"].astype(bool), flat["score"].astype(float), flat["box_idx"], boxes, scale, most)

    return images.mapInPandas(match, "area string, threshold double, most int, score double, tp long, n long, gold long")


def average_precision(matches: DataFrame, size: int = 10_000, most: tuple[int, ...] = (100,)) -> DataFrame:
    """(area, threshold, most, ap, recall): interpolated precision at 101 recall points. For each of `most`, at most so many predictions an image count.

    The curve has a step for each distinct score. It is made in two levels, so that no task sorts all scores: sums and maxima of cells, and the steps inside each cell. All steps are ranked by
    score and a cell is `size` ranks, so cells hold equally many steps however scores crowd.
    """
    curve_of = ["area", "threshold", "most"]
    matches = matches.withColumn("most", F.explode(F.array(*map(F.lit, most))))
    steps = matches.filter((F.col("place") >= 0) & (F.col("place") < F.col("most"))).groupBy(*curve_of, "score").agg(F.sum("tp").alias("tp"), F.count("*").alias("n"))
    return _precision(steps, matches.groupBy(*curve_of).agg(F.sum("n_gold").alias("gold")), size)


def _precision(steps: DataFrame, totals: DataFrame, size: int = 10_000) -> DataFrame:
    """average_precision() of steps(area, threshold, most, score, tp, n) and totals(area, threshold, most, gold)."""
    curve_of = ["area", "threshold", "most"]
    cell = [*curve_of, "cell"]
    steps = ranked(steps, ["score", *curve_of]).withColumn("cell", F.floor(F.col("rank") / size)).drop("rank")
    higher = W.partitionBy(*curve_of).orderBy(F.desc("cell")).rowsBetween(W.unboundedPreceding, -1)
    lower = W.partitionBy(*curve_of).orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    sums = steps.groupBy(*cell).agg(F.sum("tp").alias("ctp"), F.sum("n").alias("cn"))
    sums = sums.select(*cell, *[F.coalesce(F.sum(c).over(higher), F.lit(0)).alias(f"before_{c}") for c in ("ctp", "cn")])
    down, up = W.partitionBy(*cell).orderBy(F.desc("score")), W.partitionBy(*cell).orderBy("score")
    curve = steps.join(sums, cell).withColumn("ctp", F.col("before_ctp") + F.sum("tp").over(down)).withColumn("cn", F.col("before_cn") + F.sum("n").over(down))
    curve = curve.withColumn("precision", F.col("ctp") / F.col("cn"))
    tops = curve.groupBy(*cell).agg(F.max("precision").alias("top"))
    tops = tops.select(*cell, F.coalesce(F.max("top").over(lower), F.lit(0.0)).alias("later"))
    curve = curve.withColumn("envelope", F.max("precision").over(up)).join(tops, cell).join(totals, curve_of).filter("gold > 0 and tp > 0")
    recall, start = F.col("ctp") / F.col("gold"), F.when(F.col("ctp") == F.col("tp"), F.lit(-0.01)).otherwise((F.col("ctp") - F.col("tp")) / F.col("gold"))
    points = F.floor(recall * 100 + 1e-9) - F.floor(start * 100 + 1e-9)
    got = curve.groupBy(*curve_of).agg((F.sum(F.greatest("envelope", "later") * points) / 101).alias("ap"), F.max(recall).alias("recall"))
    return totals.filter("gold > 0").join(got, curve_of, "left").na.fill(0.0, ["ap", "recall"]).drop("gold")


def detection_summary(gold: DataFrame, pred: DataFrame, scale: float) -> DataFrame:
    """(name, value): the twelve summary numbers; 0 without predictions, -1 for an area without gold boxes."""
    found, curve_of = cut(detection_steps(gold, pred, scale, (1, 10, 100))), ["area", "threshold", "most"]
    steps = found.filter("n > 0").groupBy(*curve_of, "score").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    rows = _precision(steps, found.groupBy(*curve_of).agg(F.sum("gold").alias("gold")))
    at = lambda v, area="all", t=None, most=100: F.coalesce(F.avg(F.when((F.col("area") == area) & (F.col("most") == most) & (F.lit(True) if t is None else F.col("threshold") == t), F.col(v))), F.lit(-1.0))
    names = {"AP": at("ap"), "AP50": at("ap", t=0.5), "AP75": at("ap", t=0.75), "AP_small": at("ap", "small"), "AP_medium": at("ap", "medium"), "AP_large": at("ap", "large"),
             "AR1": at("recall", most=1), "AR10": at("recall", most=10), "AR100": at("recall"), "AR_small": at("recall", "small"), "AR_medium": at("recall", "medium"), "AR_large": at("recall", "large")}
    one = rows.agg(*[c.alias(n) for n, c in names.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("r")).select("r.*")
