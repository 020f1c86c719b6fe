"""Boxes of detected objects: overlap, matching, de-duplication, geometry, order and coreference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CORNERS = ("x1", "y1", "x2", "y2")


def is_empty(limit: float = 0.01) -> Column:
    """Width or height at most `limit`."""
    return (F.col("x2") - F.col("x1") <= limit) | (F.col("y2") - F.col("y1") <= limit)


def is_valid() -> Column:
    """Corners in order and a known category."""
    return (F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")) & F.col("category_id").between(1, 4)


def iou(a: str, b: str) -> Column:
    """Intersection over union of the boxes in columns <a>x1.. and <b>x1..; 0 when disjoint."""
    c = lambda side, k: F.col(f"{side}{k}")
    wide = F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1"))
    high = F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1"))
    area = lambda s: (c(s, "x2") - c(s, "x1")) * (c(s, "y2") - c(s, "y1"))
    both = wide * high
    return F.when((wide < 0) | (high < 0), 0.0).otherwise(both / (area(a) + area(b) - both))


def overlaps(left: DataFrame, right: DataFrame, grid: int | None = None, within: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """(image_id, i, j, ci, cj, iou) for each left box i and right box j of one image (or of one group `within`) that touch.

    grid: splits an image into grid x grid cells that are part of the join key, for images with very many boxes; a pair counts in
    the cell of its intersection's upper left corner only.
    """
    side = lambda df, k: df.select(
        *within, F.col("box_idx").alias("i" if k == "a" else "j"), F.col("category_id").alias("ci" if k == "a" else "cj"), *[F.col(c).alias(k + c) for c in CORNERS])
    a, b, keys = side(left, "a"), side(right, "b"), [*within]
    touch = (F.col("ax1") <= F.col("bx2")) & (F.col("bx1") <= F.col("ax2")) & (F.col("ay1") <= F.col("by2")) & (F.col("by1") <= F.col("ay2"))
    if grid:
        cell = lambda v: F.floor(v * grid).cast("int")
        spread = lambda df, k: df.withColumn("gx", F.explode(F.sequence(cell(F.col(f"{k}x1")), cell(F.col(f"{k}x2"))))).withColumn(
            "gy", F.explode(F.sequence(cell(F.col(f"{k}y1")), cell(F.col(f"{k}y2")))))
        a, b, keys = spread(a, "a"), spread(b, "b"), [*within, "gx", "gy"]
        touch = touch & (F.col("gx") == cell(F.greatest("ax1", "bx1"))) & (F.col("gy") == cell(F.greatest("ay1", "by1")))
    return a.join(b, keys).filter(touch).select(*within, "i", "j", "ci", "cj", iou("a", "b").alias("iou"))


def best_match(pairs: DataFrame, side: str, threshold: float = 0.5) -> DataFrame:
    """(image_id, side, match, iou): for each box of `side` (i or j) its best partner with at least `threshold`, ties to the lowest index."""
    other = "j" if side == "i" else "i"
    place = F.row_number().over(W.partitionBy("image_id", side).orderBy(F.desc("iou"), other))
    return pairs.withColumn("place", place).filter((F.col("place") == 1) & (F.col("iou") >= threshold)).select("image_id", side, F.col(other).alias("match"), "iou")


def with_match(boxes: DataFrame, found: DataFrame, side: str) -> DataFrame:
    """boxes with `match`, -1 where there is none."""
    return boxes.join(found.select("image_id", F.col(side).alias("box_idx"), "match"), ["image_id", "box_idx"], "left").withColumn("match", F.coalesce("match", F.lit(-1)))


def dedup_any(boxes: DataFrame, limit: float = 0.9) -> DataFrame:
    """boxes without empty ones and without those whose IoU with any earlier box, kept or not, is above `limit`."""
    full = boxes.filter(~is_empty())
    late = overlaps(full, full).filter((F.col("j") < F.col("i")) & (F.col("iou") > limit)).select("image_id", F.col("i").alias("box_idx")).distinct()
    return full.join(late, ["image_id", "box_idx"], "left_anti")


def greedy_keep(items: DataFrame, conflicts: DataFrame, group: list[str], order: str) -> DataFrame:
    """Rows of items(group, order) that stay when each, in order, is dropped if it conflicts with an earlier one that stayed.

    conflicts(group, order, earlier). Order-dependent, so a fold over the ordered group; items without conflicts skip it.
    """
    per = conflicts.groupBy(*group, order).agg(F.collect_set("earlier").alias("earlier"))
    involved = per.select(*group, order).unionByName(conflicts.select(*group, F.col("earlier").alias(order))).distinct()
    rows = involved.join(per, [*group, order], "left").withColumn("earlier", F.coalesce("earlier", F.array().cast(conflicts.select(F.array("earlier")).schema[0].dataType)))
    folded = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(order, "earlier"))).alias("all"))
    start = F.filter(F.transform("all", lambda x: x[order]), lambda x: F.lit(False))
    kept = F.aggregate("all", start, lambda kept, x: F.when(F.arrays_overlap(kept, x["earlier"]), kept).otherwise(F.array_append(kept, x[order])))
    dropped = folded.select(*group, F.explode(F.array_except(F.transform("all", lambda x: x[order]), kept)).alias(order))
    return items.join(dropped, [*group, order], "left_anti")


def dedup_greedy(ordered: DataFrame, limit: float = 0.6, within: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """ordered(image_id, box_idx, category_id, corners, ord) without empty boxes and without those above `limit` with an earlier kept box of the same group `within`."""
    full = ordered.filter(~is_empty())
    places = full.withColumn("box_idx", F.col("ord"))
    pairs = overlaps(places, places, within=within).filter((F.col("iou") > limit) & (F.col("j") < F.col("i")))
    return greedy_keep(full, pairs.select(*within, F.col("i").alias("ord"), F.col("j").alias("earlier")), [*within], "ord")


def transforms(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Boxes in 0..1 as pixels, as xywh, as center and size, flipped, rotated by 90 degrees, cropped to the lower right three quarters, and as a crop rectangle in whole pixels, clamped to the image
    (cut_) and not (raw_: cut off toward zero, as a slice takes it)."""
    c = {k: F.col(k) for k in CORNERS}
    crop = lambda v, size: F.greatest(F.least(v * size, F.lit(size)) - size / 4, F.lit(0.0))
    return boxes.select(
        "image_id", "box_idx", *[(c[k] * (width if k[0] == "x" else height)).alias(f"px_{k}") for k in CORNERS],
        (c["x2"] - c["x1"]).alias("w"), (c["y2"] - c["y1"]).alias("h"), ((c["x1"] + c["x2"]) / 2).alias("cx"), ((c["y1"] + c["y2"]) / 2).alias("cy"),
        (width - c["x2"] * width).alias("flip_x1"), (width - c["x1"] * width).alias("flip_x2"),
        (c["y1"] * height).alias("rot_x1"), (width - c["x2"] * width).alias("rot_y1"), (c["y2"] * height).alias("rot_x2"), (width - c["x1"] * width).alias("rot_y2"),
        ((crop(c["x2"], width) - crop(c["x1"], width)) * (crop(c["y2"], height) - crop(c["y1"], height))).alias("crop_area"),
        *[F.greatest(F.floor(c[k] * (width if k[0] == "x" else height)), F.lit(0)).cast("int").alias(f"cut_{k}") for k in ("x1", "y1")],
        *[F.least(F.floor(c[k] * (width if k[0] == "x" else height)), F.lit(int(width if k[0] == "x" else height))).cast("int").alias(f"cut_{k}") for k in ("x2", "y2")],
        *[(c[k] * (width if k[0] == "x" else height)).cast("int").alias(f"raw_{k}") for k in CORNERS])


def resized(width: Column, height: Column, short: int, long: int) -> Column:
    """Factor that brings the short side to `short` unless the long side would pass `long`."""
    low, high = F.least(width, height), F.greatest(width, height)
    return F.least(F.lit(float(short)) / low, F.lit(float(long)) / high)


def resize_scaled(boxes: DataFrame, width: Column, height: Column, short: int, long: int) -> DataFrame:
    """Pixel boxes of an image of width x height, scaled by how far each side goes when it is resized; sides become whole pixels, so the two ratios may differ a little."""
    factor = resized(width, height, short, long)
    rx, ry = F.floor(width * factor) / width, F.floor(height * factor) / height
    return boxes.withColumns({c: F.col(c) * (rx if c[0] == "x" else ry) for c in CORNERS}).withColumns({"ratio_x": rx, "ratio_y": ry})


def padded(boxes: DataFrame, width: Column, height: Column, right: int, bottom: int) -> DataFrame:
    """Boxes in 0..1 on an image that gets `right` and `bottom` more pixels at those sides: pixels stay, shares shrink."""
    return boxes.withColumns({c: F.col(c) * (width / (width + right) if c[0] == "x" else height / (height + bottom)) for c in CORNERS})


def pdf_points(boxes: DataFrame, page_height: float, image_dpi: float = 200.0, pdf_dpi: float = 72.0) -> DataFrame:
    """Pixel boxes of a page image as points of the page, whose y runs upward: the lower edge comes first."""
    by = pdf_dpi / image_dpi
    return boxes.withColumns({"x1": F.col("x1") * by, "x2": F.col("x2") * by, "y1": page_height - F.col("y2") * by, "y2": page_height - F.col("y1") * by})


def quantise(value: Column, bins: int = 2000) -> Column:
    """Coordinate 0..1 to a bin, half to even; within 0.001 outside it is clamped, farther out it is -1."""
    inside = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    return F.when((value < -0.001) | (value > 1.001), -1).otherwise(F.rint(inside * (bins - 1)).cast("int"))


def restore(bin_: Column, bins: int = 2000) -> Column:
    return bin_ / F.lit(float(bins - 1))


def reading_order(boxes: DataFrame, scale: float = 1000.0, band: float = 500.0) -> DataFrame:
    """boxes with `place`: bands of `band` in y1, then x1, then index."""
    order = W.partitionBy("image_id").orderBy(F.floor(F.col("y1") * scale / band), "x1", "box_idx")
    return boxes.withColumn("place", F.row_number().over(order) - 1)


def reading_order_groups(boxes: DataFrame, scale: float = 1000.0, band: float = 500.0) -> DataFrame:
    """boxes with `place`, where a molecule or text box moves with the boxes behind it, up to the next one, as a group: groups by band and x1 of their first box, then boxes by index. Boxes
    before the first such box are a group of their own."""
    order = W.partitionBy("image_id").orderBy("box_idx")
    opens = F.col("category_id").isin(1, 2) | (F.row_number().over(order) == 1)
    head = F.last(F.when(opens, F.struct(F.floor(F.col("y1") * scale / band).alias("band"), "x1", "box_idx")), ignorenulls=True).over(order)
    rows = boxes.withColumn("head", head)
    return rows.withColumn("place", F.row_number().over(W.partitionBy("image_id").orderBy("head", "box_idx")) - 1).drop("head")


def coref_links(boxes: DataFrame) -> DataFrame:
    """(image_id, mol_idx, idt_idx): each run of category-3 boxes right after a category 1 or 2 box links to it; a 4 breaks the run."""
    order = W.partitionBy("image_id").orderBy("box_idx")
    anchor = F.last(F.when(F.col("category_id") != 3, F.struct("box_idx", "category_id")), ignorenulls=True).over(order)
    rows = boxes.withColumn("anchor", anchor).filter("category_id = 3 and anchor.category_id in (1, 2)")
    return rows.select("image_id", F.col("anchor.box_idx").alias("mol_idx"), F.col("box_idx").alias("idt_idx"))


def coref_resolve(boxes: DataFrame, links: DataFrame, texts: DataFrame, fallback: str) -> DataFrame:
    """(image_id, mol_idx, smiles, texts): texts of linked identifiers in link order; a molecule without one gets the fallback."""
    linked = links.join(texts.select("image_id", F.col("box_idx").alias("idt_idx"), "text"), ["image_id", "idt_idx"])
    found = linked.groupBy("image_id", "mol_idx").agg(F.sort_array(F.collect_list(F.struct("idt_idx", "text"))).alias("t"))
    mols = boxes.filter("category_id in (1, 2)").select("image_id", F.col("box_idx").alias("mol_idx"), "smiles")
    return mols.join(found, ["image_id", "mol_idx"], "left").select("image_id", "mol_idx", "smiles", F.coalesce(F.transform("t", lambda x: x["text"]), F.array(F.lit(fallback))).alias("texts"))


def coref_score(gold: DataFrame, links: DataFrame, pred: DataFrame, strict: bool = True) -> DataFrame:
    """(pairs, hits, predicted): a gold pair is a hit when its boxes' best predicted places are in order and only category-3 boxes lie between.

    strict: the molecule must have a match at all.
    """
    order = W.partitionBy("image_id").orderBy("box_idx")
    seq = pred.withColumn("place", F.row_number().over(order) - 1).withColumn("others", F.sum((F.col("category_id") != 3).cast("int")).over(order))
    found = best_match(overlaps(gold, pred).filter("iou > 0"), "i", 0.0)
    found = found.join(seq.select("image_id", F.col("box_idx").alias("match"), "place", "others", (F.col("others") - (F.col("category_id") != 3).cast("int")).alias("before")), ["image_id", "match"])
    mol = found.select("image_id", F.col("i").alias("mol_idx"), F.col("place").alias("m"), F.col("others").alias("mo"))
    idt = found.select("image_id", F.col("i").alias("idt_idx"), F.col("place").alias("t"), F.col("before").alias("tb"))
    rows = links.join(mol, ["image_id", "mol_idx"], "left").join(idt, ["image_id", "idt_idx"], "left")
    hit = (F.coalesce("m", F.lit(-1)) < F.coalesce("t", F.lit(-1))) & (F.col("tb") - F.coalesce("mo", F.lit(0)) == 0)
    hit = hit & F.col("m").isNotNull() if strict else hit
    counts = rows.agg(F.count("*").alias("pairs"), F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"))
    return counts.crossJoin(pred.agg(F.count_if(F.col("category_id") == 3).alias("predicted")))


def detail_lookup(boxes: DataFrame) -> DataFrame:
    """Per smiles: the first box in the last figure that has it."""
    first = F.row_number().over(W.partitionBy("smiles", "image_id").orderBy("box_idx")) == 1
    rows = boxes.withColumn("first", first).filter("first")
    return rows.groupBy("smiles").agg(F.max_by(F.struct("image_id", "box_idx", *CORNERS), "image_id").alias("d")).select("smiles", "d.*")


def update_by_place(boxes: DataFrame, fixed: DataFrame) -> DataFrame:
    """boxes(image_id, box_idx, symbols) with the symbols of `fixed` where both have as many boxes in the image and as many symbols."""
    n = lambda df, c: df.groupBy("image_id").agg(F.count("*").alias(c))
    same = n(boxes, "a").join(n(fixed, "b"), "image_id").filter("a = b").select("image_id")
    new = fixed.join(same, "image_id", "left_semi").select("image_id", "box_idx", F.col("symbols").alias("new"))
    return boxes.join(new, ["image_id", "box_idx"], "left").select("image_id", "box_idx", F.when(F.size("new") == F.size("symbols"), F.col("new")).otherwise(F.col("symbols")).alias("symbols"))


def corner_key() -> Column:
    """The four corners, three decimals, as text."""
    return F.concat_ws(",", *[F.floor(F.col(c) * 1000 + 0.5).cast("string") for c in CORNERS])


def update_by_key(boxes: DataFrame, fixed: DataFrame) -> DataFrame:
    """boxes with the symbol of the last box in `fixed` that has the same corners."""
    last = fixed.groupBy("image_id", corner_key().alias("k")).agg(F.max_by("symbol", "box_idx").alias("new"))
    return boxes.withColumn("k", corner_key()).join(last, ["image_id", "k"], "left").select("image_id", "box_idx", F.coalesce("new", "symbol").alias("symbol"))


def coref_sequence(boxes: DataFrame, links: DataFrame) -> DataFrame:
    """(image_id, sequence): each molecule followed by its identifiers, as box numbers; text boxes and unpaired identifiers drop out."""
    mols = boxes.filter("category_id in (1, 2)").select("image_id", F.col("box_idx").alias("mol_idx"), F.lit(-1).alias("k"), "box_idx")
    idts = links.select("image_id", "mol_idx", F.col("idt_idx").alias("k"), F.col("idt_idx").alias("box_idx"))
    rows = mols.unionByName(idts)
    return rows.groupBy("image_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("mol_idx", "k", "box_idx"))), lambda x: x["box_idx"].cast("string")), ",").alias("sequence"))
