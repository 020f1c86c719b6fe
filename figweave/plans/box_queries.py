"""Queries over boxes, coreference and reactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from figweave.functions.metrics import prf, prf_sql
from figweave.operators import boxes as B
from figweave.operators import reactions as R
from figweave.plans import fixtures as X
from figweave.plans.registry import query

IOU = """CASE WHEN least(a.x2, b.x2) - greatest(a.x1, b.x1) < 0 OR least(a.y2, b.y2) - greatest(a.y1, b.y1) < 0 THEN 0e0 ELSE
    ((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
    - ((least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)))) END"""


def pairs_sql(left: str, right: str) -> str:
    return f"""SELECT a.image_id, a.box_idx AS i, b.box_idx AS j, a.category_id AS ci, b.category_id AS cj, {IOU} AS iou FROM {left} a JOIN {right} b ON a.image_id = b.image_id
        AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2"""


def best_sql(side: str, pairs: str = "pr", threshold: str = "5e-1") -> str:
    other = "j" if side == "i" else "i"
    return f"""SELECT image_id, {side}, {other} AS match, iou FROM (SELECT *, row_number() OVER (PARTITION BY image_id, {side} ORDER BY iou DESC, {other}) AS k FROM {pairs}) WHERE k = 1 AND iou >= {threshold}"""


def round6(df, *names):
    return df.withColumns({c: F.round(F.col(c), 6) for c in names})


@query("det pred", f"""pr AS (SELECT * FROM ({pairs_sql('det', 'pred')}) WHERE ci = cj), gi AS ({best_sql('i')}), gj AS ({best_sql('j')}),
    g AS (SELECT category_id, count(*) AS gold, count(match) AS gold_hits FROM det LEFT JOIN gi ON det.image_id = gi.image_id AND box_idx = i GROUP BY 1),
    p AS (SELECT category_id, count(*) AS pred, count(match) AS pred_hits FROM pred LEFT JOIN gj ON pred.image_id = gj.image_id AND box_idx = j GROUP BY 1)
    SELECT category_id, gold, gold_hits, pred, pred_hits, {prf_sql('pred_hits', 'pred', 'gold_hits', 'gold')} FROM g JOIN p USING (category_id)""")
def box_match_f1(spark, sf_dir):
    """Flagship: predicted against gold boxes of the same category at IoU 0.5."""
    gold, pred = X.detections(spark, sf_dir), X.predictions(spark, sf_dir)
    pairs = B.overlaps(gold, pred).filter("ci = cj")
    n = lambda df, side, c: B.with_match(df, B.best_match(pairs, side), side).groupBy("category_id").agg(
        F.count("*").alias(c), F.count_if(F.col("match") >= 0).alias(f"{c}_hits"))
    out = n(gold, "i", "gold").join(n(pred, "j", "pred"), "category_id")
    return round6(out.select("*", *prf(F.col("pred_hits"), F.col("pred"), F.col("gold_hits"), F.col("gold"))), "precision", "recall", "f1")


@query("det pred", f"SELECT image_id, i, j, round(iou, 6) AS iou FROM ({pairs_sql('det', 'pred')})")
def iou_pairs(spark, sf_dir):
    return round6(B.overlaps(X.detections(spark, sf_dir), X.predictions(spark, sf_dir)).select("image_id", "i", "j", "iou"), "iou")


@query("det pred", f"SELECT image_id, i, j, round(iou, 6) AS iou FROM ({pairs_sql('det', 'pred')})")
def iou_pairs_grid(spark, sf_dir):
    """The same with a grid cell in the join key, for images with very many boxes."""
    return round6(B.overlaps(X.detections(spark, sf_dir), X.predictions(spark, sf_dir), grid=3).select("image_id", "i", "j", "iou"), "iou")


_FULL = "full AS (SELECT * FROM det WHERE x2 - x1 > 1e-2 AND y2 - y1 > 1e-2)"


@query("det", f"{_FULL.replace('full', 'fl')}, pr AS ({pairs_sql('fl', 'fl')}) SELECT image_id, box_idx, category_id FROM fl WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.image_id = fl.image_id AND i = box_idx AND j < i AND iou > 9e-1)")
def box_dedup_any(spark, sf_dir):
    return B.dedup_any(X.detections(spark, sf_dir)).select("image_id", "box_idx", "category_id")


@query("det", f"""o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE box_idx % 3 WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END, box_idx) AS ord FROM det WHERE x2 - x1 > 1e-2 AND y2 - y1 > 1e-2),
    pr AS ({pairs_sql('o', 'o')}), bad AS (SELECT pr.image_id, x.ord, list(y.ord) AS earlier FROM pr JOIN o x ON x.image_id = pr.image_id AND x.box_idx = i JOIN o y ON y.image_id = pr.image_id AND y.box_idx = j WHERE y.ord < x.ord AND iou > 6e-1 GROUP BY 1, 2),
    q AS (SELECT o.image_id, o.ord, coalesce(earlier, []) AS earlier FROM o LEFT JOIN bad USING (image_id, ord)),
    r(image_id, ord, kept) AS (SELECT DISTINCT image_id, 0::BIGINT, []::BIGINT[] FROM q UNION ALL
        SELECT r.image_id, q.ord, CASE WHEN list_has_any(r.kept, q.earlier) THEN r.kept ELSE list_append(r.kept, q.ord) END FROM r JOIN q ON q.image_id = r.image_id AND q.ord = r.ord + 1),
    last AS (SELECT image_id, arg_max(kept, ord) AS kept FROM r GROUP BY 1)
    SELECT o.image_id, o.box_idx, o.ord FROM o JOIN last USING (image_id) WHERE list_contains(kept, o.ord)""", recursive=True)
def box_dedup_greedy(spark, sf_dir):
    from pyspark.sql import Window as W

    rank = F.when(F.col("box_idx") % 3 == 0, 0).when(F.col("box_idx") % 3 == 2, 1).otherwise(2)
    boxes = X.detections(spark, sf_dir).withColumn("ord", F.row_number().over(W.partitionBy("image_id").orderBy(rank, "box_idx")).cast("long"))
    return B.dedup_greedy(boxes).select("image_id", "box_idx", "ord")


_ROLE_RANK = "CASE role WHEN 'reactants' THEN 0 WHEN 'products' THEN 1 ELSE 2 END"


@query("det", f"""rx AS (SELECT *, box_idx // 6 AS rxn_idx, ['reactants', 'conditions', 'products'][box_idx % 3 + 1] AS role FROM det),
    o AS (SELECT *, row_number() OVER (PARTITION BY image_id, rxn_idx ORDER BY {_ROLE_RANK}, box_idx) AS ord FROM rx WHERE x2 - x1 > 1e-2 AND y2 - y1 > 1e-2),
    q AS (SELECT o.image_id, o.rxn_idx, row_number() OVER (PARTITION BY o.image_id, o.rxn_idx ORDER BY o.ord) AS n, o.ord, (SELECT coalesce(list(b.ord), []) FROM o b JOIN o a ON a.image_id = b.image_id AND a.rxn_idx = b.rxn_idx
        WHERE a.image_id = o.image_id AND a.rxn_idx = o.rxn_idx AND a.ord = o.ord AND b.ord < a.ord AND {IOU} > 6e-1) AS earlier FROM o),
    r(image_id, rxn_idx, n, kept) AS (SELECT DISTINCT image_id, rxn_idx, 0::BIGINT, []::BIGINT[] FROM q UNION ALL
        SELECT r.image_id, r.rxn_idx, q.n, CASE WHEN list_has_any(r.kept, q.earlier) THEN r.kept ELSE list_append(r.kept, q.ord) END FROM r JOIN q ON q.image_id = r.image_id AND q.rxn_idx = r.rxn_idx AND q.n = r.n + 1),
    last AS (SELECT image_id, rxn_idx, arg_max(kept, n) AS kept FROM r GROUP BY 1, 2)
    SELECT o.image_id, o.rxn_idx, role, o.box_idx FROM o JOIN last USING (image_id, rxn_idx) WHERE list_contains(kept, o.ord)""", recursive=True)
def reaction_box_dedup(spark, sf_dir):
    """Boxes de-duplicated inside each reaction, six boxes in order here, and not across reactions."""
    boxes = X.detections(spark, sf_dir)
    rows = X.reactions(boxes).withColumn("rxn_idx", F.floor(F.col("box_idx") / 6).cast("int"))
    return R.dedup_boxes(rows, boxes)


@query("det", """g AS (SELECT *, (sum((category_id IN (1, 2))::INT) OVER w) AS grp FROM det WINDOW w AS (PARTITION BY image_id ORDER BY box_idx)),
    h AS (SELECT *, first_value(floor(y1 * 1e3 / 500)) OVER v AS hb, first_value(x1) OVER v AS hx, first_value(box_idx) OVER v AS hi FROM g WINDOW v AS (PARTITION BY image_id, grp ORDER BY box_idx))
    SELECT image_id, box_idx, row_number() OVER (PARTITION BY image_id ORDER BY hb, hx, hi, box_idx) - 1 AS place FROM h""")
def box_reading_groups(spark, sf_dir):
    """Reading order where a molecule moves with its identifiers."""
    return B.reading_order_groups(X.detections(spark, sf_dir)).select("image_id", "box_idx", "place")


_MOVED = ["s_x1", "s_y2", "p_x1", "p_y2", "d_x1", "d_y1", "d_x2", "d_y2"]


@query("det", """s AS (SELECT image_id, box_idx, x1, x2, y1, y2, 600 + image_id % 300 AS w, 400 + image_id % 500 AS h FROM det), f AS (SELECT *, least(800e0 / least(w, h), 1000e0 / greatest(w, h)) AS f FROM s)
    SELECT image_id, box_idx, round(x1 * w * (floor(w * f) / w), 6) AS s_x1, round(y2 * h * (floor(h * f) / h), 6) AS s_y2, round(x1 * (w / (w + 50)::DOUBLE), 6) AS p_x1, round(y2 * (h / (h + 20)::DOUBLE), 6) AS p_y2,
        round(x1 * w * 72e0 / 200e0, 6) AS d_x1, round(792e0 - y2 * h * 72e0 / 200e0, 6) AS d_y1, round(x2 * w * 72e0 / 200e0, 6) AS d_x2, round(792e0 - y1 * h * 72e0 / 200e0, 6) AS d_y2 FROM f""")
def box_resize_pad_pdf(spark, sf_dir):
    """Boxes of images of many sizes: resized to a short side of 800 and at most 1,000, padded, and as points of a page."""
    w, h = F.lit(600) + F.col("image_id") % 300, F.lit(400) + F.col("image_id") % 500
    boxes = X.detections(spark, sf_dir).withColumn("w", w).withColumn("h", h)
    pixels = boxes.withColumns({c: F.col(c) * F.col("w" if c[0] == "x" else "h") for c in B.CORNERS})
    take = lambda df, k, cs: df.select("image_id", "box_idx", *[F.col(c).alias(f"{k}_{c}") for c in cs])
    parts = [take(B.resize_scaled(pixels, F.col("w"), F.col("h"), 800, 1000), "s", ("x1", "y2")), take(B.padded(boxes, F.col("w"), F.col("h"), 50, 20), "p", ("x1", "y2")), take(B.pdf_points(pixels, 792.0), "d", B.CORNERS)]
    return round6(parts[0].join(parts[1], ["image_id", "box_idx"]).join(parts[2], ["image_id", "box_idx"]), *_MOVED)


_GEO = ["px_x1", "px_y1", "px_x2", "px_y2", "w", "h", "cx", "cy", "flip_x1", "flip_x2", "rot_x1", "rot_y1", "rot_x2", "rot_y2", "crop_area"]


@query("det", """g AS (SELECT *, x1 * 640 AS px_x1, y1 * 480 AS px_y1, x2 * 640 AS px_x2, y2 * 480 AS px_y2, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy,
    640 - x2 * 640 AS flip_x1, 640 - x1 * 640 AS flip_x2, y1 * 480 AS rot_x1, 640 - x2 * 640 AS rot_y1, y2 * 480 AS rot_x2, 640 - x1 * 640 AS rot_y2,
    (greatest(least(x2 * 640, 640) - 160, 0) - greatest(least(x1 * 640, 640) - 160, 0)) * (greatest(least(y2 * 480, 480) - 120, 0) - greatest(least(y1 * 480, 480) - 120, 0)) AS crop_area FROM det)
    SELECT image_id, box_idx, """ + ", ".join(f"round({c}, 6) AS {c}" for c in _GEO) + """,
    greatest(floor(x1 * 640), 0)::INT AS cut_x1, greatest(floor(y1 * 480), 0)::INT AS cut_y1, least(floor(x2 * 640), 640)::INT AS cut_x2, least(floor(y2 * 480), 480)::INT AS cut_y2, trunc(x1 * 640)::INT AS raw_x1, trunc(y1 * 480)::INT AS raw_y1, trunc(x2 * 640)::INT AS raw_x2, trunc(y2 * 480)::INT AS raw_y2 FROM g""")
def box_geometry(spark, sf_dir):
    return round6(B.transforms(X.detections(spark, sf_dir), 640.0, 480.0), *_GEO)


@query("det", "q AS (SELECT image_id, box_idx, " + ", ".join(f"CASE WHEN {c} < -1e-3 OR {c} > 1001e-3 THEN -1 ELSE round_even(least(greatest({c}, 0e0), 1e0) * 1999, 0)::INT END AS {c}" for c in B.CORNERS)
       + " FROM det) SELECT *, round(x1 / 1999e0, 6) AS back_x1 FROM q")
def box_quantise(spark, sf_dir):
    out = X.detections(spark, sf_dir).select("image_id", "box_idx", *[B.quantise(F.col(c)).alias(c) for c in B.CORNERS])
    return out.withColumn("back_x1", F.round(B.restore(F.col("x1")), 6))


@query("det", "SELECT image_id, box_idx, row_number() OVER (PARTITION BY image_id ORDER BY floor(y1 * 1e3 / 500), x1, box_idx) - 1 AS place FROM det")
def box_reading_order(spark, sf_dir):
    return B.reading_order(X.detections(spark, sf_dir)).select("image_id", "box_idx", "place")


@query("pred", "SELECT category_id, count(*) AS n, count(*) FILTER (WHERE x2 - x1 <= 165e-3 OR y2 - y1 <= 1e-2) AS n_empty, count(*) FILTER (WHERE x1 < x2 AND y1 < y2 AND category_id BETWEEN 1 AND 4) AS n_valid FROM pred GROUP BY 1")
def empty_boxes(spark, sf_dir):
    """With a limit of 0.165 in x, so that some boxes are empty; y has the usual one."""
    thin = (F.col("x2") - F.col("x1") <= 0.165) | B.is_empty()
    return X.predictions(spark, sf_dir).groupBy("category_id").agg(F.count("*").alias("n"), F.count_if(thin).alias("n_empty"), F.count_if(B.is_valid()).alias("n_valid"))


_LINKS = """lk AS (SELECT image_id, (a).box_idx AS mol_idx, box_idx AS idt_idx FROM (SELECT *, last_value(CASE WHEN category_id <> 3 THEN {'box_idx': box_idx, 'category_id': category_id} END IGNORE NULLS)
    OVER (PARTITION BY image_id ORDER BY box_idx) AS a FROM det) WHERE category_id = 3 AND (a).category_id IN (1, 2))"""


@query("det", f"{_LINKS} SELECT * FROM lk")
def coref_links(spark, sf_dir):
    return B.coref_links(X.detections(spark, sf_dir))


def _with_smiles(spark, sf_dir):
    symbols = X.atoms(spark, sf_dir).select(F.col("mol_id").alias("image_id"), F.col("atom_idx").alias("box_idx"), F.col("symbol").alias("smiles"))
    return X.detections(spark, sf_dir).join(symbols, ["image_id", "box_idx"])


@query("det men atm", f"""{_LINKS}, t AS (SELECT lk.image_id, mol_idx, string_agg(text, '|' ORDER BY idt_idx) AS texts FROM lk JOIN men ON men.image_id = lk.image_id AND men.box_idx = idt_idx GROUP BY 1, 2)
    SELECT det.image_id, det.box_idx AS mol_idx, symbol AS smiles, coalesce(texts, 'no label') AS texts FROM det JOIN atm ON mol_id = image_id AND atom_idx = box_idx
    LEFT JOIN t ON t.image_id = det.image_id AND t.mol_idx = det.box_idx WHERE category_id IN (1, 2)""")
def coref_resolve(spark, sf_dir):
    boxes = _with_smiles(spark, sf_dir)
    out = B.coref_resolve(boxes, B.coref_links(boxes), X.mentions(spark, sf_dir), "no label")
    return out.withColumn("texts", F.array_join("texts", "|"))


@query("det pred", f"""{_LINKS}, pr AS (SELECT * FROM ({pairs_sql('det', 'pred')}) WHERE iou > 0), bm AS ({best_sql('i', threshold='0e0')}),
    sq AS (SELECT *, row_number() OVER w - 1 AS place, sum((category_id <> 3)::INT) OVER w AS others FROM pred WINDOW w AS (PARTITION BY image_id ORDER BY box_idx)),
    f AS (SELECT bm.image_id, i, place, others, others - (category_id <> 3)::INT AS before FROM bm JOIN sq ON sq.image_id = bm.image_id AND sq.box_idx = match),
    r AS (SELECT m.place AS m, coalesce(m.place, -1) AS mp, coalesce(t.place, -1) AS tp, coalesce(m.others, 0) AS mo, t.before AS tb FROM lk LEFT JOIN f m ON m.image_id = lk.image_id AND m.i = mol_idx LEFT JOIN f t ON t.image_id = lk.image_id AND t.i = idt_idx),
    c AS (SELECT true AS strict, count(*) AS pairs, count(*) FILTER (WHERE mp < tp AND tb - mo = 0 AND m IS NOT NULL) AS hits FROM r UNION ALL SELECT false, count(*), count(*) FILTER (WHERE mp < tp AND tb - mo = 0) FROM r),
    d AS (SELECT *, (SELECT count(*) FROM pred WHERE category_id = 3) AS predicted FROM c) SELECT *, {prf_sql('hits', 'predicted', 'hits', 'pairs')} FROM d""")
def coref_score(spark, sf_dir):
    gold, pred = X.detections(spark, sf_dir), X.predictions(spark, sf_dir)
    links = B.coref_links(gold)
    rows = B.coref_score(gold, links, pred, True).withColumn("strict", F.lit(True)).unionByName(B.coref_score(gold, links, pred, False).withColumn("strict", F.lit(False)))
    return round6(rows.select("*", *prf(F.col("hits"), F.col("predicted"), F.col("hits"), F.col("pairs"))), "precision", "recall", "f1")


@query("det atm", """f AS (SELECT det.*, symbol AS smiles, row_number() OVER (PARTITION BY symbol, image_id ORDER BY box_idx) AS k FROM det JOIN atm ON mol_id = image_id AND atom_idx = box_idx)
    SELECT smiles, image_id, box_idx, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM f WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY smiles ORDER BY image_id DESC) = 1""")
def smiles_detail(spark, sf_dir):
    return round6(B.detail_lookup(_with_smiles(spark, sf_dir)), *B.CORNERS)


@query("raw atm", """b AS (SELECT image_id, box_idx, list_transform(range(q % 3 + 1), lambda k: symbol || k) AS symbols FROM raw JOIN atm ON mol_id = image_id AND atom_idx = box_idx),
    f AS (SELECT image_id, box_idx, list_transform(range(CASE WHEN p % 3 = 0 THEN 1 ELSE q % 3 + 1 END), lambda k: 'U' || k) AS symbols FROM raw WHERE NOT (image_id % 5 = 0 AND box_idx = 0)),
    s AS (SELECT image_id FROM (SELECT image_id, count(*) AS n FROM b GROUP BY 1) x JOIN (SELECT image_id, count(*) AS n FROM f GROUP BY 1) y USING (image_id, n))
    SELECT b.image_id, b.box_idx, array_to_string(CASE WHEN s.image_id IS NOT NULL AND len(f.symbols) = len(b.symbols) THEN f.symbols ELSE b.symbols END, ',') AS symbols
    FROM b LEFT JOIN s USING (image_id) LEFT JOIN f ON f.image_id = b.image_id AND f.box_idx = b.box_idx""")
def symbol_update_pos(spark, sf_dir):
    rows = X.raw(spark, sf_dir)
    many = lambda n, head: F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda k: F.concat(head, k.cast("string")))
    own = rows.select("image_id", "box_idx", many(F.col("q") % 3 + 1, X.pick(X.SYMBOLS, F.col("p") % 12)).alias("symbols"))
    fixed = rows.filter("not (image_id % 5 = 0 and box_idx = 0)").select("image_id", "box_idx", many(F.when(F.col("p") % 3 == 0, 1).otherwise(F.col("q") % 3 + 1), F.lit("U")).alias("symbols"))
    return B.update_by_place(own, fixed).withColumn("symbols", F.array_join("symbols", ","))


_KEY = "||','||".join(f"floor({c} * 1000 + 5e-1)::BIGINT" for c in B.CORNERS)


@query("det pred atm rxn", f"""n AS (SELECT image_id, {_KEY} AS k, arg_max('U' || box_idx, box_idx) AS new FROM pred GROUP BY 1, 2)
    SELECT d.image_id, d.box_idx, coalesce(new, symbol) AS symbol FROM (SELECT *, {_KEY} AS k FROM det) d JOIN atm ON mol_id = d.image_id AND atom_idx = d.box_idx
    JOIN rxn ON rxn.image_id = d.image_id AND rxn.box_idx = d.box_idx AND role <> 'conditions' LEFT JOIN n ON n.image_id = d.image_id AND n.k = d.k""")
def symbol_update_key(spark, sf_dir):
    boxes = _with_smiles(spark, sf_dir).withColumnRenamed("smiles", "symbol").filter("box_idx % 3 <> 1")
    fixed = X.predictions(spark, sf_dir).withColumn("symbol", F.concat(F.lit("U"), F.col("box_idx").cast("string")))
    return B.update_by_key(boxes, fixed)


_EQUAL = f"""pr AS ({pairs_sql('det', 'pred')}), gi AS ({best_sql('i')}),
    lk AS (SELECT g.image_id, g.rxn_idx, list_sort(list(CASE WHEN {{pool}} AND role = 'conditions' THEN 'reactants' ELSE role END || ':' || lpad(match::VARCHAR, 6, '0'))) AS key, count(*) - count(match) AS open
        FROM rxn g LEFT JOIN gi ON gi.image_id = g.image_id AND gi.i = g.box_idx GROUP BY 1, 2),
    rk AS (SELECT image_id, rxn_idx, list_sort(list(CASE WHEN {{pool}} AND role = 'conditions' THEN 'reactants' ELSE role END || ':' || lpad(box_idx::VARCHAR, 6, '0'))) AS key FROM prxn GROUP BY 1, 2),
    eq AS (SELECT lk.image_id, lk.rxn_idx AS gold_rxn, rk.rxn_idx AS pred_rxn FROM lk JOIN rk ON lk.image_id = rk.image_id AND lk.key = rk.key WHERE open = 0),
    ht AS (SELECT image_id, coalesce(gold, 0) AS gold, coalesce(pred, 0) AS pred, coalesce(gold_hits, 0) AS gold_hits, coalesce(pred_hits, 0) AS pred_hits FROM
        (SELECT image_id, count(DISTINCT rxn_idx) AS gold FROM rxn GROUP BY 1) FULL JOIN (SELECT image_id, count(DISTINCT rxn_idx) AS pred FROM prxn GROUP BY 1) USING (image_id)
        LEFT JOIN (SELECT image_id, count(DISTINCT gold_rxn) AS gold_hits, count(DISTINCT pred_rxn) AS pred_hits FROM eq GROUP BY 1) USING (image_id))"""


def _sets(spark, sf_dir):
    gold, pred = X.detections(spark, sf_dir), X.predictions(spark, sf_dir)
    return X.reactions(gold), X.reactions(pred), B.best_match(B.overlaps(gold, pred), "i")


@query("det pred rxn prxn", _EQUAL.format(pool="false") + " SELECT * FROM eq")
def reaction_equal(spark, sf_dir):
    return R.equal_pairs(*_sets(spark, sf_dir))


@query("det pred rxn prxn", _EQUAL.format(pool="true") + " SELECT * FROM eq")
def reaction_equal_pooled(spark, sf_dir):
    """Reactants and conditions count as one role."""
    return R.equal_pairs(*_sets(spark, sf_dir), pooled=True)


_MOL = """mr AS (SELECT {t}.image_id, rxn_idx, role, {t}.box_idx, category_id, count(*) FILTER (WHERE category_id = 1) OVER (PARTITION BY {t}.image_id, rxn_idx, role) AS n FROM {t} JOIN {b} ON {b}.image_id = {t}.image_id AND {b}.box_idx = {t}.box_idx)
    SELECT image_id, rxn_idx, role, box_idx FROM mr WHERE category_id = 1 OR (n = 0 AND role <> 'conditions')"""
_EQUAL_MOL = "mg AS (WITH " + _MOL.format(t="rxn", b="det") + "), mp AS (WITH " + _MOL.format(t="prxn", b="pred") + "), " + _EQUAL.format(pool="false").replace("FROM rxn g", "FROM mg g").replace("FROM prxn GROUP BY 1, 2)", "FROM mp GROUP BY 1, 2)")


def _hits_mol_only(spark, sf_dir):
    gold, pred, match = _sets(spark, sf_dir)
    boxes = X.detections(spark, sf_dir), X.predictions(spark, sf_dir)
    pairs = R.equal_pairs(R.mol_only(gold, boxes[0]), R.mol_only(pred, boxes[1]), match)
    return pairs, R.hits(gold, pred, pairs)


@query("det pred rxn prxn", _EQUAL_MOL + " SELECT * FROM eq")
def reaction_equal_mol_only(spark, sf_dir):
    """Only molecule boxes count, where a side has any."""
    return _hits_mol_only(spark, sf_dir)[0]


def _hits(spark, sf_dir):
    gold, pred, match = _sets(spark, sf_dir)
    return R.hits(gold, pred, R.equal_pairs(gold, pred, match))


def _sums():
    return [F.sum(c).alias(c) for c in ("gold", "pred", "gold_hits", "pred_hits")]


def _scored(df, *keys):
    out = df.select(*keys, "n_images", "gold", "pred", "gold_hits", "pred_hits", *prf(F.col("pred_hits"), F.col("pred"), F.col("gold_hits"), F.col("gold")))
    return round6(out, "precision", "recall", "f1")


_SCORED = f"SELECT {{keys}}, n_images, gold, pred, gold_hits, pred_hits, {prf_sql('pred_hits', 'pred', 'gold_hits', 'gold')} FROM (SELECT {{keys}}, count(*) AS n_images, sum(gold)::BIGINT AS gold, sum(pred)::BIGINT AS pred, sum(gold_hits)::BIGINT AS gold_hits, sum(pred_hits)::BIGINT AS pred_hits FROM {{src}} GROUP BY {{group}})"


@query("det pred rxn prxn", _EQUAL.format(pool="false") + " " + _SCORED.format(keys="kind", src="(SELECT *, 'all' AS kind FROM ht)", group="kind"))
def reaction_score(spark, sf_dir):
    return _scored(_hits(spark, sf_dir).groupBy(F.lit("all").alias("kind")).agg(F.count("*").alias("n_images"), *_sums()), "kind")


@query("det pred rxn prxn", _EQUAL_MOL + " " + _SCORED.format(keys="kind", src="(SELECT *, 'molecules' AS kind FROM ht)", group="kind"))
def reaction_score_mol_only(spark, sf_dir):
    return _scored(_hits_mol_only(spark, sf_dir)[1].groupBy(F.lit("molecules").alias("kind")).agg(F.count("*").alias("n_images"), *_sums()), "kind")


@query("det pred rxn prxn", _EQUAL.format(pool="false") + " " + _SCORED.format(keys="size", src="(SELECT *, gold AS size FROM ht)", group="size"))
def reaction_score_by_size(spark, sf_dir):
    """By the number of gold reactions of an image."""
    return _scored(_hits(spark, sf_dir).withColumn("size", F.col("gold")).groupBy("size").agg(F.count("*").alias("n_images"), *_sums()), "size")


@query("det pred rxn prxn", _EQUAL.format(pool="false") + " " + _SCORED.format(keys="kind", src="(SELECT ht.*, CASE WHEN n <= 3 THEN 'single' WHEN n <= 6 THEN 'multiple' ELSE 'tree' END AS kind FROM ht JOIN (SELECT image_id, count(*) AS n FROM det GROUP BY 1) USING (image_id))", group="kind"))
def reaction_score_by_group(spark, sf_dir):
    """By diagram type, here a bucket of the number of boxes."""
    sizes = X.detections(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("n"))
    kind = F.when(F.col("n") <= 3, "single").when(F.col("n") <= 6, "multiple").otherwise("tree")
    return _scored(_hits(spark, sf_dir).join(sizes, "image_id").withColumn("kind", kind).groupBy("kind").agg(F.count("*").alias("n_images"), *_sums()), "kind")


@query("det pred rxn prxn", _EQUAL.format(pool="false") + " " + _SCORED.format(keys="size", src="(SELECT *, gold AS size FROM ht)", group="ROLLUP (size)"))
def reaction_score_rollup(spark, sf_dir):
    """Overall (null) and by size in one pass."""
    return _scored(_hits(spark, sf_dir).withColumn("size", F.col("gold")).rollup("size").agg(F.count("*").alias("n_images"), *_sums()), "size")


@query("rxn", "SELECT DISTINCT image_id, rxn_idx, (dense_rank() OVER (PARTITION BY image_id ORDER BY rxn_idx) - 1) || '_1' AS reaction_id FROM rxn")
def reaction_ids(spark, sf_dir):
    return R.with_ids(X.reactions(X.detections(spark, sf_dir)))


@query("rxn", "SELECT image_id, rxn_idx, " + ", ".join(f"count(*) FILTER (WHERE role = '{r}') AS n_{r}" for r in R.ROLES) + " FROM rxn WHERE (image_id, rxn_idx) IN (SELECT (image_id, rxn_idx) FROM rxn GROUP BY image_id, rxn_idx HAVING count(*) FILTER (WHERE role = 'reactants') > 0 AND count(*) FILTER (WHERE role = 'products') > 0) GROUP BY 1, 2")
def reaction_valid(spark, sf_dir):
    """Role counts of reactions that have a reactant and a product."""
    return R.role_counts(R.valid(X.reactions(X.detections(spark, sf_dir))))


@query("det rxn", """j AS (SELECT rxn.*, category_id, count(*) FILTER (WHERE category_id = 1) OVER (PARTITION BY rxn.image_id, rxn_idx, role) AS n FROM rxn JOIN det USING (image_id, box_idx))
    SELECT image_id, rxn_idx, role, box_idx FROM j WHERE category_id = 1 OR (n = 0 AND role <> 'conditions')""")
def reaction_mol_only(spark, sf_dir):
    boxes = X.detections(spark, sf_dir)
    return R.mol_only(X.reactions(boxes), boxes).select("image_id", "rxn_idx", "role", "box_idx")


@query("pred prxn", f"""pr AS ({pairs_sql('pred', 'pred')}), gi AS ({best_sql('i')}), lk AS (SELECT g.image_id, g.rxn_idx, list_sort(list(role || ':' || lpad(match::VARCHAR, 6, '0'))) AS key, count(*) - count(match) AS open FROM prxn g LEFT JOIN gi ON gi.image_id = g.image_id AND gi.i = g.box_idx GROUP BY 1, 2),
    rk AS (SELECT image_id, rxn_idx, list_sort(list(role || ':' || lpad(box_idx::VARCHAR, 6, '0'))) AS key FROM prxn GROUP BY 1, 2),
    ok AS (SELECT image_id, rxn_idx, row_number() OVER (PARTITION BY image_id ORDER BY rxn_idx) AS n FROM prxn GROUP BY image_id, rxn_idx HAVING bool_or(role = 'reactants') AND bool_or(role = 'products')),
    eq AS (SELECT lk.image_id, lk.rxn_idx, list(rk.rxn_idx) AS earlier FROM lk JOIN rk ON lk.image_id = rk.image_id AND lk.key = rk.key WHERE open = 0 AND rk.rxn_idx < lk.rxn_idx GROUP BY 1, 2),
    q AS (SELECT ok.*, coalesce(earlier, []) AS earlier FROM ok LEFT JOIN eq USING (image_id, rxn_idx)),
    r(image_id, n, kept) AS (SELECT DISTINCT image_id, 0::BIGINT, []::INT[] FROM q UNION ALL
        SELECT r.image_id, q.n, CASE WHEN list_has_any(r.kept, q.earlier) THEN r.kept ELSE list_append(r.kept, q.rxn_idx) END FROM r JOIN q ON q.image_id = r.image_id AND q.n = r.n + 1),
    last AS (SELECT image_id, arg_max(kept, n) AS kept FROM r GROUP BY 1)
    SELECT image_id, rxn_idx, role, box_idx FROM prxn JOIN last USING (image_id) WHERE list_contains(kept, rxn_idx)""", recursive=True)
def reaction_dedup(spark, sf_dir):
    """Reactions of the predictions without repeats of an earlier one that stayed."""
    boxes = X.predictions(spark, sf_dir)
    rows = X.reactions(boxes)
    same = R.equal_pairs(rows, rows, B.best_match(B.overlaps(boxes, boxes), "i"))
    return R.dedup(rows, same).select("image_id", "rxn_idx", "role", "box_idx")


@query("det", """n AS (SELECT image_id, count(*) AS n FROM det GROUP BY 1), f AS (SELECT a.image_id, a.image_id // 2 AS pair_id, a.image_id % 2 AS second, CASE WHEN a.image_id % 2 = 1 THEN coalesce(b.n, 0) ELSE 0 END AS o FROM n a LEFT JOIN n b ON b.image_id = a.image_id - 1)
    SELECT pair_id, box_idx + o AS box_idx, category_id, round(x1 + second, 6) AS x1, round(x2 + second, 6) AS x2, second || ':' || box_idx // 3 AS rxn FROM det JOIN f USING (image_id)""")
def union_rebase(spark, sf_dir):
    boxes = X.detections(spark, sf_dir)
    moved, linked = R.rebased_union(boxes, X.reactions(boxes))
    rows = moved.join(linked, ["pair_id", "box_idx"])
    return round6(rows.select("pair_id", "box_idx", "category_id", "x1", "x2", F.concat(F.col("second").cast("string"), F.lit(":"), F.col("rxn_idx").cast("string")).alias("rxn")), "x1", "x2")
