"""Queries over answers, label variants and serialised links."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figweave.functions.chemistry import FRAGMENTS
from figweave.operators import boxes as B
from figweave.operators import inference as J
from figweave.operators import molecules as G
from figweave.operators import reactions as R
from figweave.operators import text as S
from figweave.plans import fixtures as X
from figweave.plans.box_queries import _LINKS
from figweave.plans.mol_queries import _ASSIGN, sql_values
from figweave.plans.registry import query


def _smiles(spark, sf_dir):
    return X.atoms(spark, sf_dir).select(F.col("mol_id").alias("image_id"), F.col("atom_idx").alias("box_idx"), F.col("symbol").alias("smiles"))


@query("rxn atm men", """j AS (SELECT rxn.*, CASE WHEN role = 'conditions' THEN coalesce(text, '') ELSE symbol END AS v FROM rxn JOIN atm ON mol_id = rxn.image_id AND atom_idx = rxn.box_idx LEFT JOIN men ON men.image_id = rxn.image_id AND men.box_idx = rxn.box_idx)
    SELECT image_id, rxn_idx, """ + ", ".join(f"coalesce(string_agg(v, '|' ORDER BY box_idx) FILTER (WHERE role = '{r}'), '') AS {r}" for r in R.ROLES) + " FROM j GROUP BY 1, 2")
def reaction_answers(spark, sf_dir):
    return R.answers(X.reactions(X.detections(spark, sf_dir)), _smiles(spark, sf_dir), X.mentions(spark, sf_dir))


@query("det rxn", """f AS (SELECT rxn.*, category_id = 2 AS flat FROM rxn JOIN det USING (image_id, box_idx)), w AS (SELECT *, coalesce(bool_and(flat) FILTER (WHERE role = 'reactants') OVER s, false) AS r, coalesce(bool_and(flat) FILTER (WHERE role = 'products') OVER s, false) AS p FROM f WINDOW s AS (PARTITION BY image_id, rxn_idx))
    SELECT image_id, rxn_idx, role, box_idx FROM w WHERE NOT flat AND NOT r AND NOT p""")
def reaction_flat_boxes(spark, sf_dir):
    """Boxes of category 2 are made flat here, so that there are boxes without area."""
    boxes = X.detections(spark, sf_dir)
    flat = boxes.withColumn("x2", F.when(F.col("category_id") == 2, F.col("x1")).otherwise(F.col("x2")))
    return R.drop_flat(X.reactions(boxes), flat).select("image_id", "rxn_idx", "role", "box_idx")


@query("det", _LINKS + """, s AS (SELECT image_id, box_idx AS m, -1 AS k, box_idx FROM det WHERE category_id IN (1, 2) UNION ALL SELECT image_id, mol_idx, idt_idx, idt_idx FROM lk)
    SELECT image_id, string_agg(box_idx::VARCHAR, ',' ORDER BY m, k) AS sequence FROM s GROUP BY 1""")
def coref_sequence(spark, sf_dir):
    boxes = X.detections(spark, sf_dir)
    return B.coref_sequence(boxes, B.coref_links(boxes))


@query("men", r"""f AS (SELECT image_id, regexp_extract(arg_min(text, box_idx), '(\d+)', 1) AS number FROM men WHERE box_idx % 3 = 2 GROUP BY 1), l AS (SELECT image_id, box_idx, unnest(regexp_extract_all(text, '\b(\d+[a-zA-Z]+)\b', 1)) AS label FROM men)
    SELECT image_id, number, label, min(box_idx) AS box_idx FROM l JOIN f USING (image_id) WHERE number <> '' AND regexp_extract(label, '^(\d+)', 1) = number GROUP BY 1, 2, 3""")
def product_labels(spark, sf_dir):
    texts = X.mentions(spark, sf_dir)
    return S.product_variants(texts, texts.filter("box_idx % 3 = 2").select("image_id", "box_idx"))


@query("men", _ASSIGN + f" SELECT image_id, rxn_idx, name, value, coalesce(known, 'unknown') AS smiles FROM asg LEFT JOIN (VALUES {sql_values([(k, v) for k, v in FRAGMENTS.items() if k != 'Bn'])}) v(k, known) ON k = value")
def library_lookup(spark, sf_dir):
    """Group names looked up in a library of known molecules (one is taken out, so that there are unknown ones)."""
    rows = G.assignments(X.mentions(spark, sf_dir))
    return S.library_lookup(rows, {k: v for k, v in FRAGMENTS.items() if k != "Bn"}, "unknown").select("image_id", "rxn_idx", "name", "value", "smiles")


@query("men", """k AS (SELECT image_id, split_part(text, ',', 1) AS label, max(box_idx) AS box_idx FROM men GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY label) AS place FROM k""")
def sorted_labels(spark, sf_dir):
    """Reactions by label: the last entry of a label is kept, then they are put in order."""
    last = X.mentions(spark, sf_dir).groupBy("image_id", F.substring_index("text", ",", 1).alias("label")).agg(F.max("box_idx").alias("box_idx"))
    return last.withColumn("place", F.row_number().over(W.partitionBy("image_id").orderBy("label")))


@query("atm", "SELECT mol_id, atom_idx, upper(reverse(symbol)) AS converted FROM atm")
def converted_symbols(spark, sf_dir):
    """A conversion function that the caller passes in, on whole batches."""
    out = J.converted(X.atoms(spark, sf_dir), lambda s: s.str[::-1].str.upper(), "symbol", "converted")
    return out.select("mol_id", "atom_idx", "converted")


@query("lin", "SELECT 'line' AS kind, page, count(*) AS n FROM lin GROUP BY page UNION ALL SELECT 'figure', image_id, count(*) FROM raw WHERE p % 4 = 0 GROUP BY image_id")
def content_union(spark, sf_dir):
    """Tables and figures of each page in one frame."""
    lines = X.text_lines(spark, sf_dir).groupBy("page").agg(F.count("*").alias("n")).withColumn("kind", F.lit("line"))
    figures = X.detections(spark, sf_dir).filter("category_id = 1").groupBy(F.col("image_id").alias("page")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("figure"))
    return lines.unionByName(figures, allowMissingColumns=True).select("kind", "page", "n")
