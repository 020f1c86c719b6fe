"""Queries over tables and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from figweave.functions.metrics import prf, prf_sql
from figweave.operators import boxes as B
from figweave.operators import reactions as R
from figweave.operators import tables as T
from figweave.operators import text as S
from figweave.plans import fixtures as X
from figweave.plans.box_queries import _LINKS, round6
from figweave.plans.registry import query
from figweave.sources import readers as A

_ROWS = """ro AS (SELECT *, sum(CASE WHEN y1 > py THEN 0 WHEN py IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY y1 DESC, x0, text ROWS UNBOUNDED PRECEDING)::INT AS row_idx FROM (
    SELECT *, lag(y0) OVER (PARTITION BY page ORDER BY y1 DESC, x0, text) AS py, count(*) OVER (PARTITION BY page) AS n FROM lin) WHERE n > 1)"""
_CELLS = _ROWS + """, ce AS (SELECT page, row_idx, cell_idx, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, ' ' ORDER BY x0, text) AS text FROM (
    SELECT * EXCLUDE px, sum(CASE WHEN x0 < px OR px IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY page, row_idx ORDER BY x0, text ROWS UNBOUNDED PRECEDING)::INT AS cell_idx FROM (
        SELECT *, lag(x1) OVER (PARTITION BY page, row_idx ORDER BY x0, text) AS px FROM ro)) GROUP BY 1, 2, 3)"""


def tag_sql(header: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({header}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{tag}'" for tag, words in T.TAG_WORDS.items()) + " ELSE 'unknown' END"


_GRID = _CELLS + f""", co AS (SELECT page, cell_idx AS col_idx, text AS header, {tag_sql('text')} AS tag, coalesce(lag(x1) OVER w, '-infinity'::DOUBLE) AS l, coalesce(lead(x0) OVER w, 'infinity'::DOUBLE) AS r FROM ce WHERE row_idx = 0 WINDOW w AS (PARTITION BY page ORDER BY cell_idx)),
    cl AS (SELECT ce.page, row_idx, cell_idx, text, min(col_idx) AS col_idx FROM ce JOIN co USING (page) WHERE row_idx > 0 AND x0 >= l AND x1 <= r GROUP BY 1, 2, 3, 4),
    rj AS (SELECT page, row_idx, min(reason) AS reason FROM (SELECT page, row_idx, 'two cells claim a column' AS reason FROM cl GROUP BY page, row_idx, col_idx HAVING count(*) > 1
        UNION ALL SELECT page, row_idx, 'fits no column' FROM ce WHERE row_idx > 0 AND NOT EXISTS (SELECT 1 FROM cl WHERE cl.page = ce.page AND cl.row_idx = ce.row_idx AND cl.cell_idx = ce.cell_idx)) GROUP BY 1, 2),
    gr AS (SELECT b.page, b.row_idx, co.col_idx, header, tag, coalesce(cl.text, '') AS text FROM (SELECT DISTINCT page, row_idx FROM ce WHERE row_idx > 0) b JOIN co USING (page)
        LEFT JOIN cl ON cl.page = b.page AND cl.row_idx = b.row_idx AND cl.col_idx = co.col_idx WHERE (b.page, b.row_idx) NOT IN (SELECT (page, row_idx) FROM rj))"""


@query("lin", _ROWS + " SELECT page, row_idx, x0, text FROM ro")
def table_rows(spark, sf_dir):
    return T.rows_of(X.text_lines(spark, sf_dir)).select("page", "row_idx", "x0", "text")


@query("lin", _CELLS + " SELECT * FROM ce")
def table_cells(spark, sf_dir):
    return T.cells_of(T.rows_of(X.text_lines(spark, sf_dir)))


def _grid(spark, sf_dir):
    cells = T.cells_of(T.rows_of(X.text_lines(spark, sf_dir)))
    return T.align(cells)


@query("lin", _GRID + " SELECT * FROM gr")
def table_align(spark, sf_dir):
    return _grid(spark, sf_dir)[0].select("page", "row_idx", "col_idx", "header", "tag", "text")


@query("lin", _GRID + " SELECT * FROM rj")
def table_rejects(spark, sf_dir):
    """Rows that cannot be aligned, with the reason."""
    return _grid(spark, sf_dir)[1]


@query("lin", _CELLS + f" SELECT text AS header, {tag_sql('text')} AS tag, count(*) AS n FROM ce GROUP BY 1, 2")
def header_tags(spark, sf_dir):
    cells = T.cells_of(T.rows_of(X.text_lines(spark, sf_dir)))
    return cells.groupBy(F.col("text").alias("header"), T.header_tag(F.col("text")).alias("tag")).agg(F.count("*").alias("n"))


@query("lin", _CELLS + """ SELECT page, header_cells, first_cells, first_cells > 0 AND header_cells <> first_cells AS promote FROM (
    SELECT page, count(*) FILTER (WHERE row_idx = 0) AS header_cells, count(*) FILTER (WHERE row_idx = 1) AS first_cells FROM ce WHERE row_idx <= 1 GROUP BY 1)""")
def header_promotion(spark, sf_dir):
    return T.promoted(T.cells_of(T.rows_of(X.text_lines(spark, sf_dir))))


_MARKERS = "[" + ", ".join(f"'a{chr(c)}'" for c in range(65, 91)) + ", " + ", ".join(f"'a{d}'" for d in range(1, 10)) + ", 'a0']"


@query("lin", f"""tb AS (SELECT page, min(x0) AS l, min(y0) AS bottom, max(x1) AS r, max(y1) AS top FROM lin GROUP BY 1),
    bx AS (SELECT page, x0, y0, x1, y1, text FROM lin UNION ALL SELECT page, l, top + 5 + page % 40, r, top + 20 + page % 40, CASE WHEN page % 3 = 0 THEN 'Scheme 1 and Table ' ELSE 'see Scheme ' END || page FROM tb UNION ALL
        SELECT page, l, bottom - 30 - page % 25, r, bottom - 5 - page % 25, 'note a' || page % 7 || ' dry aB' || page % 2 FROM tb UNION ALL SELECT page, l - 90, top + 1, l - 10, top + 9, 'Scheme apart' FROM tb),
    w AS (SELECT bx.*, bottom, top, CASE WHEN contains(text, 'Table') THEN 'Table' WHEN contains(text, 'Scheme') THEN 'Scheme' END AS tw, list_filter({_MARKERS}, lambda m: contains(text, m))[1] AS fw FROM bx JOIN tb USING (page) WHERE x0 <= r AND x1 >= l),
    k AS (SELECT *, text[strpos(text, tw):] AS t, text[strpos(text, fw):] AS f FROM w)
    SELECT page, coalesce(arg_min(t, (abs(y0 - top), text)) FILTER (WHERE tw IS NOT NULL AND abs(y0 - top) < 30), '') AS title,
        coalesce(arg_min(f, (abs(y1 - bottom), text)) FILTER (WHERE fw IS NOT NULL AND abs(y1 - bottom) < 30 AND NOT (y0 >= bottom AND y1 <= top)), '') AS footnote FROM k GROUP BY page""")
def table_title(spark, sf_dir):
    lines = X.text_lines(spark, sf_dir)
    tables = lines.groupBy("page").agg(F.min("x0").alias("left"), F.min("y0").alias("bottom"), F.max("x1").alias("right"), F.max("y1").alias("top"))
    page = F.col("page").cast("string")
    extra = [
        ("left", F.col("top") + 5 + F.col("page") % 40, "right", F.col("top") + 20 + F.col("page") % 40, F.concat(F.when(F.col("page") % 3 == 0, F.lit("Scheme 1 and Table ")).otherwise(F.lit("see Scheme ")), page)),
        ("left", F.col("bottom") - 30 - F.col("page") % 25, "right", F.col("bottom") - 5 - F.col("page") % 25, F.concat(F.lit("note a"), (F.col("page") % 7).cast("string"), F.lit(" dry aB"), (F.col("page") % 2).cast("string"))),
        (F.col("left") - 90, F.col("top") + 1, F.col("left") - 10, F.col("top") + 9, F.lit("Scheme apart")),
    ]
    boxes = lines.select("page", "x0", "y0", "x1", "y1", "text")
    for x0, y0, x1, y1, text in extra:
        as_col = lambda v: F.col(v) if isinstance(v, str) else v
        boxes = boxes.unionByName(tables.select("page", as_col(x0).alias("x0"), y0.alias("y0"), as_col(x1).alias("x1"), y1.alias("y1"), text.alias("text")))
    return T.titles(boxes, tables)


_GROUP = "regexp_extract(text, '^(?:[A-Za-z0-9_]+-)?([A-Za-z0-9_-]+)(?: \\([A-Za-z0-9_]+\\))?$', 1)"


@query("lin", _GRID + f""", sg AS (SELECT page, row_idx, header AS name, {_GROUP} AS value FROM gr WHERE tag = 'alkyl group')
    SELECT page, row_idx, header AS name, tag, text AS value, (page, row_idx) IN (SELECT (page, row_idx) FROM sg WHERE value <> '') AS new_reaction FROM gr WHERE tag <> 'alkyl group'
    UNION ALL SELECT page, row_idx, name, 'substitution', value, true FROM sg WHERE value <> ''""")
def table_expand(spark, sf_dir):
    return T.expanded(_grid(spark, sf_dir)[0])


@query("lin atm", _GRID + f""", sg AS (SELECT page, row_idx, header AS name, {_GROUP} AS value FROM gr WHERE tag = 'alkyl group')
    SELECT page, row_idx, atom_idx, coalesce('[' || (SELECT min(value) FROM sg WHERE sg.page = n.page AND sg.row_idx = n.row_idx AND value <> '' AND symbol = '[' || name || ']') || ']', symbol) AS symbol
    FROM (SELECT DISTINCT page, row_idx FROM sg WHERE value <> '') n JOIN atm ON mol_id = page""")
def table_reactions(spark, sf_dir):
    """A new reaction for each table row that names groups: the page's molecule with the groups put in at the sites that the header names."""
    cells = T.cells_of(T.rows_of(X.text_lines(spark, sf_dir)))
    return T.row_reactions(T.expanded(T.align(cells)[0]), X.atoms(spark, sf_dir), T.columns_of(cells))


def _whole(spark, sf_dir):
    """whole_reactions() of a page whose reaction 0 has the first three atoms of the page's molecule as reactant, all of them as product, and one condition, or none for every fifth page."""
    atoms, pages = X.atoms(spark, sf_dir), X.pages(spark, sf_dir)
    molecules = pages.select("page", F.explode(F.array(F.struct(F.lit("reactants").alias("role"), (F.col("page") * 2).alias("mol_id")), F.struct(F.lit("products").alias("role"), (F.col("page") * 2 + 1).alias("mol_id")))).alias("m")).select("page", "m.role", F.lit(0).alias("k"), "m.mol_id")
    both = atoms.filter("atom_idx < 3").withColumn("mol_id", F.col("mol_id") * 2).unionByName(atoms.withColumn("mol_id", F.col("mol_id") * 2 + 1))
    told = pages.filter("page % 5 <> 0").select("page", F.lit(0).alias("k"), F.concat(F.lit("at "), (F.col("page") % 90).cast("string"), F.lit(" °C")).alias("text"))
    placed = T.placed_rows(T.cells_of(T.rows_of(X.text_lines(spark, sf_dir, dealt=True))))
    return T.reactions_of_parts(T.placed_parts(placed), molecules, told, both)


_TOLD = """wr AS (SELECT page, row_idx, string_agg(text || '/' || tag || '/' || header, ';' ORDER BY col_idx) FILTER (WHERE tag <> 'alkyl group') AS cells, bool_or(tag = 'alkyl group' AND """ + _GROUP + """ <> '') AS named FROM gr GROUP BY 1, 2),
    ow AS (SELECT DISTINCT page, CASE WHEN page % 5 <> 0 THEN 'at ' || (page % 90) || ' °C//' END AS own FROM lin)"""
_AS_TEXT = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("/", x["text"], F.coalesce(x["tag"], F.lit("")), F.coalesce(x["header"], F.lit("")))), ";")


@query("lin atm", _GRID + f""", {_TOLD}, sg AS (SELECT page, row_idx, '[' || header || ']' AS symbol, arg_max({_GROUP}, col_idx) AS value FROM gr WHERE tag = 'alkyl group' AND {_GROUP} <> '' GROUP BY 1, 2, 3),
    sy AS (SELECT wr.page, wr.row_idx, atom_idx, coalesce('[' || value || ']', atm.symbol) AS symbol FROM wr JOIN atm ON mol_id = wr.page LEFT JOIN sg ON sg.page = wr.page AND sg.row_idx = wr.row_idx AND sg.symbol = atm.symbol WHERE named),
    ml AS (SELECT page, row_idx, string_agg(symbol, ',' ORDER BY atom_idx) FILTER (WHERE atom_idx < 3) AS reactant, string_agg(symbol, ',' ORDER BY atom_idx) AS product FROM sy GROUP BY 1, 2)
    SELECT page, row_idx, reactant, product, concat_ws(';', own, cells) AS conditions FROM ml JOIN wr USING (page, row_idx) JOIN ow USING (page)""")
def table_whole_reactions(spark, sf_dir):
    """A whole reaction for each table row that names groups: all molecules with the groups put in, and all conditions."""
    side = lambda r: F.array_join(F.get(F.transform(F.filter("molecules", lambda m: m["role"] == r), lambda m: m["symbols"]), F.lit(0)), ",")
    return _whole(spark, sf_dir)[0].select("page", "row_idx", side("reactants").alias("reactant"), side("products").alias("product"), _AS_TEXT(F.col("conditions")).alias("conditions"))


@query("lin", _GRID + f""", {_TOLD} SELECT ow.page, concat_ws('|', coalesce(own, ''), string_agg(concat_ws(';', own, cells), '|' ORDER BY row_idx) FILTER (WHERE NOT named)) AS conditions FROM ow LEFT JOIN wr ON wr.page = ow.page GROUP BY ow.page, own""")
def table_first_reaction(spark, sf_dir):
    """The conditions of reaction 0: its own, and with the cells of each row that names no group."""
    return _whole(spark, sf_dir)[1].select("page", F.array_join(F.transform("conditions", lambda c: _AS_TEXT(c)), "|").alias("conditions"))


@query("lin atm", _GRID + " SELECT mol_id, atom_idx, symbol, header AS name FROM atm JOIN (SELECT DISTINCT page, header FROM co WHERE tag = 'alkyl group') ON page = mol_id AND symbol = '[' || header || ']'")
def table_sites(spark, sf_dir):
    """Atoms that a table's headers name."""
    return T.relevant_atoms(X.atoms(spark, sf_dir), T.columns_of(T.cells_of(T.rows_of(X.text_lines(spark, sf_dir)))))


@query("lin", _CELLS + f""", up AS (SELECT page, (count(*) FILTER (WHERE row_idx = 1) > 0 AND count(*) FILTER (WHERE row_idx = 0) <> count(*) FILTER (WHERE row_idx = 1))::INT AS k FROM ce GROUP BY 1)
    SELECT page, cell_idx AS col_idx, text AS header, {tag_sql('text')} AS tag FROM ce JOIN up USING (page) WHERE row_idx = k""")
def header_retag(spark, sf_dir):
    """Headers and their tags, of the first data row where that becomes the header."""
    return T.columns_of(T.promote(T.cells_of(T.rows_of(X.text_lines(spark, sf_dir))))).select("page", "col_idx", "header", "tag")


@query("lin", "SELECT page, count(*) AS n_inside FROM lin WHERE x0 > 90 AND x0 < 390 AND x1 > 90 AND x1 < 390 AND y0 > 600 AND y0 < 715 AND y1 > 600 AND y1 < 715 GROUP BY 1")
def lines_in_region(spark, sf_dir):
    """Lines strictly inside a region whose limits come in reversed order."""
    return X.text_lines(spark, sf_dir).filter(T.inside(390.0, 715.0, 90.0, 600.0)).groupBy("page").agg(F.count("*").alias("n_inside"))


_REGIONS = 5


@query("lin", f"""rg AS (SELECT page, k AS region_id, 90e0 + 60 * k + page % 7 AS x1, 715e0 - 9 * k AS y1, 310e0 + 75 * k - page % 11 AS x2, 600e0 - 30 * k AS y2 FROM (SELECT DISTINCT page FROM lin), range({_REGIONS}) t(k))
    SELECT page, region_id, count(*) AS n_inside, min(text) AS first FROM lin JOIN rg USING (page) WHERE lin.x0 > least(rg.x1, rg.x2) AND lin.x0 < greatest(rg.x1, rg.x2) AND lin.x1 > least(rg.x1, rg.x2) AND lin.x1 < greatest(rg.x1, rg.x2)
    AND lin.y0 > least(rg.y1, rg.y2) AND lin.y0 < greatest(rg.y1, rg.y2) AND lin.y1 > least(rg.y1, rg.y2) AND lin.y1 < greatest(rg.y1, rg.y2) GROUP BY 1, 2""")
def lines_in_regions(spark, sf_dir):
    """Lines strictly inside the regions of their page, from a table of regions."""
    lines = X.text_lines(spark, sf_dir)
    k = F.col("region_id")
    page = F.col("page")
    regions = lines.select("page").distinct().withColumn("region_id", F.explode(F.sequence(F.lit(0), F.lit(_REGIONS - 1)))).select(
        "page", "region_id", (90.0 + 60 * k + page % 7).alias("x1"), (715.0 - 9 * k).alias("y1"), (310.0 + 75 * k - page % 11).alias("x2"), (600.0 - 30 * k).alias("y2"))
    return T.lines_in_regions(lines, regions).groupBy("page", "region_id").agg(F.count("*").alias("n_inside"), F.min("text").alias("first"))


_SENT = r"""pa AS (SELECT doc_id, para_idx, replace(replace(para, chr(10), ' '), '- ', '-') AS flat FROM (SELECT doc_id, unnest(string_split({text}, chr(10) || chr(10))) AS para, generate_subscripts(string_split({text}, chr(10) || chr(10)), 1) AS para_idx FROM {src}) WHERE NOT contains(para, chr(12))),
    se AS (SELECT doc_id, para_idx, row_number() OVER (PARTITION BY doc_id, para_idx ORDER BY k) AS sent_idx, CASE WHEN s LIKE '%.' THEN s ELSE s || '.' END AS sentence FROM (
        SELECT doc_id, para_idx, k, trim(s, ' ') AS s FROM (SELECT doc_id, para_idx, unnest(string_split(c, chr(1))) AS s, generate_subscripts(string_split(c, chr(1)), 1) AS k FROM (
            SELECT doc_id, para_idx, regexp_replace(regexp_replace(replace(flat, ' .', ' ' || chr(2) || '.'), '([^\p{{Nd}}⁰¹²³⁴-⁹₀-₉])\.[^ ]*( |$)|(^|[\p{{Nd}}⁰¹²³⁴-⁹₀-₉])\. ', '\1\3.' || chr(1), 'g'), chr(2), '', 'g') AS c FROM pa))) WHERE s <> '')"""
_PARA = "replace(text, '.' || chr(10), '.' || chr(10) || chr(10))"


@query("", "WITH " + _SENT.format(text=_PARA, src="documents") + " SELECT doc_id, para_idx, sent_idx, sentence FROM se", plain=True)
def sentences(spark, sf_dir):
    """Lines that end with a full stop count as paragraphs here, as the documents have no blank lines."""
    docs = X.table(spark, sf_dir, "documents").withColumn("text", F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n\n")))
    return S.sentences(docs)


@query("", "WITH " + _SENT.format(text=_PARA, src="documents") + " SELECT doc_id, para_idx, sent_idx, sentence FROM se WHERE len(string_split(sentence, ' ')) >= 12", plain=True)
def sentences_with_reactions(spark, sf_dir):
    """Sentences in which something was found; here what is found is any sentence of twelve words, in place of a model's answer."""
    rows = sentences(spark, sf_dir)
    return R.of_sentences(rows, rows.filter(F.size(F.split("sentence", " ")) >= 12))


@query("raw", """SELECT ['Text', 'Title', 'List', 'Table', 'Figure'][(p % 5 + 1)::INT] AS type, count(*) AS n, sum(place)::BIGINT AS places FROM (SELECT p, row_number() OVER (PARTITION BY image_id ORDER BY box_idx) AS place FROM raw) GROUP BY 1""")
def layout_blocks(spark, sf_dir):
    """Layout blocks with their page by position, split by type."""
    kinds = ("Text", "Title", "List", "Table", "Figure")
    blocks = A.numbered(X.raw(spark, sf_dir).select("image_id", "box_idx", X.pick(kinds, F.col("p") % 5).alias("type")), "image_id", "box_idx")
    count = lambda k, df: df.agg(F.lit(k).alias("type"), F.count("*").alias("n"), F.sum("page").alias("places"))
    parts = [count(k, df) for k, df in A.split_blocks(blocks, kinds).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.filter("n > 0")


@query("raw", """f AS (SELECT image_id, box_idx, 'figure' AS kind FROM raw WHERE p % 4 = 0), t AS (SELECT image_id, box_idx, 'table' AS kind, abs(s % 200 - q * 2) > 50 AS fig FROM raw WHERE p % 4 = 3)
    SELECT 'tables' AS content, image_id, box_idx, kind FROM t UNION ALL SELECT 'figures', * FROM f UNION ALL SELECT 'figures', image_id, box_idx, kind FROM t WHERE fig UNION ALL SELECT 'all', * FROM f UNION ALL SELECT 'all', image_id, box_idx, kind FROM t""")
def content_switch(spark, sf_dir):
    """Tables, figures with the tables that hold one, or all."""
    rows = X.raw(spark, sf_dir)
    figures = rows.filter("p % 4 = 0").select("image_id", "box_idx", F.lit("figure").alias("kind"))
    tables = rows.filter("p % 4 = 3").select("image_id", "box_idx", F.lit("table").alias("kind"), (F.col("s") % 200).cast("double").alias("title_y"), (F.col("q") * 2).cast("double").alias("header_y"))
    out = None
    for name in ("tables", "figures", "all"):
        part = A.content_switch(figures, tables, None if name == "all" else name).select(F.lit(name).alias("content"), "image_id", "box_idx", "kind")
        out = part if out is None else out.unionByName(part)
    return out


_LABELS = r"""la AS (SELECT image_id, box_idx, unnest(regexp_extract_all(text, '\b(\d+[a-zA-Z]{0,2})\b', 1)) AS label, generate_subscripts(regexp_extract_all(text, '\b(\d+[a-zA-Z]{0,2})\b', 1), 1) - 1 AS ordinal FROM men)"""


@query("men", _LABELS + " SELECT image_id, box_idx, ordinal, label FROM la")
def label_extract(spark, sf_dir):
    return S.labels_in(X.mentions(spark, sf_dir))


@query("det men atm", _LINKS + ", " + _LABELS + """, mp AS (SELECT la.image_id, label, arg_max(symbol, (mol_idx, la.box_idx, ordinal)) AS smiles FROM la JOIN lk ON lk.image_id = la.image_id AND lk.idt_idx = la.box_idx JOIN atm ON mol_id = la.image_id AND atom_idx = mol_idx GROUP BY 1, 2)
    SELECT la.image_id, ['Reactants', 'Product', 'Yield'][box_idx % 3 + 1] AS role, la.label AS compound, CASE WHEN smiles IS NOT NULL AND box_idx % 3 < 2 THEN la.label || ' (' || smiles || ')' ELSE la.label END AS text FROM la LEFT JOIN mp ON mp.image_id = la.image_id AND mp.label = la.label""")
def label_join(spark, sf_dir):
    found = S.labels_in(X.mentions(spark, sf_dir))
    smiles = X.atoms(spark, sf_dir).select(F.col("mol_id").alias("image_id"), F.col("atom_idx").alias("box_idx"), F.col("symbol").alias("smiles"))
    known = S.label_map(found, B.coref_links(X.detections(spark, sf_dir)), smiles)
    return S.named(found.select("image_id", X.pick(("Reactants", "Product", "Yield"), F.col("box_idx") % 3).alias("role"), F.col("label").alias("compound")), known)


@query("raw", """t AS (SELECT image_id, box_idx % 2 AS mol_idx, (image_id % 3 + 3)::VARCHAR AS number, '[' || (image_id % 3 + 3) || ['1', '0', '5', '9', 'a', ''][ln % 6 + 1] || ']' AS text FROM raw),
    m AS (SELECT *, bool_or(regexp_matches(text, number || '[a-zA-Z]+')) OVER (PARTITION BY image_id, mol_idx, number) AS good, CASE WHEN contains(text, number || '1') THEN 'l' WHEN contains(text, number || '0') THEN 'o' WHEN contains(text, number || '5') THEN 's' WHEN contains(text, number || '9') THEN 'g' END AS g FROM t)
    SELECT image_id, mol_idx, number, text, false AS added FROM t UNION ALL SELECT image_id, mol_idx, number, number || g, true FROM m WHERE NOT good AND g IS NOT NULL""")
def label_repair(spark, sf_dir):
    number = (F.col("image_id") % 3 + 3).cast("string")
    rows = X.raw(spark, sf_dir).select("image_id", (F.col("box_idx") % 2).alias("mol_idx"), number.alias("number"),
                                       F.concat(F.lit("["), number, X.pick(("1", "0", "5", "9", "a", ""), F.col("ln") % 6), F.lit("]")).alias("text"))
    return S.repair_labels(rows)


@query("raw", r"""t AS (SELECT DISTINCT image_id, (image_id % 9 + 1) || chr((97 + s % 3)::INT) || CASE WHEN p % 3 = 0 THEN '' ELSE chr((97 + ln % 6)::INT) END AS label FROM raw)
    SELECT image_id, label, CASE WHEN count(*) OVER (PARTITION BY image_id, regexp_extract(label, '^(\d+[a-z]?)', 1)) > 1 THEN regexp_replace(label, '^(\d+)([a-z])([a-z])$', '\1\3\2\3') ELSE label END AS rewritten FROM t""")
def label_rewrite(spark, sf_dir):
    rows = X.raw(spark, sf_dir)
    label = F.concat((F.col("image_id") % 9 + 1).cast("string"), F.chr(97 + F.col("s") % 3), F.when(F.col("p") % 3 == 0, F.lit("")).otherwise(F.chr((97 + F.col("ln") % 6).cast("long"))))
    return S.rewrite_families(rows.select("image_id", label.alias("label")).distinct())


_COND = "CASE p % 5 WHEN 0 THEN q || '% yield' WHEN 1 THEN q || ' °C' WHEN 2 THEN q || ' h' WHEN 3 THEN 'in ' || ['THF', 'DMF', 'EtOH', 'air'][s % 4 + 1] ELSE q || ' mol% G' || ln || ' or G' || (ln + 2) END"


def _conditions(spark, sf_dir):
    q, ln = F.col("q").cast("string"), F.col("ln")
    text = (F.when(F.col("p") % 5 == 0, F.concat(q, F.lit("% yield"))).when(F.col("p") % 5 == 1, F.concat(q, F.lit(" °C"))).when(F.col("p") % 5 == 2, F.concat(q, F.lit(" h")))
            .when(F.col("p") % 5 == 3, F.concat(F.lit("in "), X.pick(("THF", "DMF", "EtOH", "air"), F.col("s") % 4))).otherwise(F.concat(q, F.lit(" mol% G"), ln.cast("string"), F.lit(" or G"), (ln + 2).cast("string"))))
    return X.raw(spark, sf_dir).select("image_id", "box_idx", text.alias("text"))


@query("raw", f"""t AS (SELECT image_id, box_idx, {_COND} AS text FROM raw) SELECT image_id, box_idx, text, CASE WHEN contains(text, 'yield') AND regexp_matches(text, '\\d+ ?%( yield)?$') THEN 'yield' WHEN regexp_matches(text, '°C|\\brt\\b|reflux') THEN 'temperature'
    WHEN regexp_matches(text, '\\b\\d+(\\.\\d+)? ?(h|min)\\b') THEN 'time' WHEN regexp_matches(text, '\\b({'|'.join(S.SOLVENTS)})\\b') THEN 'solvent' WHEN regexp_matches(text, '=|mol|equiv') THEN 'reagent' ELSE 'additional_info' END AS role FROM t""")
def condition_roles(spark, sf_dir):
    return _conditions(spark, sf_dir).withColumn("role", S.condition_role(F.col("text")))


@query("raw", f"SELECT image_id, box_idx, text, unnest(string_split(regexp_extract(text, '(\\S+(?: or \\S+)*)$', 1), ' or ')) AS label FROM (SELECT image_id, box_idx, {_COND} AS text FROM raw)")
def condition_alternatives(spark, sf_dir):
    return S.condition_alternatives(_conditions(spark, sf_dir))


@query("", """SELECT page_id // 10 AS doc, trim(string_agg('## = Page ' || (page_id % 10 + 1) || ' =' || chr(10) || html || chr(10), chr(10) ORDER BY page_id), ' ' || chr(10)) AS text FROM pages GROUP BY 1""", plain=True)
def page_markdown(spark, sf_dir):
    return S.page_document(X.table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text")))


@query("", "SELECT page_id // 10 AS doc, count(*) AS n_pages, sum(length(html))::BIGINT AS n_chars FROM pages WHERE page_id % 10 + 1 <= 5 GROUP BY 1", plain=True)
def page_limit(spark, sf_dir):
    """Only the first five pages of each document; the filter reaches the reader."""
    rows = X.table(spark, sf_dir, "pages").filter("page_id % 10 + 1 <= 5")
    return rows.groupBy(F.floor(F.col("page_id") / 10).alias("doc")).agg(F.count("*").alias("n_pages"), F.sum(F.length("html")).alias("n_chars"))


_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z]+'), lambda x: length(x) > 3))"


@query("", "WITH " + _SENT.format(text="text", src="documents") + f""", w AS (SELECT doc_id, para_idx, sent_idx, unnest({_TERMS.format('sentence')}) AS term FROM se), b AS (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark),
    c AS (SELECT item_id, doc_id, para_idx, sent_idx, count(*) AS shared FROM w JOIN b USING (term) GROUP BY 1, 2, 3, 4) SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id, para_idx, sent_idx) AS place FROM c QUALIFY place <= 3""", plain=True)
def related_sentences(spark, sf_dir):
    """The three sentences of all documents that share most terms with each passage."""
    rows = S.sentences(X.table(spark, sf_dir, "documents"))
    return S.related_sentences(rows, X.table(spark, sf_dir, "benchmark"))


_KIND = "regexp_extract({}, '^[BI]-(.*)$', 1)"
_SPANS = """{out} AS (SELECT doc_id, label, begin AS start, max("end") AS "end" FROM (SELECT *, sum((t LIKE 'B-%')::INT) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS span FROM (SELECT *, {tag} AS t FROM tag))
    JOIN (SELECT doc_id, span, label, start AS begin FROM (SELECT doc_id, tok_idx, start, t, sum((t LIKE 'B-%')::INT) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS span, """ + _KIND.format("t") + """ AS label FROM (SELECT *, {tag} AS t FROM tag)) WHERE t LIKE 'B-%') USING (doc_id, span)
    WHERE """ + _KIND.format("t") + """ = label GROUP BY 1, 2, 3)"""


@query("tag", _SPANS.format(out="sp", tag="tag") + " SELECT * FROM sp")
def ner_spans(spark, sf_dir):
    return S.spans(X.tags(spark, sf_dir))


def _strict_f1(tags):
    counts = S.span_hits(S.strict_spans(tags), S.strict_spans(tags, "pred"))
    micro = counts.agg(F.lit("micro").alias("label"), F.sum("gold").alias("gold"), F.sum("pred").alias("pred"), F.sum("hits").alias("hits"))
    out = counts.unionByName(micro)
    return round6(out.select("*", *prf(F.col("hits"), F.col("pred"), F.col("hits"), F.col("gold"))), "precision", "recall", "f1")


_STRICT = """{out} AS (SELECT doc_id, label, start, "end" FROM (SELECT doc_id, run, arg_min(t, tok_idx) AS t, arg_min(label, tok_idx) AS label, min(start) AS start, max("end") AS "end" FROM (
    SELECT *, sum((NOT coalesce(t LIKE 'I-%' AND """ + _KIND.format("b") + """ = label, false))::INT) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS run FROM (
        SELECT doc_id, tok_idx, start, "end", {tag} AS t, """ + _KIND.format("{tag}") + """ AS label, lag({tag}) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS b FROM tag)) GROUP BY 1, 2) WHERE t LIKE 'B-%')"""


@query("tag", _STRICT.format(out="g", tag="tag") + ", " + _STRICT.format(out="q", tag="pred") + f""", c AS (SELECT coalesce(g.label, q.label) AS label, count(g.label) AS gold, count(q.label) AS pred, count(g.label) FILTER (WHERE q.label IS NOT NULL) AS hits FROM g FULL JOIN q ON g.doc_id = q.doc_id AND g.label = q.label AND g.start = q.start AND g."end" = q."end" GROUP BY 1),
    a AS (SELECT * FROM c UNION ALL SELECT 'micro', sum(gold)::BIGINT, sum(pred)::BIGINT, sum(hits)::BIGINT FROM c) SELECT label, gold, pred, hits, {prf_sql('hits', 'pred', 'hits', 'gold')} FROM a""")
def ner_spans_strict_f1(spark, sf_dir):
    """On whole texts."""
    return _strict_f1(X.tags(spark, sf_dir))


#: Tokens that a model of a fixed window sees.
WINDOW = 128
_SHORT = f"short AS (SELECT * FROM tag WHERE tok_idx < {WINDOW}), "


@query("tag", _SHORT + _STRICT.format(out="g", tag="tag").replace("FROM tag)", "FROM short)") + ", " + _STRICT.format(out="q", tag="pred").replace("FROM tag)", "FROM short)") + f""", c AS (SELECT coalesce(g.label, q.label) AS label, count(g.label) AS gold, count(q.label) AS pred, count(g.label) FILTER (WHERE q.label IS NOT NULL) AS hits FROM g FULL JOIN q ON g.doc_id = q.doc_id AND g.label = q.label AND g.start = q.start AND g."end" = q."end" GROUP BY 1),
    a AS (SELECT * FROM c UNION ALL SELECT 'micro', sum(gold)::BIGINT, sum(pred)::BIGINT, sum(hits)::BIGINT FROM c) SELECT label, gold, pred, hits, {prf_sql('hits', 'pred', 'hits', 'gold')} FROM a""")
def ner_spans_truncated_f1(spark, sf_dir):
    """On what fits a model's window; spans end where it does. The window is the feature."""
    return _strict_f1(X.tags(spark, sf_dir).filter(F.col("tok_idx") < WINDOW))


@query("tag", _STRICT.format(out="g", tag="tag") + """, gc AS (SELECT doc_id, label, start, "end", unnest(range(start // 64, ("end" - 1) // 64 + 1)) AS cell FROM g), tc AS (SELECT doc_id, tok_idx, start, start // 64 AS cell FROM tag),
    h AS (SELECT doc_id, tok_idx, arg_max({'s': gc.start, 'label': label}, gc.start) AS b FROM tc JOIN gc USING (doc_id, cell) WHERE gc.start <= tc.start AND tc.start < "end" GROUP BY 1, 2)
    SELECT t.doc_id, t.tok_idx, CASE WHEN b IS NULL THEN 'O' WHEN (b).s = t.start THEN 'B-' || (b).label ELSE 'I-' || (b).label END AS tag FROM tag t LEFT JOIN h USING (doc_id, tok_idx)""")
def ner_align(spark, sf_dir):
    tags = X.tags(spark, sf_dir)
    return S.align_spans(tags.select("doc_id", "tok_idx", "start"), S.strict_spans(tags))


@query("tag", """r AS (SELECT *, sum(o) OVER (PARTITION BY doc_id ORDER BY tok_idx) AS run FROM (SELECT doc_id, tok_idx, label, replace(replace(replace(token, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS token, coalesce(label <> lag(label) OVER (PARTITION BY doc_id ORDER BY tok_idx), true)::INT AS o FROM (
        SELECT *, regexp_replace(tag, '^[BI]-', '') AS label FROM tag))), u AS (SELECT doc_id, run, min(label) AS label, string_agg(token, ' ' ORDER BY tok_idx) AS body FROM r GROUP BY 1, 2)
    SELECT doc_id, string_agg(CASE WHEN label = 'O' THEN body ELSE '<u class="' || label || '">' || body || '</u>' END, ' ' ORDER BY run) AS html FROM u GROUP BY 1""")
def tagged_html(spark, sf_dir):
    return S.html_runs(X.tags(spark, sf_dir))
