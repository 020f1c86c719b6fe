"""Hand-made rows for the edge rules."""

import pytest
from pyspark.sql import functions as F

from figweave.functions import chemistry as C
from figweave.functions.metrics import prf
from figweave.functions.ordering import ranked
from figweave.operators import backout as K
from figweave.operators import boxes as B
from figweave.operators import graphs
from figweave.operators import inference as J
from figweave.operators import metrics as M
from figweave.operators import molecules as G
from figweave.operators import reactions as R
from figweave.operators import search as S
from figweave.operators import sequences as Q
from figweave.operators import tables as T
from figweave.operators import text as X

BOX = "image_id long, box_idx int, category_id int, x1 double, y1 double, x2 double, y2 double"


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("text, expected", [
    ("Add 3.5 g. Then stir.", ["Add 3.5 g.", "Then stir."]),
    ("See Fig.1 now. End", ["See Fig.", "now.", "End."]),
    ("at pH 7. Cool", ["at pH 7.", "Cool."]),
    ("a well- known base\nhere.", ["a well-known base here."]),
    ("no stop ", ["no stop."]),
])
def test_sentences(spark, text, expected):
    out = X.sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("para_idx", "sent_idx").collect()
    assert [r.sentence for r in out] == expected


def test_header_tags(spark):
    want = {"entry": "counter", "Entry": "unknown", "R1": "alkyl group", "yield (%)": "result", "Time (h)": "temperature", "time (h)": "time", "Temp (°C)": "temperature", "solvent": "substance",
            "Solvent": "unknown", "catalyst": "catalyst", "Reactant": "alkyl group", "reactant": "reactant", "ee (%)": "measurement", "dr": "unknown"}
    out = spark.createDataFrame([(h,) for h in want], "h string").select("h", T.header_tag(F.col("h")).alias("t")).collect()
    assert {r.h: r.t for r in out} == want


def test_group_pattern(spark):
    rows = [("Ph", "Ph"), ("4-MeC6H4", "MeC6H4"), ("n-Bu (3a)", "Bu"), ("2,4-Cl2C6H3", ""), ("Ph, 2 h", "")]
    out = spark.createDataFrame(rows, "t string, w string").select(F.regexp_extract("t", T.GROUP, 1).alias("g"), "w").collect()
    assert all(r.g == r.w for r in out)


def test_first_equation_of_a_text(spark):
    out = G.assignments(spark.createDataFrame([(1, 0, "R1 = Me, R2 = Et"), (1, 1, "Ar = Ph")], "image_id long, box_idx int, text string"))
    assert values(out, "name", "value") == [("R1", "Me")]


def test_labels_include_yields(spark):
    out = X.labels_in(spark.createDataFrame([(1, 0, "1a (23% yield), 12abc")], "image_id long, box_idx int, text string"))
    assert values(out, "label") == [("1a",), ("23",)]


def test_coref_links(spark):
    boxes = spark.createDataFrame([(1, i, c, 0.0, 0.0, 1.0, 1.0) for i, c in enumerate([1, 3, 3, 4, 3, 2, 3])], BOX)
    assert values(B.coref_links(boxes), "mol_idx", "idt_idx") == [(0, 1), (0, 2), (5, 6)]


def test_spans_lenient_and_strict(spark):
    tags = spark.createDataFrame([(1, 0, "B-MOL", 0, 3), (1, 1, "O", 4, 6), (1, 2, "I-MOL", 7, 9), (1, 3, "B-TIME", 10, 12), (1, 4, "I-MOL", 13, 15)], "doc_id long, tok_idx int, tag string, start long, end long")
    assert values(X.spans(tags), "label", "start", "end") == [("MOL", 0, 9), ("TIME", 10, 12)]
    assert values(X.strict_spans(tags), "label", "start", "end") == [("MOL", 0, 3), ("TIME", 10, 12)]


def test_greedy_and_plain_dedup_differ(spark):
    rows = [(1, i, 1, x, 0.0, x + 1.0, 1.0) for i, x in enumerate([0.0, 0.2, 0.4])]
    boxes = spark.createDataFrame(rows, BOX)
    assert values(B.dedup_greedy(boxes.withColumn("ord", F.col("box_idx").cast("long")), 0.6), "box_idx") == [(0,), (2,)]
    assert values(B.dedup_any(boxes, 0.6), "box_idx") == [(0,)]


def test_label_repair(spark):
    rows = [(1, 0, "3", "[31]"), (1, 1, "3", "[3a]"), (1, 2, "3", "[30, 35]"), (1, 2, "3", "[35]")]
    out = X.repair_labels(spark.createDataFrame(rows, "image_id long, mol_idx int, number string, text string")).filter("added")
    assert values(out, "mol_idx", "text") == [(0, "3l"), (2, "3o"), (2, "3s")]


def test_label_rewrite(spark):
    out = spark.createDataFrame([("3ab",), ("3ac",), ("3a",)], "l string").select(X.rewrite_label(F.col("l")).alias("r")).collect()
    assert [r.r for r in out] == ["3bab", "3cac", "3a"]


def test_quantise_half_to_even(spark):
    r = spark.range(1).select(B.quantise(F.lit(0.5)).alias("a"), B.quantise(F.lit(0.25)).alias("b"), B.quantise(F.lit(1.0005)).alias("c"), B.quantise(F.lit(1.2)).alias("d")).first()
    assert tuple(r) == (1000, 500, 1999, -1)


def test_subsets(spark):
    out, rejects = G.site_subsets(spark.createDataFrame([(1, 3), (2, 4)], "mol_id long, n long"), 3)
    assert [r.members for r in out.orderBy("place").collect()] == ["", "2", "1", "0", "2,1", "2,0", "1,0", "2,1,0"]
    assert [tuple(r) for r in rejects.collect()] == [(2, 4, "more than 3 sites")]


def test_prf_of_nothing(spark):
    zero = F.lit(0)
    assert tuple(spark.range(1).select(*prf(zero, zero, zero, zero)).first()) == (0.0, 0.0, 0.0)


def test_rolling(spark):
    rows = spark.createDataFrame([("a", i, float(i)) for i in (1, 2, 3, 4)], "k string, ts int, v double")
    r = M.rolling(rows, "k", ["ts"], "v", 20).orderBy(F.desc("ts")).first()
    assert (r["median"], r["mean"], r["max"], r["last"]) == (2.0, 2.5, 4.0, 4.0)


def test_wedge_bonds_reverse(spark):
    atoms = spark.createDataFrame([(1, 0, "C"), (1, 1, "C")], "mol_id long, atom_idx int, symbol string")
    bonds = spark.createDataFrame([(1, 0, 1, 5), (1, 1, 2, 1)], "mol_id long, src int, dst int, order int")
    assert values(G.edges_of(atoms, bonds), "a", "b", "order") == [(0, 1, 5), (1, 0, 6)]


def test_backout_reads_groups(spark):
    atoms = spark.createDataFrame([(1, 0, "O"), (1, 1, "C"), (1, 2, "N"), (1, 3, "S"), (2, 0, "C"), (2, 1, "F")], "mol_id long, atom_idx int, symbol string")
    bonds = spark.createDataFrame([(1, 0, 1, 1), (1, 1, 2, 1), (1, 2, 3, 1), (2, 0, 1, 1)], "mol_id long, src int, dst int, order int")
    drawn = spark.createDataFrame([(0, 0, "C"), (0, 1, "[R1]"), (0, 2, "[R2]")], "mol_id long, atom_idx int, symbol string")
    tied = spark.createDataFrame([(0, 0, 1, 1), (0, 0, 2, 1)], "mol_id long, src int, dst int, order int")
    tpls, _ = K.templates(graphs.packed(drawn, G.edges_of(drawn, tied)))
    variants = spark.createDataFrame([(0, 1, "a", None, None), (0, 2, "b", None, None)], "tpl_id long, mol_id long, label string, name string, value string")
    out = K.group_texts(K.read_groups(tpls, graphs.packed(atoms, G.edges_of(atoms, bonds)), variants))
    assert values(out, "mol_id", "site", "group") == [(1, "[1*]", "O"), (1, "[2*]", "NS"), (2, "[1*]", "F"), (2, "[2*]", "H")]


def test_reaction_dedup_keeps_the_first(spark):
    rows = spark.createDataFrame([(1, r, role, b) for r in (0, 1) for role, b in (("reactants", 0), ("products", 1))] + [(1, 2, "reactants", 0)], "image_id long, rxn_idx int, role string, box_idx int")
    same = R.equal_pairs(rows, rows, spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "image_id long, i int, match int"))
    assert values(R.dedup(rows, same).select("rxn_idx").distinct(), "rxn_idx") == [(0,)]


def test_symmetric_scores_swap_wedges(spark):
    rows = [(1, 0, 1, 5, 0.8), (1, 0, 1, 6, 0.1), (1, 1, 0, 5, 0.2), (1, 1, 0, 6, 0.6)]
    out = G.symmetric_scores(spark.createDataFrame(rows, "mol_id long, i int, j int, k int, p double"))
    assert [(r.i, r.order, round(r.score, 6)) for r in out.orderBy("i").collect()] == [(0, 5, 0.7), (1, 6, 0.7)]


def test_perfect_detections_have_ap_one(spark):
    boxes = spark.createDataFrame([(k, i, 1, 0.1 * i, 0.1, 0.1 * i + 0.08, 0.3, 0.9 - 0.1 * i) for k in range(3) for i in range(4)], BOX + ", score double")
    out = {r.name: r.value for r in M.detection_summary(boxes, boxes, 640.0 * 480.0).collect()}
    assert out["AP"] == pytest.approx(1.0) and out["AP50"] == pytest.approx(1.0) and out["AR100"] == 1.0 and out["AR1"] == 0.25 and out["AP_large"] == -1.0


def test_tools():
    J.tool(lambda: 1)
    with pytest.raises(KeyError):
        J.call_tool("absent")


def test_unknown_tool_raises(spark):
    with pytest.raises(KeyError):
        J.check_tools(spark.createDataFrame([("zip",)], "name string"), {"unzip": "x"}, "name")


def test_search_finds_what_brute_force_finds(spark):
    import random

    rnd = random.Random(3)
    sets = {i: sorted(rnd.sample(range(30), rnd.randint(3, 12))) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "vec_id long, bits array<int>")
    want = sorted((a, b) for a in sets for b in sets if a != b and len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.4)
    assert values(S.search(df, df, 0.4), "query_id", "vec_id") == want


RC, C_, P, X_, N, E = Q.RCT, Q.CND, Q.PRD, Q.RXN, Q.NOISE, Q.END
BOX_A, BOX_B, BOX_C = [20, 20, 30, 30, -2], [40, 20, 50, 30, -3], [60, 20, 70, 30, -4]


@pytest.mark.parametrize("tokens, expected", [
    ([1, *BOX_A, RC, *BOX_B, C_, *BOX_C, P, X_, E], [(0, "[Rxn]", "reactants", 1), (0, "[Rxn]", "conditions", 2), (0, "[Rxn]", "products", 3)]),
    ([1, *BOX_A, RC, C_, *BOX_C, P, N, *BOX_B, RC, C_, *BOX_B, *BOX_A, P, X_, E], [(0, "[Noise]", "reactants", 1), (0, "[Noise]", "products", 3), (1, "[Rxn]", "reactants", 2), (1, "[Rxn]", "products", 2), (1, "[Rxn]", "products", 1)]),
    ([*BOX_A, RC, C_, *BOX_C, P, *BOX_B, X_, E, *BOX_A, RC, C_, *BOX_C, P, X_], [(0, "[Rxn]", "reactants", 1), (0, "[Rxn]", "products", 3)]),  # nothing behind the products, nothing behind the end
    ([15, *BOX_A, RC, 20, 20, -2, C_, 30, 30, 20, 20, -2, *BOX_C, P, X_, E], [(0, "[Rxn]", "reactants", 1), (0, "[Rxn]", "products", 3)]),  # broken boxes: read on by one token
    ([*BOX_A, RC, C_, P, X_, *BOX_B, RC, C_, *BOX_C, P, E], []),  # no product; not closed
    ([*BOX_A[:4], N, *BOX_A, RC, C_, *BOX_C, P, X_], [(1, "[Rxn]", "reactants", 1), (1, "[Rxn]", "products", 3)]),  # a box of no category ends in noise
])
def test_reaction_sequences(spark, tokens, expected):
    out = Q.parse_reactions(spark.createDataFrame([(7, tokens)], "image_id long, tokens array<int>")).orderBy("k").collect()
    assert [(r.rxn, r.label, r.role, r.category_id) for r in out] == expected


def test_box_and_coref_sequences(spark):
    rows = spark.createDataFrame([(1, i, [i, i, i + 5, i + 5], c) for i, c in enumerate([1, 3, 3, 4, 9, 3, 2, 3])], "image_id long, box_idx int, q array<int>, category_id int")
    boxes, links = Q.parse_corefs(Q.box_sequence(rows))
    assert values(boxes, "box_idx", "x1", "category_id") == [(0, 0, 1), (1, 1, 3), (2, 2, 3), (3, 3, 4), (4, 5, 3), (5, 6, 2), (6, 7, 3)]
    assert values(links, "mol_idx", "idt_idx") == [(0, 1), (0, 2), (5, 6)]


def test_boxes_are_deduplicated_inside_a_reaction(spark):
    boxes = spark.createDataFrame([(1, i, 1, x, 0.0, x + 1.0, 1.0) for i, x in enumerate([0.0, 5.0, 0.1, 9.0, 0.05])] + [(1, 5, 1, 0.0, 0.0, 0.005, 1.0)], BOX)
    rows = [(1, 0, "reactants", 0), (1, 0, "products", 1), (1, 0, "conditions", 4), (1, 1, "reactants", 2), (1, 1, "products", 3), (1, 1, "conditions", 5)]
    out = R.dedup_boxes(spark.createDataFrame(rows, "image_id long, rxn_idx int, role string, box_idx int"), boxes)
    assert values(out, "rxn_idx", "role", "box_idx") == [(0, "products", 1), (0, "reactants", 0), (1, "products", 3), (1, "reactants", 2)]


@pytest.mark.parametrize("text, title, footnote", [("Scheme 1 and Table 2", "Table 2", ""), ("see Scheme 3", "Scheme 3", ""), ("nothing", "", ""), ("x a2 y aB z", "", "aB z"), ("a0 a1 last", "", "a1 last"), ("b a0", "", "a0")])
def test_titles_and_footnotes(spark, text, title, footnote):
    table = spark.createDataFrame([(1, 0.0, 100.0, 200.0, 300.0)], "page long, left double, bottom double, right double, top double")
    at = [(1, 10.0, 310.0, 50.0, 320.0, text)] if title or not footnote else [(1, 10.0, 70.0, 50.0, 90.0, text)]
    r = T.titles(spark.createDataFrame(at, "page long, x0 double, y0 double, x1 double, y1 double, text string"), table).first()
    assert (r.title, r.footnote) == (title, footnote)


FORMULAS = {
    "C(CH3(OMe)2)3": {"C": 4, "H": 9, "OMe": 6}, "C2H4O": {"C": 2, "H": 4, "O": 1}, "((C)2N)3": {"C": 6, "N": 3}, "R1C(Ph)3": {"R1": 1, "C": 1, "Ph": 3}, "Cl2C6H3": {"Cl": 2, "C": 6, "H": 3}, "": {},
    "C(H": None, "C)H(": None, "C12345": None,
}


def test_condensed_formulas(spark):
    df = spark.createDataFrame(list(enumerate(FORMULAS)), "id long, formula string")
    found = {i: {} for i in range(len(FORMULAS))}
    for r in G.formula_counts(df).collect():
        found[r.id][r.symbol] = r.n
    assert found == {i: v or {} for i, v in enumerate(FORMULAS.values())}
    assert {r.formula for r in G.formula_rejects(df).collect()} == {f for f, v in FORMULAS.items() if v is None}
    for f, atoms in ((r.formula, r.a) for r in df.select("formula", C.formula_atoms(F.col("formula")).alias("a")).collect()):
        assert FORMULAS[f] == (None if atoms is None else {x: atoms.count(x) for x in atoms})


@pytest.mark.parametrize("formula, atoms", [("C2H4O", "C H H C H H O"), ("C3F7", "C F F C F F C F F F"), ("C2", "C C"), ("C2(OMe)3N", "C OMe C OMe OMe N"), ("N(CF2C2F5)2", "N C F F C F F C F F F C F F C F F C F F F"), ("CH3C2", "C H H H C C")])
def test_carbon_runs(spark, formula, atoms):
    assert " ".join(spark.range(1).select(C.formula_atoms(F.lit(formula)).alias("a")).first().a) == atoms


def test_refined_keys_tell_isomers_apart(spark):
    """Two molecules with the same atom and bond lists, and a copy of the first with its atoms in another order."""
    chains = {1: "CCOCN", 2: "COCCN", 3: "NCOCC"}
    atoms = spark.createDataFrame([(m, i, x) for m, c in chains.items() for i, x in enumerate(c)], "mol_id long, atom_idx int, symbol string")
    bonds = spark.createDataFrame([(m, i - 1, i, 1) for m, c in chains.items() for i in range(1, len(c))], "mol_id long, src int, dst int, order int")
    key = {r.mol_id: r.twin for r in graphs.exact_classes(atoms, G.edges_of(atoms, bonds)).collect()}
    plain = {r.mol_id: r.key for r in G.signatures(atoms, G.edges_of(atoms, bonds)).collect()}
    assert key[1] == key[3] != key[2] and len(set(plain.values())) == 1


def test_ranks_of_a_hot_value(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("k"), (F.col("id") * 37 % 1009).alias("v"))
    rows = ranked(df, ["v"], "k").collect()
    for k in "ab":
        mine = sorted((r.v, r["rank"]) for r in rows if r.k == k)
        assert [x for _, x in mine] == list(range(len(mine)))
    assert sorted(r["rank"] for r in ranked(df, ["v"]).collect()) == list(range(1000))


def test_rolling_in_chunks(spark):
    rows = spark.createDataFrame([("ab"[i % 7 == 0], i, float((i * 31) % 17)) for i in range(200)], "k string, ts int, v double")
    cols = ("ts", "median", "mean", "max", "last", "total_mean")
    assert values(M.rolling(rows, "k", ["ts"], "v", 20, chunk=25), *cols) == values(M.rolling(rows, "k", ["ts"], "v", 20), *cols)


def test_average_precision_brute(spark):
    """Scores closer than a cell stay steps of their own."""
    import random

    rnd = random.Random(12)
    rows = [(k, "all", 0.5, k % 3, 0.5 + rnd.randrange(40) / 1e5 if k % 2 else rnd.random(), int(rnd.random() < 0.6), 0) for k in range(120)] + [(0, "all", 0.5, -1, 0.0, 0, 90)]
    df = spark.createDataFrame(rows, "image_id long, area string, threshold double, place int, score double, tp int, n_gold int")
    steps = sorted({r[4] for r in rows if r[3] >= 0}, reverse=True)
    curve, tp, n = [], 0, 0
    for s in steps:
        at = [r for r in rows if r[3] >= 0 and r[4] == s]
        tp, n = tp + sum(r[5] for r in at), n + len(at)
        curve.append((tp / 90, tp / n))
    want = sum(max((p for r, p in curve if r >= k / 100 - 1e-12), default=0.0) for k in range(101)) / 101
    got = M.average_precision(df).first()
    assert got.ap == pytest.approx(want) and got.recall == pytest.approx(tp / 90)


def test_tools_by_name_and_arguments(spark):
    @J.tool(name="first", description="The first rows.", parameters={"n": "integer"})
    def first(df, n):
        return df.limit(n)

    assert J.dispatch("first", '{"n": 2}', spark.range(5)).count() == 2
    with pytest.raises(TypeError):
        J.dispatch("first", '{"n": "2"}', spark.range(5))
    with pytest.raises(KeyError):
        J.dispatch("second", "{}")
    row = J.tool_table(spark).filter("name = 'first'").first()
    assert row.description == "The first rows." and '"integer"' in row.parameters


def test_promoted_header_is_tagged_again(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0.0, "old"), (1, 1, 0, 0.0, "entry"), (1, 1, 1, 90.0, "yield (%)"), (1, 2, 0, 0.0, "1"), (2, 0, 0, 0.0, "R1"), (2, 1, 0, 0.0, "Me")], "page long, row_idx int, cell_idx int, x0 double, text string")
    cells = cells.withColumn("x1", F.col("x0") + 60)
    out = T.columns_of(T.promote(cells))
    assert values(out, "page", "header", "tag") == [(1, "entry", "counter"), (1, "yield (%)", "result"), (2, "R1", "alkyl group")]
