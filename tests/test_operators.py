"""Operators by brute force and by cases made by hand."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from figweave.operators import inference as J
from figweave.operators import metrics as M
from figweave.operators import molecules as G
from figweave.operators import sequences as Q
from figweave.operators import tables as T
from figweave.operators import text as S
from figweave.plans import QUERIES
from figweave.plans import fixtures as X


def sentences_brute(text):
    """A scan with the place where the sentence begins; what is behind a stop goes up to the next blank."""
    out, begin, i = [], 0, 0
    while i < len(text):
        if text[i] == "." and (i > 0 and not text[i - 1].isdigit() or text[i + 1 : i + 2] == " "):
            out.append(text[begin : i + 1])
            blank = text.find(" ", i)
            i = len(text) if blank < 0 else blank
            begin = i + 1
        i += 1
    if begin < len(text) and text[begin:].strip(" "):
        tail = text[begin:].strip(" ")
        out.append(tail if tail.endswith(".") else tail + ".")
    return [s.strip(" ") for s in out if s.strip(" ")]


@pytest.mark.parametrize("text, wanted", [
    ("a b. . c", ["a b.", ".", "c."]), ("x. .y z. End", ["x.", ".", "z.", "End."]), (". starts", [".", "starts."]), (".5 g of it", [".5 g of it."]), ("Add 3.5 g. Then stir.", ["Add 3.5 g.", "Then stir."]),
    ("See Fig.1 now. End", ["See Fig.", "now.", "End."]), ("at pH 7. Cool", ["at pH 7.", "Cool."]), ("x². And 5². no", ["x².", "And 5².", "no."]), ("no stop ", ["no stop."]), ("... . .", ["...", ".", "."][0:0] or None)])
def test_sentence_ends(spark, text, wanted):
    wanted = sentences_brute(text) if wanted is None else wanted
    assert sentences_brute(text) == wanted
    out = S.sentences(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("sent_idx").collect()
    assert [r.sentence for r in out] == wanted


def test_sentences_brute(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a", "7", ".", ".", " ", "b", "²", ". "]) for _ in range(rnd.randrange(1, 25))) for _ in range(400)]
    got = defaultdict(list)
    for r in S.sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id", "sent_idx").collect():
        got[r.doc_id].append(r.sentence)
    for i, text in enumerate(texts):
        assert got[i] == sentences_brute(text.replace("- ", "-")), text


@pytest.mark.parametrize("n, heavy", [(3, 1000), (1, 2)])
def test_related_sentences_brute(spark, monkeypatch, n, heavy):
    """Hot terms, ties, terms that no sentence has, passages without terms."""
    monkeypatch.setattr(S, "HEAVY", heavy)
    rnd = random.Random(n)
    words = ["common"] * 12 + [f"word{c}" for c in "abcdefghij"] + ["rare" + c for c in "xyz"]
    rows = [(d, p, s, " ".join(rnd.choice(words) for _ in range(rnd.randrange(7)))) for d in range(12) for p in (1, 2) for s in (1, 2, 3)]
    asked = [(i, " ".join(rnd.sample(words, 8) + ["absent"])) for i in range(12)] + [(90, "a b"), (91, None), (92, "absent only"), (93, "common")]
    out = S.related_sentences(spark.createDataFrame(rows, "doc_id int, para_idx int, sent_idx int, sentence string"), spark.createDataFrame(asked, "item_id int, text string"), n)
    terms = lambda t: {w for w in "".join(c if "a" <= c <= "z" else " " for c in (t or "").lower()).split() if len(w) > 3}
    want = set()
    for i, text in asked:
        found = sorted((-len(terms(text) & terms(s)), d, p, k) for d, p, k, s in rows if terms(text) & terms(s))[:n]
        want |= {(i, d, p, k, -c, at) for at, (c, d, p, k) in enumerate(found, 1)}
    assert {(r.item_id, r.doc_id, r.para_idx, r.sent_idx, r.shared, r.place) for r in out.collect()} == want


def test_lines_in_ten_thousand_regions(spark):
    """Regions of all sizes, limits in any order; candidates stay near the hits."""
    rnd = random.Random(2)
    regions = []
    for k in range(10_000):
        w, h, x, y = rnd.choice([0.5, 3, 40]), rnd.choice([0.5, 3, 40]), rnd.uniform(-900, 900), rnd.uniform(-900, 900)
        a, b, c, d = x, y, x + w, y + h
        regions.append((1, k, *((a, b, c, d), (c, d, a, b), (a, d, c, b))[k % 3]))
    regions += [(1, 20_000, 5.0, 5.0, 5.0, 9.0), (1, 20_001, None, 0.0, 1.0, 1.0), (2, 20_002, -1e9, -1e9, 1e9, 1e9)]
    lines = [(1, x, y, x + rnd.choice([0.1, 2.0]), y + 0.1, f"t{i}") for i in range(500) for x, y in [(rnd.uniform(-900, 900), rnd.uniform(-900, 900))]] + [(2, 0.0, 0.0, 1.0, 1.0, "two"), (3, 0.0, 0.0, 1.0, 1.0, "three")]
    got = T.lines_in_regions(spark.createDataFrame(lines, "page int, x0 double, y0 double, x1 double, y1 double, text string"), spark.createDataFrame(regions, "page int, region_id int, x1 double, y1 double, x2 double, y2 double"))
    inside = lambda v, a, b: min(a, b) < v < max(a, b)
    want = sorted((t, k) for p, x0, y0, x1, y1, t in lines for q, k, a, b, c, d in regions if p == q and a is not None and all(inside(v, a, c) for v in (x0, x1)) and all(inside(v, b, d) for v in (y0, y1)))
    assert sorted((r.text, r.region_id) for r in got.collect()) == want and len(want) > 300
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    assert T.lines_in_regions(spark.createDataFrame(lines, "page int, x0 double, y0 double, x1 double, y1 double, text string"), spark.createDataFrame(regions[:0], "page int, region_id int, x1 double, y1 double, x2 double, y2 double")).count() == 0


def test_rolling_is_the_same_for_large_keys(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("aaab"), rnd.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, k string, v double")
    as_set = lambda out: {(r.i, r.k, round(r["mean"], 9), r["median"], r["max"], r["last"], round(r.total_mean, 9)) for r in out.collect()}
    plain = as_set(M.rolling(df, "k", ["i"], "v", 7))
    assert len(plain) == 300 and as_set(M.rolling(df, "k", ["i"], "v", 7, chunk=50)) == plain == as_set(M.rolling(df, "k", ["i"], "v", 7, chunk=100))


def test_average_precision_in_cells_of_any_size(spark):
    """Scores that crowd near 1."""
    rnd = random.Random(4)
    rows = [(i, "all", 0.5, place, 1 - rnd.random() ** 6 * 0.01, int(rnd.random() < 0.6), 3) for i in range(60) for place in range(4)] + [(99, "all", 0.5, -1, 0.0, 0, 3)]
    df = spark.createDataFrame(rows, "image_id int, area string, threshold double, place int, score double, tp int, n_gold int")
    values = {size: M.average_precision(df, size=size).first().ap for size in (10_000, 50, 7)}
    assert max(values.values()) - min(values.values()) < 1e-12


def test_boxes_without_area_write_nothing(spark):
    rows = [(1, 0, "reactants", 0, [5, 5, 5, 9], 1), (1, 0, "reactants", 1, [1, 1, 2, 2], 1), (1, 0, "products", 2, [3, 3, 4, 4], 9), (1, 1, "reactants", 3, [5, 5, 5, 9], 1), (1, 1, "products", 4, [3, 3, 4, 4], 1),
            (2, 0, "reactants", 0, [1, 1, 2, 2], 1), (2, 0, "conditions", 1, [1, 1, 2, 2], 1)]
    df = spark.createDataFrame(rows, "image_id int, rxn_idx int, role string, box_idx int, q array<int>, category_id int")
    out = {r.image_id: r.tokens for r in Q.reaction_sequence(df).collect()}
    at = Q.BINS_AT
    assert out == {1: [Q.SOS, 1 + at, 1 + at, 2 + at, 2 + at, -2, Q.RCT, Q.CND, 3 + at, 3 + at, 4 + at, 4 + at, Q.NOISE, Q.PRD, Q.RXN, Q.END], 2: [Q.SOS, Q.END]}
    assert {r.image_id: len(r.tokens) for r in Q.box_sequence(df.filter("image_id = 1")).collect()} == {1: 2 + 15}


def test_all_equations(spark):
    out = G.equations(spark.createDataFrame([(1, 0, "R1 = Me, R2=Et; X = 3"), (1, 1, "none"), (1, 2, None)], "image_id int, box_idx int, text string")).collect()
    assert sorted((r.box_idx, r.ordinal, r.name, r.value) for r in out) == [(0, 0, "R1", "Me"), (0, 1, "R2", "Et"), (0, 2, "X", "3")]


def test_whole_reactions_of_a_table(spark):
    grid = [(1, 1, 0, "R1", "alkyl group", "4-Me (3a)"), (1, 1, 1, "time", "time", "2 h"), (1, 2, 0, "R1", "alkyl group", "?"), (1, 2, 1, "time", "time", "5 h"), (2, 1, 0, "R1", "alkyl group", "Et"), (3, 1, 0, "x", "unknown", "y")]
    molecules = [(1, "reactants", 0, 10), (1, "reactants", 1, 11), (1, "products", 0, 12), (3, "products", 0, 10)]
    atoms = [(10, 0, "[R1]"), (10, 1, "C"), (11, 0, "O"), (12, 0, "N"), (12, 1, "[R1]"), (12, 2, "[R1]")]
    new, first = T.whole_reactions(
        spark.createDataFrame(grid, "page int, row_idx int, col_idx int, header string, tag string, text string"), spark.createDataFrame(molecules, "page int, role string, k int, mol_id int"),
        spark.createDataFrame([(1, 0, "heat"), (1, 1, "air")], "page int, k int, text string"), spark.createDataFrame(atoms, "mol_id int, atom_idx int, symbol string"))
    (r,) = new.collect()
    assert (r.page, r.row_idx) == (1, 1)
    assert [(m.role, m.k, m.symbols) for m in r.molecules] == [("products", 0, ["N", "[Me]", "[Me]"]), ("reactants", 0, ["[Me]", "C"]), ("reactants", 1, ["O"])]
    assert [tuple(c) for c in r.conditions] == [("[Text]", "heat", None, None), ("[Text]", "air", None, None), ("[Table]", "2 h", "time", "time")]
    told = {r.page: [[c.text for c in x] for x in r.conditions] for r in first.collect()}
    assert told == {1: [["heat", "air"], ["heat", "air", "5 h"]], 3: [[], ["y"]]}


def test_parts_of_placed_rows_are_those_of_the_grid(spark, sf):
    placed = T.placed_rows(T.cells_of(T.rows_of(X.text_lines(spark, sf))))
    odd = spark.createDataFrame([(-1, 1, [], [(None, "a")], "fits no column"), (-2, 1, [(0, "R1", "alkyl group", 0.0, 9.0), (1, "R1", "alkyl group", 9.0, 19.0), (2, "t(", "time", 19.0, 29.0)], [(1, "4-Me (3a)"), (0, "?")], None),
                                 (-3, 2, [(0, "x", "unknown", 0.0, 9.0)], [], None)], placed.schema)
    placed = placed.unionByName(odd)
    grid, parts = T.row_parts(T.grid_of(placed)), T.placed_parts(placed)
    assert parts.columns == grid.columns and parts.exceptAll(grid).isEmpty() and grid.exceptAll(parts).isEmpty()
    assert {r.page: [g.value for g in r.groups] for r in parts.filter("page < 0").collect()} == {-2: ["[Me]"], -3: []}


def test_first_reactions_make_their_lines_once(spark, sf):
    """Pages come from the table itself: lines are ordered and made once, and no row meets its page's conditions by itself."""
    plan = QUERIES["table_first_reaction"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number(") == 1
    lines = X.text_lines(spark, sf)
    assert sorted(r.page for r in X.pages(spark, sf).collect()) == sorted(r.page for r in lines.select("page").distinct().collect())


def test_models_stay_in_their_process_and_order_is_kept(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return lambda texts: [(len(t), max(map(len, texts))) for t in texts]

    df = spark.createDataFrame([(i, "x" * ((i * 7919) % 97)) for i in range(400)], "i int, t string").repartition(16)
    for _ in range(2):
        out = J.apply_batched(df, load, "t", "n int, widest int", batch_size=8, name=f"model-{log}", size=len).collect()
        assert {(r.i, r.n) for r in out} == {(i, (i * 7919) % 97) for i in range(400)}
        assert all(r.widest - r.n < 60 for r in out)
    pids = open(log).read().split()
    assert len(pids) == len(set(pids)) < 32
    with pytest.raises(ValueError):
        J.predicted(lambda v: [], ["a"], 2, None)


def test_padding_by_length():
    widths = []
    predict = lambda v: widths.append(max(map(len, v)) * len(v)) or [(x,) for x in v]
    values = ["x" * (i % 2 * 99 + 1) for i in range(64)]
    assert J.predicted(predict, values, 8, len) == [(v,) for v in values]
    by_length = sum(widths)
    widths.clear()
    J.predicted(predict, values, 8, None)
    assert by_length < 0.6 * sum(widths)


def test_detection_steps_brute(spark):
    """Images of all shapes in one batch, crowded scores, images without gold; one row a score, however many images."""
    rnd = random.Random(8)
    box = lambda: (lambda x, y: (x, y, x + rnd.choice([0.2, 0.25]), y + 0.2))(rnd.randrange(3) * 0.05, rnd.randrange(2) * 0.05)
    gold = [(i, k, *box(), 0.0) for i in range(40) for k in range(rnd.randrange(4))]
    pred = [(i, k, *box(), rnd.randrange(5) / 8) for i in range(45) for k in range(rnd.randrange(5))]
    df = lambda rows: spark.createDataFrame(rows, "image_id long, box_idx int, x1 double, y1 double, x2 double, y2 double, score double").coalesce(1)
    out = M.detection_steps(df(gold), df(pred), 640.0 * 480.0, (1, 100)).filter("area = 'all'").collect()
    assert sum(r.n > 0 and (r.threshold, r.most) == (0.5, 100) for r in out) <= 5 * 4

    def iou(a, b):
        w, h = (max(0.0, min(a[c + 2], b[c + 2]) - max(a[c], b[c])) for c in (0, 1))
        size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
        return w * h / (size(a) + size(b) - w * h)

    want = defaultdict(lambda: [0, 0])
    for t in M.THRESHOLDS:
        for i in range(45):
            free = [g[2:6] for g in gold if g[0] == i]
            for place, p in enumerate(sorted((p for p in pred if p[0] == i), key=lambda p: (-p[6], p[1]))):
                best = max(free, key=lambda g: iou(p[2:6], g), default=None)
                hit = best is not None and iou(p[2:6], best) >= t
                if hit:
                    free.remove(best)
                for most in (1, 100):
                    if place < most:
                        want[t, most, p[6]][0] += hit
                        want[t, most, p[6]][1] += 1
    got = defaultdict(lambda: [0, 0])
    for r in out:
        if r.n:
            got[r.threshold, r.most, r.score][0] += r.tp
            got[r.threshold, r.most, r.score][1] += r.n
    assert got == want
    seen = {p[0] for p in pred}
    assert sum(r.gold for r in out if (r.threshold, r.most) == (0.5, 1)) == sum(g[0] in seen for g in gold)


def test_related_sentences_broadcast_few_queries(spark, monkeypatch):
    """The same rows in both ways; words are shuffled by term only where queries are many."""
    rnd = random.Random(9)
    words = ["common"] * 9 + [f"word{c}" for c in "abcdefgh"]
    rows = spark.createDataFrame([(d, 1, s, " ".join(rnd.choice(words) for _ in range(6))) for d in range(20) for s in (1, 2)], "doc_id int, para_idx int, sent_idx int, sentence string")
    asked = spark.createDataFrame([(i, " ".join(rnd.sample(words, 5))) for i in range(8)], "item_id int, text string")
    few = S.related_sentences(rows, asked)
    assert " part#" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(S, "SMALL", 0)
    many = S.related_sentences(rows, asked)
    assert " part#" in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
