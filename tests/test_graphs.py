"""Folds over molecules, back-out of R-groups and searches against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from figweave.functions import chemistry as C
from figweave.operators import backout as K
from figweave.operators import graphs as R
from figweave.operators import molecules as G
from figweave.operators import search as S
from figweave.plans import fixtures as X


def tables(spark, mols):
    """mols {id: (symbols, bonds (a, b, order))} as packed molecules, with atoms and edges."""
    atoms = spark.createDataFrame([(m, i, s) for m, (names, _) in mols.items() for i, s in enumerate(names)], "mol_id long, atom_idx int, symbol string")
    bonds = spark.createDataFrame([(m, a, b, o) for m, (_, bs) in mols.items() for a, b, o in bs], "mol_id long, src int, dst int, order int")
    edges = G.edges_of(atoms, bonds)
    return atoms, edges, R.packed(atoms, edges)


def links(mol):
    out = {}
    for a, b, o in mol[1]:
        out[a, b] = out[b, a] = 1 if o > 4 else o
    return out


def parts(places, near):
    label = {p: p for p in places}
    for a, b in near:
        if a in label and b in label and label[a] != label[b]:
            lo, hi = sorted((label[a], label[b]))
            label = {p: lo if x == hi else x for p, x in label.items()}
    return label


def random_mol(rnd, n, symbols, extra=1):
    bonds = {(rnd.randrange(i), i): rnd.choice([1, 1, 1, 2]) for i in range(1, n) if rnd.random() < 0.9}
    for _ in range(rnd.randrange(extra + 1)):
        a, b = sorted(rnd.sample(range(n), 2)) if n > 1 else (0, 0)
        if a != b:
            bonds.setdefault((a, b), 1)
    return [rnd.choice(symbols) for _ in range(n)], [(a, b, o) for (a, b), o in sorted(bonds.items())]


def fragments_brute(mol):
    return parts(range(len(mol[0])), links(mol))


@pytest.mark.parametrize("limit", [0, 5, 256])
def test_fragments_by_fold_and_by_propagation(spark, limit):
    rnd = random.Random(1)
    mols = {m: random_mol(rnd, rnd.randrange(1, 12), "CNO", 2) for m in range(40)}
    mols[99] = (["C"] * 60, [(i, i + 1, 1) for i in range(59) if i != 30])
    atoms, edges, _ = tables(spark, mols)
    got = {(r.mol_id, r.atom_idx): r.label for r in G.components(atoms, edges, limit=limit).collect()}
    assert got == {(m, i): x for m, mol in mols.items() for i, x in fragments_brute(mol).items()}
    assert G.components(atoms.limit(0), edges.limit(0)).count() == 0


def same_graph(a, b):
    if len(a[0]) != len(b[0]) or len(links(a)) != len(links(b)):
        return False
    la, lb = {}, {}
    for mol, out in ((a, la), (b, lb)):
        for x, y, o in mol[1]:
            out[x, y], out[y, x] = o, 11 - o if o > 4 else o
    return any(all(a[0][i] == b[0][p] for i, p in enumerate(perm)) and all(lb.get((perm[x], perm[y])) == o for (x, y), o in la.items()) for perm in itertools.permutations(range(len(a[0]))))


def ring(*sizes):
    names, bonds, at = [], [], 0
    for n in sizes:
        names += ["C"] * n
        bonds += [(at + i, at + (i + 1) % n, 1) for i in range(n)]
        at += n
    return names, bonds


def test_exact_classes(spark):
    rnd = random.Random(2)
    mols = {m: random_mol(rnd, rnd.randrange(1, 6), "CN", 1) for m in range(60)}
    for m in range(20):  # the same molecules with other atom numbers
        names, bonds = mols[m]
        perm = list(range(len(names)))
        rnd.shuffle(perm)
        mols[100 + m] = ([names[perm.index(i)] for i in range(len(names))], [(perm[a], perm[b], o) for a, b, o in bonds])
    atoms, edges, _ = tables(spark, mols)
    want = {m: min(k for k in mols if same_graph(mols[k], mols[m])) for m in mols}
    assert {r.mol_id: r.twin for r in R.exact_classes(atoms, edges).collect()} == want


def test_ring_systems_with_equal_colours_are_told_apart(spark):
    prism = (["C"] * 6, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1), (0, 3, 1), (1, 4, 1), (2, 5, 1)])
    k33 = (["C"] * 6, [(a, b, 1) for a in (0, 1, 2) for b in (3, 4, 5)])
    turned = (["C"] * 6, [(b, a, 1) for a in (0, 2, 4) for b in (1, 3, 5)])
    mols = {1: ring(40), 2: ring(20, 20), 3: ring(22, 18), 4: ring(18, 22), 5: ring(20, 20), 6: prism, 7: k33, 8: turned, 9: (["Cl"] * 9 + ["Na"] * 9, [])}
    atoms, edges, _ = tables(spark, mols)
    assert {r.mol_id: r.twin for r in R.exact_classes(atoms, edges).collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 2, 6: 6, 7: 7, 8: 7, 9: 9}
    assert R.exact_classes(atoms.limit(0), edges.limit(0)).count() == 0


def ways_brute(query, record):
    q, r = links(query), links(record)
    return sum(all(query[0][i] == record[0][p] for i, p in enumerate(perm)) and all(r.get((perm[a], perm[b])) == o for (a, b), o in q.items()) for perm in itertools.permutations(range(len(record[0])), len(query[0])))


def test_substructures_brute(spark):
    rnd = random.Random(3)
    records = {m: random_mol(rnd, rnd.randrange(1, 7), "CCN", 1) for m in range(40)}
    asked = {m: random_mol(rnd, rnd.randrange(1, 5), "CCN", 1) for m in range(200, 230)} | {300: (["Xx"], []), 301: (["C", "C"], [(0, 1, 5)])}
    out = R.substructures(tables(spark, asked)[2], tables(spark, records)[2]).collect()
    want = {(q, m): n for q in asked for m in records if (n := ways_brute(asked[q], records[m]))}
    assert {(r.query_id, r.mol_id): r.n for r in out} == want


def with_copies(mols):
    return mols.select("mol_id", "names", "near", F.when(F.col("mol_id") % 3 == 0, 5).otherwise(1).cast("long").alias("copies"))


@pytest.mark.parametrize("listed", [24, 5])
def test_substructure_counts_brute(spark, monkeypatch, listed):
    """Small paths side by side are counted by pattern, all others and large records by pairs; symbols may hold the signs of a path's text."""
    rnd = random.Random(5)
    records = {m: random_mol(rnd, rnd.randrange(1, 8), ["C", "C", "N", "C~1~1:N"], 1) for m in range(40)} | {90: (["C", "C", "C", "N"], [(0, 1, 1), (1, 2, 1), (0, 2, 1), (2, 3, 6)])}
    asked = {m: random_mol(rnd, rnd.randrange(1, 6), ["C", "C", "N", "C~1~1:N"], 1) for m in range(200, 240)}
    asked |= {300: (["Xx"], []), 301: (["C", "C"], [(0, 1, 5)]), 302: (["C", "C", "C"], [(0, 1, 1), (1, 2, 1), (0, 2, 1)]), 303: (["C"] * 4, [(0, 1, 1), (0, 2, 1), (0, 3, 1)]), 304: (["C", "C", "N", "C"], [(0, 3, 1), (1, 2, 1)]), 305: (["C"] * 3, [])}
    monkeypatch.setattr(R, "LISTED", listed)
    paired, whole = [], R.substructures
    monkeypatch.setattr(R, "substructures", lambda q, r, keep=None: (paired.append(q), whole(q, r, keep))[1])
    out = R.substructure_counts(tables(spark, asked)[2], with_copies(tables(spark, records)[2])).collect()
    copies = {m: 5 if m % 3 == 0 else 1 for m in records}
    want = {}
    for q in asked:
        n = {m: w for m in records if (w := ways_brute(asked[q], records[m]))}
        if n:
            want[q] = (sum(copies[m] for m in n), min(n), sum(w * copies[m] for m, w in n.items()))
    assert {r.query_id: (r.n_molecules, r.first, r.n_ways) for r in out} == want
    by_pairs = {r.mol_id for r in paired[0].collect()}
    assert {302, 303} <= by_pairs and not by_pairs & {300, 301, 304, 305}
    assert len(paired) == (1 if listed == 24 else 2)


def test_candidates_have_each_path_as_often(spark):
    """Three carbons and a chain apart meet no record with fewer of either; a bond that a query draws twice is one."""
    asked = tables(spark, {1: (["C", "C", "C", "N", "O"], [(3, 4, 1)]), 2: (["C", "N", "C", "N"], [(0, 1, 2), (2, 3, 2)])})[2]
    records = tables(spark, {10: (["C", "C", "N", "O"], [(2, 3, 1)]), 11: (["C", "O", "C", "N", "C"], [(1, 3, 1)]), 12: (["C", "N", "C", "N"], [(0, 1, 2)]), 13: (["N", "C", "C", "N"], [(0, 1, 2), (2, 3, 2)])})[2]
    assert {(r.query_id, r.mol_id) for r in R.substructure_candidates(asked, records).collect()} == {(1, 11), (2, 13)}
    twice = spark.createDataFrame([(1, ["C", "N"], [[(1, 2), (1, 2)], [(0, 2), (0, 2)]])], "mol_id long, names array<string>, near array<array<struct<at:int,o:int>>>")
    assert {(r.query_id, r.mol_id) for r in R.substructures(twice, records).collect()} == {(1, 12), (1, 13)}


def test_substructure_counts_of_odd_bonds(spark):
    """Bonds drawn twice or to the atom itself, and unknown symbols, are left to the pairs; without queries or records nothing is found."""
    mols = spark.createDataFrame([(1, ["C", "C"], [[(1, 1), (1, 2)], [(0, 1), (0, 2)]]), (2, ["C", None], [[(1, 1)], [(0, 1)]]), (3, ["C", "C"], [[(1, 1)], [(0, 1)]]), (4, ["C"], [[(0, 1)]])],
                                 "mol_id long, names array<string>, near array<array<struct<at:int,o:int>>>")
    records = with_copies(mols)
    got = {tuple(r) for r in R.substructure_counts(mols, records).collect()}
    pairs = R.substructures(mols, records, ["copies"]).groupBy("query_id").agg(F.sum("copies"), F.min("mol_id"), F.sum(F.col("n") * F.col("copies")))
    assert got == {tuple(r) for r in pairs.collect()} and any(r[0] == 3 for r in got)
    assert R.substructure_counts(mols.limit(0), records).count() == 0 and R.substructure_counts(mols, records.limit(0)).count() == 0


def test_molecules_packed_in_one_grouping(spark, sf):
    once, rows = X.packed(spark, sf), R.packed_rows(X.drawn(spark, sf))
    assert once.schema == rows.schema and once.exceptAll(rows).isEmpty() and rows.exceptAll(once).isEmpty()


def backout_brute(template, target):
    """Sites in order and, for the best way, (name, attach or None), with the target's places that are no core."""
    names, near, t_near = template[0], links(template), links(target)
    site = {i: x for i, s in enumerate(names) if (x := {"[R1]": "[1*]", "[R2]": "[2*]", "[R3]": "[3*]", "[Ar]": "[Ar]"}.get(s))}
    core = [i for i in range(len(names)) if i not in site]
    sites, places = sorted(site), range(len(target[0]))
    frag = parts(places, t_near)

    def found(wanted, allowed, injective=True):
        for perm in itertools.permutations(allowed, len(wanted)):
            m = dict(zip(wanted, perm))
            if all(i in site or names[i] == target[0][m[i]] for i in wanted) and all(t_near.get((m[a], m[b])) == o for (a, b), o in near.items() if a in m and b in m):
                yield m

    allowed = list(places)
    if len(set(frag.values())) > 1:
        whole = [f for f in sorted(set(frag.values())) if any(True for _ in found(list(range(len(names))), [p for p in places if frag[p] == f]))]
        if whole:
            allowed = [p for p in places if frag[p] == whole[0]]
    for size in range(len(sites) + 1):
        for hydrogens in sorted(itertools.combinations(range(len(sites)), size), key=lambda c: -sum(1 << k for k in c)):
            wanted = sorted([*core, *(sites[k] for k in range(len(sites)) if k not in hydrogens)])
            best = None
            for m in found(wanted, allowed):
                rest = [p for p in allowed if p not in {m[c] for c in core}]
                label = parts(rest, t_near)
                kept = [s for s in wanted if s in site]
                if len(set(label.values())) == len(kept) and len({label[m[s]] for s in kept}) == len(kept):
                    key = [m.get(i, -1) for i in range(len(names))]
                    best = min(best, (key, m, rest)) if best and best[0] > key else best or (key, m, rest)
            if best:
                return [(site[s], best[1].get(s)) for s in sites], best[2]
    return None


def read(spark, templates, targets, pairs):
    tpls, rejects = K.templates(tables(spark, templates)[2])
    variants = spark.createDataFrame([(t, m, f"{m}a", None, None) for t, m in pairs], "tpl_id long, mol_id long, label string, name string, value string")
    return K.read_groups(tpls, tables(spark, targets)[2], variants), rejects


def test_backout_brute(spark):
    """Templates with 1 to 3 sites and several core atoms against targets with rings and loose parts."""
    rnd = random.Random(4)
    templates = {}
    for t in range(14):
        names, bonds = random_mol(rnd, rnd.randrange(1, 4), "CCN", 1)
        bonds = [(a, b, 1) for a, b, _ in bonds]
        for k in range(rnd.randrange(1, 4)):
            names.append(["[R1]", "[R2]", "[R3]", "[Ar]"][(k + t) % 4])
            bonds.append((rnd.randrange(len(names) - k - 1), len(names) - 1, 1))
        templates[t] = (names, bonds)
    targets = {m: random_mol(rnd, rnd.randrange(1, 7), "CCCNO", 1) for m in range(100, 130)}
    targets = {m: (n, [(a, b, rnd.choice([1, 1, 1, 5, 2])) for a, b, _ in bs]) for m, (n, bs) in targets.items()}
    out, _ = read(spark, templates, targets, [(t, m) for t in templates for m in targets])
    got = {(r.tpl_id, r.mol_id): ([(g.name, g.attach) for g in r.groups], [i for i, x in enumerate(r.inside) if x]) for r in out.collect()}
    want = {(t, m): x for t in templates for m in targets if (x := backout_brute(templates[t], targets[m]))}
    assert len(want) > 100 and sum(any(a is None for _, a in x[0]) for x in want.values()) > 10
    assert got == want


def test_backout_puts_groups_on_reactants(spark):
    """R1-C(=O)-N-R2: two sites; reactants with a site, an alias, a site alone, and none."""
    template = (["[R1]", "C", "O", "N", "[R7]"], [(0, 1, 1), (1, 2, 2), (1, 3, 1), (3, 4, 1)])
    target = (["C", "C", "C", "O", "N", "F"], [(0, 1, 1), (1, 2, 1), (2, 3, 2), (2, 4, 1), (4, 5, 1)])
    out, _ = read(spark, {1: template}, {10: target, 11: (["C", "O", "N"], [(0, 1, 2), (0, 2, 1)])}, [(1, 10), (1, 11)])
    assert sorted((r.mol_id, r.site, r.group) for r in K.group_texts(out).collect()) == [(10, "[1*]", "CC"), (10, "[7*]", "F"), (11, "[1*]", "H"), (11, "[7*]", "H")]
    mols = {20: (["Br", "[R1]"], [(0, 1, 1)]), 21: (["[R7]"], []), 22: (["O", "O"], [(0, 1, 1)]), 23: (["[R1]", "S", "[R1]"], [(0, 1, 1), (1, 2, 1)])}
    reactants = spark.createDataFrame([(1, k, r) for k, r in enumerate(mols)], "tpl_id long, rct_idx int, reactant long")
    made = K.put_on(out, reactants, tables(spark, mols)[2])
    rows = {(r.mol_id, r.rct_idx): ("".join(r.atoms), sorted(tuple(e) for e in r.bonds)) for r in made.collect()}
    assert rows[10, 0] == ("BrCC", [(0, 2, 1), (1, 2, 1)]) and rows[10, 1] == ("F", []) and rows[10, 2] == ("OO", [(0, 1, 1)])
    assert rows[10, 3] == ("SCCCC", [(0, 2, 1), (0, 4, 1), (1, 2, 1), (3, 4, 1)])
    assert rows[11, 0] == ("Br", []) and rows[11, 1] == ("H", []) and rows[11, 3] == ("S", [])
    atoms, bonds = K.tables(made)
    assert atoms.filter("mol_id = 10 and rct_idx = 0").count() == 3 and bonds.filter("mol_id = 10 and rct_idx = 3").count() == 4


@pytest.mark.parametrize("drawn, known, hit", [("[R7]", "[R1]", True), ("[R1]", "[Rf]", True), ("[Rf]", "[R1]", True), ("[R7]", "[Rf]", False), ("[R2]", "[R1]", False)])
def test_backout_aliases(spark, drawn, known, hit):
    out, _ = read(spark, {1: (["C", known], [(0, 1, 1)])}, {10: (["C", "F"], [(0, 1, 1)])}, [(1, 10)])
    reactants = spark.createDataFrame([(1, 0, 20)], "tpl_id long, rct_idx int, reactant long")
    made = K.put_on(out, reactants, tables(spark, {20: (["N", drawn], [(0, 1, 1)])})[2]).first()
    assert made.atoms == (["N", "F"] if hit else ["N", drawn])


def test_backout_templates_that_cannot_be_read(spark):
    mols = {1: (["C"], []), 2: (["[R1]", "[R2]"], [(0, 1, 1)]), 3: (["C", "[R1]", "C"], [(0, 1, 1), (1, 2, 1)]), 4: (["C"] + ["[R1]"] * 11, [(0, k, 1) for k in range(1, 12)]),
            5: (["C", "[R1]", "[R2]", "[R3]"], [(0, 1, 1), (2, 3, 1)]), 6: (["C", "X"], [(0, 1, 1)])}
    good, bad = K.templates(tables(spark, mols)[2])
    assert [r.tpl_id for r in good.collect()] == [6]
    assert {r.tpl_id: r.reason for r in bad.collect()} == {1: "no R-site", 2: "nothing but R-sites", 3: "an R-site is not at an end", 4: "more than 10 R-sites", 5: "an R-site hangs on another"}


def test_labelled_variants(spark):
    products = spark.createDataFrame([(1, "3, product"), (2, "no number")], "tpl_id long, label string")
    labels = [(1, 1, 0, "3a"), (1, 10, 0, "x"), (1, 10, 1, "3b, 80%"), (1, 10, 2, "3c"), (1, 11, 0, "4a"), (1, 12, 0, "3d"), (1, 12, 1, "R1 = Me"), (1, 12, 2, "R2=Et"), (1, 13, 0, None), (2, 10, 0, "any")]
    out = K.labelled(products, spark.createDataFrame(labels, "tpl_id long, mol_id long, place int, text string"))
    assert sorted((r.tpl_id, r.mol_id, r.label, r.name, r.value) for r in out.collect()) == [
        (1, 10, "3b, 80%", None, None), (1, 12, "3dR1 = Me", "R1", "Me"), (1, 12, "3dR2=Et", "R2", "Et"), (2, 10, "any", None, None)]


def sim_brute(sets, asked, least, most=1.0):
    out = {}
    for q, a in asked.items():
        for v, b in sets.items():
            u = len(a | b)
            s = len(a & b) / u if u else 0.0
            if q != v and least <= s <= most:
                out[q, v] = round(s, 9)
    return out


@pytest.mark.parametrize("width, dense, least", [(64, 0.5, 0.4), (64, 0.5, 0.75), (40, 0.6, 0.8), (100, 0.5, 0.85), (300, 0.05, 0.5), (64, 0.5, 0.0), (70, 0.9, 1.0)])
def test_similarity_by_all_ways(spark, width, dense, least):
    rnd = random.Random(width)
    sets = {v: {b for b in range(width) if rnd.random() < dense} for v in range(90)}
    for v in range(90, 120):  # near copies
        sets[v] = sets[v - 90] ^ set(rnd.sample(range(width), rnd.randrange(4)))
    sets[200] = set()
    sets[201] = set()
    df = spark.createDataFrame([(v, sorted(b)) for v, b in sets.items()], "vec_id long, bits array<int>")
    want = sim_brute(sets, {v: b for v, b in sets.items() if v % 3 == 0}, least)
    for method in ("prefix", "segments", "blocks", None):
        if least <= 0 and method in ("prefix", "segments"):
            continue
        got = S.search(df, df.filter("vec_id % 3 = 0"), least, method=method).collect()
        assert {(r.query_id, r.vec_id): round(r.similarity, 9) for r in got} == want, method
        assert len(got) == len(want)


def test_index_meets_few_pairs(spark):
    """Dense random sets: at 0.75 the segments' candidates are under a hundredth of all pairs; at 0.5 no index pays, so blocks are compared."""
    rnd = random.Random(9)
    df = spark.createDataFrame([(v, sorted(b for b in range(64) if rnd.random() < 0.5)) for v in range(600)], "vec_id long, bits array<int>")
    held = S.packed_bits(df, 1)
    assert S.pigeonhole_candidates(held, held, 0.75, 64).filter("query_id <> vec_id").count() < 0.01 * 600 * 599
    assert S.method_for(df, df, 0.8, 64) == "segments" and S.method_for(df, df, 0.5, 64) == "blocks"
    sparse = spark.createDataFrame([(v, sorted(rnd.sample(range(4000), 12))) for v in range(900)], "vec_id long, bits array<int>")
    assert S.method_for(sparse, sparse, 0.8, 4000) == "prefix"


@pytest.mark.parametrize("text, reason", [
    ("((C9999)9999)9999", "more than 10000 atoms"), ("((C9999)9999)9", "more than 10000 atoms"), ("((((((((C9999)9999)9999)9999)9999)9", "brackets that do not close"),
    ("(((((C9999)9999)9999)9999)9999)9999", "more than 10000 atoms"), ("((C9999)9999)0", "more than 10000 atoms"), ("C" * 3000, "more than 2000 characters"), ("C?H", "characters of no token"), ("C12345", "a count of more than 4 digits"), (None, "no text")])
def test_formulas_that_stand_for_too_much(spark, text, reason):
    df = spark.createDataFrame([(1, text), (2, "C2H6")], "id long, formula string")
    assert [(r.id, r.reason) for r in G.formula_rejects(df).collect()] == [(1, reason)]
    assert sorted((r.id, r.symbol, r.n) for r in G.formula_counts(df).collect()) == [(2, "C", 2), (2, "H", 6)]
    assert [r.a for r in df.orderBy("id").select(C.formula_atoms(F.col("formula")).alias("a")).collect()] == [None, ["C", "H", "H", "H", "C", "H", "H", "H"]]


def test_substructure_candidates_are_few(spark):
    """Copies are one class, and a pair is made only where the query's rarest path is."""
    chain = lambda s, o=1: (list(s), [(i, i + 1, o) for i in range(len(s) - 1)])
    records = {m: chain("CCNCO" if m % 50 == 0 else "CNCOC") for m in range(200)} | {m: (["C"], []) for m in range(200, 400)}
    asked = {1000: chain("CCNC"), 1001: chain("OCNCC"), 1002: chain("CCNC"), 1003: chain("CCNC", 5)}
    found, members = R.classes(tables(spark, records)[2])
    assert sorted((r.mol_id, r.copies) for r in found.collect()) == [(0, 4), (1, 196), (200, 200)]
    assert members.count() == 400
    some, of = R.classes(tables(spark, asked)[2])
    assert sorted((r.mol_id, r["class"]) for r in of.collect()) == [(1000, 1000), (1001, 1001), (1002, 1000), (1003, 1000)]
    pairs = R.substructure_candidates(some, found, ["copies"]).select("query_id", "mol_id", "copies").collect()
    assert sorted(map(tuple, pairs)) == [(1000, 0, 4), (1001, 0, 4)]
    assert sorted(map(tuple, R.substructures(some, found, ["copies"]).collect())) == [(1000, 0, 4, 1), (1001, 0, 4, 1)]


def test_labels_by_page_and_renamed_targets(spark):
    """Labels of a page serve all its templates; a name that the core has is found in a target that lacks the core before it is renamed."""
    products = spark.createDataFrame([(1, 7, "1a"), (2, 7, "2a")], "tpl_id long, page long, label string")
    labels = spark.createDataFrame([(7, 1, 0, "1a"), (7, 2, 0, "2a"), (7, 3, 0, "1c"), (7, 3, 1, "R1 = Ph"), (7, 4, 0, None), (8, 5, 0, "1d")], "page long, mol_id long, place int, text string")
    asked = K.labelled(products, labels, "page")
    assert [tuple(r) for r in asked.collect()] == [(1, 3, "1cR1 = Ph", "R1", "Ph")]
    tpls, _ = K.templates(tables(spark, {1: (["C", "[Ph]", "[R2]"], [(0, 1, 1), (0, 2, 1)])})[2])
    mols = tables(spark, {3: (["C", "[R1]", "O"], [(0, 1, 1), (0, 2, 1)]), 4: (["C", "N", "O"], [(0, 1, 1), (0, 2, 1)])})[2]
    variants = asked.unionByName(spark.createDataFrame([(1, 3, "x", "R1", "Et"), (1, 4, "y", None, None), (1, 3, "z", None, None)], asked.schema))
    assert [tuple(r) for r in K.group_texts(K.read_groups(tpls, mols, variants)).collect()] == [(1, 3, "1cR1 = Ph", "[2*]", "O")]


@pytest.mark.parametrize("by", ["page", "tpl_id"])
def test_labelled_molecules_are_read_as_by_pairs(spark, by):
    """Templates and targets that meet once by number give what a row for each pair gives, renamed ones included; the texts of a molecule are read once a number, however many templates have it."""
    rnd = random.Random(7)
    mols = {m: random_mol(rnd, rnd.randrange(1, 7), ["C", "C", "N", "O", "[R1]", "[R2]", "[Ph]"], 1) for m in range(60)}
    packed = R.cut(tables(spark, mols)[2])
    tpls, rejects = K.templates(packed)
    tpls = R.cut(tpls)
    ids = [r.tpl_id for r in tpls.collect()]
    assert 5 < len(ids) and sorted(ids + [r.tpl_id for r in rejects.collect()]) == sorted(mols)
    products = spark.createDataFrame([(t, t % 2, f"{t % 3 or ''}a") for t in ids], "tpl_id long, page long, label string")
    texts = lambda m: [(0, f"{m % 3}b"), (1, rnd.choice(["R1 = Ph", "R2=N", "x", None])), (2, "R1 = C" if m % 5 == 0 else f"{m % 3}c")]
    beside = [(t, m, place, text) for t in (ids if by == "tpl_id" else (0, 1)) for m in mols for place, text in texts(m)]
    labels = spark.createDataFrame(beside, f"{by} long, mol_id long, place int, text string")
    products = products if by == "page" else products.drop("page")
    want = K.group_texts(K.read_groups(tpls, packed, K.labelled(products, labels, by)))
    got = K.group_texts(K.read_labelled(tpls, packed, products, labels, by))
    assert got.columns == want.columns and not got.isEmpty() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    asked = K._asked(products, labels, by)[1]
    assert asked.count() == asked.select(by, "number", "mol_id").distinct().count()
    if by == "page":
        assert asked.count() <= 2 * 3 * len(mols) < K.labelled(products, labels, by).count()


def test_blocks_keep_the_best(spark, monkeypatch):
    """Records over many blocks and queries over many batches: the best of each block hold the best of all, ties to the lowest id, and no block is a row."""
    monkeypatch.setattr(S, "BLOCK", 16)
    rnd = random.Random(4)
    sets = spark.createDataFrame([(i, sorted(rnd.sample(range(20), rnd.randrange(0, 9)))) for i in range(150)], "vec_id long, bits array<int>")
    asked = sets.filter("vec_id % 4 = 0")
    whole = S.search(sets, asked, 0.2, method="blocks")
    few = S.search(sets, asked, 0.2, method="blocks", best=3)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(S.top_n(few, 3)) == rows(S.top_n(whole, 3))
    assert few.count() < whole.count()
    assert rows(whole) == rows(S.search(sets, asked, 0.2, method="prefix"))


def shuffled_by(df):
    """The columns that a query's shuffles go by."""
    return set(re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString()))


def test_bonds_and_scores_stay_with_their_molecule(spark, sf):
    """Rows that are dealt by molecule are not shuffled again, and directions do not meet in a join."""
    from figweave.plans import QUERIES

    df = QUERIES["bond_scores"](spark, sf)
    assert shuffled_by(df) == {"l_orderkey"} and "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert shuffled_by(QUERIES["mol_confidence"](spark, sf)) == {"l_orderkey"}


def test_confidence_folds_a_molecule(spark, sf, tmp_path):
    """One shuffle in all; neither tokens nor classes of bonds become rows, and nothing is joined. Rows without a molecule have no bonds."""
    from figweave.plans import QUERIES

    plan = QUERIES["mol_confidence"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("Exchange hashpartitioning(l_orderkey") == 1
    assert plan.count("Sort [") == 1 and "Join" not in plan and "Generate" not in plan and "HashAggregate(keys=[mol_id" in plan
    row = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string"
    spark.createDataFrame([(key, 5, i, i, 5.0, 1.0, 0.05, "N") for key in (None, 7) for i in range(3)], row).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r.mol_id: tuple(r)[1:] for r in QUERIES["mol_confidence"](spark, str(tmp_path)).collect()}
    assert found[None] == (None, None, 1.0, None) and None not in found[7] and found[7][2] < 1 and len(found) == 2


def test_folded_confidence_as_by_rows(spark):
    """Nulls, zeros, repeated values, atoms without tokens, molecules without bonds or tokens."""
    rnd = random.Random(8)
    some = lambda n: [rnd.choice([None, 0.0, *[rnd.random() for _ in range(30)]]) for _ in range(rnd.randrange(n))]
    mols = [(m, [some(5) for _ in range(rnd.randrange(6))], rnd.choice([None, some(7)])) for m in range(80)] + [(80, None, [0.5]), (81, [[0.5], [None]], []), (82, [[None]], [None])]
    df = spark.createDataFrame(mols, "mol_id long, tokens array<array<double>>, scores array<double>")
    tokens = df.select("mol_id", F.posexplode("tokens").alias("atom_idx", "t")).select("mol_id", "atom_idx", F.explode("t").alias("p"))
    scores = df.select("mol_id", F.posexplode("scores").alias("i", "score")).select("mol_id", "i", F.lit(0).alias("j"), "score")
    rows = lambda d: {r.mol_id: [v if v is None else round(v, 12) for v in tuple(r)[1:]] for r in d.collect()}
    want = rows(G.confidence(tokens, scores))
    atoms = df.select("mol_id", F.explode("tokens").alias("tokens"), F.lit(None).cast("array<double>").alias("scores"))
    edges = df.select("mol_id", F.lit(None).cast("array<double>").alias("tokens"), F.explode(F.array(F.slice("scores", 1, 3), F.slice("scores", 4, 9))).alias("scores"))
    assert rows(G.folded_confidence(atoms.union(edges))) == want and len(want) > 50 and want[82] == [None, None, 1.0, None]


def test_symmetric_scores_brute(spark):
    """Rows without the other direction, self loops, repeated rows, ties and nulls."""
    rnd = random.Random(5)
    rows = [(m, rnd.randrange(4), rnd.randrange(4), rnd.randrange(7), rnd.randrange(6) / 8) for m in (1, 2, 3) for _ in range(150)] + [(1, None, 2, 0, 0.9), (None, 1, 1, 0, 0.9), (2, 1, 2, 0, None)]
    want, swap = {}, {5: 6, 6: 5}
    for m, i, j, k, p in rows:
        for n, a, b, c, q in rows:
            if None not in (m, i, j, p, q) and (m, i, j, k) == (n, b, a, swap.get(c, c)):
                want[m, i, j] = max(want.get((m, i, j), (-1.0, 0)), ((p + q) / 2, -k))
    out = G.symmetric_scores(spark.createDataFrame(rows, "mol_id long, i int, j int, k int, p double")).collect()
    assert {(r.mol_id, r.i, r.j): (r.score, -r.order) for r in out} == want and len(out) == len(want)


def test_edges_of_odd_bonds(spark):
    """Bonds to unknown atoms or nulls go; repeated atoms do not repeat bonds, repeated bonds stay."""
    atoms = spark.createDataFrame([(1, 0, "C"), (1, 0, "C"), (1, 1, "N"), (1, None, "X"), (2, 5, "C")], "mol_id long, atom_idx long, symbol string")
    bonds = spark.createDataFrame([(1, 0, 1, 5), (1, 0, 1, 5), (1, 0, 2, 1), (2, 0, 5, 1), (1, None, 0, 1), (2, 5, 5, None), (3, 0, 1, 1)], "mol_id long, src int, dst int, order int")
    out = G.edges_of(atoms, bonds)
    assert sorted(((r.mol_id, r.a, r.b, r.order) for r in out.collect()), key=str) == [(1, 0, 1, 5), (1, 0, 1, 5), (1, 1, 0, 6), (1, 1, 0, 6), (2, 5, 5, None), (2, 5, 5, None)]
    assert out.dtypes == [("mol_id", "bigint"), ("a", "int"), ("b", "int"), ("order", "int")]
