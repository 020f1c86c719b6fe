"""Molecule tables as graphs: atoms(mol_id, atom_idx, symbol) and bonds(mol_id, src, dst, order)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figweave.functions.chemistry import FRAGMENTS, MASSES, bare, expand_symbol, formula_problem, symbol_counts, without_locants
from figweave.functions.lineage import cut
from figweave.operators.graphs import packed, united


#: Fixed value: an R-group equation.
EQUATION = r"([RXY]\d?) *= *(\w+)"


def directed(bonds: DataFrame) -> DataFrame:
    """(mol_id, a, b, order) in both directions; a wedge's other direction is 11 - order. graphs.packed leaves out what has no known atom at an end."""
    back = F.when(F.col("order") > 4, 11 - F.col("order")).otherwise(F.col("order"))
    edge = lambda a, b, o: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), o.alias("order"))
    return bonds.select("mol_id", F.explode(F.array(edge("src", "dst", F.col("order")), edge("dst", "src", back))).alias("e")).select("mol_id", "e.*")


def edges_of(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(mol_id, a, b, order) in both directions between known atoms; a wedge's other direction is 11 - order.

    Atoms and bonds lie in one table and meet in windows, which tables that are partitioned by mol_id need no shuffle for; a join on the atom too would shuffle both again.
    """
    kinds = {c: bonds.schema[c].dataType for c in ("src", "dst")}
    drawn = bonds.filter("mol_id is not null and src is not null and dst is not null").select("mol_id", "src", "dst", "order", F.lit(False).alias("atom"))
    ends = atoms.select("mol_id", F.col("atom_idx").alias("src"), F.col("atom_idx").alias("dst"), F.lit(None).cast(bonds.schema["order"].dataType).alias("order"), F.lit(True).alias("atom"))
    rows = drawn.union(ends)
    for c in ("src", "dst"):
        rows = rows.withColumn("known", F.max("atom").over(W.partitionBy("mol_id", c))).filter("known").drop("known")
    return directed(rows.filter("not atom").withColumns({c: F.col(c).cast(t) for c, t in kinds.items()}))


def best_class(there: list[Column], back: list[Column]) -> Column:
    """(m, k) of the seven classes of a pair in one direction and in the other: classes 0-4 averaged over both, 5 with the other's 6; the best mean `m` and its class less than zero, `k` = -class (lowest on ties)."""
    swap = {5: 6, 6: 5}
    means = F.array(*[F.struct(((there[k] + back[swap.get(k, k)]) / 2).alias("m"), F.lit(-k).alias("k")) for k in range(7)])
    best = F.array_max(means)  # nulls are least
    return F.when(best["m"].isNotNull(), best)


def symmetric_scores(scores: DataFrame) -> DataFrame:
    """scores(mol_id, i, j, k, p): classes 0-4 averaged over both directions, 5 with the other direction's 6; per pair the best class (lowest on ties) and its score.

    Both directions of a pair are one group, with a column for each direction and class: fewer bytes than a join of the rows with themselves, and no shuffle where they are partitioned by mol_id.
    """
    pair = scores.filter("mol_id is not null and i is not null and j is not null").withColumn("lo", F.least("i", "j")).withColumn("hi", F.greatest("i", "j"))
    p = {(d, k): F.max(F.when((F.col("i") <= F.col("j") if d == "f" else F.col("i") >= F.col("j")) & (F.col("k") == k), F.col("p"))) for d in "fb" for k in range(7)}
    found = pair.groupBy("mol_id", "lo", "hi").agg(*[v.alias(f"{d}{k}") for (d, k), v in p.items()])

    each = lambda d: [F.col(f"{d}{k}") for k in range(7)]
    best = lambda a, b: best_class(each(a), each(b))
    way = lambda i, j, b: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), b.alias("best"))
    there, back = way("lo", "hi", best("f", "b")), way("hi", "lo", best("b", "f"))
    rows = found.select("mol_id", F.explode(F.when(F.col("lo") == F.col("hi"), F.array(there)).otherwise(F.array(there, back))).alias("x")).filter("x.best is not null")
    return rows.select("mol_id", "x.i", "x.j", (-F.col("x.best.k")).cast(scores.schema["k"].dataType).alias("order"), F.col("x.best.m").alias("score"))


def geometric_mean(p: Column) -> Column:
    return F.when(F.min(p) <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(p))))


def root_product(p: Column) -> Column:
    return F.when(F.min(p) <= 0, F.lit(0.0)).otherwise(F.exp(F.sum(F.ln(p)) / 2))


def confidence(tokens: DataFrame, edge_scores: DataFrame) -> DataFrame:
    """tokens(mol_id, atom_idx, p), edge_scores(mol_id, i, j, score): per molecule the mean atom score, the average token score, the root of the product of all edge scores, and overall."""
    atoms = tokens.groupBy("mol_id", "atom_idx").agg(geometric_mean(F.col("p")).alias("atom"), F.sum("p").alias("s"), F.count("*").alias("n"))
    mols = atoms.groupBy("mol_id").agg(F.avg("atom").alias("atom_score"), (F.sum("s") / F.sum("n")).alias("token_score"))
    product = edge_scores.groupBy("mol_id").agg(root_product(F.col("score")).alias("edge_score"))
    out = mols.join(product, "mol_id", "left").withColumn("edge_score", F.coalesce("edge_score", F.lit(1.0)))
    return out.withColumn("overall", F.col("token_score") * F.col("edge_score"))


def folded_confidence(rows: DataFrame) -> DataFrame:
    """confidence() of rows(mol_id, tokens, scores) that hold the p of an atom's tokens, scores of edges, or both; null for none. Rows that are partitioned by mol_id are not shuffled, and nothing is joined."""
    fold = lambda v, f=lambda x: x: F.aggregate(v, F.lit(0.0), lambda a, x: a + F.coalesce(f(x), F.lit(0.0)))
    rows = rows.withColumn("known", F.size(F.array_compact("tokens"))).withColumn("low", F.array_min("scores"))
    atom = F.when(F.array_min("tokens") <= 0, F.lit(0.0)).when(F.col("known") > 0, F.exp(fold(F.col("tokens"), F.ln) / F.col("known")))
    rows = rows.select("mol_id", "low", atom.alias("atom"), F.when(F.col("known") > 0, fold(F.col("tokens"))).alias("s"), F.size("tokens").alias("n"), F.when(F.col("low").isNotNull(), fold(F.col("scores"), F.ln)).alias("logs"))
    mols = rows.groupBy("mol_id").agg(F.avg("atom").alias("atom_score"), F.sum("s").alias("s"), F.sum(F.when(F.col("n") > 0, F.col("n"))).alias("n"), F.min("low").alias("low"), F.sum("logs").alias("logs"))
    edge = F.when(F.col("low") <= 0, F.lit(0.0)).otherwise(F.exp(F.col("logs") / 2))
    out = mols.filter("n is not null").select("mol_id", "atom_score", (F.col("s") / F.col("n")).alias("token_score"), F.coalesce(edge, F.lit(1.0)).alias("edge_score"))
    return out.withColumn("overall", F.col("token_score") * F.col("edge_score"))


def normalise_points(points: DataFrame, flip_y: bool = True) -> DataFrame:
    """points(mol_id, atom_idx, x, y) min-max scaled per molecule, spans of at least 1e-6, y flipped."""
    w = W.partitionBy("mol_id")
    scale = lambda c: (F.col(c) - F.min(c).over(w)) / F.greatest(F.max(c).over(w) - F.min(c).over(w), F.lit(1e-6))
    y = (F.max("y").over(w) - F.col("y")) / F.greatest(F.max("y").over(w) - F.min("y").over(w), F.lit(1e-6)) if flip_y else scale("y")
    return points.select("mol_id", "atom_idx", scale("x").alias("x"), y.alias("y"))


def from_grid(cells: DataFrame, bins: int) -> DataFrame:
    """(mol_id, atom_idx, x, y, symbol) of grid cells (mol_id, gx, gy, symbol), column by column."""
    place = F.row_number().over(W.partitionBy("mol_id").orderBy("gx", "gy")) - 1
    return cells.select("mol_id", place.alias("atom_idx"), (F.col("gx") / F.lit(bins - 1.0)).alias("x"), (F.col("gy") / F.lit(bins - 1.0)).alias("y"), "symbol")


def is_element() -> Column:
    return F.regexp_like("symbol", F.lit("^[A-Z][a-z]?$"))


def formulas(atoms: DataFrame) -> DataFrame:
    """(mol_id, formula) of explicit element atoms: C, H, then by name."""
    n = atoms.filter(is_element()).groupBy("mol_id", "symbol").agg(F.count("*").alias("n"))
    rank = F.when(F.col("symbol") == "C", 0).when(F.col("symbol") == "H", 1).otherwise(2)
    part = F.concat("symbol", F.when(F.col("n") > 1, F.col("n").cast("string")).otherwise(F.lit("")))
    parts = n.groupBy("mol_id").agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "symbol", part.alias("p")))).alias("all"))
    found = parts.select("mol_id", F.array_join(F.transform("all", lambda x: x["p"]), "").alias("formula"))
    return atoms.select("mol_id").distinct().join(found, "mol_id", "left").select("mol_id", F.coalesce("formula", F.lit("")).alias("formula"))


def counts(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Per molecule: atoms, bonds, heavy atoms, R-sites, pseudoatoms and formula."""
    site = F.regexp_like("symbol", F.lit(r"^\[R\d*\]$"))
    a = atoms.groupBy("mol_id").agg(F.count("*").alias("n_atoms"), F.count_if(is_element() & (F.col("symbol") != "H")).alias("n_heavy"), F.count_if(site).alias("n_sites"),
                                    F.count_if(~site & ~is_element()).alias("n_pseudo"))
    b = bonds.groupBy("mol_id").agg(F.count("*").alias("n_bonds"))
    return a.join(b, "mol_id", "left").join(formulas(atoms), "mol_id").na.fill(0, ["n_bonds"])


def degrees(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """(mol_id, atom_idx, degree, neighbours)."""
    near = edges.groupBy("mol_id", F.col("a").alias("atom_idx")).agg(F.sort_array(F.collect_list("b")).alias("near"))
    return atoms.join(near, ["mol_id", "atom_idx"], "left").select("mol_id", "atom_idx", F.coalesce(F.size("near"), F.lit(0)).alias("degree"), F.coalesce(F.array_join("near", ","), F.lit("")).alias("neighbours"))


def weights(atoms: DataFrame) -> DataFrame:
    """(mol_id, weight, carbon_share) over explicit atoms with a known mass."""
    table = atoms.sparkSession.createDataFrame(list(MASSES.items()), "symbol string, mass double")
    mass = F.sum("mass")
    return atoms.join(F.broadcast(table), "symbol").groupBy("mol_id").agg(mass.alias("weight"), (F.sum(F.when(F.col("symbol") == "C", F.col("mass")).otherwise(0.0)) / mass).alias("carbon_share"))


def components(nodes: DataFrame, edges: DataFrame, group: str = "mol_id", limit: int = 256) -> DataFrame:
    """nodes(group, atom_idx) with `label`, the least atom reachable over edges(group, a, b) in both directions.

    Molecules of at most `limit` atoms become one row each, in one shuffle, and are united by a fold over their bonds. Larger ones, found by a count when this is called, go through label propagation, whose rounds are
    joins: `limit` only says which way, never what comes out.
    """
    large = nodes.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(group)
    if large.isEmpty():
        return folded_components(nodes, edges, group)
    large = cut(large)
    of = lambda df, how: df.join(large, group, how)
    small = folded_components(of(nodes, "left_anti"), of(edges, "left_anti"), group)
    return small.unionByName(propagated_components(of(nodes, "left_semi"), of(edges, "left_semi"), group))


def folded_components(nodes: DataFrame, edges: DataFrame, group: str = "mol_id") -> DataFrame:
    """components() of molecules that fit a row."""
    mols = packed(nodes.select(group, "atom_idx", F.lit("").alias("symbol")), edges.select(group, "a", "b", F.lit(1).alias("order")), group)
    labels = F.transform(united(F.col("near")), lambda x: F.get("idx", x))
    rows = mols.select(group, F.explode(F.arrays_zip(F.col("idx").alias("i"), labels.alias("l"))).alias("x"))
    return rows.select(group, F.col("x.i").alias("atom_idx"), F.col("x.l").alias("label"))


def propagated_components(nodes: DataFrame, edges: DataFrame, group: str = "mol_id") -> DataFrame:
    """components() by label propagation with pointer jumping, for molecules of any size."""
    links = cut(edges.select(group, "a", "b"))
    state = cut(nodes.select(group, "atom_idx", F.col("atom_idx").alias("label")))
    while True:
        near = links.join(state.select(group, F.col("atom_idx").alias("b"), "label"), [group, "b"]).groupBy(group, F.col("a").alias("atom_idx")).agg(F.min("label").alias("near"))
        lower = state.join(near, [group, "atom_idx"], "left").select(group, "atom_idx", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = state.select(group, F.col("atom_idx").alias("label"), F.col("label").alias("end"))
        new = cut(lower.join(jump, [group, "label"], "left").select(group, "atom_idx", "old", F.least("label", "end").alias("label")))
        if not new.filter("label <> old").limit(1).count():
            return new.select(group, "atom_idx", "label")
        state = new.select(group, "atom_idx", "label")


def main_fragment(labels: DataFrame) -> DataFrame:
    """Atoms of the fragment with most atoms, the first on ties."""
    n = labels.groupBy("mol_id", "label").agg(F.count("*").alias("n"))
    best = n.groupBy("mol_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"))
    return labels.join(best, ["mol_id", "label"], "left_semi")


def pattern(atoms: DataFrame, edges: DataFrame, symbols: list[str], links: list[tuple[int, int]], limit: int = 8) -> DataFrame:
    """(mol_id, m0, m1, ..): all ordered matches of a small template; `*` matches any atom.

    links name template bonds in tree order: each adds an atom or closes a ring. One join on the shared atom per bond, labels filtered first.
    """
    if len(links) > limit:
        raise ValueError(f"a template has at most {limit} bonds")
    of = lambda k: (atoms if symbols[k] == "*" else atoms.filter(F.col("symbol") == symbols[k])).select("mol_id", F.col("atom_idx").alias(f"m{k}"))
    seen = [links[0][0]] if links else [0]
    rows = of(seen[0])
    for i, j in links:
        if i in seen and j in seen:
            rows = rows.join(edges.select("mol_id", F.col("a").alias(f"m{i}"), F.col("b").alias(f"m{j}")), ["mol_id", f"m{i}", f"m{j}"], "left_semi")
            continue
        old, new = (i, j) if i in seen else (j, i)
        rows = rows.join(edges.select("mol_id", F.col("a").alias(f"m{old}"), F.col("b").alias(f"m{new}")), ["mol_id", f"m{old}"]).join(of(new), ["mol_id", f"m{new}"], "left_semi")
        for k in seen:
            rows = rows.filter(F.col(f"m{k}") != F.col(f"m{new}"))
        seen.append(new)
    return rows.select("mol_id", *[f"m{k}" for k in range(len(symbols))])


def site_subsets(sites: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """(subsets, rejects) of sites(mol_id, n): every subset of 0..n-1 taken as hydrogen, smallest first, descending inside a size (mol_id, place, members); molecules with more than `limit` sites,
    which would make more than 2**limit rows each, are rejects (mol_id, n, reason)."""
    few = F.col("n") <= limit
    masks = sites.filter(few).withColumn("mask", F.explode(F.sequence(F.lit(0), F.expr("(1 << cast(n as int)) - 1"))))
    rows = masks.withColumn("members", F.expr("filter(if(n > 0, sequence(cast(n as int) - 1, 0, -1), array()), k -> getbit(mask, k) = 1)"))
    order = W.partitionBy("mol_id").orderBy(F.bit_count("mask"), F.desc("mask"))
    subsets = rows.select("mol_id", (F.row_number().over(order) - 1).alias("place"), F.array_join("members", ",").alias("members"))
    return subsets, sites.filter(~few).select("mol_id", "n", F.lit(f"more than {limit} sites").alias("reason"))


def assignments(texts: DataFrame) -> DataFrame:
    """texts(image_id, box_idx, text): the first `R1 = Me` of each text, distinct by (name, value) in first-seen order; each is a new reaction. (image_id, rxn_idx, name, value)."""
    found = texts.select("image_id", "box_idx", F.regexp_extract("text", r"([RXY]\d?) *= *(\w+)", 1).alias("name"), F.regexp_extract("text", r"([RXY]\d?) *= *(\w+)", 2).alias("value")).filter("name <> ''")
    first = found.groupBy("image_id", "name", "value").agg(F.min("box_idx").alias("at"))
    return first.select("image_id", F.row_number().over(W.partitionBy("image_id").orderBy("at", "name", "value")).alias("rxn_idx"), "name", "value")


def equations(texts: DataFrame) -> DataFrame:
    """texts(image_id, box_idx, text): all that a text says of its R-groups, `R1 = Me, R2 = Et`, in order. (image_id, box_idx, ordinal, name, value)."""
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(EQUATION), 1).alias("name"), F.regexp_extract_all("text", F.lit(EQUATION), 2).alias("value"))
    return texts.select("image_id", "box_idx", F.posexplode(found).alias("ordinal", "e")).select("image_id", "box_idx", "ordinal", "e.name", "e.value")


def substitute(atoms: DataFrame, assigned: DataFrame) -> DataFrame:
    """A copy of the molecule's atoms for each assignment (mol_id, rxn_idx, name, value): the symbol is the value where its bare name is the one assigned."""
    rows = atoms.join(assigned, "mol_id")
    hit = bare(F.col("symbol")) == F.col("name")
    return rows.select("mol_id", "rxn_idx", "atom_idx", F.when(hit, F.concat(F.lit("["), "value", F.lit("]"))).otherwise(F.col("symbol")).alias("symbol"))


def substitute_nested(symbol: Column, mapping: dict[str, str]) -> Column:
    """R-group names inside symbols replaced, longest name first, the group without its locants: [SO2Ar] with Ar = 2-ClC6H4 gives [SO2ClC6H4]."""
    for name in sorted(mapping, key=len, reverse=True):
        symbol = F.regexp_replace(symbol, f"{name}(?![a-z0-9])", without_locants(F.lit(mapping[name].replace("$", r"\$"))))
    return symbol


def expand_abbreviations(atoms: DataFrame) -> DataFrame:
    """atoms with `fragment`: SMILES text of abbreviations, R symbols and others."""
    table = atoms.sparkSession.createDataFrame(list(FRAGMENTS.items()), "name string, known string")
    return atoms.withColumn("name", bare(F.col("symbol"))).join(F.broadcast(table), "name", "left").select("mol_id", "atom_idx", "symbol", expand_symbol(F.col("symbol"), F.col("known")).alias("fragment"))


def formula_counts(texts: DataFrame) -> DataFrame:
    """texts(id, formula): how often each symbol occurs in a condensed formula, brackets to any depth. (id, symbol, n). What is no formula gives no rows; see formula_rejects."""
    found = texts.select("id", F.explode(symbol_counts(F.col("formula"))).alias("s"))
    return found.groupBy("id", F.col("s.symbol").alias("symbol")).agg(F.sum("s.n").alias("n"))


def formula_rejects(texts: DataFrame) -> DataFrame:
    """texts that are no condensed formula, with the `reason`: too long, a count of too many digits, other characters, brackets that do not close, too many atoms."""
    return texts.withColumn("reason", formula_problem(F.col("formula"))).filter("reason is not null")


def signatures(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    """(mol_id, key): sorted atom and bond lists. Equal molecules have equal keys, not the other way round."""
    a = atoms.groupBy("mol_id").agg(F.array_join(F.sort_array(F.collect_list("symbol")), ",").alias("ka"))
    named = edges.join(atoms.select("mol_id", F.col("atom_idx").alias("a"), F.col("symbol").alias("sa")), ["mol_id", "a"]).join(atoms.select("mol_id", F.col("atom_idx").alias("b"), F.col("symbol").alias("sb")), ["mol_id", "b"])
    b = named.groupBy("mol_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat("sa", F.col("order").cast("string"), "sb"))), ",").alias("kb"))
    return a.join(b, "mol_id", "left").select("mol_id", F.concat("ka", F.lit("|"), F.coalesce("kb", F.lit(""))).alias("key"))
