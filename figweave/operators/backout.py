"""R-groups read from products by a reaction's template and put on its reactants.

A template is a product drawn with R-sites: atoms at an end of the molecule, named R1, Ar, X and so on. A target is another product of the same kind. The template's core is found in the target, what is
left of it in fragments are the R-groups, and these replace the R-sites of the reaction's reactants. Connectivity and bond orders only: no aromaticity, no stereochemistry, wedges are single bonds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figweave.functions.chemistry import bare
from figweave.functions.lineage import cut
from figweave.operators.graphs import embeddings, plain, plan, screened, spread, steps, united

#: What an R-site is called, and the names that stand for each other.
SITE = r"^(R\d*|R[a-df']|\d+\*|[XYZQAE]|Ar[12i]?)$"
ALIASES = (("[1*]", "[7*]"), ("[7*]", "[1*]"), ("[1*]", "[Rf]"), ("[Rf]", "[1*]"))
_SITES = "array<struct<name:string,place:int,at:int,o:int>>"


def site_name(symbol: Column) -> Column:
    """[R3] and 3* become [3*], other R-sites their name in brackets; null for all other symbols."""
    name = F.regexp_replace(bare(symbol), r"^R(\d+)$", "$1*")
    return F.when(F.regexp_like(bare(symbol), F.lit(SITE)), F.concat(F.lit("["), name, F.lit("]")))


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def templates(mols: DataFrame, limit: int = 10) -> tuple[DataFrame, DataFrame]:
    """(templates, rejects) of packed molecules (graphs.packed): tpl_id, core (places in the order of their steps), size, core_steps and sites (name, place, at: the core step it hangs on, o).

    Rejects (tpl_id, reason): no R-site; more than `limit` of them; a site that is not at an end, or hangs on another site; nothing but sites.
    """
    rows = cut(plain(mols).select(F.col("mol_id").alias("tpl_id"), "names", "near", F.transform("names", site_name).alias("site")))
    # what keeps a molecule from being a template is read before its core is put in order
    held = F.filter(F.transform("site", lambda s, i: F.when(s.isNotNull(), F.struct(F.size(F.get("near", i)).alias("n"), F.get(F.get("near", i), F.lit(0))["at"].alias("at")))), lambda h: h.isNotNull())
    rows = rows.withColumn("held", held)
    reason = (F.when(F.size("held") == 0, "no R-site").when(F.size("held") > limit, f"more than {limit} R-sites").when(F.size("held") == F.size("names"), "nothing but R-sites")
              .when(~F.forall("held", lambda h: h["n"] == 1), "an R-site is not at an end").when(F.exists("held", lambda h: F.get("site", h["at"]).isNotNull()), "an R-site hangs on another"))
    rows = rows.withColumn("reason", reason)
    places = F.transform("names", lambda _, i: i)
    # written, so that no later expression computes it again
    good = cut(rows.filter("reason is null").select("tpl_id", "names", "near", "site", plan(F.col("near"), F.filter(places, lambda i: F.get("site", i).isNull())).alias("core")))
    named = F.transform(F.filter(places, lambda i: F.get("site", i).isNotNull()), lambda i: let(F.get(F.get("near", i), F.lit(0)), lambda e: F.struct(
        F.get("site", i).alias("name"), i.alias("place"), (F.array_position("core", e["at"]) - 1).cast("int").alias("at"), e["o"].alias("o"))))
    good = good.select("tpl_id", "core", F.size("names").alias("size"), steps(F.col("core"), F.col("names"), F.col("near")).alias("core_steps"), named.cast(_SITES).alias("sites"))
    return good, rows.filter("reason is not null").select("tpl_id", "reason")


def labelled(products: DataFrame, labels: DataFrame, by: str = "tpl_id") -> DataFrame:
    """(tpl_id, mol_id, label, name, value): the molecules that a reaction's product label asks for.

    products(tpl_id, by, label): the template's own first label. labels(by, mol_id, place, text): all labels of molecules beside it; templates that share a page share its labels if `by` is the page. A molecule is asked for if one of its texts
    holds the product's number followed by letters; the first such text is its label. Each of its texts that says what an R-group is (`R1 = Me`) gives a variant of its own, with that text behind the label, name and value; without one there is
    a single variant. The template itself is left out.
    """
    own, asked = _asked(products, labels, by)
    found = asked.join(own, list(dict.fromkeys((by, "number")))).filter("mol_id <> tpl_id")
    return _variants(found, "tpl_id", "mol_id").select("tpl_id", "mol_id", "label", "name", "value")


def _asked(products: DataFrame, labels: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(own, asked): own(by, tpl_id, number); asked(by, number, mol_id, label, said) for each number of a template's beside the molecule that one of its texts holds with letters behind. Templates with one number ask for the same, so texts are read once a number."""
    number = F.coalesce(F.regexp_extract("label", r"\d+", 0), F.lit(""))
    own = products.select(*dict.fromkeys((by, "tpl_id")), number.alias("number"))
    equation = lambda k: F.regexp_extract("text", r"([RXY]\d?) *= *(\w+)", k)
    # a null text reads as an empty one, which neither fits, as letters are asked for, nor says anything
    texts = labels.filter("text is not null").groupBy(by, "mol_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "text"))).alias("texts"),
        F.sort_array(F.collect_list(F.when(equation(1) != "", F.struct("place", "text", equation(1).alias("name"), equation(2).alias("value"))))).alias("said"))
    fits = F.get(F.filter("texts", lambda t: F.regexp_like(t["text"], F.concat(F.col("number"), F.lit("[a-zA-Z]+")))), F.lit(0))["text"]
    # an explode, so that a filter does not read the texts a second time
    label = F.explode(F.filter(F.array(fits), lambda t: t.isNotNull()))
    return own, texts.join(own.select(by, "number").distinct(), by).select(by, "number", "mol_id", "said", label.alias("label"))


def _variants(found: DataFrame, *keep: str) -> DataFrame:
    """A row for each thing that a text says: (keep.., label, name, value)."""
    rows = found.select(*keep, "label", F.explode_outer("said").alias("e"))
    return rows.select(*keep, F.concat("label", F.coalesce("e.text", F.lit(""))).alias("label"), "e.name", "e.value")


def _core_screen(tpls: DataFrame) -> DataFrame:
    """(tpl_id, c0, core_names): the bits that the paths of the core set, and its symbols."""
    links = F.transform("core_steps", lambda s, k: F.concat(s["links"], F.flatten(F.transform("core_steps", lambda t, j: F.transform(F.filter(t["links"], lambda e: e["at"] == k), lambda e: F.struct(j.alias("at"), e["o"].alias("o")))))))
    cores = screened(tpls.select("tpl_id", F.transform("core_steps", lambda s: s["name"]).alias("names"), links.cast("array<array<struct<at:int,o:int>>>").alias("near")))
    return cores.select("tpl_id", F.col("s0").alias("c0"), F.array_distinct("names").alias("core_names"))


def read_groups(tpls: DataFrame, mols: DataFrame, variants: DataFrame) -> DataFrame:
    """variants (tpl_id, mol_id, label, name, value) that the template explains, with the packed target (names, near), `inside` (places that are no core) and `groups`, one a site in order of the template's places:
    (name, attach): the target's place that the group hangs on the core with, null for hydrogen.

    The core is embedded in all ways. Taking it out leaves fragments; as many sites as there are fragments keep one each, by an atom beside the site's place with the site's bond order, the others are hydrogen. Ways compete in this order: fewest hydrogens; among
    them the sites with the greater places taken as hydrogen, from the last; then the least places by the template's order. So variants of the template with ever more hydrogens are tried until one fits. A target in parts that are not linked is
    first narrowed to the first part that holds the whole template, if there is one. A name and value rename the target's R-group before.

    All of this is folds inside one row a variant; nothing is shuffled but the joins by template and target. Before they meet, a target that lacks one of the core's paths is left out by 64 bits of both, unless a variant gives its atoms a name that the core has.
    """
    # a new name finds more only where the core has it
    found = variants.join(_core_screen(tpls), "tpl_id").withColumn("finds", _finds()).drop("core_names")
    rows = found.join(_targets(mols), "mol_id").filter(_holds() | (F.col("finds") & F.coalesce(F.exists("names", _meant), F.lit(False)))).drop("c0", "s0", "finds")
    return _read(spread(rows, "tpl_id").join(tpls, "tpl_id"))


def read_labelled(tpls: DataFrame, mols: DataFrame, products: DataFrame, labels: DataFrame, by: str = "tpl_id") -> DataFrame:
    """read_groups() of labelled(), with the same rows, without a row for each pair of a template and a molecule that it asks for.

    Templates and targets, each with its bits and its atoms, meet once by `by` and number, and what lacks one of the core's paths leaves in that join. So pairs are neither written nor shuffled.
    """
    own, asked = _asked(products, labels, by)
    keys = list(dict.fromkeys((by, "number")))
    values = F.transform("said", lambda e: F.concat(F.lit("["), e["value"], F.lit("]")))
    left = spread(asked.join(_targets(mols), "mol_id").withColumn("values", values), *keys)
    kept = own.join(tpls.join(_core_screen(tpls), "tpl_id"), "tpl_id")
    pairs = left.join(spread(kept, *keys), keys).filter((F.col("mol_id") != F.col("tpl_id")) & (_holds() | F.arrays_overlap("values", "core_names")))
    rows = _variants(pairs, "tpl_id", "mol_id", "names", "near", "core", "size", "core_steps", "sites", "c0", "s0", "core_names")
    rows = rows.filter(_holds() | (_finds() & F.coalesce(F.exists("names", _meant), F.lit(False)))).drop("c0", "s0", "core_names")
    return _read(rows)


def _holds() -> Column:
    """Whether the target has the bits of all paths of the core."""
    return F.col("c0").bitwiseAND(F.col("s0")) == F.col("c0")


def _meant(s: Column) -> Column:
    """A symbol that the variant's name stands for."""
    return (bare(s) == F.col("name")) & s.startswith("[")


def _finds() -> Column:
    """Whether the core has the name that the variant gives."""
    return F.coalesce(F.array_contains("core_names", F.concat(F.lit("["), F.col("value"), F.lit("]"))), F.lit(False))


def _targets(mols: DataFrame) -> DataFrame:
    """(mol_id, names, near, s0): packed targets with the bits of their paths."""
    return screened(plain(mols).select("mol_id", "names", "near")).drop("features", "s1")


def _read(rows: DataFrame) -> DataFrame:
    """read_groups() of variants with their target and template beside them."""
    renamed = F.transform("names", lambda s: F.when(_meant(s), F.concat(F.lit("["), F.col("value"), F.lit("]"))).otherwise(s))
    rows = rows.withColumn("names", F.when(F.col("name").isNull(), F.col("names")).otherwise(renamed))
    rows = rows.withColumn("part", united(F.col("near"))).withColumn("ms", embeddings(F.col("core_steps"), F.col("names"), F.col("near")))

    def beside(m, s):
        return F.transform(F.filter(F.get("near", F.get(m, s["at"])), lambda e: (e["o"] == s["o"]) & ~F.array_contains(m, e["at"])), lambda e: e["at"])

    def holds_all(m):
        """Whether every site finds an atom of its own beside an embedding of the core, all in one part of the target."""
        found = F.aggregate("sites", F.array(F.array().cast("array<int>")), lambda states, s: F.flatten(F.transform(states, lambda st: F.transform(F.filter(beside(m, s), lambda b: ~F.array_contains(st, b)), lambda b: F.array_append(st, b)))))
        return (F.size(found) > 0) & F.forall(m, lambda p: F.get("part", p) == F.get("part", F.get(m, F.lit(0))))

    wide = F.size(F.array_distinct("part")) > 1
    rows = rows.withColumn("within", F.when(wide, F.array_min(F.transform(F.filter("ms", holds_all), lambda m: F.get("part", F.get(m, F.lit(0)))))))
    rows = rows.withColumn("ms", F.when(F.col("within").isNull(), F.col("ms")).otherwise(F.filter("ms", lambda m: F.forall(m, lambda p: F.get("part", p) == F.col("within")))))

    def ways(m):
        """All fitting ways of an embedding, as (h, hydrogens, key, m, st); st[k] is the place that site k keeps or -1."""
        inside = F.transform("names", lambda _, i: ~F.array_contains(m, i) & F.coalesce(F.get("part", i) == F.col("within"), F.lit(True)))

        def with_parts(x):
            held, part = x["inside"], x["rest"]

            def settle(states, s):
                def grown(st):
                    used = F.transform(F.filter(st, lambda p: p >= 0), lambda p: F.get(part, p))
                    free = F.filter(beside(m, s), lambda b: F.get(held, b) & ~F.array_contains(used, F.get(part, b)))
                    return F.transform(F.array_append(free, F.lit(-1)), lambda b: F.array_append(st, b))

                return F.flatten(F.transform(states, grown))

            states = F.aggregate("sites", F.array(F.array().cast("array<int>")), settle)
            fit = F.filter(states, lambda st: F.size(F.filter(st, lambda p: p >= 0)) == x["left"])

            def rated(st):
                taken = F.filter(F.transform(st, lambda p, k: F.when(p < 0, k)), lambda k: k.isNotNull())
                last_first = F.reverse(F.transform(st, lambda p: F.when(p < 0, 0).otherwise(1)))  # hydrogen on a later site comes first
                by_place = F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda p: F.coalesce(
                    F.get(m, (F.nullif(F.array_position("core", p), F.lit(0)) - 1).cast("int")), F.get(st, (F.nullif(F.array_position(F.transform("sites", lambda s: s["place"]), p), F.lit(0)) - 1).cast("int"))))
                return F.struct(F.size(taken).alias("h"), last_first.alias("last_first"), by_place.alias("key"), st.alias("st"), held.alias("inside"))

            return F.transform(fit, rated)

        def with_left(x):
            """Fragments are counted once; no site is tried where there are more of them than sites, which most embeddings of a small core leave."""
            left = F.size(F.array_distinct(F.filter(F.transform(x["rest"], lambda p, i: F.when(F.get(x["inside"], i), p)), lambda p: p.isNotNull())))
            return F.struct(x["inside"].alias("inside"), x["rest"].alias("rest"), left.alias("left"))

        parts = F.transform(F.array(inside), lambda held: F.struct(held.alias("inside"), united(F.col("near"), held).alias("rest")))
        few = F.filter(F.transform(parts, with_left), lambda x: x["left"] <= F.size("sites"))
        return F.flatten(F.transform(few, with_parts))

    # an explode, so that a filter does not compute the ways a second time
    rows = rows.withColumn("best", F.explode(F.filter(F.array(F.array_min(F.flatten(F.transform("ms", ways)))), lambda b: b.isNotNull())))
    groups = F.transform("sites", lambda s, k: F.struct(s["name"].alias("name"), F.when(F.get("best.st", k) >= 0, F.get("best.st", k)).alias("attach")))
    return rows.select("tpl_id", "mol_id", "label", "names", "near", F.col("best.inside").alias("inside"), groups.alias("groups"))


def group_members(near: Column, inside: Column, attach: Column) -> Column:
    """Places of the fragment that `attach` is in."""
    return let(united(near, inside), lambda part: F.filter(F.transform(near, lambda _, i: i), lambda i: F.get(inside, i) & (F.get(part, i) == F.get(part, attach))))


def group_texts(read: DataFrame) -> DataFrame:
    """(tpl_id, mol_id, label, site, group): each site's symbols in atom order, or H."""
    rows = read.select("tpl_id", "mol_id", "label", "names", "near", "inside", F.explode("groups").alias("g"))
    text = F.array_join(F.transform(group_members(F.col("near"), F.col("inside"), F.col("g.attach")), lambda i: F.get("names", i)), "")
    return rows.select("tpl_id", "mol_id", "label", F.col("g.name").alias("site"), F.when(F.col("g.attach").isNull(), "H").otherwise(text).alias("group"))


def put_on(read: DataFrame, reactants: DataFrame, mols: DataFrame) -> DataFrame:
    """The reactions that the groups make: (tpl_id, mol_id, label, rct_idx, atoms array<string>, bonds array<struct<a, b, order>>), one row per variant and reactant; the product is mol_id.

    reactants(tpl_id, rct_idx, reactant): packed molecules of `mols` by id. An R-site of a reactant is replaced if the template has its name or an alias of it: the atom goes, and the group's atoms follow behind the reactant's own, hung by a single bond on the atom that the site was
    bonded to. Hydrogen adds nothing. A reactant of one atom is replaced whole, by one H for hydrogen. Sites of one name share a group: hydrogen if one of them is, else that with the greatest place in the target. Other reactants stay as they are.
    """
    packed = plain(mols).select(F.col("mol_id").alias("reactant"), F.col("names").alias("r_names"), F.col("near").alias("r_near"))
    rows = read.join(reactants.select("tpl_id", "rct_idx", "reactant"), "tpl_id").join(packed, "reactant")
    known = F.transform("groups", lambda g: g["name"])
    other = lambda s: F.coalesce(*(F.when((s == a) & F.array_contains(known, F.lit(b)), F.lit(b)) for a, b in ALIASES))
    hit = F.transform("r_names", lambda x: let(site_name(x), lambda s: F.when(F.array_contains(known, s), s).otherwise(other(s))))
    rows = rows.withColumn("hit", hit)
    same = lambda name: F.filter("groups", lambda g: g["name"] == name)
    attach = lambda name: F.when(~F.exists(same(name), lambda g: g["attach"].isNull()), F.array_max(F.transform(same(name), lambda g: g["attach"])))
    empty = F.array().cast("array<int>")
    members = lambda at: F.when(at.isNull(), empty).otherwise(group_members(F.col("near"), F.col("inside"), at))
    place = lambda i: F.struct(i.alias("i"), attach(F.get("hit", i)).alias("at"))
    put = F.transform(F.filter(F.transform("hit", lambda h, i: F.when(h.isNotNull(), i)), lambda i: i.isNotNull()), place)
    put = F.transform(put, lambda p: F.struct(p["i"].alias("i"), p["at"].alias("at"), members(p["at"]).alias("members")))
    rows = rows.withColumn("put", put)
    # where an atom of the result comes from: (-1, place in the reactant) or (site's place, place in the target)
    kept = F.filter(F.transform("hit", lambda h, i: F.when(h.isNull(), F.struct(F.lit(-1).alias("k"), i.alias("p")))), lambda x: x.isNotNull())
    added = F.flatten(F.transform("put", lambda p: F.transform(p["members"], lambda m: F.struct(p["i"].alias("k"), m.alias("p")))))
    rows = rows.withColumn("origin", F.concat(kept, added))
    name = lambda x: F.when(x["k"] < 0, F.get("r_names", x["p"])).otherwise(F.get("names", x["p"]))
    at = lambda k, p: (F.array_position("origin", F.struct(F.lit(k).cast("int").alias("k") if isinstance(k, int) else k.alias("k"), p.alias("p"))) - 1).cast("int")
    bond = lambda a, b, o: F.struct(a.alias("a"), b.alias("b"), o.alias("order"))
    own = F.flatten(F.transform("r_near", lambda n, a: F.transform(F.filter(n, lambda e: e["at"] > a), lambda e: bond(at(-1, a), at(-1, e["at"]), e["o"]))))
    inner = F.flatten(F.transform("put", lambda p: F.flatten(F.transform(p["members"], lambda m: F.transform(F.filter(F.get("near", m), lambda e: e["at"] > m), lambda e: bond(at(p["i"], m), at(p["i"], e["at"]), e["o"]))))))
    hung = F.transform(F.filter("put", lambda p: p["at"].isNotNull()), lambda p: let(F.get(F.get("r_near", p["i"]), F.lit(0)), lambda e: bond(at(-1, e["at"]), at(p["i"], p["at"]), F.lit(1))))
    bonds = F.filter(F.concat(own, inner, hung), lambda e: (e["a"] >= 0) & (e["b"] >= 0))
    alone = (F.size("r_names") == 1) & F.exists("put", lambda p: p["at"].isNull())
    atoms = F.when(alone, F.array(F.lit("H"))).otherwise(F.transform("origin", name))
    return rows.select("tpl_id", "mol_id", "label", "rct_idx", atoms.alias("atoms"), bonds.alias("bonds"))


def tables(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """put_on() as tables: atoms(tpl_id, mol_id, label, rct_idx, atom_idx, symbol) and bonds(.., src, dst, order)."""
    keys = ("tpl_id", "mol_id", "label", "rct_idx")
    atoms = made.select(*keys, F.posexplode("atoms").alias("atom_idx", "symbol"))
    return atoms, made.select(*keys, F.explode("bonds").alias("e")).select(*keys, F.col("e.a").alias("src"), F.col("e.b").alias("dst"), "e.order")
