"""Fixed chemistry tables and text functions for symbols, formulas and SMILES text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviation to SMILES fragment.
FRAGMENTS = {
    "NO2": "[N+](=O)[O-]", "O2N": "[N+](=O)[O-]", "CHO": "[CH1](=O)", "OHC": "[CH1](=O)", "CO2Et": "[C](=O)OCC", "COOEt": "[C](=O)OCC",
    "OAc": "[O]C(=O)C", "NHAc": "[NH]C(=O)C", "Ac": "[C](=O)C", "OBz": "[O]C(=O)c1ccccc1", "Bz": "[C](=O)c1ccccc1", "OBn": "[O]Cc1ccccc1", "Bn": "[CH2]c1ccccc1",
    "NHBoc": "[NH1]C(=O)OC(C)(C)C", "NBoc": "[NH1]C(=O)OC(C)(C)C", "Boc": "[C](=O)OC(C)(C)C", "ClC6H4": "c2ccccc2Cl", "2-ClC6H4": "c2ccccc2Cl",
    "[CF3]2C6H3": "C1=CC(=CC(=C1C(F)(F)F)C(F)(F)F)", "3,5-[CF3]2C6H3": "C1=CC(=CC(=C1C(F)(F)F)C(F)(F)F)",
    "Cbm": "[C](=O)N", "Cbz": "[C](=O)OCc1ccccc1", "Cy": "[CH1]1CCCCC1", "Fmoc": "[C](=O)OCC1c(cccc2)c2c3c1cccc3", "Mes": "[c]1c(C)cc(C)cc(C)1", "OMs": "[O]S(=O)(=O)C", "Ms": "[S](=O)(=O)C",
    "Ph": "[c]1ccccc1", "PMB": "[CH2]c1ccc(OC)cc1", "Py": "[c]1ncccc1", "SEM": "[CH2]CSi(C)(C)C", "Suc": "[C](=O)CCC(=O)O", "TBS": "[Si](C)(C)C(C)(C)C", "TBZ": "[C](=S)c1ccccc1",
    "OTf": "[O]S(=O)(=O)C(F)(F)F", "Tf": "[S](=O)(=O)C(F)(F)F", "TFA": "[C](=O)C(F)(F)F", "TMS": "[Si](C)(C)C", "Ts": "[S](=O)(=O)c1ccc(C)cc1",
    "OMe": "[O]C", "MeO": "[O]C", "SMe": "[S]C", "MeS": "[S]C", "NMe": "[NH]C", "MeN": "[NH]C", "Me": "[CH3]", "OEt": "[O]CC", "EtO": "[O]CC", "Et": "[CH2]C", "C2H5": "[CH2]C",
    "Pr": "[CH2]CC", "nPr": "[CH2]CC", "n-Pr": "[CH2]CC", "Bu": "[CH2]CCC", "nBu": "[CH2]CCC", "n-Bu": "[CH2]CCC", "iPr": "[CH1](C)C", "i-Pr": "[CH1](C)C", "iBu": "[CH2]C(C)C", "i-Bu": "[CH2]C(C)C",
    "OiBu": "[O]CC(C)C", "OtBu": "[O]C(C)(C)C", "tBu": "[C](C)(C)C", "t-Bu": "[C](C)(C)C", "CF3": "[C](F)(F)F", "F3C": "[C](F)(F)F", "NCF3": "[NH]C(F)(F)F", "F3CN": "[NH]C(F)(F)F",
    "OCF3": "[O]C(F)(F)F", "F3CO": "[O]C(F)(F)F", "CCl3": "[C](Cl)(Cl)Cl", "CO2H": "[C](=O)O", "HO2C": "[C](=O)O", "COOH": "[C](=O)O", "CN": "[C]#N", "NC": "[C]#N", "OCH3": "[O]C", "H3CO": "[O]C", "SO3H": "[S](=O)(=O)O",
}
#: Average atomic masses.
MASSES = {"H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "Br": 79.904, "I": 126.904}
#: The published atom-wise SMILES token pattern.
SMILES_TOKEN = r"\[[^\]]+]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|\/|:|~|@|\?|>|\*|\$|%[0-9]{2}|[0-9]"
#: A formula of more characters, a count of more digits or more atoms in all than this is no formula: a short text of nested counts would else stand for any number of atoms.
FORMULA_CHARS, COUNT_DIGITS, FORMULA_ATOMS = 2000, 4, 10_000


def bare(symbol: Column) -> Column:
    """A symbol without the brackets around all of it."""
    return F.regexp_replace(symbol, r"^\[(.*)\]$", "$1")


def normal_symbol(symbol: Column) -> Column:
    """[R3] becomes [3*]; other symbols stay."""
    return F.regexp_replace(symbol, r"^\[R(\d+)\]$", "[$1*]")


def normal_smiles(text: Column, stereo: bool = False, chiral: bool = False) -> Column:
    """R symbols as [n*], without the marks of double-bond geometry (stereo) and chirality (chiral) unless they are kept."""
    text = F.regexp_replace(text, r"\[R(\d+)\]", "[$1*]")
    text = text if stereo else F.translate(text, "/\\", "")
    return text if chiral else F.translate(text, "@", "")


def expand_symbol(symbol: Column, fragment: Column) -> Column:
    """The fragment of an abbreviation; else R<n> as [n*], another R symbol as *, an element as it is, anything else in brackets."""
    name = bare(symbol)
    return (
        F.when(fragment.isNotNull(), fragment).when(F.regexp_like(name, F.lit(r"^R\d+$")), F.concat(F.lit("["), F.substr(name, F.lit(2)), F.lit("*]")))
        .when(F.regexp_like(name, F.lit("^(R[a-z']*|Ar|X|Y|Z)$")), "*").when(name == symbol, symbol).otherwise(F.concat(F.lit("["), name, F.lit("]"))))


def without_locants(value: Column) -> Column:
    """2-ClC6H4 becomes ClC6H4."""
    return F.regexp_replace(value, r"^[0-9,]+-", "")


def formula_token() -> str:
    """The pattern of one token of a condensed formula: the longest known name that fits, else an R-site, an element, a count, a bracket. No other character belongs to a formula."""
    names = sorted(FRAGMENTS, key=len, reverse=True)
    return "|".join([*map(re.escape, names), r"R\d*", "[A-Z][a-z]*", r"\d+", "[()]"])


def formula_tokens(formula: Column) -> Column:
    return F.regexp_extract_all(formula, F.lit(f"({formula_token()})"), 1)


def _is_count(token: Column) -> Column:
    return F.regexp_like(token, F.lit(r"^\d+$"))


def symbol_counts(formula: Column) -> Column:
    """array<struct<symbol, n>> of a condensed formula with brackets to any depth: from the right, a stack of factors, each closing bracket's count on top of the ones around it."""
    start = F.struct(F.array(F.lit(1).cast("long")).alias("factors"), F.lit(1).cast("long").alias("count"), F.array().cast("array<struct<symbol:string,n:bigint>>").alias("found"))

    def step(at, token):
        top = F.element_at(at["factors"], -1)
        outer = F.when(F.size(at["factors"]) > 1, F.slice(at["factors"], F.lit(1), F.size(at["factors"]) - 1)).otherwise(at["factors"])
        factors = F.when(token == ")", F.array_append(at["factors"], top * at["count"])).when(token == "(", outer).otherwise(at["factors"])
        count = F.when(_is_count(token), F.left(token, F.lit(COUNT_DIGITS + 1)).try_cast("long")).otherwise(F.lit(1).cast("long"))
        symbol = F.struct(token.alias("symbol"), (top * at["count"]).alias("n"))
        found = F.when(_is_count(token) | token.isin("(", ")"), at["found"]).otherwise(F.array_append(at["found"], symbol))
        return F.struct(factors.alias("factors"), count.alias("count"), found.alias("found"))

    return _of_tokens(formula, lambda tokens: F.aggregate(F.reverse(tokens), start, step)["found"])


def _of_tokens(formula: Column, body) -> Column:
    """body of a formula's tokens, which are found once for all rules and for the body; null for what is no formula."""
    tokens = F.when(formula.isNotNull() & (F.length(formula) <= FORMULA_CHARS), formula_tokens(formula))
    return F.get(F.transform(F.array(tokens), lambda t: F.when(_problem(formula, t).isNull(), body(t))), F.lit(0))


def _size(tokens: Column) -> Column:
    """How many atoms tokens stand for, as a double, so that no product overflows. A count of 0 counts as 1, as what it repeats is made first."""
    start = F.struct(F.array(F.lit(1.0)).alias("factors"), F.lit(1.0).alias("count"), F.lit(0.0).alias("size"))

    def step(at, token):
        top = F.element_at(at["factors"], -1)
        outer = F.when(F.size(at["factors"]) > 1, F.slice(at["factors"], F.lit(1), F.size(at["factors"]) - 1)).otherwise(at["factors"])
        factors = F.when(token == ")", F.array_append(at["factors"], top * at["count"])).when(token == "(", outer).otherwise(at["factors"])
        count = F.when(_is_count(token), F.greatest(F.left(token, F.lit(COUNT_DIGITS + 1)).try_cast("double"), F.lit(1.0))).otherwise(F.lit(1.0))
        size = at["size"] + F.when(_is_count(token) | token.isin("(", ")"), F.lit(0.0)).otherwise(top * at["count"])
        return F.struct(factors.alias("factors"), count.alias("count"), size.alias("size"))

    return F.aggregate(F.reverse(tokens), start, step)["size"]


def formula_size(formula: Column) -> Column:
    """How many atoms a formula stands for, see _size."""
    return _size(formula_tokens(formula))


def _problem(formula: Column, tokens: Column) -> Column:
    open_ = F.aggregate(tokens, F.lit(0), lambda n, t: F.when(n < 0, n).otherwise(n + F.when(t == "(", 1).when(t == ")", -1).otherwise(0)))
    # a text whose counts, each at least 1, cannot multiply to so many atoms needs no sum
    most = F.aggregate(tokens, F.size(tokens).cast("double"), lambda n, t: F.when(_is_count(t), n * F.greatest(F.left(t, F.lit(COUNT_DIGITS + 1)).try_cast("double"), F.lit(1.0))).otherwise(n))
    return (
        F.when(formula.isNull(), "no text").when(F.length(formula) > FORMULA_CHARS, f"more than {FORMULA_CHARS} characters")
        .when(F.regexp_like(formula, F.lit(r"\d{%d}" % (COUNT_DIGITS + 1))), f"a count of more than {COUNT_DIGITS} digits")
        # tokens stand in order and do not overlap, so they are the whole text if they are as long
        .when(F.length(F.array_join(tokens, "")) != F.length(formula), "characters of no token").when(open_ != 0, "brackets that do not close")
        .when((most > FORMULA_ATOMS) & (_size(tokens) > FORMULA_ATOMS), f"more than {FORMULA_ATOMS} atoms"))


def formula_problem(formula: Column) -> Column:
    """Why a text is no condensed formula; null for formulas. Each rule is only asked if those before it hold, so no text costs more than FORMULA_CHARS and FORMULA_ATOMS allow."""
    tokens = F.when(formula.isNotNull() & (F.length(formula) <= FORMULA_CHARS), formula_tokens(formula))
    return F.get(F.transform(F.array(tokens), lambda t: _problem(formula, t)), F.lit(0))


def is_formula(formula: Column) -> Column:
    return formula_problem(formula).isNull()


def formula_atoms(formula: Column) -> Column:
    """A condensed formula as its atoms in order, runs of carbon spread: C2H4O gives C, H, H, C, H, H, O. A run shares out what stands behind it evenly, the rest at the end; brackets to any
    depth are repeated whole. Null for what is no formula."""
    none = F.array().cast("array<string>")
    level = lambda out, run: F.struct(out.alias("out"), run.cast("int").alias("run"))
    times = lambda unit, n: F.flatten(F.array_repeat(unit, n))
    carbon = F.array(F.lit("C"))

    def put(levels, unit, n):
        """levels with n times unit on the innermost one; a run of carbon waits for what follows it."""
        top = F.element_at(levels, -1)
        spread = F.concat(top["out"], times(F.concat(carbon, times(unit, F.floor(n / top["run"]).cast("int"))), top["run"]), times(unit, (n % top["run"]).cast("int")))
        starts_run = (unit == carbon) & (n > 1)
        new = F.when(top["run"] > 0, level(spread, F.lit(0))).when(starts_run, level(top["out"], n)).otherwise(level(F.concat(top["out"], times(unit, n)), F.lit(0)))
        return F.array_append(F.slice(levels, F.lit(1), F.size(levels) - 1), new)

    def settled(levels):
        """What the innermost level holds, a waiting run of carbon included."""
        top = F.element_at(levels, -1)
        return F.concat(top["out"], times(carbon, top["run"]))

    start = F.struct(F.array(level(none, F.lit(0))).alias("levels"), F.lit(None).cast("array<string>").alias("unit"))

    def step(at, token):
        done = F.when(at["unit"].isNull(), at["levels"]).otherwise(put(at["levels"], at["unit"], F.lit(1)))
        counted = F.when(at["unit"].isNull(), at["levels"]).otherwise(put(at["levels"], at["unit"], F.left(token, F.lit(COUNT_DIGITS)).try_cast("int")))
        inside = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        levels = F.when(_is_count(token), counted).when(token == "(", F.array_append(done, level(none, F.lit(0)))).when(token == ")", inside).otherwise(done)
        unit = F.when(_is_count(token) | (token == "("), F.lit(None).cast("array<string>")).when(token == ")", settled(done)).otherwise(F.array(token))
        return F.struct(levels.alias("levels"), unit.alias("unit"))

    end = lambda at: settled(F.when(at["unit"].isNull(), at["levels"]).otherwise(put(at["levels"], at["unit"], F.lit(1))))
    return _of_tokens(formula, lambda tokens: F.aggregate(tokens, start, step, end))
