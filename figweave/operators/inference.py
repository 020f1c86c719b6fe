"""Batched user functions, tool registry, payloads, output checks and bad input."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Tool:
    """A DataFrame function that is called by name: what it does and its parameters as JSON types by name."""

    name: str
    call: Callable
    description: str = ""
    parameters: dict[str, str] = field(default_factory=dict)


TOOLS: dict[str, Tool] = {}
#: Python types of JSON types.
JSON_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}


def tool(f: Callable | None = None, *, name: str | None = None, description: str | None = None, parameters: dict[str, str] | None = None) -> Callable:
    """Registers a DataFrame function as a tool, under its own name and docstring unless others are given."""
    def add(g: Callable) -> Callable:
        TOOLS[name or g.__name__] = Tool(name or g.__name__, g, description or (g.__doc__ or "").strip(), dict(parameters or {}))
        return g

    return add if f is None else add(f)


def call_tool(name: str, *args, **kwargs):
    """The named tool's result; a name that no tool has raises."""
    if name not in TOOLS:
        raise KeyError(f"no such tool: {name}; there are {', '.join(sorted(TOOLS))}")
    return TOOLS[name].call(*args, **kwargs)


def dispatch(name: str, arguments: str, *args):
    """Calls a tool with arguments in JSON, behind `args` (its input frames); arguments must be the tool's parameters, with their types."""
    given = json.loads(arguments or "{}")
    wanted = TOOLS[name].parameters if name in TOOLS else {}
    wrong = [k for k, v in given.items() if k not in wanted or not isinstance(v, JSON_TYPES[wanted[k]])]
    if name in TOOLS and wrong:
        raise TypeError(f"{name} does not take {', '.join(sorted(wrong))} so; it takes {wanted}")
    return call_tool(name, *args, **given)


def tool_table(spark: SparkSession) -> DataFrame:
    """(name, description, parameters) of all tools, parameters as JSON schema: what a model is told."""
    schema = lambda t: json.dumps({"type": "object", "properties": {k: {"type": v} for k, v in t.parameters.items()}, "required": sorted(t.parameters)})
    return spark.createDataFrame([(t.name, t.description, schema(t)) for _, t in sorted(TOOLS.items())], "name string, description string, parameters string")


#: Models of this process, by name: a worker process runs many tasks.
MODELS: dict[str, Callable] = {}


def model_of(name: str | None, load: Callable[[], Callable]) -> Callable:
    """The process's model of that name, loaded once; without a name, a new one."""
    if name is None:
        return load()
    if name not in MODELS:
        MODELS[name] = load()
    return MODELS[name]


def predicted(predict: Callable[[list], list[tuple]], values: list, batch_size: int, size: Callable | None) -> list[tuple]:
    """predict of all values, batch_size at a time; with `size`, values of like size share a batch, and the results come back in the values' order."""
    order = range(len(values)) if size is None else sorted(range(len(values)), key=lambda i: size(values[i]))
    out = [None] * len(values)
    for at in range(0, len(values), batch_size):
        places = order[at : at + batch_size]
        found = predict([values[i] for i in places])
        if len(found) != len(places):
            raise ValueError(f"the model gave {len(found)} rows for {len(places)} values")
        for i, row in zip(places, found):
            out[i] = row
    return out


def apply_batched(df: DataFrame, load: Callable[[], Callable[[list], list[tuple]]], column: str, schema: str, batch_size: int = 16, name: str | None = None, size: Callable | None = None) -> DataFrame:
    """df with the columns of `schema` from a model on `column`. `load` returns a function from a list of at most batch_size values to a list of as many rows.

    With a `name` the model is loaded once a worker process and kept for all its tasks; without, once a task. With `size`, a function of a value such as its length, batches are made of values of like size, so that little is padded; rows keep their order.
    """
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from figweave.operators import inference  # this process's own module, and so its models

        predict = None
        for batch in batches:
            predict = predict or inference.model_of(name, load)
            rows = inference.predicted(predict, batch[column].tolist(), batch_size, size)
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{types}, {schema}")


def converted(df: DataFrame, convert: Callable[[pd.Series], pd.Series], column: str, to: str, kind: str = "string") -> DataFrame:
    """df with `to`, a vectorised conversion of `column` that the caller passes in."""
    return df.withColumn(to, F.pandas_udf(convert, kind)(F.col(column)))


def message_payload(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, payload): messages(conv_id, turn, role, text) as one JSON list in turn order."""
    rows = messages.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    return rows.select("conv_id", "n_turns", F.to_json(F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))).alias("payload"))


def known_calls(calls: DataFrame, tools: dict[str, str], key: str) -> DataFrame:
    """calls joined with the tool that answers to their key."""
    table = calls.sparkSession.createDataFrame(sorted(tools.items()), f"{key} string, tool string")
    return calls.join(F.broadcast(table), key)


def check_tools(calls: DataFrame, tools: dict[str, str], key: str) -> None:
    """Raises on the first call that no tool answers to."""
    table = calls.sparkSession.createDataFrame(sorted(tools.items()), f"{key} string, tool string")
    unknown = calls.join(F.broadcast(table), key, "left_anti").select(key).limit(1).collect()
    if unknown:
        raise KeyError(f"no such tool: {unknown[0][0]}")


def violations(reactions: DataFrame, given: DataFrame, answered: DataFrame) -> DataFrame:
    """(image_id, violation): reactions without a reactant or a product, and given atoms that the answer lacks."""
    n = lambda r: F.count_if(F.col("role") == r)
    sides = reactions.groupBy("image_id", "rxn_idx").agg(n("reactants").alias("r"), n("products").alias("p"))
    text = lambda what: F.concat(F.lit("reaction "), F.col("rxn_idx").cast("string"), F.lit(f" has no {what}")).alias("violation")
    lost = given.join(answered, ["mol_id", "atom_idx"], "left_anti").select(F.col("mol_id").alias("image_id"), F.concat(F.lit("symbol of atom "), F.col("atom_idx").cast("string"), F.lit(" is missing in the output")).alias("violation"))
    return sides.filter("p = 0").select("image_id", text("product")).unionByName(sides.filter("r = 0").select("image_id", text("reactant"))).unionByName(lost)


def number_violations(labels: DataFrame) -> DataFrame:
    """(image_id, violation) of labels(image_id, role, label): products whose number is not that of a `product template` of their image, where it has one."""
    numbers = labels.select("image_id", "role", F.regexp_extract("label", r"^(\d+)", 1).alias("number")).distinct()
    templates = numbers.filter("role = 'product template'").select("image_id", "number")
    odd = numbers.filter("role = 'product'").join(templates.select("image_id").distinct(), "image_id", "left_semi").join(templates, ["image_id", "number"], "left_anti")
    return odd.select("image_id", F.concat(F.lit("product "), "number", F.lit(" has another number than the template")).alias("violation"))


def count_violations(given: DataFrame, answered: DataFrame, of: str, to: str) -> DataFrame:
    """(image_id, violation) where an image has another number of rows in `answered` than in `given`."""
    n = lambda df, c: df.groupBy("image_id").agg(F.count("*").alias(c))
    both = n(given, "g").join(n(answered, "a"), "image_id", "left").na.fill(0, ["a"]).filter("g <> a")
    return both.select("image_id", F.concat(F.col("g").cast("string"), F.lit(f" {of}, "), F.col("a").cast("string"), F.lit(f" {to}")).alias("violation"))


def parse_or_reject(df: DataFrame, column: str, schema: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): good has `parsed`, a struct of the JSON in `column`; rejects has the reason."""
    first = schema.split()[0]
    rows = df.withColumn("parsed", F.from_json(column, schema))
    bad = F.col("parsed").isNull() | F.col(f"parsed.{first}").isNull()
    return rows.filter(~bad), rows.filter(bad).drop("parsed").withColumn("reason", F.lit(reason))


def data_url(content: Column, kind: str) -> Column:
    """content as a base64 data URL."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.translate(F.base64(content.cast("binary")), "\r\n", ""))
