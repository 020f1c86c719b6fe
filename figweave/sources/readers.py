"""Readers and writers for images, annotations, molecule files, results and vocabularies.

Every path goes through Spark's readers and writers, so any store that Spark reaches works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figweave.functions.lineage import cut
from figweave.schemas import ANNOTATED, ENTITY_DOC

SDF_END = "$$$$\n"
RD_START = "$RFMT"


def read_images(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """(path, length, content), one row per image file; order by path where order matters."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length", "content")


def read_annotations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, boxes, reactions) of an annotation file: one row per image, box (x1, y1, x2, y2 in 0..1) and reaction member."""
    images = spark.read.schema(ANNOTATED).option("multiLine", True).json(path).select(F.explode("images").alias("i")).select("i.*")
    boxes = images.select("id", "width", "height", F.posexplode("bboxes").alias("box_idx", "b")).select(
        F.col("id").alias("image_id"), "box_idx", "b.category_id", (F.col("b.bbox")[0] / F.col("width")).alias("x1"), (F.col("b.bbox")[1] / F.col("height")).alias("y1"),
        ((F.col("b.bbox")[0] + F.col("b.bbox")[2]) / F.col("width")).alias("x2"), ((F.col("b.bbox")[1] + F.col("b.bbox")[3]) / F.col("height")).alias("y2"))
    each = images.select("id", F.posexplode("reactions").alias("rxn_idx", "r"))
    members = None
    for role in ("reactants", "conditions", "products"):
        one = each.select(F.col("id").alias("image_id"), "rxn_idx", F.lit(role).alias("role"), F.explode(f"r.{role}").alias("box_idx"))
        members = one if members is None else members.unionByName(one)
    return images.drop("bboxes", "reactions"), boxes, members


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, record) of files that hold one JSON object whose values are objects or arrays: an entry each, as an object of its own with its one key.

    A file is read in as many tasks as it has splits. Spark's text reader deals out what stands between quotes; which of it is inside a string, how deep it lies and which entry it belongs to are three running sums, each taken inside the splits first and then over the
    splits' totals. So no task reads a whole file, and no entry is lost or doubled at a split. An entry must fit a task.
    """
    raw = spark.read.option("lineSep", '"').text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    raw = raw.toDF("value", "file", "block").withColumn("at", F.monotonically_increasing_id())
    rows = cut(raw)

    def running(df: DataFrame, what: Column, name: str, here: bool) -> DataFrame:
        """df with the sum of `what` over the rows before, and this row if `here`."""
        inside = W.partitionBy("file", "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0 if here else -1)
        blocks = df.groupBy("file", "block").agg(F.sum(what).alias("_t"))
        before = blocks.select("file", "block", F.coalesce(F.sum("_t").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        return df.withColumn(name, F.coalesce(F.sum(what).over(inside), F.lit(0))).join(before, ["file", "block"]).withColumn(name, F.col(name) + F.col("_before")).drop("_before")

    # a quote behind an odd number of backslashes ends no string
    closes = F.length(F.regexp_extract("value", r"(\\*)$", 1)) % 2 == 0
    rows = running(rows, closes.cast("int"), "quotes", False)
    outside = F.col("quotes") % 2 == 0
    depth = F.when(outside, _count("value", "{[") - _count("value", "}]")).otherwise(0)
    rows = cut(running(rows, depth, "depth", True))
    starts = outside & (F.col("depth") == 1)
    rows = running(rows, starts.cast("int"), "number", False).filter("number > 0")
    entries = rows.groupBy("file", "number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "value"))), lambda x: x["value"]), '"').alias("t"), F.min("depth").alias("least"))
    text = F.rtrim(F.regexp_replace("t", r"[,\s]+$", ""))
    body = F.when(F.col("least") == 0, F.regexp_replace(text, r"\}\s*$", "")).otherwise(text)
    return entries.select("file", "number", F.concat(F.lit('{"'), body, F.lit("}")).alias("record"))


def _count(value: str, chars: str) -> Column:
    return F.length(value) - F.length(F.translate(value, chars, ""))


def read_entities(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(texts, spans) of entity files keyed by a text index: (doc, text) and (doc, entity, label, start, end). See read_json_map for how files are split."""
    raw = cut(read_json_map(spark, path)).select(F.explode(F.from_json("record", f"map<string, {ENTITY_DOC}>")).alias("doc", "d"))
    spans = raw.select("doc", F.explode("d.entities").alias("entity", "e")).select("doc", "entity", F.col("e.type").alias("label"), F.explode("e.span").alias("s"))
    return raw.select("doc", "d.text"), spans.select("doc", "entity", "label", F.col("s")[0].alias("start"), F.col("s")[1].alias("end"))


def read_molecule_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejects) of a molecule table whose node_coords and edges are list text. The text is parsed as JSON, never evaluated; rows that do not parse are rejects."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    parsed = rows.withColumn("coords", F.from_json("node_coords", "array<array<double>>")).withColumn("bonds", F.from_json("edges", "array<array<int>>"))
    bad = (F.col("node_coords").isNotNull() & F.col("coords").isNull()) | (F.col("edges").isNotNull() & F.col("bonds").isNull())
    return parsed.filter(~bad).drop("node_coords", "edges"), parsed.filter(bad).select(*rows.columns)


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """(record, molfile, properties map) of multi-record molecule files."""
    rows = spark.read.option("lineSep", SDF_END).text(path).filter(F.length(F.trim("value")) > 0)
    names = F.regexp_extract_all("value", F.lit(r"(?m)^> *<([^>]+)>[^\n]*\n([^\n]*)"), 1)
    values = F.regexp_extract_all("value", F.lit(r"(?m)^> *<([^>]+)>[^\n]*\n([^\n]*)"), 2)
    return rows.select(F.col("value").alias("record"), F.concat(F.substring_index("value", "M  END", 1), F.lit("M  END")).alias("molfile"), F.map_from_arrays(names, values).alias("properties"))


def write_sdf(df: DataFrame, path: str, molfile: str = "molfile", properties: str = "properties", mode: str = "append") -> None:
    """Appends records that read_sdf reads back."""
    block = F.array_join(F.transform(F.map_entries(properties), lambda e: F.concat(F.lit("> <"), e["key"], F.lit(">\n"), e["value"], F.lit("\n"))), "\n")
    df.select(F.concat(F.rtrim(molfile), F.lit("\n"), block, F.lit("\n")).alias("value")).write.mode(mode).option("lineSep", SDF_END).text(path)


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    """(smiles, name), one molecule a line."""
    rows = spark.read.text(path).filter("trim(value) <> ''")
    return rows.select(F.regexp_extract("value", r"^(\S+)", 1).alias("smiles"), F.regexp_extract("value", r"^\S+\s+(.*)$", 1).alias("name"))


def write_smiles(df: DataFrame, path: str, mode: str = "append") -> None:
    df.select(F.rtrim(F.concat_ws(" ", "smiles", "name")).alias("value")).write.mode(mode).text(path)


def read_rdf(spark: SparkSession, path: str) -> DataFrame:
    """(record,) reaction records of files that start each with $RFMT."""
    rows = spark.read.option("lineSep", RD_START).text(path)
    return rows.filter(~F.col("value").startswith("$RDFILE") & (F.length(F.trim("value")) > 0)).select(F.btrim("value", F.lit(" \n")).alias("record"))


def write_rdf(df: DataFrame, path: str, mode: str = "append") -> None:
    df.select(F.concat(F.lit("\n"), "record", F.lit("\n")).alias("value")).write.mode(mode).option("lineSep", RD_START).text(path)


def read_cml(spark: SparkSession, path: str) -> DataFrame:
    """(id, atoms, bonds) of <molecule> elements; ids are attributes."""
    schema = "_id string, atomArray struct<atom array<struct<_id string, _elementType string>>>, bondArray struct<bond array<struct<_atomRefs2 string, _order string>>>"
    rows = spark.read.format("xml").option("rowTag", "molecule").schema(schema).load(path)
    return rows.select(F.col("_id").alias("id"), F.col("atomArray.atom").alias("atoms"), F.col("bondArray.bond").alias("bonds"))


def write_cml(df: DataFrame, path: str, mode: str = "append") -> None:
    """Appends (id, atoms, bonds) as <molecule> elements."""
    df.select(F.col("id").alias("_id"), F.struct(F.col("atoms").alias("atom")).alias("atomArray"), F.struct(F.col("bonds").alias("bond")).alias("bondArray")).write.mode(mode).format("xml").option(
        "rootTag", "cml").option("rowTag", "molecule").save(path)


def write_results(df: DataFrame, path: str, *by: str) -> None:
    """JSON results, a folder per value of `by` (per document, batch or evaluation set)."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def save_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary.select("token", "id").write.mode("overwrite").json(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("token string, id long").json(path)


def first_pages(pages: DataFrame, n: int) -> DataFrame:
    """Only the first n pages of each document; a plain filter, so it reaches the reader."""
    return pages.filter(F.col("page") <= n)


def split_blocks(blocks: DataFrame, kinds: tuple[str, ...] = ("Text", "Title", "List", "Table", "Figure")) -> dict[str, DataFrame]:
    """Layout blocks by type, from one input."""
    return {k: blocks.filter(F.col("type") == k) for k in kinds}


def content_switch(figures: DataFrame, tables: DataFrame, content: str | None = None) -> DataFrame:
    """`tables`, `figures` (with tables that hold a figure: title and header over 50 apart), or all."""
    both = F.abs(F.col("title_y") - F.col("header_y")) > 50
    if content == "tables":
        return tables
    return figures.unionByName(tables.filter(both) if content == "figures" else tables, allowMissingColumns=True)


def numbered(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with `page`, from 1, by position in their group."""
    return rows.withColumn("page", F.row_number().over(W.partitionBy(group).orderBy(order)))
