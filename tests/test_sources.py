"""Readers and writers over temporary files."""

import json
import random

import pytest

from figweave.sources import readers as R


def test_images_by_suffix(spark, tmp_path):
    (tmp_path / "b.png").write_bytes(b"22")
    (tmp_path / "a.png").write_bytes(b"1")
    (tmp_path / "c.txt").write_text("no")
    assert [(r.path[-5:], r.length) for r in R.read_images(spark, str(tmp_path)).orderBy("path").collect()] == [("a.png", 1), ("b.png", 2)]


def test_annotations(spark, tmp_path):
    data = {"images": [{"id": 7, "file_name": "f", "width": 100, "height": 50, "bboxes": [{"category_id": 1, "bbox": [10, 10, 20, 30]}, {"category_id": 3, "bbox": [0, 0, 1, 1]}],
                        "reactions": [{"reactants": [0], "conditions": [], "products": [1]}]}]}
    (tmp_path / "a.json").write_text(json.dumps(data, indent=1))
    images, boxes, members = R.read_annotations(spark, str(tmp_path / "a.json"))
    assert images.count() == 1 and tuple(boxes.filter("box_idx = 0").select("x1", "y1", "x2", "y2").first()) == (0.1, 0.2, 0.3, 0.8)
    assert sorted((r.role, r.box_idx) for r in members.collect()) == [("products", 1), ("reactants", 0)]


def test_entities(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"0": {"text": "NaCl 3 h", "entities": {"T1": {"span": [[0, 4]], "type": "MOL"}}}}))
    texts, spans = R.read_entities(spark, str(tmp_path / "e.json"))
    assert texts.first().text == "NaCl 3 h" and tuple(spans.select("doc", "label", "start", "end").first()) == ("0", "MOL", 0, 4)


@pytest.mark.parametrize("indent, split", [(None, "1g"), (None, "300b"), (2, "700b"), (2, "97b")])
def test_entity_files_in_many_tasks(spark, tmp_path, indent, split):
    """Texts with quotes, backslashes, brackets and line ends; splits anywhere, inside strings and escapes too."""
    rnd = random.Random(str((indent, split)))
    bits = ['"', "\\", "{", "}", "[", "]", ",", ": ", "\n", "é", "日", "a", '\\"', " }, {", "\\\\"]
    for name in ("x", "y"):
        data = {f'{name}{k}"{k % 3 * "}"}': {"text": "".join(rnd.choice(bits) for _ in range(rnd.randrange(60))), "entities": {f"T{i}": {"span": [[i, i + 2]], "type": rnd.choice(["MOL", "{"])} for i in range(k % 4)}} for k in range(60)}
        (tmp_path / f"{name}.json").write_text(json.dumps(data, indent=indent, ensure_ascii=k_is_even(name)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        texts, spans = R.read_entities(spark, str(tmp_path))
        want = {k: v for name in ("x", "y") for k, v in json.loads((tmp_path / f"{name}.json").read_text()).items()}
        got = texts.collect()
        assert len(got) == 120 and {r.doc: r.text for r in got} == {k: v["text"] for k, v in want.items()}
        assert sorted((r.doc, r.entity, r.label, r.start, r.end) for r in spans.collect()) == sorted((k, e, x["type"], *x["span"][0]) for k, v in want.items() for e, x in v["entities"].items())
        if split != "1g":
            assert spark.read.option("lineSep", '"').text(str(tmp_path)).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def k_is_even(name):
    return name == "x"


@pytest.mark.parametrize("split", ["1g", "50b"])
def test_large_record_files_are_split(spark, tmp_path, split):
    """Each record once, whatever the splits cut."""
    (tmp_path / "a.sdf").write_text("".join(f"mol {k}\n{'x' * (k % 40)}\nM  END\n> <ID>\n{k}\n\n$$$$\n" for k in range(200)))
    (tmp_path / "b.rdf").write_text("$RDFILE 1\n" + "".join(f"$RFMT\n$RXN {k}\n{'y' * (k % 30)}\n" for k in range(200)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        assert sorted(int(r.properties["ID"]) for r in R.read_sdf(spark, str(tmp_path / "a.sdf")).collect()) == list(range(200))
        assert sorted(int(r.record.split()[1]) for r in R.read_rdf(spark, str(tmp_path / "b.rdf")).collect()) == list(range(200))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_molecule_csv_never_evaluates(spark, tmp_path):
    (tmp_path / "m.csv").write_text('file_path,SMILES,node_coords,edges\na.png,CC,"[[0.1, 0.2], [0.3, 0.4]]","[[0, 1, 1]]"\nb.png,C,"__import__(\'os\')","[]"\n')
    good, bad = R.read_molecule_csv(spark, str(tmp_path / "m.csv"))
    assert good.first().bonds == [[0, 1, 1]] and bad.first().file_path == "b.png"


def test_molecule_files_round_trip(spark, tmp_path):
    mols = spark.createDataFrame([("one\n  C\nM  END", {"ID": "1", "name": "x y"}), ("two\nM  END", {"ID": "2"})], "molfile string, properties map<string,string>")
    R.write_sdf(mols, str(tmp_path / "sdf"))
    R.write_sdf(mols.limit(1), str(tmp_path / "sdf"))
    back = R.read_sdf(spark, str(tmp_path / "sdf")).collect()
    assert sorted(r.properties["ID"] for r in back) == ["1", "1", "2"] and {r.molfile for r in back} == {"one\n  C\nM  END", "two\nM  END"}
    smiles = spark.createDataFrame([("CC", "ethane"), ("C", "")], "smiles string, name string")
    R.write_smiles(smiles, str(tmp_path / "smi"))
    assert sorted(tuple(r) for r in R.read_smiles(spark, str(tmp_path / "smi")).collect()) == [("C", ""), ("CC", "ethane")]
    rxns = spark.createDataFrame([("$RXN a\nb",), ("$RXN c",)], "record string")
    R.write_rdf(rxns, str(tmp_path / "rdf"))
    assert sorted(r.record for r in R.read_rdf(spark, str(tmp_path / "rdf")).collect()) == ["$RXN a\nb", "$RXN c"]


def test_cml_round_trip(spark, tmp_path):
    mols = spark.createDataFrame([("m1", [("a1", "C"), ("a2", "O")], [("a1 a2", "1")])], "id string, atoms array<struct<_id string, _elementType string>>, bonds array<struct<_atomRefs2 string, _order string>>")
    R.write_cml(mols, str(tmp_path / "cml"))
    r = R.read_cml(spark, str(tmp_path / "cml")).first()
    assert r.id == "m1" and [a._elementType for a in r.atoms] == ["C", "O"] and r.bonds[0]._order == "1"


def test_results_and_vocabulary(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "batch int, v string")
    R.write_results(rows, str(tmp_path / "out"), "batch")
    assert sorted((r.batch, r.v) for r in spark.read.json(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "b")]
    R.save_vocabulary(spark.createDataFrame([("x", 4)], "token string, id long"), str(tmp_path / "v"))
    assert tuple(R.load_vocabulary(spark, str(tmp_path / "v")).first()) == ("x", 4)


def test_page_filter_and_content_switch(spark):
    pages = spark.createDataFrame([(1, p) for p in range(1, 6)], "doc int, page int")
    assert R.first_pages(pages, 2).count() == 2
    figures = spark.createDataFrame([("f", 1.0, 1.0)], "name string, title_y double, header_y double")
    tables = spark.createDataFrame([("t", 100.0, 10.0), ("u", 10.0, 10.0)], "name string, title_y double, header_y double")
    assert [sorted(r.name for r in R.content_switch(figures, tables, c).collect()) for c in ("tables", "figures", None)] == [["t", "u"], ["f", "t"], ["f", "t", "u"]]
