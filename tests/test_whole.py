"""Queries over documents, pages and turns read all rows and whole texts: brute force over small tables."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from figweave.plans import ORACLES, QUERIES

LONG = " ".join(f"w{i % 37}" * (i % 4 + 1) for i in range(1200))
DOCS = [(1, "one two three. Gamma delta", "en"), (2, "eins zwei drei. Gamma delta", "de"), (3, "un deux trois. Gamma delta", None), (4, LONG, "fr"), (5, "uno  dos\ntres. Gamma", "es")]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(7, "gamma delta")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, f"page {i}") for i in range(13)], "page_id long, html string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(5)], "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def test_all_languages(spark, small):
    run = lambda name: QUERIES[name](spark, small).collect()
    tokens = {d: t.split(" ") for d, t, _ in DOCS}
    assert {(r.doc_id, r.tok_idx) for r in run("ner_align")} == {(d, k) for d, t in tokens.items() for k in range(len(t))}
    assert {r.doc_id for r in run("ner_spans")} == {d for d, t in tokens.items() if any(len(w) % 6 in (0, 2) for w in t)}
    assert sum(r.gold for r in run("ner_spans_strict_f1") if r.label != "micro") == sum(len(w) % 6 in (0, 2) for t in tokens.values() for w in t)
    assert {r.doc_id for r in run("tagged_html")} == set(tokens)
    assert [r.token for r in sorted(run("vocab_fit"), key=lambda r: r.id)] == sorted({w for t in tokens.values() for w in t if w})
    assert sum(r.n for r in run("bio_scheme")) == sum(map(len, tokens.values()))
    for name in ("tokens_to_ids", "ids_to_text", "pad_batch"):
        assert {r.doc_id for r in run(name)} == set(tokens)
    assert [(r.doc_id, r.shared) for r in sorted(run("related_sentences"), key=lambda r: r.place)] == [(1, 2), (2, 2), (3, 2)]


def test_sql_reads_no_part_of_documents():
    assert not any("lang = " in sql or "tok_idx < " in sql for name, sql in ORACLES.items() if name != "ner_spans_truncated_f1")


def test_whole_texts(spark, small):
    run = lambda name: {r.doc_id: r for r in QUERIES[name](spark, small).collect()}
    tokens = {d: t.split(" ") for d, t, _ in DOCS}
    assert {d: r.text for d, r in run("ids_to_text").items()} == {d: " ".join(w for w in t if w) for d, t in tokens.items()}
    assert {d: r.ids.count(",") - 1 for d, r in run("tokens_to_ids").items()} == {d: len(t) for d, t in tokens.items()}
    assert {d: (r.length, r.padded, r.n_fill) for d, r in run("pad_batch").items()} == {d: (len(t), 1200, 1200 - len(t)) for d, t in tokens.items()}


def test_all_pages_and_turns(spark, small):
    pages = {r.doc: r.text for r in QUERIES["page_markdown"](spark, small).collect()}
    assert pages == {d: "\n".join(f"## = Page {i % 10 + 1} =\npage {i}\n" for i in range(13) if i // 10 == d).strip() for d in (0, 1)}
    (row,) = QUERIES["message_payload"](spark, small).collect()
    assert row.n_turns == 5 and [m["text"] for m in json.loads(row.payload)] == [f"t{i}" for i in range(5)]


def test_pages_stay_in_their_partition(spark, sf):
    """Lines, rows, cells and grids of a page are made where its detections are: one shuffle in all."""
    from figweave.plans import QUERIES

    for name in ("table_align", "table_rejects", "table_expand"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, name


def test_formula_tokens_are_found_once(spark):
    """The rules and the reading of a formula share its tokens; texts at the rules' limits read as before."""
    from figweave.functions import chemistry as C

    texts = ["C(CH3(OMe)2)3", "C2H4O", "(", "C 2", "C12345", "(C9999)2", "x", "", None, "C0", "C" * 2001]
    df = spark.createDataFrame([(t,) for t in texts], "formula string")
    for read in (C.symbol_counts, C.formula_atoms):
        rows = df.select(read(F.col("formula")).alias("x"))
        assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
        assert [r.x is None for r in rows.collect()] == [False, False, True, True, True, True, True, False, True, False, True]


@pytest.mark.parametrize("name", ["token_parse_broken", "token_stream_parse", "token_sequence"])
def test_token_sequences_stay_with_their_image(spark, sf, name):
    """Boxes are not joined with themselves: one shuffle, by image."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == plan.count("Exchange ") == 1 and "Join" not in plan


def test_token_sequences_without_an_image(spark, tmp_path):
    """Boxes whose image is null are in no join and so in no sequence."""
    row = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string"
    rows = [(key, 4 * i, i, i, 5.0, 1.0, 0.05, "N") for key in (None, 7) for i in range(3)]
    spark.createDataFrame(rows, row).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [r.image_id for r in QUERIES["token_stream_parse"](spark, str(tmp_path)).collect()] == [7, 7, 7]


@pytest.mark.parametrize("name, n", [("ner_align", 2), ("ner_spans_strict_f1", 2)])
def test_tokens_stay_with_their_document(spark, sf, name, n):
    """Texts are dealt by document; spans and tokens are not shuffled again by other keys."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("SinglePartition")[0]
    assert "Join" not in plan and "hashpartitioning(doc_id" in plan and not re.search(r"hashpartitioning\(doc_id#\d+L?, [a-z]", plan) and plan.count("hashpartitioning(doc_id") == n


def test_span_hits_as_a_full_join(spark):
    from figweave.operators import text as S

    rnd = random.Random(6)
    some = lambda n: [(rnd.choice([1, 2, None]), rnd.choice("ab"), rnd.randrange(3), 9) for _ in range(n)]
    gold, pred = some(60), some(50)
    want = {}
    for label in "ab":
        pairs = sum(g == p for g in gold for p in pred if g[1] == label and g[0] is not None)
        alone = lambda xs, ys: sum(x[1] == label and (x[0] is None or x not in ys) for x in xs)  # noqa: E731,B023
        want[label] = (pairs + alone(gold, pred), pairs + alone(pred, gold), pairs)
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, label string, start int, end int")
    assert {r.label: (r.gold, r.pred, r.hits) for r in S.span_hits(df(gold), df(pred)).collect()} == want


def test_align_spans_brute(spark):
    """Spans that overlap, nest and cross cells; unknown documents."""
    from figweave.operators import text as S

    rnd = random.Random(7)
    spans = [(d, rnd.choice("ab"), s, s + rnd.choice([0, 1, 9, 70])) for d in (1, 2, None) for s in (rnd.randrange(120) for _ in range(25))]
    tokens = [(d, k, 4 * k) for d in (1, 2, 3, None) for k in range(40)]
    got = S.align_spans(spark.createDataFrame(tokens, "doc_id long, tok_idx int, start long"), spark.createDataFrame(spans, "doc_id long, label string, start long, end long"), cell=16).collect()
    best = lambda d, at: max(((s, x) for e, x, s, end in spans if e is not None and e == d and s <= at < end), default=None)
    tag = lambda b, at: "O" if b is None else ("B-" if b[0] == at else "I-") + b[1]
    assert sorted(((r.doc_id, r.tok_idx, r.tag) for r in got), key=str) == sorted(((d, k, tag(best(d, at), at)) for d, k, at in tokens), key=str)


def test_blocks_ask_once_for_a_token(spark):
    """Unknown tokens, nulls, ids behind an end; no shuffle carries all tokens by token or id."""
    from figweave.operators import sequences as Q

    tokens = spark.createDataFrame([(d, k, w) for d in (1, 2, None) for k, w in enumerate(["a", "b", None, "a", "zz"])], "doc_id long, tok_idx int, token string")
    vocabulary = spark.createDataFrame([("a", 4), ("b", 5)], "token string, id long")
    ids = Q.to_ids(tokens, vocabulary)
    assert sorted(((r.doc_id, r.ids) for r in ids.collect()), key=str) == [(d, [1, 4, 5, 3, 4, 3, 2]) for d in (1, 2, None)]
    odd = spark.createDataFrame([(1, [1, 4, 5, 2, 4]), (2, [1, 4, 0, 2]), (3, [5, None, 9]), (4, [1, 2])], "doc_id long, ids array<long>")
    assert sorted((r.doc_id, r.text) for r in Q.to_text(odd, vocabulary).collect()) == [(1, "a b"), (2, "a"), (3, "b <unk>")]
    plan = ids._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner.*\n(.*\n)?.*Aggregate \[block", plan)
