"""The training-data operators against brute force, round trips and odd rows."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from figweave.llm import chat, exact_dedup, fingerprints, line_dedup, mixing, near_dedup, packing, quality, queries, sharding, warc
from figweave.llm.shared import drop_tables, join_counted, ranked, write_table

DOC = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and blank texts, ties, repeated rows, a long word.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 6), (4, "Same text here, same TEXT here now", "en", "a", 34), (5, "same text here, same text here now", None, "b", 34),
    (5, "same text here, same text here now", None, "b", 34), (None, "same text here, same text here now", "en", None, 34), (6, "x" * 200_000, "en", "b", 200_000), (7, "é" * 50 + "\n" + "É" * 50, "fr", "b", 101),
    (8, "one two three", "en", "a", 13), (9, "one  two\nthree", "en", "a", 13),
]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """With extra columns whose names clash with the operators' own."""
    df = spark.createDataFrame(ODD, DOC)
    for name in ("id", "size", "key", "copies", "th", "score", "doc", "n", "label", "bucket"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


OPERATORS = {
    "pack": packing.pack_buckets, "near": near_dedup.near_dedup, "exact": exact_dedup.exact_dedup, "fingerprints": fingerprints.fingerprints,
    "mix": mixing.pareto_mix, "shards": sharding.hilbert_shards, "lines": line_dedup.line_dedup, "next": lambda d: fingerprints.with_next_text(d, "doc_id", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_no_rows(odd, empty, name):
    assert OPERATORS[name](odd).count() == len(ODD)
    assert OPERATORS[name](empty).count() == 0


def test_quality_on_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (8, 1)], "doc_id long, quality int")
    out = quality.score(odd, quality.fit(odd, labels)).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert quality.score(odd, quality.fit(odd, labels.limit(0))).agg(F.min("score")).first()[0] == 1.0
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0


def test_quality_learns(spark):
    rnd = random.Random(1)
    good = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + rnd.choice("abc") for _ in range(40))
    rows = [(i, good() if i % 4 else "$$$ ".join(good().split()[:20])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)], "doc_id long, quality int")
    model = quality.fit(docs, labels.filter("doc_id < 200"))
    held = quality.score(docs.filter("doc_id >= 200"), model).select("doc.doc_id", "score").collect()
    assert sum((r.score >= 0.7) == (r.doc_id % 4 > 0) for r in held) >= 0.97 * len(held)


def test_dual_coordinate_descent_separates():
    import numpy as np

    rows = [quality.packed(np.array(x, dtype=np.uint32)) for x in ([0, 2], [1, 2])] * 20
    y = np.array([True, False] * 20)
    w = quality.dual_coordinate_descent(rows, y, quality.log_count_ratios(rows, y))
    assert w[0] > 0 > w[1]


def test_packed_features_round_trip():
    import numpy as np

    rng = np.random.default_rng(3)
    for found in ([], [0], [254], [255], [256], [0, 255, 510, quality.SIZE - 1], sorted(rng.choice(quality.SIZE, 3000, replace=False))):
        assert quality.unpacked(quality.packed(np.array(found, dtype=np.uint32))).tolist() == list(found)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup_brute(docs, odd, keep):
    for df in (docs, odd):
        groups = defaultdict(list)
        for r in df.collect():
            groups[lower(r.text)].append(r.doc_id)
        best = min if keep == "smallest" else max
        want = sorted((str(i), best(x for x in ids if x is not None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
        assert sorted((str(r.id), r.keep_id, r.group_size, r.digest) for r in exact_dedup.exact_dedup(df, keep=keep).collect()) == want


def lines_brute(rows, least=3):
    key = lambda line: lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < least or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup_brute(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc.doc_id, r.n_lines, r.n_dropped, r.doc.text) for r in line_dedup.line_dedup(docs).collect())
    assert got == lines_brute(rows)
    long = "this line is long enough to count"
    few = [(1, long), (2, f" {long.upper()}\t"), (3, f"{long}\nother"), (4, f"{long}\n{long}\n"), (5, "short\nshort"), (6, "")]
    got = sorted((r.doc.doc_id, r.n_lines, r.n_dropped, r.doc.text) for r in line_dedup.line_dedup(spark.createDataFrame(few, "doc_id long, text string")).collect())
    assert got == lines_brute(few)


def test_line_runs_equal_one_aggregate(spark):
    rnd = random.Random(5)
    batches = [spark.createDataFrame([(rnd.randint(0, 20), 0, rnd.randint(1, 3), 100 - b) for _ in range(15)], "h1 long, h2 long, n long, holder long").groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("holder").alias("holder")) for b in range(5)]
    runs, all_rows = line_dedup.LineRuns(fanout=2), None
    for b in batches:
        b = b.persist()
        runs.add(b)
        all_rows = b if all_rows is None else all_rows.unionByName(b)
    want = all_rows.groupBy("h1").agg(F.sum("n"), F.max("holder"))
    assert sorted(map(tuple, runs.merged().select("h1", "n", "holder").collect())) == sorted(map(tuple, want.collect()))
    assert len(runs.levels) > 2


def components_brute(rows):
    sets = {}
    for i, t in rows:
        w = words(lower(t))
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())
    name = {i: i for i in sets}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            name[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def test_near_dedup_brute(docs, spark):
    got = sorted((r.id, r.n_shingles, r.component_id) for r in near_dedup.near_dedup(docs).collect())
    assert got == components_brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("small", [64, 4])
def test_near_dedup_chains_and_groups(spark, monkeypatch, small):
    """Chains whose ends are not alike, a group of many near copies, and texts just under the threshold; with `small` 4 by way of the prefix filter."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows, base = [], [word() for _ in range(120)]
    for k in range(12):  # each step changes the text a little more
        rows.append((k, " ".join(base)))
        base = base[:]
        base[10 * k % 120 : 10 * k % 120 + 2] = [word(), word()]
    group = [word() for _ in range(150)]
    for k in range(60):
        mine = group[:]
        mine[rnd.randrange(150)] = word()
        rows.append((100 + k, " ".join(mine)))
    rows += [(200 + k, " ".join(group[:75] + [word() for _ in range(75)])) for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.id, r.n_shingles, r.component_id) for r in near_dedup.near_dedup(df).collect()) == components_brute(rows)


def test_near_dedup_of_repeated_ids(spark, monkeypatch):
    """An id with several texts is linked to what any of them is like; with `PART` 1 by way of split shingles."""
    monkeypatch.setattr(near_dedup, "PART", 1)
    monkeypatch.setattr(near_dedup, "SMALL", 1)
    rnd = random.Random(2)
    text = lambda: [f"w{rnd.randrange(10**6)}" for _ in range(100)]
    a, b, c = text(), text(), text()
    near = lambda w, k: " ".join([*w[:k], "changed", *w[k + 1 :]])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, near(b, 3)), (9, near(a, 50)), (4, near(near(a, 9).split(), 50)), (11, " ".join(c)), (11, " ".join(c)), (12, " ".join(c).upper()), (None, " ".join(a)), (13, ""), (13, near(c, 0)), (14, None), (15, "one two")]
    got = {(r.id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 96, 4, False), (7, 96, 4, False), (9, 96, 4, False), (4, 96, 4, True), (11, 96, 11, True), (12, 96, 11, False), (None, 96, None, True), (13, 0, 13, True), (13, 96, 11, False), (14, 0, 14, True), (15, 1, 15, True)}


def test_components_brute(spark):
    """Random graphs, a star, a path and a ring; nodes have one label if and only if edges connect them."""
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(140)] + [(1000, 1001 + i) for i in range(50)] + [(2000 + i, 2001 + i) for i in range(60)] + [(3000 + i, 3000 + (i + 1) % 9) for i in range(9)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long").select(*[near_dedup.scrambled(F.col(c)).alias(c) for c in "ab"])
    label = {r.node: r.label for r in near_dedup.components(df).collect()}
    raw = {tuple(r)[0]: i for r, i in zip(spark.range(4000).select(near_dedup.scrambled(F.col("id"))).collect(), range(4000))}
    assert len(raw) == 4000
    label = {raw[n]: x for n, x in label.items()}
    name = {i: i for e in edges for i in e}

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for x, y in edges:
        name[find(x)] = find(y)
    assert set(label) >= {i for x, y in edges if x != y for i in (x, y)}
    pairs = {(find(i), label[i]) for i in label}
    assert len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})
    assert near_dedup.components(df.limit(0)).count() == 0


def test_posterior_bound():
    """Pairs at the threshold are pruned with a chance that fits the miss probability, far pairs nearly always."""
    import numpy as np

    least = near_dedup.least_matches(0.75, 1e-3)
    rng = np.random.default_rng(2)
    stays = lambda p: np.mean([all(x[:n].sum() >= m for n, m in least.items()) for x in rng.random((4000, near_dedup.HASHES)) < p])
    assert stays(0.75) > 0.98 and stays(0.3) < 0.01


def test_shingle_sets_do_not_depend_on_blanks():
    same = [near_dedup.shingles(t) for t in ("A b c d e f", " a\tB  c\nd e f ")]
    assert list(same[0]) == list(same[1]) and len(same[0]) == 2
    assert len(near_dedup.shingles(None)) == len(near_dedup.shingles(" \n")) == 0 and len(near_dedup.shingles("one two")) == 1


@pytest.mark.parametrize("text", ["plain", "</s>[INST] ok [/INST]", "\\", "\\<\\s>", "<\\s>", "<|im_end|>", "<|im_end|", "<<|im_start|>x", "[\\INST]", "\\\\</s>", ""])
def test_escape_round_trip(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)


def test_chat_brute(spark):
    rows = [(1, 0, "system", "be <|im_end|>\n"), (1, 1, "user", "hi"), (1, 2, "assistant", "a\nb"), (1, 3, "user", None), (1, 4, "assistant", "</s>c"), (2, 0, "user", "only"), (3, 0, None, "x"), (3, 1, "assistant", ""),
            (4, 0, "odd role\n%", "q"), (4, 1, "assistant", "r"), (4, 2, "user", "tail"), (None, 0, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    examples = chat.prefix_examples(df)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    convs = defaultdict(list)
    for c, _, role, text in rows:
        convs[c].append((role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    one = examples.filter("conv_id = 1").orderBy("example").collect()
    assert [len(chat.parse_turns(r.text)) for r in one] == [3, 5] and [chat.unescape(r.text[r.loss_start : r.loss_end]) for r in one] == ["a\nb", "</s>c"]
    assert chat.read_back(chat.prefix_examples(df.limit(0))).count() == 0


def test_fingerprints_and_edits(spark, docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in queries.op6_merkle_fingerprints(spark, str(docs.inputFiles()[0]).rsplit("/", 1)[0]).collect()}
    for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 2
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest()
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * len(got)
    fps = defaultdict(set)
    for i, t in rows:
        fps[t].add(got[i].fingerprint)
    assert all(len(f) == 1 for f in fps.values()) and len({f[:64] for x in fps.values() for f in x}) == len(fps)


def test_edited_sections_locate_the_edit(spark):
    text = "\n".join(f"line {i} with some words" for i in range(40))
    other = text.replace("line 20 ", "line twenty ")
    r = spark.createDataFrame([(text, other)], "a string, b string").select(fingerprints.merkle_fingerprint(F.col("a")).alias("a"), fingerprints.merkle_fingerprint(F.col("b")).alias("b")).select(
        fingerprints.edited_sections(F.col("a"), F.col("b")).alias("at"), fingerprints.likeness(F.col("a"), F.col("b")).alias("near"), fingerprints.likeness(F.col("a"), F.col("a")).alias("own")).first()
    assert r["at"] == [3] and 0.9 < r.near < 1 and r.own == 1.0


def test_signatures_of_long_texts_prune(spark):
    """Unrelated sets of 2,000 shingles are pruned by the signature comparison, near copies are kept."""
    rng, rows = random.Random(3), []
    for i in range(20):
        w = [f"w{rng.randrange(100_000)}" for _ in range(2004)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:1900]))]
    sketches = near_dedup._sketch(spark.createDataFrame(rows, "id long, text string").withColumn("row", F.col("id")).withColumn("th", F.lit(0))).cache()
    pairs = spark.createDataFrame(list(itertools.combinations(range(40), 2)), "a long, b long")
    kept = {(r.a, r.b) for r in near_dedup._bayes(pairs, sketches, 0.75).collect()}
    assert kept == {(2 * i, 2 * i + 1) for i in range(20)}
    longs = sketches.select("id", near_dedup._longs(F.col("sig")).alias("s"))
    x, y = (longs.select(F.col("id").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    inside = pairs.join(x, "a").join(y, "b").filter(near_dedup._survives(F.col("sa"), F.col("sb"), 0.75))
    assert {(r.a, r.b) for r in inside.collect()} == kept


def test_near_copies_stay_near(spark):
    """Long lines with a word put in front, taken out or put in the middle share nearly all pieces; Dice by brute force over the pieces."""
    rng, rows = random.Random(6), []
    for i in range(30):
        w = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(rng.choice([200, 1000, 5000]))]
        k = len(w) // 2
        rows += [(" ".join(w), " ".join(x)) for x in (["inserted", *w], w[:k] + w[k + 1 :], [*w[:k], "\t inserted", *w[k:]])]
    rows += [(" a  b", "a b"), ("", " \t"), ("spam " * 1000, "ham " + "spam " * 1000)]
    near = fingerprints.likeness(*[fingerprints.merkle_fingerprint(F.col(c)) for c in "ab"]).alias("near")
    found = spark.createDataFrame(rows, "a string, b string").select("a", "b", near)
    assert all(r.near > 0.85 for r in found.collect()[:90])
    pieces = [fingerprints.cuts(F.col(c)).alias(f"p{c}") for c in "ab"]
    for r in found.select("*", *pieces).collect():
        assert all("".join(p) == (t if words(t) else "") for t, p in ((r.a, r.pa), (r.b, r.pb)))
        assert all(len(words(p)) <= 64 for p in r.pa + r.pb)
        a, b = set(r.pa), set(r.pb)
        assert r.near == pytest.approx(2 * len(a & b) / max(1, len(a) + len(b)), abs=0.01)


def test_one_document_follows_itself(spark):
    df = spark.createDataFrame([(4, "abc")], "doc_id long, text string")
    assert fingerprints.with_next_text(df, "doc_id", "text").first().next_text == "abc"


PAGES = [(3, "http://a/ b\r\n", "y" * 70_000), (1, "u", "y" * 70_000), (2, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", "é" * 60), (7, "u", "é" * 60), (None, "u", "y" * 70_000), (8, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 20), (9, "u", "")]


def test_warc_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("row", F.lit("clash")).withColumn("first", F.lit("clash"))
    path = warc.archive_path(spark)
    warc.write_archives(df, path, segment_bytes=4096, chunk_bytes=1000, records_per_file=3)
    records = warc.read_records(spark, path).persist()
    assert records.filter("type = 'continuation'").count() > 20
    whole = warc.reassemble(records, with_payload=True)
    got = {r.page_id: r for r in warc.resolve_revisits(whole.drop("payload")).collect()}
    want = {i: (h or "").encode() for i, _, h in PAGES}
    assert set(got) == set(want) and all(r.status == "ok" for r in got.values())
    assert all((r.payload_bytes, r.payload_digest) == (len(want[i]), hashlib.sha256(want[i]).hexdigest()) for i, r in got.items())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {3: 1, 7: 6}
    assert all(bytes(r.payload) == want[r.page_id] for r in whole.filter("record_type = 'response'").collect())
    lost = warc.reassemble(records.filter("segment is null or segment <> 3")).filter("status <> 'ok'").collect()
    assert {r.page_id for r in lost} == {1, None} and {r.status for r in lost} == {"segments"}
    path = warc.archive_path(spark)
    warc.write_archives(df.limit(0), path)
    assert warc.resolve_revisits(warc.reassemble(warc.read_records(spark, path))).count() == 0


def test_damaged_archives_give_broken_rows(spark, tmp_path):
    """Whole records before and after a damaged head come back; damage fails nothing."""
    import gzip

    record = lambda i, **more: warc._record(b"block", WARC_Type="response", WARC_Record_ID=f"<{i}>", X_Page_ID=i, **more) + b"\r\n"
    bad = b"WARC/1.1\r\nno colon here\r\nWARC-Type: response\r\n\r\nblock\r\n\r\n"
    odd = record(3).replace(b"Content-Length: 5", b"content-length:5\r\nno colon").replace(b"X-Page-ID: 3", b"X-Page-ID: three")
    nameless = record(4).replace(b"WARC-Record-ID", b"Other")
    packed = gzip.compress(b"".join(record(i) for i in range(200)))
    files = {"a": gzip.compress(record(1)) + gzip.compress(bad + record(2)), "b": gzip.compress(odd + nameless + record(5)), "c": packed[: len(packed) // 2], "d": b"no gzip at all", "e": b"",
             "f": gzip.compress(record(6)[:-7]), "g": gzip.compress(record(7)) + b"\x00garbage"}
    got = {}
    for name, data in files.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc.gz").write_bytes(data)
        got[name] = warc.read_records(spark, f"file://{tmp_path}/{name}").select("type", "record_id", "page_id").collect()
    ids = {k: [r.record_id for r in v if r.type != "broken"] for k, v in got.items()}
    broken = {k: sum(r.type == "broken" for r in v) for k, v in got.items()}
    assert ids["a"] == ["<1>", "<2>"] and ids["b"] == ["<3>", "<5>"] and ids["c"] == [f"<{i}>" for i in range(len(ids["c"]))] and ids["d"] == ids["e"] == [] and ids["f"] == ["<6>"] and ids["g"] == ["<7>"]
    assert broken["a"] == broken["b"] == broken["d"] == broken["f"] == broken["g"] == 1 and broken["c"] >= 1 and broken["e"] == 0
    assert [r.page_id for r in got["b"] if r.record_id == "<3>"] == [None]
    assert len(ids["c"]) > 10
    short = warc.reassemble(warc.read_records(spark, f"file://{tmp_path}/f")).collect()
    assert [(r.page_id, r.status) for r in short] == [(6, "framing")]


def test_broken_framing_is_reported():
    framed = warc.chunked(b"abc" * 100, 50)
    assert warc.unchunked(framed) == b"abc" * 100 and warc.unchunked(warc.chunked(b"", 50)) == b""
    assert warc.unchunked(framed[:-8]) is None and warc.unchunked(b"zz\r\n") is None and warc.unchunked(framed.replace(b"\r\n", b"", 1)) is None


def targets_brute(sizes, cap=3.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total = sum(sizes.values())
    out = {s: total * weight[s] / sum(weight.values()) for s in names}
    for _ in range(1000):
        over = {s for s in names if out[s] > cap * sizes[s] + 1e-9}
        if not over:
            return out
        full = {s for s in names if out[s] >= cap * sizes[s] - 1e-9}
        excess = sum(out[s] - cap * sizes[s] for s in over)
        rest = [s for s in names if s not in full]
        for s in over:
            out[s] = cap * sizes[s]
        for s in rest:
            out[s] += excess * weight[s] / sum(weight[x] for x in rest)
    raise AssertionError


@pytest.mark.parametrize("skewed", [False, True])
def test_mix_reaches_targets(spark, docs, skewed):
    df = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 50 == 1, None).when(F.col("doc_id") % 50 == 2, "tiny").otherwise(F.col("source"))) if skewed else docs
    out = mixing.pareto_mix(df).toPandas()
    assert (out["size"].tolist()) == [len(words(t)) for t in docs.toPandas().set_index("doc_id").loc[out["id"], "text"]]
    out["s"] = out["source"].where(out["source"].notna(), None)
    sizes = defaultdict(int)
    for s, n in zip(out["s"], out["size"]):
        sizes[s] += n
    want = targets_brute(dict(sizes))
    for s in want:
        mine = out[out["s"].isna()] if s is None else out[out["s"] == s]
        assert mine["target"].iloc[0] == pytest.approx(want[s]) and mine["source_size"].iloc[0] == sizes[s]
        assert abs(mine["taken"].sum() - want[s]) <= mine["size"].max() / 2 + 1
        assert (mine["taken"] <= 3 * mine["size"]).all()
    again = mixing.pareto_mix(df).toPandas().sort_values("id")
    assert again["taken"].tolist() == out.sort_values("id")["taken"].tolist()


def copies_brute(rows, target, cap=3.0, tilt=0.5):
    """Copies of rows (id, size, u) of one source: expected copies by bisection, whole ones certain, the rest in Pareto order while the words fit, the best filler last."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(cap, mid * n**tilt) * n for _, n, _ in rows if n) < target else (low, mid)
    expected = {i: min(cap, low * n**tilt) if n else 0.0 for i, n, _ in rows}
    whole = {i: int(e + 1e-9) for i, e in expected.items()}
    p = {i: max(0.0, expected[i] - whole[i]) for i in expected}
    p = {i: v if v > 1e-9 else 0.0 for i, v in p.items()}
    left = target - sum(whole[i] * n for i, n, _ in rows)
    order = sorted((u / (1 - u) / (p[i] / (1 - p[i])), i, n) for i, n, u in rows if p[i])
    drawn, used, rest = set(), 0, []
    for k, (_, i, n) in enumerate(order):
        if used + n > left:
            rest = order[k:]
            break
        drawn.add(i)
        used += n
    gap = left - used
    fits = [(abs(n - gap), q, i) for q, i, n in rest if abs(n - gap) < gap]
    if gap > 0 and fits:
        drawn.add(min(fits)[2])
    return {i: whole[i] + (i in drawn) for i in whole}, expected


def test_mix_draws_in_pareto_order(spark):
    """Sizes of one cell are equal here, so the scale is exact; sources take a part, more than all, and all that the cap allows."""
    rnd = random.Random(8)
    sizes = {"a": [4, 9, 16, 50, 120, 300], "b": [1, 2, 5, 30], "c": [7, 40, 200], None: [3, 11]}
    rows = [(100 * k + i, " ".join(["w"] * rnd.choice(sizes[s])), s) for k, s in enumerate(sizes) for i in range((90, 40, 60, 6)[k])] + [(900, None, "a"), (901, "", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    u = {r.doc_id: (r.u + 0.5) / 2.0**52 for r in df.select("doc_id", F.pmod(F.xxhash64(F.lit(1), "doc_id", F.xxhash64("text")), F.lit(1 << 52)).alias("u")).collect()}
    got = {r.id: r for r in mixing.pareto_mix(df).collect()}
    assert len({r.target / r.source_size for r in got.values() if r.source_size}) > 2
    for s in sizes:
        mine = [(i, len(words(t)), u[i]) for i, t, x in rows if x == s]
        copies, expected = copies_brute(mine, got[mine[0][0]].target)
        assert {i: got[i].copies for i in copies} == copies
        assert all(got[i].expected == pytest.approx(e, abs=1e-6) for i, e in expected.items())


def test_mix_inclusion_frequencies(spark):
    """Over many documents those of one size are drawn as often as their inclusion probability says."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), F.element_at(F.array(*map(F.lit, (2, 8, 30, 100, 400))), (F.col("id") % 5 + 1).cast("int"))), " ").alias("text"),
                                      F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    out = mixing.pareto_mix(docs).toPandas()
    for _, g in out.groupby(["source", "size"]):
        assert g["expected"].nunique() == 1 and g["copies"].mean() == pytest.approx(g["expected"].iloc[0], abs=0.04)
    assert out.groupby("size")["copies"].mean().is_monotonic_increasing


def test_hilbert_curve_is_continuous(spark):
    grid = spark.range(512).select(*[((F.col("id") / 8**k).cast("int") % 8).cast("int").alias(c) for k, c in enumerate("abc")])
    rows = sorted((r.h, (r.a, r.b, r.c)) for r in grid.withColumn("h", sharding.hilbert_index([F.col(c) for c in "abc"], 3)).collect())
    assert [r[0] for r in rows] == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(p[1], q[1])) == 1 for p, q in zip(rows, rows[1:]))


def test_shards(docs):
    out = sharding.hilbert_shards(docs, shards=7).toPandas()
    n = out.groupby("shard").size()
    assert set(n.index) == set(range(7)) and n.max() - n.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    assert out.sort_values(["shard", "slot"])["curve"].is_monotonic_increasing
    few = sharding.hilbert_shards(docs.limit(3), shards=40).toPandas()
    assert few.groupby("shard").size().max() == 1 and (few["slot"] == 0).all()


def bounds_brute(lengths, buckets):
    tops = sorted(set(lengths))
    cost = lambda bounds: sum(min(b for b in bounds if b >= n) - n for n in lengths)
    return min(cost((*c, tops[-1])) for k in range(min(buckets, len(tops))) for c in itertools.combinations(tops[:-1], k))


def test_bucket_bounds_are_optimal():
    rnd = random.Random(4)
    for buckets in (1, 2, 3, 4):
        lengths = [rnd.choice([1, 2, 3, 7, 9, 20, 21, 50, 51, 90]) for _ in range(60)]
        tops = sorted(set(lengths))
        got = packing.optimal_bounds(tops, [lengths.count(t) for t in tops], [t * lengths.count(t) for t in tops], buckets)
        assert len(got) <= buckets and sum(min(b for b in got if b >= n) - n for n in lengths) == bounds_brute(lengths, buckets)


def test_batches(spark, docs):
    out = packing.pack_buckets(docs, budget=4096).toPandas()
    real = {r.doc_id: len(words(r.text)) for r in docs.collect()}
    assert dict(zip(out["id"], out["length"])) == real and (out["length"] <= out["padded_length"]).all() and out["bucket"].nunique() <= 16
    for _, g in out.groupby("batch"):
        assert g["bucket"].nunique() == 1 and sorted(g["slot"]) == list(range(len(g))) and (g["batch_rows"] == len(g)).all()
        assert len(g) == 1 or g["padded_length"].sum() <= 4096
    assert sorted(out["batch"].unique()) == list(range(out["batch"].nunique()))


def test_length_cells(spark):
    r = spark.range(1, 200_000, 7).withColumnRenamed("id", "length")
    r = r.withColumn("c", packing.length_cell(F.col("length"))).toPandas()
    assert (r["c"] >= r["length"]).all() and (r["c"] <= r["length"] * 1.04).all() and r["c"].nunique() <= 512 + 64 * 10


def test_ranked_and_counted_join(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 13)
    got = ranked(df, ["k", "id"], "t").orderBy("k", "id").collect()
    assert [r._rank for r in got] == list(range(1000))
    facts = spark.range(4000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"))
    dims = facts.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    out = join_counted(facts, dims, ["k"], "n", 4000)
    assert out.count() == 4000 and out.filter("v <> 2 * k").count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = P.quality_stage(spark, docs, sf)
    assert kept.columns == names and 0 < kept.count() <= docs.count()
    lines = P.line_stage(spark, docs, sf)
    assert sorted((r.doc_id, r.text) for r in lines.select("doc_id", "text").collect()) == [(i, t) for i, _, _, t in lines_brute([(r.doc_id, r.text) for r in docs.collect()])]
    assert lines.filter("n_chars <> length(text)").count() == 0 and lines.columns == names
    near = P.near_stage(spark, docs, sf)
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, _, c in components_brute([(r.doc_id, r.text) for r in docs.collect()])})
    mixed = P.mix_stage(spark, docs, sf)
    want = sum(r.copies for r in mixing.pareto_mix(docs).select("copies").collect())
    assert mixed.columns == names and mixed.count() == want
    out = P.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "batch", "bucket"} <= set(out.columns)


def test_pipeline_stages_on_odd_rows(spark, sf, odd, empty):
    import corpus_pipeline as P

    for name, stage in P.STAGES:
        assert stage(spark, odd, sf).count() > 0, name
        assert stage(spark, empty, sf).count() == 0, name
        if name != "pack":
            assert stage(spark, odd, sf).columns == odd.columns, name


def test_mix_stage_shares_copies_among_repeated_rows(spark, sf):
    import corpus_pipeline as P

    rows = [(1, "a b c d", "s")] * 3 + [(None, "a b c d", "s")] * 2 + [(2, "e f", "s"), (3, None, "s"), (4, "g h i j k l m", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = defaultdict(int)
    for r in mixing.pareto_mix(df).collect():
        want[r.id] += r.copies
    got = defaultdict(int)
    for r in P.mix_stage(spark, df, sf).collect():
        got[r.doc_id] += 1
    assert got == {i: n for i, n in want.items() if n}


def test_tables_can_be_dropped(spark):
    rows = write_table(spark.range(5).toDF("x"), "drop")
    assert rows.count() == 5
    path = rows.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    drop_tables(spark)
    assert not __import__("os").path.exists(path)
    assert write_table(spark.range(3).toDF("x"), "drop").count() == 3
