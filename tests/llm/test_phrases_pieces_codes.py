"""Phrase collocations, the piece table and vector codes against brute force, the library and odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from figweave.llm import phrases, pieces, queries, vector_codes

DOC = "doc_id long, text string, lang string, source string"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def collocations_brute(rows, longest=3, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", fold(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        phrases_ = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        over = Counter()
        for p, a in phrases_.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    over[p[i : i + k]] = max(over[p[i : i + k]], a)
        found = []
        for p, a in phrases_.items():
            if over[p] * 100 >= 50 * a:
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("longest, least, top", [(3, 10, 2000), (4, 2, 50)])
def test_collocations_brute(spark, longest, least, top):
    rnd = random.Random(longest)
    words = ["a", "b", "É", "É", "c\x01", "New", "york", "city", "the", "x" * 40]
    text = lambda: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "   "]) for _ in range(rnd.randrange(60)))
    rows = [(i, rnd.choice([None, "", text(), text(), "new york city " * 9]), rnd.choice(["en", "en", "de", None, "und"]), None) for i in range(120)]
    df = spark.createDataFrame(rows, DOC).withColumn("f", F.lit("clash")).withColumn("ids", F.lit("clash")).repartition(5)
    got = phrases.collocations(df, longest=longest, least=least, top=top).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == collocations_brute([(r[2], r[1]) for r in rows], longest, least, top)


def test_collocations_in_small_blocks(spark, sf, monkeypatch):
    """Many chunks, blocks and shards give the same rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    want = collocations_brute([(r.lang, r.text) for r in docs.collect()])
    monkeypatch.setattr(phrases, "CHUNK", 500), monkeypatch.setattr(phrases, "BLOCK", 20_000), monkeypatch.setattr(phrases, "SHARD", 3_000)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in phrases.collocations(docs).collect()) == want


def test_collocations_without_rows(spark):
    assert phrases.collocations(spark.createDataFrame([], DOC)).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None), (2, "", "en", None), (3, " \n.", "en", None)], DOC)).count() == 0


def test_scores_pass_64_bits(spark):
    score = "(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    row = spark.sql(f"SELECT {score} AS s FROM VALUES (123456789012L, 987654321098L, 123456789999L) v(a, l, r)")
    a, left, right = 123456789012, 987654321098, 123456789999
    assert row.first().s == 1000000 * a * a // (left * right)


@pytest.mark.parametrize("bits", [1, 16, 40, 63, 64, 66, 100, 124])
def test_permutation_and_packing_are_invertible(bits):
    rng = np.random.default_rng(bits)
    p = phrases.Permutation(bits)
    high, low = (rng.integers(0, 1 << p.half, 5000, dtype=np.uint64) for _ in range(2))
    back = p.undo(*p.mix(high, low))
    assert (back[0] == high).all() and (back[1] == low).all()
    words = (1 << bits // 3) - 1
    packing = phrases.Packing(words, 3)
    ids = rng.integers(0, words + 1, (2000, 3)).astype(np.int64)
    assert (packing.unpack(*packing.permutation.undo(*packing.permutation.mix(*packing.pack(ids)))) == ids).all()
    assert len({tuple(map(int, x)) for x in zip(*packing.pack(np.unique(ids, axis=0)))}) == len(np.unique(ids, axis=0))


@pytest.mark.parametrize("half", [8, 20, 32, 33, 62])
def test_quotient_filters_keep_counts(half):
    rng = np.random.default_rng(half)
    want, filters = Counter(), []
    for n in (0, 1, 7, 900, 3000):
        high, low = (rng.integers(0, min(1 << half, 4000), n, dtype=np.uint64) << np.uint64(max(0, half - 12)) & np.uint64((1 << half) - 1) for _ in range(2))
        counts = rng.choice([1, 2, 254, 255, 256, 1 << 40], n)
        for h, lo, c in zip(high.tolist(), low.tolist(), counts.tolist()):
            want[h, lo] += c
        held = phrases.QuotientFilter.of(half, high, low, counts.astype(np.int64))
        for cut in (slice(None), slice(n // 3, n // 2), slice(0, 1)):
            part = phrases.QuotientFilter(half, held.high[cut], held.low[cut], held.counts[cut])
            again = phrases.QuotientFilter.unpack(half, part.pack())
            assert (again.high == part.high).all() and (again.low == part.low).all() and (again.counts == part.counts).all()
        filters.append(held)
    total = phrases.QuotientFilter.merged(filters)
    assert dict(zip(zip(total.high.tolist(), total.low.tolist()), total.counts.tolist())) == dict(want)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


ODD_TEXTS = ["", " ", "  a  b ", "\n", "a\n\nb", "\t", "\x00", "▁", "a▁b", "é é ﬁ 日本語 🙂🙂", "￿", "a" * 5000, " " * 70 + "x", "ab " * 3000, "</s>", "<s> <unk> <0x41>", "\r\n x", "= = ====================", "ᚠ​﻿"]


def test_pieces_equal_the_library(library, sf, spark):
    table = pieces.table_of(queries.piece_model())
    rnd = random.Random(5)
    vocabulary = [library.id_to_piece(i) for i in range(259, library.vocab_size())]
    letters = list("aeinrst  e\n\t▁.,019") + list("éüß日本🙂ñ门​")
    texts = ODD_TEXTS + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(1500)] + ["".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(9))) for _ in range(1500)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text is not None]
    for text in texts:
        ids = library.encode(text)
        assert np.frombuffer(table.encode(text), "<u4").tolist() == ids, text[:80]
        assert table.decode(ids) == library.decode(ids)
    for _ in range(3000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(259), rnd.randrange(3)]) for _ in range(rnd.randrange(8))]
        assert table.decode(ids) == library.decode(ids), ids


def test_pieces_query(spark, sf, library):
    got = {r.doc_id: r for r in queries.op12_piece_table(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        assert tuple(got[r.doc_id])[:4] == (r.doc_id, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids).encode()))


def test_pieces_on_odd_rows(spark, library):
    rows = [(None, "x"), (1, None), (1, None), (2, "")] + [(10 + i, t) for i, t in enumerate(ODD_TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("id", F.lit("clash"))
    out = pieces.decode(pieces.encode(df, queries.piece_model()), queries.piece_model()).withColumn("list", pieces.numbers(F.col("ids"))).collect()
    want = sorted((str(i), library.encode(t or "", add_bos=True, add_eos=True)) for i, t in rows)
    assert sorted((str(r.id), r.list) for r in out) == want
    assert all(r.decoded == library.decode(r.list) for r in out)
    bare = pieces.encode(df.filter("doc_id = 2"), queries.piece_model(), ends=False).withColumn("list", pieces.numbers(F.col("ids"))).first()
    assert bare.list == [] and pieces.encode(df.limit(0), queries.piece_model()).count() == 0


def codes_brute(rows, parts=8, entries=16, rounds=6):
    usable = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    v = [[math.floor(4096 * x) for x in r[1]] for r in usable]
    if not v:
        return [], None
    d = len(v[0]) // parts
    cut = lambda x, p: x[p * d : (p + 1) * d]
    first = sorted(range(len(v)), key=lambda i: (usable[i][0] is None, usable[i][0] or 0, v[i]))[:entries]
    books = [[cut(v[i], p) for i in first] for p in range(parts)]
    far = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))
    assign = lambda: [[min((far(cut(x, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)] for x in v]
    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(x, p) for x, y in zip(v, got) if y[p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    got = assign()
    error, by_label = [sum(e for e, _ in y) for y in got], Counter()
    for r, e in zip(usable, error):
        by_label[r[2]] += e
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{k:02x}" for _, k in y), e, by_label[r[2]]) for r, y, e in zip(usable, got, error)), digest


VEC = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n, dim, values", [(300, 16, 1.0), (7, 8, 0.002), (200, 24, 0.0005), (40, 8, 3000.0)])
def test_codes_brute(spark, n, dim, values):
    """Coarse values give many ties; few rows give small codebooks."""
    rng = np.random.default_rng(n)
    rows = [(i // 2 if i % 9 == 0 else i, [float(np.float32(x)) for x in rng.normal(0, values, dim)], int(rng.integers(3)) if i % 4 else None) for i in range(n)]
    rows += [(1000, None, 1), (1001, [float("nan")] * dim, 1), (1002, [float("inf")] + [0.0] * (dim - 1), 2), (1003, [None] + [0.0] * (dim - 1), 2)] + rows[:3]
    df = spark.createDataFrame(rows, VEC).withColumn("code", F.lit("clash")).withColumn("ints", F.lit("clash")).repartition(3)
    coded, books = vector_codes.compress(df)
    got = vector_codes.label_errors(coded).collect()
    want, digest = codes_brute(rows)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == want and books.digest() == digest
    near = vector_codes.decode(coded, books).filter("vec_id = 1").first().approx
    assert len(near) == dim


def test_active_entries_give_what_full_scans_give():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-6, 7, (500, 16))
    books = vectors[:8].reshape(8, 4, 4).transpose(1, 0, 2).copy()
    codes, errors, moved = np.zeros((500, 4), np.int64), np.zeros((500, 4), np.int64), np.ones((4, 8), bool)
    for turn in range(12):
        codes, errors = vector_codes.reassign(vectors, codes, errors, books, moved)
        for p in range(4):
            far, k = vector_codes.nearest(vectors[:, p * 4 : p * 4 + 4], books[p], np.arange(8))
            assert (far == errors[:, p]).all() and (k == codes[:, p]).all()
        new = books.copy()
        new[rng.integers(4), rng.integers(8)] += rng.integers(-3, 4, 4)
        books, moved = new, (new != books).any(axis=2)


def test_codes_of_odd_lengths_and_no_rows(spark):
    rows = [(i, [float(i + k) for k in range(8)], 1) for i in range(20)] + [(50, [1.0, 2.0], 1), (51, [], None), (52, [1e30] * 8, None)]
    out = {r.vec_id: r for r in vector_codes.label_errors(vector_codes.compress(spark.createDataFrame(rows, VEC))[0]).collect()}
    assert len(out) == 23 and all(out[i].code is None and out[i].error is None for i in (50, 51, 52)) and out[3].code is not None
    assert out[51].label_error is None and out[50].label_error == out[3].label_error
    assert vector_codes.compress(spark.createDataFrame([], VEC))[0].count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, [1.0, 2.0], 1)], VEC))[0].first().code is None
