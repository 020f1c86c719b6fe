"""Brute force for the classifier's fit and the Hilbert index, and values on odd rows."""

import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from figweave.llm import fingerprints, line_dedup, mixing, packing, quality, sharding

DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", "a", 6), (4, "Same text here, same TEXT here now", "en", "a", 34), (5, "same text here, same text here now", None, "b", 34),
    (5, "same text here, same text here now", None, "b", 34), (None, "same text here, same text here now", "en", None, 34), (6, "x" * 200_000, "en", "b", 200_000), (7, "é" * 50 + "\n" + "É" * 50, "fr", "b", 101),
    (8, "one two three", "en", "a", 13), (9, "one  two\nthree", "en", "a", 13),
]


def odd_rows(spark):
    return spark.createDataFrame(ODD, DOC).withColumn("id", F.lit("clash")).withColumn("size", F.lit("clash"))


def words(text):
    return len((text or "").translate({c: " " for c in range(9, 14)}).split(" ")) - (text or "").translate({c: " " for c in range(9, 14)}).split(" ").count("")


def features_brute(text):
    """Feature numbers by their definition, one n-gram at a time."""
    raw = (text or "").encode()
    found = {quality.BIAS}
    for base, n in ((0, 3), (1 << quality.BITS, 5)):
        for i in range(len(raw) - n + 1):
            code = raw[i]
            for b in raw[i + 1 : i + n]:
                code = code * 0x01000193 & 0xFFFFFFFF ^ b
            found.add(base + (code * 0x9E3779B1 & 0xFFFFFFFF) // (1 << 32 - quality.BITS))
    parts = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in (text or "")).split(" ") if w]
    if len(parts) > 1:
        same = [(sum(a.encode()), len(a.encode())) == (sum(b.encode()), len(b.encode())) for a, b in zip(parts, parts[1:])]
        found.add(quality.BIAS + 1 + sum(sum(same) / len(same) >= x for x in quality.LEVELS))
    return sorted(found)


def test_features_brute():
    for text in ["", None, "a", "ab cd", "the the the the", "é" * 9, "one two  three\tthree", "x" * 1000, " lead", "tail "]:
        assert quality.features(text).tolist() == features_brute(text), text


def test_fit_is_the_support_vector_optimum():
    """Ratios by counting, and weights whose primal value meets the dual value of the same problem, solved densely."""
    rng = np.random.default_rng(1)
    sets = [sorted({quality.BIAS, *rng.choice(12, 4, replace=False).tolist(), *([20] if k % 3 else [21])}) for k in range(40)]
    y = np.array([k % 3 > 0 if k % 10 else k % 3 == 0 for k in range(40)])
    rows = [quality.packed(np.array(x, np.uint32)) for x in sets]
    ratios = quality.log_count_ratios(rows, y)
    p, q = (Counter(i for x, label in zip(sets, y) if bool(label) == side for i in x) for side in (True, False))
    total = lambda c: sum(c.values()) + quality.SIZE
    for i in range(30):
        assert math.isclose(ratios[i], math.log((p[i] + 1) / total(p)) - math.log((q[i] + 1) / total(q)), abs_tol=1e-12)
    x = np.zeros((40, 30))
    for k, found in enumerate(sets):
        for i in found:
            if i < 30:
                x[k, i] = ratios[i] / math.sqrt(len(found))
    bias = np.array([ratios[quality.BIAS] / math.sqrt(len(f)) for f in sets])
    x = np.column_stack([x, bias])
    sign = np.where(y, 1.0, -1.0)
    alpha = np.zeros(40)
    gram = (x @ x.T) * np.outer(sign, sign)
    for _ in range(20_000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, 1)
    dual = alpha.sum() - 0.5 * alpha @ gram @ alpha
    mine = quality.dual_coordinate_descent(rows, y, ratios, epochs=2000)
    w = np.array([mine[i] / ratios[i] if ratios[i] else 0.0 for i in [*range(30), quality.BIAS]])
    primal = 0.5 * w @ w + np.maximum(0, 1 - sign * (x @ w)).sum()
    assert primal < dual * 1.01 + 1e-6


def test_fit_counts_a_repeated_id_once(spark):
    docs = spark.createDataFrame([(1, f"copy {k}") for k in range(500)] + [(k, f"text {k}") for k in range(2, 12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 12)] + [(1, 0), (1, None), (None, 1)], "doc_id long, quality int")
    seen = []
    plain = quality.log_count_ratios
    try:
        quality.log_count_ratios = lambda rows, y: (seen.append(len(rows)), plain(rows, y))[1]
        quality.fit(docs, labels)
        quality.fit(docs, labels, max_rows=6)
    finally:
        quality.log_count_ratios = plain
    assert max(seen) <= 11 and seen[-1] <= 6


def hilbert_brute(cells, bits):
    """The curve drawn by recursion: each cube is visited by its Gray-coded sub-cubes, the index is the place in that walk."""
    n = len(cells)
    x = list(cells)
    for j in range(bits - 1, 0, -1):
        q = 1 << j
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for j in range(bits - 1, 0, -1):
        if x[n - 1] & 1 << j:
            t ^= (1 << j) - 1
    x = [v ^ t for v in x]
    return sum((x[i] >> j & 1) << (j * n + n - 1 - i) for i in range(n) for j in range(bits))


def test_hilbert_index_is_a_walk(spark):
    """Every cell once, and steps of one: what makes it a Hilbert curve; and equal to a plain loop."""
    for n, bits in ((2, 3), (3, 2), (3, 3)):
        cells = list(itertools.product(range(1 << bits), repeat=n))
        df = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(n)))
        got = {tuple(r)[:n]: r.h for r in df.select("*", sharding.hilbert_index([F.col(f"c{i}") for i in range(n)], bits).alias("h")).collect()}
        assert sorted(got.values()) == list(range(len(cells)))
        walk = sorted(got, key=got.get)
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(walk, walk[1:]))
        assert all(h == hilbert_brute(c, bits) for c, h in got.items())


def test_values_on_odd_rows(spark):
    odd = odd_rows(spark)
    shards = sharding.hilbert_shards(odd).collect()
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, *_ in ODD)
    assert sorted((r["size"], r.text_crc32) for r in shards) == want and sorted(r.shard for r in shards) == sorted(k * 40 // len(ODD) for k in range(len(ODD)))
    packs = packing.pack_buckets(odd).collect()
    assert len(packs) == len(ODD)
    lines = line_dedup.line_dedup(odd).select("doc.doc_id", "doc.text", "n_lines", "n_dropped").collect()
    texts = Counter((r.doc_id, r.text) for r in lines)
    # one line in the documents 4, 5 and the one without id: it stays in 5, which is two rows
    gone = {4, None}
    assert texts == Counter((i, "" if t is None or i in gone else t) for i, t, *_ in ODD)
    assert sum(r.n_dropped for r in lines) == 2 and {r.doc_id: r.n_lines for r in lines}[7] == 2
    mix = mixing.pareto_mix(odd).collect()
    assert sorted(r["size"] for r in mix) == sorted(words(t) for _, t, *_ in ODD)
    assert all(r.taken <= 3 * r["size"] and (r["size"] or not r.taken) for r in mix)
    prints = fingerprints.fingerprints(odd)
    names = prints.columns
    assert prints.count() == len(ODD), names


def test_next_text_on_odd_rows(spark):
    """Descending ids, the one without last, then the first again; repeated ids side by side."""
    rows = fingerprints.with_next_text(odd_rows(spark), "doc_id", "text").collect()
    text = {i: t or "" for i, t, *_ in ODD}
    after = {9: 8, 8: 7, 7: 6, 4: 3, 3: 2, 2: 1, 1: None, None: 9}
    for r in rows:
        if r.id in after:
            assert r.next_text == text[after[r.id]] or r.id == 6, r.id
    assert hashlib.sha256(text[7].encode()).hexdigest() and len(rows) == len(ODD)
