"""The opN_ queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from figweave.llm import chat, exact_dedup, fingerprints, line_dedup, mixing, near_dedup, packing, phrases, pieces, quality, sharding, vector_codes, warc
from figweave.llm.shared import write_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in token-budget batches inside optimal length buckets; length in words."""
    return packing.pack_buckets(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op2_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    out = quality.score(docs, model).select(F.col("doc.doc_id").alias("doc_id"), "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts are control strings."""
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.prefix_examples(rows))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.with_next_text(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half))
    rows = rows.select("id", "n_chars", "fp", "next_fp", edited.alias("edited"))
    rows = rows.select("id", "n_chars", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.merkle_fingerprint(F.col("edited")).alias("efp"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fp"), F.col("efp")).alias("near_edited"), fingerprints.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op7_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    read = write_table(warc.reassemble(warc.read_records(spark, path)), "warc-read")
    return warc.resolve_revisits(read).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


def op8_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.pareto_mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", F.round("expected", 6).alias("expected"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: 40 runs of the curve whose row counts differ by one at most."""
    out = sharding.hilbert_shards(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), F.col("curve").alias("hilbert_index"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("doc.text", 256).alias("kept_sha256"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of 2 to 3 words that occur 10 times or more, the first 2000 of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def piece_model() -> str:
    """The public BPE vocabulary with byte fallback that the query uses; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded with begin and end ids, and decoded from its ids."""
    model = piece_model()
    out = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return out.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all usable vectors: 8 parts, 16 entries, 6 rounds."""
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_pack_buckets, op2_nbsvm_quality, op3_minhash_near_dedup, op4_chat_prefix_targets, op5_exact_dedup,
    op6_merkle_fingerprints, op7_warc_segments, op8_pareto_mix, op9_hilbert_shards, op10_line_dedup,
    op11_phrase_collocations, op12_piece_table, op13_vector_codes)}

_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_CONTROL = "|".join(re.escape(x) for x in ("\\", *chat.CONTROL))



def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds written out: codebook c, assignment a, sums of a round, the next codebook."""
    far = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [f"""
        v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        p AS MATERIALIZED (SELECT vec_id, part, e[part * len(e) // {parts} + 1:(part + 1) * len(e) // {parts}] AS x FROM v, range({parts}) t(part)),
        c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, x FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT {entries}))"""]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT p.vec_id, p.part, any_value(p.x) AS x, min({{'d': {far}, 'k': c.k}}) AS best FROM p JOIN c{r} c ON c.part = p.part GROUP BY p.vec_id, p.part)")
        if r < rounds:
            steps.append(f"""
        s{r} AS (SELECT part, k, list((s - (s % n + n) % n) // n ORDER BY i) AS x FROM (
                 SELECT part, best.k AS k, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY part, best.k, i) GROUP BY part, k),
        c{r + 1} AS MATERIALIZED (SELECT c.part, c.k, coalesce(s.x, c.x) AS x FROM c{r} c LEFT JOIN s{r} s ON s.part = c.part AND s.k = c.k)""")
    return f"""WITH {", ".join(steps)},
        h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, k)) AS h FROM c{rounds}),
        o AS (SELECT vec_id, string_agg(lpad(to_hex(best.k), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
        SELECT o.vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY v.label))::BIGINT AS label_error, h.h AS codebooks_sha256 FROM o JOIN v ON v.vec_id = o.vec_id, h"""


ORACLE_SQL = {
    "op11_phrase_collocations": rf"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, {_AZ.format("coalesce(text, '')")} AS t FROM documents),
        s AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?
-
]')) AS piece FROM d),
        w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM s),
        u AS (SELECT lang, unnest(w) AS x FROM w),
        n AS (SELECT lang, count(*) AS n FROM u GROUP BY lang),
        g AS (SELECT lang, unnest([w[i:i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS g FROM w, range(1, 4) t(k)),
        ph AS MATERIALIZED (SELECT lang, g, count(*) AS f FROM g GROUP BY lang, g HAVING count(*) >= 10),
        h AS MATERIALIZED (SELECT lang, g, f, k, array_to_string(g[1:k], ' ') AS head, array_to_string(g[k + 1:], ' ') AS tail FROM ph, range(1, 3) t(k) WHERE k < len(g)),
        e AS MATERIALIZED (SELECT lang, array_to_string(g, ' ') AS e, f FROM ph),
        k AS (SELECT h.lang, h.g, h.f AS a, k, x.f AS l, y.f AS r, (1000000::HUGEINT * h.f * h.f) // (x.f::HUGEINT * y.f) AS score
              FROM h JOIN e x ON x.lang = h.lang AND x.e = h.head JOIN e y ON y.lang = h.lang AND y.e = h.tail),
        c AS (SELECT lang, g, a, min({{'score': score, 'k': k, 'l': l, 'r': r}}) AS c FROM k GROUP BY lang, g, a),
        i AS (SELECT lang, g, max(f) AS f FROM (SELECT lang, g[1:2] AS g, f FROM ph WHERE len(g) = 3 UNION ALL SELECT lang, g[2:3], f FROM ph WHERE len(g) = 3) GROUP BY lang, g),
        o AS (SELECT c.lang, array_to_string(c.g, ' ') AS phrase, a, c.c.l AS l, c.c.r AS r, c.c.score::BIGINT AS score FROM c LEFT JOIN i ON i.lang = c.lang AND i.g = c.g WHERE coalesce(100 * i.f < 50 * a, true))
        SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM o JOIN n ON n.lang = o.lang QUALIFY rank <= 2000""",
    "op13_vector_codes": _codes_sql(),
    "op3_minhash_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
              ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g FROM d),
        x AS (SELECT doc_id, len(g) AS n, hash(unnest(g)) AS h FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id
              AND 100 * a.n >= 75 * b.n AND 100 * b.n >= 75 * a.n
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        r(id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.reach)
        SELECT s.doc_id, len(g) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
        FROM s JOIN (SELECT id, min(reach) AS component_id FROM r GROUP BY id) c ON c.id = s.doc_id""",
    "op4_chat_prefix_targets": rf"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
        f AS (SELECT *, role = 'assistant' OR turn = max(turn) OVER (PARTITION BY conv_id) AS ends,
              sum({len(chat.START) + len(chat.END) + 2} + length(role) + length(text) + len(regexp_extract_all(text, '{_CONTROL}')))
                  OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               (sum(upto) FILTER (WHERE ends))::BIGINT AS formatted_chars, count(*) FILTER (WHERE ends) AS n_examples
        FROM f GROUP BY conv_id""",
    "op7_warc_segments": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
        SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to, 'ok' AS status FROM f""",
    "op5_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_AZ.format("coalesce(text, '')")}) AS h FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
        FROM d WINDOW g AS (PARTITION BY h)""",
    "op10_line_dedup": rf"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, {_AZ.format("regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')")} AS key FROM l),
        s AS (SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        j AS (SELECT k.*, coalesce(s.holder <> k.doc_id, false) AS gone FROM k LEFT JOIN s USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
}
