"""The queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, feistel, filter_audit, fingerprints, maxent, ngram_join, packing, quality, rollup, suffix_dedup, toxicity, vector_codes, warc
from tessera.llm.common import crc_mod, fresh_path, staged, table


def op1_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back."""
    manifest, where = warc.archive_pages(table(spark, sf_dir, "pages"))
    got = warc.read_warc(manifest, where, with_payload=False)
    return got.select(warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to"))


def op2_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a model of the labelled rows outside the held-out fold; null and empty texts get the
    bias alone, repeated rows equal scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert every document's BPE and word counts, revise the BPE ones to count an end token, delete the empty
    documents, and repeat the first batch, which changes nothing."""
    counts = rollup.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    counts = staged(counts, "token-counts")
    keys = ["source", "lang"]
    none = F.lit(None).cast("long")
    event = lambda op, version, n, old=none: counts.select(F.lit(op).alias("op"), *keys, F.lit(version).alias("tokenizer_version"), n.alias("n_tokens"), old.alias("old_tokens"), "text_bytes")
    bpe, words = F.col("n_tokens"), F.col("n_words")
    inserts = event("insert", "word_bpe_49k/1", bpe).unionByName(event("insert", "white_space/1", words))
    kept = rollup.TokenRollup(spark, fresh_path(spark, "token-rollup"))
    kept.commit("0001-insert", inserts)
    kept.commit("0002-revise", event("revise", "word_bpe_49k/1", bpe + 1, bpe))
    kept.commit("0003-delete", event("delete", "word_bpe_49k/1", bpe + 1).unionByName(event("delete", "white_space/1", words)).where("text_bytes = 0"))
    kept.commit("0001-insert", inserts)
    return kept.totals()


def op4_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probabilities by the unigram and the model of the documents outside the held-out fold; null
    and empty texts are an end token."""
    return maxent.score_texts(table(spark, sf_dir, "documents"))


def op5_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences; null and empty texts are an end token, repeated rows give
    pieces each."""
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"))
    slim = staged(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return packing.pack(slim)


def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot by a permutation of row numbers; null texts have no bytes, repeated rows a place each."""
    return feistel.shard(table(spark, sf_dir, "documents"))


def op7_cdc_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text; null texts are empty, equal texts have equal fingerprints."""
    return fingerprints.edit_likeness(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside a benchmark window and the items found; null texts have no words."""
    found = decontamination.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by a model of the labelled rows outside the held-out fold; null and empty texts get the
    score of the zero vector, repeated rows equal scores."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates and its number of links; texts without words are classes of their own."""
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages of 200 bytes that start twice anywhere; null texts are empty,
    rows with equal texts of 200 bytes or more lose all of them."""
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["high"] - s["low"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors whose components are finite, their errors, and a digest of the codebooks; null labels
    are a label, repeated rows are coded alike, no vectors give no rows."""
    coded, books = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    got = vector_codes.with_label_errors(staged(coded, "codes"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return got.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source in every order; null texts are empty, null sources the empty string, null
    ids never repeat a text, repeated rows count each."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op12_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds of op12 written one after another: every part of every vector against every entry."""
    sql = [
        f"""WITH RECURSIVE kept AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label, [floor(x::DOUBLE * 1024) for x in embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        points AS (SELECT row, vec_id, label, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS x FROM kept, range({parts}) t(p)),
        book0 AS (SELECT p, row - 1 AS e, x AS c FROM points WHERE row <= {entries})"""
    ]
    for r in range(rounds + 1):
        sql.append(f"near{r} AS (SELECT row, p, any_value(x) AS x, min(struct_pack(d := list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(x, c)]), e := e)) AS m FROM points JOIN book{r} USING (p) GROUP BY row, p)")
        if r < rounds:
            sql.append(f"mean{r} AS (SELECT p, m.e AS e, i, floor(sum(x[i]) / count(*)) AS c FROM near{r}, range(1, 1000) t(i) WHERE i <= len(x) GROUP BY p, m.e, i)")
            sql.append(f"new{r} AS (SELECT p, e, list(c ORDER BY i) AS c FROM mean{r} GROUP BY p, e)")
            sql.append(f"book{r + 1} AS (SELECT b.p, b.e, coalesce(n.c, b.c) AS c FROM book{r} b LEFT JOIN new{r} n ON b.p = n.p AND b.e = n.e)")
    sql.append(
        f"""coded AS (SELECT row, string_agg(lower(printf('%02x', m.e)), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM near{rounds} GROUP BY row),
        digest AS (SELECT sha256(string_agg(array_to_string([x::BIGINT::VARCHAR for x in c], ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})"""
    )
    return ",\n".join(sql) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (row), digest"


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of the corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_warc_roundtrip, op2_toxicity_ftrl, op3_token_rollup, op4_maxent_lm, op5_bestfit_packing, op6_feistel_sharding, op7_cdc_fingerprints, op8_decontamination, op9_quality_network, op10_ngram_jaccard, op11_suffix_dedup, op12_vector_codes, op13_filter_audit, pipeline)
}

ORACLES: dict[str, str] = {
    "op1_warc_roundtrip": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
        g AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN g.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.first <> d.page_id THEN g.first END AS refers_to
        FROM d LEFT JOIN g USING (payload_digest)
    """,
    "op8_decontamination": r"""
        WITH t AS (SELECT 'd' AS kind, doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'b', item_id::VARCHAR, text FROM benchmark),
        words AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
        d AS (SELECT id, w FROM words WHERE kind = 'd'),
        starts AS (SELECT id AS item, w, least(10, len(w)) AS k, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM words WHERE kind = 'b' AND len(w) > 0),
        windows AS (SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g FROM starts),
        sizes AS (SELECT DISTINCT k FROM windows),
        places AS (SELECT id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, sizes WHERE len(w) >= k),
        hits AS (SELECT id, item, k, p FROM (SELECT id, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g FROM places) JOIN windows USING (k, g)),
        n AS (SELECT id, count(*) AS n_hit FROM (SELECT DISTINCT id, unnest(generate_series(p, p + k - 1)) AS q FROM hits) GROUP BY id),
        found AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item FROM hits WHERE item IS NOT NULL) GROUP BY id)
        SELECT id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (id) LEFT JOIN found USING (id)
    """,
    "op11_suffix_dedup": """
        WITH t AS (SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        blocks AS (SELECT row, 256 * k AS base, h[512 * k + 1 : 512 * k + 512 + 398] AS h, least(256, len(h) // 2 - 256 * k) AS n FROM (SELECT row, h, unnest(range(0, (len(h) // 2 + 255) // 256)) AS k FROM t)),
        places AS (SELECT row, base, h, unnest(range(0, n)) AS j FROM blocks),
        bytes AS (SELECT row, base + j AS i, h[2 * j + 1 : 2 * j + 2] AS b, CASE WHEN 2 * j + 400 <= len(h) THEN md5_number(h[2 * j + 1 : 2 * j + 400]) END AS s FROM places),
        counted AS (SELECT row, i, b, CASE WHEN s IS NOT NULL AND count(*) OVER (PARTITION BY s) > 1 THEN i END AS again FROM bytes),
        covered AS (SELECT row, i, b, max(again) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM counted),
        edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY row ORDER BY i), false) AS begins FROM covered),
        sums AS (SELECT row, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM edges GROUP BY row)
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM t LEFT JOIN sums USING (row)
    """,
    "op12_vector_codes": _op12_sql(),
    "op13_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
        m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
                     + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(first < w.doc_id, false)::INT AS mask
              FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
        cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
        f(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        steps AS (SELECT filter_order, s AS step, bits[s] AS own, coalesce(list_sum(bits[1 : s - 1]), 0)::INT AS before FROM orders, range(1, 6) t(s)),
        got AS (SELECT part, filter_order, step, own, sum(n) FILTER (mask & (before | own) = 0) AS kept, sum(n) FILTER (mask & own > 0 AND mask & before = 0) AS removed, sum(n) FILTER (mask & own > 0 AND mask & before > 0) AS redundant,
                       sum(n) FILTER (mask = own) AS unique_fails, sum(good) FILTER (mask & own > 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & own > 0 AND mask & before = 0) AS toxic_lost
                FROM cells, steps GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
               coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
        FROM got
    """,
}
