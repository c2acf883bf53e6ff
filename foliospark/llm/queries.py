"""One query for each operator, over its whole intended table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_search, backoff, divergence, exact_dedup, fill_middle, language, mixing, near_join, packed_tokens, packing, quality, sentencepieces, toxicity
from .common import fold, table, written

#: The public vocabulary files are parameters of the operators; these are the production ones.
WORD_BPE, PIECE_MODEL, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_ok").cast("int").alias("predicted"))


def op2_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic").cast("int").alias("predicted"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).select("doc_id", "source", "mix_source", "mix_block", "mix_slot", "mix_position")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.join(table(spark, sf_dir, "documents"))


def op6_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit(table(spark, sf_dir, "documents"))
    found = language.identify(table(spark, sf_dir, "pages"), model)
    return found.select("page_id", "lang", "probability", "text_lang", "declared", "suffix", "host")


def op7_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = packed_tokens.write_store(table(spark, sf_dir, "documents"), WORD_BPE)
    return packed_tokens.catalogue(spark, path)


def op8_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_tokens", F.round("log_score", 6).alias("log_score"), "n_full", "n_backed_off")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepieces.encode(docs, PIECE_MODEL).drop("text")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.digest(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    back = fill_middle.restored(F.col("fim_form"), F.col("fim_text"))
    digests = digest(F.col("fim_text")).alias("output_sha256"), digest(back).alias("restored_sha256")
    return made.select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"), *digests)


OPERATORS = (
    op1_quality_classifier,
    op2_additive_quantisation,
    op3_toxicity,
    op4_source_mixing,
    op5_ngram_jaccard_join,
    op6_language_fusion,
    op7_packed_tokens,
    op8_stupid_backoff,
    op9_sentencepiece,
    op10_exact_dedup,
    op11_packing,
    op12_source_divergence,
    op13_fill_in_middle,
)
QUERIES = {f.__name__: f for f in OPERATORS}

ORACLE_SQL = {
    "op8_stupid_backoff": r"""
        WITH docs AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
        places AS (SELECT doc_id, len(w) AS n_tokens, unnest(range(1, len(w) + 1)) AS i, w FROM docs),
        g AS (SELECT doc_id, i, w[i] AS w3, CASE WHEN i > 1 THEN w[i - 1] END AS w2, CASE WHEN i > 2 THEN w[i - 2] END AS w1 FROM places),
        c1 AS (SELECT w3 AS a, count(*) AS n FROM g GROUP BY ALL),
        c2 AS (SELECT w2 AS a, w3 AS b, count(*) AS n FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
        c3 AS (SELECT w1 AS a, w2 AS b, w3 AS c, count(*) AS n FROM g WHERE w1 IS NOT NULL GROUP BY ALL),
        total AS (SELECT count(*) AS n FROM g),
        j AS (
            SELECT g.*, t3.n AS n3, t2c.n AS n2c, t2.n AS n2, t1c.n AS n1c, t1.n AS n1, total.n AS nn
            FROM g CROSS JOIN total
            JOIN c1 t1 ON t1.a = g.w3
            LEFT JOIN c1 t1c ON t1c.a = g.w2
            LEFT JOIN c2 t2 ON t2.a = g.w2 AND t2.b = g.w3
            LEFT JOIN c2 t2c ON t2c.a = g.w1 AND t2c.b = g.w2
            LEFT JOIN c3 t3 ON t3.a = g.w1 AND t3.b = g.w2 AND t3.c = g.w3),
        s AS (
            SELECT doc_id,
                   CASE WHEN n3 >= 2 THEN ln(n3 / n2c)
                        WHEN n2 >= 2 THEN ln(n2 / n1c) + CASE WHEN w1 IS NULL THEN 0 ELSE ln(0.4) END
                        ELSE ln(n1 / nn) + CASE WHEN w2 IS NULL THEN 0 WHEN w1 IS NULL THEN 1 ELSE 2 END * ln(0.4) END AS score,
                   CASE WHEN w1 IS NOT NULL THEN n3 >= 2 WHEN w2 IS NOT NULL THEN n2 >= 2 ELSE true END AS hit
            FROM j)
        SELECT d.doc_id, len(d.w) AS n_tokens, round(coalesce(sum(s.score), 0), 6) AS log_score,
               count(*) FILTER (s.hit) AS n_full, count(*) FILTER (NOT s.hit) AS n_backed_off
        FROM docs d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, d.w""",
    "op10_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op12_source_divergence": r"""
        WITH docs AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents),
        occurrences AS (SELECT lang, source, unnest(w) AS term FROM docs),
        df AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM docs) GROUP BY lang, term HAVING count(*) >= 3),
        n AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM occurrences JOIN df USING (lang, term) GROUP BY ALL),
        v AS (SELECT d.lang, count(df.term) AS v FROM (SELECT DISTINCT lang FROM docs) d LEFT JOIN df ON df.lang = d.lang GROUP BY d.lang),
        grp AS (
            SELECT g.lang, g.source, v.v, coalesce(sum(n.n), 0)::HUGEINT AS total
            FROM (SELECT DISTINCT lang, source FROM docs) g JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
            GROUP BY ALL),
        ln AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM n GROUP BY ALL),
        lt AS (SELECT lang, sum(n)::HUGEINT AS total FROM ln GROUP BY ALL),
        p AS (
            SELECT g.lang, g.source, df.term, coalesce(n.n, 0) AS n, 1 + (1000000000 * (coalesce(n.n, 0) + 1)) // (g.total + g.v) AS p
            FROM grp g JOIN df ON df.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = df.term),
        q AS (SELECT ln.lang, ln.term, 1 + (1000000000 * (ln.n + 1)) // (lt.total + v.v) AS q FROM ln JOIN lt ON lt.lang = ln.lang JOIN v ON v.lang = ln.lang),
        pair AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::BIGINT AS value
            FROM grp a JOIN grp b ON b.lang = a.lang AND b.source <> a.source
            LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
            LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
            GROUP BY ALL),
        term AS (
            SELECT p.lang, p.source, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // q.q)::BIGINT AS value
            FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
        SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
        UNION ALL
        SELECT * FROM (
            SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term)
        WHERE rank <= 200""",
    "op13_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        k AS (
            SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
                   CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
            FROM d),
        c AS (
            SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM k),
        parts AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                                WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM parts""",
}
