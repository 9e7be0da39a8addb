"""The registered queries of the training-data operators: each applies its operator to the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lm, quality_gam, toxicity
from .common import fresh_path
from .divergence import audit
from .exact_dedup import exact_dedup
from .fim import fill_in_middle, restored
from .host_rules import quality_rules
from .near_dup import near_duplicates
from .packing import pack_documents
from .substring import remove_repeats
from .url_filter import judge
from .warc import read_warc, write_warc


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = public_tokenizers.path("byte_bpe_50k.json"), _docs(spark, sf_dir).select("doc_id", "text")
    out = bpe.encode(docs, path, lexicon=bpe.compile_lexicon(docs, "text", path), decoded_col="decoded")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind, out = pages.schema["page_id"].dataType, fresh_path(spark, "warc")
    write_warc(pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload")), out)
    return read_warc(spark, out, with_payload=False).select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_docs(spark, sf_dir), keep="largest")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_docs(spark, sf_dir))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = labels.select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), bad)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_docs(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_docs(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_docs(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    out = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    out = quality_gam.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select(
        "doc_id", quality_gam.held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"),
        F.col("quality_predicted").alias("predicted"),
    )


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(_docs(spark, sf_dir).select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"), F.sha2("fim_output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim_output"), F.col("fim_form")), 256).alias("restored_sha256"),
    )


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_docs(spark, sf_dir))


QUERIES = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_warc": op2_warc,
    "op3_packing": op3_packing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_lm_score": op5_lm_score,
    "op6_url_filter": op6_url_filter,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_near_dup": op9_near_dup,
    "op10_toxicity": op10_toxicity,
    "op11_quality": op11_quality,
    "op12_fim": op12_fim,
    "op13_divergence": op13_divergence,
}

ORACLE_SQL = {
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op7_quality_rules": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
        win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM tri),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win WHERE c > 1) GROUP BY doc_id),
        line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM line WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        m AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                     (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                     coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
              FROM d LEFT JOIN dup ON dup.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id),
        f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m),
        h AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS k FROM f GROUP BY source),
        p AS (SELECT sum(k) / sum(n) AS m, sum(k * k / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) - (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) * count(*) / sum(n) AS spread FROM h),
        q AS (SELECT m, CASE WHEN spread > 0 THEN least(greatest(m * (1 - m) / spread - 1, 1.0), 1000.0) ELSE 1000.0 END AS weight FROM p),
        r AS (SELECT source, (k + m * weight) / (n + weight) AS host_rate FROM h, q)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rate <= 0.6 AS kept, round(host_rate, 9) AS host_rate
        FROM f JOIN r ON r.source IS NOT DISTINCT FROM f.source""",
    "op12_fim": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x,
                          regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
        h AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
                     ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
        f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        c AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
        FROM c""",
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        g AS (SELECT DISTINCT lang, source FROM d),
        t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
        v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY lang),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
        s AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
        p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
                     (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.total + v.v))::HUGEINT AS p,
                     (1 + (1000000000::HUGEINT * (k.lang_n + 1)) // (v.lang_total + v.v))::HUGEINT AS q
              FROM s JOIN v ON v.lang = s.lang JOIN k ON k.lang = s.lang
              LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value
              FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
              LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
              UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value,
               row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
        FROM r QUALIFY part = 'pair' OR rank <= 200""",
}
