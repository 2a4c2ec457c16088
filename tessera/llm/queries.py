"""Queries of this subpackage, with the parameters meant for production."""

from __future__ import annotations

from tessera.llm import alignment, bpe, exact_dedup, licenses, line_dedup, merkle, mixing, neighbours, ngram_jaccard, quality, token_counts, token_files, warc
from tessera.session import prepare, shared_dir, table


def op1_token_counts(spark, sf_dir):
    cache = spark.conf.get("spark.tessera.token.cache", None) or shared_dir(spark, "token-cache")
    return token_counts.token_counts(table(prepare(spark), sf_dir, "documents"), cache, "piece_bpe_32k.model")


def op2_token_files(spark, sf_dir):
    return token_files.token_file_report(table(prepare(spark), sf_dir, "documents"), "word_bpe_49k.json", end_id=1)


def op3_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest_neighbours(table(prepare(spark), sf_dir, "embeddings"))


def op4_line_dedup(spark, sf_dir):
    return line_dedup.line_report(table(prepare(spark), sf_dir, "documents"))


def op5_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard.jaccard_components(table(prepare(spark), sf_dir, "documents"), size=4, percent=85)


def op6_warc(spark, sf_dir):
    return warc.archive_report(table(prepare(spark), sf_dir, "pages")).drop("url")


def op7_bpe(spark, sf_dir):
    return bpe.bpe_digests(table(prepare(spark), sf_dir, "documents"), "word_bpe_49k.json")


def op8_quality(spark, sf_dir):
    return quality.quality_report(table(prepare(spark), sf_dir, "documents"))


def op9_licenses(spark, sf_dir):
    return licenses.license_report(table(prepare(spark), sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing.mixing_report(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_alignment(spark, sf_dir):
    return alignment.alignment_report(table(prepare(spark), sf_dir, "documents"), "byte_bpe_50k.json", "piece_bpe_32k.model")


def op12_merkle_manifest(spark, sf_dir):
    return merkle.merkle_report(table(prepare(spark), sf_dir, "documents"))


def op13_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(prepare(spark), sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_token_files, op3_nearest_neighbours, op4_line_dedup, op5_ngram_jaccard, op6_warc, op7_bpe, op8_quality, op9_licenses, op10_mixing, op11_alignment, op12_merkle_manifest, op13_exact_dedup)}

ORACLE_SQL = {
    "op9_licenses": licenses.oracle_sql(),
    "op12_merkle_manifest": merkle.oracle_sql(),
    "op13_exact_dedup": """
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w = 1 AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST)""",
    "op3_nearest_neighbours": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10""",
    "op4_line_dedup": """
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        h AS (SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
        m AS (SELECT k.*, h.key IS NOT NULL AND h.holder <> k.doc_id AS gone FROM k LEFT JOIN h ON k.key = h.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op6_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        r AS (SELECT payload_digest, max(page_id) AS best FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
        SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN r.best <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN r.best <> p.page_id THEN r.best END AS refers_to
        FROM p LEFT JOIN r ON p.payload_digest = r.payload_digest AND p.payload_bytes >= 1000""",
}
