"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.url_filter import Rule, filter_urls

    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), [Rule(*r) for r in RULES]).select("page_id", "host", "path", "rule", "verdict")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusloom.llm.token_shards import read_token_shards, write_token_shards

    return read_token_shards(write_token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.warc import read_archives, write_archives

    return read_archives(write_archives(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.fingerprint import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusloom.llm.pieces import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.language_model import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.toxicity import rate_toxicity

    return rate_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.llm.filter_audit import audit_filters

    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_ALL = (op1_url_filter, op2_token_shards, op3_warc, op4_decontaminate, op5_near_dup, op6_sentencepiece, op7_sharding, op8_language_model, op9_toxicity, op10_fingerprints,
    op11_html_text, op12_whitening, op13_filter_audit)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": r"""
        WITH cut AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
        ), judged AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
    """,
    "op3_warc": """
        WITH body AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM body)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM firsts
    """,
    "op5_near_dup": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), sets AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                   ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM split
        ), elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets
        ), pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS n, any_value(b.n) AS m
            FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT x, y FROM pairs WHERE 100 * c >= 75 * (n + m - c) UNION ALL SELECT y, x FROM pairs WHERE 100 * c >= 75 * (n + m - c)
        ), reach AS (
            SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x
        ), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
    """,
    "op11_html_text": r"""
        WITH cut AS (
            SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(p|h1)>') AS parts FROM pages
        ), plain AS (
            SELECT page_id, url, list_transform(parts, lambda b: regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g')) AS parts FROM cut
        ), decoded AS (
            SELECT page_id, url, list_transform(parts, lambda b: regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')) AS parts FROM plain
        ), spaced AS (
            SELECT page_id, url, list_filter(list_transform(parts, lambda b: trim(regexp_replace(b, '[\x09-\x0D\x20]+', ' ', 'g'))), lambda b: b <> '') AS parts FROM decoded
        )
        SELECT page_id, url, array_to_string(parts, chr(10)) AS text, length(array_to_string(parts, chr(10))) AS n_chars FROM spaced
    """,
    "op13_filter_audit": r"""
        WITH body AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                   min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
        ), marks AS (
            SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1
        ), flags AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END ||
                   CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END ||
                   CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
            FROM body LEFT JOIN marks USING (doc_id)
        ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), steps AS (SELECT filter_order, s::INT AS step, filter_order[s] AS own, filter_order[1:s - 1] AS before FROM orders, range(1, 6) r(s)), replayed AS (
            SELECT part, filter_order, step, own, good, toxic, fails, contains(fails, own) AS bad, len(translate(fails, before, '')) < len(fails) AS gone FROM flags, steps
        ), counts AS (
            SELECT part, filter_order, step, own, count(*) FILTER (NOT bad AND NOT gone) AS kept, count(*) FILTER (bad AND NOT gone) AS removed, count(*) FILTER (bad AND gone) AS redundant,
                   count(*) FILTER (fails = own) AS unique_fails, count(*) FILTER (bad AND NOT gone AND good = 1) AS good_lost,
                   count(*) FILTER (bad AND NOT gone AND toxic = 1) AS toxic_lost FROM replayed GROUP BY ALL
        )
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counts
    """,
}
