"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import archive, decontaminate, exact_dedup, jaccard, language, mixing, quality, toxicity, training_order, url_filter
from .common import table

#: The rules of the URL query as (verdict, host, path).
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.round_trip(spark, table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.ordered(table(spark, sf_dir, "documents")).drop("path")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_quality, op3_language, op4_warc, op5_jaccard_join, op6_decontamination, op7_exact_dedup, op8_url_filter, op9_toxicity, op10_training_order)}

SQL = {
    "op1_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source),
        f AS (SELECT *, 3 * sum(n) OVER () AS twice, sum(w) OVER () AS weights, coalesce(sum(2 * n) OVER o, 0) AS before, coalesce(sum(w) OVER o, 0) AS above FROM s
              WINDOW o AS (ORDER BY 2 * n / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT *, 4 * n * (weights - above) <= w * (twice - 2 * before) AS filled FROM f),
        g AS (SELECT *, sum(CASE WHEN filled THEN 2 * n ELSE 0 END) OVER () AS fulls, sum(CASE WHEN filled THEN w ELSE 0 END) OVER () AS full_w FROM c),
        -- a target is num / den
        t AS (SELECT source, no, n, CASE WHEN filled THEN 2 * n ELSE w * (twice - 2 * fulls) END::BIGINT AS num, CASE WHEN filled THEN 1 ELSE 2 * (weights - full_w) END::BIGINT AS den FROM g),
        u AS (SELECT *, num::DOUBLE / den AS target, sum(num::DOUBLE / den) OVER () AS total FROM t),
        seats AS (SELECT floor(sum(target) / 64 + 0.5)::BIGINT AS m FROM u),
        q AS (SELECT no, row_number() OVER (ORDER BY num::DOUBLE / (den * (2 * k + 1)) DESC, no) AS place
              FROM (SELECT u.*, unnest(range((target * m / total)::BIGINT + 4)) AS k FROM u, seats WHERE target > 0)),
        quota AS (SELECT no, count(*) AS q FROM q, seats WHERE place <= m GROUP BY no),
        own AS (SELECT d.*, u.no, u.n, u.target, greatest(1, (u.n + 1048575) // 1048576) AS shards, ('0x' || substr(md5('17/' || doc_id), 1, 8))::BIGINT AS h, ('0x' || substr(md5('18/' || doc_id), 1, 8))::BIGINT AS o
                FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source),
        sh AS (SELECT no, h % shards AS shard, sum(size)::BIGINT AS words, any_value(coalesce(source, '')) AS name FROM own GROUP BY ALL),
        sq AS (SELECT no, shard, row_number() OVER (PARTITION BY no ORDER BY words::DOUBLE / (2 * k + 1) DESC, shard) AS place
               FROM (SELECT sh.*, unnest(range((words * q / sum(words) OVER (PARTITION BY no))::BIGINT + 4)) AS k FROM sh JOIN quota USING (no) WHERE words > 0)),
        runs AS (SELECT no, shard, name, greatest(1, (words + 63) // 64)::BIGINT AS b, coalesce((SELECT count(*) FROM sq JOIN quota USING (no) WHERE sq.no = sh.no AND sq.shard = sh.shard AND place <= q), 0) AS q FROM sh),
        p AS (SELECT no, shard, b, least(q, 2 * b) // b AS whole, least(q, 2 * b) % b AS rest, ('0x' || substr(md5('17/' || name || '/' || shard || '/start'), 1, 8))::BIGINT % b AS begin,
                     1 + ('0x' || substr(md5('17/' || name || '/' || shard || '/stride'), 1, 8))::BIGINT % b AS low FROM runs),
        p2 AS (SELECT p.*, list_filter(range(low, low + 1000), lambda x: gcd(x, b) = 1)[1] AS stride FROM p),
        a AS (SELECT *, (sum(size) OVER (PARTITION BY no, h % shards ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS place FROM own),
        x AS (SELECT a.doc_id, a.size, a.n, a.target, whole, list_filter(CASE WHEN a.size > 0 THEN range(place // 64, (place + a.size - 1) // 64 + 1) ELSE [] END, lambda k: (begin + stride * k) % b < rest) AS picked, place
              FROM a JOIN p2 ON a.no = p2.no AND a.h % a.shards = p2.shard)
        SELECT doc_id, size, n AS source_size, target,
               (whole * size + coalesce(list_sum(list_transform(picked, lambda k: least(64 * k + 64, place + size) - greatest(64 * k, place))), 0))::BIGINT AS taken FROM x
    """,
    "op4_warc": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, unhex(sha1(body)) AS h, max(page_id) OVER (PARTITION BY body) AS keep FROM t),
        b AS (SELECT page_id, payload_bytes, keep, array_to_string(list_transform(range(32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ('0b' || substr(h::BIT::VARCHAR, 5 * i + 1, 5))::INT, 1)), '') AS payload_digest FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> keep THEN keep END AS refers_to FROM b
    """,
    "op5_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        inv AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
        links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM inv a JOIN inv b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
                               HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION (SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a))
        SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(b) FROM reach WHERE a = doc_id) AS component_id FROM s
    """,
    "op7_exact_dedup": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(body) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY body)
    """,
    "op8_url_filter": r"""
        WITH s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM s),
        r(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        m AS (SELECT page_id, host, path, rh || rp AS rule, verdict,
                     row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN rh IS NULL THEN 0 ELSE length(rh || rp) END DESC) AS k
              FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
    """,
}
