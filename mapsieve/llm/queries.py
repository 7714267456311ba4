"""The registered queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

from mapsieve.llm import bitmap_join, hash_ring, html_mincut, lm_bloom, ordinal_quality, permutation_index, sentencepiece_sa, suffix_dedup, template_decontam, warc_zst
from mapsieve.llm.common import stored


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scores(spark, sf_dir):
    return lm_bloom.score(_table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"))


def op3_shards(spark, sf_dir):
    return hash_ring.shard(_table(spark, sf_dir, "documents"))


def op4_warc(spark, sf_dir):
    return warc_zst.read(stored(warc_zst.write(_table(spark, sf_dir, "pages")), "uncompressed"))


def op5_sentencepiece(spark, sf_dir):
    return sentencepiece_sa.encode(_table(spark, sf_dir, "documents"))


def op6_main_text(spark, sf_dir):
    return html_mincut.extract(_table(spark, sf_dir, "pages"))


def op7_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return ordinal_quality.score(docs, ordinal_quality.fit(*ordinal_quality.sampled(docs, _table(spark, sf_dir, "labels"))))


def op8_neighbours(spark, sf_dir):
    return permutation_index.search(_table(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark, sf_dir):
    return bitmap_join.join(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark, sf_dir):
    return template_decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_lm_scores, op2_suffix_dedup, op3_shards, op4_warc, op5_sentencepiece, op6_main_text, op7_quality, op8_neighbours, op9_jaccard_join, op10_decontamination)}

#: The laws of the contracts, without the operators' methods: op2 by all substrings, op4 by equal payloads, op9 by all shared shingles.
ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id < page_id THEN first_id END AS refers_to
        FROM f""",
    "op2_suffix_dedup": """
        WITH b AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t, strlen(coalesce(text, '')) AS n FROM documents),
        g AS MATERIALIZED (SELECT r, i, md5(t[i:i + 199]) AS gram FROM (SELECT r, t, unnest(range(1, n - 198)) AS i FROM b WHERE n >= 200)),
        hit AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM g WHERE gram IN (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1)),
        run AS (SELECT r, min(i) AS a, max(i) + 199 AS z FROM (SELECT r, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS k FROM hit) GROUP BY r, k),
        edge AS (SELECT r, a, z FROM run UNION ALL SELECT r, n + 1, n FROM b),
        kept AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM edge),
        rest AS (SELECT kept.r, string_agg(hex(b.t[kept.a:kept.z]), '' ORDER BY kept.a) AS hex FROM kept JOIN b USING (r) WHERE kept.z >= kept.a GROUP BY kept.r),
        gone AS (SELECT r, sum(z - a + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM run GROUP BY r)
        SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(hex, ''))) AS kept_sha256
        FROM b LEFT JOIN gone USING (r) LEFT JOIN rest USING (r)""",
    "op9_jaccard_join": r"""
        WITH RECURSIVE w AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
                ELSE words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] || ' ' || words[i + 4] END AS shingle
            FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM w WHERE len(words) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        rare AS MATERIALIZED (SELECT doc_id, shingle FROM s WHERE shingle IN (SELECT shingle FROM s GROUP BY shingle HAVING count(*) > 1)),
        link AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b FROM rare a JOIN rare b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
        reach (doc_id, low) AS (
            SELECT doc_id, doc_id FROM n
            UNION SELECT link.b, reach.low FROM reach JOIN link ON link.a = reach.doc_id WHERE reach.low < link.b)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r.low, d.doc_id) AS component_id
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(low) AS low FROM reach GROUP BY doc_id) r USING (doc_id)""",
}
