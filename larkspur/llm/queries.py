"""The registered queries of the training-data operators, and DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table
from . import align, forest, jaccard, lmscore, media, mixing, packing, quality, sharding, substring, trie, urlfilter, warc

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_sharding": _on("documents", sharding.shard_documents),
    "op2_packing": _on("documents", packing.pack_documents),
    "op3_substring_dedup": _on("documents", substring.repeated_passages),
    "op4_lm_scoring": lambda spark, sf_dir: lmscore.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op5_media_columns": _on("documents", media.media_digests),
    "media_clips": lambda spark, sf_dir: media.clips(media.text_media(table(spark, sf_dir, "documents"))),
    "op6_jaccard_join": _on("documents", jaccard.join_documents),
    "op7_quality_rules": _on("documents", quality.judge_documents),
    "op8_url_filters": _on("pages", urlfilter.filter_urls),
    "op9_mixing": _on("documents", mixing.mix_documents),
    "op10_warc": _on("pages", warc.archive_pages),
    "op11_prefix_trie": lambda spark, sf_dir: trie.conversation_trie(table(spark, sf_dir, "conversations")).drop("preorder", "subtree_end"),
    "op12_token_alignment": _on("documents", align.align_documents),
    "op13_minhash_forest": _on("documents", forest.near_duplicates),
}

#: A document's draw, and the times that it is taken under seed s.
_DRAW = "('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, 'null'), md5(coalesce(text, ''))) || '#mix'), 1, 13))::BIGINT"
_TAKEN = """(size * (floor(rate)::BIGINT + CASE WHEN (((draw + s * 70368744177664) % 4503599627370496)::DOUBLE + 0.5::DOUBLE)
          / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT"""

_SHARD = "1.0::DOUBLE / -ln((('0x' || substr(md5(k || '#shard-{i}'), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"

ORACLE_SQL: dict[str, str] = {
    "op1_sharding": """
WITH t(v) AS (  -- the checksum's table, from its polynomial
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))
), b AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, strlen(coalesce(text, ''))::BIGINT + 1 AS size,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
                         lambda c, x: xor(c // 256, v[(xor(c, x) % 256 + 1)::BIGINT])), 4294967295)::BIGINT AS text_crc32
  FROM documents, t
), s AS (
  SELECT *, ["""
    + ", ".join(_SHARD.format(i=i) for i in range(8))
    + """] AS w, """
    + _SHARD.format(i=8)
    + """ AS more, ('0x' || substr(md5(k || '|' || text_crc32::VARCHAR || '#slot'), 1, 13))::BIGINT AS key FROM b
), p AS (
  SELECT *, (list_position(w, list_max(w)) - 1)::INT AS shard, CASE WHEN more > list_max(w) THEN 8 ELSE list_position(w, list_max(w)) - 1 END::INT AS grown_shard FROM s
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY key, doc_id NULLS FIRST, size, text_crc32, grown_shard) - 1 AS slot, grown_shard FROM p
""",
    "op8_url_filters": r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(h, p, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fit AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id
)
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fit ON parts.page_id = fit.page_id
""",
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 3 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w
  FROM s
), f AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
         coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS remaining
  FROM w
), l AS (
  SELECT *, max(CASE WHEN ((total - before)::DOUBLE / remaining) * w <= cap THEN (total - before)::DOUBLE / remaining END) OVER () AS level FROM f
), t AS (
  SELECT source, source_size, CASE WHEN level IS NULL THEN cap::DOUBLE ELSE least(cap::DOUBLE, level * w) END AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM t
), u AS (
  SELECT d.*, r.source_size, r.target, r.rate, """
    + _DRAW
    + """ AS draw FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), a AS (
  SELECT source, target, s, sum("""
    + _TAKEN
    + """) AS taken FROM u, range(64) AS t(s) GROUP BY source, target, s
), best AS (
  SELECT source, s FROM a QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(taken::DOUBLE - target), s) = 1
)
SELECT doc_id, size, source_size, target, """
    + _TAKEN
    + """ AS taken FROM u JOIN best ON u.source IS NOT DISTINCT FROM best.source
""",
    "op10_warc": r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest AS d, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON payload_digest = d
""",
    "op11_prefix_trie": r"""
WITH v(v) AS (  -- the checksum's table, from its polynomial
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))
), t AS (
  SELECT conv_id, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS w,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base FROM t GROUP BY conv_id
), g AS (
  SELECT conv_id, n, base,
         xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT)),
                         lambda a, x: xor(a // 256, v[(xor(a, x) % 256 + 1)::BIGINT])), 4294967295)::BIGINT % 4 AS h
  FROM c, v
), p AS (
  SELECT g.conv_id, g.base, g.h, least(g.h, coalesce(b.n, 0)) AS taken FROM g LEFT JOIN c b ON b.conv_id = g.base
), r AS (
  SELECT p.conv_id, pos AS d, m, w FROM p JOIN t ON t.conv_id = p.base AND pos <= taken
  UNION ALL
  SELECT p.conv_id, pos - h + taken, m, w FROM p JOIN t ON t.conv_id = p.conv_id AND pos > h
), s AS (
  SELECT p.conv_id, coalesce(ms, []) AS ms, coalesce(ws, []) AS ws
  FROM p LEFT JOIN (SELECT conv_id, list(m ORDER BY d) AS ms, list(w ORDER BY d) AS ws FROM r GROUP BY conv_id) l ON l.conv_id = p.conv_id
), e AS (
  SELECT conv_id, d, ms[:d] AS path, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, d = len(ms) AS whole
  FROM (SELECT *, unnest(range(0, len(ms) + 1)) AS d FROM s)
), n AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(w) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole), '')) AS ends_sha256
  FROM e GROUP BY path, d
), k AS (
  SELECT path[:d - 1] AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), f AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.path = n.path
), b AS (
  SELECT path[:a] AS path, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY ALL
)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM f JOIN b ON b.path = f.path LEFT JOIN n u ON f.d > 0 AND u.path = f.path[:f.d - 1]
""",
}
