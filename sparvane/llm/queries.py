"""The registered queries of this package, over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparvane.llm import annsearch, bpe, hpylm, neardup, orderhash, packing, pii, prefixtrie, topk, toxicity, urlfilter, warc, whitening
from sparvane.llm.common import read

URL_RULES = [
    urlfilter.Rule("block", "com", "/en/"),
    urlfilter.Rule("allow", "example.com", "/en/7"),
    urlfilter.Rule("allow", "net", "/de/"),
    urlfilter.Rule("block", "example.net", "/de/8"),
    urlfilter.Rule("block", "org", "/es/"),
]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, their digest and the decoded text's digest of every document; null texts are empty, very long ones are encoded chunk by chunk, repeated rows stay.  An empty table gives no rows; other columns are ignored."""
    return bpe.digests(read(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document; null texts are empty, very long ones are searched whole, repeated rows stay.  An empty table gives no rows; other columns are ignored."""
    return pii.find(read(spark, sf_dir, "documents"))


def op3_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under a model of the rows that aren't held out; a null or empty text is its end alone, repeated rows count and are scored each.  An empty table gives no rows; other columns are ignored."""
    return hpylm.score(read(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of every document with its place in a sequence of at most 4096 tokens; a null text is its end token, longer ones are cut, repeated rows are packed each.  An empty table gives no rows; other columns are ignored."""
    return packing.pack(read(spark, sf_dir, "documents"), capacity=4096)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, learned from labelled rows that aren't held out; null and empty texts have a score too, repeated rows stay.  An empty table gives no rows; other columns are ignored."""
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url by the longest rule that fits; a null url has an empty host and path and is allowed, repeated rows stay.  An empty table gives no rows; other columns are ignored."""
    return urlfilter.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest integer inner products of each vector whose id is divisible by 100; unusable vectors take no part, ties go to the smaller id.  An empty table gives no rows; other columns are ignored."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op8_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id and the size of its class of near-duplicates; null texts are empty and equal, repeated rows stay.  An empty table gives no rows; other columns are ignored."""
    return neardup.classes(read(spark, sf_dir, "documents"))


def op9_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors found of each whose id is divisible by 50; unusable and zero vectors take no part, ties go to the smaller id.  An empty table gives no rows; other columns are ignored."""
    return annsearch.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each page as it is read back from its archive; null html is an empty payload, repeated payloads of 100 bytes or more are revisits, very long ones are one record.  An empty table gives no rows; other columns are ignored."""
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited form, with their likeness; null texts are empty, repeated rows come out as often as they went in, a document without doc_id comes after the smallest.  An empty table gives no rows; other columns are ignored."""
    return orderhash.fingerprints(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of rebuilt conversations; null roles and texts are empty, turns of equal number follow by a digest of role and text, rows without a conv_id are left out.  An empty table gives no rows; other columns are ignored."""
    return prefixtrie.nodes(read(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each usable vector's first 16 whitened components; equal vectors count once in the fit, components without variance are null.  An empty table gives no rows; other columns are ignored."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=16, scale=64, shift=1_000_000)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_pii, op3_hpylm, op4_best_fit_packing, op5_toxicity, op6_url_filter, op7_exact_top_k, op8_dart_minhash, op9_additive_ann, op10_warc, op11_order_minhash, op12_prefix_trie, op13_whitening)}

ORACLE_SQL = {
    "op6_url_filter": """
WITH u AS (
  SELECT page_id,
    coalesce(CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END, '') AS host,
    coalesce(CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END, '') AS path
  FROM pages),
r(rhost, rpath, said) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block'))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(said, 'allow') AS verdict
FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) + length(rpath) DESC) = 1
""",
    "op7_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
""",
    "op10_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM f
""",
    # CRC-32 by its table of 256 remainders; turns are compared as they stand.
    "op12_prefix_trie": """
WITH crc AS (SELECT list_transform(generate_series(0, 255), lambda n: list_reduce([CAST(n AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 4 AS h FROM own, crc),
built AS (SELECT o.conv_id, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS p FROM h o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
pre AS (SELECT conv_id, p[1:d] AS q, d, len(p) = d AS ends FROM (SELECT conv_id, p, unnest(generate_series(0, len(p))) AS d FROM built)),
node AS (SELECT q, d, min(conv_id) AS owner, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN d > 0 THEN len(regexp_extract_all(q[d].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words FROM pre GROUP BY q, d),
child AS (SELECT q[1:d - 1] AS q, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
own_sums AS (SELECT node.q, node.d, CAST(child.n IS NULL AS BIGINT) AS leaf, (node.n - 1) * words AS saved FROM node LEFT JOIN child ON node.d = child.d AND node.q = child.q),
tree AS (SELECT q[1:k] AS q, k AS d, sum(leaf) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(generate_series(0, d)) AS k FROM own_sums) GROUP BY ALL)
SELECT node.owner AS conv_id, CAST(node.d AS BIGINT) AS depth, above.owner AS parent_conv_id, node.n AS n_convs, coalesce(child.n, 0) AS n_children,
  CAST(tree.leaves AS BIGINT) AS n_leaves, CAST(tree.saved AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node JOIN tree ON tree.d = node.d AND tree.q = node.q LEFT JOIN child ON child.d = node.d AND child.q = node.q LEFT JOIN node above ON above.d = node.d - 1 AND above.q = node.q[1:node.d - 1]
""",
}
