"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varicube.llm import (
    archive, centroids, decontamination, exact_dedup, lattice, mixing, pii, prefix_trie, quality, sharding, simhash, token_orc, wrappers,
)
from varicube.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality(spark, sf):
    docs = table(spark, sf, "documents")
    return quality.scores(docs, quality.fit(docs, table(spark, sf, "labels")))


@query
def op2_mixing(spark, sf):
    return mixing.mixture(table(spark, sf, "documents")).drop("source", "copies")


ORACLE["op2_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w,
    2.0::DOUBLE * source_size AS cap FROM totals),
trial AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) AS left_over,
    sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS w_left, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k
  FROM ranked WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(left_over / w_left, k) AS level FROM trial WHERE cap >= left_over / w_left * w),
target AS (
  SELECT source, source_size, least(cap, coalesce(level * w, cap)) AS target FROM trial, level),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS coin
  FROM sized d JOIN target t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM rated
"""


@query
def op3_lattice(spark, sf):
    return lattice.scores(table(spark, sf, "documents"))


@query
def op4_decontamination(spark, sf):
    return decontamination.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op5_wrappers(spark, sf):
    return wrappers.main_text(table(spark, sf, "pages"))


@query
def op6_warc(spark, sf):
    return archive.round_trip(table(spark, sf, "pages"))


@query
def op7_exact_dedup(spark, sf):
    return exact_dedup.classes(table(spark, sf, "documents"))


ORACLE["op7_exact_dedup"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(text) AS text_sha256
FROM t WINDOW g AS (PARTITION BY text)
"""


@query
def op8_simhash(spark, sf):
    found = simhash.classes(table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.element_at("codes", 1)), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op9_pii(spark, sf):
    return pii.find(table(spark, sf, "documents"))


@query
def op10_sharding(spark, sf):
    return sharding.shard_table(table(spark, sf, "documents")).drop("source")


@query
def op11_centroids(spark, sf):
    return centroids.clustered(table(spark, sf, "embeddings"))


def _centroid_sql(rounds: int = centroids.ROUNDS, clusters: int = centroids.CLUSTERS) -> str:
    """The rounds unrolled: d holds distances, c the centroids, both of one round."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM kept)
  ORDER BY h, q LIMIT {clusters})"""]
    for t in range(rounds + 1):
        steps.append(f"""
d{t} AS MATERIALIZED (
  SELECT r, min(CAST(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT) * 16 + k) AS m
  FROM kept v, c{t} c GROUP BY r)""")
        if t < rounds:
            steps.append(f"""
s{t} AS (
  SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT CAST(m % 16 AS INT) AS k, unnest(q) AS x, unnest(range(64)) AS i FROM d{t} JOIN kept USING (r)) GROUP BY k, i),
c{t + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(moved, c.q) AS q FROM c{t} c
  LEFT JOIN (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS moved FROM s{t} GROUP BY k) USING (k))""")
    last = rounds
    return "WITH" + ",".join(steps) + f"""
SELECT vec_id, CAST(m % 16 AS INT) AS cluster, CAST(m // 16 AS BIGINT) AS distance,
  CAST(sum(m // 16) OVER (PARTITION BY m % 16) AS BIGINT) AS cluster_inertia, CAST(sum(m // 16) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM d{last} JOIN kept USING (r) JOIN c{last} c ON c.k = m % 16
"""


ORACLE["op11_centroids"] = _centroid_sql()


@query
def op12_token_orc(spark, sf):
    return token_orc.report(table(spark, sf, "documents"))


@query
def op13_prefix_trie(spark, sf):
    return prefix_trie.trie(table(spark, sf, "conversations"))


ORACLE["op13_prefix_trie"] = """
WITH crc_table AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, _: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t
  FROM range(256) r(i)),
turns AS MATERIALIZED (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table),
placed AS (
  SELECT c.conv_id, 0 AS own, p, turn FROM convs c JOIN turns t ON t.conv_id = c.base WHERE p <= h
  UNION ALL SELECT c.conv_id, 1, p, turn FROM convs c JOIN turns t USING (conv_id) WHERE p > h),
numbered AS (
  SELECT conv_id, turn, row_number() OVER w AS depth, list(turn) OVER (w ROWS UNBOUNDED PRECEDING) AS path
  FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY own, p)),
members AS MATERIALIZED (
  SELECT conv_id, depth, path FROM numbered UNION ALL SELECT conv_id, 0, [] FROM convs),
ending AS (
  SELECT arg_max(path, depth) AS path, conv_id FROM members GROUP BY conv_id),
ended AS (
  SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM ending GROUP BY path),
nodes AS MATERIALIZED (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, CASE WHEN depth > 0 THEN length(path[depth].text) ELSE 0 END AS chars
  FROM members GROUP BY path, depth),
children AS MATERIALIZED (
  SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
weighed AS MATERIALIZED (
  SELECT nodes.path, depth, conv_id, n, chars, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
up AS (SELECT path[:d] AS path, n, chars, n_children FROM weighed, LATERAL (SELECT unnest(range(depth + 1)) AS d)),
below AS (
  SELECT path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum((n - 1) * chars) AS BIGINT) AS saved_tokens FROM up GROUP BY path)
SELECT w.conv_id, w.depth, parent.conv_id AS parent_conv_id, w.n AS n_convs, w.n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM weighed w JOIN below USING (path) LEFT JOIN ended USING (path) LEFT JOIN weighed parent ON w.depth > 0 AND parent.path = w.path[:w.depth - 1]
"""
