"""Registered queries of the subpackage and the SQL twins of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chunks, conversations, decontamination, html_text, inner_products, language, lexical_search, near_duplicates, personal_data, pieces, secret_scan, urls, winnowing,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, s, s + 12), ' ') AS t
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
runs AS (SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS t
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
occ AS (SELECT doc_id, s, runs.n, item_id FROM runs JOIN win USING (t)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id
"""


@query("op3_decontaminate", OP3_SQL)
def op3(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


@query("op4_secrets")
def op4(spark, sf_dir):
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


@query("op9_fingerprints")
def op9(spark, sf_dir):
    return winnowing.fingerprints(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 2), ' ') AS t
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, m IS NULL OR d.doc_id <= m AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""


@query("op7_near_duplicates", OP7_SQL)
def op7(spark, sf_dir):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents")).drop("class", "key")


@query("op8_substring_dedup")
def op8(spark, sf_dir):
    return chunks.substring_dedup(table(spark, sf_dir, "documents"))


@query("op1_personal_data")
def op1(spark, sf_dir):
    return personal_data.personal_data(table(spark, sf_dir, "documents"))


@query("op2_language")
def op2(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query("op5_url_filter")
def op5(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op6_main_text")
def op6(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query("op10_sentencepiece")
def op10(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0) q JOIN v c ON len(c.v) = len(q.v) AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""


@query("op11_top_products", OP11_SQL)
def op11(spark, sf_dir):
    vectors = inner_products.quantised(table(spark, sf_dir, "embeddings"))
    return inner_products.top_products(vectors, vectors.where("vec_id % 100 = 0"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (SELECT i, item_id, t, count(*) AS times FROM i GROUP BY ALL),
n AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
wt AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, n),
m AS (SELECT r, doc_id, 75 + (25 * len(w) * n_docs) // n_terms AS m FROM d, n WHERE len(w) > 0),
s AS (SELECT i, item_id, doc_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM asked JOIN wt USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 20
"""


@query("op12_lexical_search", OP12_SQL)
def op12(spark, sf_dir):
    return lexical_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda a, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda c, i: xor(c >> 1, CAST(3988292384 AS BIGINT) * (c & 1)), xor(a, b)),
      CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 20 AS d FROM given),
rows_ AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
      CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE d <> 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
      rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM rows_),
flt AS (SELECT *, said = '' AS blank, said <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
      left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ord),
f AS (SELECT *, said <> '' AND NOT dup AND right(said, 1) NOT IN ('.', '!', '?') AS cut, blank OR dup AS gone FROM flt),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, CAST(count_if(blank) AS BIGINT) AS blank, CAST(count_if(dup) AS BIGINT) AS duplicate,
      CAST(count_if(cut) AS BIGINT) AS truncated, CAST(count_if(before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS BIGINT) AS illegal FROM f GROUP BY conv_id),
-- a path is (cost, audit, repaired); `least` compares the lists in this order, a null one is no path
e AS (SELECT conv_id, i, role || ':' || text AS line, r, ':' || text AS body, CAST(cut AS BIGINT) AS c, gone FROM f),
go AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {'c': CAST(0 AS BIGINT), 'a': '', 'o': ''} AS n, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR)) AS s,
    CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR)) AS u, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, o VARCHAR)) AS a FROM f
  UNION ALL
  SELECT go.conv_id, e.i,
    CASE WHEN n IS NOT NULL THEN {'c': n.c + 3, 'a': n.a || 'D', 'o': n.o} END,
    list_min(list_filter([
      CASE WHEN s IS NOT NULL THEN {'c': s.c + 3, 'a': s.a || 'D', 'o': s.o} END,
      CASE WHEN NOT gone AND r = 's' AND n IS NOT NULL THEN {'c': n.c + e.c, 'a': n.a || 'K', 'o': n.o || chr(10) || line} END], lambda p: p IS NOT NULL)),
    list_min(list_filter([
      CASE WHEN u IS NOT NULL THEN {'c': u.c + 3, 'a': u.a || 'D', 'o': u.o} END,
      CASE WHEN NOT gone AND r = 'u' AND n IS NOT NULL THEN {'c': n.c + e.c, 'a': n.a || 'K', 'o': n.o || chr(10) || line} END,
      CASE WHEN NOT gone AND r = 'u' AND s IS NOT NULL THEN {'c': s.c + e.c, 'a': s.a || 'K', 'o': s.o || chr(10) || line} END,
      CASE WHEN NOT gone AND r = 'u' AND go.a IS NOT NULL THEN {'c': go.a.c + e.c, 'a': go.a.a || 'K', 'o': go.a.o || chr(10) || line} END,
      CASE WHEN NOT gone AND r = 'u' AND u IS NOT NULL THEN {'c': u.c + 2 + e.c, 'a': u.a || 'IK', 'o': u.o || chr(10) || 'assistant:' || chr(10) || line} END,
      CASE WHEN NOT gone AND n IS NOT NULL THEN {'c': n.c + 2 + e.c, 'a': n.a || 'R', 'o': n.o || chr(10) || 'user' || body} END,
      CASE WHEN NOT gone AND s IS NOT NULL THEN {'c': s.c + 2 + e.c, 'a': s.a || 'R', 'o': s.o || chr(10) || 'user' || body} END,
      CASE WHEN NOT gone AND go.a IS NOT NULL THEN {'c': go.a.c + 2 + e.c, 'a': go.a.a || 'R', 'o': go.a.o || chr(10) || 'user' || body} END,
      CASE WHEN NOT gone AND u IS NOT NULL THEN {'c': u.c + 4 + e.c, 'a': u.a || 'IR', 'o': u.o || chr(10) || 'assistant:' || chr(10) || 'user' || body} END
      ], lambda p: p IS NOT NULL)),
    list_min(list_filter([
      CASE WHEN go.a IS NOT NULL THEN {'c': go.a.c + 3, 'a': go.a.a || 'D', 'o': go.a.o} END,
      CASE WHEN NOT gone AND r = 'a' AND u IS NOT NULL THEN {'c': u.c + e.c, 'a': u.a || 'K', 'o': u.o || chr(10) || line} END,
      CASE WHEN NOT gone AND r = 'a' AND n IS NOT NULL THEN {'c': n.c + 2 + e.c, 'a': n.a || 'IK', 'o': n.o || chr(10) || 'user:' || chr(10) || line} END,
      CASE WHEN NOT gone AND r = 'a' AND s IS NOT NULL THEN {'c': s.c + 2 + e.c, 'a': s.a || 'IK', 'o': s.o || chr(10) || 'user:' || chr(10) || line} END,
      CASE WHEN NOT gone AND r = 'a' AND go.a IS NOT NULL THEN {'c': go.a.c + 2 + e.c, 'a': go.a.a || 'IK', 'o': go.a.o || chr(10) || 'user:' || chr(10) || line} END,
      CASE WHEN NOT gone AND u IS NOT NULL THEN {'c': u.c + 2 + e.c, 'a': u.a || 'R', 'o': u.o || chr(10) || 'assistant' || body} END,
      CASE WHEN NOT gone AND n IS NOT NULL THEN {'c': n.c + 4 + e.c, 'a': n.a || 'IR', 'o': n.o || chr(10) || 'user:' || chr(10) || 'assistant' || body} END,
      CASE WHEN NOT gone AND s IS NOT NULL THEN {'c': s.c + 4 + e.c, 'a': s.a || 'IR', 'o': s.o || chr(10) || 'user:' || chr(10) || 'assistant' || body} END,
      CASE WHEN NOT gone AND go.a IS NOT NULL THEN {'c': go.a.c + 4 + e.c, 'a': go.a.a || 'IR', 'o': go.a.o || chr(10) || 'user:' || chr(10) || 'assistant' || body} END
      ], lambda p: p IS NOT NULL))
  FROM go JOIN e ON go.conv_id IS NOT DISTINCT FROM e.conv_id AND e.i = go.i + 1),
fin AS (SELECT conv_id, list_min(list_filter([n, go.a,
      CASE WHEN u IS NOT NULL THEN {'c': u.c + 2, 'a': u.a || 'I', 'o': u.o || chr(10) || 'assistant:'} END,
      CASE WHEN s IS NOT NULL THEN {'c': s.c + 4, 'a': s.a || 'II', 'o': s.o || chr(10) || 'user:' || chr(10) || 'assistant:'} END],
      lambda p: p IS NOT NULL)) AS p
   FROM go WHERE i = (SELECT max(i) FROM f WHERE f.conv_id IS NOT DISTINCT FROM go.conv_id))
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(p.c, 0) AS cost, coalesce(p.a, '') AS audit, sha256(coalesce(substr(p.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op13_repair_conversations", OP13_SQL)
def op13(spark, sf_dir):
    rows = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.report(conversations.repair(rows, present=F.col("present"), turns=False))
