"""Registered queries of this package, each over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitslices, bpe, centroids, chat, decontaminate, embeddings, lexical, lm, minhash, repeats, secret_scan, sharding, toxicity
from .common import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_OP1 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS shingle FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN c ON a = doc_id
"""


@query("op1_minhash", _OP1)
def op1_minhash(spark, folder):
    return minhash.link(table(spark, folder, "documents").select("doc_id", "text"))


@query("op2_toxicity")
def op2_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, folder, "labels"), ~held_out(F.col("doc_id"), 3, 1))
    scored = toxicity.score(docs, model, carry=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted")


@query("op3_bpe")
def op3_bpe(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, tokenizer_file(), carry=["doc_id"]))


_OP4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


@query("op4_embeddings", _OP4)
def op4_embeddings(spark, folder):
    return embeddings.link(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))


@query("op5_secrets")
def op5_secrets(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return secret_scan.report(secret_scan.scan(docs, secret_scan.train(docs), carry=["doc_id"]))


_OP6 = """
WITH RECURSIVE c AS (
  SELECT conv_id, conv_id || ':' || turn AS call_id, conv_id || ':' || (turn - 2) AS parent_id, turn, text,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) AS k, count(*) OVER (PARTITION BY conv_id, turn) AS n_calls
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL),
r AS (
  SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, min(text) AS content, count(*) AS n_results
  FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
f AS (SELECT * FROM c WHERE k = 1),
d AS (
  SELECT conv_id, call_id, 0::BIGINT AS depth FROM f WHERE parent_id NOT IN (SELECT call_id FROM f)
  UNION ALL SELECT f.conv_id, f.call_id, d.depth + 1 FROM d JOIN f ON f.parent_id = d.call_id)
SELECT f.conv_id, f.call_id, turn, depth, 'reply' AS name, coalesce(n_results, 0) AS n_results,
  CASE WHEN n_calls > 1 THEN 'identifier repeats' ELSE '' END AS faults,
  '{"arguments":{"n_chars":' || length(text) || ',"text":' || to_json(text) || '},"depth":' || depth || ',"id":"' || f.call_id
  || '","name":"reply","result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"turn":' || turn || '}' AS line
FROM f JOIN d USING (conv_id, call_id) LEFT JOIN r USING (conv_id, call_id)
"""


@query("op6_chat", _OP6)
def op6_chat(spark, folder):
    return chat.link(*chat.from_turns(table(spark, folder, "conversations")), chat.REPLY)


_OP6_UNLINKED = r"""
WITH c AS (
  SELECT conv_id, conv_id || ':' || turn AS call_id, turn, text, count(*) AS n,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1 AS first
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn, text),
r AS (
  SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, turn, text, count(*) AS n,
    row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1 AS first
  FROM conversations WHERE role = 'user' GROUP BY conv_id, turn, text),
a AS (
  SELECT c.*, '{"text":' || to_json(text) || ',"n_chars":' || length(text) || '}' AS arguments, call_id IN (SELECT call_id FROM r WHERE call_id IS NOT NULL) AS answered FROM c),
b AS (SELECT r.*, call_id IN (SELECT call_id FROM c WHERE call_id IS NOT NULL) AS called FROM r)
SELECT conv_id, call_id, turn, 'call' AS kind, 'call without result' AS fault, arguments AS content, 1::BIGINT AS n FROM a WHERE first AND NOT answered
UNION ALL SELECT conv_id, call_id, turn, 'call', 'identifier repeats', arguments, n - first::BIGINT FROM a WHERE call_id IS NOT NULL AND n > first::BIGINT
UNION ALL SELECT conv_id, call_id, turn, 'result', 'result without call', text, n FROM b WHERE NOT called
UNION ALL SELECT conv_id, call_id, turn, 'result', 'identifier repeats', text, n - first::BIGINT FROM b WHERE called AND n > first::BIGINT
UNION ALL SELECT conv_id, NULL, turn, 'call', 'no identifier', arguments, n FROM a WHERE call_id IS NULL
UNION ALL SELECT conv_id, NULL, turn, 'result', 'no identifier', text, n FROM b WHERE call_id IS NULL
UNION ALL SELECT conv_id, NULL, turn, 'turn', coalesce(role, 'unknown') || ' turn', text, count(*) FROM conversations
  WHERE role IS NULL OR role NOT IN ('assistant', 'user') GROUP BY conv_id, turn, role, text
"""


@query("op6_chat_unlinked", _OP6_UNLINKED)
def op6_chat_unlinked(spark, folder):
    turns = table(spark, folder, "conversations")
    others = turns.filter("role IS NULL OR role NOT IN ('assistant', 'user')")
    return chat.unlinked(*chat.from_turns(turns), others)


@query("op7_decontamination")
def op7_decontamination(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.passages(docs, table(spark, folder, "benchmark"))


@query("op8_sharding")
def op8_sharding(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return sharding.report(sharding.shard(docs))


@query("op9_lm")
def op9_lm(spark, folder):
    return lm.score(table(spark, folder, "documents").select("doc_id", "text"), held_out(F.col("doc_id"), 7, 2), across=True)


@query("op10_repeats")
def op10_repeats(spark, folder):
    return repeats.report(repeats.remove(table(spark, folder, "documents").select("doc_id", "text")))


_VALID = "embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0"
_OP11 = f"""
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings WHERE {_VALID}),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score, q.r
  FROM v q JOIN v ON q.r <> v.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""


@query("op11_bitslices", _OP11)
def op11_bitslices(spark, folder):
    return bitslices.search(table(spark, folder, "embeddings").select("vec_id", "embedding"))


_TERMS = r"list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
_OP12 = f"""
WITH t AS (
  SELECT d, doc_id, unnest({_TERMS.removeprefix('list_distinct')}) AS term FROM (SELECT row_number() OVER () AS d, * FROM documents)),
n AS (SELECT d, doc_id, count(*) AS n FROM t GROUP BY ALL),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM n),
p AS (SELECT d, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY term),
i AS (SELECT r, item_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS r, * FROM benchmark)),
s AS (
  SELECT r, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN p USING (term) JOIN n USING (d), g GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10
"""


@query("op12_lexical", _OP12)
def op12_lexical(spark, folder):
    return lexical.search(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))


def _op13() -> str:
    """Ten rounds over (vector, component) rows; every round is two tables."""
    parts = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = 64 AND {_VALID}),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), x) - 1)::INTEGER AS cluster, x FROM v
  QUALIFY row_number() OVER (ORDER BY sha256('3:' || vec_id), x) <= 8)"""]
    for k in range(11):
        parts.append(f"""
a{k} AS MATERIALIZED (
  SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
    SELECT r, cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{k} c)
  GROUP BY r)""")
        if k < 10:
            parts.append(f"""
c{k + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (
    SELECT cluster, list(m ORDER BY i) AS x FROM (
      SELECT cluster, i, ((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
      FROM a{k} JOIN v USING (r), (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i)
    GROUP BY cluster) m USING (cluster))""")
    return ",".join(parts) + """
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a10 JOIN v USING (r) JOIN c10 c USING (cluster)
"""


@query("op13_centroids", _op13())
def op13_centroids(spark, folder):
    return centroids.cluster(table(spark, folder, "embeddings").select("vec_id", "embedding"))
