"""Vector and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ivf
from ..operators import vectors as V
from ..storage import Scratch
from .base import query

R6 = lambda x: f"(floor(({x}) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE)"
SIM = R6("list_cosine_similarity(embedding::DOUBLE[], q)")


def _q(load):
    """Every vector whose id is divisible by 100 is a query."""
    return load("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


_EACH = lambda k, where="": f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, vec_id, label, {SIM} AS similarity FROM embeddings, q {where}
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, vec_id) <= {k}"""  # noqa: E731


@query("cosine_sim",
    f"SELECT e.vec_id, query_id, {SIM.replace('embedding', 'e.embedding')} AS similarity FROM embeddings e JOIN (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings) ON query_id = e.vec_id - e.vec_id % 100")
def cosine_sim(load):
    """Each vector with the last query vector at or before it."""
    q = load("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    rows = load("embeddings").join(q, F.col("query_id") == F.col("vec_id") - F.col("vec_id") % 100)
    return rows.select("vec_id", "query_id", T.rnd(V.cosine(F.col("embedding"), F.col("q")), 6).alias("similarity"))


@query("vector_topk", _EACH(10))
def vector_topk(load):
    return V.topk(load("embeddings"), _q(load)).select("query_id", "vec_id", "label", "similarity")


@query("vector_topk_filtered", _EACH(5, "WHERE label = 3"))
def vector_topk_filtered(load):
    return V.topk(load("embeddings"), _q(load), 5, F.col("label") == 3).select("query_id", "vec_id", "label", "similarity")


@query("vector_index_topk", _EACH(10).replace("vec_id, label, ", "vec_id, "))
def vector_index_topk(load):
    """An index of all vectors, and an exact search in it."""
    rows = load("embeddings")
    return ivf.build(rows, Scratch(rows.sparkSession, "vector-index").path).search(_q(load), 10, exact=True)


query("l2_normalize",
    f"SELECT vec_id, {R6('sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))')} AS norm, {R6('embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)))')} AS first FROM embeddings")(
    lambda load: V.l2_normalize(load("embeddings")).select("vec_id", T.rnd(F.col("norm"), 6).alias("norm"), T.rnd(F.col("embedding")[0], 6)
        .alias("first")))
query("upsert_latest",
    "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")(
    lambda load: V.upsert_latest(load("events").select("user_id", "event_id", "event_type"), "user_id", "event_id"))
query("collection_stats",
    "SELECT label, count(*) AS n, max(len(embedding))::BIGINT AS dim FROM embeddings GROUP BY label")(lambda load: load("embeddings")
    .groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).cast("long").alias("dim")))
_CTX = """WITH t AS (SELECT conv_id, turn, text, (length(text) // 4)::BIGINT AS tokens FROM conversations), u AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM t), v AS (SELECT *, 200 - (upto - tokens) AS rest FROM u),
p AS (SELECT conv_id, turn, tokens, upto > 200 AS truncated, CASE WHEN upto > 200 THEN substr(text, 1, (rest - 20) * 4) || '...' ELSE text END AS piece FROM v WHERE upto <= 200 OR (rest > 50 AND upto - tokens <= 200)) """
query("context_budget", _CTX + "SELECT * FROM p")(lambda load: V.context_budget(load("conversations"), 200))
query("assemble_context", _CTX +
    "SELECT conv_id, string_agg(piece, chr(10) || chr(10) ORDER BY turn) AS context, sum(tokens)::BIGINT AS tokens FROM p GROUP BY conv_id")(
    lambda load: V.assemble_context(V.context_budget(load("conversations"), 200)))
query("retrieval_metrics",
    "SELECT conv_id, count(*) AS hits, count(DISTINCT role) AS sources, max(turn) AS last_turn FROM conversations GROUP BY conv_id")(
    lambda load: load("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("role").alias("sources"),
        F.max("turn").alias("last_turn")))
query("prompt_format",
    "SELECT conv_id, turn, '[' || upper(role) || '] ' || coalesce(text, '') || chr(10) || 'Answer:' AS prompt FROM conversations")(
    lambda load: load("conversations").select("conv_id", "turn", F.concat(F.lit("["), F.upper("role"), F.lit("] "), F.coalesce("text",
                F.lit("")), F.lit("\nAnswer:")).alias("prompt")))
