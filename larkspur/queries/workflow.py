"""Prompt, workflow and image-metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.files import lookup
from ..operators.images import quality_band
from ..operators.workflow import dag_run, step_levels, step_parameters
from .base import query

ALIASES = {"path": "file_path", "filename": "file_path", "file": "file_path", "text": "content", "data": "content", "type": "file_type",
    "format": "file_type", "output_format": "target_format", "conversion_format": "target_format", "language": "target_language", "lang":
    "target_language"}
_KEYS = [*ALIASES, "content", "other"]
_PICK = "[" + ", ".join(f"'{k}'" for k in _KEYS) + f"][(doc_id % {len(_KEYS)} + 1)::BIGINT]"
query("param_normalize", f"SELECT doc_id, k AS given, CASE k " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ALIASES.items()) +
    f" ELSE k END AS name, substr(text, 1, 100000) AS value FROM (SELECT doc_id, text, {_PICK} AS k FROM documents)")(lambda load: load(
        "documents").select("doc_id", "text", F.get(F.array(*[F.lit(k) for k in _KEYS]), (F.col("doc_id") % len(_KEYS)).cast("int")).alias(
            "given")).select("doc_id", "given", F.coalesce(lookup(F.col("given"), ALIASES, None), "given").alias("name"), F.substring(
            "text", 1, 100000).alias("value")))


query("dag_levels", "SELECT o_orderkey AS step, CASE WHEN o_orderkey = 0 THEN 0 ELSE length(bin(o_orderkey)) END AS level FROM orders")(
    lambda load: step_levels(load("orders").select(F.col("o_orderkey").alias("step"), F.floor(F.col("o_orderkey") / 2).cast("long").alias("dep"))))


_M = "SELECT l_orderkey, l_linenumber, l_quantity / 20.0::DOUBLE AS bpp, l_extendedprice / 5000.0::DOUBLE AS mp, l_discount * 100 AS sharp, l_tax * 100 AS noise FROM lineitem"
query("image_quality_band",
    f"WITH s AS (SELECT *, (CASE WHEN bpp > 2 THEN 2 WHEN bpp > 1 THEN 1 ELSE 0 END + CASE WHEN mp > 8 THEN 2 WHEN mp > 2 THEN 1 ELSE 0 END + CASE WHEN sharp > 10 THEN 2 WHEN sharp > 5 THEN 1 ELSE 0 END + CASE WHEN noise < 5 THEN 2 WHEN noise < 10 THEN 1 ELSE 0 END) AS score FROM ({_M})) SELECT l_orderkey, l_linenumber, score::BIGINT AS score, CASE WHEN score >= 6 THEN 'excellent' WHEN score >= 4 THEN 'good' WHEN score >= 2 THEN 'fair' ELSE 'poor' END AS band FROM s")(
    lambda load: quality_band(load("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 20.0).alias("bpp"), (F.col(
                "l_extendedprice") / 5000.0).alias("mp"), (F.col("l_discount") * 100).alias("sharp"), (F.col("l_tax") * 100).alias(
                "noise"))).select("l_orderkey", "l_linenumber", "score", "band"))


#: An order depends on the orders whose keys are its own divided by its line numbers + 1; a handful of keys make circles, and urgent open ones fail.
_EDGES = """SELECT l_orderkey AS step, CASE WHEN l_orderkey = 61 THEN 61 * (l_linenumber + 1) WHEN l_orderkey % 1013 = 7 THEN -l_orderkey
         ELSE l_orderkey // (l_linenumber + 1) END AS dep FROM lineitem WHERE l_orderkey > 0 AND l_orderkey // (l_linenumber + 1) > 0
  UNION SELECT o_orderkey, NULL FROM orders"""
_DAG = f"""WITH RECURSIVE e AS (SELECT DISTINCT step, dep FROM ({_EDGES}) WHERE dep IS NOT NULL),
names AS (SELECT DISTINCT step FROM ({_EDGES})),
reach AS (SELECT step, dep FROM e UNION SELECT r.step, e.dep FROM reach r JOIN e ON e.step = r.dep),
circle AS (SELECT step FROM reach WHERE step = dep),
lost AS (SELECT DISTINCT step FROM reach WHERE dep NOT IN (SELECT step FROM names) OR dep IN (SELECT step FROM circle)),
between AS (SELECT a.step FROM (SELECT DISTINCT step FROM reach WHERE dep IN (SELECT step FROM circle)) a
            WHERE a.step IN (SELECT r.dep FROM reach r WHERE r.step IN (SELECT step FROM circle))),
good AS (SELECT step FROM names WHERE step NOT IN (SELECT step FROM lost)),
walk AS (SELECT step, 0 AS level FROM good WHERE step NOT IN (SELECT step FROM e)
         UNION SELECT e.step, w.level + 1 FROM walk w JOIN e ON e.dep = w.step WHERE e.step IN (SELECT step FROM good)),
fails AS (SELECT o_orderkey AS step FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AND o_orderkey > 300),
hit AS (SELECT DISTINCT r.step FROM reach r JOIN fails f ON r.dep = f.step)
SELECT g.step, max(w.level)::BIGINT AS level, CASE WHEN g.step IN (SELECT step FROM hit) THEN 'stopped' WHEN g.step IN (SELECT step FROM fails) THEN 'failed' ELSE 'completed' END AS status
FROM good g JOIN walk w ON w.step = g.step GROUP BY g.step
UNION ALL
SELECT step, NULL, CASE WHEN step IN (SELECT step FROM between) OR step IN (SELECT step FROM circle) THEN 'circular' ELSE 'blocked' END FROM lost"""


def order_steps(load):
    """Rows (step, dep): the graph that ``_EDGES`` describes."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    up = F.floor(key / (line + 1)).cast("long")
    dep = F.when(key == 61, F.lit(61) * (line + 1)).when(key % 1013 == 7, -key).otherwise(up)
    edges = load("lineitem").where((key > 0) & (up > 0)).select(key.alias("step"), dep.alias("dep"))
    return edges.unionByName(load("orders").select(F.col("o_orderkey").alias("step"), F.lit(None).cast("long").alias("dep")))


def failing_orders(load):
    return load("orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P' and o_orderkey > 300").select(F.col("o_orderkey").alias("step"))


query("dag_run", _DAG)(lambda load: dag_run(order_steps(load), failing_orders(load)))
query("step_parameters",
    f"""WITH e AS (SELECT DISTINCT step, dep FROM ({_EDGES})), o AS (SELECT o_orderkey AS step, o_orderpriority AS output FROM orders WHERE o_orderstatus <> 'P'),
k AS (SELECT e.step, e.dep::VARCHAR || '_output' AS name, o.output AS value FROM e JOIN o ON o.step = e.dep)
SELECT s.step, coalesce((SELECT string_agg(name || '=' || value, ',' ORDER BY name) FROM k WHERE k.step = s.step), '') AS outputs, 'mail' AS channel,
       coalesce(o_orderstatus, 'none') AS state FROM (SELECT DISTINCT step FROM e) s LEFT JOIN orders ON o_orderkey = s.step""")(
    lambda load: step_parameters(order_steps(load), load("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("step"), F.col(
        "o_orderpriority").alias("output")), load("orders").select(F.col("o_orderkey").alias("step"), F.create_map(F.lit("state"), "o_orderstatus")
        .alias("params")), {"channel": "mail", "state": "none"}).select("step", F.array_join(F.array_sort(F.transform(F.map_entries(F.map_filter(
        "params", lambda k, v: F.endswith(k, F.lit("_output")))), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",").alias("outputs"),
        F.col("params")["channel"].alias("channel"), F.col("params")["state"].alias("state")))
