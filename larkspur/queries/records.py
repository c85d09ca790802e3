"""Queries on records of batches, checks, layouts, recognised words, and on parts of texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import files as K
from ..functions import text as T
from ..functions.times import epoch
from ..operators import batches as B
from ..operators import records as O
from ..operators import web
from ..session import spread
from ..sources.html import parse_pages
from .base import ORACLE_SQL, query
from .files import case, files
from .text import BASE, STRIP, WS, R
from .web import _ATTR, _JSON, _PLAIN, _TEXT, _TRIM, _URLS, PARSED, urls

_CAN = ", ".join(f"'.{e}'" for e in K.CONVERSIONS)
files("convertible_scan",
    f"SELECT dir, count(*) FILTER (WHERE lower(extension) IN ({_CAN})) AS convertible, count(*) FILTER (WHERE lower(extension) NOT IN ({_CAN})) AS other, count(*) AS total FROM c GROUP BY dir")(
    O.convertible_scan)
files("find_files",
    r"SELECT '*1.*' AS pattern, path FROM c WHERE regexp_matches(name, '^.*1\..*$') UNION ALL SELECT '1?.t*' AS pattern, path FROM c "
    r"WHERE regexp_matches(name, '^1.\.t.*$') UNION ALL SELECT '*.py' AS pattern, path FROM c WHERE ends_with(name, '.py')")(
    lambda c: O.find_files(c, ["*1.*", "1?.t*", "*.py"]))
_TOOLS = ", ".join(f"('{a}', '{b}', '{t}')" for a, b, t in K.TOOLS)
files("conversion_tool", f", t(e, target, tool) AS (VALUES {_TOOLS}) SELECT path, target, tool FROM c LEFT JOIN t ON lower(extension) = e")(O.conversion_tool)
_SCHEMES = {"scanned": (K.SCANNED, "other"), "recorded": (K.RECORDED, "unknown"), "detected": (K.DETECTED, "other")}
files("category_schemes", "SELECT path, " + ", ".join(f"{case('lower(extension)', K.by_extension(s), repr(d))} AS {n}" for n, (s,
            d) in _SCHEMES.items()) + " FROM c")(B.category_schemes)
files("code_language", f"SELECT path, {case('lower(extension)', K.LANGUAGES, repr('text'))} AS language FROM c")(B.code_language)
files("dir_children", "SELECT dir, count(*) AS item_count, sum(size)::BIGINT AS total_size, count(*) = 0 AS is_empty FROM c GROUP BY dir")(O.dir_children)
files("output_tree",
    "SELECT DISTINCT '' AS parent, dir AS name, false AS is_file FROM c UNION ALL SELECT dir AS parent, name, true AS is_file FROM c")(
    O.output_tree)
files("file_record",
    rf"SELECT path, doc_id::VARCHAR AS stem, lower(extension) AS suffix, {R('size / 1048576.0::DOUBLE', 2)} AS size_mb, strftime(mtime, '%Y-%m-%dT%H:%M:%S') AS modified FROM c")(
    O.file_record)
_MESSAGES = [*K.SKIPPED, "Disk full", "PERMISSION DENIED: locked"]
_SAYS = "[" + ", ".join(f"'{m}'" for m in _MESSAGES) + f"][(doc_id % {len(_MESSAGES)} + 1)::BIGINT]"
files("error_skip",
    f"SELECT path, lower({_SAYS} || ' ' || path) SIMILAR TO '.*(permission denied|file not found|unsupported format|corrupted file).*' AS skip FROM c")(
    lambda c: O.error_skip(c.select("path", F.concat_ws(" ", F.get(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col(
                "doc_id") % len(_MESSAGES)).cast("int")), "path").alias("message"))))
_STATUS = "CASE WHEN extension IN ('.zip', '.mp3', '.xyz') THEN 'skipped' WHEN size > 5000 THEN 'failed' ELSE 'success' END"
_OK = "FILTER (WHERE status = 'success')"
files("conversion_batch",
    f", r AS (SELECT dir, size, size - doc_id % 100 AS new_size, {_STATUS} AS status FROM c), g AS (SELECT dir, count(*) {_OK} AS successful, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, coalesce(sum(size) {_OK}, 0)::BIGINT AS size_before, coalesce(sum(new_size) {_OK}, 0)::BIGINT AS size_after FROM r GROUP BY dir) "
    f"SELECT *, CASE WHEN successful + failed > 0 THEN {R('successful::DOUBLE / (successful + failed)', 4)} ELSE 0.0::DOUBLE END AS success_rate, CASE WHEN size_before > 0 THEN {R('100.0::DOUBLE * (size_after - size_before) / size_before', 2)} ELSE 0.0::DOUBLE END AS change_percent FROM g")(
    lambda c: O.conversion_batch(c.select("dir", "size", (F.col("size") - F.col("doc_id") % 100).alias("new_size"), F.expr(_STATUS).alias(
                "status"))))
_WHY = "CASE WHEN size IS NULL THEN 'missing' WHEN extension NOT IN ('.txt', '.csv', '.pdf') THEN 'invalid: extension not allowed' ELSE 'valid' END"
files("file_list_check",
    f"SELECT {_WHY} AS outcome, count(*) AS n, min(path) AS first_path FROM c GROUP BY 1")(lambda c: B.file_list_check(c, [".txt", ".csv",
            ".pdf"]))
_TYPE = "CASE WHEN doc_id % 11 = 0 THEN 'application/x-executable' ELSE 'text/plain' END"
files("security_report",
    f"SELECT path, (doc_id >> 7) & 1 = 1 AS writable, {_TYPE} LIKE '%executable%' AND extension NOT IN ('.exe', '.bin') AS suspicious FROM c")(
    lambda c: B.security_report(c.select("path", "extension", F.col("doc_id").alias("mode"), F.expr(_TYPE).alias("mime")), [".exe",
            ".bin"]))


def docs(name: str, sql: str):
    return lambda fn: query(name, sql)(lambda load: fn(spread(load("documents"))))


docs("sentence_list", BASE + "SELECT doc_id, unnest(generate_series(1, len(s))) - 1 AS pos, unnest(s) AS sentence FROM b")(
    lambda d: d.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")))
docs("paragraph_list", BASE +
    rf", p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, '. ', E'.\n\n'), '\n{WS}*\n'), lambda x: {STRIP('x')}), lambda x: x <> '') AS ps FROM d) SELECT doc_id, unnest(generate_series(1, len(ps))) - 1 AS pos, unnest(ps) AS paragraph FROM p")(
    lambda d: d.select("doc_id", F.posexplode(F.transform(T.paragraphs(F.replace(T.given(F.col("text")), F.lit(". "), F.lit(".\n\n"))),
                T.strip)).alias("pos", "paragraph")))
docs("min_sentences", BASE + "SELECT doc_id, array_to_string(list_slice(s, 1, 3), ' ') AS summary FROM b")(
    lambda d: d.select("doc_id", T.at_least(F.lit(""), F.col("text"), 3).alias("summary")))
docs("enhance_stub", r"SELECT doc_id, '# Enhanced' || chr(10) || regexp_replace(coalesce(text, ''), '(?m)^(def |function )', '\"\"\"Documented.\"\"\"' || chr(10) || '\1', 'g') AS content FROM documents".replace('\\"', '"'))(
    lambda d: d.select("doc_id", F.concat(F.lit("# Enhanced\n"), F.regexp_replace(T.given(F.col("text")), r"(?m)^(def |function )", '"""Documented."""\n$1')).alias("content")))

query("page_meta", PARSED +
    "SELECT page_id, len(meta)::INT AS n_meta, '{' || coalesce((SELECT string_agg(to_json(m[1]) || ':' || to_json(m[2]), ',') FROM "
    "(SELECT unnest(meta) AS m)), '') || '}' AS meta FROM p")(lambda load: parse_pages(load("pages")).select("page_id", F.size("meta")
        .alias("n_meta"), F.to_json("meta").alias("meta")))
query("page_headings", PARSED +
    f"SELECT page_id, pos - 1 AS pos, lower(regexp_extract(h, '(?i)^<(h[1-6])', 1)) AS level, {_TRIM(_PLAIN('h'))} AS text FROM (SELECT page_id, unnest(list_filter(heads_, lambda h: {_TRIM(_PLAIN('h'))} <> '')) AS h, generate_subscripts(list_filter(heads_, lambda h: {_TRIM(_PLAIN('h'))} <> ''), 1) AS pos FROM p)")(
    lambda load: parse_pages(load("pages")).select("page_id", F.posexplode("heading_texts").alias("pos", "h")).select("page_id", "pos",
        "h.*"))
_SRC = f"CASE WHEN starts_with({_ATTR('x', 'src')}, '/') THEN home ELSE '' END || {_TEXT(_ATTR('x', 'src'))}"
query("page_images", PARSED + f"""SELECT page_id, len(list_filter(images_, lambda x: {_ATTR('x', 'src')} <> ''))::INT AS n_images, '[' || array_to_string(list_transform(list_filter(images_, lambda x: {_ATTR('x', 'src')} <> ''),
  lambda x: {_JSON(("src", _SRC), *[(k, _TEXT(_ATTR('x', k))) for k in ("alt", "title", "width", "height")])}), ',') || ']' AS images FROM p""")(lambda load: parse_pages(load("pages")).select("page_id", F.size("image_list").alias("n_images"), F.to_json("image_list").alias("images")))
_GOOD = r"regexp_matches(url, '(?i)^https?://\S+$') AND NOT regexp_matches(url, '[<>]') AND regexp_matches(regexp_extract(url, '(?i)^https?://([^/?#]*)', 1), '^[^:]*\.\p{L}{2,}(:.*)?$')"
query("url_batch", _URLS +
    f"SELECT count(*) AS total, count(*) FILTER (WHERE {_GOOD}) AS n_valid, printf('%.1f%%', {R(f'100.0::DOUBLE * count(*) FILTER (WHERE {_GOOD}) / count(*)', 1)}) AS rate FROM u")(
    lambda load: web.url_batch(urls(load("pages"))))
query("url_domain", _URLS +
    r", h AS (SELECT url, string_split(regexp_extract(url, '(?i)^[a-z]+:(?:https?:)?//([^/?#]*)', 1), ':')[1] AS domain FROM u) SELECT "
    r"url, domain, CASE WHEN domain = '' THEN 0 ELSE len(string_split(domain, '.')) END::BIGINT AS labels FROM h")(lambda load: urls(load(
            "pages")).select("url", F.split(F.regexp_extract("url", r"(?i)^[a-z]+:(?:https?:)?//([^/?#]*)", 1), ":")[0].alias("domain"))
    .withColumn("labels", F.when(F.col("domain") == "", 0).otherwise(F.size(F.split("domain", r"\."))).cast("long")))


def events(name: str, sql: str):
    return lambda fn: query(name, sql)(lambda load: fn(load("events").withColumn("series", F.col("event_type"))))


events("health_summary",
    "SELECT event_type AS series, count(*) AS total, count(*) FILTER (WHERE value < 40) AS n_passed, count(*) - count(*) FILTER (WHERE "
    "value < 40) AS n_failed, count(*) = count(*) FILTER (WHERE value < 40) AS all_passed FROM events GROUP BY 1")(
    lambda e: O.health_summary(e.withColumn("passed", F.col("value") < 40)))
events("latest_execution",
    "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(epoch(ts)::BIGINT) AS last_s FROM (SELECT user_id, event_type, "
    "event_id, date_trunc('second', ts) AS ts FROM events) GROUP BY 1")(lambda e: B.latest_execution(e.withColumn("t", epoch(F.date_trunc(
                "second", "ts"))), "user_id", "event_type", "t", "event_id"))
events("eta",
    f"SELECT event_id, CASE WHEN event_id % 101 > 0 THEN {R('value / ((event_id % 101) / 100.0::DOUBLE)', 3)} END AS eta_s FROM events")(
    lambda e: O.eta(e.select("event_id", F.col("value").alias("elapsed_s"), (F.col("event_id") % 101).alias("percent"))).select("event_id",
        "eta_s"))
events("diagnostics",
    "SELECT event_type AS series, count(i) AS n_issues, CASE WHEN coalesce(bool_or(contains(lower(i), 'critical')), false) THEN "
    "'critical' WHEN count(i) > 0 THEN 'warning' ELSE 'healthy' END AS overall FROM (SELECT event_type, CASE WHEN event_type = 'error' "
    "AND value > 90 THEN 'Disk usage: CRITICAL' WHEN event_type <> 'view' AND value > 95 THEN 'Slow' END AS i FROM events) GROUP BY 1")(
    lambda e: O.diagnostics(e.select("series", F.when((F.col("series") == "error") & (F.col("value") > 90), "Disk usage: CRITICAL")
            .when((F.col("series") != "view") & (F.col("value") > 95), "Slow").alias("issue"))))
events("connectivity",
    "SELECT event_id AS host, CASE WHEN issues = '' THEN 'healthy' ELSE 'degraded' END AS overall, issues FROM (SELECT event_id, "
    "concat_ws('; ', CASE WHEN event_id % 7 = 0 THEN 'DNS resolution failed' END, CASE WHEN event_id % 5 = 0 THEN 'Host is not reachable "
    "via ping' END, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'HTTP/HTTPS services are not accessible' END) AS issues FROM "
    "events)")(lambda e: O.connectivity(e.select(F.col("event_id").alias("host"), *[(F.col("event_id") % n != 0).alias(c) for c, n in ((
                "resolvable", 7), ("reachable", 5), ("http", 2), ("https", 3))])))
events("port_states",
    "SELECT user_id, count(*) FILTER (WHERE value < 10) AS n_open, count(*) FILTER (WHERE value >= 10 AND value < 30) AS n_closed, "
    "count(*) FILTER (WHERE value >= 30) AS n_filtered FROM events GROUP BY 1")(lambda e: B.port_states(e, "user_id"))
events("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, epoch(date_trunc('second', ts))::BIGINT - 1704067200 AS since_s FROM events")(
    lambda e: B.iso_times(e, "ts", "event_id"))
events("unique_users",
    "SELECT event_type AS series, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")(lambda e: B.distinct_values(e, "series",
        "user_id", "n_users"))
_RAW = "CASE WHEN event_id % 10 = 0 THEN substr(props, 2) ELSE props END"
events("json_check", f"SELECT event_id, json_valid({_RAW}) AS valid, strlen({_RAW}) AS n_bytes FROM events")(
    lambda e: e.select("event_id", T.is_json(F.expr(_RAW)).alias("valid"), F.expr(f"octet_length({_RAW})").cast("long").alias("n_bytes")))
events("map_merge",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 7 ELSE (props->>'$.k')::BIGINT END AS k, 1::BIGINT AS z FROM events")(lambda e: e
    .select("event_id", T.merge(T.merge(F.expr("map('k', 0L, 'z', 1L)"), F.from_json("props", "map<string,bigint>")), F.when(F.col(
                "event_id") % 3 == 0, F.expr("map('k', 7L)"))).alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["z"]
        .alias("z")))
_NAMES = "[" + ", ".join(f"'{n}'" for n in ("path", "content", "mode")) + "]"
events("parameter_sets",
    f"SELECT event_id AS call, array_to_string(list_sort(list_filter(['path', 'content', 'mode'], lambda x: NOT list_contains(g, x))), ',') AS missing, array_to_string(list_sort(list_filter(g, lambda x: NOT list_contains({_NAMES}, x))), ',') AS extra FROM (SELECT event_id, [event_type, ['path', 'content', 'mode'][(event_id % 3 + 1)::BIGINT]] AS g FROM events)")(
    lambda e: O.parameter_sets(e.select(F.col("event_id").alias("call"), F.array("series", F.get(F.array(F.lit("path"), F.lit("content"),
                F.lit("mode")), (F.col("event_id") % 3).cast("int"))).alias("given")), ["path", "content", "mode"]))

query("process_filter", "SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%CUSTOMER%1%' ORDER BY c_custkey LIMIT 50")(
    lambda load: B.process_filter(load("customer").select("c_custkey", "c_name"), "CUSTOMER%1", 50, "c_name", "c_custkey"))
query("partitions_by_usage",
    "SELECT s_name AS device, s_acctbal AS used FROM supplier ORDER BY used DESC, device")(lambda load: B.by_usage(load("supplier")
        .select(F.col("s_name").alias("device"), F.col("s_acctbal").alias("used"))))
query("image_basics",
    f"WITH i AS (SELECT l_orderkey, l_linenumber, l_partkey % 4000 + 1 AS width, l_suppkey % 3000 + 1 AS height FROM lineitem) SELECT *, {R('width * height / 1000000.0::DOUBLE', 2)} AS megapixels, (width // gcd(width, height)) || ':' || (height // gcd(width, height)) AS aspect FROM i")(
    lambda load: O.image_basics(load("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 4000 + 1).alias("width"),
            (F.col("l_suppkey") % 3000 + 1).alias("height"))))
query("ocr_words",
    f"WITH w AS (SELECT l_orderkey AS image, CASE WHEN l_linenumber % 5 = 0 THEN '  ' ELSE l_shipdate::DATE::VARCHAR END AS word, (l_quantity * 2 - 4)::BIGINT AS conf FROM lineitem), g AS (SELECT image, count(*) AS word_count, sum(length(trim(word)))::BIGINT AS character_count, avg(conf) AS c, min(conf) AS min_confidence, max(conf) AS max_confidence FROM w WHERE conf > 0 AND trim(word) <> '' GROUP BY image) "
    f"SELECT image, word_count, character_count, min_confidence, max_confidence, {R('c', 4)} AS average_confidence, CASE WHEN c > 80 THEN 'excellent' WHEN c > 60 THEN 'good' WHEN c > 40 THEN 'fair' ELSE 'poor' END AS quality, {R('word_count / 200.0::DOUBLE', 2)} AS reading_minutes FROM g")(
    lambda load: O.ocr_words(load("lineitem").select(F.col("l_orderkey").alias("image"), F.when(F.col("l_linenumber") % 5 == 0, "  ")
            .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("word"), (F.col("l_quantity") * 2 - 4).cast("long").alias("conf"))))
query("page_regions",
    "SELECT l_orderkey AS page, l_linenumber * 10 AS x0, l_quantity * 16 AS y0, l_quantity * 16 + 20 AS y1, 800.0::DOUBLE AS height, CASE "
    "WHEN l_quantity * 16 + 20 <= 800.0::DOUBLE * 0.15::DOUBLE THEN 'header' WHEN l_quantity * 16 >= 800.0::DOUBLE * 0.85::DOUBLE THEN "
    "'footer' ELSE 'body' END AS region FROM lineitem")(lambda load: O.page_regions(load("lineitem").select(F.col("l_orderkey").alias(
                "page"), (F.col("l_linenumber") * 10).alias("x0"), (F.col("l_quantity") * 16).alias("y0"), (F.col("l_quantity") * 16 + 20)
            .alias("y1"), F.lit(800.0).alias("height"))))
query("image_collection",
    f"WITH i AS (SELECT l_returnflag AS format, CASE WHEN l_linestatus = 'O' THEN 'L' ELSE 'RGB' END AS mode, l_partkey % 4000 + 1 AS width, l_suppkey % 3000 + 1 AS height FROM lineitem) SELECT format, count(*) AS n, count(*) FILTER (WHERE mode = 'L') AS n_grey, min(width) AS min_width, max(width) AS max_width, min(height) AS min_height, max(height) AS max_height, {R('avg(width)', 2)} AS avg_width, {R('avg(height)', 2)} AS avg_height, CASE WHEN count(*) FILTER (WHERE mode = 'L') * 2 > count(*) THEN 'store as greyscale' END AS advice FROM i GROUP BY 1")(
    lambda load: O.image_collection(load("lineitem").select(F.col("l_returnflag").alias("format"), F.when(F.col("l_linestatus") == "O", "L")
            .otherwise("RGB").alias("mode"), (F.col("l_partkey") % 4000 + 1).alias("width"), (F.col("l_suppkey") % 3000 + 1).alias(
                "height"))))
docs("table_clean",
    f"WITH r AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda r: list_transform(string_split(r, ','), lambda c: {STRIP('c')})), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rows FROM documents), w AS (SELECT *, coalesce(list_max(list_transform(rows, lambda r: len(r))), 0) AS width FROM r) "
    "SELECT doc_id, width::BIGINT AS width, array_to_string(list_transform(rows, lambda r: array_to_string(r, '|') || repeat('|', width - "
    "len(r))), chr(10)) AS cleaned FROM w")(lambda d: O.table_clean(d.select("doc_id", F.transform(F.split(T.given(F.col("text")), "\n"),
                lambda r: F.split(r, ",")).alias("cells"))).select("doc_id", F.coalesce(F.array_max(F.transform("cells", F.size)),
            F.lit(0)).cast("long").alias("width"), F.array_join(F.transform("cells", lambda r: F.array_join(r, "|")), "\n").alias(
            "cleaned")))
events("progress_states",
    "SELECT user_id AS key, count(*) AS steps, max(epoch(date_trunc('second', ts)))::BIGINT - min(epoch(date_trunc('second', "
    "ts)))::BIGINT AS span_s, CASE WHEN bool_or(event_type = 'purchase') THEN 'completed' WHEN bool_or(event_type = 'error') THEN "
    "'failed' ELSE 'active' END AS status FROM events GROUP BY 1")(lambda e: O.progress_states(e.select(F.col("user_id").alias("key"),
            F.col("event_type").alias("kind"), epoch(F.date_trunc("second", "ts")).alias("t"))))
docs("summary_compression",
    f"SELECT lang, {R('avg(length(summary)::DOUBLE / greatest(length(text), 1))', 3)} AS mean_ratio FROM ({ORACLE_SQL['summary_first_n']}) JOIN (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents) USING (doc_id) GROUP BY 1")(
    lambda d: d.groupBy("lang").agg(T.rnd(F.avg(F.length(T.first_n(F.col("text"), 200)) / F.greatest(F.length(T.given(F.col("text"))),
                F.lit(1))), 3).alias("mean_ratio")))
