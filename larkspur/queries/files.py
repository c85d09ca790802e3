"""File-catalog queries; the catalog is made of ``documents`` in the same way on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import files as K
from ..functions.times import epoch
from ..operators.layout import output_targets
from ..operators import files as O
from .base import query

_EXT = "[" + ", ".join(f"'{e}'" for e in O.EXTENSIONS) + "]"
CATALOG = f"""WITH k AS (SELECT doc_id, source AS dir, {_EXT}[(doc_id % 8 + 1)::BIGINT] AS extension, n_chars AS size, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS mtime, text AS content FROM documents),
c AS (SELECT doc_id, dir || '/' || doc_id || extension AS path, doc_id || extension AS name, dir, extension, size, mtime, content FROM k) """


def case(key: str, table: dict[str, str], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def files(name: str, sql: str):
    def add(fn):
        return query(name, CATALOG + sql)(lambda load: fn(O.catalog(load("documents"))))

    return add


CAT = case("lower(extension)", K.by_extension(K.CATEGORIES), "'unknown'")
PLURAL = case("lower(extension)", K.by_extension(K.PLURAL), "'other'")
KIND = case("extension", K.MIME, "'application/octet-stream'")

files("scan_filter",
    "SELECT path, size FROM c WHERE extension IN ('.txt', '.pdf', '.csv') AND size BETWEEN 500 AND 5000 AND mtime >= TIMESTAMP "
    "'2024-01-05' AND regexp_matches(name, '^[0-9]+1.*$')")(lambda c: O.scan_filter(c, ["txt", ".pdf", "csv"], 500, 5000, "2024-01-05")
    .where(F.col("name").rlike("^[0-9]+1.*$")).select("path", "size"))
files("scan_stats",
    "SELECT count(*) AS n_files, sum(size)::BIGINT AS total_size, floor(avg(size))::BIGINT AS avg_size, arg_min(path, (mtime, path)) AS "
    "oldest, arg_min(path, (-epoch(mtime)::BIGINT, path)) AS newest, arg_min(path, (-size, path)) AS largest FROM c")(O.scan_stats)
files("scan_sort_limit", "SELECT path, size FROM c ORDER BY size DESC, path LIMIT 20")(lambda c: O.scan_sort_limit(c).select("path", "size"))
files("large_files", "SELECT path, size FROM c WHERE size >= 5000 ORDER BY size DESC, path LIMIT 10")(lambda c: O.scan_sort_limit(c.where(
            "size >= 5000"), limit=10).select("path", "size"))
files("size_buckets",
    "SELECT CASE WHEN size < 1024 THEN 'under_1K' WHEN size < 1048576 THEN 'under_1M' WHEN size < 10485760 THEN 'under_10M' ELSE '10M_up' "
    "END AS bucket, count(*) AS n FROM c GROUP BY 1")(lambda c: c.groupBy(K.size_bucket(F.col("size")).alias("bucket"))
    .agg(F.count(F.lit(1)).alias("n")))
files("type_rollup",
    f"SELECT {CAT} AS category, count(*) AS n, sum(size)::BIGINT AS total_size, arg_min(path, (-size, path)) AS largest, arg_min(path, (size, path)) AS smallest FROM c GROUP BY 1")(
    lambda c: c.groupBy(K.category(F.col("extension")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias(
            "total_size"), F.min_by("path", F.struct((-F.col("size")).alias("a"), "path")).alias("largest"), F.min_by("path", F.struct(
                "size", "path")).alias("smallest")))
files("category_lookup",
    f"SELECT path, {CAT} AS category, CASE WHEN {CAT} = 'unknown' THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM c")(lambda c: c
    .select("path", K.category(F.col("extension")).alias("category"), F.when(K.category(F.col("extension")) == "unknown", 0.5)
        .otherwise(0.7).alias("confidence")))
files("scan_by_category",
    f"SELECT {PLURAL} AS category, count(*) AS n, string_agg(path, ',' ORDER BY path) AS paths FROM c GROUP BY 1")(lambda c: c
    .groupBy(K.category(F.col("extension"), K.PLURAL, "other").alias("category")).agg(F.count(F.lit(1)).alias("n"),
        F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths")))
files("duplicate_groups",
    "SELECT md5(content) AS md5, count(*) AS n, string_agg(path, ',' ORDER BY path) AS paths FROM c GROUP BY 1 HAVING count(*) > 1")(
    O.duplicate_groups)
files("dir_sizes", "SELECT dir, sum(size)::BIGINT AS total_size, count(*) AS n FROM c GROUP BY dir ORDER BY total_size DESC, dir LIMIT 10")(
    lambda c: c.groupBy("dir").agg(F.sum("size").alias("total_size"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("total_size"), "dir").limit(10))
files("flatten_names",
    r"SELECT path, CASE WHEN n = 0 THEN t ELSE regexp_replace(t, '(\.[^.]*)$', '_' || n || '\1') END AS target FROM (SELECT path, t, "
    r"row_number() OVER (PARTITION BY t ORDER BY path) - 1 AS n FROM (SELECT path, regexp_extract(dir, '^[^0-9]*') || extension AS t FROM "
    r"c))")(O.flatten_names)
query("compare_sets", CATALOG +
    f", b AS (SELECT DISTINCT c_custkey || {_EXT}[(c_custkey % 4 + 1)::BIGINT] AS other FROM customer), a AS (SELECT DISTINCT name AS own FROM c) SELECT coalesce(own, other) AS name, CASE WHEN other IS NULL THEN 'first' WHEN own IS NULL THEN 'second' ELSE 'both' END AS side FROM a FULL JOIN b ON own = other")(
    lambda load: O.compare_sets(O.catalog(load("documents")), load("customer").select(F.concat(F.col("c_custkey").cast("string"),
                F.element_at(F.array(*[F.lit(e) for e in O.EXTENSIONS]), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("name"))))
files("validate_files",
    "SELECT path, concat_ws('; ', CASE WHEN size = 0 THEN 'File is empty' END, CASE WHEN size > 5000 THEN 'File too large' END, CASE WHEN "
    "extension NOT IN ('.txt', '.csv', '.pdf') THEN 'Extension not allowed' END) AS errors, (size BETWEEN 1 AND 5000 AND extension IN "
    "('.txt', '.csv', '.pdf')) AS valid FROM c")(O.validate_files)
_IN = lambda unit, by: f"printf('%.2f {unit}', floor(size / {by}.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE)"
files("human_size",
    f"SELECT path, CASE WHEN size = 0 THEN '0 B' WHEN size >= 1099511627776 THEN {_IN('TB', 1024**4)} WHEN size >= 1073741824 THEN {_IN('GB', 1024**3)} WHEN size >= 1048576 THEN {_IN('MB', 1024**2)} WHEN size >= 1024 THEN {_IN('KB', 1024)} ELSE {_IN('B', 1)} END AS human FROM (SELECT path, size * [1, 1000, 1000000, 1000000000][(doc_id % 4 + 1)::BIGINT] AS size FROM c)")(
    lambda c: c.select("path", K.human_size(F.col("size") * F.element_at(F.array(*[F.lit(1000**i) for i in range(4)]), (F.col(
                "doc_id") % 4 + 1).cast("int"))).alias("human")))
files("mime_category",
    f"SELECT path, {KIND} AS mime, CASE WHEN starts_with({KIND}, 'text/') THEN 'document' WHEN starts_with({KIND}, 'image/') THEN 'image' WHEN starts_with({KIND}, 'audio/') THEN 'audio' ELSE 'binary' END AS category FROM c")(
    lambda c: c.select("path", K.lookup(F.col("extension"), K.MIME, "application/octet-stream").alias("mime")).withColumn("category",
        K.mime_category(F.col("mime"))))
_HEAD = "[" + ", ".join(f"'{h}'" for h, _ in K.MAGIC) + f"][(doc_id % {len(K.MAGIC) + 3} + 1)::BIGINT]"
_SIG = "CASE " + " ".join(f"WHEN starts_with(head, '{h}') THEN '{m}'" for h, m in K.MAGIC) + " END"


def _head():
    return F.concat(F.coalesce(F.get(F.array(*[F.lit(h) for h, _ in K.MAGIC]), (F.col("doc_id") % (len(K.MAGIC) + 3)).cast("int")), F.lit(
                "")), F.hex(F.encode(F.substring("content", 1, 8), "UTF-8")))


files("magic_detect",
    f", h AS (SELECT path, coalesce({_HEAD}, '') || hex(encode(substr(content, 1, 8))) AS head FROM c) SELECT path, {_SIG} AS mime FROM h")(
    lambda c: c.select("path", K.magic(_head()).alias("mime")))
files("detect_chain",
    f", h AS (SELECT path, extension, coalesce({_HEAD}, '') || hex(encode(substr(content, 1, 8))) AS head FROM c) SELECT path, coalesce({case('extension', K.MIME, 'NULL')}, {_SIG}, 'text/plain') AS mime, CASE WHEN {case('extension', K.MIME, 'NULL')} IS NOT NULL THEN 'extension' WHEN {_SIG} IS NOT NULL THEN 'signature' ELSE 'fallback' END AS method FROM h")(
    lambda c: c.select("path", K.lookup(F.col("extension"), K.MIME, None).alias("e"), K.magic(_head()).alias("m")).select("path",
        F.coalesce("e", "m", F.lit("text/plain")).alias("mime"), F.when(F.col("e").isNotNull(), "extension").when(F.col("m").isNotNull(),
            "signature").otherwise("fallback").alias("method")))
files("mode_string", "SELECT path, " + " || ".join(
        f"CASE WHEN ((doc_id % 512) >> {i}) & 1 = 1 THEN '{'xwr'[i % 3]}' ELSE '-' END" for i in range(8, -1, -1)) +
    " AS mode FROM c")(lambda c: c.select("path", K.mode_string((F.col("doc_id") % 512).cast("int")).alias("mode")))
files("organize_paths",
    f"SELECT path, {PLURAL} || '/' || name AS by_category, strftime(mtime, '%Y-%m') || '/' || name AS by_month, ltrim(extension, '.') || '/' || name AS by_extension FROM c")(
    lambda c: c.select("path", F.concat_ws("/", K.category(F.col("extension"), K.PLURAL, "other"), "name").alias("by_category"),
        F.concat_ws("/", F.date_format("mtime", "yyyy-MM"), "name").alias("by_month"), F.concat_ws("/", F.ltrim("extension", F.lit(".")),
            "name").alias("by_extension")))
files("month_bucket", "SELECT strftime(mtime, '%Y-%m') AS month, count(*) AS n FROM c GROUP BY 1")(lambda c: c.groupBy(F.date_format(
            "mtime", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n")))
files("batch_rename",
    r"SELECT path, regexp_replace(name, '([0-9]+)1\.', 'file_\1_.') AS new_name FROM c WHERE regexp_replace(name, '([0-9]+)1\.', "
    r"'file_\1_.') <> name")(lambda c: c.select("path", "name", F.regexp_replace("name", r"([0-9]+)1\.", "file_$1_.").alias("new_name"))
    .where("name <> new_name").drop("name"))
files("retention",
    "SELECT path, dir FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY mtime DESC, path) AS r FROM c) WHERE r > 5")(lambda c: c
    .withColumn("r", F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("mtime"), "path"))).where("r > 5").select("path", "dir"))
files("file_info",
    f"SELECT path, size, CASE WHEN size < 10485760 THEN md5(content) END AS md5, CASE WHEN size < 10485760 THEN sha256(content) END AS sha256, epoch(mtime)::BIGINT AS mtime_epoch, {CAT} AS category FROM c")(
    lambda c: c.select("path", "size", F.when(F.col("size") < 10485760, F.md5("content")).alias("md5"), F.when(F.col("size") < 10485760,
            F.sha2("content", 256)).alias("sha256"), epoch(F.col("mtime")).alias("mtime_epoch"), K.category(F.col("extension")).alias(
            "category")))
_TO = " UNION ALL ".join(f"SELECT '.{a}' AS e, '{b}' AS to_format" for a, bs in K.CONVERSIONS.items() for b in bs.split())
files("conversion_suggestions",
    f", t AS ({_TO}) SELECT path, to_format, CASE WHEN (e, to_format) IN (('.csv', 'xlsx'), ('.txt', 'pdf')) THEN 'simple' WHEN (e, to_format) IN (('.pdf', 'docx'), ('.docx', 'pdf')) THEN 'complex' ELSE 'medium' END AS complexity FROM c JOIN t ON extension = e")(
    lambda c: c.select("path", "extension", F.explode(F.split(K.lookup(F.ltrim("extension", F.lit(".")), K.CONVERSIONS, None), " ")).alias(
            "to_format")).select("path", "to_format", F.when(F.concat("extension", "to_format").isin(".csvxlsx", ".txtpdf"), "simple")
        .when(F.concat("extension", "to_format").isin(".pdfdocx", ".docxpdf"), "complex").otherwise("medium").alias("complexity")))
files("chunk_rows", "SELECT path, (row_number() OVER (PARTITION BY dir ORDER BY path) - 1) // 10 AS batch FROM c")(
    lambda c: c.select("path", F.floor((F.row_number().over(Window.partitionBy("dir").orderBy("path")) - 1) / 10).cast("long").alias("batch")))
files("time_estimate",
    "SELECT dir, count(*) AS n, (count(*) * 2.0)::DOUBLE AS serial_s, (count(*) * 2.0)::DOUBLE / least(4, count(*)) AS parallel_s, CASE "
    "WHEN count(*) > 10 THEN 'parallel' ELSE 'serial' END AS mode FROM c GROUP BY dir")(lambda c: c.groupBy("dir").agg(F.count(F.lit(1))
        .alias("n")).select("dir", "n", (F.col("n") * 2.0).alias("serial_s"), (F.col("n") * 2.0 / F.least(F.lit(4), F.col("n"))).alias(
            "parallel_s"), F.when(F.col("n") > 10, "parallel").otherwise("serial").alias("mode")))
files("batch_summary",
    "SELECT dir, count(*) AS processed, count(*) FILTER (WHERE size <= 5000) AS successful, count(*) FILTER (WHERE size > 5000) AS "
    "failed, floor(10000.0::DOUBLE * count(*) FILTER (WHERE size <= 5000) / count(*) + 0.5::DOUBLE) / 10000.0::DOUBLE AS success_rate "
    "FROM c GROUP BY dir")(lambda c: c.groupBy("dir").agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("size") <= 5000).alias(
            "successful"), F.count_if(F.col("size") > 5000).alias("failed")).withColumn("success_rate", F.floor(F.lit(10000.0) * F.col(
                "successful") / F.col("processed") + 0.5) / 10000.0))
from ..sources.sinks import column_widths  # noqa: E402

files("column_widths",
    "SELECT unnest(['path', 'dir', 'size']) AS \"column\", unnest([least(greatest(max(length(path)), 4) + 2, 50), "
    "least(greatest(max(length(dir)), 3) + 2, 50), least(greatest(max(length(size::VARCHAR)), 4) + 2, 50)])::BIGINT AS width FROM c")(
    lambda c: column_widths(c.select("path", "dir", "size")))


_NAMED = """SELECT coalesce(source, '') || '/' || doc_id::VARCHAR || '/' || coalesce(lang, 'xx') || CASE WHEN n_chars % 20 = 0 THEN '' ELSE '_' || (n_chars % 20)::VARCHAR END || '.txt' AS path FROM documents"""
query("output_targets", f"""WITH p AS ({_NAMED}), t AS (
  SELECT path, regexp_extract(path, '[^/]*$') AS name, row_number() OVER (PARTITION BY name ORDER BY path) - 1 AS n FROM p
), b AS (
  SELECT name, substr(name, 1, length(name) - 4) AS stem, max(n) AS most FROM t GROUP BY name
), x AS (
  SELECT name, stem, unnest(range(1, most + 25)) AS k FROM b
), free AS (
  SELECT name, stem, k, row_number() OVER (PARTITION BY name ORDER BY k) AS n FROM x WHERE stem || '_' || k::VARCHAR || '.txt' NOT IN (SELECT name FROM b)
)
SELECT path, 'flattened_structure/s/' || CASE WHEN t.n = 0 THEN t.name ELSE free.stem || '_' || free.k::VARCHAR || '.txt' END AS target
FROM t LEFT JOIN free ON free.name = t.name AND free.n = t.n""")(lambda load: output_targets(load("documents").select(F.concat(F.coalesce("source", F.lit("")),
    F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), F.coalesce("lang", F.lit("xx")), F.when(F.col("n_chars") % 20 == 0, "").otherwise(F.concat(
        F.lit("_"), (F.col("n_chars") % 20).cast("string"))), F.lit(".txt")).alias("path")), "flattened", stamp="s"))
