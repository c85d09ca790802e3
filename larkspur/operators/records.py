"""Operators on records of batches, checks, layouts and recognised words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import files as K
from ..functions.text import per, rnd, strip
from ..registry import operator


def one() -> Column:
    return F.count(F.lit(1))


@operator(category="files")
def convertible_scan(files: DataFrame) -> DataFrame:
    """Files of each directory that some conversion takes, and the others."""
    can = F.ltrim(F.lower("extension"), F.lit(".")).isin(*K.CONVERSIONS)
    return files.groupBy("dir").agg(F.count_if(can).alias("convertible"), F.count_if(~can).alias("other"), one().alias("total"))


@operator(category="files")
def find_files(files: DataFrame, patterns: list[str]) -> DataFrame:
    """pattern and path of every match, in the order of paths; a file that fits several patterns is found for each."""
    fits = F.filter(F.array(*[F.when(F.col("name").rlike(K.glob(p)), F.lit(p)) for p in patterns]), F.isnotnull)
    return files.select(F.explode(fits).alias("pattern"), "path").orderBy("path", "pattern")


@operator(category="files")
def conversion_tool(files: DataFrame) -> DataFrame:
    """path, target and tool: a row for each tool that takes the file, or one without a tool."""
    tools = F.array(*[F.struct(F.lit(a).alias("e"), F.lit(b).alias("target"), F.lit(t).alias("tool")) for a, b, t in K.TOOLS])
    mine = F.filter(tools, lambda t: t.e == F.lower(F.col("extension")))
    return files.select("path", F.explode_outer(mine).alias("t")).select("path", "t.target", "t.tool")


@operator(category="files")
def dir_children(files: DataFrame) -> DataFrame:
    """Items, size and emptiness of each directory; a file of null size counts as empty."""
    return files.groupBy("dir").agg(one().alias("item_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size")).withColumn(
        "is_empty", F.col("item_count") == 0)


@operator(category="files")
def output_tree(files: DataFrame) -> DataFrame:
    """parent, name and is_file of a tree of depth two: directories before files, then by lower-case name."""
    dirs = files.select(F.lit("").alias("parent"), F.col("dir").alias("name"), F.lit(False).alias("is_file")).distinct()
    return dirs.unionByName(files.select(F.col("dir").alias("parent"), "name", F.lit(True).alias("is_file"))).orderBy("parent", "is_file", F.lower("name"))


@operator(category="files")
def error_skip(errors: DataFrame) -> DataFrame:
    """Whether each ``message`` lets its file be skipped, by words anywhere in it and in any case."""
    low = F.lower(F.coalesce("message", F.lit("")))
    return errors.select("path", reduce(lambda a, b: a | b, [low.contains(p.lower()) for p in K.SKIPPED]).alias("skip"))


@operator(category="files")
def file_record(files: DataFrame) -> DataFrame:
    """Stem, suffix, size in MB and time of each file; a leading dot is part of the stem."""
    return files.select(
        "path",
        F.regexp_replace("name", r"(?s)^(.+)\.[^.]*\z", "$1").alias("stem"),
        F.lower(F.regexp_extract("name", r"(?s)^.+(\.[^.]*)\z", 1)).alias("suffix"),
        rnd(F.col("size") / F.lit(1048576.0), 2).alias("size_mb"),
        F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified"),
    )


@operator(category="files")
def conversion_batch(results: DataFrame) -> DataFrame:
    """Counts by ``status`` (success, failed, skipped), the share of successes in what was tried, and the sizes of successes."""
    ok = F.col("status") == "success"
    rows = results.groupBy("dir").agg(
        F.count_if(ok).alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.coalesce(F.sum(F.when(ok, F.col("size"))), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum(F.when(ok, F.col("new_size"))), F.lit(0)).alias("size_after"),
    )
    rate = rnd(per(F.col("successful"), F.col("successful") + F.col("failed")), 4)
    change = rnd(per(F.lit(100.0) * (F.col("size_after") - F.col("size_before")), F.col("size_before")), 2)
    return rows.withColumns({"success_rate": rate, "change_percent": change})


@operator(category="images")
def image_basics(images: DataFrame) -> DataFrame:
    """Megapixels and the reduced aspect ratio of ``width`` and ``height`` (Euclid's steps, 46 at most for 32 bits).

    The ratio is null where a side is null or both are 0.
    """
    step = lambda s, _: F.when(s.b == 0, s).otherwise(F.struct(s.b.alias("a"), F.pmod(s.a, F.when(s.b == 0, F.lit(1)).otherwise(s.b)).cast(
                "long").alias("b")))
    start = F.struct(F.col("width").cast("long").alias("a"), F.col("height").cast("long").alias("b"))
    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(46)), start, step, lambda s: s.a)
    rows = images.withColumn("_g", gcd)
    part = lambda c: F.floor(F.try_divide(F.col(c), F.col("_g"))).cast("string")
    return rows.withColumns({"megapixels": rnd(F.col("width") * F.col("height") / F.lit(1000000.0), 2), "aspect": F.concat(part("width"),
                F.lit(":"), part("height"))}).drop("_g")


@operator(category="images")
def ocr_words(words: DataFrame, key: str = "image") -> DataFrame:
    """Words and confidence of each image, over words (``word``, ``conf``) that are not blank and have a confidence above 0."""
    good = words.where((F.col("conf") > 0) & (F.trim("word") != ""))
    rows = good.groupBy(key).agg(one().alias("word_count"), F.sum(F.length(F.trim("word"))).alias("character_count"), F.avg("conf").alias(
            "c"), F.min("conf").alias("min_confidence"), F.max("conf").alias("max_confidence"))
    band = F.when(F.col("c") > 80, "excellent").when(F.col("c") > 60, "good").when(F.col("c") > 40, "fair").otherwise("poor")
    return rows.withColumns({"average_confidence": rnd(F.col("c"), 4), "quality": band, "reading_minutes": rnd(F.col(
                    "word_count") / F.lit(200.0), 2)}).drop("c")


@operator(category="images")
def page_regions(blocks: DataFrame, share: float = 0.15) -> DataFrame:
    """Blocks (page, x0, y0, x1, y1, height) in reading order, and whether they are header or footer."""
    region = F.when(F.col("y1") <= F.col("height") * share, "header").when(F.col("y0") >= F.col("height") * (1 - share), "footer").otherwise("body")
    return blocks.withColumn("region", region).orderBy("page", "y0", "x0")


@operator(category="telemetry")
def health_summary(checks: DataFrame, by: str = "series") -> DataFrame:
    """Checks (``passed``) of each series: total, passed, failed, and whether all passed; null is a failure."""
    ok = F.coalesce("passed", F.lit(False))
    rows = checks.groupBy(by).agg(one().alias("total"), F.count_if(ok).alias("n_passed"))
    return rows.select(by, "total", "n_passed", (F.col("total") - F.col("n_passed")).alias("n_failed"), (F.col("total") == F.col(
                "n_passed")).alias("all_passed"))


@operator(category="telemetry")
def connectivity(hosts: DataFrame) -> DataFrame:
    """Overall state and issues of hosts by the flags resolvable, reachable, http and https; null flags are false."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    issues = F.filter(F.array(F.when(~on("resolvable"), "DNS resolution failed"), F.when(~on("reachable"),
                "Host is not reachable via ping"), F.when(~on("http") & ~on("https"), "HTTP/HTTPS services are not accessible")),
        F.isnotnull)
    return hosts.select("host", F.when(F.size(issues) > 0, "degraded").otherwise("healthy").alias("overall"), F.concat_ws("; ", issues).alias("issues"))


@operator(category="telemetry")
def diagnostics(issues: DataFrame, by: str = "series") -> DataFrame:
    """Overall status of each series: critical if an issue says so, warning if there is any, else healthy."""
    rows = issues.groupBy(by).agg(F.count("issue").alias("n_issues"), F.coalesce(F.bool_or(F.lower("issue").contains("critical")), F.lit(False)).alias("c"))
    return rows.select(by, "n_issues", F.when(F.col("c"), "critical").when(F.col("n_issues") > 0, "warning").otherwise("healthy").alias("overall"))


@operator(category="telemetry")
def eta(progress: DataFrame) -> DataFrame:
    """Seconds that a linear course needs in all, from ``elapsed_s`` and ``percent``; null without progress."""
    return progress.withColumn("eta_s", F.when(F.col("percent") > 0, rnd(F.col("elapsed_s") / (F.col("percent") / F.lit(100.0)), 3)))


@operator(category="workflow")
def parameter_sets(calls: DataFrame, required: list[str]) -> DataFrame:
    """Required names that a call's ``given`` array lacks, and given names that are not required, sorted."""
    need = F.array(*[F.lit(r) for r in required])
    given = F.coalesce("given", F.array().cast("array<string>"))
    sides = {"missing": F.array_except(need, given), "extra": F.array_except(given, need)}
    return calls.select("call", *[F.array_join(F.array_sort(c), ",").alias(k) for k, c in sides.items()])


@operator(category="images")
def image_collection(images: DataFrame) -> DataFrame:
    """Images (format, mode, width, height) by format: counts, sizes, and advice where over half are grey (mode L)."""
    size = [f(c).alias(f"{n}_{c}") for c in ("width", "height") for n, f in (("min", F.min), ("max", F.max))]
    rows = images.groupBy("format").agg(one().alias("n"), F.count_if(F.col("mode") == "L").alias("n_grey"), *size, rnd(F.avg("width"), 2)
        .alias("avg_width"), rnd(F.avg("height"), 2).alias("avg_height"))
    return rows.withColumn("advice", F.when(F.col("n_grey") * 2 > F.col("n"), "store as greyscale"))


@operator(category="files")
def table_clean(tables: DataFrame) -> DataFrame:
    """Tables (id, cells: array of rows) with stripped cells, without blank rows, all rows as wide as the widest."""
    rows = F.transform(F.coalesce("cells", F.array().cast("array<array<string>>")), lambda r: F.transform(r, lambda c: strip(F.coalesce(c, F.lit("")))))
    full = tables.withColumn("cells", F.filter(rows, lambda r: F.exists(r, lambda c: c != "")))
    full = full.withColumn("_width", F.coalesce(F.array_max(F.transform("cells", F.size)), F.lit(0)))
    return full.withColumn("cells", F.transform("cells", lambda r: F.concat(r, F.array_repeat(F.lit(""), F.col("_width") - F.size(r))))).drop("_width")


@operator(category="telemetry")
def progress_states(events: DataFrame, done: str = "purchase", failed: str = "error") -> DataFrame:
    """Each operation's (key, kind, t) events: steps, span, and a status of completed, failed (never completed) or active."""
    ended, broke = F.bool_or(F.col("kind") == done), F.bool_or(F.col("kind") == failed)
    rows = events.groupBy("key").agg(one().alias("steps"), (F.max("t") - F.min("t")).alias("span_s"), ended.alias("e"), broke.alias("b"))
    return rows.select("key", "steps", "span_s", F.when(F.col("e"), "completed").when(F.col("b"), "failed").otherwise("active").alias("status"))
