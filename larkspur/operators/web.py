"""Operators over URLs and parsed pages (see ``sources.html``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, per, rnd, tokens
from ..registry import operator


def _sum(*tests: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(False)).cast("int") for t in tests])


@operator(category="web")
def validate_url(urls: DataFrame) -> DataFrame:
    """url, valid, uses_https and the issues found, for http and https URLs."""
    url = F.coalesce("url", F.lit(""))
    rest = F.regexp_extract(url, r"(?i)^https?://([^/?#]*)", 1)
    parts = F.split(F.split(rest, ":", 2)[0], r"\.", -1)
    last = F.element_at(parts, -1)
    syntax, https, odd = url.rlike(r"(?i)^https?://\S+\z"), F.lower(url).startswith("https://"), url.rlike("[<>]")
    # fixed values: the messages
    domain = F.when(rest == "", "Missing domain").when(F.size(parts) < 2, "Missing top-level domain (TLD)").when(
        (F.length(last) < 2) | ~last.rlike(r"^\p{L}+\z"), F.concat(F.lit("Invalid TLD: "), last))
    # fixed values: the messages
    issues = F.when(~syntax, "Invalid URL syntax (should start with http:// or https://)").otherwise(F.concat_ws(" | ", domain, F
            .when(~https, "Consider using HTTPS for secure connections"), F.when(odd, "URL contains suspicious characters (< or >)")))
    return urls.select("url", (syntax & domain.isNull() & ~odd).alias("valid"), (syntax & https).alias("uses_https"), issues.alias("issues"))


@operator(category="web")
def page_scores(parsed: DataFrame) -> DataFrame:
    """Quick score, the four category scores, overall score and grade of each page.

    A page's HTTP status counts for its technical score if the table has a column ``status``; without
    one, pages count as fetched. Thresholds and weights are fixed values.
    """
    fetched = F.col("status") == 200 if "status" in parsed.columns else F.lit(True)
    flat = F.regexp_replace("text", "\n", " ")
    p = parsed.select("*", F.size(tokens(flat)).alias("n"), F.size(F.split(flat, "[.!?]+")).alias("pieces"),
        F.aggregate(F.transform(tokens(flat), F.length), F.lit(0), lambda a, x: a + x).alias("chars"), F.coalesce(F.length("title"),
            F.lit(0)).alias("tl"), F.length("description").alias("dl"), F.coalesce(F.try_element_at("headings", F.lit("h1")), F.lit(0))
        .alias("h1"))
    asl, awl = F.col("n") / F.col("pieces"), per(F.col("chars"), F.col("n"))
    quick = F.least(F.lit(0.5) + F.when(F.col("tl") > 0, 0.2).otherwise(0.0) + F.when(F.col("dl") > 0, 0.2).otherwise(0.0) + F.when(F.col(
                "n") > 100, 0.1).otherwise(0.0), F.lit(1.0))
    heads = rnd(_sum(F.col("h1") > 0, F.col("h1") == 1) / F.lit(2.0), 2)
    content = rnd((F.when(F.col("n") > 300, 2).when(F.col("n") > 100, 1).otherwise(0) + F.when(asl.between(15, 25), 2).otherwise(0) + F
            .when(awl.between(4, 6), 1).otherwise(0) + heads) / 7, 2)
    alt = (F.col("images") > 0) & (per(F.col("images_with_alt"), F.col("images")) > 0.8)
    seo = rnd(_sum(F.col("tl").between(30, 60), F.col("dl").between(120, 160), alt) / F.lit(4.0), 2)
    technical = rnd(_sum(F.col("viewport"), F.col("charset"), F.coalesce("lang", F.lit("")) != "", fetched) / F.lit(4.0), 2)
    ux = rnd(_sum(F.size("links") > 5, F.col("images") > 0, F.col("lists") > 0, F.col("forms") > 0) / F.lit(4.0), 2)
    s = p.select("page_id", quick.alias("quick_score"), content.alias("content_quality"), seo.alias("seo"), technical.alias("technical"), ux
        .alias("user_experience"))
    overall = F.col("content_quality") * 0.4 + F.col("seo") * 0.3 + F.col("technical") * 0.2 + F.col("user_experience") * 0.1
    grade = reduce(lambda rest, g: F.when(F.col("raw") >= g[0], g[1]).otherwise(rest), ((0.5, "D"), (0.6, "C"), (0.7, "B"), (0.8, "A"),
            (0.9, "A+")), F.lit("F"))
    return s.withColumn("raw", overall).select("*", rnd(F.col("raw"), 2).alias("overall_score"), grade.alias("grade")).drop("raw")


@operator(category="web")
def page_text(parsed: DataFrame) -> DataFrame:
    """Characters, words and lines of each page's text."""
    return parsed.select("page_id", F.length("text").cast("long").alias("characters"), F.regexp_count("text", F.lit(WORD)).cast("long")
        .alias("words"), F.when(F.col("text") == "", 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1).cast("long").alias("lines"))


def bare(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->|(?i:<script\b.*?</script>|<style\b.*?</style>)", "")


@operator(category="web")
def page_flags(pages: DataFrame) -> DataFrame:
    """Counts of forms, tables, lists, images, links and headings, by their tags."""
    count = lambda tag: F.regexp_count(F.col("b"), F.lit(rf"(?i)<{tag}[\s>/]")).cast("long")
    return pages.select("page_id", bare(F.col("html")).alias("b")).select("page_id", count("form").alias("forms"), count("table").alias(
            "tables"), (count("ul") + count("ol")).alias("lists"), count("img").alias("images"), *[count(f"h{i}").alias(
                f"h{i}") for i in range(1, 7)])


@operator(category="web")
def status_class(rows: DataFrame) -> DataFrame:
    """The class of an HTTP status ``status``."""
    s = F.col("status")
    names = ((200, "Success"), (300, "Redirection"), (400, "Client Error"), (500, "Server Error"))
    return rows.withColumn("status_class", reduce(lambda rest, n: F.when(s.between(n[0], n[0] + 99), n[1]).otherwise(rest), names, F.lit("Unknown")))


@operator(category="web")
def url_batch(urls: DataFrame) -> DataFrame:
    """How many URLs there are and how many are valid, and the rate as text."""
    out = validate_url(urls).agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("n_valid"))
    return out.withColumn("rate", F.format_string("%.1f%%", rnd(per(F.lit(100.0) * F.col("n_valid"), F.col("total")), 1)))


#: Fields of parsed pages by the name of what is extracted.
EXTRACTS = {"title": ["title"], "meta": ["meta"], "headers": ["heading_texts"], "links": ["links"], "text": ["text"], "images": ["image_list"]}


@operator(category="web")
def extract(parsed: DataFrame, parts: list[str]) -> DataFrame:
    """page_id, url and the named parts of parsed pages: title, meta, headers, links, text, images; unknown names are left out."""
    return parsed.select("page_id", "url", *[c for part in dict.fromkeys(parts) for c in EXTRACTS.get(part, [])])


@operator(category="web")
def seo_issues(parsed: DataFrame) -> DataFrame:
    """page_id and the ordered issues of title, description and images without alternative texts. The messages are fixed values."""
    title, description = F.length(F.coalesce("title", F.lit(""))), F.length("description")
    share = F.col("images_with_alt") / F.col("images")
    notes = F.array(F.when(title == 0, "Missing title").when(~title.between(30, 60), F.format_string("Title length %d not ideal", title)), F
        .when(description == 0, "Missing meta description").when(~description.between(120, 160), F.format_string(
                "Meta description length %d not ideal", description)), F.when((F.col("images") > 0) & (share <= 0.8), F.format_string(
                "Only %d%% of images have alt", F.floor(share * 100).cast("int"))),)
    return parsed.select("page_id", F.filter(notes, F.isnotnull).alias("issues"))


@operator(category="web")
def ip_literals(hosts: DataFrame) -> DataFrame:
    """host and its kind: ipv4, ipv6 or name."""
    byte = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = rf"{byte}(?:\.{byte}){{3}}"
    h = F.col("host")
    # at most seven groups beside "::", eight without; a dotted tail counts as two
    groups = F.size(F.filter(F.split(F.regexp_replace(h, rf"{v4}$", "0:0"), ":"), lambda g: g != ""))
    shape = h.rlike(rf"^[0-9A-Fa-f:]*(?:{v4})?$") & h.contains(":") & ~h.rlike(":::|::.*::|[0-9A-Fa-f]{5}") & ~h.rlike(
        "^:[^:]|[^:]:$") & ~h.rlike(rf"[0-9A-Fa-f]\.[^.]*:")
    v6 = shape & F.when(h.contains("::"), groups <= 7).otherwise(groups == 8)
    return hosts.select("host", F.when(h.rlike(f"^{v4}$"), "ipv4").when(v6, "ipv6").otherwise("name").alias("kind"))


@operator(category="web")
def redirect_summary(captures: DataFrame) -> DataFrame:
    """Of (url, history, final_url, status, seconds), as a fetch leaves them: the chain, how many redirects, whether it ends on https, the status class and the time."""
    chain = F.concat(F.coalesce("history", F.array().cast("array<string>")), F.array("final_url"))
    rows = status_class(captures).withColumn("chain", chain)
    return rows.select("url", "chain", (F.size("chain") - 1).cast("long").alias("redirect_count"), F.lower("final_url").startswith(
            "https://").alias("is_https"), "status", "status_class", rnd(F.col("seconds"), 2).alias("response_time_seconds"))
