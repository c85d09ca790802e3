"""URL and page queries over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import WORD
from ..operators import web as O
from ..sources.html import parse_pages
from .base import query

_URLS = """WITH u AS (SELECT url FROM pages UNION ALL SELECT 'ftp:' || url FROM pages UNION ALL SELECT replace(url, 'example.', 'example<') FROM pages UNION ALL SELECT 'http://localhost:' || page_id FROM pages UNION ALL SELECT 'http://10.0.0.' || page_id FROM pages UNION ALL SELECT url || ' ' FROM pages) """


def urls(pages):
    more = ["concat('ftp:', url)", "replace(url, 'example.', 'example<')", "concat('http://localhost:', page_id)",
        "concat('http://10.0.0.', page_id)", "concat(url, ' ')"]
    return pages.select(F.explode(F.array("url", *[F.expr(e) for e in more])).alias("url"))


query("validate_url", _URLS + r""", p AS (SELECT url, regexp_matches(url, '(?i)^https?://\S+$') AS syn, regexp_matches(url, '(?i)^https://') AS https, regexp_matches(url, '[<>]') AS odd, regexp_extract(url, '(?i)^https?://([^/?#]*)', 1) AS host FROM u),
q AS (SELECT *, string_split(string_split(host, ':')[1], '.') AS parts FROM p), r AS (SELECT *, CASE WHEN host = '' THEN 'Missing domain' WHEN len(parts) < 2 THEN 'Missing top-level domain (TLD)' WHEN length(parts[-1]) < 2 OR NOT regexp_matches(parts[-1], '^\p{L}+$') THEN 'Invalid TLD: ' || parts[-1] END AS dom FROM q)
SELECT url, (syn AND dom IS NULL AND NOT odd) AS valid, (syn AND https) AS uses_https, CASE WHEN NOT syn THEN 'Invalid URL syntax (should start with http:// or https://)' ELSE concat_ws(' | ', dom, CASE WHEN NOT https THEN 'Consider using HTTPS for secure connections' END, CASE WHEN odd THEN 'URL contains suspicious characters (< or >)' END) END AS issues FROM r""")(lambda load: O.validate_url(urls(load("pages"))))
_BARE = r"regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->|(?i:<script\b.*?</script>|<style\b.*?</style>)', '', 'g')"
_N = lambda tag: rf"len(regexp_extract_all(b, '(?i)<{tag}[\s>/]'))::BIGINT"
query("page_flags",
    f"SELECT page_id, {_N('form')} AS forms, {_N('table')} AS tables, {_N('ul')} + {_N('ol')} AS lists, {_N('img')} AS images, " + ", "
    .join(f"{_N(f'h{i}')} AS h{i}" for i in range(1, 7)) +
    f" FROM (SELECT page_id, {_BARE} AS b FROM pages)")(lambda load: O.page_flags(load("pages")))
query("heading_counts",
    f"SELECT page_id, {_N('h1')} AS h1, (({_N('h1')} > 0)::INT + ({_N('h1')} = 1)::INT) / 2.0::DOUBLE AS score FROM (SELECT page_id, {_BARE} AS b FROM pages)")(
    lambda load: O.page_flags(load("pages")).select("page_id", "h1", (((F.col("h1") > 0).cast("int") + (F.col("h1") == 1).cast(
                "int")) / F.lit(2.0)).alias("score")))
query("ux_score",
    rf"SELECT page_id, (({_N('a')} > 5)::INT + ({_N('img')} > 0)::INT + ({_N('ul')} + {_N('ol')} > 0)::INT + ({_N('form')} > 0)::INT) / 4.0::DOUBLE AS score FROM (SELECT page_id, {_BARE} AS b FROM pages)")(
    lambda load: O.page_flags(load("pages")).join(load("pages").select(F.col("page_id").alias("p"), F.regexp_count(O.bare(F.col("html")),
                F.lit(r"(?i)<a[\s>/]")).alias("links")), F.col("page_id") == F.col("p")).select("page_id", (O._sum(F.col("links") > 5,
                F.col("images") > 0, F.col("lists") > 0, F.col("forms") > 0) / F.lit(4.0)).alias("score")))
query("status_class",
    "SELECT page_id, status, CASE WHEN status BETWEEN 200 AND 299 THEN 'Success' WHEN status BETWEEN 300 AND 399 THEN 'Redirection' WHEN "
    "status BETWEEN 400 AND 499 THEN 'Client Error' WHEN status BETWEEN 500 AND 599 THEN 'Server Error' ELSE 'Unknown' END AS "
    "status_class FROM (SELECT page_id, 100 + page_id % 7 * 100 AS status FROM pages)")(lambda load: O.status_class(load("pages").select(
            "page_id", (F.lit(100) + F.col("page_id") % 7 * 100).alias("status"))))
#: What the parser gives, by patterns that hold for the pages of the test tables: attributes in double quotes, no unclosed quotes, seven entities.
_TEXT = lambda x: f"replace(replace(replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;', '&')"
_PLAIN = lambda x: _TEXT(f"regexp_replace({x}, '<[^>]*>', '', 'g')")
_ATTR = lambda tag, name: rf"regexp_extract({tag}, '(?i)\s{name}=\x22([^\x22]*)\x22', 1)"
_TRIM = lambda x: rf"regexp_replace({x}, '^[\s\p{{Z}}\x0b\x1c-\x1f\x85]+|[\s\p{{Z}}\x0b\x1c-\x1f\x85]+$', '', 'g')"
PARSED = rf"""WITH b AS (SELECT page_id, url, {_BARE} AS b FROM pages), o AS (
  SELECT *, regexp_extract(url, '^[a-z]+://[^/?#]*') AS home, {_PLAIN("b")} AS flat,
         regexp_extract_all(b, '(?is)<a\s[^>]*href=[^>]*>.*?</a>') AS links_, regexp_extract_all(b, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS heads_, regexp_extract_all(b, '(?is)<img\s[^>]*>') AS images_, regexp_extract_all(b, '(?is)<meta\s[^>]*>') AS metas_
  FROM b
), p AS (
  SELECT *, CASE WHEN regexp_matches(b, '(?i)<title') THEN {_PLAIN("regexp_extract(b, '(?is)<title[^>]*>(.*?)</title>', 1)")} END AS title,
         array_to_string(list_filter(list_transform(regexp_split_to_array(flat, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{{2028}}\x{{2029}}]'), lambda x: {_TRIM("x")}), lambda x: x <> ''), chr(10)) AS text,
         list_filter(list_transform(metas_, lambda m: [coalesce(nullif({_ATTR("m", "name")}, ''), {_ATTR("m", "property")}), {_ATTR("m", "content")}]), lambda m: m[1] <> '' AND m[2] <> '') AS meta,
         coalesce(list_filter(list_transform(metas_, lambda m: CASE WHEN lower({_ATTR("m", "name")}) = 'description' THEN {_ATTR("m", "content")} END), lambda x: x IS NOT NULL)[1], '') AS description,
         {_ATTR("regexp_extract(b, '(?i)<html[^>]*>')", "lang")} AS lang, list_bool_or(list_transform(metas_, lambda m: lower({_ATTR("m", "name")}) = 'viewport')) AS viewport,
         list_bool_or(list_transform(metas_, lambda m: regexp_matches(m, '(?i)\scharset=') OR lower({_ATTR("m", "http-equiv")}) = 'content-type')) AS charset
  FROM o
)"""
_WORDS_ = r"regexp_extract_all(text, '[^\s\p{Z}\x0b\x1c-\x1f\x85]+')"
_R2 = lambda x: f"(floor(({x}) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE)"
_B = lambda *tests: "(" + " + ".join(f"coalesce({t}, false)::INT" for t in tests) + ")"
SCORED = PARSED + rf""", w AS (
  SELECT *, len({_WORDS_}) AS n, len(regexp_extract_all(text, '[.!?]+')) + 1 AS pieces, coalesce(list_sum(list_transform({_WORDS_}, lambda x: length(x))), 0) AS chars, coalesce(length(title), 0) AS tl, length(description) AS dl, {_N("h1")} AS h1,
         len(images_) AS images, len(list_filter(images_, lambda x: {_ATTR("x", "alt")} <> '')) AS alts, {_N("ul")} + {_N("ol")} AS lists, {_N("form")} AS forms, len(list_filter(links_, lambda x: {_ATTR("x", "href")} <> '' AND NOT regexp_matches({_ATTR("x", "href")}, '^(javascript:|mailto:|tel:)'))) AS n_links FROM p
), v AS (
  SELECT *, n::DOUBLE / pieces AS asl, CASE WHEN n > 0 THEN chars::DOUBLE / n ELSE 0.0::DOUBLE END AS awl FROM w
), s AS (
  SELECT page_id, url, least(0.5::DOUBLE + CASE WHEN tl > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN dl > 0 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN n > 100 THEN 0.1::DOUBLE ELSE 0 END, 1.0::DOUBLE) AS quick_score,
         {_R2(f"(CASE WHEN n > 300 THEN 2 WHEN n > 100 THEN 1 ELSE 0 END + CASE WHEN asl BETWEEN 15 AND 25 THEN 2 ELSE 0 END + CASE WHEN awl BETWEEN 4 AND 6 THEN 1 ELSE 0 END + {_R2(_B('h1 > 0', 'h1 = 1') + ' / 2.0::DOUBLE')}) / 7.0::DOUBLE")} AS content_quality,
         {_R2(_B("tl BETWEEN 30 AND 60", "dl BETWEEN 120 AND 160", "images > 0 AND alts::DOUBLE / images > 0.8::DOUBLE") + " / 4.0::DOUBLE")} AS seo,
         {_R2(_B("viewport", "charset", "lang <> ''", "true") + " / 4.0::DOUBLE")} AS technical, {_R2(_B("n_links > 5", "images > 0", "lists > 0", "forms > 0") + " / 4.0::DOUBLE")} AS user_experience FROM v
), g AS (
  SELECT *, content_quality * 0.4::DOUBLE + seo * 0.3::DOUBLE + technical * 0.2::DOUBLE + user_experience * 0.1::DOUBLE AS raw FROM s
), graded AS (
  SELECT page_id, url, quick_score, content_quality, seo, technical, user_experience, {_R2("raw")} AS overall_score,
         CASE WHEN raw >= 0.9 THEN 'A+' WHEN raw >= 0.8 THEN 'A' WHEN raw >= 0.7 THEN 'B' WHEN raw >= 0.6 THEN 'C' WHEN raw >= 0.5 THEN 'D' ELSE 'F' END AS grade FROM g
) """
_LINK = f"""SELECT page_id, CASE WHEN starts_with(href, '/') THEN home || href ELSE href END AS href, {_TRIM(_PLAIN("x"))} AS text, starts_with(href, '/') AS relative, starts_with(href, '/') OR regexp_extract(href, '^[a-z]+://[^/?#]*') = home AS internal
FROM (SELECT page_id, home, x, {_TEXT(_ATTR("x", "href"))} AS href FROM (SELECT page_id, home, unnest(links_) AS x FROM p)) WHERE href <> '' AND NOT regexp_matches(href, '^(javascript:|mailto:|tel:)')"""
_JSON = lambda *pairs: "'{' || " + " || ',' || ".join(f"'\"{k}\":' || to_json({v})" for k, v in pairs) + " || '}'"
query("page_title", PARSED + "SELECT page_id, title, length(title) AS length FROM p")(lambda load: parse_pages(load("pages")).select(
        "page_id", "title", F.length("title").alias("length")))
query("page_links", PARSED + _LINK)(lambda load: parse_pages(load("pages")).select("page_id", F.explode("links").alias("l")).select("page_id", "l.*"))
query("page_text", PARSED +
    rf"SELECT page_id, length(text)::BIGINT AS characters, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS words, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS lines FROM p")(
    lambda load: O.page_text(parse_pages(load("pages"))))
query("page_quick_score", SCORED + "SELECT page_id, quick_score FROM graded")(lambda load: O.page_scores(parse_pages(load("pages"))).select(
        "page_id", "quick_score"))
query("page_grade", SCORED + "SELECT * EXCLUDE (url) FROM graded")(lambda load: O.page_scores(parse_pages(load("pages"))))
_VALID = r"regexp_matches(url, '(?i)^https?://\S+$') AND NOT regexp_matches(url, '[<>]') AND regexp_matches(regexp_extract(url, '(?i)^https?://([^/?#]*)', 1), '^[^:]*\.\p{L}{2,}(:.*)?$')"
query("web_pipeline", SCORED +
    f"SELECT a.* EXCLUDE (url) FROM graded a JOIN (SELECT url FROM pages WHERE {_VALID}) u ON u.url = a.url")(
    lambda load: O.validate_url(load("pages")).where("valid").select("url").join(load("pages"),
        "url").transform(parse_pages).transform(O.page_scores))
