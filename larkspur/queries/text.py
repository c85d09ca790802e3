"""Text queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import text as O
from ..session import spread
from .base import query

W, WS = T.WORD, T.BLANK
STRIP = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
R = lambda x, n: f"(floor(({x}) * {10**n}.0::DOUBLE + 0.5::DOUBLE) / {10**n}.0::DOUBLE)"
PER = lambda a, b: f"(CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b})::DOUBLE ELSE 0.0::DOUBLE END)"
SUM = lambda x: f"coalesce(list_sum({x}), 0)::BIGINT"
COUNT = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"

BASE = f"""WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents
), b AS (
  SELECT *, regexp_extract_all(text, '{W}') AS w,
         list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: {STRIP("x")}), lambda x: x <> '') AS s
  FROM d
), n AS (
  SELECT *, len(w)::BIGINT AS n, len(s)::BIGINT AS ns, list_transform(w, lambda x: length(x)) AS lens,
         list_transform(s, lambda x: {COUNT("x", W)}) AS per_s,
         {SUM("list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+'))))")} AS syll
  FROM b
), m AS (
  SELECT *, {R(PER("len(list_distinct(w))", "n"), 3)} AS ld, {R(PER(SUM("lens"), "n"), 1)} AS awl, {R(PER("syll", "n"), 2)} AS spw, {R(PER(SUM("per_s"), "ns"), 1)} AS asl FROM n
), r AS (
  SELECT *, greatest(0.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * asl - 84.6::DOUBLE * spw) AS flesch,
         greatest(0.0::DOUBLE, 0.39::DOUBLE * asl + 11.8::DOUBLE * spw - 15.59::DOUBLE) AS fk,
         greatest(0.0::DOUBLE, 4.71::DOUBLE * awl + 0.5::DOUBLE * asl - 21.43::DOUBLE) AS ari FROM m
), l AS (
  SELECT *, CASE WHEN flesch >= 90 THEN 'Very Easy (5th grade)' WHEN flesch >= 80 THEN 'Easy (6th grade)' WHEN flesch >= 70 THEN 'Fairly Easy (7th grade)'
    WHEN flesch >= 60 THEN 'Standard (8th-9th grade)' WHEN flesch >= 50 THEN 'Fairly Difficult (10th-12th grade)' WHEN flesch >= 30 THEN 'Difficult (College)' ELSE 'Very Difficult (Graduate)' END AS lvl FROM r
)
"""


def doc_query(name: str, operator, select: str, base: str = BASE, **params):
    query(name, base + select)(lambda load: operator(spread(load("documents")), **params))


@query("corpus_by_lang", BASE +
    "SELECT lang, count(*) AS n_docs, sum(n)::BIGINT AS n_words, sum(ns)::BIGINT AS n_sentences, max(n)::BIGINT AS longest FROM n GROUP "
    "BY lang")
def corpus_by_lang(load):
    b = spread(load("documents")).select("lang", F.size(T.words(F.col("text"))).alias("w"), F.size(T.sentences(F.col("text"))).alias("s"))
    return b.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("w").alias("n_words"), F.sum("s").alias("n_sentences"), F.max(
            "w").cast("long").alias("longest"))


doc_query("token_counts", O.token_counts,
    f"SELECT doc_id, n AS words, len(list_distinct(list_transform(w, lambda x: lower(x))))::BIGINT AS unique_words, ns AS sentences, len(list_filter(regexp_split_to_array(text, '\\n{WS}*\\n'), lambda x: {STRIP('x')} <> ''))::BIGINT AS paragraphs FROM n")
doc_query("text_light", O.text_light, f"""SELECT doc_id, n AS words, length(text)::BIGINT AS characters, length(replace(text, ' ', ''))::BIGINT AS characters_no_spaces, ns AS sentences,
  {R(PER(SUM("lens"), "n"), 1)} AS avg_word_length, {R(PER("n", "ns"), 1)} AS words_per_sentence,
  CASE WHEN {PER("n", "ns")} < 15 AND {PER(SUM("lens"), "n")} < 5 THEN 'Easy' WHEN {PER("n", "ns")} < 25 THEN 'Moderate' ELSE 'Complex' END AS readability FROM n""")
doc_query("text_basic", O.text_basic,
    f"SELECT doc_id, length(text)::BIGINT AS characters, length(regexp_replace(text, '{WS}', '', 'g'))::BIGINT AS characters_no_spaces, ({COUNT('text', chr(92) + 'n')} + 1)::BIGINT AS lines FROM d")
_CLASSES = {"letters": r"\p{L}", "digits": r"\p{Nd}", "spaces": WS, "punctuation": r"[!-/:-@\[-`{-~]"}
doc_query("char_classes", O.char_classes,
    "SELECT doc_id, letters, digits, spaces, punctuation, k - letters - digits - spaces - punctuation AS other, " + R(PER("letters", "k"),
        3) + " AS letter_ratio FROM (SELECT doc_id, length(text)::BIGINT AS k, " + ", ".join(f"{COUNT('text', p)}::BIGINT AS {c}" for c,
        p in _CLASSES.items()) + " FROM d)")
doc_query("word_stats", O.word_stats,
    "SELECT doc_id, n AS total, len(list_distinct(w))::BIGINT AS \"unique\", ld AS lexical_diversity, awl AS average_word_length, "
    "list_max(lens)::BIGINT AS max_word_length, list_min(lens)::BIGINT AS min_word_length, syll AS total_syllables, spw AS "
    "average_syllables FROM m")
doc_query("sentence_stats", O.sentence_stats,
    "SELECT doc_id, ns AS total, asl AS average_sentence_length, list_max(per_s)::BIGINT AS max_sentence_length, list_min(per_s)::BIGINT "
    "AS min_sentence_length FROM m")
doc_query("readability", O.readability,
    f"SELECT doc_id, {R('flesch', 1)} AS flesch_reading_ease, {R('fk', 1)} AS flesch_kincaid_grade, {R('ari', 1)} AS automated_readability_index, lvl AS reading_level FROM l")
doc_query("complexity", O.complexity, f"""SELECT doc_id, {R("raw", 1)} AS score, CASE WHEN raw < 33 THEN 'Simple' WHEN raw < 66 THEN 'Moderate' ELSE 'Complex' END AS level,
  CASE WHEN ld > 0.7::DOUBLE THEN 'High' WHEN ld > 0.5::DOUBLE THEN 'Medium' ELSE 'Low' END AS vocabulary_diversity, CASE WHEN asl > 20 THEN 'Complex' WHEN asl > 15 THEN 'Moderate' ELSE 'Simple' END AS sentence_structure,
  CASE WHEN awl > 6 THEN 'Complex' WHEN awl > 5 THEN 'Moderate' ELSE 'Simple' END AS word_complexity
  FROM (SELECT *, least(greatest((1.0::DOUBLE - ld) * 25 + least(asl / 5, 25.0::DOUBLE) + least(awl * 3, 25.0::DOUBLE) + (100.0::DOUBLE - {R("flesch", 1)}) / 2, 0.0::DOUBLE), 100.0::DOUBLE) AS raw FROM r)""")
doc_query("insights", O.insights, """SELECT doc_id, concat_ws(' | ', CASE WHEN ld > 0.7::DOUBLE THEN 'Rich vocabulary with high word diversity' WHEN ld < 0.3::DOUBLE THEN 'Consider using more varied vocabulary' END,
  CASE WHEN asl > 25 THEN 'Long sentences may affect readability - consider breaking them up' WHEN asl < 10 THEN 'Short, punchy sentences - good for clarity' END,
  CASE WHEN contains(lvl, 'Difficult') THEN 'Text may be challenging for general audiences' WHEN contains(lvl, 'Easy') THEN 'Accessible writing style suitable for broad audiences' END,
  CASE WHEN awl > 6 THEN 'Uses longer words - consider simpler alternatives' END) AS insights FROM l""")
doc_query("length_histogram", O.length_histogram,
    "SELECT word_length::BIGINT AS word_length, count(*) AS n_words FROM (SELECT unnest(lens) AS word_length FROM n) GROUP BY word_length")
_TOP = """SELECT doc_id, rank, {out}, n FROM (SELECT doc_id, {x}, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rank FROM x GROUP BY doc_id, {x}) WHERE rank <= 10"""
_STOP = ", ".join(f"'{x}'" for x in T.STOP)
doc_query("top_words", O.top_words, f""", f AS (SELECT doc_id, w, list_filter(w, lambda x: lower(x) NOT IN ({_STOP}) AND length(x) > 2) AS k FROM b), g AS (SELECT doc_id, CASE WHEN len(k) > 0 THEN k ELSE w END AS k FROM f),
x AS (SELECT doc_id, unnest(k) AS word, generate_subscripts(k, 1) AS pos FROM g) """ + _TOP.format(out="word", x="word"))
doc_query("top_chars", O.top_chars,
    ", g AS (SELECT doc_id, string_split(text, '') AS k FROM d WHERE text <> ''), x AS (SELECT doc_id, unnest(k) AS char, "
    "generate_subscripts(k, 1) AS pos FROM g) " + _TOP.format(out="hex(encode(char)) AS char_hex", x="char"))
_CLEAN = f""", c AS (SELECT doc_id, text, {STRIP("text")} AS st, {STRIP(f"regexp_replace(text, '{WS}+', ' ', 'g')")} AS sq FROM d),
q AS (SELECT *, CASE WHEN length(sq) = length(st) THEN sq ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(sq, ' ([.,!?;:])', '\\1', 'g'), '\\( ', '(', 'g'), ' \\)', ')', 'g'), '\\.+', '.', 'g'), ',+', ',', 'g'), '!+', '!', 'g'), '\\?+', '?', 'g') END AS cleaned FROM c) """
doc_query("clean_text", O.clean_text, _CLEAN + f"""SELECT doc_id, cleaned, length(text)::BIGINT AS original_length, length(cleaned)::BIGINT AS cleaned_length,
  greatest(1, {COUNT("text", WS + "{2,}")} - {COUNT("cleaned", WS + "{2,}")} + (st <> text)::INT)::BIGINT AS changes, {R(PER("(length(text) - length(cleaned)) * 100.0::DOUBLE", "length(text)"), 1)} AS reduction_percent FROM q""")
doc_query("key_sentences", O.key_sentences, """, x AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS pos FROM b), y AS (SELECT *, least(length(s) / 100.0::DOUBLE, 1.0::DOUBLE) + CASE WHEN pos = 1 THEN 2.0 ELSE 0.0 END AS score FROM x),
z AS (SELECT *, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING) AS upto FROM y), p AS (SELECT doc_id, string_agg(s, ' ' ORDER BY score DESC, pos) AS summary FROM z WHERE upto <= 200 GROUP BY doc_id)
SELECT d.doc_id, coalesce(summary, substr(text, 1, 200)) AS summary FROM d LEFT JOIN p ON d.doc_id = p.doc_id""")
doc_query("sentence_scores", O.sentence_scores, f""", x AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS pos FROM b), y AS (SELECT doc_id, pos, list_transform(regexp_extract_all(s, '{W}'), lambda q: lower(q)) AS w FROM x),
z AS (SELECT doc_id, pos, unnest(list_filter(w, lambda q: length(q) > 3)) AS word FROM y), f AS (SELECT doc_id, word, count(*) AS f FROM z GROUP BY doc_id, word), t AS (SELECT z.doc_id, z.pos, sum(f)::BIGINT AS total FROM z JOIN f ON z.doc_id = f.doc_id AND z.word = f.word GROUP BY z.doc_id, z.pos)
SELECT y.doc_id, y.pos::BIGINT AS pos, coalesce(total, 0) AS total, len(w)::BIGINT AS words, {R(PER("coalesce(total, 0)", "len(w)"), 6)} AS score FROM y LEFT JOIN t ON y.doc_id = t.doc_id AND y.pos = t.pos""")
_FIXED = f""", t AS (SELECT doc_id, {STRIP("text")} AS t FROM d), u AS (SELECT doc_id, t, length(t) AS n, greatest(ceil(length(t) / 800.0)::INT - 1, 0) AS last FROM t), v AS (SELECT *, unnest(range(0, last + 1)) AS i FROM u),
x AS (SELECT doc_id, i, {STRIP("substr(t, (greatest(i * 800 - 100, 0) + 1)::BIGINT, (CASE WHEN i = last THEN n - greatest(i * 800 - 100, 0) ELSE (i + 1) * 800 - greatest(i * 800 - 100, 0) END)::BIGINT)")} AS c FROM v) """
doc_query("chunk_fixed", O.chunk_fixed, _FIXED + r"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS chunk, c AS text, len(regexp_extract_all(c, '[^\s\p{Z}\x0b\x1c-\x1f\x85]+'))::BIGINT AS word_count FROM x WHERE length(c) >= 50""")


def columns(name_: str, sql: str, base: str = BASE, **cols):
    """A projection query: Column functions of text on one side, SQL over ``d`` on the other."""
    query(name_, base + sql)(lambda load: spread(load("documents")).select("doc_id", *[c().alias(n) for n, c in cols.items()]))


t = lambda: F.col("text")
_ASCII_STRIP = lambda x: f"regexp_replace({x}, '^[\\s\\x0b\\x1c-\\x1f]+|[\\s\\x0b\\x1c-\\x1f]+$', '', 'g')"
_STEPS = "text"
for _p, _by in ((r"\r\n?", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"), (r"[^\x00-\x7F]+", " "), (r"[^A-Za-z0-9_\s.,!?;:()\-/\n]", "")):
    _STEPS = f"regexp_replace({_STEPS}, '{_p}', '{_by}', 'g')"
columns("ingest_clean", f"SELECT doc_id, {_ASCII_STRIP(_STEPS)} AS cleaned FROM d", cleaned=lambda: T.ingest_clean(t()))
_LAST = lambda mark: f"(CASE WHEN strpos(reverse(win), {mark}) > 0 THEN length(win) - strpos(reverse(win), {mark}) - length({mark}) + 1 ELSE -1 END)"
_ENDS = " ".join(
    f"WHEN {_LAST(mark)} > 800 * {share}::DOUBLE THEN b + {_LAST(mark)} + {f'length({mark})' if stays else '0'}"
    for mark, stays, share in (("chr(10) || chr(10)" if m.strip() == "" and len(m) == 2 else f"'{m}'", stays, share) for m, stays, share in O.CHUNK_ENDS)
)
#: One step of the recursion is one chunk: done is where the last one ended, b where this one begins, win its window.
_SMART = f"""WITH RECURSIVE d AS (SELECT doc_id, {_ASCII_STRIP(_STEPS)} AS t FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
r AS (
  SELECT doc_id, t, 0::BIGINT AS done, 0::BIGINT AS b, 0::BIGINT AS e FROM d WHERE length(t) > 800
  UNION ALL
  SELECT doc_id, t, CASE WHEN x > done THEN x ELSE done + 800 END AS done, b, CASE WHEN x > done THEN x ELSE done + 800 END AS e
  FROM (SELECT *, CASE WHEN done + 800 >= length(t) THEN length(t) {_ENDS} ELSE done + 800 END AS x
        FROM (SELECT doc_id, t, e AS done, greatest(e - 100, 0) AS b, substr(t, greatest(e - 100, 0) + 1, e + 800 - greatest(e - 100, 0)) AS win FROM r WHERE e < length(t)))
), c AS (
  SELECT doc_id, b, {_ASCII_STRIP("substr(t, b + 1, e - b)")} AS text FROM r WHERE e > 0
  UNION ALL SELECT doc_id, 0, t FROM d WHERE length(t) <= 800
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1)::BIGINT AS chunk, text, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM c WHERE length(text) >= 50"""
query("chunk_smart", _SMART)(lambda load: O.chunk_smart(spread(load("documents"))))
columns("clean_metrics", _CLEAN + "SELECT doc_id, length(sq)::BIGINT AS squeezed, length(st)::BIGINT AS stripped, (length(sq) <> length(st)) AS mended FROM q",
        squeezed=lambda: F.length(T.strip(F.regexp_replace(t(), f"{WS}+", " "))).cast("long"), stripped=lambda: F.length(T.strip(t())).cast("long"),
        mended=lambda: F.length(T.strip(F.regexp_replace(t(), f"{WS}+", " "))) != F.length(T.strip(t())))
columns("summary_first_n",
    r"SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN length(regexp_extract(substr(text, 1, 200), '(?s)^(.*[.!?])', 1)) > 1 "
    r"THEN regexp_extract(substr(text, 1, 200), '(?s)^(.*[.!?])', 1) ELSE substr(text, 1, 200) END AS summary FROM d",
    summary=lambda: T.first_n(t(), 200))
_TOK = r"len(regexp_extract_all(text, '[^\s\p{Z}\x0b\x1c-\x1f\x85]+'))"
columns("summary_strategy",
    f"SELECT doc_id, CASE WHEN {_TOK} < 50 THEN 'first_n' WHEN regexp_matches(lower(text), 'study|research|data|analysis') THEN 'extractive' ELSE 'key_sentences' END AS strategy FROM d",
    strategy=lambda: T.strategy(t()))
columns("retention_ratio",
    f", s2 AS (SELECT doc_id, list_distinct(list_transform(w, lambda x: lower(x))) AS o, list_distinct(list_transform(regexp_extract_all(substr(text, 1, 200), '{W}'), lambda x: lower(x))) AS z FROM b) SELECT doc_id, {R(PER('len(list_intersect(o, z))', 'greatest(len(o), 1)'), 3)} AS retention FROM s2",
    retention=lambda: T.retention(t(), F.substring(T.given(t()), 1, 200)))
_IND = {lang: " + ".join(f"contains(lower(text), '{w}')::INT" for w in ws) for lang, ws in T.INDICATORS.items()}
columns("detect_language", ", i AS (SELECT doc_id, " + ", ".join(f"{v} AS k_{k}" for k, v in _IND.items()) +
    " FROM d), j AS (SELECT *, greatest(k_en, k_es, k_fr, k_de) AS best FROM i) SELECT doc_id, CASE WHEN k_en = best THEN 'en' WHEN k_es "
    "= best THEN 'es' WHEN k_fr = best THEN 'fr' ELSE 'de' END AS detected_language, least(best::DOUBLE / 5.0::DOUBLE, 1.0::DOUBLE) AS "
    "confidence FROM j", detected_language=lambda: T.detected_language(t())[0], confidence=lambda: T.detected_language(t())[1])
columns("translate_mock",
    f", v AS (SELECT doc_id, text, lower({STRIP('text')}) AS low FROM d) SELECT doc_id, CASE WHEN contains(low, 'hello') THEN 'hallo' WHEN contains(low, 'goodbye') THEN 'auf wiedersehen' WHEN contains(low, 'thank you') THEN 'danke' ELSE '[DE: ' || text || ']' END AS translated FROM v",
    translated=lambda: T.translate_mock(t(), "de"))
columns("token_estimate",
    "SELECT doc_id, (length(text) // 4)::BIGINT AS tokens, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END "
    "AS truncated FROM d", tokens=lambda: F.floor(F.length(T.given(t())) / 4).cast("long"), truncated=lambda: F.when(F.length(t()) > 400,
        F.concat(F.substring(t(), 1, 400), F.lit("..."))).otherwise(T.given(t())))
columns("text_file_info",
    f"SELECT doc_id, ({COUNT('text', chr(92) + 'n')} + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END)::BIGINT AS lines, {_TOK}::BIGINT AS words, length(text)::BIGINT AS characters FROM d",
    lines=lambda: (F.regexp_count(T.given(t()), F.lit("\n")) + F.when((T.given(t()) == "") | t().endswith("\n"), 0).otherwise(1)).cast(
        "long"), words=lambda: F.size(T.tokens(t())).cast("long"), characters=lambda: F.length(T.given(t())).cast("long"))
_CODE = {"functions": "def |function |func ", "classes": "class |struct |interface ", "imports": "import |require|#include"}
columns("code_info", "SELECT doc_id, " + ", ".join(
        f"({' + '.join(f'{COUNT(chr(116) + chr(101) + chr(120) + chr(116), x)}' for x in p.split('|'))})::BIGINT AS {n}" for n,
        p in _CODE.items()) + " FROM d", **{n: (lambda p=p: sum((F.regexp_count(T.given(t()), F.lit(x)) for x in p.split("|")),
                F.lit(0)).cast("long")) for n, p in _CODE.items()})
columns("diff_summary", _CLEAN +
    f"SELECT doc_id, ({COUNT('cleaned', chr(92) + 'n')} - {COUNT('text', chr(92) + 'n')})::BIGINT AS lines, (length(cleaned) - length(text))::BIGINT AS characters, ({COUNT('cleaned', W)} - {COUNT('text', W)})::BIGINT AS words FROM q",
    lines=lambda: (F.regexp_count(T.clean(t()), F.lit("\n")) - F.regexp_count(t(), F.lit("\n"))).cast("long"),
    characters=lambda: (F.length(T.clean(t())) - F.length(t())).cast("long"),
    words=lambda: (F.size(T.words(T.clean(t()))) - F.size(T.words(t()))).cast("long"))
columns("sanitize", "SELECT doc_id, " + STRIP("translate(text, '<>&\"' || chr(39), '')") + " AS sanitized FROM d", sanitized=lambda: T.sanitize(T.given(t())))
columns("clean_filename", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(substr(text, 1, 40), '[<>:"/\\|?*]', '_', 'g'), '^ +| +$', '', 'g'), '^\.+|\.+$', '', 'g') AS name FROM d""", name=lambda: T.clean_filename(F.substring(T.given(t()), 1, 40)))
columns("content_hash", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM d", md5=lambda: F.md5(T.given(t())),
    sha256=lambda: F.sha2(T.given(t()), 256))
columns("preview",
    "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '... (truncated)' ELSE text END AS preview FROM d",
    preview=lambda: F.when(F.length(t()) > 100, F.concat(F.substring(t(), 1, 100), F.lit("... (truncated)"))).otherwise(T.given(t())))
columns("syllables", "SELECT doc_id, syll AS syllables FROM n", syllables=lambda: T.syllables(T.words(t())))
columns("is_text",
    r"SELECT doc_id, (CASE WHEN strlen(text) = 0 THEN false ELSE len(regexp_extract_all(substr(text, 1, 1024), "
    r"'[\x20-\x7E\t\n\r]'))::DOUBLE / length(substr(text, 1, 1024)) > 0.8::DOUBLE END) AS is_text FROM d", is_text=lambda: F
    .when(F.length(T.given(t())) == 0, F.lit(False)).otherwise(F.regexp_count(F.substring(t(), 1, 1024), F.lit(
                r"[\x20-\x7E\t\n\r]")) / F.length(F.substring(t(), 1, 1024)) > 0.8))
_HEADING = "(length(p) < 100 AND ((upper(p) = p AND lower(p) <> p) OR ends_with(p, ':')) AND NOT ends_with(p, '.') AND NOT ends_with(p, ','))"


@query("heading_detect", BASE +
    f", p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {STRIP('x')}), lambda x: x <> '') AS ps FROM d), u AS (SELECT doc_id, unnest(generate_series(0, len(ps) - 1)) AS pos, unnest(ps) AS p FROM p) SELECT doc_id, pos::BIGINT AS pos, p AS paragraph, {_HEADING} AS is_heading FROM u")
def heading_paragraphs(load):
    return O.heading_paragraphs(spread(load("documents")))


_FIRST = r"""CASE WHEN length(text) <= 200 THEN text WHEN length(regexp_extract(substr(text, 1, 200), '(?s)^(.*[.!?])', 1)) > 1
  THEN regexp_extract(substr(text, 1, 200), '(?s)^(.*[.!?])', 1) ELSE substr(text, 1, 200) END"""
_PIPE = f""", e AS (SELECT doc_id, cleaned AS text FROM q), i AS (SELECT doc_id, text, {", ".join(f"{v} AS k_{k}" for k, v in _IND.items())} FROM e)
SELECT doc_id, {_FIRST} AS summary, CASE greatest(k_en, k_es, k_fr, k_de) WHEN k_en THEN 'en' WHEN k_es THEN 'es' WHEN k_fr THEN 'fr' ELSE 'de' END AS language FROM i"""


@query("text_pipeline", BASE + _CLEAN + _PIPE)
def text_pipeline(load):
    return O.text_pipeline(spread(load("documents")))
