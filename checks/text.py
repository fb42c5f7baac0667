"""Queries over page text: numbers, headings, references, word facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.fixtures import add_view, oracle
from quire.functions import numerals, text as t

QUERIES, ORACLES = {}, {}


def q(name, view, sql):
    def add(function):
        QUERIES[name] = function
        ORACLES[name] = oracle(view, sql)
        return function
    return add


add_view("f_tokens", r"""
  SELECT book_id, scan_index, list_filter(tok, lambda x: regexp_full_match(x, '[0-9]+')) AS arabic,
         list_filter(tok, lambda x: x <> '' AND regexp_full_match(lower(x), 'm{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})')) AS roman, tok
  FROM (SELECT *, regexp_split_to_array(full_text, '[^\p{L}\p{N}_]+') AS tok FROM f_text)""", ["f_text"])


def _digit(expr: str) -> str:
    return f"(CASE lower({expr}) WHEN 'm' THEN 1000 WHEN 'd' THEN 500 WHEN 'c' THEN 100 WHEN 'l' THEN 50 WHEN 'x' THEN 10 WHEN 'v' THEN 5 WHEN 'i' THEN 1 ELSE 0 END)"


def roman_sql(column: str) -> str:
    here, after = _digit(f"substr({column}, k, 1)"), _digit(f"substr({column}, k + 1, 1)")
    return (f"CAST(list_sum(list_transform(range(1, length({column}) + 1), lambda k: {here} * "
            f"CASE WHEN {here} >= {after} THEN 1 ELSE -1 END)) AS INTEGER)")


@q("extract_arabic", "f_tokens", """
SELECT book_id, scan_index, CAST(o - 1 AS INTEGER) AS ord, text, least(coalesce(try_cast(text AS BIGINT), 1000000000000000000), 1000000000000000000) AS numeric_value, 80.0::DOUBLE AS confidence
FROM (SELECT book_id, scan_index, unnest(arabic) AS text, generate_subscripts(arabic, 1) AS o FROM f_tokens)""")
def extract_arabic(spark, sf_dir):
    return t.text_numbers(fx.f_text(spark, sf_dir)).where("number_type = 'arabic'").drop("number_type")


@q("extract_roman", "f_tokens", f"""
SELECT book_id, scan_index, CAST(o - 1 + n AS INTEGER) AS ord, text, {roman_sql("text")} AS numeric_value, 75.0::DOUBLE AS confidence
FROM (SELECT book_id, scan_index, len(arabic) AS n, unnest(roman) AS text, generate_subscripts(roman, 1) AS o FROM f_tokens)""")
def extract_roman(spark, sf_dir):
    return t.text_numbers(fx.f_text(spark, sf_dir)).where("number_type = 'roman'").drop("number_type")


@q("text_numbers", "f_tokens", f"""
SELECT * FROM (
  SELECT book_id, scan_index, x AS text, 'arabic' AS number_type, CAST(x AS INTEGER) AS numeric_value, 70.0::DOUBLE AS confidence
  FROM (SELECT book_id, scan_index, unnest(list_filter(arabic, lambda a: length(a) <= 3)) AS x FROM f_tokens)
  UNION ALL SELECT book_id, scan_index, x, 'roman', {roman_sql("x")}, 75.0 FROM (SELECT book_id, scan_index, unnest(list_filter(list_transform(tok, lambda a: lower(a)), lambda a: regexp_full_match(a, '[ivxlcdm]{{1,10}}'))) AS x FROM f_tokens))
WHERE numeric_value BETWEEN 1 AND CASE WHEN number_type = 'roman' THEN 50 ELSE 500 END""")
def text_numbers(spark, sf_dir):
    return t.short_numbers(fx.f_text(spark, sf_dir)).drop("ord")


@q("extract_hybrid", "f_text", r"""
SELECT book_id, scan_index, 'thousands' AS form, x AS text, 'arabic' AS number_type, try_cast(regexp_replace(x, '[,.]', '', 'g') AS BIGINT) AS numeric_value
FROM (SELECT book_id, scan_index, unnest(regexp_extract_all(full_text, '\b[0-9]{1,3}(?:[,.][0-9]{3})*\b')) AS x FROM f_text)
UNION ALL SELECT book_id, scan_index, 'decimal', x, 'arabic', try_cast(split_part(x, '.', 1) AS INTEGER) FROM (SELECT book_id, scan_index, unnest(regexp_extract_all(full_text, '\b[0-9]+\.[0-9]+\b')) AS x FROM f_text)
UNION ALL SELECT book_id, scan_index, 'chapter_page', x, 'hybrid', try_cast(regexp_extract(x, '[0-9]+$') AS INTEGER) FROM (SELECT book_id, scan_index, unnest(regexp_extract_all(full_text, '(?i)\b(?:Chapter|Ch\.?)\s*[0-9]+[,\s]+(?:Page|p\.?)\s*[0-9]+\b')) AS x FROM f_text)
UNION ALL SELECT book_id, scan_index, 'section', x, 'hierarchical', try_cast(split_part(x, '.', 1) AS INTEGER) FROM (SELECT book_id, scan_index, unnest(regexp_extract_all(full_text, '\b[0-9]+\.[0-9]+\b')) AS x FROM f_text)""")
def extract_hybrid(spark, sf_dir):
    pages = fx.f_text(spark, sf_dir)
    parts = [t.extra_numbers(pages, form).drop("ord").withColumn("form", F.lit(form)) for form in t.EXTRA_FORMS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# letter by letter: words are runs of word characters
add_view("f_letters", r"""
  SELECT book_id, scan_index, unnest(string_split(full_text, '')) AS ch, generate_subscripts(string_split(full_text, ''), 1) AS p FROM f_text""", ["f_text"])
add_view("f_runs", r"""
  SELECT book_id, scan_index, min(p) AS start, string_agg(ch, '' ORDER BY p) AS tok FROM (
    SELECT *, p - row_number() OVER (PARTITION BY book_id, scan_index ORDER BY p) AS run FROM f_letters WHERE regexp_matches(ch, '[\p{L}\p{N}_]'))
  GROUP BY book_id, scan_index, run""".replace("\\\\", "\\"), ["f_letters"])


@q("number_contexts", ["f_text", "f_runs"], """
SELECT r.book_id, r.scan_index, number_type, tok AS text, start, CAST(length(tok) AS BIGINT) AS length,
       trim(substr(full_text, greatest(start - 20, 1), start - greatest(start - 20, 1) + length(tok) + 20), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS context
FROM (SELECT *, CASE WHEN regexp_full_match(tok, '[0-9]+') THEN 'arabic'
                     WHEN regexp_full_match(lower(tok), 'm{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})') THEN 'roman' END AS number_type FROM f_runs) r
JOIN f_text t ON t.book_id = r.book_id AND t.scan_index = r.scan_index WHERE number_type IS NOT NULL""")
def number_contexts(spark, sf_dir):
    return t.located_numbers(fx.f_text(spark, sf_dir)).drop("ord")


@q("roman_to_int", "f_tokens", f"""
SELECT DISTINCT word, CASE WHEN regexp_full_match(word, '[ivxlcdm]+') AND {roman_sql("word")} > 0 THEN {roman_sql("word")} END AS value,
       regexp_full_match(word, '[ivxlcdm]+') AS loose
FROM (SELECT lower(unnest(tok)) AS word FROM f_tokens) WHERE word <> ''""")
def roman_to_int(spark, sf_dir):
    token = F.explode(F.split("full_text", r"[^\p{L}\p{N}_]+")).alias("word")
    word = F.col("word")
    return (fx.f_text(spark, sf_dir).select(token).select(F.lower("word").alias("word")).where(word != "").distinct()
            .select("word", numerals.roman_value(word).alias("value"), numerals.is_loose_roman(word).alias("loose")))


@q("int_to_roman", "f_lines", """
SELECT DISTINCT n, repeat('l', n // 50) || CASE WHEN n % 50 >= 40 THEN 'xl' ELSE '' END || repeat('x', (n % 50 % 40) // 10)
  || CASE WHEN n % 10 = 9 THEN 'ix' WHEN n % 10 >= 5 THEN 'v' || repeat('i', n % 5) WHEN n % 10 = 4 THEN 'iv' ELSE repeat('i', n % 10) END AS roman,
  n BETWEEN 1 AND 12 AS learner_roman
FROM (SELECT CAST(i % 90 AS INTEGER) AS n FROM f_lines)""")
def int_to_roman(spark, sf_dir):
    n = F.col("n")
    return (fx.lines(spark, sf_dir).select((F.col("i") % 90).alias("n")).distinct()
            .select("n", numerals.roman_text(n).alias("roman"),
                    (numerals.number_type(numerals.roman_text(n), 12) == "roman").alias("learner_roman")))


@q("headings", "f_text", r"""
SELECT book_id, scan_index, CAST(line_no AS INTEGER) AS line_no, rule, heading,
       CASE WHEN rule = 'structure' THEN 'section_header' WHEN contains(lower(heading), 'chapter') THEN 'chapter' WHEN contains(lower(heading), 'section') THEN 'section'
            WHEN contains(lower(heading), 'part') THEN 'part' WHEN contains(lower(heading), 'appendix') THEN 'appendix'
            WHEN regexp_matches(heading, '^[0-9]+\.') THEN 'numbered_section' WHEN regexp_matches(heading, '^[IVX]+\.') THEN 'roman_section' ELSE 'generic' END AS heading_type
FROM (SELECT book_id, scan_index, k - 1 AS line_no, trim(l, ' ' || chr(9) || chr(13) || chr(12)) AS heading, unnest(['pattern', 'structure']) AS rule
      FROM (SELECT book_id, scan_index, unnest(string_split(full_text, chr(10))) AS l, generate_subscripts(string_split(full_text, chr(10)), 1) AS k FROM f_text))
WHERE heading <> '' AND CASE rule
  WHEN 'pattern' THEN regexp_matches(heading, '(?i)^(?:(?:chapter|section|part|appendix)\s+[0-9]+|[0-9]+\.\s+[A-Z][a-z]+|[A-Z][A-Z\s]+$|[0-9]+\.[0-9]+\s+[A-Z][a-z]+|[IVX]+\.\s+[A-Z][a-z]+)')
  ELSE (regexp_matches(heading, '\p{Lu}') AND NOT regexp_matches(heading, '\p{Ll}') AND len(regexp_extract_all(heading, '\S+')) <= 6 AND length(heading) <= 50)
       OR (ends_with(heading, ':') AND len(regexp_extract_all(heading, '\S+')) <= 4) END""")
def headings(spark, sf_dir):
    return t.headings(fx.f_text(spark, sf_dir)).drop("heading_number")


@q("heading_numbers", "f_text", r"""
SELECT book_id, scan_index, CAST(line_no AS INTEGER) AS line_no, heading_number FROM (
  SELECT book_id, scan_index, unnest(range(len(ls))) AS line_no, unnest(ls) AS l, try_cast(regexp_extract(unnest(ls), '[0-9]+') AS INTEGER) AS heading_number
  FROM (SELECT book_id, scan_index, string_split(full_text, chr(10)) AS ls FROM f_text))
WHERE regexp_matches(l, '(?i)^chapter\s+[0-9]+')""")
def heading_numbers(spark, sf_dir):
    found = t.headings(fx.f_text(spark, sf_dir)).where("rule = 'pattern' AND heading_type = 'chapter'")
    return found.where(F.col("heading").rlike(r"(?i)^chapter\s+[0-9]+")).select(
        "book_id", "scan_index", "line_no", "heading_number")


@q("references", "f_text", r"""
SELECT book_id, scan_index, pattern_no, reference,
       CASE WHEN contains(lower(reference), 'page') OR contains(lower(reference), 'p.') THEN 'page_reference' WHEN contains(lower(reference), 'fig') THEN 'figure_reference'
            WHEN contains(lower(reference), 'table') THEN 'table_reference' WHEN regexp_matches(lower(reference), 'above|below|previous|next') THEN 'positional_reference'
            ELSE 'generic_reference' END AS reference_type,
       try_cast(regexp_extract(reference, '[0-9]+') AS INTEGER) AS referenced_number
FROM (SELECT book_id, scan_index, 0 AS pattern_no, unnest(regexp_extract_all(full_text, '(?i)see\s+(?:page|p\.?|figure|fig\.?|table)\s+[0-9]+')) AS reference FROM f_text
  UNION ALL SELECT book_id, scan_index, 1, unnest(regexp_extract_all(full_text, '(?i)(?:page|p\.?)\s+[0-9]+')) FROM f_text
  UNION ALL SELECT book_id, scan_index, 2, unnest(regexp_extract_all(full_text, '(?i)(?:figure|fig\.?|table)\s+[0-9]+')) FROM f_text
  UNION ALL SELECT book_id, scan_index, 3, unnest(regexp_extract_all(full_text, '(?i)as\s+(?:discussed|mentioned|shown)\s+(?:above|below|earlier|later)')) FROM f_text
  UNION ALL SELECT book_id, scan_index, 4, unnest(regexp_extract_all(full_text, '(?i)(?:above|below|previous|next|following)\s+(?:section|chapter|page)')) FROM f_text)""")
def references(spark, sf_dir):
    return t.references(fx.f_text(spark, sf_dir)).drop("ord")


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in t.STOP_WORDS) + "]"
add_view("f_words", f"""
  SELECT book_id, scan_index, list_filter(list_transform(list_filter(regexp_split_to_array(lower(full_text), '[ \\t\\n\\r\\f]+'), lambda w: w <> ''),
     lambda w: trim(w, '.,!?;:"()[]')), lambda w: NOT list_contains({STOP_SQL}, w)) AS ws FROM f_text""", ["f_text"])


@q("boundary_words", "f_words", """
SELECT book_id, scan_index, array_to_string(ws[:10], ' ') AS first_words, array_to_string(ws[greatest(len(ws) - 9, 1):], ' ') AS last_words FROM f_words""")
def boundary_words(spark, sf_dir):
    return t.boundary_words(fx.f_text(spark, sf_dir)).select(
        "book_id", "scan_index", F.array_join("first_words", " ").alias("first_words"),
        F.array_join("last_words", " ").alias("last_words"))


add_view("f_shape", r"""
  SELECT *, len(regexp_extract_all(full_text, '\S+')) AS n_words,
         len(list_filter(regexp_split_to_array(full_text, '[.!?]+'), lambda s: regexp_matches(s, '\S'))) AS n_sent FROM f_text""", ["f_text"])


@q("text_shape", "f_shape", r"""
SELECT book_id, scan_index, n_words AS word_count, n_sent AS sentence_count,
       len(list_filter(string_split(full_text, chr(10) || chr(10)), lambda s: regexp_matches(s, '\S'))) AS paragraph_count, CAST(n_words AS DOUBLE) AS text_density FROM f_shape""")
def text_shape(spark, sf_dir):
    return t.text_shape(fx.f_text(spark, sf_dir))


@q("language_features", "f_shape", r"""
SELECT book_id, scan_index, round(list_avg(list_transform(regexp_extract_all(full_text, '\S+'), lambda w: length(w))), 6) AS mean_word_length,
       n_sent AS sentence_count, round(n_words / n_sent, 6) AS mean_sentence_length,
       regexp_matches(full_text, '(?:^|[^\p{L}\p{N}_])[A-Z]{2,}(?:$|[^\p{L}\p{N}_])') AS has_capitals, regexp_matches(full_text, '[0-9]') AS has_digits FROM f_shape""")
def language_features(spark, sf_dir):
    return t.language_features(fx.f_text(spark, sf_dir)).withColumns({
        name: F.round(name, 6) for name in ("mean_word_length", "mean_sentence_length")})


@q("page_features", "f_shape", r"""
SELECT book_id, scan_index, n_words AS word_count, n_sent AS sentence_count,
       len(regexp_extract_all(full_text, '(?i)see\s+(?:page|p\.?|figure|fig\.?|table)\s+[0-9]+')) + len(regexp_extract_all(full_text, '(?i)(?:page|p\.?)\s+[0-9]+'))
       + len(regexp_extract_all(full_text, '(?i)(?:figure|fig\.?|table)\s+[0-9]+')) + len(regexp_extract_all(full_text, '(?i)as\s+(?:discussed|mentioned|shown)\s+(?:above|below|earlier|later)'))
       + len(regexp_extract_all(full_text, '(?i)(?:above|below|previous|next|following)\s+(?:section|chapter|page)')) AS refs FROM f_shape""")
def page_features(spark, sf_dir):
    return t.page_features(fx.f_text(spark, sf_dir)).select(
        "book_id", "scan_index", "word_count", "sentence_count", F.col("references").alias("refs"))
