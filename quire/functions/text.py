"""Numbers, headings, references and word facts from page text.

Classes are spelt out (``[0-9]``, ``[A-Za-z]``) so that case and digit rules mean
the same on every engine. All of it stays in JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.numerals import STRICT_ROMAN_WORD, roman_value
from quire.schemas import STOP_WORDS

# Declared number forms and the type each one gives.
EXTRA_FORMS = {
    "thousands": (r"(?<![\p{L}\p{N}_])([0-9]{1,3}(?:[,.][0-9]{3})*)(?![\p{L}\p{N}_])", "arabic"),
    "decimal": (r"(?<![\p{L}\p{N}_])([0-9]+\.[0-9]+)(?![\p{L}\p{N}_])", "arabic"),
    "chapter_page": (r"(?i)(?<![\p{L}\p{N}_])((?:Chapter|Ch\.?)\s*[0-9]+[,\s]+(?:Page|p\.?)\s*[0-9]+)(?![\p{L}\p{N}_])", "hybrid"),
    "section": (r"(?<![\p{L}\p{N}_])([0-9]+\.[0-9]+)(?![\p{L}\p{N}_])", "hierarchical"),
}

# Heading patterns, tried in this order at the start of a line.
HEADING_PATTERNS = [
    r"(?:chapter|section|part|appendix)\s+[0-9]+",
    r"[0-9]+\.\s+[A-Z][a-z]+",
    r"[A-Z][A-Z\s]+$",
    r"[0-9]+\.[0-9]+\s+[A-Z][a-z]+",
    r"[IVX]+\.\s+[A-Z][a-z]+",
]

# Reference patterns; each of them reports all its matches.
REFERENCE_PATTERNS = [
    r"see\s+(?:page|p\.?|figure|fig\.?|table)\s+[0-9]+",
    r"(?:page|p\.?)\s+[0-9]+",
    r"(?:figure|fig\.?|table)\s+[0-9]+",
    r"as\s+(?:discussed|mentioned|shown)\s+(?:above|below|earlier|later)",
    r"(?:above|below|previous|next|following)\s+(?:section|chapter|page)",
]

WORD_EDGE = '.,!?;:"()[]'


#: Digit strings above this count as this: far above any page, and sums of a few still fit 64 bits.
LARGEST_NUMBER = 10**18


def whole_number(text: Column) -> Column:
    """Value of a digit string as a long, ``LARGEST_NUMBER`` for longer ones; null without digits only."""
    own = F.coalesce(text.try_cast("long"), F.when(text.rlike("^[0-9]+$"), LARGEST_NUMBER))
    return F.least(own, F.lit(LARGEST_NUMBER))


DIGITS_WORD = r"(?<![\p{L}\p{N}_])([0-9]+)(?![\p{L}\p{N}_])"


def arabic_matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DIGITS_WORD), F.lit(1))


def roman_matches(text: Column) -> Column:
    """Whole words that are strict roman numerals, each once per occurrence."""
    return F.regexp_extract_all(text, F.lit(STRICT_ROMAN_WORD), F.lit(0))


def text_numbers(pages: DataFrame, text: str = "full_text") -> DataFrame:
    """All numbers of a page in list order: arabic (80), then roman (75)."""
    arabic = F.transform(arabic_matches(F.col(text)), lambda m: F.struct(
        m.alias("text"), F.lit("arabic").alias("number_type"), F.lit(80.0).alias("confidence")))
    roman = F.transform(roman_matches(F.col(text)), lambda m: F.struct(
        m.alias("text"), F.lit("roman").alias("number_type"), F.lit(75.0).alias("confidence")))
    rows = pages.select("book_id", "scan_index", F.posexplode(F.concat(arabic, roman)).alias("ord", "_n"))
    value = F.when(F.col("_n.number_type") == "roman", roman_value(F.col("_n.text"))).otherwise(
        whole_number(F.col("_n.text")))
    return rows.select("book_id", "scan_index", "ord", "_n.text", "_n.number_type",
                       value.alias("numeric_value"), "_n.confidence")


def extra_numbers(pages: DataFrame, form: str, text: str = "full_text") -> DataFrame:
    """Numbers of one declared form: thousands, decimal, chapter_page or section."""
    pattern, kind = EXTRA_FORMS[form]
    rows = pages.select("book_id", "scan_index", F.posexplode(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("ord", "text"))
    digits = {"thousands": F.regexp_replace("text", "[,.]", ""),
              "chapter_page": F.regexp_extract("text", r"([0-9]+)$", 1)}.get(
                  form, F.regexp_extract("text", "^([0-9]+)", 1))
    return rows.select("book_id", "scan_index", "ord", "text", F.lit(kind).alias("number_type"),
                       whole_number(digits).alias("numeric_value"))


def context_window(text: Column, position: Column, length: Column, reach: int = 20) -> Column:
    """Text around a match (``position`` is 1-based), ``reach`` characters each side, stripped."""
    start = F.greatest(position - reach, F.lit(1))
    return F.trim(F.substring(text, start, position - start + length + reach))


def located_numbers(pages: DataFrame, text: str = "full_text", reach: int = 20) -> DataFrame:
    """Each number of :func:`text_numbers` with its 1-based ``start``, ``length`` and the text around it.

    ``ord`` counts within the number's type. ``context`` is the number with up to ``reach`` characters
    each side, white space at its ends taken off. Matches come without places, so the text is cut at
    them: a place is the running length of what stands before, and the text around a number lies in
    the ends of at most ``reach`` neighbouring cuts. Text is cut once and never copied per number.
    One row per page is assumed; a null or empty text has no numbers.
    """
    kinds = {"arabic": (DIGITS_WORD, arabic_matches), "roman": (STRICT_ROMAN_WORD, roman_matches)}
    whole = None
    for kind, (pattern, matches) in kinds.items():
        cut = pages.select("book_id", "scan_index", F.lit(kind).alias("number_type"),
                           F.split(text, pattern, -1).alias("gap"), matches(F.col(text)).alias("text"))
        # the last cut has no number behind it
        rows = cut.where(F.size("text") > 0).select(
            "book_id", "scan_index", "number_type", F.posexplode(F.arrays_zip("gap", "text")).alias("ord", "_c"))
        rows = rows.select("book_id", "scan_index", "number_type", "ord", F.col("_c.text").alias("text"),
                           F.length("_c.gap").alias("_gap"), F.left("_c.gap", F.lit(reach)).alias("_head"),
                           F.right("_c.gap", F.lit(reach)).alias("_tail"))
        whole = rows if whole is None else whole.unionByName(rows)
    # the shuffle that the windows need, by page even if the pages come dealt by book
    whole = whole.repartition("book_id", "scan_index")
    page = Window.partitionBy("book_id", "scan_index", "number_type").orderBy("ord")
    number = F.coalesce("text", F.lit(""))
    before = F.array_join(F.collect_list(F.concat("_tail", number)).over(page.rowsBetween(-reach, -1)), "")
    after = F.array_join(F.collect_list(F.concat("_head", number)).over(page.rowsBetween(1, reach + 1)), "")
    so_far = F.sum(F.col("_gap") + F.length(number)).over(page.rowsBetween(Window.unboundedPreceding, 0))
    found = whole.withColumns({"_so_far": so_far, "_before": before, "_after": after}).where(F.col("text").isNotNull())
    around = F.concat(F.right(F.concat("_before", "_tail"), F.lit(reach)), "text", F.left("_after", F.lit(reach)))
    return found.select(
        "book_id", "scan_index", "number_type", "ord", "text", (F.col("_so_far") - F.length("text") + 1).alias("start"),
        F.length("text").cast("long").alias("length"), F.btrim(around, F.lit(" \t\n\r\f\v")).alias("context"))


def name_numbers(pages: DataFrame) -> DataFrame:
    """Every digit run of the file name, confidence 70."""
    rows = pages.select("book_id", "scan_index", F.posexplode(
        F.regexp_extract_all("original_name", F.lit("([0-9]+)"), F.lit(1))).alias("ord", "text"))
    return rows.select("book_id", "scan_index", "ord", "text", F.lit("arabic").alias("number_type"),
                       F.col("text").try_cast("long").alias("numeric_value"), F.lit(70.0).alias("confidence"))


def short_numbers(pages: DataFrame, text: str = "full_text") -> DataFrame:
    """Text-only detection: 1-3 digits 1..500 (70) and lower-case roman words 1..50 (75)."""
    arabic = F.regexp_extract_all(
        text, F.lit(r"(?<![\p{L}\p{N}_])([0-9]{1,3})(?![\p{L}\p{N}_])"), F.lit(1))
    roman = F.regexp_extract_all(
        F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])([ivxlcdm]{1,10})(?![\p{L}\p{N}_])"), F.lit(1))
    both = F.concat(
        F.transform(arabic, lambda m: F.struct(m.alias("text"), F.lit("arabic").alias("kind"))),
        F.transform(roman, lambda m: F.struct(m.alias("text"), F.lit("roman").alias("kind"))))
    rows = pages.select("book_id", "scan_index", F.posexplode(both).alias("ord", "_n"))
    value = F.when(F.col("_n.kind") == "roman", roman_value(F.col("_n.text"))).otherwise(F.col("_n.text").try_cast("int"))
    return (rows.select("book_id", "scan_index", "ord", "_n.text", F.col("_n.kind").alias("number_type"),
                        value.alias("numeric_value"),
                        F.when(F.col("_n.kind") == "roman", 75.0).otherwise(70.0).alias("confidence"))
            .where(F.col("numeric_value").between(1, F.when(F.col("number_type") == "roman", 50).otherwise(500))))


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" \t\r\f")))


def heading_class(heading: Column) -> Column:
    low = F.lower(heading)
    expr = F.when(low.contains("chapter"), "chapter")
    for word in ("section", "part", "appendix"):
        expr = expr.when(low.contains(word), word)
    return (expr.when(heading.rlike(r"^[0-9]+\."), "numbered_section")
            .when(heading.rlike(r"^[IVX]+\."), "roman_section").otherwise("generic"))


def heading_number(heading: Column) -> Column:
    """First digits, else the first roman word."""
    digits = F.regexp_extract(heading, "([0-9]+)", 1)
    roman = F.regexp_extract(heading, r"(?<![\p{L}\p{N}_])([IVXLCDMivxlcdm]+)(?![\p{L}\p{N}_])", 1)
    return F.when(digits != "", whole_number(digits)).otherwise(F.when(roman != "", roman_value(roman)))


def _by_pattern(line: Column) -> Column:
    found = F.lit(False)
    for pattern in HEADING_PATTERNS:
        found = found | line.rlike(f"(?i)^{pattern}")
    return found


def _by_structure(line: Column) -> Column:
    words = F.regexp_count(line, F.lit(r"\S+"))
    capitals = line.rlike(r"\p{Lu}") & ~line.rlike(r"\p{Ll}")
    return ((capitals & (words <= 6) & (F.length(line) <= 50)) | (line.endswith(":") & (words <= 4)))


def heading_lines(text: Column) -> Column:
    """The lines of ``text`` that :func:`headings` finds, which it finds in them alone too: a small text to move."""
    return F.array_join(F.filter(_lines(text), lambda line: (line != "") & (_by_pattern(line) | _by_structure(line))), "\n")


def headings(pages: DataFrame, text: str = "full_text") -> DataFrame:
    """Heading lines. A line may give two rows: one by pattern, one by structure."""
    rows = pages.select("book_id", "scan_index", F.posexplode(_lines(F.col(text))).alias("line_no", "heading"))
    line = F.col("heading")
    by_pattern, by_structure = _by_pattern(line), _by_structure(line)
    found = F.array_compact(F.array(F.when(by_pattern, "pattern"), F.when(by_structure, "structure")))
    return (rows.where(line != "").withColumn("rule", F.explode(found))
            .select("book_id", "scan_index", "line_no", "rule", "heading",
                    F.when(F.col("rule") == "structure", "section_header")
                    .otherwise(heading_class(line)).alias("heading_type"), heading_number(line).alias("heading_number")))


def reference_class(reference: Column) -> Column:
    low = F.lower(reference)
    return (F.when(low.contains("page") | low.contains("p."), "page_reference")
            .when(low.contains("fig"), "figure_reference")
            .when(low.contains("table"), "table_reference")
            .when(low.rlike("above|below|previous|next"), "positional_reference").otherwise("generic_reference"))


def references(pages: DataFrame, text: str = "full_text") -> DataFrame:
    """All matches of each reference pattern with the number they name."""
    def matches(number: int, pattern: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(f"(?i)({pattern})"), F.lit(1))
        return F.transform(found, lambda m: F.struct(F.lit(number).alias("pattern_no"), m.alias("reference")))

    found = F.flatten(F.array(*[matches(k, p) for k, p in enumerate(REFERENCE_PATTERNS)]))
    rows = pages.select("book_id", "scan_index", F.posexplode(found).alias("ord", "_r"))
    return rows.select(
        "book_id", "scan_index", "ord", "_r.pattern_no", "_r.reference",
        reference_class(F.col("_r.reference")).alias("reference_type"),
        whole_number(F.regexp_extract("_r.reference", "([0-9]+)", 1)).alias("referenced_number"))


def numbered_citations(text: Column) -> Column:
    """The parts of ``text`` in which :func:`references` finds numbers, each number as in ``text``: a small text to move.

    The first pattern's numbers are among those of the next two, which start with a letter and end with
    their digits, so nothing is found across the bars.
    """
    found = [F.regexp_extract_all(text, F.lit(f"(?i)({p})"), F.lit(1)) for p in REFERENCE_PATTERNS[1:3]]
    return F.array_join(F.concat(*found), "\n|\n")


def words(text: Column) -> Column:
    """Whitespace separated words; empty array for blank text."""
    return F.array_remove(F.split(text, r"[ \t\n\r\f]+"), "")


def meaningful_words(text: Column) -> Column:
    """Lower-cased words without edge punctuation and stop words; pure punctuation stays as an empty word."""
    bare = F.transform(words(F.lower(text)), lambda w: F.btrim(w, F.lit(WORD_EDGE)))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(bare, lambda w: ~F.array_contains(stop, w))


def boundary_words(pages: DataFrame, text: str = "full_text", keep: int = 10) -> DataFrame:
    """First and last ``keep`` meaningful words of each page."""
    rows = pages.select("book_id", "scan_index", meaningful_words(F.col(text)).alias("_w"))
    return rows.select(
        "book_id", "scan_index", F.slice("_w", 1, keep).alias("first_words"),
        F.reverse(F.slice(F.reverse("_w"), 1, keep)).alias("last_words"))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]+"), lambda s: F.btrim(s, F.lit(" \t\n\r\f"))), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n\n"), lambda p: F.btrim(p, F.lit(" \t\n\r\f")) != ""))


def text_shape(pages: DataFrame, blocks: str | None = None, text: str = "full_text") -> DataFrame:
    """Words, sentences, paragraphs and density (words per text block)."""
    count = F.regexp_count(text, F.lit(r"\S+"))
    density = count / F.col(blocks) if blocks else count.cast("double")
    return pages.select("book_id", "scan_index", count.alias("word_count"),
                        F.size(sentences(F.col(text))).alias("sentence_count"),
                        paragraphs(F.col(text)).alias("paragraph_count"),
                        density.alias("text_density"))


def language_features(pages: DataFrame, text: str = "full_text") -> DataFrame:
    """Mean word length, sentences, mean words per sentence, capitals and digits."""
    body = F.col(text)
    count = F.regexp_count(body, F.lit(r"\S+"))
    letters = F.length(F.regexp_replace(body, r"[ \t\n\r\f]+", ""))
    n_sentences = F.size(sentences(body))
    return pages.select(
        "book_id", "scan_index",
        F.when(count > 0, letters / count).otherwise(0.0).alias("mean_word_length"),
        n_sentences.alias("sentence_count"),
        F.when(n_sentences > 0, count / n_sentences).otherwise(0.0).alias("mean_sentence_length"),
        body.rlike(r"(?<![\p{L}\p{N}_])[A-Z]{2,}(?![\p{L}\p{N}_])").alias("has_capitals"),
        body.rlike("[0-9]").alias("has_digits"))


def page_features(pages: DataFrame, text: str = "full_text") -> DataFrame:
    """One row per page with all features; headings and references stay arrays of that page only."""
    count = F.regexp_count(text, F.lit(r"\S+"))
    heads = headings(pages, text).groupBy("book_id", "scan_index").agg(F.count("*").alias("headings"))
    refs = references(pages, text).groupBy("book_id", "scan_index").agg(F.count("*").alias("references"))
    shape = text_shape(pages, None, text).drop("text_density", "word_count")
    language = language_features(pages, text).drop("sentence_count")
    key = ["book_id", "scan_index"]
    return (pages.select(*key, count.alias("word_count")).join(heads, key, "left").join(refs, key, "left")
            .join(shape, key).join(language, key)
            .fillna(0, ["headings", "references"]))
