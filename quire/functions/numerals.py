"""Roman and arabic numerals as column expressions (JVM side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Roman digits, large to small.
ROMAN_DIGITS = [("m", 1000), ("d", 500), ("c", 100), ("l", 50), ("x", 10), ("v", 5), ("i", 1)]
# The pieces of a written roman numeral below 90.
ROMAN_PIECES = [(50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]

# A whole word that is a strict numeral; the look-ahead keeps it from being empty.
STRICT_ROMAN_WORD = (r"(?i)(?<![\p{L}\p{N}_])(?=[ivxlcdm])m{0,4}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"
                     r"(?![\p{L}\p{N}_])")


def roman_value(text: Column) -> Column:
    """Subtractive value of a roman word, malformed ones too; null for other letters or a total below 1.

    A digit counts negative when a larger one follows it, so the total is the sum of
    all digits minus twice the sum of the digits standing before a larger one.
    """
    word = F.lower(text)
    total = F.lit(0)
    larger = ""
    for digit, value in ROMAN_DIGITS:
        total = total + value * (F.length(word) - F.length(F.replace(word, F.lit(digit), F.lit(""))))
        if larger:
            total = total - 2 * value * F.regexp_count(word, F.lit(f"{digit}(?=[{larger}])"))
        larger += digit
    return F.when(word.rlike("^[ivxlcdm]+$") & (total > 0), total).cast("int")


def written_roman(number: int) -> str:
    """Lower-case roman numeral of a plain Python integer, digits up to l."""
    out = ""
    for value, piece in ROMAN_PIECES:
        out += piece * (number // value)
        number %= value
    return out


def roman_text(number: Column) -> Column:
    """Lower-case roman numeral with digits up to l; empty for numbers below 1."""
    n = F.greatest(number, F.lit(0)).cast("int")
    ones = F.array(*[F.lit(written_roman(k)) for k in range(10)])
    below_fifty = F.pmod(n, F.lit(50))
    return F.concat(
        F.repeat(F.lit("l"), F.floor(n / 50).cast("int")),
        F.when(below_fifty >= 40, "xl").otherwise(""),
        F.repeat(F.lit("x"), F.floor(F.pmod(below_fifty, F.lit(40)) / 10).cast("int")),
        F.get(ones, F.pmod(n, F.lit(10))))


def is_loose_roman(text: Column) -> Column:
    return F.lower(text).rlike("^[ivxlcdm]+$")


def number_type(text: Column, upper: int) -> Column:
    """'roman' for the written numerals 1..``upper``, else 'arabic'."""
    known = [written_roman(k) for k in range(1, upper + 1)]
    return F.when(F.lower(text).isin(known), "roman").otherwise("arabic")


def one_decimal(value: Column) -> Column:
    """A number of at least 0 with one decimal: its exact binary value rounded, exact ties to the even digit.

    ``format_string`` rounds the shortest decimal form instead, ties up: 30.25 would become 30.3.
    """
    x = value.cast("double")
    low = F.floor(x * 10)
    # 20 x against 2 low + 1: the head of x and its rest are multiplied apart, so nothing is rounded
    head = F.floor(x * (1 << 20)) / F.lit(float(1 << 20))
    over = (20 * head - (2 * low + 1)) + 20 * (x - head)
    tenths = low + ((over > 0) | ((over == 0) & (low % 2 == 1))).cast("long")
    return F.format_string("%d.%d", F.floor(tenths / 10), tenths % 10)
