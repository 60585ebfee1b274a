"""Column expressions over strings: metrics, coordinates and spellings.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BASE, _MARK = r"\p{L}\p{N}\p{Pc}", r"\p{M}"
#: Possessive, because a plain repetition of groups recurses once for each character.
WORD = rf"[{_BASE}][{_BASE}{_MARK}]*+(?:['’][{_BASE}][{_BASE}{_MARK}]*+)*+"
#: Findings that are returned at most; totals stay exact.
DETAIL_LIMIT = 500


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def code_points(text: Column) -> Column:
    return F.char_length(text).cast("long")


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def _occurrences(text: Column, part: str) -> Column:
    """How often part stands in text, by what is left without it: plain replacement is much faster than a regular expression."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def line_count(text: Column) -> Column:
    return (_occurrences(text, "\n") + _occurrences(text, "\r") - _occurrences(text, "\r\n") + 1).cast("long")


def word_count(text: Column) -> Column:
    return count_of(text, WORD)


def metrics(text: Column) -> Column:
    return F.struct(utf8_bytes(text).alias("bytes"), utf16_units(text).alias("utf16_code_units"), code_points(text).alias("unicode_scalars"), line_count(text).alias("lines"))


def format_code_point(char: Column) -> Column:
    """U+ and at least four hex digits."""
    digits = F.hex(F.ascii(char))
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def escape_code_point(char: Column) -> Column:
    """Backslash spelling with braces above U+FFFF, and letters for tab, line feed and carriage return."""
    digits = F.hex(F.ascii(char))
    return (
        F.when(char == "\t", F.lit(r"\t")).when(char == "\n", F.lit(r"\n")).when(char == "\r", F.lit(r"\r"))
        .when(F.ascii(char) > 0xFFFF, F.concat(F.lit(r"\u{"), digits, F.lit("}"))).otherwise(F.concat(F.lit(r"\u"), F.lpad(digits, 4, "0")))
    )


def review_escape(char: Column) -> Column:
    """The spelling of the reviews: four digits, or a capital U and eight, and no letters for tab and line ends."""
    digits = F.hex(F.ascii(char))
    return F.when(F.ascii(char) > 0xFFFF, F.concat(F.lit(r"\U"), F.lpad(digits, 8, "0"))).otherwise(F.concat(F.lit(r"\u"), F.lpad(digits, 4, "0")))


def has_surrogate(data: Column) -> Column:
    """Whether bytes that should be UTF-8 spell a surrogate."""
    return F.decode(data, "ISO-8859-1").rlike(r"\xED[\xA0-\xBF][\x80-\xBF]")


def utf8_hex(text: Column) -> Column:
    """Upper-case bytes with spaces between."""
    return F.trim(F.regexp_replace(F.hex(F.encode(text, "UTF-8")), "(..)", "$1 "))


TOTAL_COLUMNS = "total long, bytes long, utf16_code_units long, unicode_scalars long, lines long"


def with_status(found: DataFrame, key: str) -> DataFrame:
    """Rows with a total also get a status, returned and truncated."""
    total, limit = F.col("total"), F.lit(DETAIL_LIMIT).cast("long")
    status = F.when(total > 0, "issues_found").otherwise("clean").alias("status")
    return found.select(F.col(key), status, *found.columns[1:], F.least(total, limit).alias("returned"), (total > limit).alias("truncated"))
