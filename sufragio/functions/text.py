"""Text normalisation as Column builders: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and the letters they are folded to.
ACCENTED = "ÁÀÂÃÄÅÇÉÈÊËÍÌÎÏÑÓÒÔÕÖÚÙÛÜÝáàâãäåçéèêëíìîïñóòôõöúùûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
#: Blanks at either end, as Python's strip has them, with no-break blanks and marks without width.
BLANKS = " \t\n\x0b\f\r\u00a0\u2060\ufeff" + "".join(map(chr, range(0x2000, 0x200E)))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without outer white space of any kind; a native trim, as a pattern costs many times more."""
    return F.trim(col(c), F.lit(BLANKS))


def text(c: Column | str) -> Column:
    """Trimmed text, null as ''."""
    return F.coalesce(strip(col(c).cast("string")), F.lit(""))


def nullable(c: Column | str) -> Column:
    """Trimmed text, blank as null."""
    return F.nullif(strip(col(c).cast("string")), F.lit(""))


def or_na(c: Column | str) -> Column:
    """Trimmed text, blank and null as 'N/A'."""
    return F.coalesce(nullable(c), F.lit("N/A"))


def fold(c: Column | str) -> Column:
    """Without accents and other characters outside ASCII, outer blanks removed."""
    x = text(c)
    plain = F.translate(x, ACCENTED, PLAIN)
    ascii_only = F.octet_length(x) == F.length(x)  # most values: nothing to translate
    return F.when(ascii_only, x).otherwise(F.trim(F.regexp_replace(plain, "[^\\x00-\\x7F]", "")))


def fold_upper(c: Column | str) -> Column:
    """fold() in capitals with single blanks: the key by which names are compared."""
    return F.trim(F.upper(F.regexp_replace(fold(c), "\\s+", " ")))


def digits(c: Column | str) -> Column:
    return F.regexp_replace(text(c), "[^0-9]", "")


def number(c: Column | str) -> Column:
    """Number or null; text that is no number is null."""
    return strip(col(c).cast("string")).try_cast("double")


def whole(c: Column | str) -> Column:
    """Whole number of a text, exact at any size where it is written as one; a fraction is cut off."""
    x = strip(col(c).cast("string"))
    return F.when(x.rlike("^[+-]?[0-9]{1,38}\\z"), x.try_cast("decimal(38,0)")).otherwise(x.try_cast("double").try_cast("bigint").cast("decimal(38,0)"))


def number0(c: Column | str) -> Column:
    return F.coalesce(number(c), F.lit(0.0))
