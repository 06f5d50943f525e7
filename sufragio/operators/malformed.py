"""Separate the lines of delimited text that do not parse, each with its first reason.

Structure (quoting, number of fields) is judged line by line with possessive patterns, which
never backtrack, so very long lines cost linear time and no stack. Values are judged once per
distinct value: the distinct values of each checked column are cast, the unusable ones kept
with their reason as a dictionary, and the dictionary is joined back. It is broadcast only if
its measured size allows; else the join is salted, as one bad value may stand in very many lines.

Defined cases: a null line has no fields ('column_count'); an empty line has one empty field;
repeated lines are judged each; an empty table gives two empty tables; a checked value that is
null, which cannot come from a line, is unusable; other columns pass through, a column
named as the reason is replaced, and what the operator adds besides starts with '__'.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sufragio.session import materialize, measured

SALTS = 16


def _field(delimiter: str, quote: str) -> str:
    d, q = re.escape(delimiter), re.escape(quote)
    return f"(?:{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q}|[^{q}{d}]*+)"


def well_quoted(line: Column, delimiter: str = ";", quote: str = '"') -> Column:
    """True if each field is free of quotes or wholly enclosed with inner quotes doubled."""
    f, d = _field(delimiter, quote), re.escape(delimiter)
    return ~F.contains(line, F.lit(quote)) | line.rlike(f"^{f}(?:{d}{f})*+\\z")


def raw_fields(line: Column, delimiter: str = ";", quote: str = '"') -> Column:
    """Fields of a well quoted line, quotes kept."""
    f, d = _field(delimiter, quote), re.escape(delimiter)
    quoted = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(f"{d}({f})"), F.lit(1))
    return F.when(F.contains(line, F.lit(quote)), quoted).otherwise(F.split(line, d, -1))


def unquoted(field: Column, quote: str = '"') -> Column:
    inner = F.replace(field.substr(F.lit(2), F.length(field) - 2), F.lit(quote * 2), F.lit(quote))
    return F.when(F.startswith(field, F.lit(quote)), inner).otherwise(field)


def _judged(df: DataFrame, line: str, width: int, delimiter: str, quote: str) -> DataFrame:
    body = F.regexp_replace(F.col(f"`{line}`"), "\\r\\z", "")
    return (
        df.withColumn("__line", body)
        .withColumn("__well", F.coalesce(well_quoted(F.col("__line"), delimiter, quote), F.lit(True)))
        .withColumn("__raw", F.when(F.col("__well"), raw_fields(F.col("__line"), delimiter, quote)))
        .withColumn(
            "__structure",
            F.when(~F.col("__well"), "quoting").when(F.coalesce(F.size("__raw"), F.lit(0)) != width, "column_count"),
        )
    )


def separate(
    df: DataFrame,
    line: str,
    fields: Sequence[str],
    checks: Mapping[str, str],
    reason: str = "motivo",
    delimiter: str = ";",
    quote: str = '"',
    bad_value: str = "invalid_value",
) -> DataFrame:
    """df with `reason` (null for valid lines) and __raw, the fields of well built lines.

    fields: the names in order; checks: for a field, the pattern its value must match as a
    whole, once unquoted and without outer blanks.
    """
    judged = _judged(df, line, len(fields), delimiter, quote)
    place = {f: i + 1 for i, f in enumerate(fields)}
    value = lambda f: F.trim(unquoted(F.element_at("__raw", place[f]), quote))
    good = F.col("__structure").isNull()
    if not checks:
        return judged.withColumn(reason, F.col("__structure")).drop("__line", "__well", "__structure")
    entries = F.array(*[F.struct(F.lit(f).alias("__f"), value(f).alias("__v")) for f in checks])
    each = judged.filter(good).select(F.explode(entries).alias("e")).select("e.*").groupBy("__f", "__v").agg(F.lit(1).alias("one"))
    usable = F.lit(False)
    for f, pattern in checks.items():
        usable = usable | ((F.col("__f") == f) & F.col("__v").rlike(f"^(?:{pattern})\\z"))
    bad = each.filter(~F.coalesce(usable, F.lit(False))).select("__f", "__v", F.lit(bad_value).alias("__bad"))
    bad, small = measured(materialize(bad, "invalid-values"))
    out = judged.withColumn("__salt", F.pmod(F.xxhash64("__line"), F.lit(SALTS)) if not small else F.lit(0))
    for k, f in enumerate(checks):
        own = bad.filter(F.col("__f") == f).select(F.col("__v").alias(f"__v{k}"), F.col("__bad").alias(f"__bad{k}"))
        out = out.withColumn(f"__v{k}", F.when(good, value(f)))
        if small:
            out = out.join(F.broadcast(own), f"__v{k}", "left")
        else:
            own = own.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
            out = out.join(own, [f"__v{k}", "__salt"], "left")
    found = F.coalesce("__structure", *[f"__bad{k}" for k in range(len(checks))])
    return out.withColumn(reason, found).select(*[F.col(f"`{c}`") for c in df.columns if c != reason], reason, "__raw")


def failing(df: DataFrame, reason: str = "motivo") -> DataFrame:
    return df.filter(F.col(reason).isNotNull()).drop("__raw")


def typed(df: DataFrame, fields: Sequence[str], types: Mapping[str, str], keep: Sequence[str], reason: str = "motivo", quote: str = '"') -> DataFrame:
    """The valid lines as a table: fields unquoted and trimmed, cast where types names a type
    (null where an unchecked field does not fit it)."""
    cols = []
    for i, f in enumerate(fields):
        v = F.trim(unquoted(F.element_at("__raw", i + 1), quote))
        cols.append((v.try_cast(types[f]) if f in types else v).alias(f))
    return df.filter(F.col(reason).isNull()).select(*[F.col(f"`{k}`") for k in keep], *cols)
