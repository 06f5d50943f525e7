"""Operators that take and give DataFrames of canonical columns (see fact.py)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sufragio.functions import labels

METRICS = ("votos_nominais", "candidatos", "eleitos", "registros")


def metric(name: str) -> Column:
    """Aggregate of one metric; an unknown name is an error (queries give nothing for it)."""
    out = {
        "votos_nominais": F.coalesce(F.sum("votes"), F.lit(0)),
        "candidatos": F.count_distinct("candidate"),
        "eleitos": F.count_if(F.col("elected")),
        "registros": F.count(F.lit(1)),
    }
    if name not in out:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return out[name].cast("bigint")


def latest_round(df: DataFrame) -> DataFrame:
    """Rows of each candidate's last round of each year; rows without year or candidate go.
    The last rounds are one small row per candidate and year, joined back, so that no task has
    to hold and sort all rows of a candidate with very many of them."""
    rows = df.filter(F.col("year").isNotNull() & F.col("candidate").isNotNull())
    last = rows.groupBy("candidate", "year").agg(F.max("round").alias("__last"))
    return rows.join(last.withColumnRenamed("candidate", "__c").withColumnRenamed("year", "__y"), (F.col("candidate") == F.col("__c")) & (F.col("year") == F.col("__y")) & (F.col("round") == F.col("__last"))).drop("__c", "__y", "__last")


def one_row_per_candidate(df: DataFrame) -> DataFrame:
    """A national candidate's rows as one: votes summed, elected if any row is, the status of
    such a row, everything else from the row that came first."""
    rest = [c for c in df.columns if c not in ("candidate", "votes", "elected", "status", "row", "counted")]
    first = F.min(F.struct("row", *rest))
    out = df.filter(F.col("candidate").isNotNull()).groupBy("candidate").agg(
        F.sum("votes").alias("votes"), F.max("elected").alias("elected"), F.max(F.struct(F.col("elected").alias("e"), (-F.col("row")).alias("r"), "status")).alias("__s"), first.alias("__f"),
        F.max("counted").alias("counted"),
    )
    return out.select("candidate", "votes", "elected", "counted", F.col("__s.status").alias("status"), "__f.*")


def best_row(df: DataFrame, unit: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each unit; the order must end in something unique. Spark cuts each
    partition down to one row per unit before the shuffle."""
    w = Window.partitionBy(*unit).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def resolved_labels(df: DataFrame, label: Column) -> DataFrame:
    """One label per candidacy (candidate, year, round, office): answered before unanswered, then
    the most frequent, then the first by name."""
    unit = ["candidate", "year", "round", "office_key"]
    counts = df.filter(F.col("candidate").isNotNull()).select(*unit, label.alias("label")).groupBy(*unit, "label").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(labels.unanswered(F.col("label")).alias("u"), (-F.col("n")).alias("n"), "label"))
    return counts.groupBy(*unit).agg(best["label"].alias("label"))


def with_share(df: DataFrame, value: str, name: str = "percentual", digits: int = 2, few: bool = True) -> DataFrame:
    """The share of the returned rows' total. few: the rows are labels, states, places or one page,
    which one task can hold, so the total is a window over them; else it is a scalar of its own."""
    total = F.sum(value).over(Window.partitionBy(F.lit(0))) if few else df.agg(F.sum(value)).scalar()
    return df.withColumn(name, labels.percent(F.col(value), total, digits))


def totals(df: DataFrame, size: int) -> DataFrame:
    """One row: total of rows and of pages of `size`."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"), F.ceil(n / size).alias("paginas"))


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def round_breakdown() -> list[Column]:
    """Reference round and votes by round of a group's rows; null where a round has no row."""
    of = lambda r: F.sum(F.when(F.col("round") == r, F.col("votes")))
    return [
        F.max(F.when(F.col("round") > 0, F.col("round"))).alias("turno_referencia"),
        of(1).alias("votos_primeiro_turno"),
        of(2).alias("votos_segundo_turno"),
        F.sum("votes").alias("votos_consolidados"),
    ]


def usual(df: DataFrame, group: Sequence[str], value: str, alias: str) -> DataFrame:
    """The most frequent value per group, ties to the smallest; blank values do not count."""
    counts = df.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*group).agg(best["v"].alias(alias))


def person_id(sig: Column) -> Column:
    return F.concat(F.lit("person:"), F.sha1(sig))
