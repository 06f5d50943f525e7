"""Schema drift over files of a series: a catalogue of field lifespans, its report of changes,
and one consistent table over all files.

The header of each file is exploded to one row per file and field, with the field's type taken
from the file's own values. Lag and lead over a series' files tell where a field's life starts
and ends; a start and an end of the same meaning (alias table) between the same two files are
one renaming. Windows run over blocks of at most BLOCK files, each block also holding the file
before and after it, so even a series that has a third of all files is never one task.

Defined cases: repeated lines of a file count each for its type; a field without any value in a
file has no type there and is not compared; files of one series made at the same moment are
taken in the order of their key; a null header is a file without fields; a name that stands
twice in a header counts once, at its first place; a line with too few values leaves the rest
null; empty tables give empty results. In the consistent table nothing is lost: values of names
outside the alias table, of unnamed or repeated columns and beyond the header (these as '#' and
their place) stand in `outros`; of two names of one field in a file the first that has a value
counts and the other stands in `outros`; a value that does not fit its field is null there and
stands as it is in `rejeitados`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sufragio.session import materialize

BLOCK = 2048
SALTS = 8
#: Values that stand for no value.
NO_VALUE = ("", "#NULO#")
#: Types by pattern, in the order in which a tie is settled (the later is the wider).
TYPES = {
    "integer": "[0-9]+",
    "decimal": "[0-9]+[.,][0-9]+",
    "date_dmy": "[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "date_ymd": "[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "timestamp": "[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}",
}
#: Canonical field, kind of its values, and the other names under which files carry it.
ALIASES: dict[str, tuple[str, tuple[str, ...]]] = {
    "ANO_ELEICAO": ("int", ("NR_ANO_ELEICAO", "AA_PLEITO", "AA_ELEICAO")),
    "NR_TURNO": ("int", ("CD_TURNO", "DS_TURNO")),
    "SG_UF": ("text", ("SG_ESTADO", "UF")),
    "NM_UE": ("text", ("NM_MUNICIPIO", "NM_UNIDADE_ELEITORAL")),
    "CD_MUNICIPIO": ("digits", ("CD_MUN_TRE", "CD_MUN")),
    "NR_ZONA": ("digits", ("CD_ZONA", "SQ_ZONA")),
    "DS_CARGO": ("text", ("DS_CARGO_D", "DS_FUNCAO_DISPUTADA")),
    "SQ_CANDIDATO": ("digits", ("SQ_CAND",)),
    "NR_CANDIDATO": ("digits", ("NR_URNA",)),
    "NM_CANDIDATO": ("text", ("NM_COMPLETO",)),
    "SG_PARTIDO": ("text", ("SG_AGREMIACAO",)),
    "DT_ELEICAO": ("date", ("DT_PLEITO",)),
    "DS_SIT_TOT_TURNO": ("text", ("DS_SITUACAO_FINAL",)),
    "QT_VOTOS_NOMINAIS_VALIDOS": ("int", ("QT_VOTOS_NOMINAIS", "NR_VOTACAO_NOMINAL", "QTDE_VOTACAO")),
    "QT_VAGAS": ("int", ("QTD_VAGAS", "QTDE_VAGAS")),
    "NM_COLIGACAO": ("text", ()),
    "DS_GENERO": ("text", ()),
    "DS_COR_RACA": ("text", ()),
    "DS_OCUPACAO": ("text", ()),
    "DS_FAIXA_RENDA": ("text", ()),
}


def meanings(aliases: Mapping[str, tuple[str, Sequence[str]]]) -> dict[str, str]:
    """Each known name and its canonical field."""
    return {n: k for k, (_, others) in aliases.items() for n in (k, *others)}


def canonical(name: Column, aliases: Mapping[str, tuple[str, Sequence[str]]]) -> Column:
    pairs = [F.lit(x) for kv in meanings(aliases).items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def header_names(header: Column, delimiter: str = ";") -> Column:
    """Field names in capitals, without outer blanks and invisible marks."""
    mark = "[\\u200b-\\u200f\\u2060\\ufeff]"
    clean = lambda x: F.upper(F.regexp_replace(F.regexp_replace(x, mark, ""), "^[\\s\\u00a0]+|[\\s\\u00a0]+$", ""))
    return F.transform(F.split(header, delimiter, -1), clean)


def value_type(v: Column) -> Column:
    out = F.when(v.isNull() | F.trim(v).isin(*NO_VALUE), F.lit(None).cast("string"))
    for name, pattern in TYPES.items():
        out = out.when(v.rlike(f"^{pattern}\\z"), name)
    return out.otherwise("text")


def file_numbers(files: DataFrame, key: str, series: str, made: str) -> DataFrame:
    """files with __seq, each file's number in its series from 0. Files are counted by day
    and days summed up, so no window spans a whole series of unbounded size."""
    day = F.date_trunc("day", F.coalesce(F.col(made), F.lit("0001-01-01").cast("timestamp_ntz")))
    rows = files.select(F.col(series).alias("__series"), F.col(key).alias("__key"), F.col(made).alias("__made"), day.alias("__day"))
    days = rows.groupBy("__series", "__day").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("__series").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("__series", "__day").orderBy(F.col("__made").asc_nulls_first(), "__key"))
    numbered = rows.withColumn("__in", inside)
    same = numbered["__series"].eqNullSafe(days["__series"]) & (numbered["__day"] == days["__day"])
    return numbered.join(days, same).select(numbered["__series"], "__key", (F.col("__before") + F.col("__in") - 1).alias("__seq"))


def catalogue(
    files: DataFrame, lines: DataFrame, key: str, series: str, made: str, header: str, line_key: str, content: str, delimiter: str = ";"
) -> DataFrame:
    """One row per file and field: __series, __key, __seq, name, place, type (null: no value)."""
    numbers = file_numbers(files, key, series, made)
    heads = (
        files.select(F.col(key).alias("__key"), F.posexplode(header_names(F.col(header), delimiter)).alias("place", "name"))
        .filter(F.col("name") != "")
        .groupBy("__key", "name")
        .agg(F.min("place").alias("place"))
    )
    counts = [F.count_if(F.col("t") == t).alias(f"n{i}") for i, t in enumerate([*TYPES, "text"])]
    typed = (
        lines.select(F.col(line_key).alias("__key"), F.posexplode(F.split(F.col(content), delimiter, -1)).alias("place", "v"))
        .select("__key", "place", value_type(F.col("v")).alias("t"))
        .filter(F.col("t").isNotNull())
        .groupBy("__key", "place")
        .agg(*counts)
    )
    best = F.greatest(*[F.struct(F.col(f"n{i}").alias("n"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate([*TYPES, "text"])])
    typed = typed.select("__key", "place", best["t"].alias("type"))
    return heads.join(typed, ["__key", "place"], "left").join(numbers, "__key")


def lives(cat: DataFrame) -> DataFrame:
    """cat with the numbers and types of the files before and after that have the same name."""
    around = F.array_distinct(
        F.array(*[F.floor(F.greatest(F.col("__seq") + d, F.lit(0)) / BLOCK) for d in (-1, 0, 1)])
    )
    blocks = cat.withColumn("__block", F.explode(around))
    own = F.floor(F.col("__seq") / BLOCK) == F.col("__block")
    w = Window.partitionBy("__series", "name", "__block").orderBy("__seq")
    return (
        blocks.withColumn("__prev", F.lag("__seq").over(w))
        .withColumn("__prev_type", F.lag("type").over(w))
        .withColumn("__next", F.lead("__seq").over(w))
        .withColumn("__next_type", F.lead("type").over(w))
        .filter(own)
    )


def islands(cat: DataFrame) -> DataFrame:
    """serie, campo, tipo (null: no value), primeiro, ultimo (file numbers from 1): each stretch of
    consecutive files of a series in which a field has one type. Windows hold only the starts and
    ends of one field's stretches."""
    before = F.coalesce(F.col("__prev") == F.col("__seq") - 1, F.lit(False)) & F.col("__prev_type").eqNullSafe(F.col("type"))
    after = F.coalesce(F.col("__next") == F.col("__seq") + 1, F.lit(False)) & F.col("__next_type").eqNullSafe(F.col("type"))
    edges = lives(cat).select("__series", "name", "type", "__seq", (~before).alias("s"), (~after).alias("e")).filter("s or e")
    w = Window.partitionBy("__series", "name").orderBy("__seq")
    until = F.when(F.col("e"), F.col("__seq")).otherwise(F.lead("__seq").over(w))  # the edge after a start is its end
    out = edges.withColumn("until", until).filter("s")
    return out.select(F.col("__series").alias("serie"), F.col("name").alias("campo"), F.col("type").alias("tipo"), (F.col("__seq") + 1).alias("primeiro"), (F.col("until") + 1).alias("ultimo"))


def changes(cat: DataFrame, aliases: Mapping[str, tuple[str, Sequence[str]]] = ALIASES) -> DataFrame:
    """__key (the later file), campo, mudanca: added, removed, renamed, type_changed."""
    lived = lives(cat)
    follows = F.coalesce(F.col("__prev") == F.col("__seq") - 1, F.lit(False))
    goes_on = F.coalesce(F.col("__next") == F.col("__seq") + 1, F.lit(False))
    at = "__at"  # number of the later file of a pair
    kept = lived.filter(follows & (F.col("type") != F.col("__prev_type"))).select("__series", F.col("__seq").alias(at), F.col("name").alias("campo"), F.lit("type_changed").alias("mudanca"))
    starts = lived.filter(~follows & (F.col("__seq") > 0)).select("__series", F.col("__seq").alias(at), "name", "type", F.lit(1).alias("s"))
    ends = lived.filter(~goes_on).select("__series", (F.col("__seq") + 1).alias(at), "name", "type", F.lit(0).alias("s"))
    # one row per file pair and meaning: at most a handful of names, matched in the order of their names
    same = (
        starts.unionByName(ends)
        .withColumn("field", canonical(F.col("name"), aliases))
        .groupBy("__series", at, "field")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("s") == 1, F.struct("name", "type")))).alias("new"),
            F.array_sort(F.collect_list(F.when(F.col("s") == 0, F.struct("name", "type")))).alias("old"),
        )
    )
    pairs = F.least(F.size("new"), F.size("old"))
    event = lambda name, what: F.struct(name.alias("campo"), F.lit(what).alias("mudanca"))
    renamed = F.transform(F.slice("new", F.lit(1), pairs), lambda x: event(x["name"], "renamed"))
    retyped = F.transform(
        F.filter(F.arrays_zip(F.slice("new", F.lit(1), pairs).alias("n"), F.slice("old", F.lit(1), pairs).alias("o")), lambda x: x["n"]["type"] != x["o"]["type"]),
        lambda x: event(x["n"]["name"], "type_changed"),
    )
    rest = lambda a, what: F.transform(F.slice(a, pairs + 1, F.greatest(F.size(a) - pairs, F.lit(0))), lambda x: event(x["name"], what))
    moved = same.select("__series", at, F.explode(F.concat(renamed, retyped, rest("new", "added"), rest("old", "removed"))).alias("e")).select("__series", at, "e.*")
    return kept.unionByName(moved)


def report(files: DataFrame, lines: DataFrame, key: str, series: str, made: str, header: str, line_key: str, content: str, aliases=ALIASES) -> DataFrame:
    """The changes with the key of the later file. An end after a series' last file has no
    later file and drops out in the join."""
    cat = materialize(catalogue(files, lines, key, series, made, header, line_key, content), "field-lifespans")
    numbers = file_numbers(files, key, series, made).withColumnRenamed("__seq", "__at")
    found = changes(cat, aliases)
    same = found["__series"].eqNullSafe(numbers["__series"]) & (found["__at"] == numbers["__at"])
    return found.join(numbers, same).select(F.col("__key").alias(key), "campo", "mudanca")


#: A number with something written around it ('31ª ZONA', 'ANO-2008', '#5'), but no sign or separator.
DECORATED = "^(?:[^0-9.,+-]*[^0-9\\s.,+-]-)?[^0-9.,+-]*([0-9]+)[^0-9.,+-]*\\z"


def cast(v: Column, kind: str) -> Column:
    """v (trimmed) as the kind of its field, null if it does not fit. A whole number may have a sign
    (not in digits), a fraction of zeros, or words around it; nothing else is read into it."""
    if kind == "date":
        day = F.when(v.rlike(f"^{TYPES['date_dmy']}\\z"), F.try_to_date(v, "dd/MM/yyyy"))
        return F.coalesce(day, F.when(v.rlike(f"^{TYPES['date_ymd']}( [0-9:]{{8}})?\\z"), F.try_to_date(v.substr(1, 10), "yyyy-MM-dd")))
    if kind in ("int", "digits"):
        sign = "[+-]?" if kind == "int" else ""
        run = F.when(v.rlike(f"^{sign}[0-9]+\\z"), v).when(v.rlike(f"^{sign}[0-9]+[.,]0+\\z"), F.regexp_extract(v, "^([+-]?[0-9]+)", 1))
        run = run.when(v.rlike(DECORATED), F.regexp_extract(v, DECORATED, 1))
        return run.try_cast("bigint") if kind == "int" else run
    return v


def consistent(files: DataFrame, lines: DataFrame, key: str, header: str, line_id: str, line_key: str, content: str, aliases=ALIASES, delimiter: str = ";") -> DataFrame:
    """All lines as one table: a column per field of the alias table, cast by the field's kind,
    `outros` ('NAME=value' of everything else, by place) and `rejeitados` ('FIELD=value' of values
    that do not fit, by field), both divided by the delimiter and null if there is none.

    The places of the fields are worked out once per file and joined to its lines salted, since
    one file may hold a third of them."""
    clean = lambda v: F.when(~F.trim(v).isin(*NO_VALUE), F.trim(v))
    names = F.coalesce(header_names(F.col(header), delimiter), F.array().cast("array<string>"))
    place = F.sequence(F.lit(0), F.size("__n") - 1)
    told = F.when(F.size("__n") == 0, F.array().cast("array<string>")).otherwise(
        F.transform(place, lambda i: F.when((F.get("__n", i) == "") | (F.array_position("__n", F.get("__n", i)) <= i), F.concat(F.lit("#"), (i + 1).cast("string"))).otherwise(F.get("__n", i)))
    )
    heads = files.select(F.col(key).alias("__key"), names.alias("__n")).withColumn("__n", told)
    heads = heads.withColumn("__f", F.transform("__n", lambda x: canonical(x, aliases)))
    all_of = lambda f: F.filter(F.transform("__f", lambda x, i: F.when(x == f, i)), lambda i: i.isNotNull())
    known = F.array(*[F.lit(f) for f in aliases])
    rest = F.filter(
        F.transform("__n", lambda n, i: F.struct(n.alias("name"), i.alias("at"), F.filter(all_of(F.get("__f", i)), lambda p: p < i).alias("before"), F.array_contains(known, F.get("__f", i)).alias("known"))),
        lambda x: ~x["known"] | (F.size(x["before"]) > 0),
    )
    heads = heads.select("__key", F.size("__n").alias("__width"), rest.alias("__rest"), *[all_of(F.lit(f)).alias(f"__at_{f}") for f in aliases])
    heads = heads.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    values = F.transform(F.split(F.col(content), delimiter, -1), clean)
    rows = lines.select(F.col(line_id), F.col(line_key).alias("__key"), values.alias("__v"), F.pmod(F.xxhash64(F.col(line_id)), F.lit(SALTS)).alias("__salt"))
    joined = rows.join(heads, ["__key", "__salt"], "left")
    raw = {f: F.get(F.filter(F.transform(f"__at_{f}", lambda p: F.get("__v", p)), lambda v: v.isNotNull()), F.lit(0)) for f in aliases}
    joined = joined.select("*", *[v.alias(f"__raw_{f}") for f, v in raw.items()])
    made = {f: cast(F.col(f"__raw_{f}"), kind) for f, (kind, _) in aliases.items()}
    used = lambda x: x["known"] & ~F.exists(x["before"], lambda p: F.get("__v", p).isNotNull())
    show = lambda name, v: F.concat(name, F.lit("="), v)
    others = F.transform(F.filter("__rest", lambda x: ~used(x)), lambda x: show(x["name"], F.get("__v", x["at"])))
    width = F.coalesce("__width", F.lit(0))
    beyond = F.transform("__v", lambda v, i: F.when(i >= width, show(F.concat(F.lit("#"), (i + 1).cast("string")), v)))
    every = F.filter(F.concat(F.coalesce(others, F.array().cast("array<string>")), F.coalesce(beyond, F.array().cast("array<string>"))), lambda x: x.isNotNull())
    out = joined.select(F.col("__key").alias(line_key), line_id, *[c.alias(f) for f, c in made.items()], every.alias("__every"), *[f"__raw_{f}" for f in aliases])
    rejected = F.concat_ws(delimiter, *[F.when(F.col(f"__raw_{f}").isNotNull() & F.col(f).isNull(), show(F.lit(f), F.col(f"__raw_{f}"))) for f in aliases])
    return out.select(line_key, line_id, *aliases, F.nullif(F.array_join("__every", delimiter), F.lit("")).alias("outros"), F.nullif(rejected, F.lit("")).alias("rejeitados"))


def rejects(table: DataFrame, delimiter: str = ";") -> DataFrame:
    """campo, valores: how many values of each field did not fit it."""
    each = table.filter(F.col("rejeitados").isNotNull()).select(F.explode(F.split("rejeitados", delimiter, -1)).alias("r"))
    return each.groupBy(F.substring_index("r", "=", 1).alias("campo")).agg(F.count(F.lit(1)).alias("valores"))
