"""The semantic layer: source columns under many names are bound to roles, and each role to one
canonical column. A role without a column becomes null, so every query runs on every source; the
set of bound roles tells an operator when to give nothing instead."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sufragio.functions import labels, text

# Column names of each role, the first present one counts.
ROLES: dict[str, tuple[str, ...]] = {
    "row": ("ROW_ID",),
    "year": ("ANO_ELEICAO", "NR_ANO_ELEICAO"),
    "round": ("NR_TURNO", "CD_TURNO", "DS_TURNO"),
    "state": ("SG_UF",),
    "office": ("DS_CARGO", "DS_CARGO_D"),
    "party": ("SG_PARTIDO",),
    "place": ("NM_UE", "NM_MUNICIPIO"),
    "place_code": ("CD_MUNICIPIO",),
    "status": ("DS_SIT_TOT_TURNO",),
    "votes": ("QT_VOTOS_NOMINAIS_VALIDOS", "NR_VOTACAO_NOMINAL", "QT_VOTOS_NOMINAIS"),
    "source_id": ("SQ_CANDIDATO",),
    "number": ("NR_CANDIDATO",),
    "full_name": ("NM_CANDIDATO",),
    "ballot_name": ("NM_URNA_CANDIDATO",),
    "cpf": ("NR_CPF_CANDIDATO",),
    "birth": ("DT_NASCIMENTO",),
    "held": ("DT_ELEICAO",),
    "age": ("IDADE",),
    "zone": ("NR_ZONA", "CD_ZONA", "SQ_ZONA"),
    "gender": ("DS_GENERO",),
    "education": ("DS_GRAU_INSTRUCAO",),
    "race": ("DS_COR_RACA",),
    "civil": ("DS_ESTADO_CIVIL",),
    "occupation": ("DS_OCUPACAO",),
    "income": ("DS_FAIXA_RENDA", "DS_RENDA", "FAIXA_RENDA"),
    "area": ("DS_LOCAL_VOTACAO", "DS_TIPO_LOCAL", "DS_CLASSIFICACAO_UE"),
    "coalition": ("NM_COLIGACAO", "DS_COMPOSICAO_COLIGACAO"),
    "seats": ("QT_VAGAS", "QTD_VAGAS", "QTDE_VAGAS"),
    "latitude": ("LATITUDE",),
    "longitude": ("LONGITUDE",),
}


def day(c: Column) -> Column:
    """Date written dd/MM/yyyy or yyyy-MM-dd; anything else is null."""
    x = text.strip(c)
    return F.coalesce(F.try_to_date(x, "dd/MM/yyyy"), F.try_to_date(x, "yyyy-MM-dd"))


#: Normalised key columns that a built fact table carries, so that filters on them reach the files.
STORED = {"state": "uf_chave", "office_key": "cargo_chave", "place_key": "municipio_chave"}
WHOLE, BROKEN = ("tinyint", "smallint", "int", "bigint"), ("float", "double")


def round_number(c: Column) -> Column:
    """Number, else the first run of digits, else 0."""
    x = text.strip(c.cast("string"))
    return F.coalesce(x.try_cast("double").try_cast("int"), F.regexp_extract(x, "([0-9]+)", 1).try_cast("int"), F.lit(0))


def signature(cpf: Column, name_key: Column, birth: Column) -> Column:
    """What identifies a person: the number's digits, else folded name and birth date."""
    born = F.date_format(birth, "yyyy-MM-dd")
    return F.when(cpf != "", cpf).otherwise(F.concat_ws("|", F.nullif(name_key, F.lit("")), born))


@dataclass(frozen=True)
class Fact:
    """df has the canonical columns; bound names the roles that the source really has."""

    df: DataFrame
    bound: frozenset[str]

    def has(self, *roles: str) -> bool:
        return all(r in self.bound for r in roles)

    def where(self, condition: Column) -> Fact:
        return Fact(self.df.filter(condition), self.bound)


def bind(source: DataFrame) -> Fact:
    """Catalyst prunes the canonical columns that a query does not use."""
    present = {c.upper(): c for c in reversed(source.columns)}
    found = {role: next((present[a] for a in names if a in present), None) for role, names in ROLES.items()}
    kinds = dict(source.dtypes)
    raw = lambda role: F.col(f"`{found[role]}`") if found[role] else F.lit(None).cast("string")
    s = lambda role: text.nullable(raw(role))
    stored = lambda key, made: F.col(f"`{present[STORED[key].upper()]}`") if STORED[key].upper() in present else made

    def whole(role: str, kind: str) -> Column:
        """A number as it is where the column is one already, so that filters reach the files and
        large ones stay exact; else out of its text."""
        own = kinds.get(found[role])
        return raw(role) if own == kind else raw(role).cast(kind) if own in WHOLE else text.whole(raw(role)).try_cast(kind)

    def broken(role: str) -> Column:
        own = kinds.get(found[role])
        return raw(role) if own == "double" else raw(role).cast("double") if own in WHOLE + BROKEN else text.number(raw(role))

    turn = F.coalesce(raw("round").cast("int"), F.lit(0)) if kinds.get(found["round"]) in WHOLE else round_number(raw("round"))
    base = source.select(
        (raw("row").cast("bigint") if found["row"] else F.monotonically_increasing_id()).alias("row"),
        whole("year", "int").alias("year"),
        turn.alias("round"),
        stored("state", F.upper(s("state"))).alias("state"),
        s("office").alias("office"),
        stored("office_key", F.upper(s("office"))).alias("office_key"),
        s("party").alias("party"),
        s("place").alias("place"),
        stored("place_key", labels.place_key(raw("place"))).alias("place_key"),
        text.nullable(text.digits(raw("place_code"))).alias("place_code"),
        s("status").alias("status"),
        labels.elected(raw("status")).alias("elected"),
        F.coalesce(whole("votes", "bigint"), F.lit(0).cast("bigint")).alias("votes"),
        whole("votes", "bigint").isNotNull().alias("counted"),
        s("source_id").alias("source_id"),
        s("number").alias("number"),
        s("full_name").alias("full_name"),
        s("ballot_name").alias("ballot_name"),
        text.digits(raw("cpf")).alias("cpf"),
        day(raw("birth")).alias("birth"),
        day(raw("held")).alias("held"),
        broken("age").alias("own_age"),
        s("zone").alias("zone"),
        *[s(r).alias(r) for r in ("gender", "education", "race", "civil", "occupation", "income", "area", "coalition")],
        broken("seats").alias("seats"),
        broken("latitude").alias("latitude"),
        broken("longitude").alias("longitude"),
    )
    # three projections, each built on columns of the one before: fewer plans to analyse, and
    # no expression is written out again inside another
    longer = F.length(F.coalesce("full_name", F.lit(""))) >= F.length(F.coalesce("ballot_name", F.lit("")))
    name = F.when(longer, F.coalesce("full_name", "ballot_name")).otherwise(F.col("ballot_name"))
    by_dates = F.bround(F.datediff("held", "birth") / 365.25, 0)
    fold = text.fold_upper
    named = base.select("*", name.alias("name"), fold(F.col("gender")).alias("gender_key"), fold(F.col("race")).alias("race_key"), F.coalesce("own_age", by_dates).alias("age"))
    named = named.select("*", fold(F.col("name")).alias("name_key"), F.coalesce("source_id", "number", F.lower("name")).alias("candidate"))
    named = named.select("*", signature(F.col("cpf"), F.col("name_key"), F.col("birth")).alias("signature"))
    return Fact(named, frozenset(r for r, c in found.items() if c))
