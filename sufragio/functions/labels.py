"""Vocabularies of the election domain and the label normalisers built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sufragio.functions.text import fold_upper, or_na, strip, text

# Offices by the area in which they are voted for.
MUNICIPAL_OFFICES = ("PREFEITO", "VICE-PREFEITO", "VEREADOR")
NATIONAL_OFFICES = ("PRESIDENTE", "VICE-PRESIDENTE")
# The 27 states and their regions.
REGION_OF_STATE = {
    "AC": "Norte", "AL": "Nordeste", "AP": "Norte", "AM": "Norte", "BA": "Nordeste", "CE": "Nordeste", "DF": "Centro-Oeste", "ES": "Sudeste",
    "GO": "Centro-Oeste", "MA": "Nordeste", "MT": "Centro-Oeste", "MS": "Centro-Oeste", "MG": "Sudeste", "PA": "Norte", "PB": "Nordeste", "PR": "Sul",
    "PE": "Nordeste", "PI": "Nordeste", "RJ": "Sudeste", "RN": "Nordeste", "RS": "Sul", "RO": "Norte", "RR": "Norte", "SC": "Sul", "SP": "Sudeste",
    "SE": "Nordeste", "TO": "Norte",
}
STATES = tuple(sorted(REGION_OF_STATE))
# The side of the spectrum of each party.
SIDE_OF_PARTY = {
    "PCDOB": "esquerda", "PC DO B": "esquerda", "PDT": "esquerda", "PSB": "esquerda", "PSOL": "esquerda", "PSTU": "esquerda", "PT": "esquerda",
    "PV": "esquerda", "REDE": "esquerda", "PCB": "esquerda", "UP": "esquerda", "AGIR": "centro", "AVANTE": "centro", "CIDADANIA": "centro",
    "DC": "centro", "MDB": "centro", "MOBILIZA": "centro", "PODEMOS": "centro", "PODE": "centro", "PMB": "centro", "PMN": "centro", "PSD": "centro",
    "SOLIDARIEDADE": "centro", "PROS": "centro", "DEM": "centro", "PHS": "direita", "PTC": "direita", "NOVO": "direita", "PL": "direita",
    "PP": "direita", "PRD": "direita", "PRTB": "direita", "PSDB": "direita", "REPUBLICANOS": "direita", "PRB": "direita", "PTB": "direita",
    "PSC": "direita", "PSL": "direita", "PATRIOTA": "direita", "UNIAO": "direita", "UNIAO BRASIL": "direita",
}
# Other spellings of places, as folded keys.
PLACE_ALIASES = {"SANTA IZABEL DO PARA": "SANTA ISABEL DO PARA", "MUNHOZ DE MELLO": "MUNHOZ DE MELO"}
# Labels without an answer, as folded keys.
NO_ANSWER = (
    "", "N/A", "NA", "NONE", "NAN", "NULL", "NULO", "NAO INFORMADO", "NAO INFORMADA", "NAO DIVULGAVEL", "NAO DECLARADO", "SEM INFORMACAO", "IGNORADO",
)
# Race categories in the order of reports, and what a label must contain for them.
RACES = {"BRANCA": ("BRANCA",), "PRETA": ("PRETA", "NEGRA"), "PARDA": ("PARDA",), "AMARELA": ("AMARELA",), "INDIGENA": ("INDIGENA",)}
RACE_UNKNOWN = "NAO_INFORMADO"


def lookup(c: Column, table: dict[str, str], default: str | None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))


def region(state: Column) -> Column:
    return lookup(state, REGION_OF_STATE, "N/A")


def side(party: Column, sides: dict[str, str] | None = None) -> Column:
    return lookup(fold_upper(party), SIDE_OF_PARTY if sides is None else sides, "indefinido")


def elected(status: Column) -> Column:
    """Status begins with ELEITO; 'NÃO ELEITO' does not."""
    return F.coalesce(F.startswith(F.upper(strip(status)), F.lit("ELEITO")), F.lit(False))


def place_key(c: Column) -> Column:
    key = fold_upper(c)
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PLACE_ALIASES.items() for x in kv]), key), key)


def race(key: Column) -> Column:
    """Category of a folded label."""
    out = None
    for name, parts in RACES.items():
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(key, F.lit(p))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(RACE_UNKNOWN)


def gender(key: Column, c: Column) -> Column:
    """MASCULINO, FEMININO or the label as it stands, from the folded label and the label. The
    folded one is a column of its own, as a CASE would work it out again in every branch."""
    return F.when((key == "M") | F.startswith(key, F.lit("MASC")), "MASCULINO").when((key == "F") | F.startswith(key, F.lit("FEM")), "FEMININO").otherwise(plain(c))


def plain(c: Column) -> Column:
    """Capitals with single blanks, 'N/A' if blank."""
    return or_na(F.upper(F.regexp_replace(text(c), "\\s+", " ")))


def unanswered(label: Column) -> Column:
    return fold_upper(label).isin(*NO_ANSWER)


def scope(office_key: Column) -> Column:
    return F.when(office_key.isin(*MUNICIPAL_OFFICES), "municipio").when(office_key.isin(*NATIONAL_OFFICES), "nacional").otherwise("uf")


def age_band(age: Column) -> Column:
    return F.when(age.isNull(), "N/A").when(age <= 29, "18-29").when(age <= 39, "30-39").when(age <= 49, "40-49").when(age <= 59, "50-59").when(age <= 69, "60-69").otherwise("70+")


def impact(percent: Column) -> Column:
    return F.when(percent >= 1.0, "Alto").when(percent >= 0.3, "Médio").otherwise("Baixo")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 x part / whole, half up at the given digits; 0 where whole is not positive."""
    scale = 10.0**digits
    return F.when(whole > 0, F.floor(part.cast("double") * (100.0 * scale) / whole.cast("double") + 0.5) / scale).otherwise(0.0)
