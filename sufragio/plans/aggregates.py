"""Aggregate queries: each takes a bound Fact and a Scope and gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sufragio.functions import labels
from sufragio.operators.fact import Fact
from sufragio.operators.filters import Scope, state_filter
from sufragio.operators.relational import METRICS, best_row, latest_round, metric, one_row_per_candidate, page, person_id, resolved_labels, round_breakdown, with_share
from sufragio.session import materialize

DIMENSIONS = ("status", "genero", "instrucao", "cor_raca", "estado_civil", "ocupacao", "cargo", "uf")
LOW_AGE, HIGH_AGE, BAND = 20, 90, 10


def options(fact: Fact, what: str) -> DataFrame:
    """Sorted values of a filter: anos, ufs (valid states only) or cargos."""
    column, alias = {"anos": ("year", "ano"), "ufs": ("state", "uf"), "cargos": ("office", "cargo")}[what]
    out = fact.df.filter(F.col(column).isNotNull()).select(F.col(column).alias(alias)).distinct()
    return (out.filter(F.col("uf").isin(*labels.STATES)) if what == "ufs" else out).orderBy(alias)


def scoped(fact: Fact, scope: Scope, last: bool = True) -> DataFrame:
    """Filtered rows: of the last round unless one was asked for, national candidates as one row."""
    df = scope.apply(fact).df
    if last and scope.round is None and fact.has("round"):
        df = latest_round(df)
    return one_row_per_candidate(df) if scope.presidential else df


def overview(fact: Fact, scope: Scope) -> DataFrame:
    """Totals; those whose role the source lacks are null."""
    df = scoped(fact, scope)
    need = {"candidatos": fact.has("source_id") or fact.has("number") or fact.has("full_name"), "eleitos": fact.has("status"), "votos_nominais": fact.has("votes"), "registros": True}
    return df.agg(*[(metric(m) if there else F.lit(None).cast("bigint")).alias(m) for m, there in need.items()])


def top_candidates(fact: Fact, scope: Scope, number: int = 1, size: int = 20) -> DataFrame:
    """One page of candidates by votes, then name, with identity and votes by round. Rows are
    first summed per candidate and identity, so the second aggregate sees few rows."""
    df = scope.apply(fact).df
    df = latest_round(df) if scope.round is None and fact.has("round") else df.filter(F.col("candidate").isNotNull())
    part = df.groupBy("candidate", "signature").agg(
        F.count(F.lit(1)).alias("n"), *round_breakdown(),
        F.min("state").alias("s0"), F.max("state").alias("s1"), F.min(F.struct("row", "name", "party", "office", "status", "number")).alias("first"),
    )
    out = part.groupBy("candidate").agg(
        F.max("turno_referencia").alias("turno_referencia"), F.sum("votos_primeiro_turno").alias("votos_primeiro_turno"), F.sum("votos_segundo_turno").alias("votos_segundo_turno"),
        F.sum("votos_consolidados").alias("votos"), F.min("s0").alias("s0"), F.max("s1").alias("s1"), F.min("first").alias("first"),
        F.min(F.struct((F.col("signature") == "").alias("blank"), (-F.col("n")).alias("n"), "signature")).alias("who"),
    )
    out = out.select(
        F.col("candidate").alias("candidato_id"), F.col("first.name").alias("candidato"), F.col("first.party").alias("partido"), F.col("first.office").alias("cargo"),
        F.when(F.col("s0") == F.col("s1"), F.col("s0")).alias("uf"), F.col("first.status").alias("situacao"), F.col("first.number").alias("numero"), "votos",
        "turno_referencia", "votos_primeiro_turno", "votos_segundo_turno", person_id(F.col("who.signature")).alias("person_id"),
    )
    return page(out, [F.desc("votos"), F.asc_nulls_first("candidato"), "candidato_id"], number, size)


def label_of(dimension: str) -> Column:
    return {
        "status": labels.plain(F.col("status")),
        "genero": labels.gender(F.col("gender_key"), F.col("gender")),
        "instrucao": labels.plain(F.col("education")),
        "cor_raca": labels.race(F.col("race_key")),
        "estado_civil": labels.plain(F.col("civil")),
        "ocupacao": labels.plain(F.col("occupation")),
        "cargo": labels.plain(F.col("office")),
    }[dimension]


def distribution(fact: Fact, dimension: str, scope: Scope) -> DataFrame:
    """Candidacies per label (rows per state for 'uf'), unanswered ones left out before shares."""
    if dimension == "uf":
        counted = scope.apply(fact).df.filter(F.col("state").isNotNull()).groupBy(F.col("state").alias("rotulo")).agg(F.count(F.lit(1)).alias("total"))
        return with_share(counted, "total")
    picked = resolved_labels(scoped(fact, scope, last=False), label_of(dimension))
    unknown = F.col("label") == labels.RACE_UNKNOWN if dimension == "cor_raca" else labels.unanswered(F.col("label"))
    counts = picked.groupBy("label").agg(F.count(F.lit(1)).alias("total"))
    # over label and count: a condition on the label alone would be pushed below the aggregation
    known = F.when(F.col("total") > 0, ~unknown).otherwise(False)
    return with_share(counts.filter(known).select(F.col("label").alias("rotulo"), "total"), "total")


def race_comparison(fact: Fact, scope: Scope) -> DataFrame:
    """Rows and elected rows per race in fixed order, with the share of each in its total."""
    df = scope.apply(fact).df.withColumn("categoria", labels.race(F.col("race_key")))
    counts = df.groupBy("categoria").agg(F.count(F.lit(1)).alias("candidatos"), F.count_if(F.col("elected")).alias("eleitos"))
    every = fact.df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(r) for r in labels.RACES])).alias("ordem", "categoria"))
    full = every.join(counts, "categoria", "left").fillna(0, ["candidatos", "eleitos"])
    return with_share(with_share(full, "candidatos", "parte_candidatos"), "eleitos", "parte_eleitos")


def occupation_by_gender(fact: Fact, scope: Scope) -> DataFrame:
    kind = labels.gender(F.col("gender_key"), F.col("gender"))
    df = scope.apply(fact).df.select(label_of("ocupacao").alias("ocupacao"), kind.alias("g"))
    out = df.groupBy("ocupacao").agg(F.count_if(F.col("g") == "MASCULINO").alias("masculino"), F.count_if(F.col("g") == "FEMININO").alias("feminino"))
    # one condition over label and counts: a condition on the label alone would be pushed to every row
    some = F.when((F.col("masculino") > 0) | (F.col("feminino") > 0), ~labels.unanswered(F.col("ocupacao"))).otherwise(False)
    return out.filter(some).orderBy(F.desc("masculino"), F.desc("feminino"), "ocupacao")


def age_statistics(fact: Fact, scope: Scope) -> DataFrame:
    """Mean, median, extremes and population deviation, the latter from exact sums."""
    a = F.col("age")
    n, s, q = F.count(a), F.sum(a), F.sum(a * a)
    six = lambda x: F.floor(x * 1e6 + 0.5) / 1e6
    return scope.apply(fact).df.agg(
        n.alias("n"), six(s / n).alias("media"), six(F.median(a)).alias("mediana"), F.min(a).alias("minima"), F.max(a).alias("maxima"),
        six(F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))).alias("desvio"),
    )


def age_bins(fact: Fact, scope: Scope) -> DataFrame:
    """Counts per half-open band of ten years from 20 to 90, empty bands included."""
    low = (F.floor(F.col("age") / BAND) * BAND).cast("int")
    counts = scope.apply(fact).df.filter((F.col("age") >= LOW_AGE) & (F.col("age") < HIGH_AGE)).groupBy(low.alias("de")).agg(F.count(F.lit(1)).alias("total"))
    bands = fact.df.sparkSession.range(LOW_AGE, HIGH_AGE, BAND).select(F.col("id").cast("int").alias("de"))
    return bands.join(counts, "de", "left").select("de", (F.col("de") + BAND - 1).alias("ate"), F.coalesce("total", F.lit(0)).alias("total"))


def known_metric(fact: Fact, name: str) -> tuple[Fact, str]:
    """An unknown metric gives an empty result."""
    return (fact, name) if name in METRICS else (fact.where(F.lit(False)), "registros")


def time_series(fact: Fact, name: str, scope: Scope) -> DataFrame:
    fact, name = known_metric(fact, name)
    return scope.apply(fact).df.filter(F.col("year").isNotNull()).groupBy(F.col("year").alias("ano")).agg(metric(name).alias("valor")).orderBy("ano")


def ranking(fact: Fact, by: str, name: str, scope: Scope, top: int | None = 20) -> DataFrame:
    """Groups by metric; shares are of the returned rows."""
    fact, name = known_metric(fact, name)
    df = scope.apply(fact).df
    if scope.presidential and by != "uf":
        df = one_row_per_candidate(df)
    label = {"candidato": F.coalesce("name", F.lit("N/A")), "partido": F.coalesce("party", F.lit("N/A")), "cargo": labels.plain(F.col("office")), "uf": F.coalesce("state", F.lit("N/A"))}[by]
    out = df.groupBy(label.alias("rotulo")).agg(metric(name).alias("valor"))
    return with_share(out, "valor", few=False) if top is None else with_share(out.orderBy(F.desc("valor"), "rotulo").limit(top), "valor")


def state_map(fact: Fact, name: str, scope: Scope) -> DataFrame:
    fact, name = known_metric(fact, name)
    out = scope.apply(fact).df.filter(F.col("state").isNotNull()).groupBy(F.col("state").alias("uf")).agg(metric(name).alias("valor"))
    return with_share(out, "valor")


def seats(fact: Fact, by: str, scope: Scope) -> DataFrame:
    """Seats per office, state or place: the largest number given per unit, summed; without such
    a column, the distinct elected candidates."""
    df = scope.apply(fact).df.withColumn("area", labels.scope(F.col("office_key")))
    if by == "municipio":
        df = df.filter(F.col("area") == "municipio")
    place = F.when(F.col("area") == "municipio", F.col("place_key"))
    df = df.withColumn("unit_place", place).withColumn("unit_state", F.when(F.col("area") == "nacional", F.lit("BR")).otherwise(F.col("state")))
    label = {"cargo": F.coalesce("office_key", F.lit("N/A")), "uf": F.coalesce("unit_state", F.lit("N/A")), "municipio": F.coalesce("place_key", F.lit("N/A"))}[by]
    df = df.withColumn("rotulo", label)
    unit = ["rotulo", "year", "unit_state", "office_key", "unit_place"]
    if fact.has("seats"):
        return df.groupBy(*unit).agg(F.max("seats").alias("n")).groupBy("rotulo").agg(F.sum(F.coalesce("n", F.lit(0.0))).cast("bigint").alias("vagas"))
    return df.filter(F.col("elected") & F.col("candidate").isNotNull()).select(*unit, "candidate").distinct().groupBy("rotulo").agg(F.count(F.lit(1)).alias("vagas"))


def winners(fact: Fact, office: str, unit: list[str], year: int | None, round_: int | None, state: str | None, sides: dict[str, str] | None = None) -> DataFrame:
    """The winning row of each unit: elected before others, later round, then votes; ties by
    party, candidate and row."""
    df = fact.df.filter((F.col("office_key") == office) & F.col("state").isNotNull() & F.col("party").isNotNull())
    if state_filter(state):
        df = df.filter(F.col("state") == state_filter(state))
    if "place_key" in unit:
        df = df.filter(F.coalesce("place_key", F.lit("")) != "")
    if year is not None:
        df = df.filter(F.col("year") == year)
    newest = df.agg(F.max("year")).scalar() if year is None else None
    if newest is not None:
        df = df.filter(F.col("year") == newest)
    if round_ is not None:
        df = df.filter(F.col("round") == round_)
    order = [F.desc("elected"), F.desc("round"), F.desc("votes"), F.asc("party"), F.asc_nulls_last("candidate"), F.asc("row")]
    kept = df.select("state", "place_key", "party", "votes", "status", "elected", "year", "round", "candidate", "row")
    return best_row(kept, unit, order).withColumn("espectro", labels.side(F.col("party"), sides))


def polarization(fact: Fact, view: str, state: str | None = None, year: int | None = None, round_: int | None = None) -> DataFrame:
    """view: federal (governors by state), municipal_uf (mayors by place) or municipal_brasil
    (per state the side with most mayors, its total and the party with most of them)."""
    if view == "federal":
        won = winners(fact, "GOVERNADOR", ["state"], year, round_, state)
        return won.select(F.col("state").alias("uf"), F.col("party").alias("partido"), "espectro", F.col("votes").alias("votos"), "status", F.col("elected").alias("eleito"), F.col("year").alias("ano"), F.col("round").alias("turno"))
    won = winners(fact, "PREFEITO", ["state", "place_key"], year, round_, state)
    if view == "municipal_brasil":  # at most one row per place, used twice below
        won = materialize(won.select("state", "party", "espectro", "votes", "year"), "winners")
    if view == "municipal_uf":
        return won.select(F.col("state").alias("uf"), F.col("place_key").alias("municipio"), F.col("party").alias("partido"), "espectro", F.col("votes").alias("votos"), "status", F.col("elected").alias("eleito"), F.col("year").alias("ano"), F.col("round").alias("turno"))
    sides = won.groupBy("state", "espectro").agg(F.count(F.lit(1)).alias("n"), F.sum("votes").alias("v"), F.max("year").alias("ano"))
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.col("v")).alias("v"), "espectro"))
    sides = sides.groupBy("state").agg(best["espectro"].alias("espectro"), F.sum("n").alias("total_prefeitos"), F.max("ano").alias("ano"))
    parties = won.groupBy("state", "party").agg(F.count(F.lit(1)).alias("n")).groupBy("state").agg(F.min(F.struct((-F.col("n")).alias("n"), "party"))["party"].alias("partido_representativo"))
    return sides.join(parties, "state").select(F.col("state").alias("uf"), "espectro", "partido_representativo", "total_prefeitos", "ano")


def official_totals(won: DataFrame, official: DataFrame) -> DataFrame:
    """municipal_brasil with the official number of mayors where that is larger."""
    return won.join(official, "uf", "left").withColumn("total_prefeitos", F.greatest("total_prefeitos", F.coalesce("oficial", F.lit(0)))).drop("oficial")


def unmapped_parties(fact: Fact, state: str | None = None, sides: dict[str, str] | None = None) -> DataFrame:
    """Winning mayors and governors of parties without a side, by party. sides: party -> side."""
    won = winners(fact, "GOVERNADOR", ["state"], None, None, state, sides).unionByName(winners(fact, "PREFEITO", ["state", "place_key"], None, None, state, sides))
    return won.filter(F.col("elected") & (F.col("espectro") == "indefinido")).groupBy(F.col("party").alias("partido")).agg(F.count(F.lit(1)).alias("total"))


def place_codes(fact: Fact) -> DataFrame:
    """Rows and votes of each place with its code: the smallest of its rows' codes, none if a row
    lacks one."""
    rows = fact.df.filter(F.col("state").isNotNull() & (F.coalesce("place_key", F.lit("")) != ""))
    unit = [F.col("state").alias("uf"), F.col("place_key").alias("municipio")]
    codes = rows.groupBy(*unit).agg(F.nullif(F.min(F.coalesce("place_code", F.lit(""))), F.lit("")).alias("codigo"))
    sums = rows.groupBy(*unit).agg(F.count(F.lit(1)).alias("linhas"), F.sum("votes").alias("votos"))
    return sums.join(codes, ["uf", "municipio"], "left")


def region_clusters(fact: Fact, scope: Scope) -> DataFrame:
    """Vote-weighted centres by state and by region."""
    ok = F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & ~((F.col("latitude") == 0) & (F.col("longitude") == 0))
    df = scope.apply(fact).df.filter(F.col("state").isNotNull() & ok & (F.col("votes") > 0))
    unit = df.groupBy("state").agg(F.sum(F.col("latitude") * F.col("votes")).alias("a"), F.sum(F.col("longitude") * F.col("votes")).alias("o"), F.sum("votes").alias("v"))
    five = lambda x: F.floor(x * 1e5 + 0.5) / 1e5
    shape = [five(F.sum("a") / F.sum("v")).alias("latitude"), five(F.sum("o") / F.sum("v")).alias("longitude"), F.sum("v").alias("votos")]
    by_state = unit.groupBy(F.lit("uf").alias("nivel"), F.col("state").alias("chave")).agg(*shape)
    return by_state.unionByName(unit.groupBy(F.lit("macrorregiao").alias("nivel"), labels.region(F.col("state")).alias("chave")).agg(*shape))
