"""Candidate queries over a bound Fact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sufragio.functions import labels
from sufragio.operators.fact import Fact
from sufragio.operators.filters import Scope, folded, is_candidate, search_key
from sufragio.operators.relational import latest_round, page, person_id, usual, with_share
from sufragio.session import materialize, measured

LEVELS = ("macroregiao", "uf", "municipio", "zona")


def search(fact: Fact, query: str, scope: Scope, number: int = 1, size: int = 20) -> DataFrame:
    """Candidates whose folded name contains the query: 3 points if equal, 2 if it begins so,
    1 if it contains it; by votes, points and name. Under 2 letters nothing is searched, under
    8 letters only within a scope."""
    key = search_key(query, scope)
    df = scope.apply(fact).df
    df = latest_round(df) if scope.round is None and fact.has("round") else df
    if key is None:
        df, key = df.filter(F.lit(False)), folded(query)
    name = F.col("name_key")
    hit = df.filter(F.contains(name, F.lit(key)))
    points = (name == key).cast("int") * 3 + F.startswith(name, F.lit(key)).cast("int") * 2 + 1
    group = {"candidato_id": "candidate", "candidato": "name", "partido": "party", "cargo": "office", "uf": "state", "numero": "number", "situacao": "status"}
    out = hit.groupBy(*[F.col(c).alias(a) for a, c in group.items()]).agg(F.sum("votes").alias("votos"), F.max(points).alias("pontos"), F.max("round").alias("turno"))
    return page(out, [F.desc("votos"), F.desc("pontos"), *[F.asc_nulls_first(a) for a in ("candidato", "candidato_id", "partido", "cargo", "uf", "numero", "situacao")]], number, size)


def standing(context: DataFrame, keys: Sequence[str | None]) -> tuple[int, list[int | None]]:
    """All votes of a contest, and the place of each candidate in keys by votes (ties by key): one
    more than the number of those before it, so no window spans all candidates."""
    sums = materialize(context.groupBy("candidate").agg(F.sum("votes").alias("votos")), "contest")
    got = sums.agg(F.sum("votos").alias("all"), *[F.max(F.when(F.col("candidate") == F.lit(k), F.col("votos"))).alias(f"own{i}") for i, k in enumerate(keys)]).first()
    ahead = []
    for i, k in enumerate(keys):
        own = F.lit(got[f"own{i}"])
        ahead.append(F.count_if(F.col("candidate").isNotNull() & ((F.col("votos") > own) | ((F.col("votos") == own) & (F.col("candidate") < F.lit(k))))).alias(f"n{i}"))
    n = sums.agg(*ahead).first()
    return got["all"] or 0, [None if got[f"own{i}"] is None else n[f"n{i}"] + 1 for i in range(len(keys))]


def first(column: str):
    """The column's value in the first row that has one."""
    return F.min(F.when(F.col(column).isNotNull(), F.struct("row", column)))[column].alias(column)


def identity(df: DataFrame) -> DataFrame:
    """One row: the usual person signature and number digits of the rows."""
    one = df.withColumn("all", F.lit(1))
    sig = usual(one, ["all"], "signature", "sig")
    cpf = usual(one, ["all"], "cpf", "nr_cpf")
    return sig.join(cpf, "all", "full").select(person_id(F.coalesce("sig", F.lit(""))).alias("person_id"), "nr_cpf")


def summary(fact: Fact, candidate: str, scope: Scope) -> DataFrame:
    """One row about a candidate's last year in scope (no row if unknown): votes by round, votes
    and share of the reference round, position in it, mandates and attributes. The candidate's
    rows reach the driver as one row per year and round."""
    rows = Scope(year=scope.year, state=scope.state, office=scope.office).apply(fact).df.filter(is_candidate(candidate))
    marks = ("state", "office", "status", "candidate", "name", "number", "party")
    firsts = [F.min(F.when(F.col(c).isNotNull(), F.struct("row", c))).alias(c) for c in marks]
    cells = rows.groupBy("year", "round").agg(F.sum("votes").alias("votes"), F.max("elected").alias("elected"), *firsts).collect()
    years = [r["year"] for r in cells if r["year"] is not None]
    if not years:
        return fact.df.sparkSession.createDataFrame([], SUMMARY)
    year = max(years)
    of = {r["round"]: r for r in cells if r["year"] == year}
    turn = max((t for t in of if t > 0), default=None)
    ref = scope.round if scope.round in (1, 2) else turn
    seen = of.get(ref)
    earliest = lambda c, among: min((r[c] for r in among if r[c] is not None), default=(None, None))[1]
    here = {c: earliest(c, [seen] if seen else []) for c in marks}
    total, place = None, [None]
    if seen:
        inside = (F.col("year") == year) & (F.col("round") == ref) & (F.col("state") == F.lit(here["state"])) & (F.lower("office") == F.lower(F.lit(here["office"])))
        total, place = standing(fact.df.filter(inside), [here["candidate"]])
    votes = seen["votes"] if seen else 0
    one = (
        candidate, *(earliest(c, cells) for c in ("name", "number", "party")), here["office"], here["state"], here["status"], len({r["year"] for r in cells if r["elected"] and r["year"] is not None}),
        year, ref, of[1]["votes"] if 1 in of else None, of[2]["votes"] if 2 in of else None, sum(r["votes"] for r in of.values()), votes, total, place[0],
    )
    out = fact.df.sparkSession.createDataFrame([one], ", ".join(f"{c} {t}" for c, t in zip(SUMMARY_COLUMNS[:-2], SUMMARY_TYPES)).replace("percentual double", "total bigint"))
    out = out.withColumn("percentual", labels.percent(F.col("votos"), F.col("total"), 4))
    out = out.withColumn("one", F.lit(1)).join(identity(rows).withColumn("one", F.lit(1)), "one")
    return out.select(*SUMMARY_COLUMNS)


SUMMARY_COLUMNS = ("candidato_id", "nome", "numero", "partido", "cargo", "uf", "situacao", "mandatos", "ano", "turno_referencia", "votos_primeiro_turno", "votos_segundo_turno", "votos_consolidados", "votos", "percentual", "posicao", "person_id", "nr_cpf")
SUMMARY_TYPES = ("string",) * 7 + ("bigint", "int", "int", "bigint", "bigint", "bigint", "bigint", "double", "bigint", "string", "string")
SUMMARY = ", ".join(f"{c} {t}" for c, t in zip(SUMMARY_COLUMNS, SUMMARY_TYPES))


def contexts(df: DataFrame) -> DataFrame:
    """Columns of the contest a row belongs to: year, office, round, and the state and place in
    which that office is contested."""
    area = labels.scope(F.col("office_key"))
    return df.withColumn("in_state", F.when(area == "nacional", F.lit("")).otherwise(F.coalesce("state", F.lit("")))).withColumn(
        "in_place", F.when(area == "municipio", F.coalesce("place_key", F.lit(""))).otherwise(F.lit(""))
    )


CONTEXT = ["year", "office_key", "round", "in_state", "in_place"]


def usual_signature(seed: DataFrame) -> str | None:
    got = usual(seed.withColumn("all", F.lit(1)), ["all"], "signature", "sig").select("sig").first()
    return got[0] if got else None


def persons_rows(fact: Fact, candidate: str, cpf: str | None = None, state: str | None = None, office: str | None = None) -> DataFrame:
    """All rows of the person behind a candidate: those with the usual signature of its rows in scope."""
    sig = usual_signature(Scope(state=state, office=office).apply(fact).df.filter(is_candidate(candidate, cpf)))
    return fact.df.filter(has_signature(sig))


def has_signature(sig: str | None):
    """Rows of a signature, told by the number alone where that can be, as names cost more."""
    if sig and sig.isdigit():
        return (F.col("cpf") == sig) | ((F.col("cpf") == "") & (F.col("name") == sig) & F.col("birth").isNull())
    return (F.col("cpf") == "") & (F.col("signature") == F.lit(sig))


def vote_history(fact: Fact, candidate: str, cpf: str | None = None, state: str | None = None, office: str | None = None) -> DataFrame:
    """One row per year, newest first: the later round, then the contest with more votes."""
    rows = contexts(persons_rows(fact, candidate, cpf, state, office)).filter(F.col("year").isNotNull() & F.col("office_key").isNotNull())
    own = rows.groupBy(*CONTEXT).agg(
        F.sum("votes").alias("votos"), first("state").alias("uf"), first("place").alias("municipio"), first("party").alias("partido"), first("number").alias("numero"), first("source_id"),
        F.when(F.max("elected"), "ELEITO").otherwise(first("status")).alias("situacao"),
    )
    own = materialize(own, "contests")
    # only the person's own contests are summed up; they are broadcast if they are as few as usual
    few, _ = measured(own.select(*CONTEXT))
    totals = contexts(fact.df).join(few, CONTEXT, "left_semi").groupBy(*CONTEXT).agg(F.sum("votes").alias("total"))
    out = own.join(totals, CONTEXT, "left")
    w = Window.partitionBy("year").orderBy(F.desc("round"), F.desc("votos"), "office_key", "in_state", "in_place")
    out = out.withColumn("n", F.row_number().over(w)).filter("n = 1")
    area = labels.scope(F.col("office_key"))
    return out.select(
        F.col("year").alias("ano"), F.col("office_key").alias("cargo"), F.col("round").alias("turno"), "uf", F.when(area == "municipio", F.col("municipio")).alias("municipio"), "partido", "numero", "source_id",
        "votos", labels.percent(F.col("votos"), F.col("total"), 4).alias("percentual"), "situacao",
    ).orderBy(F.desc("ano"))


def electorate_profile(fact: Fact, candidate: str, scope: Scope) -> DataFrame:
    """Vote-weighted shares of the candidate's rows by gender, age band and area, and the label of
    most weight for schooling and income."""
    rows = scope.apply(fact).df.filter(is_candidate(candidate))
    w = F.when(F.col("counted"), F.col("votes")).otherwise(1).cast("double")
    rows = rows.withColumn("w", w)
    g = F.col("gender_key")
    share = lambda c: labels.percent(F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0.0)), F.sum("w"), 4)
    age, area = F.col("age"), labels.fold_upper(F.col("area"))
    base = rows.agg(
        F.count(F.lit(1)).alias("linhas"), share(F.contains(g, F.lit("MASC"))).alias("masculino"), share(F.contains(g, F.lit("FEM"))).alias("feminino"),
        share((age >= 18) & (age <= 34)).alias("a18_34"), share((age >= 35) & (age <= 59)).alias("a35_59"), share(age >= 60).alias("a60_mais"), share(F.contains(area, F.lit("URBAN"))).alias("urbano"),
    ).filter("linhas > 0").withColumn("one", F.lit(1))
    for role, alias in (("education", "escolaridade"), ("income", "renda")):
        label = rows.groupBy(F.coalesce(role, F.lit("N/A")).alias("l")).agg(F.sum("w").alias("w")).agg(F.min(F.struct((-F.col("w")).alias("w"), "l"))["l"].alias(alias))
        base = base.join(label.withColumn("one", F.lit(1)), "one")
    return base.drop("one", "linhas")


def vote_distribution(fact: Fact, candidate: str, level: str, scope: Scope, sort: str | None = None, ascending: bool = False, number: int | None = None, size: int = 20) -> DataFrame:
    """A candidate's votes by region, state, place or zone, with shares; places also carry all
    valid votes cast there, from one pass over the scope."""
    df = scope.apply(fact).df
    mine = is_candidate(candidate)
    if level == "municipio":
        g = df.filter(F.col("place").isNotNull()).groupBy(F.col("place").alias("chave")).agg(
            F.sum(F.when(mine, F.col("votes"))).alias("votos"), F.sum("votes").alias("votos_municipio"), F.count_if(mine).alias("n"))
        out = with_share(g.filter("n > 0").drop("n"), "votos")
        out = out.withColumn("percentual_municipio", labels.percent(F.col("votos"), F.col("votos_municipio"))).withColumn("impacto", labels.impact(F.col("percentual")))
    else:
        rows = df.filter(mine)
        if level == "zona":
            g = rows.filter(F.col("zone").isNotNull()).groupBy(F.col("zone").alias("chave"), F.col("place").alias("municipio"), F.col("state").alias("uf")).agg(F.sum("votes").alias("votos"))
        else:
            label = labels.region(F.col("state")) if level == "macroregiao" else F.coalesce("state", F.lit("N/A"))
            g = rows.groupBy(label.alias("chave")).agg(F.sum("votes").alias("votos"))
        out = with_share(g, "votos", digits=4)  # zones or states of one candidate
        out = out.withColumn("impacto", labels.impact(F.col("percentual"))) if level == "zona" else out
    if sort is None and number is None:
        return out
    by = sort_key(out, level, sort)
    keys = [by.asc_nulls_last() if ascending else by.desc_nulls_last(), *[F.asc_nulls_last(c) for c in ("chave", "municipio", "uf") if c in out.columns]]
    return page(out, keys, number, size) if number is not None else out.orderBy(*keys)


#: Columns by which each level may be sorted; anything else means votes.
SORTABLE = {"macroregiao": ("chave", "votos", "percentual"), "uf": ("chave", "votos", "percentual"), "municipio": ("chave", "votos", "votos_municipio", "percentual", "percentual_municipio", "impacto"), "zona": ("chave", "municipio", "uf", "votos", "percentual", "impacto")}


def sort_key(out: DataFrame, level: str, sort: str | None) -> Column:
    """Codes are sorted as the texts they are, impact by its height."""
    if sort not in SORTABLE[level] or sort not in out.columns:
        return F.col("votos")
    return F.col("percentual") if sort == "impacto" else F.col(sort)


def compare(fact: Fact, candidates: Sequence[str], scope: Scope) -> DataFrame:
    """Votes, share, position and retention of two to four candidates in one contest."""
    if not 2 <= len(candidates) <= 4:
        raise ValueError("two to four candidates can be compared")
    inside = Scope(state=scope.state, office=scope.office).apply(fact)
    year = scope.year if scope.year is not None else inside.df.agg(F.max("year")).first()[0]
    # one pass over the rows of all of them, first by signature, then by candidate
    which = F.explode(F.filter(F.array(*[F.when(is_candidate(c), F.lit(i)) for i, c in enumerate(candidates)]), lambda i: i.isNotNull()))
    now = F.col("year") == F.lit(year)
    firsts = ("name", "party", "candidate")
    rows = inside.df.select("row", "year", "votes", "signature", *firsts, which.alias("i"))
    part = rows.groupBy("i", "signature").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(now, F.col("votes"))).alias("v"), *[F.min(F.when(now & F.col(c).isNotNull(), F.struct("row", c))).alias(c) for c in firsts]
    )
    known = F.when(F.col("signature") != "", F.struct((-F.col("n")).alias("n"), "signature"))
    got = {r["i"]: r for r in part.groupBy("i").agg(F.sum("v").alias("v"), F.min(known)["signature"].alias("sig"), *[F.min(c)[c].alias(c) for c in firsts]).collect()}
    there = [i for i in range(len(candidates)) if i in got and got[i]["v"] is not None]
    total, places = standing(inside.df.filter(now).select("candidate", "votes"), [got[i]["candidate"] for i in there]) if there else (0, [])
    kept_votes = retentions(inside.df, [got[i]["sig"] for i in there], year)
    out = [(candidates[i], got[i]["name"], got[i]["party"], got[i]["v"], total, p, *k) for i, p, k in zip(there, places, kept_votes)]
    shape = "candidato_id string, nome string, partido string, votos bigint, total bigint, posicao bigint, agora bigint, antes bigint"
    few = fact.df.sparkSession.createDataFrame(out, shape)  # at most four rows
    kept = F.when(F.coalesce("antes", F.lit(0)) > 0, labels.percent(F.col("agora"), F.col("antes"), 4)).otherwise(100.0)
    return few.select("candidato_id", "nome", "partido", "votos", labels.percent(F.col("votos"), F.col("total"), 4).alias("percentual"), "posicao", kept.alias("retencao"))


def retentions(df: DataFrame, signatures: Sequence[str | None], year: int | None) -> list[tuple[int | None, int | None]]:
    """For each signature: votes of the year's first contest and of the oldest earlier one, where
    contests are ordered by year and round (both falling), office, and votes (falling)."""
    which = F.explode(F.filter(F.array(F.lit(None).cast("int"), *[F.when(has_signature(s), F.lit(i)) for i, s in enumerate(signatures)]), lambda i: i.isNotNull()))
    rows = df.filter(F.col("year").isNotNull()).select(which.alias("i"), "year", F.coalesce("office_key", F.lit("")).alias("office"), "round", "votes")
    groups = rows.groupBy("i", "year", "office", "round").agg(F.sum("votes").alias("v"))
    now, before = F.col("year") == F.lit(year), F.col("year") < F.lit(year)
    latest = F.min(F.when(now, F.struct((-F.col("round")).alias("r"), "office", (-F.col("v")).alias("v"))))["v"]
    # the last of the falling order: smallest year and round, then the largest office
    oldest = F.min(F.when(before, F.struct("year", "round")))
    got = {r["i"]: -r["v"] if r["v"] is not None else None for r in groups.groupBy("i").agg(latest.alias("v")).collect()}
    first = groups.filter(before).join(groups.groupBy("i").agg(oldest.alias("o")), "i").filter((F.col("year") == F.col("o.year")) & (F.col("round") == F.col("o.round")))
    base = {r["i"]: r["m"]["v"] for r in first.groupBy("i").agg(F.max(F.struct("office", (-F.col("v")).alias("n"), "v")).alias("m")).collect()}
    return [(got.get(i), base.get(i)) for i in range(len(signatures))]


def deltas(compared: DataFrame) -> DataFrame:
    """Best candidate and gap to the second per metric; compared has at most four rows."""
    long = compared.select("candidato_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metrica"), F.col(m).cast("double").alias("valor")) for m in ("votos", "percentual", "retencao")])).alias("x")).select("candidato_id", "x.*")
    best = F.sort_array(F.collect_list(F.struct((-F.col("valor")).alias("v"), "candidato_id")))
    return long.groupBy("metrica").agg(best.alias("b")).filter(F.size("b") > 1).select("metrica", F.col("b")[0]["candidato_id"].alias("melhor"), (F.floor((F.col("b")[1]["v"] - F.col("b")[0]["v"]) * 1e4 + 0.5) / 1e4).alias("vantagem"))


def municipal_scope(fact: Fact, candidate: str, scope: Scope) -> DataFrame:
    """State and place where a municipal candidate has most votes, and whether others were open."""
    rows = scope.apply(fact).df.filter(is_candidate(candidate) & F.col("state").isNotNull() & F.col("place").isNotNull())
    g = rows.groupBy(F.col("state").alias("uf"), F.col("place_key").alias("municipio")).agg(F.sum("votes").alias("votos"))
    best = F.min(F.struct((-F.col("votos")).alias("v"), "uf", "municipio")).alias("b")
    out = g.agg(best, F.count(F.lit(1)).alias("n")).filter("n > 0")
    return out.select(F.col("b.uf").alias("uf"), F.col("b.municipio").alias("municipio"), (-F.col("b.v")).alias("votos"), ((F.col("n") > 1) & F.lit(not (scope.state and scope.place))).alias("ambiguo"))


def zone_distribution_with_fallback(fact: Fact, candidate: str, scope: Scope) -> DataFrame:
    """Votes by zone in round two, or in round one if that is empty, as one plan: the round that
    counts is a scalar over the candidate's rows."""
    wide = Scope(scope.year, None, scope.state, scope.office, scope.party, scope.place)
    rows = wide.apply(fact).df.filter(is_candidate(candidate) & F.col("zone").isNotNull() & (F.col("round") <= (scope.round or 2)))
    used = rows.agg(F.max("round")).scalar()
    g = rows.filter(F.col("round") == used).groupBy(F.col("zone").alias("chave"), F.col("place").alias("municipio"), F.col("state").alias("uf"), F.col("round").alias("turno")).agg(F.sum("votes").alias("votos"))
    out = with_share(g, "votos", digits=4)
    return out.withColumn("usou_outro_turno", F.col("turno") != (scope.round or 2))
