"""The registered queries over the analytics table, each with its SQL. The candidate queries take
the smallest keys of an office's latest year, a rule that both sides evaluate on any data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sufragio.functions import labels
from sufragio.functions.text import ACCENTED, PLAIN
from sufragio.operators import etl
from sufragio.operators.fact import Fact, bind
from sufragio.operators.filters import Scope
from sufragio.operators.relational import METRICS, person_id
from sufragio.plans import aggregates as A
from sufragio.plans import candidates as C
from sufragio.session import table

YEAR, TURN, STATE, OFFICE, PARTY, NAME = 2022, 1, "SP", "Vereador", "PT", "MARIA"


def fact(spark: SparkSession, folder: str) -> Fact:
    return bind(table(spark, folder, "analytics"))


def first_candidates(f: Fact, office: str, n: int) -> list[str]:
    rows = f.df.filter((F.col("office_key") == office) & F.col("source_id").isNotNull()).groupBy("source_id").agg(F.max("year").alias("y"))
    rows = rows.orderBy(F.desc_nulls_last("y"), "source_id").limit(n).collect()
    return [r[0] for r in rows] or ["0"]


def _q(build):
    return lambda spark, folder: build(fact(spark, folder))


def _c(office: str, n: int, build):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        f = fact(spark, folder)
        got = first_candidates(f, office, n)
        return build(f, got + ["-"] * (n - len(got)))

    return run


# ---- SQL -------------------------------------------------------------------------------------
_BLANK = "\\s\\x{00A0}\\x{2000}-\\x{200D}\\x{2060}\\x{FEFF}"


def _s(c: str) -> str:
    return f"nullif(regexp_replace(CAST({c} AS VARCHAR), '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g'), '')"


def _fold(c: str) -> str:
    return f"trim(upper(regexp_replace(trim(regexp_replace(translate(coalesce({_s(c)}, ''), '{ACCENTED}', '{PLAIN}'), '[^\\x00-\\x7F]', '', 'g')), '\\s+', ' ', 'g')))"


def _case(c: str, pairs: dict[str, str], default: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {default} END"


_DAY = "coalesce(try_strptime({0}, '%d/%m/%Y'), try_strptime({0}, '%Y-%m-%d'))::DATE"
_NUM = "try_cast({0} AS DOUBLE)"
_PLAIN = "coalesce(nullif(trim(upper(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))), ''), 'N/A')"
_GENDER = f"CASE WHEN gkey = 'M' OR gkey LIKE 'MASC%' THEN 'MASCULINO' WHEN gkey = 'F' OR gkey LIKE 'FEM%' THEN 'FEMININO' ELSE {_PLAIN.format('gender')} END"
_RACE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(rkey, '{p}')" for p in parts) + f" THEN '{name}'" for name, parts in labels.RACES.items()) + f" ELSE '{labels.RACE_UNKNOWN}' END"
_SIDES = labels.SIDE_OF_PARTY
_OFFICES = "('" + "','".join(labels.MUNICIPAL_OFFICES) + "')"
_NATION = "('" + "','".join(labels.NATIONAL_OFFICES) + "')"
_NONE = "('" + "','".join(labels.NO_ANSWER) + "')"

BASE = f"""WITH b AS (SELECT row_id AS "row", CAST({_NUM.format(_s('ANO_ELEICAO'))} AS INT) AS year,
  coalesce(CAST(trunc({_NUM.format(_s('NR_TURNO'))}) AS INT), 0) AS round, upper({_s('SG_UF')}) AS state, {_s('DS_CARGO')} AS office, upper({_s('DS_CARGO')}) AS office_key,
  {_s('SG_PARTIDO')} AS party, {_s('NM_UE')} AS place, {_case(_fold('NM_UE'), labels.PLACE_ALIASES, _fold('NM_UE'))} AS place_key, {_s('DS_SIT_TOT_TURNO')} AS status,
  coalesce(upper({_s('DS_SIT_TOT_TURNO')}) LIKE 'ELEITO%', FALSE) AS elected, coalesce(QT_VOTOS_NOMINAIS_VALIDOS, 0) AS votes, QT_VOTOS_NOMINAIS_VALIDOS IS NOT NULL AS counted,
  {_s('SQ_CANDIDATO')} AS source_id, {_s('NR_CANDIDATO')} AS number, {_s('NM_CANDIDATO')} AS full_name, {_s('NM_URNA_CANDIDATO')} AS ballot_name,
  regexp_replace(coalesce(NR_CPF_CANDIDATO, ''), '[^0-9]', '', 'g') AS cpf, {_DAY.format(_s('DT_NASCIMENTO'))} AS birth, {_DAY.format(_s('DT_ELEICAO'))} AS held, CAST(IDADE AS DOUBLE) AS own_age,
  {_s('NR_ZONA')} AS zone, {_s('DS_GENERO')} AS gender, {_fold('DS_GENERO')} AS gkey, {_s('DS_GRAU_INSTRUCAO')} AS education, {_s('DS_COR_RACA')} AS race, {_fold('DS_COR_RACA')} AS rkey,
  {_s('DS_ESTADO_CIVIL')} AS civil, {_s('DS_OCUPACAO')} AS occupation, LATITUDE AS latitude, LONGITUDE AS longitude FROM analytics),
n AS (SELECT *, CASE WHEN length(coalesce(full_name, '')) >= length(coalesce(ballot_name, '')) THEN coalesce(full_name, ballot_name) ELSE ballot_name END AS name FROM b),
f AS (SELECT *, {_fold('name')} AS name_key, coalesce(source_id, number, lower(name)) AS candidate,
  CASE WHEN cpf <> '' THEN cpf ELSE concat_ws('|', nullif({_fold('name')}, ''), strftime(birth, '%Y-%m-%d')) END AS signature,
  coalesce(own_age, round_even(date_diff('day', birth, held) / 365.25, 0)) AS age FROM n)
"""
LAST = ", l AS (SELECT * FROM f WHERE {where} AND year IS NOT NULL AND candidate IS NOT NULL QUALIFY round = max(round) OVER (PARTITION BY candidate, year))\n"
_METRIC = {"votos_nominais": "coalesce(sum(votes), 0)::BIGINT", "candidatos": "count(DISTINCT candidate)", "eleitos": "count(*) FILTER (WHERE elected)", "registros": "count(*)"}


def _pct(part: str, whole: str, digits: int = 2) -> str:
    scale = 10.0**digits
    return f"CASE WHEN ({whole}) > 0 THEN floor(CAST({part} AS DOUBLE) * {100.0 * scale:e} / CAST({whole} AS DOUBLE) + 0.5) / {scale:e} ELSE 0e0 END"


def _where(year=None, turn=None, state=None, office=None, party=None, elected=False) -> str:
    parts = [f"year = {year}" if year else "", f"round = {turn}" if turn else "", f"state = '{state}'" if state else "", f"lower(office) = '{office.lower()}'" if office else "", f"{_fold('party')} = '{party}'" if party else "", "elected" if elected else ""]
    return " AND ".join(p for p in parts if p) or "TRUE"


def _shared(inner: str, value: str, name: str = "percentual", digits: int = 2) -> str:
    return f"SELECT *, {_pct(value, f'(SELECT sum({value}) FROM x)', digits)} AS {name} FROM x".join([f", x AS ({inner})\n", ""])


def _winners(office: str, unit: str) -> str:
    place = "AND coalesce(place_key, '') <> ''" if "place" in unit else ""
    return f"""SELECT *, {_case(_fold('party'), _SIDES, "'indefinido'")} AS espectro FROM f WHERE office_key = '{office}' AND state IS NOT NULL AND party IS NOT NULL {place}
  AND year = (SELECT max(year) FROM f WHERE office_key = '{office}' AND state IS NOT NULL AND party IS NOT NULL {place})
  QUALIFY row_number() OVER (PARTITION BY {unit} ORDER BY elected DESC, round DESC, votes DESC, party, candidate NULLS LAST, "row") = 1"""


def _top(where: str, size: int = 20, offset: int = 0) -> str:
    return (
        BASE + LAST.format(where=where) + f""", a AS (SELECT candidate, sum(votes) AS votos, max(round) FILTER (WHERE round > 0) AS turno_referencia, sum(votes) FILTER (WHERE round = 1) AS votos_primeiro_turno,
  sum(votes) FILTER (WHERE round = 2) AS votos_segundo_turno, CASE WHEN min(state) = max(state) THEN min(state) END AS uf FROM l GROUP BY candidate),
g AS (SELECT candidate, signature, count(*) AS n FROM l GROUP BY ALL),
w AS (SELECT candidate, signature FROM g QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY signature = '', n DESC, signature) = 1),
r AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY "row") = 1)
SELECT a.candidate AS candidato_id, r.name AS candidato, r.party AS partido, r.office AS cargo, a.uf, r.status AS situacao, r.number AS numero, votos::BIGINT AS votos, turno_referencia,
  votos_primeiro_turno::BIGINT AS votos_primeiro_turno, votos_segundo_turno::BIGINT AS votos_segundo_turno, 'person:' || sha1(w.signature) AS person_id
FROM a JOIN w USING (candidate) JOIN r USING (candidate) ORDER BY votos DESC, r.name NULLS FIRST, a.candidate LIMIT {size} OFFSET {offset}"""
    )


_LABEL = {"status": _PLAIN.format("status"), "genero": _GENDER, "instrucao": _PLAIN.format("education"), "cor_raca": _RACE, "estado_civil": _PLAIN.format("civil"), "ocupacao": _PLAIN.format("occupation"), "cargo": _PLAIN.format("office")}


def _distribution(dimension: str, where: str) -> str:
    if dimension == "uf":
        return BASE + _shared(f"SELECT state AS rotulo, count(*) AS total FROM f WHERE {where} AND state IS NOT NULL GROUP BY state", "total")
    unknown = f"label = '{labels.RACE_UNKNOWN}'" if dimension == "cor_raca" else f"{_fold('label')} IN {_NONE}"
    return (
        BASE + f""", c AS (SELECT candidate, year, round, office_key, {_LABEL[dimension]} AS label, count(*) AS n FROM f WHERE {where} AND candidate IS NOT NULL GROUP BY ALL),
p AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY candidate, year, round, office_key ORDER BY {_fold('label')} IN {_NONE}, n DESC, label) = 1)"""
        + _shared(f"SELECT label AS rotulo, count(*) AS total FROM p WHERE NOT ({unknown}) GROUP BY label", "total")
    )


def _id(office: str, k: int) -> str:
    return f"coalesce((SELECT source_id FROM f WHERE office_key = '{office}' AND source_id IS NOT NULL GROUP BY source_id ORDER BY max(year) DESC NULLS LAST, source_id LIMIT 1 OFFSET {k}), '-')"


def _is(c: str) -> str:
    return f"(coalesce(source_id, '') = {c} OR coalesce(number, '') = {c} OR name_key = {c} OR (cpf = {c} AND {c} <> '-'))"


_SCOPE_OF = f"CASE WHEN office_key IN {_OFFICES} THEN 'municipio' WHEN office_key IN {_NATION} THEN 'nacional' ELSE 'uf' END"
_CTX = f"""ctx AS (SELECT *, CASE WHEN office_key IN {_NATION} THEN '' ELSE coalesce(state, '') END AS in_state, CASE WHEN office_key IN {_OFFICES} THEN coalesce(place_key, '') ELSE '' END AS in_place FROM f)"""


def _persona(c: str) -> str:
    """Signature of a candidate's person."""
    return f"(SELECT signature FROM f WHERE {_is(c)} AND signature <> '' GROUP BY signature ORDER BY count(*) DESC, signature LIMIT 1)"


def _summary() -> str:
    c = "(SELECT k FROM key)"
    first = lambda x: f"(SELECT {x} FROM o WHERE {x} IS NOT NULL ORDER BY \"row\" LIMIT 1)"
    anyof = lambda x: f"(SELECT {x} FROM r WHERE {x} IS NOT NULL ORDER BY \"row\" LIMIT 1)"
    return BASE + f""", key AS (SELECT {_id('PREFEITO', 0)} AS k), r AS (SELECT * FROM f WHERE {_is(c)}), y AS (SELECT * FROM r WHERE year = (SELECT max(year) FROM r)),
o AS (SELECT * FROM y WHERE round = (SELECT max(round) FILTER (WHERE round > 0) FROM y)),
t AS (SELECT candidate, sum(votes) AS v, sum(sum(votes)) OVER () AS dummy FROM f WHERE year = (SELECT max(year) FROM r) AND round = (SELECT max(round) FILTER (WHERE round > 0) FROM y)
  AND state = {first('state')} AND lower(office) = lower({first('office')}) GROUP BY candidate),
z AS (SELECT candidate, row_number() OVER (ORDER BY v DESC, candidate) AS p FROM t WHERE candidate IS NOT NULL)
SELECT {c} AS candidato_id, {anyof('name')} AS nome, {anyof('number')} AS numero, {anyof('party')} AS partido, {first('office')} AS cargo, {first('state')} AS uf, {first('status')} AS situacao,
  (SELECT count(DISTINCT year) FROM r WHERE elected) AS mandatos, (SELECT max(year) FROM r) AS ano, (SELECT max(round) FILTER (WHERE round > 0) FROM y) AS turno_referencia,
  (SELECT sum(votes) FROM y WHERE round = 1)::BIGINT AS votos_primeiro_turno, (SELECT sum(votes) FROM y WHERE round = 2)::BIGINT AS votos_segundo_turno, (SELECT sum(votes) FROM y)::BIGINT AS votos_consolidados,
  coalesce((SELECT sum(votes) FROM o), 0)::BIGINT AS votos, {_pct('(SELECT sum(votes) FROM o)', '(SELECT sum(v) FROM t)', 4)} AS percentual, (SELECT p FROM z WHERE candidate = {first('candidate')}) AS posicao,
  'person:' || sha1(coalesce({_persona(c)}, '')) AS person_id, (SELECT cpf FROM r WHERE cpf <> '' GROUP BY cpf ORDER BY count(*) DESC, cpf LIMIT 1) AS nr_cpf FROM key WHERE EXISTS (SELECT 1 FROM r WHERE year IS NOT NULL)"""


def _history() -> str:
    c = "(SELECT k FROM key)"
    first = lambda x: f"arg_min({x}, \"row\") FILTER (WHERE {x} IS NOT NULL)"
    return BASE + f""", key AS (SELECT {_id('PREFEITO', 0)} AS k), {_CTX},
o AS (SELECT year, office_key, round, in_state, in_place, sum(votes) AS votos, {first('state')} AS uf, {first('place')} AS municipio, {first('party')} AS partido, {first('number')} AS numero, {first('source_id')} AS source_id,
  CASE WHEN bool_or(elected) THEN 'ELEITO' ELSE {first('status')} END AS situacao FROM ctx WHERE signature = {_persona(c)} AND year IS NOT NULL AND office_key IS NOT NULL GROUP BY ALL),
t AS (SELECT year, office_key, round, in_state, in_place, sum(votes) AS total FROM ctx GROUP BY ALL),
z AS (SELECT o.*, total FROM o JOIN t USING (year, office_key, round, in_state, in_place) QUALIFY row_number() OVER (PARTITION BY year ORDER BY round DESC, votos DESC, office_key, in_state, in_place) = 1)
SELECT year AS ano, office_key AS cargo, round AS turno, uf, CASE WHEN {_SCOPE_OF} = 'municipio' THEN municipio END AS municipio, partido, numero, source_id, votos::BIGINT AS votos, {_pct('votos', 'total', 4)} AS percentual, situacao FROM z"""


def _profile() -> str:
    c = "(SELECT k FROM key)"
    share = lambda cond: _pct(f"coalesce(sum(w) FILTER (WHERE {cond}), 0)", "sum(w)", 4)
    return BASE + f""", key AS (SELECT {_id('PREFEITO', 0)} AS k), r AS (SELECT *, CAST(CASE WHEN counted THEN votes ELSE 1 END AS DOUBLE) AS w FROM f WHERE {_is(c)})
SELECT {share("contains(gkey, 'MASC')")} AS masculino, {share("contains(gkey, 'FEM')")} AS feminino, {share('age >= 18 AND age <= 34')} AS a18_34, {share('age >= 35 AND age <= 59')} AS a35_59, {share('age >= 60')} AS a60_mais, 0e0 AS urbano,
  (SELECT coalesce(education, 'N/A') FROM r GROUP BY 1 ORDER BY sum(w) DESC, 1 LIMIT 1) AS escolaridade, 'N/A' AS renda FROM r HAVING count(*) > 0"""


def _votes_by(level: str) -> str:
    c = "(SELECT k FROM key)"
    head = BASE + f", key AS (SELECT {_id('DEPUTADO ESTADUAL', 0)} AS k)"
    if level == "municipio":
        x = f"SELECT place AS chave, sum(votes) FILTER (WHERE {_is(c)})::BIGINT AS votos, sum(votes)::BIGINT AS votos_municipio FROM f WHERE place IS NOT NULL GROUP BY place HAVING count(*) FILTER (WHERE {_is(c)}) > 0"
        share = _pct("votos", "(SELECT sum(votos) FROM x)")
        return f"{head}, x AS ({x}), y AS (SELECT *, {share} AS percentual, {_pct('votos', 'votos_municipio')} AS percentual_municipio FROM x) SELECT *, CASE WHEN percentual >= 1 THEN 'Alto' WHEN percentual >= 0.3 THEN 'Médio' ELSE 'Baixo' END AS impacto FROM y"
    share = _pct("votos", "(SELECT sum(votos) FROM x)", 4)
    if level == "zona":
        x = f"SELECT zone AS chave, place AS municipio, state AS uf, sum(votes)::BIGINT AS votos FROM f WHERE {_is(c)} AND zone IS NOT NULL GROUP BY ALL"
        return f"{head}, x AS ({x}), y AS (SELECT *, {share} AS percentual FROM x) SELECT *, CASE WHEN percentual >= 1 THEN 'Alto' WHEN percentual >= 0.3 THEN 'Médio' ELSE 'Baixo' END AS impacto FROM y"
    label = _case("state", labels.REGION_OF_STATE, "'N/A'") if level == "macroregiao" else "coalesce(state, 'N/A')"
    return f"{head}, x AS (SELECT {label} AS chave, sum(votes)::BIGINT AS votos FROM f WHERE {_is(c)} GROUP BY 1) SELECT *, {share} AS percentual FROM x"


def _compare_sql(office: str) -> str:
    parts = []
    for k in (0, 1):
        c = f"(SELECT k{k} FROM key)"
        g = f"SELECT year, coalesce(office_key, '') AS office, round, sum(votes) AS v FROM f WHERE signature = {_persona(c)} AND year IS NOT NULL GROUP BY ALL"
        # persona within the office's rows, as the comparison is scoped by it
        g = g.replace("FROM f WHERE signature", "FROM i WHERE signature").replace("FROM f WHERE", "FROM i WHERE")
        now = f"(SELECT v FROM ({g}) WHERE year = (SELECT y FROM yy) ORDER BY round DESC, office, v DESC LIMIT 1)"
        old = f"(SELECT v FROM ({g}) WHERE year < (SELECT y FROM yy) ORDER BY year, round, office DESC, v LIMIT 1)"
        rows = f"(SELECT * FROM i WHERE year = (SELECT y FROM yy) AND {_is(c)})"
        first = lambda x: f"(SELECT {x} FROM {rows} WHERE {x} IS NOT NULL ORDER BY \"row\" LIMIT 1)"  # noqa: B023, E731
        ret = _pct(now, old, 4)
        parts.append(f"""SELECT {c} AS candidato_id, {first('name')} AS nome, {first('party')} AS partido, (SELECT sum(votes) FROM {rows})::BIGINT AS votos, {_pct(f'(SELECT sum(votes) FROM {rows})', '(SELECT sum(votes) FROM i WHERE year = (SELECT y FROM yy))', 4)} AS percentual,
  (SELECT p FROM z WHERE candidate = {first('candidate')}) AS posicao, CASE WHEN coalesce({old}, 0) > 0 THEN {ret} ELSE 100e0 END AS retencao WHERE EXISTS (SELECT 1 FROM {rows})""")
    return f""", key AS (SELECT {_id(office, 0)} AS k0, {_id(office, 1)} AS k1), i AS (SELECT * FROM f WHERE lower(office) = '{office.lower()}'), yy AS (SELECT max(year) AS y FROM i),
z AS (SELECT candidate, row_number() OVER (ORDER BY sum(votes) DESC, candidate) AS p FROM i WHERE year = (SELECT y FROM yy) AND candidate IS NOT NULL GROUP BY candidate),
cmp AS ({' UNION ALL '.join(parts)})
"""


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


_add("filter_options_anos", _q(lambda f: A.options(f, "anos")), BASE + "SELECT DISTINCT year AS ano FROM f WHERE year IS NOT NULL")
_add("filter_options_ufs", _q(lambda f: A.options(f, "ufs")), BASE + "SELECT DISTINCT state AS uf FROM f WHERE state IN ('" + "','".join(labels.STATES) + "')")
_add("filter_options_cargos", _q(lambda f: A.options(f, "cargos")), BASE + "SELECT DISTINCT office AS cargo FROM f WHERE office IS NOT NULL")
_ALL = ", ".join(f"{_METRIC[m]} AS {m}" for m in ("candidatos", "eleitos", "votos_nominais", "registros"))
_add("overview", _q(lambda f: A.overview(f, Scope(YEAR, TURN))), BASE + f"SELECT {_ALL} FROM f WHERE {_where(YEAR, TURN)}")
_add("overview_latest_round", _q(lambda f: A.overview(f, Scope(YEAR))), BASE + LAST.format(where=_where(YEAR)) + f"SELECT {_ALL} FROM l")
_add("overview_office", _q(lambda f: A.overview(f, Scope(state=STATE, office=OFFICE))), BASE + LAST.format(where=_where(state=STATE, office=OFFICE)) + f"SELECT {_ALL} FROM l")
_add(
    "overview_presidential", _q(lambda f: A.overview(f, Scope(office="Presidente"))),
    BASE + LAST.format(where=_where(office="Presidente")) + "SELECT count(*) AS candidatos, count(*) FILTER (WHERE e) AS eleitos, sum(v)::BIGINT AS votos_nominais, count(*) AS registros FROM (SELECT candidate, bool_or(elected) AS e, sum(votes) AS v FROM l GROUP BY candidate)",
)
_add("top_candidates", _q(lambda f: A.top_candidates(f, Scope(YEAR))), _top(_where(YEAR)))
_add("top_candidates_page2", _q(lambda f: A.top_candidates(f, Scope(YEAR), 2)), _top(_where(YEAR), 20, 20))
_add("top_candidates_party", _q(lambda f: A.top_candidates(f, Scope(party=PARTY))), _top(_where(party=PARTY)))
for _d in A.DIMENSIONS:
    _add(f"distribution_{_d}", _q(lambda f, d=_d: A.distribution(f, d, Scope(office=OFFICE))), _distribution(_d, _where(office=OFFICE)))
_add("distribution_elected", _q(lambda f: A.distribution(f, "genero", Scope(elected_only=True))), _distribution("genero", _where(elected=True)))
_races = ", ".join(f"({i}, '{r}')" for i, r in enumerate(labels.RACES))
_add(
    "race_comparison", _q(lambda f: A.race_comparison(f, Scope(YEAR))),
    BASE + f""", x AS (SELECT ordem, categoria, coalesce(candidatos, 0) AS candidatos, coalesce(eleitos, 0) AS eleitos FROM (VALUES {_races}) v(ordem, categoria) LEFT JOIN
  (SELECT {_RACE} AS categoria, count(*) AS candidatos, count(*) FILTER (WHERE elected) AS eleitos FROM f WHERE {_where(YEAR)} GROUP BY 1) USING (categoria))
SELECT *, {_pct('candidatos', '(SELECT sum(candidatos) FROM x)')} AS parte_candidatos, {_pct('eleitos', '(SELECT sum(eleitos) FROM x)')} AS parte_eleitos FROM x""",
)
_add(
    "occupation_gender", _q(lambda f: A.occupation_by_gender(f, Scope())),
    BASE + f""", x AS (SELECT {_LABEL['ocupacao']} AS ocupacao, {_GENDER} AS g FROM f)
SELECT ocupacao, count(*) FILTER (WHERE g = 'MASCULINO') AS masculino, count(*) FILTER (WHERE g = 'FEMININO') AS feminino FROM x WHERE {_fold('ocupacao')} NOT IN {_NONE} GROUP BY ocupacao
HAVING count(*) FILTER (WHERE g IN ('MASCULINO', 'FEMININO')) > 0""",
)
_six = lambda x: f"floor(({x}) * 1e6 + 0.5) / 1e6"
_add(
    "age_stats", _q(lambda f: A.age_statistics(f, Scope(elected_only=True))),
    BASE + f"""SELECT count(age) AS n, {_six('sum(age) / count(age)')} AS media, {_six('median(age)')} AS mediana, min(age) AS minima, max(age) AS maxima,
  {_six('sqrt(greatest(sum(age * age) / count(age) - (sum(age) / count(age)) * (sum(age) / count(age)), 0e0))')} AS desvio FROM f WHERE elected""",
)
_add(
    "age_bins", _q(lambda f: A.age_bins(f, Scope())),
    BASE + "SELECT r.de::INT AS de, (r.de + 9)::INT AS ate, count(age) AS total FROM range(20, 90, 10) r(de) LEFT JOIN f ON age >= r.de AND age < r.de + 10 GROUP BY r.de",
)
for _m in METRICS:
    _add(f"time_series_{_m}", _q(lambda f, m=_m: A.time_series(f, m, Scope(office=OFFICE))), BASE + f"SELECT year AS ano, {_METRIC[_m]} AS valor FROM f WHERE {_where(office=OFFICE)} AND year IS NOT NULL GROUP BY year")
    _add(f"uf_map_{_m}", _q(lambda f, m=_m: A.state_map(f, m, Scope(YEAR))), BASE + _shared(f"SELECT state AS uf, {_METRIC[_m]} AS valor FROM f WHERE {_where(YEAR)} AND state IS NOT NULL GROUP BY state", "valor"))
_BY = {"candidato": "coalesce(name, 'N/A')", "partido": "coalesce(party, 'N/A')", "cargo": _LABEL["cargo"], "uf": "coalesce(state, 'N/A')"}
for _b, _m in (("candidato", "votos_nominais"), ("partido", "votos_nominais"), ("partido", "candidatos"), ("partido", "eleitos"), ("partido", "registros"), ("cargo", "votos_nominais"), ("uf", "candidatos")):
    _add(f"ranking_{_b}_{_m}", _q(lambda f, b=_b, m=_m: A.ranking(f, b, m, Scope(YEAR))), BASE + _shared(f"SELECT {_BY[_b]} AS rotulo, {_METRIC[_m]} AS valor FROM f WHERE {_where(YEAR)} GROUP BY 1 ORDER BY valor DESC, rotulo LIMIT 20", "valor"))
_UNIT = f"SELECT DISTINCT {{label}} AS rotulo, year, CASE WHEN office_key IN {_NATION} THEN 'BR' ELSE state END AS us, office_key, CASE WHEN office_key IN {_OFFICES} THEN place_key END AS up, candidate FROM f WHERE elected AND candidate IS NOT NULL"
for _b, _l in (("cargo", "coalesce(office_key, 'N/A')"), ("uf", f"coalesce(CASE WHEN office_key IN {_NATION} THEN 'BR' ELSE state END, 'N/A')"), ("municipio", "coalesce(place_key, 'N/A')")):
    _only = f" AND office_key IN {_OFFICES}" if _b == "municipio" else ""
    _add(f"vacancies_{_b}", _q(lambda f, b=_b: A.seats(f, b, Scope())), BASE + f"SELECT rotulo, count(*) AS vagas FROM ({_UNIT.format(label=_l)}{_only}) GROUP BY rotulo")
_FED = "state AS uf, party AS partido, espectro, votes AS votos, status, elected AS eleito, year AS ano, round AS turno"
_add("polarization_federal", _q(lambda f: A.polarization(f, "federal")), BASE + f"SELECT {_FED} FROM ({_winners('GOVERNADOR', 'state')})")
_add("polarization_municipal_uf", _q(lambda f: A.polarization(f, "municipal_uf")), BASE + f"SELECT place_key AS municipio, {_FED} FROM ({_winners('PREFEITO', 'state, place_key')})")
_add(
    "polarization_municipal_brasil", _q(lambda f: A.polarization(f, "municipal_brasil")),
    BASE + f""", w AS ({_winners('PREFEITO', 'state, place_key')}),
s AS (SELECT state, espectro FROM w GROUP BY state, espectro QUALIFY row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, sum(votes) DESC, espectro) = 1),
p AS (SELECT state, party FROM w GROUP BY state, party QUALIFY row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, party) = 1)
SELECT state AS uf, espectro, party AS partido_representativo, n AS total_prefeitos, ano FROM s JOIN p USING (state) JOIN (SELECT state, count(*) AS n, max(year) AS ano FROM w GROUP BY state) USING (state)""",
)
_add(
    "polarization_audit", _q(A.unmapped_parties),
    BASE + f"SELECT party AS partido, count(*) AS total FROM (SELECT party, elected, espectro FROM ({_winners('GOVERNADOR', 'state')}) UNION ALL SELECT party, elected, espectro FROM ({_winners('PREFEITO', 'state, place_key')})) WHERE elected AND espectro = 'indefinido' GROUP BY party",
)
_add(
    "search", _q(lambda f: C.search(f, NAME, Scope(YEAR, office="Deputado Estadual"))),
    BASE + LAST.format(where=_where(YEAR, office="Deputado Estadual")) + f"""SELECT candidate AS candidato_id, name AS candidato, party AS partido, office AS cargo, state AS uf, number AS numero, status AS situacao, sum(votes)::BIGINT AS votos,
  max((name_key = '{NAME}')::INT * 3 + starts_with(name_key, '{NAME}')::INT * 2 + 1) AS pontos, max(round) AS turno FROM l WHERE contains(name_key, '{NAME}') GROUP BY candidate, name, party, office, state, number, status
ORDER BY votos DESC, pontos DESC, name NULLS FIRST, candidate NULLS FIRST, party NULLS FIRST, office NULLS FIRST, state NULLS FIRST, number NULLS FIRST, status NULLS FIRST LIMIT 20""",
)
_add("candidate_summary", _c("PREFEITO", 1, lambda f, ids: C.summary(f, ids[0], Scope())), _summary())
_add("vote_history", _c("PREFEITO", 1, lambda f, ids: C.vote_history(f, ids[0])), _history())
_add("electorate_profile", _c("PREFEITO", 1, lambda f, ids: C.electorate_profile(f, ids[0], Scope())), _profile())
for _l in C.LEVELS:
    _add(f"vote_distribution_{_l}", _c("DEPUTADO ESTADUAL", 1, lambda f, ids, v=_l: C.vote_distribution(f, ids[0], v, Scope())), _votes_by(_l))
_add("compare_candidates", _c("PREFEITO", 2, lambda f, ids: C.compare(f, ids, Scope(office="Prefeito"))), BASE + _compare_sql("PREFEITO") + "SELECT * FROM cmp")
_add(
    "compare_deltas", _c("PREFEITO", 2, lambda f, ids: C.deltas(C.compare(f, ids, Scope(office="Prefeito")))),
    BASE + _compare_sql("PREFEITO") + ", m AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metrica, candidato_id, CAST({m} AS DOUBLE) AS v FROM cmp" for m in ("votos", "percentual", "retencao"))
    + ") SELECT metrica, (list(candidato_id ORDER BY v DESC, candidato_id))[1] AS melhor, floor(((list(v ORDER BY v DESC))[1] - (list(v ORDER BY v DESC))[2]) * 1e4 + 0.5) / 1e4 AS vantagem FROM m GROUP BY metrica HAVING count(*) > 1",
)
_add(
    "municipal_scope", _c("PREFEITO", 1, lambda f, ids: C.municipal_scope(f, ids[0], Scope())),
    BASE + f""", key AS (SELECT {_id('PREFEITO', 0)} AS k), g AS (SELECT state AS uf, place_key AS municipio, sum(votes)::BIGINT AS votos FROM f WHERE {_is('(SELECT k FROM key)')} AND state IS NOT NULL AND place IS NOT NULL GROUP BY ALL)
SELECT *, (SELECT count(*) > 1 FROM g) AS ambiguo FROM g ORDER BY votos DESC, uf, municipio LIMIT 1""",
)
_add(
    "zone_round_fallback", _c("VEREADOR", 1, lambda f, ids: C.zone_distribution_with_fallback(f, ids[0], Scope(round=2))),
    BASE + f""", key AS (SELECT {_id('VEREADOR', 0)} AS k), r AS (SELECT * FROM f WHERE {_is('(SELECT k FROM key)')} AND zone IS NOT NULL AND round <= 2),
x AS (SELECT zone AS chave, place AS municipio, state AS uf, round AS turno, sum(votes)::BIGINT AS votos FROM r WHERE round = (SELECT max(round) FROM r) GROUP BY ALL) SELECT *, {_pct('votos', '(SELECT sum(votos) FROM x)', 4)} AS percentual, turno <> 2 AS usou_outro_turno FROM x""",
)
_add(
    "weighted_region_clusters", _q(lambda f: A.region_clusters(f, Scope(YEAR))),
    BASE + f""", g AS (SELECT state, sum(latitude * votes) AS a, sum(longitude * votes) AS o, sum(votes) AS v FROM f WHERE {_where(YEAR)} AND state IS NOT NULL AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0) AND votes > 0 GROUP BY state)
SELECT 'uf' AS nivel, state AS chave, floor(a / v * 1e5 + 0.5) / 1e5 AS latitude, floor(o / v * 1e5 + 0.5) / 1e5 AS longitude, v::BIGINT AS votos FROM g
UNION ALL SELECT 'macrorregiao', {_case('state', labels.REGION_OF_STATE, "'N/A'")}, floor(sum(a) / sum(v) * 1e5 + 0.5) / 1e5, floor(sum(o) / sum(v) * 1e5 + 0.5) / 1e5, sum(v)::BIGINT FROM g GROUP BY 2""",
)
_add(
    "text_fold", _q(lambda f: f.df.groupBy("name_key").agg(F.count(F.lit(1)).alias("linhas"))), BASE + "SELECT name_key, count(*) AS linhas FROM f GROUP BY name_key"
)
_add(
    "person_id_sha1", _q(lambda f: f.df.groupBy("state").agg(F.count_distinct(person_id(F.col("signature"))).alias("pessoas"), F.min(person_id(F.col("signature"))).alias("primeira"))),
    BASE + "SELECT state, count(DISTINCT sha1(signature)) AS pessoas, min('person:' || sha1(signature)) AS primeira FROM f GROUP BY state",
)


def _etl(build):
    return lambda spark, folder: build(table(spark, folder, "analytics"), spark, folder)


def _rolled(df: DataFrame) -> DataFrame:
    return etl.rollup(df.select(*etl.CANONICAL))


def _repeats(df: DataFrame) -> DataFrame:
    kept = df.drop("row_id", "dt_carga").distinct()
    return kept.groupBy("ANO_ELEICAO").agg(F.count(F.lit(1)).alias("linhas"), F.sum(etl.VOTES).alias("votos"))


def _registered(df: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    votes = df.select("row_id", *dict.fromkeys([*etl.EXACT_KEY, *etl.WIDE_KEY, *etl.PROFILE]))
    votes = votes.withColumns({c: F.col(c).cast("string") for c in etl.PROFILE}).withColumn("SQ_CANDIDATO", F.trim("SQ_CANDIDATO"))
    return etl.enrich(votes, etl.prepare_register(table(spark, folder, "consulta_cand"))).select("row_id", *etl.PROFILE)


_REGISTER = ", ".join(f"{_s(c)} AS {c}" for c in dict.fromkeys(["SQ_CANDIDATO", "NR_CANDIDATO", "SG_UF", "DS_CARGO", *etl.PROFILE]))
_ORDER = "dt_carga DESC NULLS LAST, " + ", ".join(f"{c} NULLS LAST" for c in (*etl.PROFILE, *etl.EXACT_KEY, *etl.WIDE_KEY))
_filled = ", ".join(f"coalesce({_s('v.' + c)}, a.{c}, b.{c}) AS {c}" for c in etl.PROFILE)
_add("etl_rollup", _etl(lambda df, *_: _rolled(df)), "SELECT " + ", ".join(c for c in etl.CANONICAL if c != etl.VOTES) + ", sum(QT_VOTOS_NOMINAIS_VALIDOS)::BIGINT AS QT_VOTOS_NOMINAIS_VALIDOS FROM analytics GROUP BY ALL")
_add("etl_exact_dedup", _etl(lambda df, *_: _repeats(df)), "SELECT ANO_ELEICAO, count(*) AS linhas, sum(QT_VOTOS_NOMINAIS_VALIDOS)::BIGINT AS votos FROM (SELECT DISTINCT * EXCLUDE (row_id, dt_carga) FROM analytics) GROUP BY ANO_ELEICAO")
_add(
    "etl_register_join", _etl(_registered),
    f"""WITH r AS (SELECT ANO_ELEICAO, dt_carga, {_REGISTER} FROM consulta_cand),
a AS (SELECT * FROM r WHERE ANO_ELEICAO IS NOT NULL AND SQ_CANDIDATO IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ANO_ELEICAO, SQ_CANDIDATO ORDER BY {_ORDER}) = 1),
b AS (SELECT * FROM r WHERE ANO_ELEICAO IS NOT NULL AND NR_CANDIDATO IS NOT NULL AND SG_UF IS NOT NULL AND DS_CARGO IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ANO_ELEICAO, NR_CANDIDATO, SG_UF, DS_CARGO ORDER BY {_ORDER}) = 1)
SELECT v.row_id, {_filled} FROM analytics v LEFT JOIN a ON a.ANO_ELEICAO = v.ANO_ELEICAO AND a.SQ_CANDIDATO = trim(v.SQ_CANDIDATO)
LEFT JOIN b ON b.ANO_ELEICAO = v.ANO_ELEICAO AND b.NR_CANDIDATO = v.NR_CANDIDATO AND b.SG_UF = v.SG_UF AND b.DS_CARGO = v.DS_CARGO""",
)
_KEY = ", ".join(etl.IDENTITY)
_add(
    "quality_report", _etl(lambda df, *_: etl.quality(df)),
    "SELECT count(*) AS linhas, count(*) FILTER (WHERE QT_VOTOS_NOMINAIS_VALIDOS < 0) AS votos_negativos, " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS nulos_{c}" for c in etl.CANONICAL)
    + f", (SELECT coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM analytics GROUP BY {_KEY} HAVING count(*) > 1)) AS linhas_repetidas FROM analytics",
)
_add(
    "quality_by_year", _etl(lambda df, *_: etl.quality_by_year(df)),
    "SELECT ANO_ELEICAO AS ano, count(*) AS linhas, count(DISTINCT upper(trim(SG_UF))) AS ufs, count(DISTINCT upper(trim(DS_CARGO))) AS cargos, count(DISTINCT SQ_CANDIDATO) AS candidatos, coalesce(sum(QT_VOTOS_NOMINAIS_VALIDOS), 0)::BIGINT AS votos FROM analytics GROUP BY ANO_ELEICAO",
)
_add(
    "municipalities", _etl(lambda df, *_: etl.municipalities(df)),
    f"""WITH r AS (SELECT nullif(regexp_replace(coalesce({_s('CD_MUNICIPIO')}, ''), '[^0-9]', '', 'g'), '') AS codigo, upper({_s('SG_UF')}) AS uf, {_s('NM_UE')} AS municipio FROM analytics),
c AS (SELECT codigo, uf, municipio, count(*) AS n FROM r WHERE uf IS NOT NULL AND municipio IS NOT NULL GROUP BY ALL)
SELECT codigo, uf, municipio FROM (SELECT * FROM c WHERE codigo IS NOT NULL QUALIFY row_number() OVER (PARTITION BY codigo ORDER BY n DESC, municipio, uf) = 1) UNION ALL SELECT codigo, uf, municipio FROM c WHERE codigo IS NULL""",
)
def _united(spark: SparkSession, folder: str) -> DataFrame:
    both = table(spark, folder, "analytics").unionByName(table(spark, folder, "consulta_cand"), allowMissingColumns=True)
    return both.groupBy("ANO_ELEICAO", "SG_UF").agg(F.count(F.lit(1)).alias("linhas"), *[F.count(c).alias(f"com_{c}") for c in ("row_id", "dt_carga", *etl.CANONICAL) if c not in ("ANO_ELEICAO", "SG_UF")])


_add(
    "union_by_name", _united,
    "SELECT ANO_ELEICAO, SG_UF, count(*) AS linhas, " + ", ".join(f"count({c}) AS com_{c}" for c in ("row_id", "dt_carga", *etl.CANONICAL) if c not in ("ANO_ELEICAO", "SG_UF"))
    + " FROM (SELECT * FROM analytics UNION ALL BY NAME SELECT * FROM consulta_cand) GROUP BY ALL",
)
