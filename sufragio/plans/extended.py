"""Further registered queries: filters, sorting and paging rules, the whole fact-table build, seats,
official numbers, places and their coordinates, and sources written and read back, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sufragio.functions import labels
from sufragio.operators import etl
from sufragio.operators.fact import Fact, bind
from sufragio.operators.filters import Scope, is_candidate
from sufragio.operators.relational import latest_round, totals
from sufragio.plans import aggregates as A
from sufragio.plans import candidates as C
from sufragio.plans import queries as Q
from sufragio.plans.queries import BASE, LAST, STATE, YEAR, fact
from sufragio.session import shared_folder, table
from sufragio.sources import files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _add(name: str, query, sql: str) -> None:
    QUERIES[name], ORACLE[name] = query, sql


def _q(build):
    return lambda spark, folder: build(fact(spark, folder))


# ---- filters ---------------------------------------------------------------------------------
def _in_place(f: Fact) -> DataFrame:
    place = f.df.filter((F.col("state") == STATE) & (F.col("place_key") != "")).agg(F.min("place_key")).first()[0]
    return A.overview(f, Scope(state=STATE, place=place or "-"))


_add("overview_place", _q(_in_place), BASE + LAST.format(where=f"state = '{STATE}' AND place_key = (SELECT min(place_key) FROM f WHERE state = '{STATE}' AND place_key <> '')") + f"SELECT {Q._ALL} FROM l")
_add("overview_whole_country", _q(lambda f: A.overview(f, Scope(YEAR, 1, "Brasil"))), BASE + f"SELECT {Q._ALL} FROM f WHERE year = {YEAR} AND round = 1")
_add("ranking_unknown_metric", _q(lambda f: A.ranking(f, "partido", "nada", Scope(YEAR))), "SELECT '' AS rotulo, 0::BIGINT AS valor, 0e0 AS percentual WHERE FALSE")

#: The number of the person with most years; ties by number.
_CPF = "(SELECT cpf FROM f WHERE length(cpf) = 11 GROUP BY cpf ORDER BY count(DISTINCT year) DESC, cpf LIMIT 1)"


def _number_of(f: Fact) -> str:
    rows = f.df.filter(F.length("cpf") == 11).groupBy("cpf").agg(F.count_distinct("year").alias("n")).orderBy(F.desc("n"), "cpf").limit(1).collect()
    return rows[0][0] if rows else "0"


def _history(scope: str) -> str:
    sql = Q._history()
    persona = Q._persona("(SELECT k FROM key)")
    own = f"(SELECT signature FROM f WHERE cpf = {_CPF} AND signature <> ''{scope} GROUP BY signature ORDER BY count(*) DESC, signature LIMIT 1)"
    assert persona in sql
    return sql.replace(persona, own)


_add("vote_history_by_number", _q(lambda f: C.vote_history(f, "-", cpf=_number_of(f))), _history(""))
_add("vote_history_in_scope", _q(lambda f: C.vote_history(f, "-", cpf=_number_of(f), state=STATE, office="Vereador")), _history(f" AND state = '{STATE}' AND office_key = 'VEREADOR'"))
_add("candidate_rows_by_number", _q(lambda f: f.df.filter(is_candidate("-", _number_of(f))).groupBy("year").agg(F.sum("votes").alias("votos"), F.count(F.lit(1)).alias("linhas"))), BASE + f"SELECT year, sum(votes)::BIGINT AS votos, count(*) AS linhas FROM f WHERE cpf = {_CPF} GROUP BY year")

# ---- search, places in a contest, pages ------------------------------------------------------
_add("text_search", _q(lambda f: C.search(f, "ANTONIO", Scope(state=STATE), 1, 50)), Q.ORACLE["search"].replace(Q._where(YEAR, office="Deputado Estadual"), Q._where(state=STATE)).replace("'MARIA'", "'ANTONIO'").replace("LIMIT 20", "LIMIT 50"))


def _ranked(f: Fact) -> DataFrame:
    ids = Q.first_candidates(f, "PREFEITO", 3)
    inside = f.df.filter((F.col("office_key") == "PREFEITO") & (F.col("year") == F.lit(f.df.filter(F.col("office_key") == "PREFEITO").agg(F.max("year")).first()[0])))
    _, places = C.standing(inside, ids)
    rows = [(i, p) for i, p in zip(ids, places) if p is not None]
    return f.df.sparkSession.createDataFrame(rows, "candidato_id string, posicao bigint")


_add(
    "candidate_rank", _q(_ranked),
    BASE + f""", y AS (SELECT max(year) AS y FROM f WHERE office_key = 'PREFEITO'), z AS (SELECT candidate, row_number() OVER (ORDER BY sum(votes) DESC, candidate) AS posicao FROM f WHERE office_key = 'PREFEITO' AND year = (SELECT y FROM y) AND candidate IS NOT NULL GROUP BY candidate)
SELECT candidate AS candidato_id, posicao FROM z WHERE candidate IN ({', '.join(Q._id('PREFEITO', k) for k in range(3))})""",
)
_add("top_candidates_pages", _q(lambda f: totals(latest_round(Scope(YEAR).apply(f).df).select("candidate").distinct(), 20)), BASE + LAST.format(where=Q._where(YEAR)) + "SELECT count(DISTINCT candidate) AS total, ceil(count(DISTINCT candidate) / 20)::BIGINT AS paginas FROM l")
for _level, _sort, _up, _page, _order in (
    ("municipio", "percentual_municipio", True, 2, "percentual_municipio, chave"), ("municipio", "nada", False, 1, "votos DESC, chave"), ("zona", "chave", True, 2, "chave, municipio NULLS LAST, uf NULLS LAST"), ("uf", "chave", True, 1, "chave"),
):
    _add(
        f"votes_sorted_{_level}_{_sort}", Q._c("DEPUTADO ESTADUAL", 1, lambda f, ids, v=_level, s=_sort, u=_up, n=_page: C.vote_distribution(f, ids[0], v, Scope(), s, u, n, 5)),
        f"SELECT * FROM ({Q._votes_by(_level)}) ORDER BY {_order} LIMIT 5 OFFSET {5 * (_page - 1)}",
    )
for _level in ("macroregiao", "uf"):
    _add(f"votes_of_president_{_level}", Q._c("PRESIDENTE", 1, lambda f, ids, v=_level: C.vote_distribution(f, ids[0], v, Scope())), Q._votes_by(_level).replace(Q._id("DEPUTADO ESTADUAL", 0), Q._id("PRESIDENTE", 0)))
_add("distribution_office_all", _q(lambda f: A.distribution(f, "cargo", Scope())), Q._distribution("cargo", "TRUE"))
_BAND = "CASE WHEN age IS NULL THEN 'N/A' WHEN age <= 29 THEN '18-29' WHEN age <= 39 THEN '30-39' WHEN age <= 49 THEN '40-49' WHEN age <= 59 THEN '50-59' WHEN age <= 69 THEN '60-69' ELSE '70+' END"
_add("age_bands", _q(lambda f: f.df.groupBy(labels.age_band(F.col("age")).alias("faixa")).agg(F.count(F.lit(1)).alias("linhas"))), BASE + f"SELECT {_BAND} AS faixa, count(*) AS linhas FROM f GROUP BY 1")

# ---- winners of parties without a side: with the left alone mapped there are some -------------
_LEFT = {p: s for p, s in Q._SIDES.items() if s == "esquerda"}
_add("polarization_audit_left_only", _q(lambda f: A.unmapped_parties(f, sides=_LEFT)), Q.ORACLE["polarization_audit"].replace(Q._case(Q._fold("party"), Q._SIDES, "'indefinido'"), Q._case(Q._fold("party"), _LEFT, "'indefinido'")))


# ---- seats given in a column, official numbers -----------------------------------------------
def _with_seats(spark: SparkSession, folder: str, by: str) -> DataFrame:
    rows = table(spark, folder, "analytics").withColumn("QT_VAGAS", F.trim("NR_ZONA").try_cast("bigint"))
    return A.seats(bind(rows), by, Scope())


_SEATS = BASE.replace("LATITUDE AS latitude", "try_cast(trim(NR_ZONA) AS BIGINT) AS seats, LATITUDE AS latitude")
for _b, _l in (("cargo", "coalesce(office_key, 'N/A')"), ("uf", f"coalesce(CASE WHEN office_key IN {Q._NATION} THEN 'BR' ELSE state END, 'N/A')")):
    _add(
        f"seats_of_column_{_b}", lambda spark, folder, b=_b: _with_seats(spark, folder, b),
        _SEATS + f""", u AS (SELECT {_l} AS rotulo, year, CASE WHEN office_key IN {Q._NATION} THEN 'BR' ELSE state END AS us, office_key, CASE WHEN office_key IN {Q._OFFICES} THEN place_key END AS up, max(seats) AS n FROM f GROUP BY ALL)
SELECT rotulo, sum(coalesce(n, 0))::BIGINT AS vagas FROM u GROUP BY rotulo""",
    )


def _official(spark: SparkSession, folder: str) -> DataFrame:
    listed = table(spark, folder, "municipios_ref").select(F.col("SG_UF").alias("uf"), F.col("NM_MUNICIPIO").alias("municipio"), F.lit("PREFEITO").alias("cargo"), F.lit(1).cast("bigint").alias("vagas"))
    return A.official_totals(A.polarization(fact(spark, folder), "municipal_brasil"), files.official_mayors(listed))


_add("polarization_official_totals", _official, Q.ORACLE["polarization_municipal_brasil"].replace("n AS total_prefeitos", "greatest(n, coalesce(oficial, 0)) AS total_prefeitos") + f" LEFT JOIN (SELECT SG_UF AS state, count(DISTINCT {Q._fold('NM_MUNICIPIO')}) AS oficial FROM municipios_ref GROUP BY 1) USING (state)")

# ---- places ----------------------------------------------------------------------------------
_add("place_codes", _q(A.place_codes), BASE + """, c AS (SELECT state, place_key, nullif(min(coalesce(nullif(regexp_replace(coalesce(code, ''), '[^0-9]', '', 'g'), ''), '')), '') AS codigo FROM (SELECT f.*, CD_MUNICIPIO AS code FROM f JOIN analytics a ON a.row_id = f."row") GROUP BY ALL)
SELECT state AS uf, place_key AS municipio, c.codigo, count(*) AS linhas, sum(votes)::BIGINT AS votos FROM f LEFT JOIN c USING (state, place_key) WHERE state IS NOT NULL AND place_key <> '' GROUP BY ALL""")


def _five(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.floor(F.col(c) * 1e4 + 0.5) / 1e4 for c in ("latitude", "longitude")})


def _located(spark: SparkSession, folder: str) -> DataFrame:
    coords = table(spark, folder, "municipios_ref").select(F.col("CD_MUNICIPIO").alias("codigo"), F.col("SG_UF").alias("uf"), F.col("NM_MUNICIPIO").alias("municipio"), F.col("LATITUDE").alias("latitude"), F.col("LONGITUDE").alias("longitude"))
    return _five(etl.locate(etl.municipalities(table(spark, folder, "analytics")), coords))


_KEY = lambda c: Q._case(Q._fold(c), labels.PLACE_ALIASES, Q._fold(c))
_add(
    "places_located", _located,
    f"""WITH p AS ({Q.ORACLE['municipalities']}), q AS (SELECT *, {_KEY('municipio')} AS key FROM p),
c AS (SELECT CD_MUNICIPIO AS codigo, SG_UF AS uf, {_KEY('NM_MUNICIPIO')} AS key, LATITUDE AS la, LONGITUDE AS lo FROM municipios_ref WHERE LATITUDE BETWEEN -90 AND 90 AND LONGITUDE BETWEEN -180 AND 180 AND NOT (LATITUDE = 0 AND LONGITUDE = 0)),
a AS (SELECT codigo, avg(la) AS la, avg(lo) AS lo FROM c GROUP BY 1), b AS (SELECT uf, key, avg(la) AS la, avg(lo) AS lo FROM c GROUP BY 1, 2),
d AS (SELECT key, avg(la) AS la, avg(lo) AS lo FROM c GROUP BY 1 HAVING count(DISTINCT uf) = 1), e AS (SELECT uf, avg(la) AS la, avg(lo) AS lo FROM c GROUP BY 1)
SELECT q.codigo, q.uf, q.municipio, floor(coalesce(a.la, b.la, d.la, e.la) * 1e4 + 0.5) / 1e4 AS latitude, floor(coalesce(a.lo, b.lo, d.lo, e.lo) * 1e4 + 0.5) / 1e4 AS longitude,
  CASE WHEN a.la IS NOT NULL THEN 'codigo' WHEN b.la IS NOT NULL THEN 'uf_nome' WHEN d.la IS NOT NULL THEN 'nome' WHEN e.la IS NOT NULL THEN 'uf' END AS achado_por
FROM q LEFT JOIN a USING (codigo) LEFT JOIN b ON b.uf = q.uf AND b.key = q.key LEFT JOIN d ON d.key = q.key LEFT JOIN e ON e.uf = q.uf""",
)


def _zones(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "analytics").select(F.upper(F.trim("SG_UF")).alias("uf"), F.col("NM_UE").alias("municipio"), F.trim("NR_ZONA").alias("zona"), F.col("ANO_ELEICAO").alias("ano"), F.col("LATITUDE").alias("latitude"), F.col("LONGITUDE").alias("longitude"))
    zones = rows.select("uf", "municipio", "zona").distinct()
    return _five(etl.locate_zones(zones, rows.filter((F.col("ano") >= 2016) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).drop("ano")))


_Z = "nullif(regexp_replace(regexp_replace(coalesce({0}, ''), '[^0-9]', '', 'g'), '^0+', ''), NULL)"
_add(
    "zones_located", _zones,
    f"""WITH r AS (SELECT upper(trim(SG_UF)) AS uf, NM_UE AS municipio, trim(NR_ZONA) AS zona, ANO_ELEICAO AS ano, LATITUDE AS la, LONGITUDE AS lo FROM analytics),
z AS (SELECT *, {_KEY('municipio')} AS key, {_Z.format('zona')} AS z FROM (SELECT DISTINCT uf, municipio, zona FROM r)),
s AS (SELECT *, {_KEY('municipio')} AS key, {_Z.format('zona')} AS z FROM r WHERE ano >= 2016 AND la IS NOT NULL AND lo IS NOT NULL),
a AS (SELECT uf, key, z, avg(la) AS la, avg(lo) AS lo FROM s GROUP BY ALL), b AS (SELECT uf, z, avg(la) AS la, avg(lo) AS lo FROM s GROUP BY ALL), c AS (SELECT z, avg(la) AS la, avg(lo) AS lo FROM s GROUP BY ALL), d AS (SELECT uf, key, avg(la) AS la, avg(lo) AS lo FROM s GROUP BY ALL)
SELECT z.uf, z.municipio, z.zona, floor(coalesce(a.la, b.la, c.la, d.la) * 1e4 + 0.5) / 1e4 AS latitude, floor(coalesce(a.lo, b.lo, c.lo, d.lo) * 1e4 + 0.5) / 1e4 AS longitude
FROM z LEFT JOIN a ON a.uf = z.uf AND a.key = z.key AND a.z = z.z LEFT JOIN b ON b.uf = z.uf AND b.z = z.z LEFT JOIN c ON c.z = z.z LEFT JOIN d ON d.uf = z.uf AND d.key = z.key""",
)


# ---- the whole build -------------------------------------------------------------------------
def _built(spark: SparkSession, folder: str) -> DataFrame:
    return etl.build(table(spark, folder, "analytics").drop("row_id", "dt_carga"), table(spark, folder, "consulta_cand"))


_S = Q._s
_own = {c: _S(c) for c in etl.CANONICAL} | {"ANO_ELEICAO": "ANO_ELEICAO", "NR_TURNO": "nullif(NR_TURNO, 0)", "NM_UE": f"coalesce({_S('NM_UE')}, {_S('NM_MUNICIPIO')})", etl.VOTES: f"coalesce({etl.VOTES}, 0)", "LATITUDE": "LATITUDE", "LONGITUDE": "LONGITUDE"}
_day = lambda c: f"(CASE WHEN year({Q._DAY.format(c)}) BETWEEN 1900 AND 2100 THEN {Q._DAY.format(c)} END)"
_kept = ", ".join(f"coalesce(v.{c}, a.{c}, b.{c}) AS {c}" if c in etl.PROFILE else f"v.{c}" for c in etl.CANONICAL if c not in ("IDADE", "FAIXA_ETARIA"))
_years = f"coalesce(CAST(round_even(date_diff('day', {_day('DT_NASCIMENTO')}, {_day('DT_ELEICAO')}) / 365.25, 0) AS INT), ANO_ELEICAO - year({_day('DT_NASCIMENTO')}))"
_add(
    "etl_build", _built,
    f"""WITH r AS (SELECT ANO_ELEICAO, dt_carga, {Q._REGISTER} FROM consulta_cand),
a AS (SELECT * FROM r WHERE ANO_ELEICAO IS NOT NULL AND SQ_CANDIDATO IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ANO_ELEICAO, SQ_CANDIDATO ORDER BY {Q._ORDER}) = 1),
b AS (SELECT * FROM r WHERE ANO_ELEICAO IS NOT NULL AND NR_CANDIDATO IS NOT NULL AND SG_UF IS NOT NULL AND DS_CARGO IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ANO_ELEICAO, NR_CANDIDATO, SG_UF, DS_CARGO ORDER BY {Q._ORDER}) = 1),
v AS (SELECT {', '.join(f'{e} AS {c}' for c, e in _own.items())} FROM analytics),
e AS (SELECT {_kept} FROM v LEFT JOIN a ON a.ANO_ELEICAO = v.ANO_ELEICAO AND a.SQ_CANDIDATO = v.SQ_CANDIDATO LEFT JOIN b ON b.ANO_ELEICAO = v.ANO_ELEICAO AND b.NR_CANDIDATO = v.NR_CANDIDATO AND b.SG_UF = v.SG_UF AND b.DS_CARGO = v.DS_CARGO),
g AS (SELECT *, CASE WHEN {_years} BETWEEN 15 AND 120 THEN {_years} END AS IDADE FROM e), h AS (SELECT DISTINCT *, {_BAND.replace('age', 'IDADE')} AS FAIXA_ETARIA FROM g)
SELECT {', '.join(c for c in etl.CANONICAL if c != etl.VOTES)}, sum({etl.VOTES})::BIGINT AS {etl.VOTES} FROM h GROUP BY ALL""",
)


# ---- sources written and read back -----------------------------------------------------------
def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/sources/{uuid.uuid4().hex}/{name}"


def _csv(spark: SparkSession, folder: str) -> DataFrame:
    path, at = _place(spark, "votos.csv"), _place(spark, "votos.parquet")
    rows = table(spark, folder, "analytics").drop("dt_carga")
    files.write(rows, path)
    files.convert(spark, path, at, encoding="UTF-8")
    back = files.open_fact(spark, at)
    return back.groupBy(F.col("ANO_ELEICAO").try_cast("int").alias("ano"), F.trim("SG_UF").alias("uf")).agg(F.count(F.lit(1)).alias("linhas"), F.sum(F.col(etl.VOTES).try_cast("bigint")).alias("votos"), F.count_distinct("ROW_ID").alias("chaves"))


_add("source_csv_to_parquet", _csv, f"SELECT ANO_ELEICAO AS ano, nullif(trim(SG_UF), '') AS uf, count(*) AS linhas, sum({etl.VOTES})::BIGINT AS votos, count(DISTINCT row_id) AS chaves FROM analytics GROUP BY ALL")


def _partitioned(spark: SparkSession, folder: str) -> DataFrame:
    """Written by year with its normalised keys, read back, filtered on both."""
    path = _place(spark, "fato.parquet")
    files.write(etl.with_keys(table(spark, folder, "analytics")), path, ["ANO_ELEICAO"])
    return A.overview(bind(files.open_fact(spark, path)), Scope(YEAR, state=STATE))


_add("source_partitioned_fact", _partitioned, BASE + LAST.format(where=Q._where(YEAR, state=STATE)) + f"SELECT {Q._ALL} FROM l")


def _snapshot(spark: SparkSession, folder: str) -> DataFrame:
    root = _place(spark, "snapshots")
    rows = table(spark, folder, "municipios_ref")
    for release in ("r1", "r2", "r3"):
        files.publish(rows, root, release, keep=2, remove=True)
    return spark.read.parquet(root).groupBy("release").agg(F.count(F.lit(1)).alias("linhas"))


_add("source_snapshots", _snapshot, "SELECT 'r' || r.range AS release, count(*) AS linhas FROM municipios_ref, range(2, 4) r GROUP BY 1")


def _coordinates(spark: SparkSession, folder: str) -> DataFrame:
    """A coordinates table under other header names, written as CSV and read by alias."""
    path = _place(spark, "coords.csv")
    rows = table(spark, folder, "municipios_ref").select(F.col("CD_MUNICIPIO").alias("cod_municipio"), F.col("SG_UF").alias("uf"), F.col("NM_MUNICIPIO").alias("municipality"), F.col("LATITUDE").alias("lat"), F.col("LONGITUDE").alias("lng"))
    files.write(rows, path)
    got = files.read_coordinates(spark, path, encoding="UTF-8")
    return got.groupBy("uf").agg(F.count("codigo").alias("codigos"), F.count_distinct("municipio").alias("nomes"), F.count("latitude").alias("lat"), F.count("longitude").alias("lng"))


_add("source_coordinates", _coordinates, "SELECT SG_UF AS uf, count(CD_MUNICIPIO) AS codigos, count(DISTINCT NM_MUNICIPIO) AS nomes, count(LATITUDE) AS lat, count(LONGITUDE) AS lng FROM municipios_ref GROUP BY 1")
