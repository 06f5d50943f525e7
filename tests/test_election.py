"""Known answers on small fixtures."""

import pytest
from pyspark.sql import functions as F

from sufragio.operators.fact import bind
from sufragio.operators.filters import Scope
from sufragio.plans import aggregates as A
from sufragio.plans import candidates as C

COLUMNS = "ANO_ELEICAO int, NR_TURNO int, SG_UF string, NM_UE string, DS_CARGO string, DS_SIT_TOT_TURNO string, SQ_CANDIDATO string, SG_PARTIDO string, QT_VOTOS_NOMINAIS_VALIDOS bigint, IDADE int, NM_CANDIDATO string, NR_ZONA string, DS_GENERO string, DS_COR_RACA string, DS_GRAU_INSTRUCAO string"
ROWS = [
    (2022, 1, "SP", "SAO PAULO", "Deputado Estadual", "ELEITO", "1", "AAA", 12000, 45), (2022, 1, "SP", "SAO PAULO", "Deputado Estadual", "NAO ELEITO", "2", "BBB", 8000, 36),
    (2022, 1, "RJ", "RIO DE JANEIRO", "Senador", "ELEITO", "3", "CCC", 30000, 60), (2022, 1, "SP", "SAO PAULO", "Presidente", "NAO ELEITO", "9", "PPP", 70000, 58),
    (2022, 1, "RJ", "RIO DE JANEIRO", "Presidente", "NAO ELEITO", "9", "PPP", 80000, 58), (2024, 1, "SP", "SAO PAULO", "Prefeito", "ELEITO", "4", "AAA", 500000, 52),
    (2024, 2, "SP", "SAO PAULO", "Prefeito", "ELEITO", "4", "AAA", 550000, 52), (2024, 1, "SP", "SAO PAULO", "Vereador", "ELEITO", "5", "BBB", 40000, 44),
    (2024, 1, "SP", "SAO PAULO", "Vereador", "ELEITO", "6", "CCC", 35000, 40), (2024, 1, "SP", "CAMPINAS", "Prefeito", "ELEITO", "7", "DDD", 200000, 50),
    (2024, 1, "SP", "CAMPINAS", "Vereador", "ELEITO", "8", "EEE", 18000, 38),
]
RACES = ["Branca", "PRETA", "Parda", "Parda", "NÃO DIVULGÁVEL", "", None, "INDÍGENA", "Branca", "Branca", "Branca"]


@pytest.fixture(scope="module")
def fact(spark):
    rows = [(*r, f"Candidato {r[6]}", f"{i % 3:03d}", "FEMININO" if r[6] == "6" else "MASC.", RACES[i], "SUPERIOR COMPLETO") for i, r in enumerate(ROWS)]
    return bind(spark.createDataFrame(rows, COLUMNS))


def test_overview_of_one_round(fact):
    r = A.overview(fact, Scope(2022, 1, "SP", "Deputado Estadual")).first()
    assert (r["registros"], r["candidatos"], r["eleitos"], r["votos_nominais"]) == (2, 2, 1, 20000)


def test_overview_takes_the_last_round(fact):
    assert A.overview(fact, Scope(2024, state="SP", office="prefeito ")).first()["votos_nominais"] == 750000


def test_national_candidate_is_one_row(fact):
    r = A.overview(fact, Scope(2022, office="Presidente")).first()
    assert (r["registros"], r["votos_nominais"]) == (1, 150000)
    top = A.top_candidates(fact, Scope(2022, 1, office="Presidente")).first()
    assert (top["candidato_id"], top["votos"], top["uf"]) == ("9", 150000, None)


def test_not_elected_is_not_elected(fact):
    assert A.overview(fact, Scope(elected_only=True, year=2022)).first()["registros"] == 2


def test_time_series_and_vacancies(fact):
    assert [tuple(r) for r in A.time_series(fact, "votos_nominais", Scope(state="SP", place="campinas")).collect()] == [(2024, 218000)]
    got = {r["rotulo"]: r["vagas"] for r in A.seats(fact, "cargo", Scope(2024, state="SP")).collect()}
    assert got == {"PREFEITO": 2, "VEREADOR": 3}


def test_vacancy_column_is_largest_per_unit(spark):
    rows = [(2024, "SP", "A", "Prefeito", 1), (2024, "SP", "A", "Prefeito", 1), (2024, "SP", "A", "Vereador", 9), (2024, "SP", "B", "Vereador", 7), (2024, "SP", "B", "Vereador", 5)]
    f = bind(spark.createDataFrame(rows, "ANO_ELEICAO int, SG_UF string, NM_UE string, DS_CARGO string, QT_VAGAS int"))
    assert {r["rotulo"]: r["vagas"] for r in A.seats(f, "cargo", Scope()).collect()} == {"PREFEITO": 1, "VEREADOR": 16}


def test_race_comparison_keeps_order_and_zeroes(fact):
    got = [tuple(r) for r in A.race_comparison(fact, Scope(2022)).orderBy("ordem").select("categoria", "candidatos", "parte_candidatos").collect()]
    assert got == [("BRANCA", 1, 25.0), ("PRETA", 1, 25.0), ("PARDA", 2, 50.0), ("AMARELA", 0, 0.0), ("INDIGENA", 0, 0.0)]


def test_summary(fact):
    r = C.summary(fact, "4", Scope()).first()
    assert (r["votos_primeiro_turno"], r["votos_segundo_turno"], r["votos_consolidados"], r["turno_referencia"], r["votos"], r["posicao"]) == (500000, 550000, 1050000, 2, 550000, 1)
    assert C.summary(fact, "unknown", Scope()).count() == 0


def test_compare_and_deltas(fact):
    out = C.compare(fact, ["1", "2"], Scope(2022, state="SP", office="Deputado Estadual"))
    gaps = {r["metrica"]: (r["melhor"], r["vantagem"]) for r in C.deltas(out).collect()}
    assert gaps["votos"] == ("1", 4000.0) and gaps["percentual"] == ("1", 20.0)
    with pytest.raises(ValueError):
        C.compare(fact, ["1"], Scope())


def test_distribution_by_state_and_profile(fact):
    assert {r["chave"]: r["votos"] for r in C.vote_distribution(fact, "9", "uf", Scope(2022)).collect()} == {"SP": 70000, "RJ": 80000}
    p = C.electorate_profile(fact, "6", Scope()).first()
    assert (p["feminino"], p["a35_59"], p["escolaridade"]) == (100.0, 100.0, "SUPERIOR COMPLETO")


def test_zone_falls_back_to_round_one(fact):
    out = C.zone_distribution_with_fallback(fact, "7", Scope(2024, 2, office="Prefeito")).collect()
    assert [(r["votos"], r["usou_outro_turno"]) for r in out] == [(200000, True)]


def test_scope_of_a_municipal_candidate(fact):
    r = C.municipal_scope(fact, "4", Scope(2024)).first()
    assert (r["uf"], r["municipio"], r["ambiguo"]) == ("SP", "SAO PAULO", False)


def test_search_needs_letters_and_scope(fact):
    assert C.search(fact, "candidato", Scope(2022)).count() == 5  # one of them in two states
    assert C.search(fact, "cand", Scope(2022)).count() == 0
    assert C.search(fact, "cand", Scope(2022, state="RJ")).count() == 2


def test_missing_roles_give_nothing_instead_of_errors(spark):
    f = bind(spark.createDataFrame([(2020, "SP")], "ano_eleicao int, SG_UF string"))
    r = A.overview(f, Scope(2020)).first()
    assert r["registros"] == 1 and r["eleitos"] is None
    assert A.distribution(f, "genero", Scope(office="x")).count() == 0


def test_polarization_and_region(spark):
    rows = [(2022, 2, "SP", "-", "Governador", "ELEITO", "PL", 1000000), (2022, 2, "SP", "-", "Governador", "NAO ELEITO", "PT", 990000), (2024, 1, "SP", "SAO PAULO", "Prefeito", "ELEITO", "PT", 500000),
            (2024, 1, "SP", "SAO PAULO", "Prefeito", "NAO ELEITO", "PL", 490000), (2024, 1, "SP", "CAMPINAS", "Prefeito", "NAO ELEITO", "PL", 300000), (2024, 1, "SP", "CAMPINAS", "Prefeito", "ELEITO", "PT", 290000)]
    f = bind(spark.createDataFrame(rows, "ANO_ELEICAO int, NR_TURNO int, SG_UF string, NM_UE string, DS_CARGO string, DS_SIT_TOT_TURNO string, SG_PARTIDO string, QT_VOTOS_NOMINAIS bigint"))
    fed = A.polarization(f, "federal", "sp").first()
    assert (fed["partido"], fed["espectro"]) == ("PL", "direita")
    br = A.polarization(f, "municipal_brasil").first()
    assert (br["espectro"], br["total_prefeitos"], br["partido_representativo"]) == ("esquerda", 2, "PT")
    official = spark.createDataFrame([("SP", 5)], "uf string, oficial bigint")
    assert A.official_totals(A.polarization(f, "municipal_brasil"), official).first()["total_prefeitos"] == 5


def test_history_follows_the_person_not_the_name(spark):
    cols = "ANO_ELEICAO int, NR_TURNO int, SG_UF string, NM_UE string, DS_CARGO string, DS_SIT_TOT_TURNO string, SQ_CANDIDATO string, NR_CANDIDATO string, NR_CPF_CANDIDATO string, NM_CANDIDATO string, DT_NASCIMENTO string, SG_PARTIDO string, QT_VOTOS_NOMINAIS_VALIDOS bigint"
    rows = [(2020, 1, "SP", "X", "Vereador", "ELEITO", "10", "45", "111.222.333-44", "JOSÉ", "01/02/1970", "A", 10), (2022, 1, "SP", "X", "Governador", "NAO ELEITO", "11", "45", "11122233344", "JOSE", "01/02/1970", "A", 30),
            (2024, 1, "SP", "X", "Prefeito", "ELEITO", "12", "45", "11122233344", "JOSÉ", None, "B", 50), (2024, 1, "RJ", "Y", "Vereador", "ELEITO", "13", "99", None, "JOSÉ", "05/05/1980", "C", 99)]
    out = C.vote_history(bind(spark.createDataFrame(rows, cols)), "12").collect()
    assert [(r["ano"], r["cargo"], r["situacao"]) for r in out] == [(2024, "PREFEITO", "ELEITO"), (2022, "GOVERNADOR", "NAO ELEITO"), (2020, "VEREADOR", "ELEITO")]


def test_plans_stay_in_the_jvm(fact):
    plan = A.top_candidates(fact, Scope(2022))._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
    assert fact.df.select("year").filter(F.col("year") > 0).count() == 11
