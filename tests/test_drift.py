from datetime import datetime, timedelta

import pytest

from sufragio.operators import drift

FILES = "id bigint, serie string, quando timestamp_ntz, cab string, name string"
LINES = "lid bigint, id bigint, conteudo string"
T0 = datetime(2020, 1, 1)


def run(spark, files, lines):
    f = spark.createDataFrame([(i, s, T0 + timedelta(days=9 * d), c, "clash") for i, s, d, c in files], FILES)
    ln = spark.createDataFrame([(k, i, c) for k, (i, c) in enumerate(lines)], LINES)
    return f, ln, {tuple(r) for r in drift.report(f, ln, "id", "serie", "quando", "cab", "id", "conteudo").collect()}


SERIES = [
    (1, "s", 0, "SG_UF;QT_VOTOS_NOMINAIS_VALIDOS;DS_CARGO"),
    (2, "s", 1, " ds_cargo ;﻿SG_UF;NR_VOTACAO_NOMINAL"),
    (3, "s", 2, "DS_CARGO_D;SG_UF;NR_VOTACAO_NOMINAL;DS_GENERO"),
    (4, "s", 3, "DS_CARGO_D;NR_VOTACAO_NOMINAL"),
    (9, "other", 1, "SG_UF"),
]
VALUES = [
    (1, "SP;1;Vereador"), (1, "RJ;;Prefeito"), (2, "Vereador;SP;2,00"), (2, "Vereador;SP;#NULO#"), (3, "5;SP;2,50;F"), (3, "5;SP;2,50;F"), (4, "7;01/02/2020"), (9, "SP"),
]
EXPECTED = {
    (2, "NR_VOTACAO_NOMINAL", "renamed"), (2, "NR_VOTACAO_NOMINAL", "type_changed"),
    (3, "DS_CARGO_D", "renamed"), (3, "DS_CARGO_D", "type_changed"), (3, "DS_GENERO", "added"),
    (4, "SG_UF", "removed"), (4, "DS_GENERO", "removed"), (4, "NR_VOTACAO_NOMINAL", "type_changed"),
}


@pytest.mark.parametrize("block", [2048, 2, 1])
def test_changes(spark, monkeypatch, block):
    monkeypatch.setattr(drift, "BLOCK", block)
    assert run(spark, SERIES, VALUES)[2] == EXPECTED


def test_field_that_comes_back_in_a_long_series(spark, monkeypatch):
    monkeypatch.setattr(drift, "BLOCK", 3)
    files = [(i, "s", i, "A;B" if i % 4 else "A") for i in range(1, 14)]
    got = run(spark, files, [])[2]
    want = {(i, "B", "removed") for i in (4, 8, 12)} | {(i, "B", "added") for i in (5, 9, 13)}
    assert got == want


def test_consistent_table(spark):
    f, ln, _ = run(spark, SERIES, VALUES)
    out = {r["lid"]: r for r in drift.consistent(f, ln, "id", "cab", "lid", "id", "conteudo").collect()}
    assert len(out) == len(VALUES)
    assert out[0]["QT_VOTOS_NOMINAIS_VALIDOS"] == 1 and out[1]["QT_VOTOS_NOMINAIS_VALIDOS"] is None
    assert out[2]["QT_VOTOS_NOMINAIS_VALIDOS"] == 2 and out[2]["DS_CARGO"] == "Vereador"
    assert out[4]["DS_CARGO"] == "5" and out[4]["DS_GENERO"] == "F" and out[4]["SG_UF"] == "SP"
    assert out[7]["DS_CARGO"] is None


def test_empty_nulls_and_ties(spark):
    assert run(spark, [], [])[2] == set()
    files = [(1, None, 0, None), (2, None, 0, "A;A;;B"), (3, None, 1, "A")]
    assert run(spark, files, [(1, None), (2, "1;x"), (3, "1;2;3"), (3, None)])[2] == {(2, "A", "added"), (2, "B", "added"), (3, "B", "removed")}
    # as many integers as texts: the wider type
    got = run(spark, [(1, "s", 0, "A"), (2, "s", 1, "A")], [(1, "1"), (1, "x"), (2, "1")])[2]
    assert got == {(2, "A", "type_changed")}


def test_nothing_is_changed_in_silence(spark):
    """Numbers that do not fit, unknown fields, two names of one field, values beyond the header."""
    files = [(1, "s", 0, "QT_VOTOS_NOMINAIS_VALIDOS;NR_ZONA;NM_UE;NM_MUNICIPIO;NOVO;DT_ELEICAO;;NOVO")]
    lines = [(1, "382,50;1.234;A;B;x;2020-13-01"), (1, "-5;-5;;B;;01/02/2020"), (1, "382,00;2014.0;A;;;2020-02-01 10:00:00;u;w;y;z"), (1, "abc12x34;31ª ZONA;;;;"), (1, "ANO-2008;M80720"), (1, None), (7, "1;2"), (1, "99999999999999999999;082")]
    f, ln, _ = run(spark, files, lines)
    out = {r["lid"]: r for r in drift.consistent(f, ln, "id", "cab", "lid", "id", "conteudo").collect()}
    votes = [out[i]["QT_VOTOS_NOMINAIS_VALIDOS"] for i in range(8)]
    assert votes == [None, -5, 382, None, 2008, None, None, None]
    assert [out[i]["NR_ZONA"] for i in range(8)] == [None, None, "2014", "31", "80720", None, None, "082"]
    assert [out[i]["rejeitados"] for i in range(8)] == ["NR_ZONA=1.234;DT_ELEICAO=2020-13-01;QT_VOTOS_NOMINAIS_VALIDOS=382,50", "NR_ZONA=-5", None, "QT_VOTOS_NOMINAIS_VALIDOS=abc12x34", None, None, None, "QT_VOTOS_NOMINAIS_VALIDOS=99999999999999999999"]
    assert [out[i]["NM_UE"] for i in range(3)] == ["A", "B", "A"]
    assert [out[i]["outros"] for i in range(8)] == ["NM_MUNICIPIO=B;NOVO=x", None, "#7=u;#8=w;#9=y;#10=z", None, None, None, "#1=1;#2=2", None]
    assert {r["campo"]: r["valores"] for r in drift.rejects(drift.consistent(f, ln, "id", "cab", "lid", "id", "conteudo")).collect()} == {"NR_ZONA": 2, "DT_ELEICAO": 1, "QT_VOTOS_NOMINAIS_VALIDOS": 3}


@pytest.mark.parametrize("block", [2048, 2])
def test_type_islands(spark, monkeypatch, block):
    monkeypatch.setattr(drift, "BLOCK", block)
    f, ln, _ = run(spark, [(i, "s", i, "A") for i in range(1, 8) if i != 5] + [(5, "s", 5, "B")], [(1, "1"), (2, "2"), (3, "x"), (4, "y"), (6, "z"), (7, "7")])
    got = {tuple(r) for r in drift.islands(drift.catalogue(f, ln, "id", "serie", "quando", "cab", "id", "conteudo")).collect()}
    assert got == {("s", "A", "integer", 1, 2), ("s", "A", "text", 3, 4), ("s", "B", None, 5, 5), ("s", "A", "text", 6, 6), ("s", "A", "integer", 7, 7)}
