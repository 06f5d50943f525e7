"""Sources, fact-table build, geography, streams and payloads."""

import json

import pytest
from pyspark.sql import functions as F

from sufragio.operators import etl
from sufragio.operators.filters import Scope
from sufragio.plans import service
from sufragio.sources import files
from sufragio.streaming import votes as stream


@pytest.fixture()
def raw(tmp_path):
    a, b = tmp_path / "votos_2020.csv", tmp_path / "sub" / "votos_2022.csv"
    b.parent.mkdir()
    a.write_bytes('sg_uf;NM_UE;DS_CARGO ;SQ_CANDIDATO;NR_CANDIDATO;QT_VOTOS_NOMINAIS;DT_ELEICAO;NR_TURNO\nSP;SÃO PAULO;Vereador;1;10;5;04/10/2020;1º\nSP;SÃO PAULO;Vereador;1;10;5;04/10/2020;1º\nSP;SÃO PAULO;Vereador;2;11;x;04/10/2020;\n'.encode("latin-1"))
    b.write_bytes("ANO_ELEICAO;SG_UF;DS_CARGO_D;SQ_CANDIDATO;NR_VOTACAO_NOMINAL\n2022;RJ;Senador;7;3\n".encode("latin-1"))
    (tmp_path / "leia-me.csv").write_text("x\n")
    return tmp_path


def test_discover_read_and_build(spark, raw):
    paths = files.discover(str(raw), ["votos_*.csv", "*.csv"], ["leia*"])
    assert len(paths) == 2
    register = spark.createDataFrame([(2020, "1", "ANA", "01/01/1990", "FEMININO"), (2020, "1", "ANA", "01/01/1990", "FEMININO"), (2020, None, "X", None, None)], "ANO_ELEICAO int, SQ_CANDIDATO string, NM_CANDIDATO string, DT_NASCIMENTO string, DS_GENERO string")
    out = {(r["ANO_ELEICAO"], r["SQ_CANDIDATO"]): r for r in etl.build(files.read_csv(spark, paths), register).collect()}
    assert set(out) == {(2020, "1"), (2020, "2"), (2022, "7")}
    one = out[(2020, "1")]  # exact repeats count once, and the register does not multiply votes
    assert (one["QT_VOTOS_NOMINAIS_VALIDOS"], one["NM_CANDIDATO"], one["IDADE"], one["FAIXA_ETARIA"], one["NR_TURNO"], one["NM_UE"]) == (5, "ANA", 31, "30-39", 1, "SÃO PAULO")
    assert out[(2020, "2")]["QT_VOTOS_NOMINAIS_VALIDOS"] == 0 and out[(2020, "2")]["FAIXA_ETARIA"] == "N/A"
    assert out[(2022, "7")]["DS_CARGO"] == "Senador" and out[(2022, "7")]["QT_VOTOS_NOMINAIS_VALIDOS"] == 3


def test_rollup_keeps_nulls_together(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", None, 2), ("a", "x", 4)], f"A string, B string, {etl.VOTES} bigint")
    assert sorted(r[etl.VOTES] for r in etl.rollup(df).collect()) == [3, 4]


def test_quality_and_gate(spark, raw, tmp_path):
    df = etl.build(files.read_csv(spark, files.discover(str(raw), ["votos*.csv"])), None)
    found = etl.report(df)
    assert found["rows"] == 3 and found["missing_columns"] == [] and etl.gate(found) == []
    assert any("negative" in x for x in etl.gate({**found, "negative_votes": 1}))
    target = str(tmp_path / "out.parquet")
    files.write(df, target, ["ANO_ELEICAO"])
    assert files.open_fact(spark, target, "fato").count() == 3 and spark.table("fato").count() == 3
    files.write_json(found, str(tmp_path / "q.json"))
    made = files.manifest([str(tmp_path / "q.json")], release="r1")
    assert len(made["files"][0]["sha256"]) == 64 and json.loads((tmp_path / "q.json").read_text())["rows"] == 3
    assert etl.ready(found, made, [2020, 2022]) == [] and etl.ready(found, made, [2024]) == ["year 2024 has no rows"]
    assert files.publish(df, str(tmp_path / "snap"), "1", keep=1) == [] and files.publish(df, str(tmp_path / "snap"), "2", keep=1) == ["release=1"]


def test_source_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.open_fact(spark, str(tmp_path / "none.parquet"))
    (tmp_path / "x.xls").write_text("")
    with pytest.raises(ValueError):
        files.open_fact(spark, str(tmp_path / "x.xls"))
    with pytest.raises(ValueError):
        files.write(spark.range(1), str(tmp_path / "x.doc"))


def test_convert_and_official_seats(spark, tmp_path):
    p = tmp_path / "vagas.csv"
    p.write_bytes("SG_UF;NM_UE;DS_CARGO;QT_VAGA\nSP;São Paulo;Prefeito;1\nSP;SAO PAULO;Prefeito;1\nSP;Campinas;Prefeito;1\nSP;Campinas;Vereador;33\n".encode("latin-1"))
    assert [tuple(r) for r in files.official_mayors(files.official_seats(spark, [str(p)])).collect()] == [("SP", 2)]
    files.convert(spark, str(p), str(tmp_path / "v.parquet"))
    assert spark.read.parquet(str(tmp_path / "v.parquet")).count() == 4


def test_geography(spark, tmp_path):
    square = [[[0, 0], [0, 2], [2, 2], [2, 0]]]
    (tmp_path / "z.geojson").write_text(json.dumps({"features": [{"properties": {"zona": "012", "uf": "SP"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": {}, "geometry": {"type": "Point", "coordinates": [-46.5, -23.25]}}]}))
    (tmp_path / "bad.geojson").write_text("{")
    rows = files.read_geojson(spark, [str(tmp_path / "z.geojson"), str(tmp_path / "bad.geojson")]).orderBy("kind").collect()
    assert [(r["kind"], r["latitude"], r["longitude"]) for r in rows] == [("Point", -23.25, -46.5), ("Polygon", 1.0, 1.0)] and rows[1]["properties"]["ZONA"] == "012"
    coords = spark.createDataFrame([("1", "SP", "São Paulo", -23.0, -46.0), (None, "SP", "Santos", -24.0, -46.0), ("9", "SP", "Zero", 0.0, 0.0)], "codigo string, uf string, municipio string, latitude double, longitude double")
    places = spark.createDataFrame([("1", "SP", "x"), (None, "SP", "SANTOS"), (None, "RJ", "santos"), (None, "SP", "nova"), (None, "AC", "q")], "codigo string, uf string, municipio string")
    assert [r["achado_por"] for r in etl.locate(places, coords).collect()].count(None) == 1
    assert {(r["municipio"], r["achado_por"]) for r in etl.locate(places, coords).collect()} == {("x", "codigo"), ("SANTOS", "uf_nome"), ("santos", "nome"), ("nova", "uf"), ("q", None)}
    shapes = spark.createDataFrame([("SP", "A", "012", 1.0, 2.0), ("SP", "B", "12", 3.0, 4.0)], "uf string, municipio string, zona string, latitude double, longitude double")
    zones = spark.createDataFrame([("SP", "a", "12"), ("SP", "c", "0012"), ("RJ", "c", "12"), ("RJ", "c", "99")], "uf string, municipio string, zona string")
    assert [r["latitude"] for r in etl.locate_zones(zones, shapes).orderBy("uf", "municipio", "zona").collect()] == [2.0, None, 1.0, 2.0]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp_ntz'2024-10-06 08:10:00' t, 'SP' uf, 3 v, 2024 ANO_ELEICAO union all select timestamp_ntz'2024-10-06 08:50:00', 'SP', 4, 2024 union all select timestamp_ntz'2024-10-06 08:50:00', 'SP', 4, 2024").write.parquet(src)
    schema = spark.read.parquet(src).schema
    counts = stream.windowed_counts(stream.arriving(spark, src, schema), "t", ["uf"], "v")
    q = counts.writeStream.format("memory").queryName("janelas").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["uf"], r["linhas"], r["total"]) for r in spark.table("janelas").collect()] == [("SP", 3, 11)]
    once = stream.without_repeats(stream.arriving(spark, src, schema), "t", ["uf", "v"])
    stream.refresh(once, str(tmp_path / "fact"), str(tmp_path / "chk")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "fact")).agg(F.sum("v")).first()[0] == 7


def test_service_rules_and_cache():
    assert service.one_year(None, 2020) == 2020
    for bad in (lambda: service.one_year(2020, 2022), lambda: service.checked_round(3), lambda: service.needs_year("Vereador", None), lambda: service.search_text("a", Scope())):
        with pytest.raises(service.RequestError):
            bad()
    assert service.search_text("José", Scope()) is None and service.search_text("José", Scope(state="SP")) == "jose"
    assert service.page_size(Scope(), 99) == 50 and service.page_size(Scope(state="SP"), 999) == 100
    now = [0.0]
    cache = service.ResultCache(entries=2, clock=lambda: now[0])
    key = cache.key("v1", "overview", {"b": 1, "a": 2})
    assert key == cache.key("v1", "overview", {"a": 2, "b": 1})
    assert cache.run(key, 10, lambda: {"x": 1}) == {"x": 1} and cache.get(key) == {"x": 1}
    now[0] = 11
    assert cache.get(key) is None and cache.run(key, 10, lambda: 1 / 0) == {"x": 1}
    with pytest.raises(ZeroDivisionError):
        cache.run("other", 10, lambda: 1 / 0)
    assert cache.run("other", 10, lambda: 1 / 0, empty=[]) == []
    cache.put("b", 1, 10), cache.put("c", 1, 10)
    assert cache.get(key, stale=True) is None and len(cache.held) == 2
    assert service.etag([1]) == service.etag([1]) and service.failure("c", "m", "t")["retryable"] is False


def test_filters_reach_the_files_and_large_votes_stay_exact(spark, tmp_path):
    """A year filter prunes partitions or is pushed, normalised keys are pushed, 2^60 is summed exactly."""
    from sufragio.operators.fact import bind
    from sufragio.operators.filters import Scope
    from sufragio.plans import aggregates

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([(2022, 1, " sp ", "Prefeito ", "1", 2**60, "X"), (2022, 1, "SP", "Prefeito", "2", 1, "X"), (2018, 1, "SP", "Prefeito", "1", 5, "X")], "ANO_ELEICAO int, NR_TURNO int, SG_UF string, DS_CARGO string, SQ_CANDIDATO string, QT_VOTOS_NOMINAIS_VALIDOS bigint, NM_UE string")
    keyed = etl.with_keys(rows)
    files.write(keyed, str(tmp_path / "flat.parquet"))
    files.write(keyed, str(tmp_path / "cut.parquet"), ["ANO_ELEICAO"])
    scope = Scope(2022, 1, "SP", "prefeito", place="x")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    flat = aggregates.overview(bind(files.open_fact(spark, str(tmp_path / "flat.parquet"))), scope)
    shown = plan(flat)
    for pushed in ("EqualTo(ANO_ELEICAO,2022)", "EqualTo(uf_chave,SP)", "EqualTo(cargo_chave,PREFEITO)", "EqualTo(municipio_chave,X)"):
        assert pushed in shown
    cut = aggregates.overview(bind(files.open_fact(spark, str(tmp_path / "cut.parquet"))), scope)
    assert "PartitionFilters: [isnotnull(ANO_ELEICAO" in plan(cut)
    for df in (flat, cut):
        assert df.first()["votos_nominais"] == 2**60 + 1
    as_text = bind(rows.withColumn("QT_VOTOS_NOMINAIS_VALIDOS", F.col("QT_VOTOS_NOMINAIS_VALIDOS").cast("string")))
    assert aggregates.overview(as_text, Scope(2022, 1)).first()["votos_nominais"] == 2**60 + 1


def test_materialised_tables_can_be_removed(spark):
    from sufragio import session

    df = session.materialize(spark.range(5), "few")
    assert df.count() == 5 and session._WRITTEN
    path = session._WRITTEN[-1]
    session.clean(spark)
    fs, p = files._storage(path)
    assert not fs.exists(p) and not session._WRITTEN
