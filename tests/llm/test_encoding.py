import pytest

from sufragio.llm import encoding as E

CLEAN = ["JOÃO GRAÇA", "CONCEIÇÃO MÁRIO", "JOSÉ ANTÔNIO", "LÚCIA JÚNIOR", "VINÍCIUS GRAÇA", "JOÃO MÁRIO", "INÊS NUÑARES", "ZÉ CADÊ? JÚNIOR", "“ZECA” GRAÇA", "D’ÁVIRO MÜHLBERT", "JÔ… NAÏR"]


def chain(text, written, read):
    return text.encode(written).decode(read)


BAD = {
    chain("JOÃO GRAÇA", "utf-8", "latin-1"): "JOÃO GRAÇA", chain("CONCEIÇÃO MÁRIO", "utf-8", "cp850"): "CONCEIÇÃO MÁRIO", chain("JOSÉ ANTÔNIO", "utf-8", "mac_roman"): "JOSÉ ANTÔNIO",
    chain("LÚCIA JÚNIOR", "latin-1", "cp850"): "LÚCIA JÚNIOR", chain("JOÃO GRAÇA", "latin-1", "mac_roman"): "JOÃO GRAÇA",
    chain(chain("JOÃO MÁRIO", "utf-8", "latin-1"), "utf-8", "latin-1"): "JOÃO MÁRIO", "JO�O MÁRIO": "JOÃO MÁRIO", "JOS? ANT?NIO": "JOSÉ ANTÔNIO", "GRAÃA": "GRAÇA",
}


@pytest.mark.parametrize("text", CLEAN)
@pytest.mark.parametrize("chain_,written,read", [("utf8>win", "utf-8", "latin-1"), ("utf8>dos", "utf-8", "cp850"), ("utf8>dos", "utf-8", "cp437"), ("utf8>mac", "utf-8", "mac_roman")])
def test_round_trip_of_words(text, chain_, written, read):
    for w in text.split(" "):
        if not w.isascii():
            once = chain(w, written, read)
            assert E.restored(once)[chain_] == w
            assert E.restored(chain(once, written, read))[chain_] == w


def test_text_damaged_many_times():
    word = "JOÃO"
    for _ in range(7):
        word = chain(word, "utf-8", "latin-1")
    assert E.restored(word)["utf8>win"] == "JOÃO"


def test_refill_is_the_best_of_all_ways():
    import itertools

    model = E.WordModel({"^^J": 4.0, "^JO": 3.0, "JOÃ": 3.0, "OÃO": 3.0, "ÃO$": 3.0, "^JÉ": 1.0, "JÉÇ": 1.0, "ÉÇA": 1.0, "ÇA$": 1.0})
    for word in ("J?O", "?O", "J??A", "JO?", "?"):
        fixed, score = model.refill(word)
        ways = {"".join(c) for form in {word, word.replace("??", "?")} for c in itertools.product(*[E.REFILL if ch == "?" else ch for ch in form])}
        assert fixed in ways and abs(score - max(model.score(w) for w in ways)) < 1e-9


def test_planted_damage_is_found_and_undone(spark):
    """Restored against the text before the damage, over chains, sources and fields."""
    import random

    r = random.Random(6)
    firsts, lasts = ["JOÃO", "JOSÉ", "CONCEIÇÃO", "ANTÔNIO", "LÚCIA", "MÁRIO", "INÊS", "PEDRO"], ["GRAÇA", "JÚNIOR", "SILVA", "FRANÇA", "GALVÃO", "LEITÃO", "COSTA"]
    pages = [("utf-8", "latin-1"), ("utf-8", "cp850"), ("latin-1", "cp850"), ("latin-1", "mac_roman")]
    rows, true = [], {}
    for i in range(1500):
        text = f"{r.choice(firsts)} {r.choice(lasts)} {r.choice(lasts)}"
        if i % 15 == 0 and not text.isascii():
            true[i] = text
            text = chain(text, *pages[i % 4])
        rows.append((i, r.choice(["SP", "RJ"]), text))
    found = {x["row_id"]: x["restored"] for x in E.find(spark.createDataFrame(rows, "row_id bigint, uf string, nome string"), "uf", ["nome"], "row_id").collect()}
    assert set(found) == set(true) and sum(found[i] == true[i] for i in true) >= 0.98 * len(true)


def test_capitals_after_the_damage():
    assert E.restored(chain("josé", "utf-8", "latin-1").upper())["utf8>win"] == "JOSÉ"
    assert E.restored(chain("condões", "utf-8", "latin-1").upper())["utf8>win"] == "CONDÕES"


def test_find_and_restore(spark):
    rows = [(k, "SP", v, "x") for k, v in enumerate(CLEAN * 40)] + [(10_000 + k, None, v, "x") for k, v in enumerate(BAD)]
    rows += [(20_000, "SP", None, "x"), (20_001, "SP", "", "x"), (20_002, "SP", "PLAIN TEXT", "x"), (20_003, "RJ", "JO�O MÁRIO", "x"), (20_004, "RJ", "JO�O MÁRIO", "x")]
    df = spark.createDataFrame(rows, "row_id bigint, uf string, nome string, chain string")
    found = {r["row_id"]: r for r in E.find(df, "uf", ["nome"], "row_id").collect()}
    assert set(found) == {*range(10_000, 10_000 + len(BAD)), 20_003, 20_004}
    for k, good in enumerate(BAD.values()):
        assert found[10_000 + k]["restored"] == good
    assert all(0.5 < r["confidence"] <= 1 for r in found.values())


def test_empty_table_and_salted_join(spark, monkeypatch):
    schema = "row_id bigint, uf string, nome string"
    assert E.find(spark.createDataFrame([], schema), "uf", ["nome"], "row_id").count() == 0
    monkeypatch.setattr(E, "measured", lambda df: (df, False))
    df = spark.createDataFrame([(k, "SP", "JOÃO") for k in range(200)] + [(500, "SP", "JO�O")], schema)
    assert [r["row_id"] for r in E.find(df, "uf", ["nome"], "row_id").collect()] == [500]


def test_very_long_word(spark):
    df = spark.createDataFrame([(1, "SP", "JOÃO"), (2, "SP", "Ã" * 30_000), (3, "SP", "A" * 30_000 + "�")], "row_id bigint, uf string, nome string")
    assert 3 in {r["row_id"] for r in E.find(df, "uf", ["nome"], "row_id").collect()}
