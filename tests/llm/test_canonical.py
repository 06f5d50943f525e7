import math
import random
from collections import Counter

from sufragio.llm import canonical as C

LIST = [("1", "SP", "SÃO FABRÍCIO"), ("2", "SP", "SÃO FABRÍCIO D'OESTE"), ("3", "RJ", "SÃO FABRÍCIO"), ("4", "SP", "PRESIDENTE DRIRMUÇU"), ("5", "SP", "VÁRZEA DO ANIL"), ("6", "RJ", "PEDRA DE CIMA"), ("7", "SP", "ITATINTINGA")]
CASES = [
    ("SP", "s. fabricio", None, "1"), (" sp ", None, "SAO  FABRYCIO", "1"), ("RJ", "SÃO FABRÍCIO", "São Fabrício", "3"), (None, "Sao Fabricio (RJ)", None, "3"), (None, "pres drirmuçu - sp", "", "4"),
    ("SP", "MUNICIPIO DE VARZEA ANIL/SP", None, "5"), ("SP", "itatinttinga", "ITATINTIGNA", "7"), ("SP", "S FABRICIO DOESTE", None, "2"), ("RJ", "PEDRA CIMA", "pedrra de cyma", "6"),
    ("SP", "PEDRA DE CIMA", None, None), ("SP", "TESTE", None, None), ("SP", "N/I", "000", None), ("ZZ", "SÃO FABRÍCIO", None, None), ("SP", None, None, None), ("SP", " ", "\t", None), (None, "SÃO FABRÍCIO", None, None), ("SP", "x" * 50_000, None, None),
]


def tables(spark, cases=CASES, listed=LIST):
    rows = spark.createDataFrame([(i, *c[:3], "k") for i, c in enumerate(cases)], "id bigint, uf string, a string, b string, key string")
    return rows, spark.createDataFrame(listed, "cd string, uf string, nome string")


def match(spark, *args):
    rows, listed = tables(spark, *args)
    return {r["id"]: r["__entry"] for r in C.match(rows, "uf", ["a", "b"], listed, "cd", "uf", "nome").collect()}


def test_cases(spark):
    assert match(spark) == {i: c[3] for i, c in enumerate(CASES)}


def test_salted_join_and_repeated_rows(spark, monkeypatch):
    real = C.measured
    monkeypatch.setattr(C, "measured", lambda df: (real(df)[0], False))
    cases = CASES[:3] * 30
    assert match(spark, cases) == {i: c[3] for i, c in enumerate(cases)}


def test_empty_list_rows_and_ambiguous_entries(spark):
    assert match(spark, CASES[:2], [("9", "AC", "OUTRO")]) == {0: None, 1: None}
    rows, listed = tables(spark)
    assert C.match(rows.limit(0), "uf", ["a", "b"], listed, "cd", "uf", "nome").count() == 0
    assert match(spark, [("SP", "IGUAL", None)], [("1", "SP", "IGUAL"), ("2", "SP", "Igual")]) == {0: None}


def grams(k):
    s = f"^{k}$"
    found = Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))
    found += Counter(f"{n}:" + "".join(sorted(s[i : i + n])) for n in (2, 3) for i in range(len(s) - n + 1))
    return {(g, i) for g, n in found.items() for i in range(n)}


def test_index_loses_no_candidate_and_cosine_equals_brute_force(spark):
    """Random keys of few letters: the best entry by brute force over all pairs."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("ABCDE") for _ in range(r.randint(3, 9)))
    entries = [("SP", k, str(i)) for i, k in enumerate({word() for _ in range(60)})]
    keys = sorted({word() for _ in range(80)} | {k[1:] for _, k, _ in entries[:20]} | {k for _, k, _ in entries[:10]})
    df = Counter(g for _, k, _ in entries for g in grams(k))
    n = len(entries)
    w = lambda g: math.log(1 + n / (1 + df[g])) if g in df else C.UNSEEN**2 * math.log(1 + n)
    norm = lambda k: sum(w(g) for g in grams(k))
    cos = lambda a, b: sum(w(g) for g in grams(a) & grams(b)) / math.sqrt(norm(a) * norm(b))
    got = C.match_keys(spark.createDataFrame([("SP", k) for k in keys], "scope string, key string"), spark.createDataFrame(entries, "scope string, key string, entry string"), 0.6, 0.0001, 0.0).collect()
    got = {x["key"]: (x["entry"], x["score"]) for x in got}
    for k in keys:
        scores = sorted(((cos(k, e), i) for _, e, i in entries), reverse=True)
        if scores[0][0] > 0.601 and scores[0][0] - scores[1][0] > 0.001:
            assert got[k][0] == scores[0][1] and abs(got[k][1] - scores[0][0]) < 1e-4
        elif scores[0][0] < 0.599:
            assert k not in got
