import pytest
from pyspark.sql import functions as F

from sufragio.llm import linkage as L

PEOPLE = [
    (100, "JOSÉ ANTÔNIO PRALCATTO SILDURY", "01/02/1970", "12345678901"), (101, "JOSE ANTONIO PRALCATTO SILDURY", "1970-02-01", None), (102, "MARIA DALVA ZORVEIRA", "15/08/1980", "98765432109"),
    (103, "MARIA DALVA ZORVEIRA", "03/03/1955", "55544433322"), (104, "TAÍS NIRMÃO PASTEÇA", "18/03/1969", "04341162338"), (105, "SEBASTIÃO GERALDO BALCANO", "09/11/1951", "60613209700"),
]
OLD = [
    (1, "PRALCATTO SILDURY, JOSÉ A.", "01021970", "123.456.789-01", {100, 101}), (2, "ZÉ ANTONIO PRALCATO SILDURY", "02/02/70", None, {100, 101}), (3, "MARIA DALVA ZORVEIRA", "15-ago-1980", "***.654.321-**", {102}),
    (4, "GRAÇA NIRMÃO PASTEÇA", "18/03/1969", "11122233344", set()), (5, "TIAO GERALDO BALCANO", "09/11/51", "67613209700", {105}), (6, "MARIA DALVA ZORVEIRA", "20/07/1991", "77788899900", set()),
    (7, None, None, None, set()), (8, "", "01/01/1900", "000.000.000-00", set()), (9, "HELENA OUTRA PESSOA", "05/09/1988", "12345678901", set()), (10, "José Antonio Novonome", None, "12345678901", {100, 101}),
    (11, "PRALCATTO SILDURY, JOSÉ A.", "01021970", "123.456.789-01", {100, 101}), (12, "X " * 20_000, "01/01/1980", None, set()),
]
SHAPE = "nome string, nasc string, cpf string, score string"


def background():
    """Persons that make the weights learnable: found again with and without number, and siblings who are others."""
    import random

    r = random.Random(8)
    part = lambda n: "".join(r.choice(["BRA", "CO", "DU", "FRI", "GA", "LEM", "MO", "NIR", "PA", "RU", "SA", "TOR", "VI", "ZEN"]) for _ in range(n))
    firsts, old, new = [part(2) + x for x in "AOES" for _ in range(12)], [], []
    for i in range(600):
        first, family, date, number = r.choice(firsts), f"{part(3)} {part(3)}", f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(1940, 1999)}", "".join(r.choice("0123456789") for _ in range(11))
        new.append((5000 + i, f"{first} {family}", date, number))
        if i < 300:
            k = r.randrange(11)
            wrong = number[:k] + r.choice("0123456789") + number[k + 1 :]
            old.append((5000 + i, r.choice([f"{first} {family}", f"{first} {family.split()[1]}", f"{first} {family[:-1]}O"]), r.choice([date, date, date, None]), r.choice([number, number, wrong, None])))
            if old[-1][2] is None and old[-1][3] is None:
                old[-1] = (*old[-1][:3], number)
        elif i < 450:
            old.append((5000 + i, f"{r.choice([f for f in firsts if f != first])} {family}", date, "".join(r.choice("0123456789") for _ in range(11))))
    return old, new


def link(spark, old, new, others=True):
    if others and old and new:
        more = background()
        old, new = list(old) + more[0], list(new) + more[1]
    a = spark.createDataFrame([(i, n, d, c, "clash") for i, n, d, c, *_ in old], f"old bigint, {SHAPE}")
    b = spark.createDataFrame([(i, n, d, c, "clash") for i, n, d, c in new], f"new bigint, {SHAPE}")
    return L.link(a, b, "old", "new", "nome", "nasc", "cpf")


def test_pairs_and_confidence(spark):
    out = link(spark, OLD, PEOPLE + PEOPLE[:1]).collect()
    pairs = [(r["old"], r["new"]) for r in out if r["old"] < 5000]
    found = {(r["old"], r["new"]) for r in out if r["old"] >= 5000}
    true = {(i, i) for i in range(5000, 5300)}
    assert len(found & true) >= 297 and len(found - true) <= 3
    assert sorted(pairs) == sorted((o[0], n) for o in OLD for n in o[4])
    assert all(0 <= r["confidence"] <= 1 for r in out)


def test_empty_sides(spark):
    assert link(spark, [], PEOPLE).count() == 0 and link(spark, OLD, []).count() == 0


@pytest.mark.parametrize("written,number", [("123.456.789-01", "12345678901"), (" 12345678-01", "01234567801"), ("***.456.789-**", "***456789**"), ("000.000.000-00", None), ("-4", None), ("NÃO DIVULGÁVEL", None), (None, None), ("1220041441", "01220041441")])
def test_person_number(spark, written, number):
    df = spark.createDataFrame([(written,)], "c string")
    assert df.select(L.person_number(F.col("c"))).first()[0] == number


@pytest.mark.parametrize("written,date", [("01/02/1970", "700201"), ("1970-02-01", "700201"), ("01021970", "700201"), ("01-fev-1970", "700201"), ("01/02/70", "700201"), ("01/01/1900", None), ("00/00/0000", None), ("x", None), (None, None)])
def test_birth_date(spark, written, date):
    assert spark.createDataFrame([(written,)], "c string").select(L.birth_date(F.col("c"))).first()[0] == date


def met(a, b):
    """Whether two encoded records share an undamaged combination, told without the index."""
    digits = lambda x: [x["cpf"][i:j] if x["cpf"] and "*" not in x["cpf"] else None for i, j in ((0, 3), (3, 6), (6, 9), (9, 11))]
    equal = lambda u, v: sum(p is not None and p == q for p, q in zip(u, v))
    words = lambda x: {x["bf"], *x["bw"]} - {0}
    date = lambda x: [x["date"][:2], x["date"][2:4], x["date"][4:]] if x["date"] else [None] * 3
    shared, same = len(words(a) & words(b)), equal(date(a), date(b))
    turned = a["date"] and b["date"] and date(a)[0] == date(b)[0] and a["md"] == b["md"]
    return equal(digits(a), digits(b)) >= 2 or (shared >= 1 and bool(turned)) or (shared >= 2 and same >= 2)


def test_every_pair_within_the_radius_meets(spark):
    """Multi-index hashing is exact for the number, the date and the name words alike."""
    import random

    r = random.Random(4)
    base = ("FERNANDO LIMEIRA GUTERRES PALMEIRAM", "14/09/1961", "48291730564")

    def damaged(name, date, number):
        name, number = list(name), list(number)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(name))
            if name[k] != " ":
                name[k] = r.choice("ABCDEGILMNORSTU")
        for _ in range(r.randint(0, 5)):
            number[r.randrange(11)] = str(r.randint(0, 9))
        d, m, y = date.split("/")
        d, m = (f"{r.randint(1, 12):02d}" if r.random() < 0.3 else d), (f"{r.randint(1, 12):02d}" if r.random() < 0.3 else m)
        y = str(r.randint(1950, 1999)) if r.random() < 0.3 else y
        return "".join(name), r.choice([f"{d}/{m}/{y}", f"{m}/{d}/{y}", None]), r.choice(["".join(number), None])

    rows = [(i, *(damaged(*base) if i else base)) for i in range(160)]
    x = L.encode(L.normalised(spark.createDataFrame(rows, "i bigint, n string, d string, c string"), "n", "d", "c", ["i"]), ["i"])
    x = x.select("i", "cpf", "date", "md", "bf", "bw", L._keys().alias("k")).collect()
    for a in x[:40]:
        for b in x:
            assert not met(a, b) or set(a["k"]) & set(b["k"]), (rows[a["i"]], rows[b["i"]])


def test_errors_in_first_and_last_name(spark):
    """Equal dates, no number on one side, one wrong letter in the first and in the last name."""
    old = [(1, "FERNANDO LIMEIRA GUTERRES PALMEIRAM", "14/09/1961", None, set())]
    new = [(7, "FERNANDA LIMEIRA GUTERRES PALMEIRIM", "14/09/1961", "48291730564")]
    e = lambda rows, s: L.encode(L.normalised(spark.createDataFrame([r[:4] for r in rows], "id bigint, n string, d string, c string"), "n", "d", "c", ["id"]), ["id"])
    keys = [set(e(x, "").select(L._keys()).first()[0]) for x in (old, new)]
    assert keys[0] & keys[1]


def test_weights_are_learned():
    """Counts of cells of two fields that tell matches: the posterior follows them."""
    cell = lambda *at: int(__import__("numpy").ravel_multi_index(at, L.SIZES))
    cells = {cell(1, 1, 1, 1): 900, cell(3, 5, 4, 6): 1000, cell(7, 5, 4, 6): 3000, cell(0, 1, 1, 1): 100, cell(0, 1, 1, 6): 40, cell(3, 1, 1, 6): 400}
    p = L.confidences(cells, {"l": 3000.0, "r": 3000.0, "ln": 2500.0, "rn": 2500.0, "lc": 2000.0, "rc": 2500.0})
    assert p[cell(1, 1, 1, 1)] > 0.99 and p[cell(0, 1, 1, 1)] > 0.9 and p[cell(0, 1, 1, 6)] < 0.5 and p[cell(3, 1, 1, 6)] < 0.01
    assert L.confidences({}, {}) == {}
