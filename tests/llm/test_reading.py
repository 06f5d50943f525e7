import math

from pyspark.sql import functions as F

from sufragio.llm import reading as R
from sufragio.llm import unigram as U

EASY, NEWS, SCHOOL, LAW = "O gato viu a urna. A moça leu o nome.", "O prefeito falou sobre a rua. O ônibus passou cedo.", "A legislação determina que as contas sejam apresentadas. Analistas observam a bancada.", "Outrossim, o acervo probatório prescinde de dilação. Destarte, a preclusão consumativa subsume-se."
TEXTS = [EASY, NEWS, SCHOOL, LAW]
DOCS = "doc_id bigint, text string, nivel string"


def levels(spark, docs, labels):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], DOCS)
    a = spark.createDataFrame(labels, "doc_id bigint, nivel int")
    return {r["doc_id"]: r for r in R.assess(d, a, "doc_id", "text", "nivel").collect()}


LABELLED = [(i, TEXTS[i % 4] + f" {i}") for i in range(40)]
LABELS = [(i, i % 4 + 1) for i in range(40)] + [(3, 3), (5, None), (999, 4), (7, 9)]


def test_levels_edges_and_whole_text(spark):
    docs = LABELLED + [(100, (LAW + " ") * 9 + EASY), (101, (EASY + "\n") * 9 + LAW), (102, None), (103, "  \n"), (104, "urna"), (105, "..."), (106, (LAW + " ") * 4000), (107, LAW.upper()), (107, LAW)]
    got = levels(spark, docs, LABELS)
    assert [got[i]["nivel"] for i in range(40)] == [i % 4 + 1 for i in range(40)]
    assert got[100]["nivel"] == 4 and got[101]["nivel"] == 1 and got[106]["nivel"] == 4 and got[107]["nivel"] == 4
    assert got[102]["nivel"] is None and got[103]["nivel"] is None and got[105]["nivel"] is None and got[104]["nivel"] == 1
    assert got[102]["palavras"] == 0 and got[104]["palavras"] == 1


def test_formula_seeds_and_empty(spark):
    docs = [(i, t * 3) for i, t in enumerate(["A urna. O voto. O sol. Eu vi. ", "Desproporcionalidade constitucional intempestivamente reconhecida pressupondo inconstitucionalidade superveniente das representatividades "])] * 1
    got = levels(spark, docs, [])
    assert got[0]["nivel"] < got[1]["nivel"]
    assert levels(spark, [], []) == {} and levels(spark, [], LABELS) == {}


def test_python_and_spark_words_agree(spark):
    text = "Ação nº 12.345: «Órgão» – é ÇÃO? x1y2 | # fim"
    got = spark.createDataFrame([(text,)], "t string").select(U.words_of(F.col("t"))).first()[0]
    assert got == U.words(text) and "#" in got


def test_scores_equal_brute_force(spark):
    """Posteriors of pieces, in chunks of any size, against plain arithmetic."""
    rows = [("urna", 3.0, 1.0, 0.0, 0.0), ("voto", 1.0, 2.0, 4.0, 0.0), ("#", 0.0, 1.0, 1.0, 1.0)]
    model = U.Unigram(spark.createDataFrame(rows, "word string, c1 double, c2 double, c3 double, c4 double"), ["c1", "c2", "c3", "c4"])
    text = "Urna urna voto. Sim. Voto 12 urna nova! " + "voto " * 95 + "Fim."
    pieces = [["urna", "urna", "voto"], ["sim", "voto", "#", "urna", "nova"]]
    long = ["voto"] * 95 + ["fim"]  # three even parts
    pieces += [long[i * 96 // 3 : (i + 1) * 96 // 3] for i in range(3)]
    counts = {w: c for w, *c in rows}
    totals = [sum(r[g + 1] for r in rows) + 0.1 * 4 for g in range(4)]
    want = [0.0] * 4
    for piece in pieces:
        s = [sum(math.log((counts.get(w, [0] * 4)[g] + 0.1) / totals[g]) for w in piece) for g in range(4)]
        e = [math.exp(x - max(s)) for x in s]
        want = [a + x / sum(e) / len(pieces) for a, x in zip(want, e)]
    for chunk in (1, 1000):
        U.CHUNK, old = chunk, U.CHUNK
        got = R.posteriors([None, text, "...", text], model)
        U.CHUNK = old
        assert abs(got[1] - want).max() < 1e-12 and abs(got[3] - want).max() < 1e-12 and math.isnan(got[0][0]) and math.isnan(got[2][0])


def test_held_out_accuracy(spark):
    """On the labelled sample: trained on four fifths, the rest is judged right for the most part."""
    import pandas as pd

    base = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text")
    lab = spark.read.parquet(f"{base}/rotulos_leitura.parquet").dropna().select("doc_id", "nivel").toPandas().drop_duplicates("doc_id")
    test = lab[lab.doc_id % 5 == 0]
    texts = R.labelled(docs, spark.createDataFrame(lab[lab.doc_id % 5 != 0]), "doc_id", "text", "nivel")
    held = docs.join(spark.createDataFrame(test), "doc_id").toPandas()
    seen = {r[0] for r in texts.select("__text").collect()}
    held = held[~held.text.isin(seen) & held.text.notna()]
    model = R.train(texts)
    guess = pd.Series(R.posteriors(held.text.tolist(), model).argmax(axis=1) + 1, index=held.index)
    assert len(held) > 50 and (guess == held.nivel).mean() > 0.85 and ((guess == 4) == (held.nivel == 4)).mean() > 0.93
