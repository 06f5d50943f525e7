import os

import pytest

from sufragio.llm import mixing as M
from sufragio.llm.tokens import sizes, tokenizer_path

pytestmark = pytest.mark.skipif(not os.path.exists(tokenizer_path()), reason="no tokenizer files")
DOCS = "doc_id bigint, text string, source string, tokens string"
TARGETS = "source string, peso double, max_repeticoes int"


def docs(spark):
    rows = [(i, f"voto urna eleitor {i} " * 10, ["A", "a ", "Á", "a"][i % 4], "clash") for i in range(300)]
    rows += [(1000 + i, f"juiz recurso acordao {i} " * 10, "b c" if i % 2 else "B-C", "clash") for i in range(60)]
    rows += [(2000 + i, "juiz recurso acordao " * 10, None, "clash") for i in range(5)]
    rows += [(3000, None, "a", ""), (3001, "", None, ""), (3002, "fora da lista " * 5, "z", "")]
    return spark.createDataFrame(rows, DOCS)


def test_shares_caps_and_report(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b_c", 0.4, 4), ("nada", 0.1, 2)], TARGETS)
    chosen, report = M.mix(docs(spark), targets, "doc_id", "text", "source")
    got = {r["fonte"]: r for r in report.collect()}
    assert got["nada"]["tokens"] == 0 and got["nada"]["parte"] == 0
    assert abs(got["a"]["parte"] - 5 / 9) < 0.01 and abs(got["b_c"]["parte"] - 4 / 9) < 0.01
    assert got["a"]["limitante"] and not got["b_c"]["limitante"] and got["a"]["erro"] < 0.001
    rows = chosen.collect()
    assert max(r["repeticoes"] for r in rows if r["fonte"] == "a") == 1 and max(r["repeticoes"] for r in rows if r["fonte"] == "b_c") <= 4
    assert not {3000, 3001, 3002} & {r["doc_id"] for r in rows}
    assert len({r["doc_id"] for r in rows}) == len(rows)


def test_budget_below_and_beyond_the_scarcest_source(spark):
    targets = spark.createDataFrame([("a", 0.5, 3), ("b_c", 0.5, 5)], TARGETS)
    chosen, _ = M.mix(docs(spark), targets, "doc_id", "text", "source", budget=4000.0)
    assert abs(sum(r["tokens"] * r["repeticoes"] for r in chosen.collect()) - 4000) < 80
    targets = spark.createDataFrame([("a", 0.5, 1), ("b_c", 0.5, 1)], TARGETS)
    chosen, report = M.mix(docs(spark), targets, "doc_id", "text", "source", budget="all")
    got = {r["fonte"]: r for r in report.collect()}
    assert all(r["tokens"] == r["disponivel"] and r["limitante"] for r in got.values())  # nothing is left over


@pytest.mark.parametrize("have,weights,budget,want", [([100, 100], [1, 1], None, [100, 100]), ([100, 10], [1, 1], None, [10, 10]), ([100, 10], [1, 1], 60, [50, 10]), ([100, 10, 0], [1, 1, 5], 999, [100, 10, 0]), ([0, 0], [1, 1], None, [0, 0]), ([100, 100], [3, 1], 80, [60, 20])])
def test_targets_within_what_there_is(have, weights, budget, want):
    assert M.shared_out([float(h) for h in have], [float(w) for w in weights], budget) == want


def test_systematic_rounding_keeps_sums(spark):
    import random

    r = random.Random(2)
    rows = [(i, r.choice("xyy"), r.randint(1, 900), r.choice([0.0, 0.4, 1.3, r.random()])) for i in range(3000)]
    got = M.rounded(spark.createDataFrame(rows, "id bigint, fonte string, tokens bigint, rate double"), "id").collect()
    assert len(got) == 3000 and all(abs(g["repeticoes"] - g["rate"]) < 1 for g in got)
    for s in "xy":
        assert abs(sum(g["tokens"] * (g["repeticoes"] - g["rate"]) for g in got if g["fonte"] == s)) <= 900


def test_repairs():
    assert M.repairs(0.0, [(5, 1)], [(7, 2)]) == []
    got = M.repairs(100.0, [(50, 1), (20, 2)], [(120, 3), (90, 4), (3, 5)])
    assert sum({1: 50, 2: 20, 3: 120, 4: 90, 5: 3}[k] * s for k, s in got) == 100


def test_empty(spark):
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    chosen, report = M.mix(spark.createDataFrame([], DOCS), targets, "doc_id", "text", "source")
    assert chosen.count() == 0 and report.first()["parte"] == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "uma frase"), (2, None), (3, ""), (4, "<|endoftext|>"), (5, "a" * 100_000), (6, "uma frase")], "id bigint, t string")
    got = {r["id"]: r["tokens"] for r in sizes(df, "id", "t").collect()}
    assert got[1] == got[6] > 0 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 100
