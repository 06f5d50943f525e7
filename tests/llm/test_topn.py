import random

from pyspark.sql import functions as F

from sufragio.llm import topn
from sufragio.llm.topn import top_n

SCHEMA = "id bigint, g string, v bigint, posicao int, extra string"


def run(spark, rows, n, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    out = top_n(df, {"g": F.upper(F.trim("g"))}, "v", [("id", True)], n, ["id"])
    return sorted((r["g"], r["posicao"], r["id"]) for r in out.collect())


def brute(rows, n):
    groups = {}
    for i, g, v, _, _ in rows:
        if g is not None and v is not None:
            groups.setdefault(g.strip(" ").upper(), []).append((-v, i))
    return sorted((g, k, i) for g, rs in groups.items() for k, (_, i) in enumerate(sorted(rs)[:n], 1))


def test_hot_group_ties_and_nulls(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "A ", "a", "b", "c", None]), r.choice([1, 2, 3, 3, None, -5]), 0, "x") for i in range(600)]
    rows += [(1000 + i, f"g{i}", 1, 0, "x") for i in range(50)]  # groups below N have no bound
    for n in (1, 3, 7):
        assert run(spark, rows, n) == brute(rows, n)


def test_repeated_rows_and_empty(spark):
    assert run(spark, [(1, "a", 5, 0, ""), (1, "a", 5, 0, ""), (2, "a", 4, 0, "")], 2) == [("A", 1, 1), ("A", 2, 1)]
    assert run(spark, [], 3) == [] and run(spark, [(1, "a", 1, 0, "")], 0) == []


def test_local_best_moves_nothing(spark):
    df = spark.createDataFrame([(i, "a", i, 0, "") for i in range(100)], SCHEMA).repartition(4)
    narrow = df.select(F.col("g").alias("__g0"), F.col("v").alias("__score"), "id")
    local = topn.local_best(narrow, ["__g0"], [("__score", "descending"), ("id", "ascending")], 5)
    before = narrow._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert local._jdf.queryExecution().executedPlan().toString().count("Exchange") == before
    assert local.count() == 20 and local.agg(F.max("__rank")).first()[0] == 5


def test_bound_drops_rows_and_large_bounds_join_without_broadcast(spark, monkeypatch):
    rows = [(i, f"g{i % 40}", i % 97, 0, "x") for i in range(4000)]
    monkeypatch.setattr(topn, "HELD", 64)
    monkeypatch.setattr(topn, "measured", lambda df: (df, False))
    assert run(spark, rows, 4) == brute(rows, 4)


def test_descending_ties_nulls_last_and_nan(spark):
    df = spark.createDataFrame([(1, "a", 1.0, "b"), (2, "a", 1.0, None), (3, "a", 1.0, "c"), (4, "a", float("nan"), "z"), (5, "a", None, "z")], "id bigint, g string, v double, t string")
    out = top_n(df, {"g": F.col("g")}, "v", [("t", False)], 9, ["id", "t"])
    assert [r["id"] for r in out.orderBy("posicao").collect()] == [3, 1, 2]
