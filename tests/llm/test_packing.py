import random

import pytest

from sufragio.llm import packing as P


def check(spark, sizes, capacity, **kw):
    df = spark.createDataFrame(list(enumerate(sizes)), "id bigint, n bigint")
    rows = P.pack(df, "id", "n", capacity).collect()
    fill, parts = {}, {}
    for r in rows:
        fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
        parts.setdefault(r["id"], []).append((r["inicio"], r["tokens"]))
    assert all(0 < f <= capacity for f in fill.values())
    for i, n in enumerate(sizes):
        own = sorted(parts.get(i, []))
        assert sum(t for _, t in own) == (n or 0)
        assert len(own) == (-(-n // capacity) if n else 0)  # cut only if longer than a container
        assert [s for s, _ in own] == [k * capacity for k in range(len(own))]
    return fill


def test_whole_items_and_tight_fill(spark):
    r = random.Random(5)
    sizes = [r.randint(1, 700) for _ in range(900)] + [0, None, 5000, 1000, 1000]
    fill = check(spark, sizes, 1000)
    total = sum(n or 0 for n in sizes)
    assert len(fill) <= -(-total // 1000) + 1


def test_several_shards_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 60)
    r = random.Random(6)
    sizes = [r.randint(1, 400) for _ in range(500)]
    fill = check(spark, sizes, 1000)
    assert len(fill) <= sum(sizes) / 1000 * 1.05 + 1


def test_items_that_never_fit_together_end_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD", 10)
    assert len(check(spark, [600] * 75, 1000)) == 75


def test_summary_and_breaches(spark):
    items = spark.createDataFrame([(1, 7), (2, 5), (3, 25), (4, 0), (5, None)], "id bigint, n bigint")
    packed = P.pack(items, "id", "n", 10)
    got = P.summary(packed, 10).first()
    assert (got["minimo"], got["tokens"]) == (4, 37) and got["containers"] >= 4
    assert tuple(P.kept(packed, items, "id", "n", 10).first()) == (0, 0, 0, 3)
    bad = spark.createDataFrame([("a", 1, 0, 7), ("a", 2, 0, 5), ("b", 3, 0, 10)], "container string, id bigint, inicio bigint, tokens bigint")
    assert tuple(P.kept(bad, items, "id", "n", 10).first()) == (1, 1, 1, 3)


def test_local_search_empties_containers():
    sizes = [6, 6, 4, 4, 5, 5, 5, 5, 3, 3, 2, 2]
    start = [[0], [1], [2, 3], [4], [5], [6], [7], [8, 9], [10, 11]]
    out = P.improve(sizes, start, 10)
    assert len(out) <= 6 and sorted(i for b in out for i in b) == list(range(len(sizes)))
    assert P.pack_sizes([], 5) == []


@pytest.mark.parametrize("seed", range(4))
def test_search_never_worsens_or_loses(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, 50) for _ in range(80)]
    start = [[i] for i in range(len(sizes))]
    out = P.improve(sizes, start, 60)
    assert sorted(i for b in out for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 60 for b in out)
    assert len(out) <= -(-sum(sizes) // 60) * 1.1 + 1


def test_empty_and_errors(spark):
    assert check(spark, [], 10) == {} and check(spark, [0, None], 10) == {}
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([], "id bigint, n bigint"), "id", "n", 0)
