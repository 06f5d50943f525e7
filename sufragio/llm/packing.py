"""Put items of varying length into containers of fixed capacity.

Items longer than a container are cut into pieces of the capacity and a rest; no other item is
cut. Items are dealt by hash into shards of about SHARD items, each packed on its own: best fit
by falling size, then swap-based local search. The search takes the emptiest container as donor
and moves items, exchanges one for one, two for one or one for two with the other underfull
containers whenever that raises the sum of squared fills, so donors drain until they are empty;
it ends when no exchange helps or the containers are as few as the total size allows. Containers
left under REOPEN of the capacity are opened again and their items dealt anew, until one shard is
left or a round neither closes a container nor lowers the number of open ones. Each round deals its
shards to as many partitions as there are tasks, by shard, so that none is joined with others for
being few bytes; no task holds more than a few times SHARD items.

Defined cases: items without size go nowhere; equal sizes are ordered by key; repeated keys are
separate items; an empty table gives no containers; a capacity below 1 is an error.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sufragio.session import materialize

SHARD, REOPEN = 4000, 0.98


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions in sizes: best fit by falling size."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, container), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            left, b = capacity - sizes[i], len(bins) - 1
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            left -= sizes[i]
        insort(room, (left, b))
    return bins


def _exchange(sizes: list[int], donor: list[int], taker: list[int], gap: int) -> tuple[list[int], list[int]] | None:
    """The items to give and to take back that fill the taker's gap most, of the exchanges
    one-none, one-one, two-one and one-two; None if nothing fits."""
    give = sorted(donor, key=lambda i: (sizes[i], i))
    gs = [sizes[i] for i in give]
    best, found = 0, None

    def single(limit: int) -> int:
        return bisect_right(gs, limit) - 1

    at = single(gap)
    if at >= 0:
        best, found = gs[at], ([give[at]], [])
    for x in sorted(taker, key=lambda i: (sizes[i], i)):
        if best == gap:
            break
        limit = gap + sizes[x]
        at = single(limit)
        if at >= 0 and gs[at] - sizes[x] > best:
            best, found = gs[at] - sizes[x], ([give[at]], [x])
        low, high = 0, len(gs) - 1  # the two of the donor whose sum comes nearest from below
        while low < high:
            total = gs[low] + gs[high]
            if total > limit:
                high -= 1
                continue
            if total - sizes[x] > best:
                best, found = total - sizes[x], ([give[low], give[high]], [x])
            low += 1
    if best < gap and give:
        back = sorted(taker, key=lambda i: (sizes[i], i))
        bs = [sizes[i] for i in back]
        for y in give:
            low, high = 0, len(bs) - 1  # one of the donor for two of the taker
            while low < high:
                change = sizes[y] - bs[low] - bs[high]
                if change > gap:
                    low += 1
                    continue
                if change > best:
                    best, found = change, ([y], [back[low], back[high]])
                high -= 1
    return found


def improve(sizes: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Local search from the emptiest container on; every exchange makes the fuller of two
    containers fuller still, so the sum of squared fills rises and the search ends."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    alive = {b for b in range(len(bins)) if fill[b]}
    moved = True
    while moved and len(alive) > least:
        moved = False
        for donor in sorted(alive, key=lambda b: (fill[b], b)):
            if len(alive) <= least:
                break
            if fill[donor] == capacity:
                continue
            for taker in sorted((b for b in alive if b != donor and fill[donor] <= fill[b] < capacity), key=lambda b: (-fill[b], b)):
                while fill[donor] and fill[donor] <= fill[taker] < capacity and (x := _exchange(sizes, bins[donor], bins[taker], capacity - fill[taker])):
                    give, back = set(x[0]), set(x[1])
                    change = sum(sizes[i] for i in give) - sum(sizes[i] for i in back)
                    if change <= 0:
                        break
                    bins[donor] = [i for i in bins[donor] if i not in give] + sorted(back)
                    bins[taker] = [i for i in bins[taker] if i not in back] + sorted(give)
                    fill[donor], fill[taker], moved = fill[donor] - change, fill[taker] + change, True
                if not fill[donor]:
                    alive.discard(donor)
                    break
            if moved:
                break
    return [bins[b] for b in sorted(alive)]


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    return improve(sizes, best_fit(sizes, capacity), capacity) if sizes else []


def cut(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """key, inicio, tokens: one row per item, more where an item is longer than a container."""
    n = F.ceil(F.col(size) / capacity).cast("int")
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("bigint") * capacity)
    rows = items.filter(F.col(size) > 0).select(F.col(key), F.col(size).alias("__s"), F.explode(starts).alias("inicio"))
    return rows.select(key, "inicio", F.least(F.col("__s") - F.col("inicio"), F.lit(capacity).cast("bigint")).alias("tokens"))


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """container, key, inicio (offset in the item), tokens: the content of each container."""
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    kind = items.schema[key].dataType.simpleString()
    open_items = materialize(cut(items, key, size, capacity), "pieces")

    def packer(name: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([key, "inicio"], kind="stable").reset_index(drop=True)
            shard = f"{name}-{pdf['shard'].iloc[0]}"
            sizes = pdf["tokens"].tolist()
            where, full = [""] * len(sizes), [0] * len(sizes)
            for b, content in enumerate(pack_sizes(sizes, capacity)):
                total = sum(sizes[i] for i in content)
                for i in content:
                    where[i], full[i] = f"{shard}-{b}", total
            return pdf.assign(container=where, cheio=full)[["container", key, "inicio", "tokens", "cheio"]]

        return run

    spark = items.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    done, rounds, before = [], 0, None
    while True:
        shards = max(1, -(-open_items.count() // SHARD))
        shard = F.pmod(F.xxhash64(F.lit(rounds), F.col(key), F.col("inicio")), F.lit(shards))
        dealt = open_items.withColumn("shard", shard).repartition(min(shards, tasks), "shard")
        packed = dealt.groupBy("shard").applyInPandas(packer(f"r{rounds}"), f"container string, {key} {kind}, inicio bigint, tokens bigint, cheio bigint")
        packed = materialize(packed, "packed")
        rounds += 1
        full = F.col("cheio") >= REOPEN * capacity
        now = packed.groupBy("container").agg(F.max("cheio").alias("cheio")).agg(F.count_if(full).alias("closed"), F.count_if(~full).alias("open")).first()
        if shards == 1 or now["open"] == 0 or (now["closed"] == 0 and before is not None and now["open"] >= before):
            done.append(packed)
            break
        before = now["open"]
        done.append(packed.filter(full))
        open_items = packed.filter(~full).select(key, "inicio", "tokens")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("container", key, "inicio", "tokens")


def summary(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, the fewest that the tokens allow, tokens, and containers under REOPEN."""
    each = packed.groupBy("container").agg(F.sum("tokens").alias("t"))
    total = F.coalesce(F.sum("t"), F.lit(0))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.ceil(total / capacity).alias("minimo"), total.alias("tokens"), F.count_if(F.col("t") < REOPEN * capacity).alias("abertos"))


def kept(packed: DataFrame, items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """What must hold, each as the number of breaches: containers beyond the capacity, items whose
    pieces do not make up their size, and items cut though they fit."""
    over = packed.groupBy("container").agg(F.sum("tokens").alias("t")).agg(F.count_if(F.col("t") > capacity)).scalar()
    mine = packed.groupBy(key).agg(F.sum("tokens").alias("__t"), F.count(F.lit(1)).alias("__n"), F.count_distinct("inicio").alias("__i"))
    each = items.select(key, F.col(size).alias("__s")).join(mine, key, "full")
    lost = F.coalesce("__t", F.lit(0)) != F.coalesce("__s", F.lit(0))
    cut = (F.col("__s") > 0) & ((F.col("__n") != F.ceil(F.col("__s") / capacity)) | (F.col("__i") != F.col("__n")))
    rows = each.agg(F.count_if(lost).alias("perdidos"), F.count_if(cut).alias("cortados"), F.count_if(F.col("__n") > 0).alias("documentos"))
    return rows.select(over.alias("acima"), "perdidos", "cortados", "documentos")


def fills(packed: DataFrame, key: str, capacity: int) -> DataFrame:
    total = F.sum("tokens")
    return packed.groupBy("container").agg(F.count_distinct(key).alias("documentos"), total.alias("tokens"), (total / capacity).alias("cheio"))
